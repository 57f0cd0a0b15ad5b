"""Graph operators on edge lists: bounded propagation, frontiers, shortest paths, galaxy edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.operators.scores import in_window, noisy_or
from loomlake.operators.serving import both_ways, ranked_by, top_per


def adjacency(edges: DataFrame) -> DataFrame:
    """(me, other, rel, strength) from both ends."""
    return both_ways(edges, "src", "dst").select("me", "other", "rel", "strength")


#: Weight of each relation's type (fixed values); other types spread nothing.
TYPE_WEIGHTS = {"SUPPLY": 0.8, "INVEST": 0.6, "COMPETE": 0.5, "PARTNER": 0.5, "CO_MENTIONED": 0.4}


def spread_paths(edges: DataFrame, weights: dict[str, float], least: float, hub: int = 8, weak: str = "CO_MENTIONED") -> DataFrame:
    """(key, target, via, f, real, hops, path): one- and two-hop paths from key whose factor f is ``least`` or more.

    A hop's factor is type weight x strength x min(1, sqrt(hub / degree)) of the node it leaves, the degree counting its real relations.
    No factor is above one (strengths are at most one), so a hop below ``least`` is on no path that counts: it is left out before the
    second hop, and what is left of a node of degree k ends in few enough nodes however large k is. Paths do not depend on documents.
    """
    w = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("rel")), F.lit(0.0))
    adj = adjacency(edges)
    degree = adj.filter(F.col("rel") != weak).groupBy("me").agg(F.count(F.lit(1)).alias("k"))
    damp = F.coalesce(F.least(F.lit(1.0), F.sqrt(hub / F.col("k"))), F.lit(1.0))
    hop = adj.join(degree, "me", "left").select("me", "other", "rel", (w * F.col("strength") * damp).alias("f"), (F.col("rel") != weak).alias("real")).filter((F.col("f") >= least) & (F.col("me") != F.col("other")))
    step = F.concat_ws(">", F.col("me").cast("string"), "rel", F.col("other").cast("string"))
    one = hop.select(F.col("me").alias("key"), F.col("other").alias("target"), F.lit(None).cast(edges.schema["src"].dataType).alias("via"), "f", "real", F.lit(1).alias("hops"), step.alias("path"))
    second = hop.select(F.col("me").alias("target"), F.col("other").alias("o2"), F.col("rel").alias("r2"), F.col("f").alias("f2"), F.col("real").alias("real2"))
    two = one.join(second, "target").filter((F.col("o2") != F.col("key")) & (F.col("f") * F.col("f2") >= least))
    two = two.select("key", F.col("o2").alias("target"), F.col("target").alias("via"), (F.col("f") * F.col("f2")).alias("f"), (F.col("real") | F.col("real2")).alias("real"), F.lit(2).alias("hops"), F.concat_ws(">", "path", "r2", F.col("o2").cast("string")).alias("path"))
    return one.unionByName(two)


def propagate(
    mentions: DataFrame, edges: DataFrame, weights: dict[str, float] = TYPE_WEIGHTS, seed: float = 0.8, ok: float = 0.25, hold: float = 0.15, most: int = 12, most_ok: int = 6, active: list[str] | None = None
) -> DataFrame:
    """X-19: (doc, company, basis, hop, score, path, status, hold_reason).

    mentions: (doc, company, salience), all REPORTED with hop 0. Those of salience ``seed`` or more spread over two hops at most, along
    ``active`` relation types (all by default); a reported company is neither target nor on the way. A target's best path with a real
    relation counts if it reaches ``hold`` (OK from ``ok`` on, else LOW), otherwise its best path of co-mentions alone, always held.
    Equal scores: the shorter path, then its text. Of a document the ``most`` best targets stay, the ``most_ok`` first of them OK at most.
    """
    if active is not None:  # an idle relation spreads nothing, yet it counts for the degree
        weights = {k: v if k in active else 0.0 for k, v in weights.items()}
    paths = spread_paths(edges, weights, hold)  # salience is at most one
    reported = mentions.groupBy("doc").agg(F.collect_set("company").alias("own"))  # a document's own companies
    seeds = mentions.filter(F.col("salience") >= seed).select("doc", F.col("company").alias("key"), "salience")
    rows = seeds.join(paths, "key").filter(F.round(F.col("salience") * F.col("f"), 10) >= hold).join(reported, "doc")
    rows = rows.filter(~F.array_contains("own", F.col("target")) & (F.col("via").isNull() | ~F.array_contains("own", F.col("via"))))
    rank = F.struct((-F.round(F.col("salience") * F.col("f"), 10)).alias("s"), "hops", "path")
    best = rows.groupBy("doc", "target").agg(F.min(F.when(F.col("real"), rank)).alias("r"), F.min(F.when(~F.col("real"), rank)).alias("c"))
    b = F.coalesce("r", "c")
    found = best.select("doc", F.col("target").alias("company"), (-b["s"]).alias("score"), b["hops"].alias("hop"), b["path"].alias("path"), F.when(F.col("r").isNull(), "CO_MENTION_ONLY").when(-F.col("r.s") < ok, "LOW").alias("hold_reason"))
    found = top_per(found, ["doc"], [F.desc("score"), F.col("company")], most)
    taken = F.count_if(F.col("hold_reason").isNull()).over(Window.partitionBy("doc").orderBy(F.desc("score"), "company").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_k", taken).withColumn("hold_reason", F.when(F.col("hold_reason").isNull() & (F.col("_k") > most_ok), "RANK").otherwise(F.col("hold_reason")))
    inferred = found.select("doc", "company", F.lit("INFERRED").alias("basis"), "hop", "score", "path", F.when(F.col("hold_reason").isNull(), "OK").otherwise("HOLD").alias("status"), "hold_reason")
    named = mentions.select("doc", "company", F.lit("REPORTED").alias("basis"), F.lit(0).alias("hop"), F.col("salience").alias("score"), F.lit("").alias("path"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("hold_reason"))
    return named.unionByName(inferred)


def frontier(edges: DataFrame, centers: DataFrame, depth: int = 3) -> DataFrame:
    """X-21: (center, node, depth) of all nodes within ``depth`` hops; each hop joins the newest frontier alone."""
    adj = adjacency(edges).select("me", "other").distinct()
    seen = centers.select(F.col("center"), F.col("center").alias("node"), F.lit(0).alias("depth"))
    edge = seen
    for k in range(1, depth + 1):
        edge = edge.join(adj, edge["node"] == adj["me"]).select("center", F.col("other").alias("node")).distinct().join(seen, ["center", "node"], "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(edge)
    return seen


def shortest_paths(edges: DataFrame, centers: DataFrame, depth: int = 3) -> DataFrame:
    """X-22: (center, node, hops, penalty, bottleneck): fewest hops, then least sum of (1 - strength), with the weakest link of the path.

    Only the best path to a node survives a hop, so what is carried grows with nodes, not with paths.
    """
    adj = adjacency(edges).groupBy("me", "other").agg(F.max("strength").alias("s"))
    best = centers.select("center", F.col("center").alias("node"), F.lit(0).alias("hops"), F.lit(0.0).alias("penalty"), F.lit(1e9).alias("bottleneck"))
    edge = best
    for k in range(1, depth + 1):
        nxt = edge.join(adj, edge["node"] == adj["me"]).select("center", F.col("other").alias("node"), F.round(F.col("penalty") + 1 - F.col("s") / 10, 8).alias("penalty"), F.least("bottleneck", "s").alias("bottleneck"))
        nxt = nxt.join(best.select("center", "node"), ["center", "node"], "left_anti")
        edge = nxt.groupBy("center", "node").agg(F.min(F.struct("penalty", (-F.col("bottleneck")).alias("nb"))).alias("b")).select("center", "node", F.lit(k).alias("hops"), F.col("b.penalty").alias("penalty"), (-F.col("b.nb")).alias("bottleneck"))
        best = best.unionByName(edge)
    return best.filter("hops > 0")


def segment_pairs(mentions: DataFrame, doc: str, segment: str, company: str) -> DataFrame:
    """(doc, a, b), a < b, each once a document: companies that share a segment. Pairs are made within a segment's own row, so nothing is
    joined to itself and what comes out is bounded by what one sentence names."""
    own = mentions.groupBy(doc, segment).agg(F.array_sort(F.collect_set(company)).alias("own")).filter(F.size("own") > 1)
    first = own.select(doc, "own", F.posexplode("own").alias("i", "a"))
    return first.select(doc, "a", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("b")).distinct()


def comention_stats(mentions: DataFrame, doc: str, segment: str, company: str, least: int = 3) -> DataFrame:
    """A-07: (a, b, n_ab, n_a, n_b, n_docs, npmi) of the pairs that share a segment in ``least`` documents or more."""
    n = F.broadcast(mentions.agg(F.count_distinct(doc).alias("n_docs")))  # one row
    single = mentions.select(doc, company).distinct().groupBy(company).agg(F.count(F.lit(1)).alias("n"))
    pair = segment_pairs(mentions, doc, segment, company).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= least)
    pair = pair.join(single.select(F.col(company).alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col(company).alias("b"), F.col("n").alias("n_b")), "b").crossJoin(n)
    return pair.select("a", "b", "n_ab", "n_a", "n_b", "n_docs", npmi(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n_docs")).alias("npmi"))


def npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """F-24: normalised pointwise mutual information; 1 for a pair that is in every document."""
    d = [c.cast("double") for c in (n_ab, n_a, n_b, n)]
    return F.round(F.when(n_ab == n, 1.0).otherwise(F.log(d[0] * d[3] / (d[1] * d[2])) / -F.log(d[0] / d[3])), 6)


def comention_edges(stats: DataFrame, most: int = 5, full: float = 60.0) -> DataFrame:
    """X-15: (a, b, n, score) of the pairs of positive NPMI that are among the ``most`` best (by documents, then NPMI, then name) of
    either end: full x ln(1 + n) / ln(1 + the greatest n chosen)."""
    both = both_ways(stats.filter("npmi > 0"), "a", "b")
    chosen = top_per(both, ["me"], [F.desc("n_ab"), F.desc("npmi"), F.col("other")], most).select("a", "b", F.col("n_ab").alias("n")).distinct()
    top = F.broadcast(chosen.agg(F.max("n").alias("n_max")))  # one row
    return chosen.crossJoin(top).select("a", "b", "n", F.round(full * F.log1p("n") / F.log1p("n_max"), 6).alias("score"))


def evidence_edges(snippets: DataFrame, windows: DataFrame, undirected=("PARTNER", "COMPETE", "CO_MENTIONED"), least: float = 0.5) -> DataFrame:
    """X-14: (src, dst, rel, window_type, score, confidence, documents) of each relation whose evidence makes an edge.

    snippets: (src, dst, rel, doc, published, confidence). The edge exists if 1 - product(1 - confidence) over all its snippets is ``least``
    or more; in each window with a snippet its score is 60 + 10 min(snippets, 4). Undirected pairs count both ways as one.
    """
    flip = F.col("rel").isin(*undirected)
    rows = snippets.withColumns({"src": F.when(flip, F.least("src", "dst")).otherwise(F.col("src")), "dst": F.when(flip, F.greatest("src", "dst")).otherwise(F.col("dst"))})
    known = noisy_or(rows, ["src", "dst", "rel"], "confidence", least).select("src", "dst", "rel")
    inside = rows.join(F.broadcast(windows), in_window("published")).groupBy("src", "dst", "rel", "window_type").agg(
        (60 + 10 * F.least(F.lit(4), F.count(F.lit(1)))).cast("double").alias("score"), F.round(F.max(F.col("confidence").cast("double")), 6).alias("confidence"), F.count_distinct("doc").alias("documents")
    )  # three windows
    return inside.join(known, ["src", "dst", "rel"], "left_semi")


def best_stakes(stakes: DataFrame, investor: str, investee: str, pct: str, order: list[Column], least: float = 1.0) -> DataFrame:
    """X-17: the largest disclosed stake of each investor in each investee, ``least`` to 100 %, no company in itself; ties by ``order``."""
    good = stakes.filter((F.col(investor) != F.col(investee)) & F.col(pct).between(least, 100))
    return top_per(good, [investor, investee], [F.desc(pct), *order])


def merge_ownership(news: DataFrame, disclosed: DataFrame) -> DataFrame:
    """News relations (src, dst, rel, score) and disclosed stakes; a news INVEST in the direction of a disclosed stake gives way to it."""
    kept = news.join(disclosed.select("src", "dst", F.lit("INVEST").alias("rel")), ["src", "dst", "rel"], "left_anti").withColumn("source", F.lit("NEWS"))
    return kept.unionByName(disclosed.select("src", "dst", F.lit("INVEST").alias("rel"), "score", F.lit("DISCLOSED").alias("source")))


def merge_chains(chains: list[DataFrame], key: list[str], score: str) -> DataFrame:
    """X-16: the higher score of each key over all chains; the earlier chain on a tie."""
    rows = None
    for k, c in enumerate(chains):
        c = c.withColumn("_chain", F.lit(k))
        rows = c if rows is None else rows.unionByName(c)
    return top_per(rows, key, [F.desc(score), "_chain"]).drop("_chain")


#: How much of a company's score an edge hands on, by its type (fixed values); .3 for any other.
EDGE_FACTORS = {"ownership": 0.8, "co_mention": 0.5, "sector": 0.3, "correlation": 0.4}


def expand_impact(companies: DataFrame, industries: DataFrame, members: DataFrame, edges: DataFrame, base: float = 0.6, most: float = 0.6, least_edge: float = 0.2, least: float = 0.05) -> DataFrame:
    """X-24: (doc, company, score, source, reasons): whom a document exposes.

    companies: (doc, company, confidence) named in it, with that score. industries: (doc, industry, n) it speaks of: their members (company,
    industry) get base (1 + ln n) / sqrt(size), at most ``most``. edges: (src, dst, kind, weight) of ``least_edge`` or more, one hop from
    a named company: its confidence x weight x the kind's factor (a "sector" edge divided by the root of the other's industry), from
    ``least`` on. Named companies get no indirect reason. The greatest score counts, then direct before industry before graph.
    """
    direct = companies.groupBy("doc", "company").agg(F.max("confidence").alias("s")).withColumn("source", F.lit("1direct"))
    size = members.groupBy("industry").agg(F.count(F.lit(1)).alias("size"))
    spoken = industries.join(size, "industry").select("doc", "industry", F.least(F.lit(most), base * (1 + F.log(F.greatest("n", F.lit(1)).cast("double"))) / F.sqrt("size")).alias("s"))
    industry = spoken.join(members, "industry").select("doc", "company", "s", F.lit("2industry").alias("source"))
    factor = F.coalesce(F.element_at(F.create_map(*[x for k, v in EDGE_FACTORS.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(0.3))
    adj = both_ways(edges.filter(F.col("weight") >= least_edge), "src", "dst").select("me", "other", "kind", "weight")
    adj = adj.join(members.join(size, "industry").select(F.col("company").alias("other"), "size"), "other", "left")
    w = F.col("weight") * factor / F.when(F.col("kind") == "sector", F.sqrt(F.coalesce("size", F.lit(1)))).otherwise(1.0)
    graph = direct.join(adj, F.col("company") == F.col("me")).select("doc", F.col("other").alias("company"), (F.col("s") * w).alias("s"), F.lit("3graph").alias("source")).filter(F.col("s") >= least)
    indirect = industry.unionByName(graph).join(direct.select("doc", "company"), ["doc", "company"], "left_anti")
    rows = direct.unionByName(indirect).withColumn("s", F.round("s", 3))
    return rows.groupBy("doc", "company").agg(F.max("s").alias("score"), F.min_by("source", F.struct(-F.col("s"), "source")).alias("source"), F.count(F.lit(1)).alias("reasons")).withColumn("source", F.substring("source", 2, 20))


#: Weights of the reasons that make a link special (fixed values).
LINK_REASONS = {"industry": 0.12, "market": 0.08, "frenemy": 0.42, "quiet": 0.2, "rare": 0.34, "far": 0.2}


def special_links(edges: DataFrame, nodes: DataFrame, least: float = 0.42, least_edge: float = 55.0) -> DataFrame:
    """X-23: (src, dst, rel, score, reasons) of the links worth a look.

    edges: (src, dst, rel, score 0-100); nodes: (id, industry, market, x, y, z), a null industry is not known. Reasons, each 0 to 1 x its weight:
    industry and market differ; frenemy, the pair competes and does something else too; quiet, both ends in the lower half by degree;
    rare, the only link of its two industries and type; far, the layout distance against the median of its score band (of all where
    the band has under four links), from 1.6 times on. A link needs frenemy, or rare, or quiet and far together.
    """
    ends = both_ways(edges, "src", "dst")
    degree = nodes.select("id").join(ends.groupBy(F.col("me").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    ranked = ranked_by(degree, ["degree", "id"])
    many = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("nodes")))  # one row
    pct = ranked.crossJoin(many).select("id", F.when(F.col("nodes") > 1, F.col("rank") / (F.col("nodes") - 1)).otherwise(1.0).alias("pct"))
    n = nodes.join(pct, "id")
    rows = edges
    for end, k in (("src", "a"), ("dst", "b")):
        rows = rows.join(n.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{k}") for c in ("industry", "market", "x", "y", "z", "pct")]), end)
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = edges.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.bool_or(F.col("rel") == "COMPETE").alias("competes"), F.count_distinct("rel").alias("kinds"))
    ia, ib = F.coalesce("industry_a", F.lit("")), F.coalesce("industry_b", F.lit(""))
    rows = rows.withColumns({"lo": lo, "hi": hi, "ilo": F.least(ia, ib), "ihi": F.greatest(ia, ib), "band": F.floor(F.col("score") / 10), "dist": F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "xyz"))})
    combos = rows.groupBy("ilo", "ihi", "rel").agg(F.count(F.lit(1)).alias("combo"))
    bands = rows.groupBy("band").agg(F.median("dist").alias("mid"), F.count(F.lit(1)).alias("k")).filter("k >= 4").select("band", "mid")  # ten bands
    whole = F.broadcast(rows.agg(F.median("dist").alias("mid_all")))  # one row
    rows = rows.filter(F.col("score") >= least_edge).join(pairs, ["lo", "hi"]).join(combos, ["ilo", "ihi", "rel"]).join(F.broadcast(bands), "band", "left").crossJoin(whole)
    known = F.col("industry_a").isNotNull() & F.col("industry_b").isNotNull()
    other = known & (F.col("industry_a") != F.col("industry_b"))
    middle = F.coalesce("mid", "mid_all")
    strength = {
        "industry": other.cast("double"),
        "market": (F.col("market_a") != F.col("market_b")).cast("double"),
        "frenemy": (F.col("competes") & (F.col("kinds") > 1)).cast("double"),
        "quiet": (0.5 - F.greatest("pct_a", "pct_b")) / 0.5,
        "rare": (other & (F.col("combo") <= 1)).cast("double"),
        "far": F.when(middle > 0, F.col("dist") / middle - 1.6),
    }
    weigh = {k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0)))) * LINK_REASONS[k] for k, v in strength.items()}
    rows = rows.withColumns({f"w_{k}": v for k, v in weigh.items()})
    signature = (F.col("w_frenemy") > 0) | (F.col("w_rare") > 0) | ((F.col("w_quiet") > 0) & (F.col("w_far") > 0))
    raw = F.least(F.lit(1.0), sum(F.col(f"w_{k}") for k in weigh))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"w_{k}") > 0, k) for k in sorted(weigh)])), ",")
    out = rows.filter(signature).select("src", "dst", "rel", F.round(raw * (0.6 + 0.4 * F.col("score") / 100), 6).alias("score"), reasons.alias("reasons"))
    return out.filter(F.col("score") >= least)


def corroborate(edges: DataFrame, signals: list[DataFrame], base: str = "strength", share: float = 0.25) -> DataFrame:
    """X-35: edges (src, dst, ...) with ``score``: base plus ``share`` of the strongest signal of the unordered pair. signals: (a, b, value), a < b,
    values of 0 to 1; a pair without any gets none. A signal never makes an edge."""
    rows = signals[0]
    for s in signals[1:]:
        rows = rows.unionByName(s)
    best = rows.groupBy(F.col("a").alias("_lo"), F.col("b").alias("_hi")).agg(F.max("value").alias("_v"))
    out = edges.withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")}).join(best, ["_lo", "_hi"], "left")
    return out.withColumn("score", F.round(F.col(base) + share * F.coalesce("_v", F.lit(0.0)), 6)).drop("_lo", "_hi", "_v")


def greedy_list(ranked: DataFrame, cap: int = 2, most: int = 500) -> DataFrame:
    """O-09: the ``most`` best links (src, dst, score, ...): in order of rank (ties: src, dst, rel) each is taken if its pair is not in the list
    yet and both ends have fewer than ``cap``.

    Sequential by nature, so one task reads all links, sorted and batch by batch; it holds the counts of the nodes taken alone.
    """

    def pick(batches):
        used: dict = {}
        pairs: set = set()
        taken = 0
        for pdf in batches:
            keep = []
            for k, (a, b) in enumerate(zip(pdf["src"], pdf["dst"])):
                pair = (a, b) if a < b else (b, a)
                if taken < most and pair not in pairs and used.get(a, 0) < cap and used.get(b, 0) < cap:
                    pairs.add(pair)
                    used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                    taken += 1
                    keep.append(k)
            yield pdf.iloc[keep]

    return ranked.repartition(1).sortWithinPartitions(F.desc("score"), "src", "dst", *[c for c in ranked.columns if c == "rel"]).mapInPandas(pick, ranked.schema)
