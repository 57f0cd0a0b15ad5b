"""Windowed relationship scores (A-01 to A-06, A-32, A-33) as DataFrame operators.

Windows are a table (name, kind, n): ``days`` and ``years`` look back from ``as_of`` half-open, ``all`` has no lower bound. Means
of decimals are taken on whole micro-units and rounded once, HALF_UP: ``round(avg(x))`` would round twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT_WINDOWS = (("7D", "days", 7), ("30D", "days", 30), ("90D", "days", 90))
LONG_WINDOWS = (("30D", "days", 30), ("1Y", "years", 1), ("10Y", "years", 10))


def window_table(spark: SparkSession, as_of: str, windows=LONG_WINDOWS) -> DataFrame:
    """(window_type, start_at, end_at): a handful of rows, so safe to broadcast."""
    start = {"days": "CAST('{a}' AS TIMESTAMP_NTZ) - INTERVAL {n} DAY", "years": "CAST('{a}' AS TIMESTAMP_NTZ) - INTERVAL {n} YEAR", "all": "CAST(NULL AS TIMESTAMP_NTZ)"}
    return spark.sql(" UNION ALL ".join(f"SELECT '{w}' AS window_type, {start[k].format(a=as_of, n=n)} AS start_at, CAST('{as_of}' AS TIMESTAMP_NTZ) AS end_at" for w, k, n in windows))


def in_window(at: str) -> Column:
    return (F.col("start_at").isNull() | (F.col(at) >= F.col("start_at"))) & (F.col(at) < F.col("end_at"))


def half_up_mean(total: Column, n: Column) -> Column:
    """Integer mean, halves away from zero for non-negative totals."""
    return F.when(n > 0, F.floor((total * 2 + n) / (n * 2)))


def canonical(df: DataFrame, undirected=("PARTNER", "COMPETE", "CO_MENTIONED"), a: str = "source_company_id", b: str = "target_company_id", rel: str = "relationship_type") -> DataFrame:
    """Undirected relations with their lower endpoint first; self relations dropped."""
    flip = F.col(rel).isin(*undirected)
    return df.filter(F.col(a) != F.col(b)).withColumns({a: F.when(flip, F.least(a, b)).otherwise(F.col(a)), b: F.when(flip, F.greatest(a, b)).otherwise(F.col(b))})


def violations(df: DataFrame) -> DataFrame:
    """P-05: rows outside the contract, with the first rule each breaks."""
    rule = (
        F.when(F.col("source_company_id").isNull() | F.col("target_company_id").isNull() | F.col("document_id").isNull(), "null_key")
        .when(F.col("source_company_id") == F.col("target_company_id"), "self_relation")
        .when(~F.col("document_type").isin("NEWS", "DISCLOSURE"), "document_type")
        .when(F.col("score").isNull() | ~F.col("score").between(0, 100), "score_range")
        .when(~F.col("confidence").between(0, 1), "confidence_range")
        .when(~F.col("impact_direction").isin("POSITIVE", "NEGATIVE", "NEUTRAL", "MIXED"), "direction")
    )
    return df.withColumn("rule", rule).filter(F.col("rule").isNotNull())


def evidence_mean(evidence: DataFrame, windows: DataFrame) -> DataFrame:
    """A-01: per relation and window the mean of NEWS and of DISCLOSURE scores, their equal blend, direction if unanimous.

    Every relation has a row for every window; a null score means no evidence, 0 an observed zero.
    """
    key = ["source_company_id", "target_company_id", "relationship_type"]
    rows = canonical(evidence).withColumn("micro", (F.col("score") * 1_000_000).cast("long"))
    rows = rows.select(*key, "document_id", "document_type", "published_at", "impact_direction", "micro").distinct()  # rows that disagree are for dq.conflicts
    news, filed = F.col("document_type") == "NEWS", F.col("document_type") == "DISCLOSURE"
    cells = []  # a few windows, all in one aggregate: no grid, no range join
    for w in windows.collect():
        start = F.lit(True) if w["start_at"] is None else F.col("published_at") >= F.lit(w["start_at"]).cast("timestamp_ntz")
        inside = start & (F.col("published_at") < F.lit(w["end_at"]).cast("timestamp_ntz"))
        direction = F.when(inside, F.col("impact_direction"))
        cells.append(
            F.struct(
                F.lit(w["window_type"]).alias("window_type"), F.sum(F.when(inside & news, F.col("micro"))).alias("news_sum"), F.count_if(inside & news).alias("news_n"),
                F.sum(F.when(inside & filed, F.col("micro"))).alias("disclosure_sum"), F.count_if(inside & filed).alias("disclosure_n"), F.min(direction).alias("low"), F.max(direction).alias("high"),
            )
        )
    out = rows.groupBy(*key).agg(F.array(*cells).alias("cells")).select(*key, F.inline("cells"))
    n, d = half_up_mean(F.col("news_sum"), F.col("news_n")), half_up_mean(F.col("disclosure_sum"), F.col("disclosure_n"))
    out = out.withColumn("news_micro", n).withColumn("disclosure_micro", d)
    both = F.col("news_micro").isNotNull() & F.col("disclosure_micro").isNotNull()
    score = F.when(both, half_up_mean(F.col("news_micro") + F.col("disclosure_micro"), F.lit(2))).otherwise(F.coalesce("news_micro", "disclosure_micro"))
    return out.select(
        *key, "window_type", "news_micro", "disclosure_micro", score.alias("score_micro"),
        F.coalesce("news_n", F.lit(0)).alias("news_n"), F.coalesce("disclosure_n", F.lit(0)).alias("disclosure_n"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("direction"),
    )


def saturating_support(evidence: DataFrame, windows: DataFrame, scale: float = 5.0, correlation: DataFrame | None = None, most_bonus: float = 3.0) -> DataFrame:
    """A-02: greatest confidence per document, 100(1 - e^(-sum/scale)) per source, mean of the sources present, at most 100.

    correlation: (a, b, corr) of unordered pairs, a < b, made of prices before the as-of time alone: adds ``most_bonus`` x |corr|; it makes no score by itself.
    """
    key = ["source_company_id", "target_company_id", "relationship_type", "window_type"]
    doc = canonical(evidence).join(F.broadcast(windows), in_window("published_at")).groupBy(*key, "document_type", "document_id").agg(F.max("confidence").cast("double").alias("c"))
    part = doc.groupBy(*key).agg(F.sum(F.when(F.col("document_type") == "NEWS", F.col("c"))).alias("n"), F.sum(F.when(F.col("document_type") == "DISCLOSURE", F.col("c"))).alias("d"))
    part = part.withColumns({"n": -100 * F.expm1(-F.col("n") / scale), "d": -100 * F.expm1(-F.col("d") / scale)})
    blend = F.when(F.col("n").isNotNull() & F.col("d").isNotNull(), (F.col("n") + F.col("d")) / 2).otherwise(F.coalesce("n", "d"))
    if correlation is not None:
        c = correlation.select(F.col("a").alias("_lo"), F.col("b").alias("_hi"), "corr")
        part = part.withColumns({"_lo": F.least(*key[:2]), "_hi": F.greatest(*key[:2])}).join(c, ["_lo", "_hi"], "left")
        blend = blend + most_bonus * F.least(F.lit(1.0), F.abs(F.coalesce("corr", F.lit(0.0))))
    return part.select(*key, F.round("n", 6).alias("news_score"), F.round("d", 6).alias("disclosure_score"), F.round(F.least(F.lit(100.0), blend), 6).alias("score"))


def evidence_confidence(evidence: DataFrame, publisher: str = "publisher") -> DataFrame:
    """A-32: .50 + .35(1 - e^(-n/8)), +.05 for a disclosure, +.05 for both sources, +.03 for two publishers or more, +.02 for a span of 180 days, at most 1."""
    key = ["source_company_id", "target_company_id", "relationship_type"]
    g = canonical(evidence).groupBy(*key).agg(
        F.count_distinct("document_id").alias("n"), F.bool_or(F.col("document_type") == "DISCLOSURE").alias("d"), F.bool_or(F.col("document_type") == "NEWS").alias("w"),
        F.count_distinct(publisher).alias("publishers"), F.datediff(F.max("published_at"), F.min("published_at")).alias("span"),
    )
    def bonus(c, v):
        return F.when(c, v).otherwise(0.0)

    total = 0.5 - 0.35 * F.expm1(-F.col("n") / 8) + bonus(F.col("d"), 0.05) + bonus(F.col("d") & F.col("w"), 0.05) + bonus(F.col("publishers") >= 2, 0.03) + bonus(F.col("span") >= 180, 0.02)
    return g.select(*key, "n", F.round(F.least(F.lit(1.0), total), 6).alias("confidence"))


def invest_score(stake: Column) -> Column:
    """A-05: 100(1 - e^(-stake / .28)), 0 below a twentieth; stake as a share."""
    return F.when(stake < 0.05, 0.0).otherwise(F.round(F.least(F.lit(100.0), -100 * F.expm1(-stake / 0.28)), 6))


def noisy_or(edges: DataFrame, key: list[str], confidence: str, least: float = 0.5) -> DataFrame:
    """A-06: 1 - product(1 - confidence) per key, kept from ``least`` on; one certain piece makes the edge certain."""
    c = F.col(confidence).cast("double")
    g = edges.groupBy(*key).agg(F.max(c).alias("m"), F.sum(F.when(c < 1, F.log1p(-c))).alias("s"), F.count(F.lit(1)).alias("pieces"))
    return g.select(*key, F.round(F.when(F.col("m") >= 1, 1.0).otherwise(-F.expm1("s")), 6).alias("strength"), "pieces").filter(F.col("strength") >= least)
