"""Readers (S-01 to S-28): pruned, schema given, never inferred where rows decide it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def partitioned(spark: SparkSession, root: str, where: Column | None = None) -> DataFrame:
    """S-01: partition columns stay strings; the filter prunes directories."""
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    df = spark.read.option("basePath", root).parquet(root)
    return df if where is None else df.filter(where)


def many_roots(spark: SparkSession, roots: list[str]) -> DataFrame:
    """S-02: one read per root, united by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(r) for r in roots])


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-03: a line that does not parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-13: bad lines are dropped; gzip by name."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """S-05: distinct non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''").distinct()


def dictionary_csv(spark: SparkSession, path: str, schema: str, null: str = "") -> DataFrame:
    """S-06, S-28: CSV with a header, the schema given, a marker for null; Spark drops a leading byte-order mark."""
    return spark.read.schema(schema).option("header", True).option("nullValue", null).option("encoding", "UTF-8").csv(path)


def offsets_accounted(valid: DataFrame, quarantined: DataFrame, ranges: DataFrame) -> DataFrame:
    """S-08: offsets of [start, end) that are in neither table, or in both or twice: (partition, offset, times). Empty means accounted for.

    ranges: (partition, start, end).
    """
    want = ranges.select("partition", F.explode(F.sequence("start", F.col("end") - 1)).alias("offset"))
    have = valid.select("partition", "offset").unionByName(quarantined.select("partition", "offset")).groupBy("partition", "offset").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, ["partition", "offset"], "full").select("partition", "offset", F.coalesce("n", F.lit(0)).alias("times")).filter("times <> 1")


def article_store(df: DataFrame, partition: str, key: str) -> DataFrame:
    """S-14: the row of the last partition by name wins for each key."""
    w = Window.partitionBy(key).orderBy(F.desc(partition))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def changes(feed: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """S-16: the newest status of each key."""
    return feed.groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias(status), F.max(at).alias(at))


def uncovered(covered: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """S-18: wanted days (key, day) that no covered range (key, first, last) holds. An empty fetch covers nothing, so it stays wanted."""
    c = covered.select(key, F.explode(F.sequence("first", "last")).alias("day")).distinct()
    return wanted.join(c, [key, "day"], "left_anti")


def requested(spark: SparkSession, **arrays) -> DataFrame:
    """S-27: parallel arrays as a table."""
    names = list(arrays)
    return spark.createDataFrame(list(zip(*arrays.values())), names)


def bisected(counts: list[tuple[str, int]], most: int) -> list[tuple[str, str, int]]:
    """S-15: windows (first day, last day, hits) of at most ``most`` hits, halved until they fit; a single day is never split."""
    out = []

    def split(a: int, b: int) -> None:
        hits = sum(n for _, n in counts[a:b])
        if hits <= most or b - a <= 1:
            if b > a:
                out.append((counts[a][0], counts[b - 1][0], hits))
            return
        m = (a + b) // 2
        split(a, m)
        split(m, b)

    split(0, len(counts))
    return out


def asked_of(companies: DataFrame, market: str, providers: dict[str, str], other: str) -> DataFrame:
    """S-19: companies with the provider that their market is asked of."""
    out = F.lit(other)
    for m, p in providers.items():
        out = F.when(F.col(market) == m, p).otherwise(out)
    return companies.withColumn("provider", out)


def combine_csv(spark: SparkSession, roots: list[str], schema: str, keys: list[str]) -> DataFrame:
    """S-20: CSV folders partitioned by key columns as one typed table; a row that comes again, word for word, stays once, and a key with two contents fails the read."""
    from loomlake.operators.dq import duplicate_keys

    rows = reduce(DataFrame.unionByName, [spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("basePath", r).csv(r) for r in roots]).distinct()
    if not duplicate_keys(rows, keys).isEmpty():
        raise ValueError(f"rows that disagree on {', '.join(keys)}")
    return rows


def ranged(df: DataFrame, key: str, parts: int) -> list[str]:
    """S-25: conditions that cut a table by its key as a partitioned JDBC read does: equal steps from least to greatest, the ends open, null keys in the first."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or parts < 2 or high - low < parts:
        return ["true"]
    edges = [low + (high - low) * k // parts for k in range(1, parts)]
    middle = [f"{key} >= {a} and {key} < {b}" for a, b in zip(edges, edges[1:])]
    return [f"{key} < {edges[0]} or {key} is null", *middle, f"{key} >= {edges[-1]}"]


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """S-25: a service table in ranges of its key; filters and columns go to the server. Needs the database's driver on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
    return reader.option("numPartitions", parts).option("fetchsize", 10_000).options(**options).load()
