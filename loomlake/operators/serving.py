"""Building blocks of serving queries: optional predicates, search rank, keyset pages, top-1 per key, either-direction joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.session import written


def optional(df: DataFrame, **wanted) -> DataFrame:
    """P-06: equality filters for those parameters that are given."""
    return reduce(lambda out, kv: out.filter(F.col(kv[0]) == kv[1]), [kv for kv in wanted.items() if kv[1] is not None], df)


def contains_ignoring_case(c: str, keyword: str) -> Column:
    """P-07: the keyword's wildcards are ordinary characters."""
    return F.lower(F.col(c)).contains(keyword.lower())


def search_rank(code: str, name: str, aliases: str, keyword: str) -> Column:
    """P-08: 0 exact code, 1 exact name or alias, 2 prefix, 3 contained, null no match. aliases: an array column."""
    k = keyword.lower()
    low = F.transform(F.coalesce(F.col(aliases), F.array().cast("array<string>")), F.lower)
    n = F.lower(F.col(name))
    return (
        F.when(F.lower(F.col(code).cast("string")) == k, 0)
        .when((n == k) | F.array_contains(low, k), 1)
        .when(n.startswith(k) | F.exists(low, lambda x: x.startswith(k)), 2)
        .when(n.contains(k) | F.exists(low, lambda x: x.contains(k)), 3)
    )


def after(values: list[tuple[str, object, bool]]) -> Column:
    """P-09, P-10: rows behind a cursor. values: (column, cursor's value as a Column, descending) in the page's order."""
    out, equal = F.lit(False), F.lit(True)
    for name, v, down in values:
        out = out | (equal & ((F.col(name) < v) if down else (F.col(name) > v)))
        equal = equal & (F.col(name) == v)
    return out


def page(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """O-04: one row more than the page, which tells whether another follows."""
    return df.orderBy(*order).limit(size + 1)


def top_per(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """J-11, W-01, W-17: the first n rows of each key; Spark limits each key before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def counts_before(df: DataFrame, key: str, us: str, days: tuple[int, ...]) -> DataFrame:
    """W-11: df with ``n<d>`` for each d of days: rows of the same key from d days before a row's own µs up to the µs before it.

    As SQL counts RANGE BETWEEN d days PRECEDING AND 1 PRECEDING; rows of a null time are one another's peers. A window of whole days is all
    rows of the days before, less the rows before the same time of its first day, plus those of the row's own day: so rows meet by key and
    day, each once itself and once more for each d, and a running count goes over them. Time grows with the rows, not with rows a window.
    """
    day_us = 86_400_000_000
    rows = df.withColumns({"_at": F.col(us), "_back": F.lit(0)})
    moved = df.filter(F.col(us).isNotNull()).select(key, F.inline(F.array(*[F.struct((F.col(us) + d * day_us).alias("_at"), F.lit(d).alias("_back")) for d in days])))
    day = F.expr(f"(_at - pmod(_at, {day_us}L)) div {day_us}L")
    w = Window.partitionBy(key, "_day").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    seen = {f"_seen{d}": F.count(F.when(F.col("_back") == d, 1)).over(w) for d in (0, *days)}
    met = rows.unionByName(moved, allowMissingColumns=True).withColumn("_day", day).withColumns(seen).filter("_back = 0")
    a_day = rows.filter("_at is not null").withColumn("_day", day).groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_day")
    a_day = a_day.select(F.col(key).alias("_key"), F.col("_day").alias("_on"), *[F.coalesce(F.sum("_n").over(before.rangeBetween(-d, -1)), F.lit(0)).alias(f"_days{d}") for d in days])
    out = met.join(a_day, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_day") == F.col("_on")), "left")
    return out.select(*df.columns, *[(F.col("_seen0") + F.coalesce(f"_days{d}", F.lit(0)) - F.col(f"_seen{d}")).alias(f"n{d}") for d in days])


def ranked_by(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with its position from 0 in a total order, without one task that sees all rows: rows are sorted in ranges, written, and each
    range's rows are counted; a row's rank is its place in its range plus the rows of the ranges before. The order must have no ties."""
    own = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    counts = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def both_ways(df: DataFrame, a: str, b: str, directed: Column | None = None) -> DataFrame:
    """J-15, U-01: each relation seen from either end (from its source alone where ``directed``), as (me, other, ...)."""
    forward = df.withColumns({"me": F.col(a), "other": F.col(b)})
    back = (df if directed is None else df.filter(~directed)).withColumns({"me": F.col(b), "other": F.col(a)})
    return forward.unionByName(back)


def replace_keys(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """K-12, U-08: rows of the new keys replace those of the target."""
    return target.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """S-14, U-07: the last row of each key by an order without ties."""
    return top_per(df, key, order)
