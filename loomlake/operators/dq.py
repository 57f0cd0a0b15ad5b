"""Data-quality checks as DataFrames of violations (Q-01 to Q-11): an empty result is a pass, and every check is one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q-01."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q-02: keys with their number of rows; only the keys are shuffled."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def conflicts(df: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """Q-03, Q-04: keys whose rows disagree; nulls count as a value of their own."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*[F.struct(F.col(f)) for f in facts])).alias("versions")).filter("versions > 1")


def schema_differences(df: DataFrame, declared: dict[str, str]) -> list[str]:
    """Q-05."""
    have = dict(df.dtypes)
    return [f"{k}: {have.get(k, 'absent')} instead of {t}" for k, t in declared.items() if have.get(k) != t] + [f"{k}: not declared" for k in have if k not in declared]


def incomplete(df: DataFrame, keys: list[str], part: str, n: int) -> DataFrame:
    """Q-07: keys that lack one of n parts."""
    return df.groupBy(*keys).agg(F.count_distinct(part).alias("parts")).filter(F.col("parts") != n)


def rederived(df: DataFrame, stored: str, derived: F.Column, tolerance: float = 0.0) -> DataFrame:
    """Q-08: rows whose stored value is not what it should be; one null alone is a difference."""
    off = F.when(F.col(stored).isNull() | derived.isNull(), ~(F.col(stored).isNull() & derived.isNull())).otherwise(F.abs(F.col(stored) - derived) > tolerance)
    return df.filter(off)


def contract(df: DataFrame, rules: dict[str, F.Column]) -> tuple[DataFrame, DataFrame]:
    """Q-11: rows that keep all rules, and the others with the names of the rules they break. A rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    tagged = df.withColumn("broken", broken)
    return tagged.filter(F.size("broken") == 0).drop("broken"), tagged.filter(F.size("broken") > 0)
