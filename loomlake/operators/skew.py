"""Joins that survive one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_split(rows: DataFrame, summary: DataFrame, keys: list[str], share: int = 32) -> DataFrame:
    """rows LEFT JOIN summary on keys (null-free in summary, one summary row per key).

    Keys with more than 1/share of the rows are hot: at most ``share`` of them exist, whatever the data, so their summary
    rows are broadcast and their rows never meet in one task. All other keys are joined by a shuffle.
    """
    counts = rows.groupBy(*keys).count()
    n = rows.count()
    hot = [r.asDict() for r in counts.filter(F.col("count") > max(n // share, 1000)).select(*keys).limit(share).collect()]
    if not hot:
        return rows.join(summary, keys, "left")
    spark = rows.sparkSession
    marks = spark.createDataFrame([tuple(h[k] for k in keys) for h in hot], rows.select(*keys).schema)
    hot_summary = F.broadcast(summary.join(F.broadcast(marks), keys, "left_semi"))
    is_hot = F.lit(False)
    for h in hot:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.lit(h[k]))
        is_hot = is_hot | same
    return rows.filter(is_hot).join(hot_summary, keys, "left").unionByName(rows.filter(~is_hot).join(summary, keys, "left"))
