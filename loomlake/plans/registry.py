"""All queries of the core by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlake.plans import graph, more, pages, pipelines, platform, protocol, quality, scores, serving, text, timeseries

_MODULES = (quality, scores, serving, timeseries, graph, text, platform, more, protocol, pipelines, pages)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return scores.a01(spark, d)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
