"""Queries of the text problems by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm.leaks import leaked
from loomlake.llm.names import link_names
from loomlake.llm.nearcopies import NearCopies, pairs_within
from loomlake.llm.stuffing import stuffed
from loomlake.llm.tokens import encode_corpus
from loomlake.operators.skew import join_split
from loomlake.session import written
from loomlake.sources.tables import table


def _stories(spark: SparkSession, d: str) -> NearCopies:
    rows = table(spark, d, "source_document").filter("body is not null").select("document_id", F.concat_ws(" ", "title", "body").alias("all"))
    return NearCopies(rows, "document_id", "all", similarity=0.75)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different documents of one group: TESTDATA.md asks for the pairs themselves."""
    return pairs_within(_stories(spark, d).groups(), "document_id")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same groups in linear form: one row per document and group, the group named by its least document, with its size."""
    g = _stories(spark, d).groups().distinct()
    names = g.groupBy("group").agg(F.min("document_id").alias("representative"), F.count(F.lit(1)).alias("members"))
    return g.join(names, "group").select("document_id", "representative", "members")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved aliases with the one company they mean: distinct spellings are linked, then the rows take the link of theirs."""
    companies = table(spark, d, "companies")
    names = reduce(
        DataFrame.unionByName,
        [companies.select("ticker", F.col(c).alias("name")) for c in ("name_official", "name_en")] + [table(spark, d, "company_alias").select("ticker", F.col("alias_name").alias("name"))],
    )
    rows = table(spark, d, "alias_freq").filter("ticker is null and alias is not null").select("alias_id", "alias")
    links = written(link_names(rows, "alias", names, "ticker", "name"), "p2-links").withColumnRenamed("entity", "ticker")
    return join_split(rows, links, ["alias"]).filter("ticker is not null").select("alias_id", "ticker")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an item with up to two edited characters among them."""
    return leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", edits=2)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed(table(spark, d, "documents"), "doc_id", "text", "lang")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_edited": p8_edited, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    return {}
