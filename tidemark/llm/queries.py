"""Queries p8 to p10 over the text tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import mixing, subjects
from tidemark.llm.tokens import encode_corpus
from tidemark.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    sizes = mixing.sized(table(spark, folder, "documents").select("doc_id", "source", "text"), targets)
    return mixing.mix(sizes, targets), targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mix(spark, folder))


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix, whatever the documents: no source is used more often than it may be, and each that has
    text has its target's part of what such sources have, within a hundredth."""
    got = mixing.shares(*_mix(spark, folder))
    some = F.col("tokens") > 0
    part = F.col("target_share") / F.sum(F.when(some, F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # one row a source
    kept = F.when(some, F.abs(F.col("actual_share") - part) < 0.01).otherwise(F.col("actual_share") == 0)
    return got.select("source", some.alias("used"), (F.col("most_used") <= F.col("max_repeats")).alias("within_cap"), kept.alias("share_kept"))


def _assigned(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    documents = table(spark, folder, "documents")
    areas = sorted(r["subject"] for r in table(spark, folder, "subject_areas").where("subject IS NOT NULL").select("subject").distinct().collect())  # the list of subjects doesn't grow
    model = subjects.train(documents, table(spark, folder, "subject_labels"), areas)
    return subjects.assign_subjects(documents, model, ["doc_id"]), areas


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder)[0].select("doc_id", F.explode("subjects").alias("subject"))


def p10_makeup(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.makeup(*_assigned(spark, folder))


QUERIES = {f.__name__: f for f in (p8_ids, p9_mix, p9_shares, p9_kept, p10_found, p10_makeup)}
SQL = {
    "p9_kept": """
SELECT t.source, t.max_repeats > 0 AND d.source IS NOT NULL AS used, true AS within_cap, true AS share_kept
FROM mix_targets t LEFT JOIN (SELECT DISTINCT source FROM documents WHERE text <> '') d ON d.source = t.source WHERE t.source IS NOT NULL""",
}
