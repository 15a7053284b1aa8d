"""Joins whose keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import OWN
from tidemark.session import parallelism

PART, PARTS = f"{OWN}part", f"{OWN}parts"
#: Rows of one key that a single task may hold; a key with more is split.
ROWS_PER_TASK = 1_000_000
#: More keys than this are never split; a broadcast list of them takes some ten megabytes at most.
MOST_HOT = 100_000


def hot_keys(rows: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows, or than one in ``MOST_HOT`` of all rows if that is more, and the number of
    parts to split each into.

    Counts combine map-side. Fewer than ``MOST_HOT`` keys can hold that many rows each, however many rows there are: that
    bound is why the result may be broadcast.
    """
    some = rows.where(F.col(key).isNotNull())
    least = F.greatest(F.lit(rows_per_task), (some.agg(F.count("*")).scalar() / MOST_HOT).cast("bigint"))
    counts = some.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    return counts.select(key, F.ceil(F.col("_n") / rows_per_task).cast("int").alias(PARTS))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner", counted: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``left`` joined to ``right`` (few rows a key) on ``key`` with the hot keys of ``left`` split over several tasks.

    Rows of a hot key get a part from a hash of the columns ``spread``; the right side's rows of that key are repeated
    once for each part. Keys that aren't hot stay in one part, so nothing else grows. ``counted`` is a cheaper frame to
    count keys in (at least the rows of ``left``). Null keys match nothing; ``how="left"`` keeps such rows of ``left``, spread over all tasks.
    """
    hot = F.broadcast(hot_keys(left if counted is None else counted, key, rows_per_task))
    parts = F.coalesce(F.col(PARTS), F.lit(1))
    scattered = F.when(F.col(key).isNull(), F.lit(parallelism(left.sparkSession))).otherwise(parts)  # null keys match nothing
    a = left.join(hot, key, "left").withColumn(PART, F.pmod(F.xxhash64(*spread), scattered).cast("int")).drop(PARTS)
    b = right.join(hot, key, "left").withColumn(PART, F.explode(F.sequence(F.lit(0), parts - 1))).drop(PARTS)
    return a.join(b, [key, PART], how).drop(PART)
