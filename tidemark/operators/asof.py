"""Attributes as known at event time, by one change history per attribute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import OWN, free_name
from tidemark.operators.skew import ROWS_PER_TASK, salted_join
from tidemark.operators.snapshots import standing_rows


def attribute_changes(snapshots: DataFrame, key: str, attributes: list[str], day: str = "_batch_date", recency: str = "_ingested_at") -> DataFrame:
    """Independent change histories, long form: (key, ``attribute``, ``since``, ``value`` as text).

    A value is recorded on the day it is first seen and on each day it differs from the last one seen; null is a value.
    """
    states = standing_rows(snapshots, key, attributes, day, recency)
    order = Window.partitionBy(key).orderBy(day)
    seen = states.select(key, day, *attributes, (F.row_number().over(order) == 1).alias("_first"), *[F.lag(a).over(order).alias(f"_was_{i}") for i, a in enumerate(attributes)])
    entries = F.array(*[
        F.when(F.col("_first") | ~F.col(a).eqNullSafe(F.col(f"_was_{i}")), F.struct(F.lit(a).alias("attribute"), F.col(day).alias("since"), F.col(a).cast("string").alias("value")))
        for i, a in enumerate(attributes)
    ])
    return seen.select(key, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_e")).select(key, "_e.*")


def packed_histories(changes: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One row a key with one array per attribute of (since, value), oldest first. An array is as long as the attribute
    has changes, at most the number of snapshots."""
    lists = [F.sort_array(F.collect_list(F.when(F.col("attribute") == a, F.struct("since", "value")))).alias(f"{OWN}h_{i}") for i, a in enumerate(attributes)]
    return changes.groupBy(key).agg(*lists)


def known_at(events: DataFrame, event_day: str, histories: DataFrame, key: str, attributes: list[str], spread: list[str], counted: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK, prefix: str = "") -> DataFrame:
    """Each event with every attribute's last known value on ``event_day``, never a later one.

    A last-known match is made for each attribute by itself; the matches become columns again (``prefix`` + attribute).
    An event column of the same name is kept, the known value then comes with an underscore more. Added
    besides: ``_known_since``, the day of the latest of these matches (the version's first day; null where nothing
    was known yet), and ``_last_since``, the day of the key's last change of all. Events whose key has no history at all,
    or no key, are kept with nulls. Hot keys are split, see ``salted_join``.
    """
    joined = salted_join(events, histories, key, spread, "left", counted, rows_per_task)
    kinds = [f"{OWN}h_{i}" for i in range(len(attributes))]
    for h in kinds:
        upto = F.filter(F.col(h), lambda e: e["since"] <= F.col(event_day))
        joined = joined.withColumn(f"{h}_m", F.try_element_at(upto, F.lit(-1)))
    latest = lambda cols: reduce(lambda a, b: F.greatest(a, b), cols) if len(cols) > 1 else cols[0]
    return joined.select(
        *events.columns,
        *[F.col(f"{h}_m.value").alias(free_name(prefix + a, events.columns)) for h, a in zip(kinds, attributes)],
        latest([F.col(f"{h}_m.since") for h in kinds]).alias("_known_since"),
        latest([F.try_element_at(F.col(h), F.lit(-1))["since"] for h in kinds]).alias("_last_since"),
        F.col(kinds[0]).isNotNull().alias("_has_history"),
    )
