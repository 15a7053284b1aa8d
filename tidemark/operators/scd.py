"""Slowly changing dimensions kept in a table: snapshots applied one after the other."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import digest
from tidemark.operators.snapshots import standing_rows
from tidemark.sources.store import Store

#: The first version of a key is valid from here, since it was there before it was first reported.
BEGINNING = dt.date(1900, 1, 1)
LAST = "last_snapshot"


def surrogate(key: str, valid_from: str = "valid_from"):
    """A version's surrogate key."""
    return F.xxhash64(F.col(key), F.col(valid_from))


def staged_changes(current: DataFrame, snapshot: DataFrame, key: str, attributes: list[str], day: dt.date) -> DataFrame:
    """Rows to merge: for a changed key the old version closed and a new one, for a new key its first version.

    Absent keys are left alone. A key whose current version was itself made on ``day`` (the day's snapshot comes in parts, and
    this part says otherwise) has that version put right instead. Columns: key, attributes, ``attr_hash``, ``seen_on`` (the day
    of the snapshot that made the version), ``valid_from``, ``valid_to``, ``is_current``, ``version_key``.
    """
    hashed = snapshot.where(F.col(key).isNotNull()).select(key, *attributes, digest(snapshot, attributes).alias("attr_hash"))
    kept = [*attributes, "attr_hash", "seen_on", "valid_from"]
    now = current.where("is_current").select(key, F.struct(*kept).alias("_now"))
    pairs = hashed.join(now, key, "left").where(F.col("_now").isNull() | (F.col("_now.attr_hash") != F.col("attr_hash")))
    today = F.coalesce(F.col("_now.seen_on") == F.lit(day), F.lit(False))
    since = F.when(F.col("_now").isNull(), F.lit(BEGINNING)).when(today, F.col("_now.valid_from")).otherwise(F.lit(day))
    fresh = F.struct(*attributes, "attr_hash", F.lit(day).alias("seen_on"), since.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    closed = F.when(F.col("_now").isNotNull() & ~today, F.struct(*[F.col(f"_now.{a}").alias(a) for a in kept], F.lit(day).alias("valid_to"), F.lit(False).alias("is_current")))
    rows = pairs.select(key, F.explode(F.array_compact(F.array(fresh, closed))).alias("_v")).select(key, "_v.*")
    return rows.withColumn("version_key", surrogate(key))


def apply_snapshot(store: Store, name: str, snapshot: DataFrame, key: str, attributes: list[str], day: dt.date) -> bool:
    """Applies one snapshot; False, and nothing done, where one of a later day was applied before. A snapshot of the day
    applied last goes on with that day: its other rows may have come in an earlier part; False where it changes nothing."""
    last = store.properties(name).get(LAST) if store.exists(name) else None
    again = last is not None and day == dt.date.fromisoformat(last)
    if last and day < dt.date.fromisoformat(last):
        return False
    if not store.exists(name):
        empty = snapshot.select(key, *attributes, F.lit("").alias("attr_hash"), F.lit(BEGINNING).alias("seen_on"), F.lit(BEGINNING).alias("valid_from"), F.lit(BEGINNING).alias("valid_to"), F.lit(True).alias("is_current"), F.lit(0).cast("bigint").alias("version_key"))
        store.ensure(name, empty.schema, [key, "valid_from"])
    staged = staged_changes(store.read(name), snapshot, key, attributes, day)
    if again and staged.isEmpty():
        return False
    store.merge(name, staged, [key, "valid_from"], unique=True)
    if not again:
        store.set_properties(name, **{LAST: day.isoformat()})
    return True


def apply_snapshots(store: Store, name: str, snapshots: DataFrame, key: str, attributes: list[str], day: str = "_batch_date", recency: str = "_ingested_at") -> int:
    """Applies all snapshots in the order of their days (a short list, one entry a snapshot); returns how many were new."""
    days = sorted(r[0] for r in snapshots.where(F.col(day).isNotNull()).select(day).distinct().collect())
    states = standing_rows(snapshots, key, attributes, day, recency)
    return sum(apply_snapshot(store, name, states.where(F.col(day) == F.lit(d)), key, attributes, d) for d in days)


def as_dimension(versions: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Versions (from ``history.versions``) as a dimension: the first one reaches back to the beginning, with surrogate
    key and current flag."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("valid_from")) == 1
    rows = versions.withColumn("valid_from", F.when(first, F.lit(BEGINNING)).otherwise(F.col("valid_from")))
    return rows.select(surrogate(key).alias("version_key"), key, *attributes, "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))
