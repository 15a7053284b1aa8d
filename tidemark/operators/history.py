"""History of changing attributes, kept as checkpoints and patches.

A key's first version and every ``every``-th after it are stored whole (checkpoints); versions in between store only the
attributes that changed (patches). A version is read by folding the patches forward from the nearest checkpoint before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.snapshots import standing_rows
from tidemark.sources.store import Store

EVERY = 4
CHECKPOINT, PATCH = "checkpoint", "patch"
#: The property of a stored log that holds the last day it was given.
UPTO = "history_upto"


def _log(states: DataFrame, key: str, attributes: list[str], day: str, every: int, known: DataFrame | None = None) -> DataFrame:
    """Log rows of standing states. ``known``: (key, attributes, ``_number``), the last version that a log has of each key."""
    rows = states.select(key, day, *attributes, F.lit(None).cast("int").alias("_number"))
    if known is not None:
        rows = rows.unionByName(known.select(key, F.lit(None).cast("date").alias(day), *attributes, F.col("_number").cast("int").alias("_number")))
    order = Window.partitionBy(key).orderBy(F.col(day).asc_nulls_first())
    before = {a: F.lag(a).over(order).alias(f"_was_{i}") for i, a in enumerate(attributes)}
    seen = rows.select(key, day, *attributes, "_number", *before.values(), (F.row_number().over(order) == 1).alias("_first"))
    moved = [~F.col(a).eqNullSafe(F.col(f"_was_{i}")) for i, a in enumerate(attributes)]
    versions = seen.where(F.col("_first") | reduce(lambda a, b: a | b, moved))
    stored = F.coalesce(F.max("_number").over(Window.partitionBy(key)), F.lit(-1))
    behind = F.max(F.col("_number").isNotNull().cast("int")).over(Window.partitionBy(key))  # the known version is the first row
    number = versions.withColumn("_nth", F.row_number().over(order) - behind + stored)
    whole = F.col("_nth") % every == 0
    return number.where(F.col(day).isNotNull()).select(
        key,
        F.col(day).alias("valid_from"),
        F.floor(F.col("_nth") / every).cast("int").alias("segment"),
        F.when(whole, CHECKPOINT).otherwise(PATCH).alias("kind"),
        *[F.when(whole | m, F.struct(F.col(a).alias("v"))).alias(a) for a, m in zip(attributes, moved)],
    )


def history_log(snapshots: DataFrame, key: str, attributes: list[str], day: str = "_batch_date", recency: str = "_ingested_at", every: int = EVERY) -> DataFrame:
    """The checkpoint-and-patch log: (key, ``valid_from``, ``segment``, ``kind``, one nullable struct<v> per attribute).

    ``segment`` numbers a key's checkpoints. In a patch an attribute's struct is null where the attribute didn't change;
    a struct that holds null says that it changed to null. Snapshots without the key change nothing; equal attributes in
    its next snapshot go on with the version.
    """
    return _log(standing_rows(snapshots, key, attributes, day, recency), key, attributes, day, every)


def fold_log(log: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Versions from the log: (key, attributes, ``valid_from``, ``valid_to`` exclusive, null for the last).

    Each row's patches are folded forward from its segment's checkpoint. A row that leaves the attributes as they were (a
    patch logged twice) starts no version; of a key's rows of one day the checkpoint is read before patches. Rows are brought
    together by key once for all steps.
    """
    order = Window.partitionBy(key).orderBy("valid_from", "segment", F.col("kind") == PATCH)
    folded = Window.partitionBy(key, "segment").orderBy("valid_from", F.col("kind") == PATCH).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = log.repartition(F.col(key)).select(key, "valid_from", "segment", "kind", *[F.last(a, ignorenulls=True).over(folded).getField("v").alias(a) for a in attributes])
    moved = reduce(lambda a, b: a | b, (~F.col(a).eqNullSafe(F.lag(a).over(order)) for a in attributes))
    starts = states.withColumn("_starts", moved | (F.row_number().over(order) == 1)).where("_starts")
    return starts.select(key, *attributes, "valid_from", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")).alias("valid_to"))


def as_of(log: DataFrame, key: str, attributes: list[str], day=None) -> DataFrame:
    """The attributes valid on ``day`` (by default now): patches folded from each key's nearest checkpoint, one row a key
    known by then, with ``valid_from``, ``segment`` and the number of patches folded (``patches``)."""
    known = log if day is None else log.where(F.col("valid_from") <= F.lit(day))
    at = known.groupBy(key, "segment").agg(F.max("valid_from").alias("valid_from"), F.count_if(F.col("kind") == PATCH).alias("patches"), *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("valid_from"))).alias(a) for a in attributes])
    best = at.groupBy(key).agg(F.max_by(F.struct("valid_from", "patches", *attributes), F.col("segment")).alias("_s"), F.max("segment").alias("segment"))
    return best.select(key, *[F.col("_s").getField(a).getField("v").alias(a) for a in attributes], F.col("_s.valid_from").alias("valid_from"), "segment", F.col("_s.patches").alias("patches"))


class HistoryTable:
    """A log kept in a table, given snapshots as they come and read back by folding.

    ``add`` appends what the snapshots after the last day it was given change: patches, and a checkpoint at every
    ``every``-th version of a key. Nothing that was written is written again.
    """

    def __init__(self, store: Store, name: str, key: str, attributes: list[str], every: int = EVERY, buckets: int = 1):
        self.store, self.name, self.key, self.attributes, self.every, self.buckets = store, name, key, attributes, every, buckets

    def log(self) -> DataFrame:
        return self.store.read(self.name)

    def add(self, snapshots: DataFrame, day: str = "_batch_date", recency: str = "_ingested_at") -> int:
        """Takes the snapshots later than those taken before; returns the table's version. Snapshots of days already taken
        change nothing, so a delivery may be given again."""
        last = self.store.properties(self.name).get(UPTO) if self.store.exists(self.name) else None
        fresh = snapshots if last is None else snapshots.where(F.col(day) > F.lit(last).cast("date"))
        upto = fresh.agg(F.max(day)).first()[0]
        if upto is None and last is not None:
            return self.store.version(self.name)
        known = None if last is None else as_of(self.log(), self.key, self.attributes).withColumn("_number", F.col("segment") * self.every + F.col("patches"))
        rows = _log(standing_rows(fresh, self.key, self.attributes, day, recency), self.key, self.attributes, day, self.every, known)
        self.store.ensure(self.name, rows.schema, [self.key], self.buckets)
        version = self.store.append(self.name, rows, properties={} if upto is None else {UPTO: upto.isoformat()})
        return version

    def versions(self) -> DataFrame:
        """Every version with its days of validity."""
        return fold_log(self.log(), self.key, self.attributes)

    def as_of(self, day) -> DataFrame:
        """What was valid on a day."""
        return as_of(self.log(), self.key, self.attributes, day).select(self.key, *self.attributes, "valid_from")


def versions(snapshots: DataFrame, key: str, attributes: list[str], day: str = "_batch_date", recency: str = "_ingested_at", every: int = EVERY) -> DataFrame:
    """Every version with its days of validity, by way of the log (not stored)."""
    return fold_log(history_log(snapshots, key, attributes, day, recency, every), key, attributes)
