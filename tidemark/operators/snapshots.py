"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import digest


def standing_rows(snapshots: DataFrame, key: str, attributes: list[str], day: str = "_batch_date", recency: str = "_ingested_at", hashed: bool = False) -> DataFrame:
    """One row for each key and snapshot: of a key's rows in a snapshot the one with the latest ``recency``.

    Null keys and null days are ignored. A null recency loses to any value; equal recency is settled by the greatest
    attributes in their order. Columns: key, day, attributes. With ``hashed`` a ``_digest`` of 16 bytes stands for the
    attributes, so that no more is shuffled; equal recency is then settled by it.
    """
    rows = snapshots.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    says = [F.substring(F.unhex(digest(snapshots, attributes)), 1, 16).alias("_digest")] if hashed else [F.col(a) for a in attributes]
    best = F.max(F.struct(F.col(recency).alias("_recency"), *says))
    return rows.groupBy(key, day).agg(best.alias("_s")).select(key, day, *([F.col("_s._digest")] if hashed else [F.col("_s").getField(a).alias(a) for a in attributes]))


def snapshot_index(snapshots: DataFrame, day: str = "_batch_date") -> DataFrame:
    """The snapshots' days, numbered from 0, with the day of the next one. One row a snapshot."""
    days = snapshots.where(F.col(day).isNotNull()).select(day).distinct()
    order = Window.orderBy(day)  # one row a snapshot: the only unpartitioned window, over days and not over records
    return days.select(day, (F.row_number().over(order) - 1).alias("_index"), F.lead(day).over(order).alias("_next_day"))


def snapshot_changes(snapshots: DataFrame, key: str, attributes: list[str], day: str = "_batch_date", recency: str = "_ingested_at") -> DataFrame:
    """Keys added, removed or changed between consecutive snapshots: (``record_key``, ``day``, ``change``).

    Each key's rows are put in the order of the snapshots' index. A lagged digest that differs is a change; a gap in the
    index is a removal after its near end and an addition at its far end. The first snapshot adds nothing; an empty
    table gives no changes. Attributes compare exactly, null equal to null.
    """
    index = snapshot_index(snapshots, day)
    states = standing_rows(snapshots, key, attributes, day, recency, hashed=True)
    placed = states.join(index, day)
    order = Window.partitionBy(key).orderBy("_index")
    was, last = F.lag("_index").over(order), F.lag("_digest").over(order)
    seen = placed.select(key, day, "_index", "_next_day", was.alias("_was"), (last != F.col("_digest")).alias("_differs"), F.lead("_index").over(order).alias("_then"))
    here = F.when(F.col("_was") == F.col("_index") - 1, F.when(F.col("_differs"), "changed")).when(F.col("_index") > 0, "added")
    gone = F.when(F.col("_next_day").isNotNull() & (F.coalesce(F.col("_then"), F.lit(-1)) != F.col("_index") + 1), "removed")
    events = F.array(F.struct(F.col(day).alias("day"), here.alias("change")), F.struct(F.col("_next_day").alias("day"), gone.alias("change")))
    return seen.select(F.col(key).alias("record_key"), F.explode(events).alias("_e")).select("record_key", "_e.day", "_e.change").where(F.col("change").isNotNull())
