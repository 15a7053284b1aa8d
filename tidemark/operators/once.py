"""Messages delivered more than once: keep exactly one row for each identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import OWN, all_set, col, comparable, nulls_last

#: What "delivered first" means for a landing feed.
DELIVERY = ("_batch_date", "_ingested_at", "_source_file")


def deliver_once(df: DataFrame, keys: list[str], order: tuple[str, ...] = DELIVERY, copies: str | None = None, first: bool = True) -> DataFrame:
    """One row per identifier: of its copies the one delivered first (or last, with ``first=False``).

    One aggregation with ``min_by`` over the struct (delivery order, digest of the row). Copies collapse in the map-side
    partial aggregation, so an identifier that holds a third of all rows reaches the reducer as one row per map task.
    Ties in the delivery order are settled by a digest of the other columns, then two equal rows are the same row.

    A row with a null in any key has no identifier and is left out. A null in the delivery order sorts after every value
    (before, with ``first=False``: it loses either way). An empty table gives an empty table. Other columns are carried
    along whatever their names; ``copies`` adds the number of copies seen.
    """
    rest = [c for c in df.columns if c not in keys]
    ranks = comparable(df, [c for c in order if c in df.columns])
    tie = comparable(df, [c for c in rest if c not in order])
    if first:
        rank = F.struct(*nulls_last(ranks), *([F.xxhash64(*tie)] if tie else []))
        pick = F.min_by(F.struct(*[col(c) for c in rest]), rank)
    else:
        rank = F.struct(*ranks, *([F.xxhash64(*tie)] if tie else []))
        pick = F.max_by(F.struct(*[col(c) for c in rest]), rank)
    kept, seen = f"{OWN}kept", f"{OWN}copies"
    groups = df.where(all_set(keys)).groupBy(*[col(k) for k in keys]).agg(*([pick.alias(kept)] if rest else []), F.count("*").alias(seen))
    return groups.select(*[col(c) if c in keys else F.col(kept).getField(c).alias(c) for c in df.columns], *([F.col(seen).alias(copies)] if copies else []))
