"""Do two tables hold the same rows?"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import comparable


class Unequal(AssertionError):
    """Reconciliation found rows on one side only."""


@dataclass(frozen=True)
class Check:
    """A pair of tables, the columns to compare, an optional filter of both, and whether copies count."""

    name: str
    left: DataFrame
    right: DataFrame
    columns: tuple[str, ...] = ()
    where: str | None = None
    as_set: bool = False

    def sides(self) -> tuple[DataFrame, DataFrame]:
        columns = self.columns or tuple(self.left.columns)
        return tuple((d.where(self.where) if self.where else d).select(*columns) for d in (self.left, self.right))


def difference(left: DataFrame, right: DataFrame, as_set: bool = False) -> DataFrame:
    """One row: (``only_left``, ``only_right``), rows beyond what the other side has; as sets, copies don't count.

    One shuffle: rows of both sides are counted by whole row with a sign, instead of two anti-joins.
    """
    right = right.select(*left.columns)
    signed = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    keys = [k.alias(f"_k{i}") for i, k in enumerate(comparable(left, left.columns))]
    each = signed.groupBy(*keys).agg(F.count_if(F.col("_side") == 1).alias("_l"), F.count_if(F.col("_side") == -1).alias("_r"))
    a, b = (F.least("_l", F.lit(1)), F.least("_r", F.lit(1))) if as_set else (F.col("_l"), F.col("_r"))
    return each.agg(F.coalesce(F.sum(F.greatest(a - b, F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(b - a, F.lit(0))), F.lit(0)).alias("only_right"))


def evaluate(checks: list[Check]) -> DataFrame:
    """One row a check: what each side has alone, and whether it passed."""
    rows = [difference(*c.sides(), c.as_set).select(F.lit(c.name).alias("check"), "only_left", "only_right") for c in checks]
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("passed", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def enforce(results: DataFrame) -> None:
    """Raises where a check failed; one row a check is collected."""
    failed = results.where(~F.col("passed")).collect()
    if failed:
        raise Unequal("; ".join(f"{r['check']}: {r['only_left']} and {r['only_right']}" for r in failed))
