"""Keys, orderings and digests of whole rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Columns that operators add for their own use begin with this; inputs must not use it.
OWN = "__tm_"


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name}`")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores added until no column has the name (names compare without case)."""
    have = {t.lower() for t in taken}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def day_int(day: Column | str) -> Column:
    """A date as yyyymmdd, null for null."""
    d = F.col(day) if isinstance(day, str) else day
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def all_set(columns: list[str]) -> Column:
    """True where none of the columns is null."""
    return reduce(lambda a, b: a & b, (col(c).isNotNull() for c in columns), F.lit(True))


def comparable(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns in a form that can be hashed and ordered: maps and variants become JSON text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def one(c: str) -> Column:
        if isinstance(kinds[c], T.MapType):
            return F.to_json(F.array_sort(F.map_entries(col(c))))
        if "map<" in kinds[c].simpleString() or "variant" in kinds[c].simpleString():
            return F.to_json(col(c))
        return col(c)

    return [one(c) for c in columns]


def nulls_last(columns: list[Column]) -> list[Column]:
    """Fields of a struct that orders the columns ascending, a null after every value."""
    return [x for c in columns for x in (c.isNull(), c)]


def digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the named values. Field names are kept and nulls left out, so a null differs from every text and no
    two different rows of values share the hashed text."""
    parts = comparable(df, columns)
    return F.sha2(F.to_json(F.struct(*[p.alias(c) for p, c in zip(parts, columns)])), 256)
