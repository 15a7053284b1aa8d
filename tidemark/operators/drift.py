"""Schemas that drift between files: find every change, and read all files into one table.

A delivery is what one feed sends in one batch. Its schema is measured from its rows (which fields hold values in more
than half of them, and of which kind), as a tree where values are JSON objects. Consecutive schemas of a feed are compared
by tree edit distance; the scripts are compiled into one mapping from each delivery's field names to steady names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import OWN, free_name
from tidemark.operators.skew import salted_join
from tidemark.operators.tree_edit import edit_script, schema_tree
from tidemark.session import scratch

NUMBER, BOOLEAN, TIMESTAMP, OBJECT, TEXT = "number", "boolean", "timestamp", "object", "text"
IS_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
IS_BOOLEAN = r"^\s*(?i:true|false)\s*$"
IS_TIMESTAMP = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"
MAP = "map<string,string>"
#: Deliveries whose maps of names may be broadcast, some kilobytes each; with more the rows are joined to them by key.
MOST_MAPS = 5_000
AT, NAMES, STEADY, EXTRA = f"{OWN}at", f"{OWN}names", f"{OWN}steady", f"{OWN}extra"
SCRIPT = "feed string, day date, op string, old_path string, new_path string, kind string, cost double"


def kind_of(value: Column) -> Column:
    """The kind of a value that came as text; null for null."""
    return (
        F.when(value.rlike(IS_NUMBER), NUMBER)
        .when(value.rlike(IS_BOOLEAN), BOOLEAN)
        .when(value.rlike(IS_TIMESTAMP), TIMESTAMP)
        .when(value.rlike(r"^\s*\{") & F.from_json(value, MAP).isNotNull(), OBJECT)
        .when(value.isNotNull(), TEXT)
    )


def column_kind(kind: T.DataType) -> str:
    """The kind of a typed column's values."""
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIMESTAMP
    return OBJECT if isinstance(kind, (T.StructType, T.MapType)) else TEXT


LEAF = r"\{[^{}]*\}"


def nesting(rows: DataFrame, rescued: str) -> int:
    """The greatest number of names on a path in the rescued texts, 1 where no value is an object; found in one scan of that
    column by taking objects without objects away until none is left. Braces within texts can only raise it."""
    peel = F.aggregate(
        F.sequence(F.lit(1), F.length(F.regexp_replace(rescued, r"[^{]", ""))),
        F.struct(F.col(rescued).alias("text"), F.lit(0).alias("n")),
        lambda acc, _: F.struct(F.regexp_replace(acc["text"], LEAF, "").alias("text"), (acc["n"] + acc["text"].contains("{").cast("int")).alias("n")),
        lambda acc: acc["n"],
    )
    return max(1, rows.where(F.col(rescued).rlike(r"\{[^{]*\{")).agg(F.max(peel)).first()[0] or 1)


def entries(rescued: Column, depth: int) -> list[Column]:
    """For each level down to ``depth`` the (path, value) of all fields at it, objects too."""
    entry = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    pairs = lambda text: F.coalesce(F.map_entries(F.from_json(text, MAP)), F.array().cast("array<struct<key:string,value:string>>"))
    levels = [F.transform(pairs(rescued), lambda e: entry(e["key"], e["value"]))]
    for _ in range(depth - 1):
        objects = F.filter(levels[-1], lambda e: e["value"].rlike(r"^\s*\{"))
        levels.append(F.flatten(F.transform(objects, lambda e: F.transform(pairs(e["value"]), lambda c: entry(F.concat(e["path"], F.lit("."), c["key"]), c["value"])))))
    return levels


def delivery_schemas(rows: DataFrame, feed: str, day: str, columns: list[str], rescued: str, depth: int | None = None) -> DataFrame:
    """The fields of each delivery: (``feed``, ``day``, ``path``, ``kind``, ``held``, ``rows``), held by more than half,
    and for each delivery a row with null ``path`` besides.

    Counts are made of all rows in one pass over the narrow columns and combined map-side, so that what is shuffled is
    deliveries x names x kinds, stray names included. Nested objects are followed to ``depth`` names, by default as deep as
    they are; a nested field belongs where more than half of the delivery's rows hold it. Null values aren't held. Rows
    without feed or day are left out. Of two kinds with equally many values the first by name stands.
    """
    kinds = {f.name: column_kind(f.dataType) for f in rows.schema.fields}
    levels = entries(F.col(rescued), nesting(rows, rescued) if depth is None else depth)
    named = rows.where(F.col(feed).isNotNull() & F.col(day).isNotNull())
    in_columns = named.groupBy(feed, day).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"_c_{i}") for i, c in enumerate(columns)])
    cell = lambda path, kind, n: F.struct(F.lit(path).cast("string").alias("path"), F.lit(kind).cast("string").alias("kind"), F.col(n).alias("n"))
    cells = F.array(cell(None, None, "rows"), *[cell(c, kinds[c], f"_c_{i}") for i, c in enumerate(columns)])  # the cell without a path says how many rows there are
    held = in_columns.select(feed, day, F.explode(cells).alias("_e")).where(F.col("_e.n") > 0).select(feed, day, "_e.path", "_e.kind", "_e.n")
    texts = named.where(F.col(rescued).isNotNull()).select(feed, day, F.explode(F.concat(*levels)).alias("_e")).where(F.col("_e.value").isNotNull())
    in_texts = texts.groupBy(feed, day, F.col("_e.path").alias("path"), kind_of(F.col("_e.value")).alias("kind")).agg(F.count("*").alias("n"))
    most = F.min_by("kind", F.struct(-F.col("n"), F.col("kind")))
    fields = held.unionByName(in_texts).groupBy(feed, day, "path").agg(most.alias("kind"), F.sum("n").alias("held"))
    size = F.max(F.when(F.col("path").isNull(), F.col("held"))).over(Window.partitionBy(feed, day))
    belongs = fields.withColumn("rows", size).where(F.col("path").isNull() | (F.col("held") * 2 > F.col("rows")))
    return belongs.select(F.col(feed).alias("feed"), F.col(day).alias("day"), "path", "kind", "held", "rows")


def _scripts(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in pairs:
        out = []
        for feed, day, before, now in zip(frame["feed"], frame["day"], frame["before"], frame["now"]):
            old, new = (schema_tree([(f["path"], f["kind"]) for f in x]) for x in (before, now))
            cost, script = edit_script(old, new)
            out += [(feed, day, e.op, e.old_path or None, e.new_path or None, e.kind, cost) for e in script]
        yield pd.DataFrame(out, columns=["feed", "day", "op", "old_path", "new_path", "kind", "cost"])


def schema_scripts(schemas: DataFrame) -> DataFrame:
    """The minimum-cost edit script of each delivery against its feed's previous one, a row a step.

    Works on schemas, not on rows: one row a delivery is compared, and deliveries whose schema stays are left out before
    Python sees them. A feed's first delivery changes nothing.
    """
    fields = F.sort_array(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "kind"))))
    one = schemas.groupBy("feed", "day").agg(fields.alias("now"))
    order = Window.partitionBy("feed").orderBy("day")
    pairs = one.withColumn("before", F.lag("now").over(order)).where(F.col("before").isNotNull() & (F.col("before") != F.col("now")))
    return pairs.select("feed", "day", "before", "now").mapInPandas(_scripts, SCRIPT)


def top_level_changes(scripts: DataFrame) -> DataFrame:
    """(feed, day, ``field_name``, ``change``) of whole fields: added, removed, retyped or renamed (under its new name).

    A field that moves out of another one or into one is added or removed at the top.
    """
    top = lambda c: F.col(c).isNotNull() & ~F.col(c).contains(".")
    moved = F.col("op") == "moved"
    change = F.when(moved & top("old_path"), "removed").when(moved & top("new_path"), "added").when(~moved & (top("new_path") | (F.col("new_path").isNull() & top("old_path"))), F.col("op"))
    name = F.when(moved & top("old_path"), F.col("old_path")).otherwise(F.coalesce("new_path", "old_path"))
    return scripts.select("feed", "day", name.alias("field_name"), change.alias("change")).where(F.col("change").isNotNull()).distinct()


def steady_paths(fields: list[tuple], scripts: dict, contract: set[str]) -> list[tuple]:
    """The scripts of one feed compiled: for each delivery the map from its paths to steady ones, without those that stay.

    ``fields``: (day, paths) in the order of days; ``scripts``: for a day its (old path, new path) renamed or moved. A path goes
    back along renames and moves to the name it had first; what lies below a renamed or moved object goes with it. A contract
    column is steady by its own name. Of two paths with one steady name the newer gets its own, with a number if need be.
    """
    out, was, before = [], {}, set()
    for day, paths in fields:
        came = {n: o for o, n in scripts.get(day, ())}
        origin: dict[str, str | None] = {"": ""}
        for q in sorted(paths, key=lambda p: p.count(".")):
            parent, _, name = q.rpartition(".")
            over = origin.get(parent)
            stays = None if over is None else f"{over}.{name}" if over else name
            origin[q] = came.get(q, stays if stays in before and stays not in came.values() else None)
        now: dict[str, str] = {}
        for q in sorted(paths, key=lambda q: (q not in contract, origin[q] is None, q)):
            want = q if q in contract or origin[q] is None else was.get(origin[q], origin[q])
            name, n = want, 1
            while name in now.values():
                n += 1
                name = q if n == 2 and q != want else f"{q}_{n}"
            now[q] = name
        out.append((day, {q: s for q, s in now.items() if q != s}))
        was, before = now, set(paths)
    return out


def _compiled(contract: list[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        scripts = {d: [(s["old_path"], s["new_path"]) for s in steps] for d, steps in zip(group["day"], group["steps"])}
        made = steady_paths([(d, list(p)) for d, p in zip(group["day"], group["paths"])], scripts, set(contract))
        return pd.DataFrame([(group["feed"].iloc[0], d, m) for d, m in made], columns=["feed", "day", "names"])

    return run


def steady_names(schemas: DataFrame, scripts: DataFrame, contract: list[str]) -> DataFrame:
    """The scripts compiled: (feed, day, ``names``), for each delivery the map from its own paths to steady ones, without
    paths that stay. A group is the deliveries of one feed, a row each whatever the number of records."""
    paths = schemas.groupBy("feed", "day").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    steps = scripts.where(F.col("op").isin("renamed", "moved")).groupBy("feed", "day").agg(F.collect_list(F.struct("old_path", "new_path")).alias("steps"))
    none = F.array().cast("array<struct<old_path:string,new_path:string>>")
    each = paths.join(steps, ["feed", "day"], "left").select("feed", "day", "paths", F.coalesce("steps", none).alias("steps"))
    return each.groupBy("feed").applyInPandas(_compiled(contract), f"feed string, day date, names {MAP}")


#: How amounts name their currency.
CURRENCIES = ["BRL", "USD", "EUR", "GBP", "JPY", "CHF", "CNY", "ARS", "MXN", "CAD", "AUD", "cr."]
_UNIT = "(?:" + "|".join(c.replace(".", r"\.") for c in CURRENCIES) + r"|\p{L}{0,3}\p{Sc})"
_AMOUNT = rf"^\s*(?:{_UNIT}\s*)?([+-]?[\d.,]+(?:[eE][+-]?\d+)?)(?:\s*{_UNIT})?\s*$"


def _number(text: Column) -> Column:
    n = F.regexp_extract(text, _AMOUNT, 1)
    return (
        F.when(n.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), n)
        .when(n.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d+$|^[+-]?\d{1,3}(,\d{3}){2,}$"), F.replace(n, F.lit(","), F.lit("")))
        .when(n.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,\d+)?$|^[+-]?\d+,\d+$"), F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .try_cast("double").try_cast("decimal(38,6)")
    )


def number_from(text: Column) -> Column:
    """A number written in any of the ways seen, the whole text being read: plain, with thousands set apart, with a decimal
    comma (one comma alone is one), with a currency before or after it, or as the only number of an object. Null for anything
    else: words aren't skipped."""
    values = F.map_values(F.from_json(text, MAP))
    inside = F.filter(F.transform(values, _number), lambda v: v.isNotNull())
    return F.when(text.rlike(r"^\s*\{"), F.when(F.size(inside) == 1, F.get(inside, 0))).otherwise(_number(text))


def timestamp_from(text: Column) -> Column:
    """A timestamp written as ISO text, as seconds since 1970, or as day/month/year with hours and minutes; the whole text is
    read, and null is given for anything else."""
    day = r"^\s*(\d{2})/(\d{2})/(\d{4}) (\d{2})\D(\d{2})\s*$"
    part = lambda i: F.regexp_extract(text, day, i)
    parts = F.concat(part(3), F.lit("-"), part(2), F.lit("-"), part(1), F.lit(" "), part(4), F.lit(":"), part(5))
    epoch = F.when(text.rlike(r"^\d{9,11}$"), F.timestamp_seconds(text.try_cast("bigint")).cast("timestamp_ntz"))
    return F.coalesce(epoch, F.when(text.rlike(IS_TIMESTAMP), text.try_cast("timestamp_ntz")), F.when(text.rlike(day), parts.try_cast("timestamp_ntz")))


def text_from(text: Column) -> Column:
    """Plain text, or the only text within an object; null for an object with none or several."""
    said = F.regexp_extract_all(text, F.lit(r':\s*"((?:[^"\\]|\\.)*)"'), 1)
    return F.when(text.rlike(r"^\s*\{") & F.from_json(text, MAP).isNotNull(), F.when(F.size(said) == 1, F.get(said, 0))).otherwise(text)


def convert(text: Column, kind: T.DataType) -> Column:
    """Text as a contract column's type, null where it can't be read."""
    if isinstance(kind, T.NumericType):
        return number_from(text).try_cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_from(text).try_cast(kind)
    return text_from(text).try_cast(kind)


def unify(rows: DataFrame, feed: str, day: str, columns: list[str], rescued: str, names: DataFrame, spread: list[str], depth: int | None = None) -> DataFrame:
    """All deliveries in one table with steady columns and types.

    Every contract column is filled from its own values or, where a delivery sends it under another name, at another place or
    in another form, from the rescued field that the compiled scripts map to it, converted to the contract's type. Every other
    rescued value that is no object comes out in the map ``extra_fields`` under its steady path (the column has an underscore
    more if the input has one of that name): renamed, moved and nested fields alike, and a contract's value that can't be read,
    so that nothing sent is lost. An object that fills a column is done with. Each row stays one row; rows without feed or day
    keep their fields under their own paths. ``depth`` as in ``delivery_schemas``. The maps of up to ``MOST_MAPS`` deliveries are
    broadcast and no row is shuffled; beyond that rows are joined to them, hot deliveries split.
    """
    at = F.struct(F.col(feed), F.col(day))
    keyed = rows.withColumn(AT, at)
    maps = names.select(F.struct(F.col("feed").alias(feed), F.col("day").alias(day)).alias(AT), F.col("names").alias(NAMES))
    at_hand = scratch(rows.sparkSession, "names")
    maps.write.parquet(at_hand)  # a row a delivery; read back to know how many
    maps = rows.sparkSession.read.parquet(at_hand)
    if maps.limit(MOST_MAPS + 1).count() <= MOST_MAPS:
        joined = keyed.join(F.broadcast(maps), AT, "left")
    else:
        joined = salted_join(keyed, maps, AT, spread, "left", counted=keyed.select(AT))
    every = F.concat(*entries(F.col(rescued), nesting(rows, rescued) if depth is None else depth))
    named = F.transform(every, lambda e: F.struct(F.coalesce(F.try_element_at(F.col(NAMES), e["path"]), e["path"]).alias("key"), e["path"].alias("path"), e["value"].alias("value")))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    wide = joined.withColumn(STEADY, F.coalesce(named, F.array().cast("array<struct<key:string,path:string,value:string>>")))
    sent = lambda c: F.get(F.filter(F.col(STEADY), lambda e: (e["key"] == c) & e["value"].isNotNull()), 0)
    for i, c in enumerate(columns):
        wide = wide.withColumn(f"{OWN}s_{i}", sent(c)).withColumn(f"{OWN}f_{i}", F.coalesce(F.col(c), convert(F.col(f"{OWN}s_{i}.value"), kinds[c])))
    done = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"{OWN}f_{i}").isNotNull(), F.col(f"{OWN}s_{i}.path")) for i, c in enumerate(columns)]))
    below = lambda e: F.exists(done, lambda d: (e["path"] == d) | e["path"].startswith(F.concat(d, F.lit("."))))
    is_object = lambda e: e["value"].rlike(r"^\s*\{") & F.from_json(e["value"], MAP).isNotNull()
    left = F.filter(F.col(STEADY), lambda e: e["value"].isNotNull() & ~is_object(e) & ~below(e))
    extra = F.aggregate(left, F.create_map().cast(MAP), lambda acc, e: F.when(F.map_contains_key(acc, e["key"]), acc).otherwise(F.map_concat(acc, F.map_from_entries(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))))))
    place = {c: i for i, c in enumerate(columns)}
    wide = wide.withColumn(EXTRA, extra)  # by itself: beside the filled columns their names would be taken for the sent ones
    return wide.select(*[F.col(f"{OWN}f_{place[c]}").alias(c) if c in place else F.col(c) for c in rows.columns if c != rescued], F.col(EXTRA).alias(free_name("extra_fields", rows.columns)))
