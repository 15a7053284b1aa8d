"""Versioned Parquet tables: atomic commits, MERGE, time travel, change feed, properties.

A table is a folder of immutable data files and a log with one JSON record per commit, created by put-if-absent, so that of
two writers of a version one fails and may retry. Every attempt writes to a folder of its own, which only its record names:
a writer that loses or dies leaves what is committed as it was. Keyed tables are hashed into buckets; a merge reads and rewrites only the
buckets that its source touches. One pass writes new rows, kept rows and the change feed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.sources.files import create_json, names_in, read_json, remove

BUCKET, ACTION, PRE = "_bucket", "_action", "_pre"
INSERT, UPDATE, DELETE, KEEP = "insert", "update", "delete", "keep"
Side = Callable[[str], Column]


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version first; nothing was changed."""


class ChangesUnavailable(RuntimeError):
    """The change feed of these versions can't be read: vacuumed, or a whole overwrite."""


class DuplicateKeys(ValueError):
    """A merge source holds a key more than once."""


def _optional(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


class Store:
    """All tables below ``root``, a folder that every executor sees."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the log

    def _log(self, name: str) -> list[str]:
        return [n for n in names_in(self.spark, f"{self.root}/{name}/_log") if n.endswith(".json") and n[0] != "."]

    def _record(self, name: str, version: int | None = None) -> dict:
        if version is None:
            found = self._log(name)
            if not found:
                raise KeyError(f"no table {name}")
            return read_json(self.spark, f"{self.root}/{name}/_log/{found[-1]}")
        return read_json(self.spark, f"{self.root}/{name}/_log/{version:020d}.json")

    def exists(self, name: str) -> bool:
        return bool(self._log(name))

    def version(self, name: str) -> int:
        """The newest version, -1 where there is no table."""
        found = self._log(name)
        return int(found[-1].split(".")[0]) if found else -1

    def history(self, name: str) -> DataFrame:
        """One row a commit: version, operation and its row counts."""
        rows = [self._record(name, int(n.split(".")[0])) for n in self._log(name)]
        return self.spark.createDataFrame([(r["version"], r["operation"], r.get("metrics", {})) for r in rows], "version int, operation string, metrics map<string,bigint>")

    def properties(self, name: str) -> dict[str, str]:
        return self._record(name).get("properties", {})

    def set_properties(self, name: str, **values: str) -> int:
        now = self._record(name)
        return self._commit(name, now, "set properties", now["parts"], properties=now.get("properties", {}) | values)

    def _commit(self, name: str, now: dict | None, operation: str, parts: dict[str, list[str]], **more) -> int:
        version = now["version"] + 1 if now else 0
        record = {"schema": now and now["schema"], "keys": now["keys"] if now else [], "buckets": now["buckets"] if now else 1, "properties": (now or {}).get("properties", {}), "txns": (now or {}).get("txns", {})}
        record |= {"version": version, "operation": operation, "parts": parts, "changes": [], "metrics": {}} | more
        if not create_json(self.spark, f"{self.root}/{name}/_log/{version:020d}.json", record):
            raise ConcurrentCommit(f"{name} version {version}")
        return version

    # -- reading

    def schema(self, name: str, version: int | None = None) -> StructType:
        return StructType.fromJson(json.loads(self._record(name, version)["schema"]))

    def _files(self, folders: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest by default. A column added later is null in older files."""
        r = self._record(name, version)
        return self._files(sorted(p for ps in r["parts"].values() for p in ps), StructType.fromJson(json.loads(r["schema"])))

    def changes(self, name: str, after: int, upto: int) -> DataFrame:
        """Row changes of the versions in (after, upto], with ``_change_type`` (insert, update_preimage,
        update_postimage, delete) and ``_commit_version``."""
        schema = self.schema(name, upto)
        out = self.spark.createDataFrame([], StructType([*schema.fields, StructField("_change_type", StringType()), StructField("_commit_version", IntegerType())]))
        with_pre = StructType([*schema.fields, StructField(PRE, schema)])
        for v in range(after + 1, upto + 1):
            r = self._record(name, v)
            if r["operation"] == "overwrite" or r.get("vacuumed"):
                raise ChangesUnavailable(f"{name} version {v}: {r['operation']}")
            by = {a: [p for k, p in r["changes"] if k == a] for a in (INSERT, UPDATE, DELETE)}
            rows = []
            if by[INSERT]:
                rows.append(self._files(by[INSERT], schema).withColumn("_change_type", F.lit("insert")))
            if by[UPDATE]:
                both = self._files(by[UPDATE], with_pre)
                rows += [both.select(f"{PRE}.*").withColumn("_change_type", F.lit("update_preimage")), both.drop(PRE).withColumn("_change_type", F.lit("update_postimage"))]
            if by[DELETE]:
                rows.append(self._files(by[DELETE], with_pre).select(f"{PRE}.*").withColumn("_change_type", F.lit("delete")))
            for x in rows:
                out = out.unionByName(x.withColumn("_commit_version", F.lit(v)))
        return out

    # -- writing

    def ensure(self, name: str, schema: StructType, keys: list[str] = (), buckets: int = 1) -> None:
        """Makes an empty table if there is none. ``keys`` and ``buckets`` are fixed from then on."""
        if not self.exists(name):
            self._commit(name, None, "create", {}, schema=_optional(schema).json(), keys=list(keys), buckets=buckets)

    def _bucket(self, now: dict) -> Column:
        return F.pmod(F.xxhash64(*now["keys"]), F.lit(now["buckets"])).cast("int") if now["keys"] and now["buckets"] > 1 else F.lit(0)

    def _write(self, name: str, version: int, rows: DataFrame, now: dict) -> tuple[dict[str, dict[str, str]], dict[str, int]]:
        """Writes rows with bucket and action; returns folders by bucket and action, and the rows counted per action."""
        at = f"{self.root}/{name}/data/v{version}-{uuid.uuid4().hex}"
        seen = Observation()
        counted = rows.observe(seen, *[F.count_if(F.col(ACTION) == a).alias(a) for a in (INSERT, UPDATE, DELETE, KEEP)])
        if now["buckets"] > 1:
            counted = counted.repartitionById(now["buckets"], F.col(BUCKET))  # a task a bucket
        counted.write.partitionBy(BUCKET, ACTION).parquet(at)
        folders = {b.split("=")[1]: {a.split("=")[1]: f"{at}/{b}/{a}" for a in names_in(self.spark, f"{at}/{b}")} for b in names_in(self.spark, at) if b.startswith(f"{BUCKET}=")}
        return folders, {k: int(v) for k, v in seen.get.items()}

    def append(self, name: str, df: DataFrame, txn: tuple[str, int] | None = None, properties: dict[str, str] | None = None) -> int:
        """Adds rows, and sets ``properties`` in the same commit. ``txn`` = (writer, number): a batch with a number no greater
        than the writer's last is skipped, which makes a replayed micro-batch harmless."""
        self.ensure(name, df.schema)
        now = self._record(name)
        if txn and now["txns"].get(txn[0], -1) >= txn[1]:
            return now["version"]
        schema = StructType.fromJson(json.loads(now["schema"]))
        rows = df.select([f.name for f in schema.fields]).withColumn(BUCKET, self._bucket(now)).withColumn(ACTION, F.lit(INSERT))
        folders, n = self._write(name, now["version"] + 1, rows, now)
        parts = {b: now["parts"].get(b, []) + [x[INSERT]] for b, x in folders.items() if INSERT in x}
        return self._commit(name, now, "append", now["parts"] | parts, changes=[[INSERT, x[INSERT]] for x in folders.values() if INSERT in x], metrics=n, txns=now["txns"] | ({txn[0]: txn[1]} if txn else {}), properties=now.get("properties", {}) | (properties or {}))

    def overwrite(self, name: str, df: DataFrame, keys: list[str] = (), buckets: int = 1) -> int:
        """Replaces all rows and the schema in one commit; earlier versions stay readable."""
        now = self._record(name) if self.exists(name) else None
        head = {"schema": _optional(df.schema).json(), "keys": list(keys) or (now or {}).get("keys", []), "buckets": now["buckets"] if now else buckets}
        folders, n = self._write(name, now["version"] + 1 if now else 0, df.withColumn(BUCKET, self._bucket(head)).withColumn(ACTION, F.lit(INSERT)), head)
        return self._commit(name, now, "overwrite", {b: [x[INSERT]] for b, x in folders.items()}, metrics=n, **head)

    def update(self, name: str, where: Column, **values: Column) -> int:
        """UPDATE ... SET ... WHERE: rows for which ``where`` is true get the new values."""
        now = self._record(name)
        table = self.read(name)
        hit = F.coalesce(where, F.lit(False))
        new = [F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns]
        rows = table.select(*new, F.when(hit, F.struct(*table.columns)).alias(PRE), self._bucket(now).alias(BUCKET), F.when(hit, UPDATE).otherwise(KEEP).alias(ACTION))
        folders, n = self._write(name, now["version"] + 1, rows, now)
        return self._commit(name, now, "update", {b: list(x.values()) for b, x in folders.items()}, changes=[[UPDATE, x[UPDATE]] for x in folders.values() if UPDATE in x], metrics=n)

    def delete(self, name: str, gone: DataFrame) -> int:
        """DELETE: rows that equal a row of ``gone`` in all its columns. Null equals nothing."""
        now = self._record(name)
        table = self.read(name)
        hit = F.coalesce("_hit", F.lit(False))
        marked = table.join(gone.distinct().withColumn("_hit", F.lit(True)), gone.columns, "left")
        rows = marked.select(*table.columns, F.when(hit, F.struct(*table.columns)).alias(PRE), self._bucket(now).alias(BUCKET), F.when(hit, DELETE).otherwise(KEEP).alias(ACTION))
        folders, n = self._write(name, now["version"] + 1, rows, now)
        return self._commit(name, now, "delete", {b: [x[KEEP]] for b, x in folders.items() if KEEP in x}, changes=[[DELETE, x[DELETE]] for x in folders.values() if DELETE in x], metrics=n)

    def merge(
        self,
        name: str,
        source: DataFrame,
        keys: list[str],
        update_when: Callable[[Side, Side], Column] | None = None,
        update: bool = True,
        insert: bool = True,
        delete_missing: bool = False,
        evolve: bool = False,
        set_values: dict[str, Callable[[Side, Side], Column]] | None = None,
        txn: tuple[str, int] | None = None,
        unique: bool = False,
    ) -> int:
        """MERGE INTO name USING source ON keys.

        Matched rows are replaced by the source's where ``update_when(target, source)`` is true (always if not given; each
        argument gives a column by name), or get ``set_values`` only; unmatched source rows are inserted; with
        ``delete_missing`` unmatched target rows are deleted. Null keys match nothing. A key that comes twice in the source
        is refused (``unique`` says that it can't, and spares the look). ``evolve`` adds new source columns to the table, and then every matched row is updated so that the new
        column is filled. Columns the source lacks keep their value (null in inserts).
        """
        now = self._record(name)
        if txn and now["txns"].get(txn[0], -1) >= txn[1]:
            return now["version"]
        known = list(keys)
        keyed = now["buckets"] > 1 and now["keys"] == known and not delete_missing
        source = source.persist()  # read once to be looked at, once to be merged
        try:
            return self._merge(name, now, source, known, keyed, update_when, update, insert, delete_missing, evolve, set_values, txn, unique)
        finally:
            source.unpersist()

    def _looked_at(self, now: dict, source: DataFrame, keys: list[str]) -> tuple[bool, set[str]]:
        """Whether a key comes twice, and the buckets touched (at most the number of buckets), by one aggregation."""
        some = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
        each = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(F.when(some, F.col("_n")).alias("_n"), self._bucket(now).alias(BUCKET) if now["keys"] == keys else F.lit(0).alias(BUCKET))
        found = each.agg(F.max("_n"), F.collect_set(BUCKET)).first()
        return (found[0] or 0) > 1, {str(b) for b in found[1]}

    def _merge(self, name, now, source, known, keyed, update_when, update, insert, delete_missing, evolve, set_values, txn, unique) -> int:
        touched: set[str] = set()
        if keyed or not unique:
            twice, touched = self._looked_at(now, source, known)
            if twice and not unique:
                raise DuplicateKeys(f"{name}: the source holds a key of {known} twice")
        old = StructType.fromJson(json.loads(now["schema"]))
        added = [f for f in source.schema.fields if f.name not in old.names] if evolve else []
        schema = _optional(StructType([*old.fields, *added]))
        parts = now["parts"]
        if not keyed:
            touched = set(parts) | {"0"}
        target = self._files(sorted(p for b in touched for p in parts.get(b, [])), schema)
        if not update and not delete_missing:
            fresh = source.join(target.select(*known), known, "left_anti") if insert else source.limit(0)
            rows = fresh.select(*[F.col(f.name) if f.name in source.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
            folders, n = self._write(name, now["version"] + 1, rows.withColumn(BUCKET, self._bucket(now)).withColumn(ACTION, F.lit(INSERT)), now)
            new = {b: parts.get(b, []) + [x[INSERT]] for b, x in folders.items() if INSERT in x}
        else:
            t = target.select(*known, F.struct(*schema.names).alias("_t"))
            s = source.select(*known, F.struct(*source.columns).alias("_s"))
            side = lambda x: lambda c: F.col(f"{x}.{c}")
            both = F.col("_t").isNotNull() & F.col("_s").isNotNull()
            condition = F.lit(update) if update_when is None or added else F.coalesce(update_when(side("_t"), side("_s")), F.lit(False))
            joined = t.join(s, known, "full")
            action = F.when(both, F.when(condition, UPDATE).otherwise(KEEP)).when(F.col("_t").isNull(), INSERT if insert else "skip").otherwise(DELETE if delete_missing else KEEP)
            marked = joined.withColumn(ACTION, action).where(F.col(ACTION) != "skip")

            def value(f: StructField) -> Column:
                kept, fresh = F.col(f"_t.{f.name}"), F.col(f"_s.{f.name}") if f.name in source.columns else F.lit(None)
                changed = set_values[f.name](side("_t"), side("_s")) if set_values and f.name in set_values else kept if set_values or f.name not in source.columns else fresh
                return F.when(F.col(ACTION) == UPDATE, changed).when(F.col(ACTION) == INSERT, fresh).otherwise(kept).cast(f.dataType).alias(f.name)

            rows = marked.select(*[value(f) for f in schema.fields], F.when(F.col(ACTION).isin(UPDATE, DELETE), F.col("_t")).alias(PRE), ACTION)
            folders, n = self._write(name, now["version"] + 1, rows.withColumn(BUCKET, self._bucket(now)), now)
            new = {b: [p for a, p in folders.get(b, {}).items() if a != DELETE] for b in touched | set(folders)}
        changes = [[a, p] for x in folders.values() for a, p in x.items() if a != KEEP]
        return self._commit(name, now, "merge", {b: p for b, p in (parts | new).items() if p}, schema=schema.json(), changes=changes, metrics=n, txns=now["txns"] | ({txn[0]: txn[1]} if txn else {}))

    def compact(self, name: str, most: int = 8) -> int:
        """Writes each bucket that consists of more than ``most`` folders as one, in a commit that changes no row. Appends add
        a folder a time, so this keeps records, listings and files few. Returns the newest version."""
        now = self._record(name)
        many = {b: ps for b, ps in now["parts"].items() if len(ps) > most}
        if not many:
            return now["version"]
        rows = self._files(sorted(p for ps in many.values() for p in ps), StructType.fromJson(json.loads(now["schema"])))
        folders, n = self._write(name, now["version"] + 1, rows.withColumn(BUCKET, self._bucket(now)).withColumn(ACTION, F.lit(KEEP)), now)
        return self._commit(name, now, "compact", {b: p for b, p in (now["parts"] | {b: [folders[b][KEEP]] if b in folders else [] for b in many}).items() if p}, metrics=n)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Deletes data folders that none of the newest ``keep`` versions reads. Their change feed is gone with them. Folders of
        writers that didn't commit go too once a later version stands, since they can't commit any more; those of writers at
        work on the next version stay."""
        at = f"{self.root}/{name}/data"
        newest = self.version(name)
        live = {p.removeprefix(f"{at}/").split("/")[0] for v in range(max(0, newest - keep + 1), newest + 1) for ps in self._record(name, v)["parts"].values() for p in ps}
        gone = 0
        for v in names_in(self.spark, at):
            if v not in live and int(v[1:].split("-")[0]) <= newest:
                remove(self.spark, f"{at}/{v}")
                gone += 1
        return gone

    def readable_changes(self, name: str, after: int, upto: int) -> bool:
        """Whether ``changes`` can serve these versions, from the log alone and without a job."""
        for v in range(after + 1, upto + 1):
            r = self._record(name, v)
            if r["operation"] == "overwrite" or any(not names_in(self.spark, p) for _, p in r["changes"]):
                return False
        return True


# -- the merge flavours by name


def merge_insert_new(store: Store, name: str, rows: DataFrame, keys: list[str], **more) -> int:
    """Rows of keys not yet in the table are inserted; the rest is left as it is. Only new files are written."""
    return store.merge(name, rows, keys, update=False, **more)


def merge_upsert(store: Store, name: str, rows: DataFrame, keys: list[str], newer: str | None = None, **more) -> int:
    """Matched rows are replaced, others inserted. With ``newer`` a row is replaced only by one whose value there is at
    least its own, so that an older delivery that comes in a later run changes nothing."""
    when = (lambda t, s: t(newer).isNull() | (s(newer) >= t(newer))) if newer else None
    return store.merge(name, rows, keys, when, **more)


def merge_forward_only(store: Store, name: str, rows: DataFrame, keys: list[str], sequence: str, **more) -> int:
    """Matched rows are replaced only by a greater sequence number."""
    return store.merge(name, rows, keys, lambda t, s: s(sequence) > t(sequence), **more)


def merge_hash_guarded(store: Store, name: str, rows: DataFrame, keys: list[str], row_hash: str = "row_hash", delete_missing: bool = False) -> int:
    """Matched rows are rewritten only if their hash differs (null differs from a hash); new columns fill all rows."""
    return store.merge(name, rows, keys, lambda t, s: ~t(row_hash).eqNullSafe(s(row_hash)), evolve=True, delete_missing=delete_missing)
