"""A stream of inserts, updates and deletes applied to a table: bucketed copy-on-write.

The table is hashed into buckets by key, a folder of files each. Applying changes routes them to their buckets, joins only
the buckets that got any with their changes, writes those buckets anew and commits a manifest that names one folder per
bucket; untouched buckets are carried over by name. Readers see one manifest, so never half a batch. Deleted keys stay in
their bucket as tombstones: a change that comes late can't bring them back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.columns import OWN, all_set, comparable
from tidemark.session import parallelism
from tidemark.sources.files import create_json, names_in, read_json, remove

BUCKET, GONE, NEW = f"{OWN}bucket", f"{OWN}gone", f"{OWN}new"


def is_delete(op: str = "_op") -> Column:
    """True for a delete however a feed writes it (delete, DELETE, D); null and other texts are no deletes."""
    return F.coalesce(F.lower(F.trim(F.col(op))).isin("d", "del", "delete", "deleted"), F.lit(False))


class ChangedTable:
    """A keyed table at ``path`` that changes are applied to.

    ``key``: its columns. ``order``: columns of which a greater value (by the first, then the next) wins; the rest of a
    tie is settled by a digest of the row. ``buckets``: fixed when the table is made; about 100 MB of rows a bucket is a
    good size, the default is the session's number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], buckets: int | None = None):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        at = self._newest()
        self.buckets = at["buckets"] if at else buckets or parallelism(spark)

    def _newest(self) -> dict | None:
        found = [n for n in names_in(self.spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        return read_json(self.spark, f"{self.path}/manifests/{found[-1]}") if found else None

    def version(self) -> int:
        """The number of the newest commit, -1 before the first."""
        at = self._newest()
        return at["version"] if at else -1

    def standing(self, changes: DataFrame) -> DataFrame:
        """The one change of each key that stands among ``changes``, aggregated map-side first.

        Rows with a null key or a null in the first order column say nothing and are ignored.
        """
        rest = [c for c in changes.columns if c not in self.key]
        ranks = comparable(changes, self.order)
        others = comparable(changes, [c for c in rest if c not in self.order])
        best = F.max_by(F.struct(*rest), F.struct(*ranks, *([F.xxhash64(*others)] if others else [])))
        rows = changes.where(all_set(self.key) & F.col(self.order[0]).isNotNull())
        return rows.groupBy(*self.key).agg(best.alias("_s")).select(*self.key, *[F.col("_s").getField(c).alias(c) for c in rest])

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders)

    def apply(self, changes: DataFrame, deletes: Column) -> int:
        """Applies a batch of changes and returns the new version.

        ``deletes`` is true for a row that deletes its key. Changes may come in any order, repeated, in one batch or in
        several: of a key the change greatest in ``order`` stands, whatever came before.
        """
        now = self._newest()
        version = (now["version"] if now else -1) + 1
        folders: dict[str, str] = dict(now["folders"]) if now else {}
        attempt = f"{version:08d}-{uuid.uuid4().hex}"  # another writer of this version has folders of its own
        routed, new = f"{self.path}/routed/{attempt}", f"{self.path}/data/{attempt}"
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        marked = self.standing(changes.withColumn(GONE, deletes)).withColumn(BUCKET, bucket)
        self._by_bucket(marked).write.partitionBy(BUCKET).parquet(routed)
        touched = [n for n in names_in(self.spark, routed) if n.startswith(f"{BUCKET}=")]
        schema = marked.drop(BUCKET).schema
        staged = False
        if touched:
            kept = [folders[b] for b in touched if b in folders]
            if kept:
                incoming = self.spark.read.schema(marked.schema).option("basePath", routed).parquet(*[f"{routed}/{b}" for b in touched])
                base = self._read(kept, schema).withColumn(BUCKET, bucket)
                self.merge(base, incoming).write.partitionBy(BUCKET).parquet(new)
                folders |= {b: f"{new}/{b}" for b in touched}
                staged = True
            else:  # nothing to merge with: the routed files are the buckets
                folders |= {b: f"{routed}/{b}" for b in touched}
        record = {"version": version, "buckets": self.buckets, "folders": folders, "rewritten": touched, "schema": schema.json()}
        done = create_json(self.spark, f"{self.path}/manifests/{version:08d}.json", record)
        if staged or not done:
            remove(self.spark, routed)
        if not done:
            remove(self.spark, new)
            raise RuntimeError(f"version {version} was committed by another writer; apply the changes again")
        return version

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        """A task a bucket: the bucket's number is the partition's."""
        return rows.repartitionById(self.buckets, F.col(BUCKET))

    def merge(self, base: DataFrame, incoming: DataFrame) -> DataFrame:
        """Base rows and standing changes of the same buckets, brought together once by bucket, sorted by key within it and
        merged: of a key's at most two rows the greater in order stays, of equal ones the change."""
        rest = [c for c in base.columns if c not in (*self.key, BUCKET)]
        both = self._by_bucket(base.withColumn(NEW, F.lit(0)).unionByName(incoming.withColumn(NEW, F.lit(1))))
        best = F.max_by(F.struct(*rest), F.struct(*comparable(base, self.order), NEW))
        merged = both.groupBy(BUCKET, *self.key).agg(best.alias("_s"))  # sorted runs of a bucket; the bucket is its partitioning
        return merged.select(*self.key, *[F.col("_s").getField(c).alias(c) for c in rest], BUCKET)

    def current(self, version: int | None = None) -> DataFrame:
        """The rows that exist, as of a version (the newest by default)."""
        at = self._newest() if version is None else read_json(self.spark, f"{self.path}/manifests/{version:08d}.json")
        if at is None:
            raise ValueError(f"nothing was committed to {self.path}")
        schema = StructType.fromJson(json.loads(at["schema"]))
        if not at["folders"]:
            return self.spark.createDataFrame([], schema).drop(GONE)
        return self._read(sorted(at["folders"].values()), schema).where(~F.col(GONE)).drop(GONE)
