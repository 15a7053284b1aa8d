"""A replay of raw tables as dated deliveries: planned once, then delivered day by day into the landing folders."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.sources import landing
from tidemark.sources.contracts import CONTRACTS
from tidemark.sources.store import Store

MANIFEST = "ops.replay_manifest"
#: The raw files below a replay's source folder.
SOURCE_FILES = {k: f"{k}.csv" for k in ("orders", "items", "customers", "reviews", "products", "sellers", "translation")}


class ReplayStarted(RuntimeError):
    """Days of the replay were delivered already; planning it anew would deliver them again."""


def raw_files(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The raw files of a folder, all columns text."""
    return {k: landing.read_csv(spark, f"{folder}/{name}") for k, name in SOURCE_FILES.items()}


class Replay:
    """Below ``base``: ``staging`` holds what will be delivered by day, ``landing`` what was; the table of the manifest says, a
    row a feed and day, how many rows there are, what was done to them, and when they were delivered."""

    def __init__(self, store: Store, base: str, plan: replay.Plan):
        self.store, self.spark, self.base, self.plan = store, store.spark, base.rstrip("/"), plan

    def manifest(self) -> DataFrame:
        return self.store.read(MANIFEST)

    def prepare(self, raw: dict[str, DataFrame], force: bool = False) -> None:
        """Builds and stages all feeds with their faults, and the manifest of what lies there. Refuses to begin anew where days
        were delivered, unless ``force`` says so."""
        if not force and self.store.exists(MANIFEST) and not self.manifest().where(F.col("delivered_at").isNotNull()).isEmpty():
            raise ReplayStarted("days of this replay were delivered; prepare again only with force")
        parts = []
        for name, rows in replay.with_faults(replay.feeds(raw, self.plan), self.plan).items():
            replay.stage(rows, f"{self.base}/staging/{name}")
            parts.append(replay.manifest(self.spark.read.parquet(f"{self.base}/staging/{name}"), name, replay.DAY, replay.NEW_FIELD))
        every = reduce(lambda a, b: a.unionByName(b), parts)
        self.store.overwrite(MANIFEST, every.withColumn("delivered_at", F.lit(None).cast("timestamp")))

    def next_day(self) -> dt.date | None:
        """The earliest day not delivered yet; None where all were."""
        return replay.next_undelivered(self.manifest())

    def deliver(self, day: dt.date) -> dt.date:
        """Drops a day's files, rows in no order, and marks the day. Doing it again replaces the files."""
        planned = {r["feed"] for r in self.manifest().where(F.col("batch_date") == F.lit(day)).select("feed").collect()}  # at most the feeds
        for name in sorted(planned):
            rows = replay.staged_day(self.spark, f"{self.base}/staging/{name}", day).drop(replay.DAY, "_fault")
            landing.drop(rows, f"{self.base}/landing/{name}", day, CONTRACTS[name].fmt, seed=self.plan.seed, mode="overwrite")
        self.store.update(MANIFEST, (F.col("batch_date") == F.lit(day)) & F.col("delivered_at").isNull(), delivered_at=F.current_timestamp())
        return day
