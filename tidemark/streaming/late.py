"""Windowed aggregates of a stream of events that come late, kept by panes in tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.once import deliver_once
from tidemark.operators.panes import _COMBINE, DAY, TOO_LATE, Windows, measure, pane_changes, pane_start, slice_events
from tidemark.sources.store import Store, merge_insert_new

BATCH = "batch"


class PaneStream:
    """State of a windowed aggregation over micro-batches, for ``foreachBatch``.

    The table ``panes`` receives what each batch adds to its panes, a row a pane: a batch writes the panes of its events and no
    other. The table ``windows`` receives, per batch, the windows that cover a changed pane, recomposed from their panes, as
    they stand after it. Both are written with the batch's number as transaction, so a batch replayed after a failure changes
    nothing twice. Events beyond the cut-off change nothing.

    With ``key`` (the columns that identify a message) copies are left out, in one batch by the operator of problem 6 and over
    batches by the table ``seen``: the identifiers of events that could still be counted. Rows without an identifier are then
    left out too. Without ``key`` every row counts.

    Every ``fold_every`` batches the rows of each pane are folded into one, and identifiers of events beyond the cut-off (a copy
    of which would come too late) are forgotten, so state is as large as panes and the identifiers of the days still open.
    """

    def __init__(
        self, store: Store, name: str, event_time: str, arrival: str, sums: dict[str, Column | tuple[str, Column]], allowed_days: int, open_until: dt.date | None = None,
        size_days: int = 1, slide_days: int = 1, windows: Windows | None = None, key: list[str] | None = None, order: tuple[str, ...] = (), fold_every: int = 64, buckets: int = 16,
    ):
        self.kind, self.spans = ("timestamp_ntz", windows) if windows else ("date", Windows(size_days * DAY, slide_days * DAY))
        self.store, self.panes, self.windows, self.seen = store, f"{name}.panes", f"{name}.windows", f"{name}.seen"
        self.event_time, self.arrival, self.measures = event_time, arrival, sums
        self.how = {k: measure(v)[0] for k, v in sums.items()}
        self.allowed, self.open_until, self.key, self.order, self.fold_every, self.buckets = allowed_days, open_until, key, order, fold_every, buckets

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes one micro-batch; its rows may come from several deliveries."""
        sliced = slice_events(batch, self.event_time, self.arrival, self.allowed, self.open_until, self.spans)
        sliced = sliced.where(F.col("_outcome") != TOO_LATE)
        if self.key:
            sliced = deliver_once(sliced, self.key, self.order or (self.arrival,))
            if self.store.exists(self.seen):
                sliced = sliced.join(self.store.read(self.seen).select(*self.key), self.key, "left_anti")
            sliced = sliced.persist()
        try:
            added = pane_changes(sliced, self.arrival, self.measures).groupBy(F.col("_pane").alias("pane")).agg(*[_COMBINE[h](c).alias(c) for c, h in self.how.items()])
            self.store.append(self.panes, added.withColumn(BATCH, F.lit(number)), txn=("panes", number))
            self.store.append(self.windows, self._covering(number).withColumn(BATCH, F.lit(number)), txn=("windows", number))
            if self.key:  # last: until then a replay must find the same rows new
                ids = sliced.select(*self.key, F.to_date(self.event_time).alias("_day"), F.col(self.arrival).alias("_arrived"))
                self.store.ensure(self.seen, ids.schema, self.key, self.buckets)
                merge_insert_new(self.store, self.seen, ids, self.key, txn=("seen", number), unique=True)
        finally:
            if self.key:
                sliced.unpersist()
        if number % self.fold_every == self.fold_every - 1:
            self.fold()

    def fold(self) -> None:
        """One row a pane, and only the identifiers that can still matter."""
        rows = self.store.read(self.panes)
        self.store.overwrite(self.panes, rows.groupBy("pane").agg(*[_COMBINE[h](c).alias(c) for c, h in self.how.items()], F.max(BATCH).alias(BATCH)))
        if self.key:
            ids = self.store.read(self.seen)
            newest = ids.agg(F.max("_arrived")).first()[0]
            if newest is not None:
                self.store.overwrite(self.seen, ids.where(F.date_add("_day", self.allowed) >= F.to_date(F.lit(newest))), self.key)
            self.store.vacuum(self.seen)
        self.store.compact(self.windows)

    def _starts(self, panes: DataFrame) -> DataFrame:
        first, last = self.spans.starts(F.col("pane"))
        return panes.where(last >= first).withColumn("start", F.explode(F.sequence(first, last, F.lit(self.spans.step // self.spans.pane))))

    def _covering(self, number: int) -> DataFrame:
        """The windows over the panes that a batch changed, composed of all of their panes. Only panes that lie in one of
        these windows are read on; their first and last prune the scan."""
        kept = self.store.read(self.panes)
        touched = self._starts(kept.where(F.col(BATCH) == number).select("pane")).select("start").distinct()
        width = self.spans.size // self.spans.pane
        wanted = touched.select(F.explode(F.sequence("start", F.col("start") + width - 1)).alias("pane")).distinct()
        ends = touched.agg(F.min("start"), F.max("start")).first()
        near = kept.where(F.col("pane").between(ends[0], ends[1] + width - 1)) if ends[0] is not None else kept.limit(0)
        parts = self._starts(near.join(wanted, "pane", "left_semi")).join(touched, "start", "left_semi")
        start = pane_start(F.col("start"), self.spans.pane).cast(self.kind)
        return parts.groupBy(start.alias("window_start")).agg(*[_COMBINE[h](c).alias(c) for c, h in self.how.items()])

    def results(self) -> DataFrame:
        """Each window as it stands now: its last emission."""
        log = self.store.read(self.windows)
        last = F.max_by(F.struct(*self.how), F.col(BATCH))
        return log.groupBy("window_start").agg(last.alias("_w")).select("window_start", "_w.*")
