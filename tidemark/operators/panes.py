"""Late and out-of-order events: aggregates by event time, corrected as late records arrive.

Stream slicing: event time is cut into non-overlapping panes, at the granularity of window boundaries: a pane is as wide as
the greatest common divisor of the windows' size and slide. An arriving batch changes only the panes of its events; only the
windows that cover a changed pane are composed again and emitted. Events beyond the cut-off change nothing.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
ON_TIME, CORRECTS, TOO_LATE = "on_time", "corrects", "too_late"
SUM, LEAST, GREATEST = "sum", "min", "max"
_COMBINE = {SUM: F.sum, LEAST: F.min, GREATEST: F.max}


@dataclass(frozen=True)
class Windows:
    """Windows of ``size`` seconds that start every ``slide`` seconds, counted from 1970; tumbling without ``slide``. ``width``
    is that of panes made already, where these are narrower than they need be."""

    size: int = DAY
    slide: int | None = None
    width: int | None = None

    def __post_init__(self):
        if min(self.size, self.step) < 1 or self.size % self.pane or self.step % self.pane:
            raise ValueError("size and slide must be positive multiples of the pane")

    @property
    def step(self) -> int:
        return self.size if self.slide is None else self.slide

    @property
    def pane(self) -> int:
        """The width of a pane in seconds."""
        return self.width or gcd(self.size, self.step)

    def starts(self, pane: Column) -> tuple[Column, Column]:
        """The first and the last start, in panes, of the windows that cover a pane; the first is greater where none does."""
        step, size = self.step // self.pane, self.size // self.pane
        return (F.ceil((pane - size + 1) / step) * step).cast("bigint"), (F.floor(pane / step) * step).cast("bigint")


def pane_of(event_time: Column, width: int) -> Column:
    """The number of the pane that a time falls into, panes of ``width`` seconds counted from 1970."""
    return F.floor(F.unix_seconds(event_time.cast("timestamp")) / width).cast("bigint")


def pane_start(pane: Column, width: int) -> Column:
    """The time at which a pane begins."""
    return F.timestamp_seconds(pane * width).cast("timestamp_ntz")


def measure(value: Column | tuple[str, Column]) -> tuple[str, Column]:
    """A measure is (``sum``, ``min`` or ``max``, column); a column alone is summed. What these three give of panes can be
    composed into what they give of a window; a mean is a sum and a count."""
    return value if isinstance(value, tuple) else (SUM, value)


def slice_events(events: DataFrame, event_time: str, arrival: str, allowed_days: int, open_until: dt.date | None = None, windows: Windows = Windows()) -> DataFrame:
    """Each event with its pane (``_pane``, a number), its lateness in days and what it does to that pane.

    ``on_time``: it arrives no later than its day, or in a batch up to ``open_until`` (a backfill, which no cut-off
    concerns). ``corrects``: it arrives up to ``allowed_days`` later and changes a pane that may have been emitted.
    ``too_late``: it changes nothing. Events without event time or arrival have no pane and are left out. An event that claims
    to be of the future is on time. Input columns of the three names added are replaced.
    """
    late = F.date_diff(F.col(arrival), F.to_date(event_time))
    free = F.col(arrival) <= F.lit(open_until) if open_until else F.lit(False)
    outcome = F.when(free | (F.col("_lateness") <= 0), ON_TIME).when(F.col("_lateness") <= allowed_days, CORRECTS).otherwise(TOO_LATE)
    seen = events.where(F.col(event_time).isNotNull() & F.col(arrival).isNotNull())
    return seen.withColumn("_pane", pane_of(F.col(event_time), windows.pane)).withColumn("_lateness", late).withColumn("_outcome", outcome)


def pane_changes(sliced: DataFrame, arrival: str, measures: dict[str, Column | tuple[str, Column]]) -> DataFrame:
    """What each batch adds to each pane: one small row for each pane and batch, combined map-side."""
    parts = {k: measure(v) for k, v in measures.items()}
    return sliced.where(F.col("_outcome") != TOO_LATE).groupBy("_pane", arrival).agg(*[_COMBINE[how](c).alias(k) for k, (how, c) in parts.items()])


def window_results(changes: DataFrame, arrival: str, measures: list[str] | dict[str, Column | tuple[str, Column]], size_days: int = 1, slide_days: int = 1, windows: Windows | None = None) -> DataFrame:
    """Every window's aggregates as they stand after each batch that changed one of its panes.

    Windows are of ``size_days`` and ``slide_days`` over panes of a day, and their bounds dates; or any ``windows``, over panes
    as wide as theirs, and their bounds times. Columns: ``window_start``, ``window_end`` (exclusive), ``_start`` (the start in panes), the arrival column, the measures,
    and ``_since``: for the first measure, what it was when the window was last emitted (null at first). A pane change is sent
    to the windows that cover it (``size/slide`` of them); measures of a window run over its batches. Works on pane rows only,
    whose number is panes x batches whatever the number of events.
    """
    kind, windows = ("timestamp_ntz", windows) if windows else ("date", Windows(size_days * DAY, slide_days * DAY, DAY))
    how = {m: SUM for m in measures} if isinstance(measures, list) else {k: measure(v)[0] for k, v in measures.items()}
    first, last = windows.starts(F.col("_pane"))
    starts = changes.where(last >= first).withColumn("_start", F.explode(F.sequence(first, last, F.lit(windows.step // windows.pane))))
    per_batch = starts.groupBy("_start", arrival).agg(*[_COMBINE[h](c).alias(c) for c, h in how.items()])
    order = Window.partitionBy("_start").orderBy(arrival)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bound = lambda more, name: pane_start(F.col("_start") + more, windows.pane).cast(kind).alias(name)
    lead = next(iter(how))
    return per_batch.select(
        bound(0, "window_start"), bound(windows.size // windows.pane, "window_end"), "_start", F.col(arrival),
        *[_COMBINE[h](c).over(so_far).alias(c) for c, h in how.items()], _COMBINE[how[lead]](lead).over(before).alias("_since"),
    )


def late_outcomes(sliced: DataFrame, emitted: DataFrame, arrival: str, counted: str, open_until: dt.date | None = None) -> DataFrame:
    """What became of each late event (later than its day, in a batch after ``open_until``), read from the windows emitted.

    ``emitted`` are the tumbling windows of ``window_results``, one pane each, with a count of events as the first measure. A
    late event ``corrects`` where its batch emitted its window again with more events than it had; where it didn't, the event
    came ``too_late``. The join's right side holds windows x batches; whether it is broadcast is decided by its size as measured.
    """
    late = sliced.where(F.col("_lateness") > 0)
    if open_until:
        late = late.where(F.col(arrival) > F.lit(open_until))
    grown = emitted.where(F.col(counted) > F.coalesce("_since", F.lit(0))).select(F.col("_start").alias("_pane"), arrival, F.lit(True).alias("_grown"))
    return late.drop("_outcome").join(grown, ["_pane", arrival], "left").withColumn("_outcome", F.when(F.col("_grown"), CORRECTS).otherwise(TOO_LATE)).drop("_grown")
