import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources.store import Store
from tidemark.streaming.ingest import each_batch
from tidemark.streaming.late import PaneStream

SCHEMA = "id int, at timestamp, _batch_date date"


def day(n):
    return dt.date(2024, 4, 1) + dt.timedelta(days=n)


def events(spark, *rows):
    return spark.createDataFrame([(i, dt.datetime.combine(day(d), dt.time(8)) if d is not None else None, day(b)) for i, (d, b) in enumerate(rows)], SCHEMA)


def stream(store, size=1, slide=1):
    return PaneStream(store, "s", "at", "_batch_date", {"n": F.lit(1).cast("bigint")}, 3, size_days=size, slide_days=slide)


@pytest.mark.parametrize("size,slide", [(1, 1), (3, 1), (4, 2)])
def test_windows_after_late_events(spark, rows, tmp_path, size, slide):
    store = Store(spark, f"file://{tmp_path}")
    s = stream(store, size, slide)
    batches = [[(0, 0), (1, 1)], [(0, 2), (3, 3), (None, 3)], [], [(0, 9), (9, 9)]]  # the last (0, 9) is too late
    for n, b in enumerate(batches):
        s.apply(events(spark, *b), n)
        s.apply(events(spark, *b), n)  # replayed
    counted = [day(d) for b in batches for d, a in b if d is not None and a - d <= 3]
    epoch, want = dt.date(1970, 1, 1), {}
    for d in counted:
        k = (d - epoch).days
        for start in range(k - size + 1, k + 1):
            if start % slide == 0:
                w = epoch + dt.timedelta(days=start)
                want[w] = want.get(w, 0) + 1
    assert dict(rows(s.results())) == want
    if size == 1:
        assert rows(store.read("s.windows"), "batch", "window_start", "n") == [(0, day(0), 1), (0, day(1), 1), (1, day(0), 2), (1, day(3), 1), (3, day(9), 1)]


def test_as_a_stream(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t")
    s = stream(store)
    for batch in ([(0, 0), (0, 1)], [(0, 2)]):
        events(spark, *batch).write.mode("append").parquet(f"file://{tmp_path}/in")
        each_batch(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/c", s.apply)
    assert rows(s.results()) == [(day(0), 3)]
    with pytest.raises(ValueError):
        stream(store, 0)


def test_a_batch_writes_its_own_panes_only(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    s = stream(store, 3, 1)
    s.apply(events(spark, *[(d, d) for d in range(20)]), 0)
    s.apply(events(spark, (18, 20)), 1)
    last = store.history("s.panes").orderBy(F.desc("version")).first()
    assert (last["metrics"]["insert"], last["metrics"]["update"], last["metrics"]["keep"]) == (1, 0, 0)
    assert rows(store.read("s.windows").where("batch = 1"), "window_start", "n") == [(day(16), 4), (day(17), 4), (day(18), 3)]


@pytest.mark.parametrize("fold_every", [1, 64])
def test_copies_in_later_batches_are_left_out(spark, rows, tmp_path, fold_every):
    store = Store(spark, f"file://{tmp_path}")
    s = PaneStream(store, "s", "at", "_batch_date", {"n": F.lit(1).cast("bigint"), "least": ("min", F.col("id")), "most": ("max", F.col("id"))}, 3, key=["id"], fold_every=fold_every)
    first = events(spark, (0, 0), (1, 1))
    s.apply(first.union(first), 0)
    for number in (1, 1):
        s.apply(first.withColumn("_batch_date", F.lit(day(2))).union(spark.createDataFrame([(7, dt.datetime.combine(day(1), dt.time(9)), day(2)), (None, dt.datetime.combine(day(1), dt.time(9)), day(2))], SCHEMA)), number)
    assert rows(s.results()) == [(day(0), 1, 0, 0), (day(1), 2, 1, 7)]
    s.apply(first.withColumn("_batch_date", F.lit(day(9))), 2)  # by now too late, remembered or not
    assert rows(s.results(), "window_start", "n") == [(day(0), 1), (day(1), 2)]
    if fold_every == 1:
        assert rows(store.read("s.panes"), "n") == [(1,), (2,)]


def test_windows_of_hours(spark, rows, tmp_path):
    from tidemark.operators.panes import Windows

    store = Store(spark, f"file://{tmp_path}")
    s = PaneStream(store, "s", "at", "_batch_date", {"n": F.lit(1).cast("bigint")}, 3, windows=Windows(6 * 3600, 4 * 3600))
    s.apply(events(spark, (0, 0)), 0)  # at 8 o'clock: panes of two hours, windows from 4 and from 8
    assert rows(store.read("s.panes"), "pane") == [((dt.datetime(2024, 4, 1, 8) - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=2),)]
    assert rows(s.results()) == [(dt.datetime(2024, 4, 1, 4), 1), (dt.datetime(2024, 4, 1, 8), 1)]
