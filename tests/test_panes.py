import datetime as dt
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators.panes import Windows, late_outcomes, pane_changes, slice_events, window_results

BACKFILL = dt.date(2024, 3, 31)
SCHEMA = "id int, at timestamp, price decimal(12,2), _batch_date date"


def day(n):
    return dt.date(2024, 4, 1) + dt.timedelta(days=n)


def at(n):
    return dt.datetime.combine(day(n), dt.time(15))


def events(spark, rows):
    return spark.createDataFrame([(i, a, p if p is None else Decimal(p), b) for i, (a, p, b) in enumerate(rows)], SCHEMA)


def test_outcomes_and_their_boundaries(spark, rows):
    df = events(spark, [(at(0), None, day(0)), (at(0), None, day(1)), (at(0), None, day(3)), (at(0), None, day(4)), (at(5), None, day(1)), (at(-9), None, BACKFILL), (None, None, day(1)), (at(0), None, None)])
    got = rows(slice_events(df, "at", "_batch_date", 3, BACKFILL), "id", "_lateness", "_outcome")
    assert got == [(0, 0, "on_time"), (1, 1, "corrects"), (2, 3, "corrects"), (3, 4, "too_late"), (4, -4, "on_time"), (5, 8, "on_time")]


def test_without_backfill_everything_has_a_cutoff(spark, rows):
    assert rows(slice_events(events(spark, [(at(-9), None, BACKFILL)]), "at", "_batch_date", 3), "_outcome") == [("too_late",)]


def test_only_windows_that_cover_a_changed_pane_are_emitted_again(spark, rows):
    df = slice_events(events(spark, [(at(0), 5, day(0)), (at(4), 7, day(4)), (at(3), 1, day(5)), (at(0), 9, day(5))]), "at", "_batch_date", 3)
    changes = pane_changes(df, "_batch_date", {"n": F.lit(1), "total": F.col("price")})
    got = rows(window_results(changes, "_batch_date", ["n", "total"], 1, 1), "window_start", "_batch_date", "n", "total")
    assert [(a, b, n, int(t)) for a, b, n, t in got] == [(day(0), day(0), 1, 5), (day(3), day(5), 1, 1), (day(4), day(4), 1, 7)]


@pytest.mark.parametrize("size,slide", [(1, 1), (7, 1), (7, 7), (6, 4), (3, 5)])
def test_windows_against_brute_force(spark, size, slide):
    data = [(at((i * 7) % 12), i % 5, day((i * 7) % 12 + i % 4)) for i in range(60)] + [(at(2), None, day(3))] * 2
    changes = pane_changes(slice_events(events(spark, data), "at", "_batch_date", 3), "_batch_date", {"n": F.lit(1), "total": F.col("price")})
    got = {(r["window_start"], r["_batch_date"]): (r["n"], r["total"] or 0) for r in window_results(changes, "_batch_date", ["n", "total"], size, slide).collect()}
    epoch = dt.date(1970, 1, 1)
    want, touched = {}, defaultdict(set)
    for a, _, b in data:
        d = (a.date() - epoch).days
        for s in range(d - size + 1, d + 1):
            if s % slide == 0:
                touched[b].add(s)
    for b, starts in touched.items():
        for s in starts:
            inside = [p for a, p, x in data if x <= b and s <= (a.date() - epoch).days < s + size]
            want[epoch + dt.timedelta(days=s), b] = (len(inside), sum(p or 0 for p in inside))
    assert got == want


def test_empty_and_impossible_windows(spark, rows):
    changes = pane_changes(slice_events(events(spark, []), "at", "_batch_date", 3), "_batch_date", {"n": F.lit(1)})
    assert rows(window_results(changes, "_batch_date", ["n"], 7, 1)) == []
    with pytest.raises(ValueError):
        window_results(changes, "_batch_date", ["n"], 0, 1)


def test_names_that_the_operator_adds_are_replaced(spark):
    df = events(spark, [(at(0), 1, day(0))]).withColumn("_pane", F.lit("mine")).withColumn("_outcome", F.lit(3))
    assert slice_events(df, "at", "_batch_date", 3).first()["_outcome"] == "on_time"


def test_panes_are_as_wide_as_window_boundaries_allow(spark, rows):
    month = Windows(30 * 86_400)
    df = slice_events(events(spark, [(at(i), i, day(i)) for i in range(20)]), "at", "_batch_date", 3, windows=month)
    assert month.pane == 30 * 86_400 and df.select("_pane").distinct().count() <= 2
    how = {"n": F.lit(1), "least": ("min", F.col("price")), "most": ("max", F.col("price"))}
    changes = pane_changes(df, "_batch_date", how)
    last = window_results(changes, "_batch_date", how, windows=month).orderBy(F.desc("_batch_date")).first()
    inside = [i for i in range(20) if dt.datetime.combine(day(i), dt.time(15)) >= last["window_start"]]
    assert (last["n"], int(last["least"]), int(last["most"])) == (len(inside), min(inside), max(inside)) and last["window_end"] - last["window_start"] == dt.timedelta(days=30)
    assert (Windows(6 * 3600, 4 * 3600).pane, Windows(86_400).pane, Windows(7 * 86_400, 86_400).pane) == (7200, 86_400, 86_400)
    with pytest.raises(ValueError):
        Windows(7, 7, 2)


def test_outcomes_are_read_from_what_was_emitted(spark, rows):
    df = slice_events(events(spark, [(at(0), 1, day(0)), (at(0), 1, day(2)), (at(0), 1, day(4)), (at(1), 1, day(4)), (at(-9), 1, BACKFILL), (at(3), 1, day(1))]), "at", "_batch_date", 3, BACKFILL)
    emitted = window_results(pane_changes(df, "_batch_date", {"n": F.lit(1)}), "_batch_date", ["n"])
    assert rows(late_outcomes(df, emitted, "_batch_date", "n", BACKFILL), "id", "_outcome") == [(1, "corrects"), (2, "too_late"), (3, "corrects")]
    nothing = emitted.where("window_start <> DATE'2024-04-02'")  # a window that isn't emitted corrects nothing
    assert rows(late_outcomes(df, nothing, "_batch_date", "n", BACKFILL), "id", "_outcome") == [(1, "corrects"), (2, "too_late"), (3, "too_late")]


def test_p1_and_p4_go_through_their_methods(spark):
    from tidemark.plans import found

    folder = "/root/testdata/sf0.001"
    p1 = found.p1_found(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert p1.count("Aggregate [_pane") == 1 and "Window [sum(item_count" in p1
    p4 = found.p4_found(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "last(seller_city" in p4 and "segment" in p4 and "kind" in p4 and "parquet" in p4
