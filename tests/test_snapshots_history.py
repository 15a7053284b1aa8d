import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, history, scd
from tidemark.operators.snapshots import snapshot_changes
from tidemark.sources.store import Store

SCHEMA = "k string, city string, state string, _batch_date date, _ingested_at timestamp"
A = ["city", "state"]
DAYS = [dt.date(2024, 1, d) for d in (1, 4, 5, 9, 20)]


def snap(spark, data):
    """(key, city, state, snapshot, minute of ingestion)"""
    return spark.createDataFrame([(k, c, s, DAYS[d], dt.datetime(2024, 1, 1, 0, m)) for k, c, s, d, m in data], SCHEMA)


def random_snapshots(seed, keys=6):
    rng, out, state = random.Random(seed), [], {}
    for d in range(len(DAYS)):
        for i in range(keys):
            if rng.random() < 0.35 or i not in state:
                state[i] = (rng.choice(["x", "y", "", None]), rng.choice(["A", None]))
            if rng.random() < 0.75:
                out.append((f"k{i}", *state[i], d, 5))
                if rng.random() < 0.3:
                    out.append((f"k{i}", "stale", "row", d, 1))
        out.append((None, "n", "n", d, 5))
    return out


def standing(data):
    best = {}
    for k, c, s, d, m in data:
        if k is not None and (k, d) not in best or k is not None and best[k, d][0] < m:
            best[k, d] = (m, (c, s))
    return {kd: v for kd, (_, v) in best.items()}


def test_changes_by_hand(spark, rows):
    df = snap(spark, [("a", "x", "A", 0, 1), ("a", "x", "A", 1, 1), ("a", None, "A", 2, 1), ("a", None, "A", 4, 1), ("b", "q", "B", 1, 1), ("c", "q", "B", 0, 1), ("c", "q", "B", 1, 1), ("d", "1", None, 3, 1)])
    assert rows(snapshot_changes(df, "k", A), "record_key", "day", "change") == [("a", DAYS[2], "changed"), ("a", DAYS[3], "removed"), ("a", DAYS[4], "added"), ("b", DAYS[1], "added"), ("b", DAYS[2], "removed"), ("c", DAYS[2], "removed"), ("d", DAYS[3], "added"), ("d", DAYS[4], "removed")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_against_brute_force(spark, rows, seed):
    data = random_snapshots(seed)
    s, want = standing(data), set()
    for d in range(1, len(DAYS)):
        for k in {k for k, _ in s}:
            was, now = s.get((k, d - 1)), s.get((k, d))
            if was != now:
                want.add((k, DAYS[d], "added" if (k, d - 1) not in s else "removed" if (k, d) not in s else "changed"))
    assert set(rows(snapshot_changes(snap(spark, data), "k", A), "record_key", "day", "change")) == want


def brute_versions(data):
    s, out = standing(data), []
    for k in sorted({k for k, _ in s}):
        seen = [(d, s[k, d]) for d in range(len(DAYS)) if (k, d) in s]
        starts = [x for i, x in enumerate(seen) if i == 0 or x[1] != seen[i - 1][1]]
        out += [(k, *v, DAYS[d], DAYS[starts[i + 1][0]] if i + 1 < len(starts) else None) for i, (d, v) in enumerate(starts)]
    return out


@pytest.mark.parametrize("seed,every", [(1, 1), (2, 2), (3, 4), (4, 100)])
def test_versions_by_checkpoints_and_patches(spark, rows, seed, every):
    data = random_snapshots(seed)
    got = rows(history.versions(snap(spark, data), "k", A, every=every), "k", *A, "valid_from", "valid_to")
    assert got == sorted(brute_versions(data), key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_log_stores_only_what_changed_and_reads_as_of_any_day(spark, rows):
    df = snap(spark, [("a", "x", "A", 0, 1), ("a", "y", "A", 1, 1), ("a", "y", None, 2, 1), ("a", "z", None, 4, 1)])
    log = history.history_log(df, "k", A, every=3)
    got = log.orderBy("valid_from").collect()
    assert [r["kind"] for r in got] == ["checkpoint", "patch", "patch", "checkpoint"]
    assert got[1]["state"] is None and got[1]["city"]["v"] == "y" and got[2]["state"]["v"] is None and got[2]["city"] is None
    assert rows(history.as_of(log, "k", A, DAYS[3]), "k", *A, "valid_from") == [("a", "y", None, DAYS[2])]
    assert rows(history.as_of(log, "k", A, dt.date(2023, 1, 1))) == []


def test_applied_snapshots_equal_the_one_pass_history(spark, rows, tmp_path):
    data = random_snapshots(5)
    store = Store(spark, f"file://{tmp_path}")
    assert scd.apply_snapshots(store, "h", snap(spark, data), "k", A) == len(DAYS)
    assert scd.apply_snapshots(store, "h", snap(spark, data), "k", A) == 0
    columns = ["k", *A, "valid_from", "valid_to", "is_current", "version_key"]
    assert rows(store.read("h"), *columns) == rows(scd.as_dimension(history.versions(snap(spark, data), "k", A), "k", A), *columns)
    assert not scd.apply_snapshot(store, "h", snap(spark, data).where(F.col("_batch_date") == F.lit(DAYS[0])), "k", A, DAYS[0])


def test_known_at_event_time_against_versions(spark):
    data = random_snapshots(6)
    packed = asof.packed_histories(asof.attribute_changes(snap(spark, data), "k", A), "k", A)
    ev = [(i, f"k{i % 7}" if i % 11 else None, dt.date(2023, 12, 30) + dt.timedelta(days=i % 25) if i % 13 else None) for i in range(120)]
    events = spark.createDataFrame([(i, k, d, "own") for i, k, d in ev], "id int, k string, day date, city string")
    want = {}
    for i, k, d in ev:
        vs = [v for v in brute_versions(data) if v[0] == k]
        now = [v for v in vs if d and v[3] <= d and (v[4] is None or d < v[4])]
        want[i] = (now[0][1] if now else None, now[0][2] if now else None, now[0][3] if now else None, vs[-1][3] if vs else None)
    for per_task in (1_000_000, 5):  # the second splits the hot keys
        got = asof.known_at(events, "day", packed, "k", A, ["id"], rows_per_task=per_task).collect()
        assert {r["id"]: (r["city_"], r["state"], r["_known_since"], r["_last_since"]) for r in got} == want
        assert all(r["city"] == "own" for r in got) and len(got) == len(ev)


def test_empty_snapshots(spark, rows):
    df = snap(spark, [])
    assert rows(snapshot_changes(df, "k", A)) == [] and rows(history.versions(df, "k", A)) == []
    assert rows(asof.packed_histories(asof.attribute_changes(df, "k", A), "k", A)) == []


@pytest.mark.parametrize("seed,every", [(7, 1), (8, 2), (9, 4)])
def test_a_stored_history_takes_snapshots_as_they_come(spark, rows, tmp_path, seed, every):
    data = random_snapshots(seed)
    store = Store(spark, f"file://{tmp_path}")
    kept = history.HistoryTable(store, "h", "k", A, every)
    for part in ((0, 1), (2,), (2,), (3, 4), (0, 4)):  # some are delivered again
        kept.add(snap(spark, [r for r in data if r[3] in part]))
    assert rows(kept.versions(), "k", *A, "valid_from", "valid_to") == sorted(brute_versions(data), key=lambda t: tuple((x is not None, str(x)) for x in t))
    assert rows(kept.log(), "k", "valid_from", "segment", "kind") == rows(history.history_log(snap(spark, data), "k", A, every=every), "k", "valid_from", "segment", "kind")
    assert rows(kept.as_of(DAYS[2]), "k", *A) == sorted([v[:3] for v in brute_versions(data) if v[3] <= DAYS[2] and (v[4] is None or DAYS[2] < v[4])], key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_patches_logged_twice_start_no_version(spark, rows):
    df = snap(spark, [("a", "x", "A", 0, 1), ("a", "y", None, 1, 1), ("a", "z", None, 4, 1)])
    log = history.history_log(df, "k", A, every=8)
    assert rows(history.fold_log(log.union(log.where("kind = 'patch'")), "k", A)) == rows(history.fold_log(log, "k", A))


def test_a_days_snapshot_in_two_parts(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    part = lambda *r: snap(spark, list(r))
    assert scd.apply_snapshots(store, "h", part(("a", "x", "A", 0, 1), ("b", "x", "A", 0, 1)), "k", A) == 1
    assert scd.apply_snapshots(store, "h", part(("a", "y", "A", 1, 1), ("c", "p", "A", 1, 1)), "k", A) == 1
    assert scd.apply_snapshots(store, "h", part(("b", "z", "A", 1, 2), ("d", "q", "A", 1, 2), ("c", "r", "A", 1, 2)), "k", A) == 1
    assert scd.apply_snapshots(store, "h", part(("b", "z", "A", 1, 2), ("a", "old", "A", 0, 9)), "k", A) == 0
    got = rows(store.read("h"), "k", "city", "valid_from", "valid_to", "is_current")
    first = scd.BEGINNING
    assert got == [("a", "x", first, DAYS[1], False), ("a", "y", DAYS[1], None, True), ("b", "x", first, DAYS[1], False), ("b", "z", DAYS[1], None, True), ("c", "r", first, None, True), ("d", "q", first, None, True)]
