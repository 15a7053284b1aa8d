import datetime as dt
import random

import pytest

from tidemark.operators.changes import ChangedTable, is_delete

SCHEMA = "order_id string, change_seq int, order_status string, _op string, _ingested_at timestamp"
ORDER = ["change_seq", "_ingested_at"]


def feed(spark, data):
    return spark.createDataFrame([(k, s, v, op, m if m is None else dt.datetime(2024, 1, 1, 0, m)) for k, s, v, op, m in data], SCHEMA)


def table(spark, path, buckets=4):
    return ChangedTable(spark, f"file://{path}", ["order_id"], ORDER, buckets)


def expected(data):
    best = {}
    for k, s, v, op, m in data:
        if k is not None and s is not None:
            rank = (s, -1 if m is None else m)
            if k not in best or rank > best[k][0]:
                best[k] = (rank, v, op)
    return sorted((k, r[0], v) for k, (r, v, op) in best.items() if (op or "").lower() not in ("d", "delete"))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_in_any_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([1, 2, 3, 4, None]), f"s{i}", rng.choice(["I", "update", "DELETE", "D", None]), i) for i in range(40)]
    t = table(spark, tmp_path)
    for part in (data[:15], data[15:16], [], data[16:]):
        t.apply(feed(spark, part), is_delete())
    got = sorted((r["order_id"], r["change_seq"], r["order_status"]) for r in t.current().collect())
    assert got == expected(data) and t.version() == 3


def test_a_late_change_does_not_bring_a_deleted_key_back(spark, rows, tmp_path):
    t = table(spark, tmp_path)
    t.apply(feed(spark, [("a", 5, None, "delete", 1), ("b", 1, "x", "I", 1)]), is_delete())
    t.apply(feed(spark, [("a", 3, "shipped", "U", 9)]), is_delete())
    assert rows(t.current(), "order_id") == [("b",)]
    t.apply(feed(spark, [("a", 6, "again", "I", 9)]), is_delete())
    assert rows(t.current(), "order_id", "order_status") == [("a", "again"), ("b", "x")]


def test_only_touched_buckets_are_written_and_old_versions_stay(spark, rows, tmp_path):
    t = table(spark, tmp_path, 8)
    t.apply(feed(spark, [(f"k{i}", 1, "new", "I", 1) for i in range(60)]), is_delete())
    before = dict(t._newest()["folders"])
    t.apply(feed(spark, [("k7", 2, "changed", "U", 1)]), is_delete())
    after = t._newest()
    assert len(before) == 8 and len(after["rewritten"]) == 1
    assert sum(before[b] != after["folders"][b] for b in before) == 1
    assert rows(t.current(0).where("order_id = 'k7'"), "order_status") == [("new",)]
    assert rows(t.current().where("order_id = 'k7'"), "order_status") == [("changed",)]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.apply(feed(spark, [("a", 1, "x", "I", 1)]), is_delete())
    monkeypatch.setattr(other, "_newest", lambda: None)
    with pytest.raises(RuntimeError):
        other.apply(feed(spark, [("a", 2, "y", "I", 1)]), is_delete())
    assert [(r["change_seq"], r["order_status"]) for r in t.current().collect()] == [(1, "x")]
    stale = t._newest()
    t.apply(feed(spark, [("a", 3, "z", "U", 1)]), is_delete())
    monkeypatch.setattr(other, "_newest", lambda: stale)
    with pytest.raises(RuntimeError):
        other.apply(feed(spark, [("a", 9, "lost", "U", 1)]), is_delete())
    assert [(r["change_seq"], r["order_status"]) for r in t.current().collect()] == [(3, "z")]
    assert sorted(p.name for p in (tmp_path / "routed").iterdir() if not p.name.startswith("."))[0].startswith("00000000-")
    assert len(list((tmp_path / "routed").iterdir())) == 1  # files that were merged, and those of losers, are gone


def test_ties_repeats_null_times_and_empty(spark, rows, tmp_path):
    t = table(spark, tmp_path)
    t.apply(feed(spark, []), is_delete())
    assert rows(t.current()) == []
    same = [("a", 1, "x", "I", 3), ("a", 1, "x", "I", 3), ("a", 1, "old", "I", 1), ("a", 1, "none", "I", None)]
    t.apply(feed(spark, same), is_delete())
    t.apply(feed(spark, same), is_delete())
    assert rows(t.current(), "order_id", "order_status") == [("a", "x")]


def test_words_for_delete(spark):
    df = spark.createDataFrame([(o,) for o in ("d", " DELETE ", "Delete", "update", "I", "", None)], "_op string")
    assert [r[0] for r in df.select(is_delete("_op")).collect()] == [True, True, True, False, False, False, False]
