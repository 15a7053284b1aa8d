import pytest
from pyspark.sql import functions as F

from tidemark.sources.store import ChangesUnavailable, ConcurrentCommit, DuplicateKeys, Store, merge_forward_only, merge_hash_guarded, merge_insert_new, merge_upsert

SCHEMA = "k string, v int, seq int"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def df(spark, *data, schema=SCHEMA):
    return spark.createDataFrame(list(data), schema)


@pytest.fixture(params=[1, 4])
def table(spark, store, request):
    first = df(spark, ("a", 1, 1), ("b", 2, 1))
    store.ensure("t", first.schema, ["k"], request.param)
    merge_upsert(store, "t", first, ["k"])
    return store


def test_insert_new(spark, table, rows):
    merge_insert_new(table, "t", df(spark, ("a", 9, 9), ("c", 3, 1)), ["k"])
    assert rows(table.read("t")) == [("a", 1, 1), ("b", 2, 1), ("c", 3, 1)]
    assert rows(table.read("t", 1)) == [("a", 1, 1), ("b", 2, 1)]


def test_upsert_with_and_without_guard(spark, table, rows):
    merge_upsert(table, "t", df(spark, ("a", 9, 0), ("c", 3, 1)), ["k"], newer="seq")
    assert rows(table.read("t")) == [("a", 1, 1), ("b", 2, 1), ("c", 3, 1)]
    merge_upsert(table, "t", df(spark, ("a", 9, 0)), ["k"])
    assert rows(table.read("t"))[0] == ("a", 9, 0)


def test_forward_only(spark, table, rows):
    merge_forward_only(table, "t", df(spark, ("a", 7, 1), ("b", 8, 2)), ["k"], "seq")
    assert rows(table.read("t")) == [("a", 1, 1), ("b", 8, 2)]


def test_delete_missing_and_set_values(spark, table, rows):
    table.merge("t", df(spark, ("a", 5, 5)), ["k"], delete_missing=True, set_values={"v": lambda t, s: t("v") + s("v")})
    assert rows(table.read("t")) == [("a", 6, 1)]


def test_null_keys_match_nothing_and_double_keys_are_refused(spark, table, rows):
    merge_upsert(table, "t", df(spark, (None, 1, 1), (None, 2, 2)), ["k"])
    merge_upsert(table, "t", df(spark, (None, 3, 3)), ["k"])
    assert [r for r in rows(table.read("t")) if r[0] is None] == [(None, 1, 1), (None, 2, 2), (None, 3, 3)]
    with pytest.raises(DuplicateKeys):
        merge_upsert(table, "t", df(spark, ("a", 1, 1), ("a", 1, 1)), ["k"])


def test_hash_guard_and_new_columns(spark, store, rows):
    schema = "k string, v int, row_hash string"
    store.ensure("t", df(spark, schema=schema).schema, ["k"])
    merge_hash_guarded(store, "t", df(spark, ("a", 1, "h1"), ("b", 2, "h2"), schema=schema), ["k"])
    merge_hash_guarded(store, "t", df(spark, ("a", 9, "h1"), ("b", 9, "x"), schema=schema), ["k"])
    assert rows(store.read("t"), "k", "v") == [("a", 1), ("b", 9)]
    merge_hash_guarded(store, "t", df(spark, ("a", 1, "h1", 5.0), schema=schema + ", score double"), ["k"])
    assert rows(store.read("t"), "k", "score") == [("a", 5.0), ("b", None)]
    assert "score" not in store.read("t", 1).columns


def test_change_feed(spark, table, rows):
    merge_upsert(table, "t", df(spark, ("a", 5, 2), ("c", 3, 1)), ["k"])
    table.merge("t", df(spark, ("a", 5, 2)), ["k"], update=False, insert=False, delete_missing=True)
    got = rows(table.changes("t", 1, 3), "_commit_version", "_change_type", "k", "v")
    assert got == [(2, "insert", "c", 3), (2, "update_postimage", "a", 5), (2, "update_preimage", "a", 1), (3, "delete", "b", 2), (3, "delete", "c", 3)]
    assert rows(table.changes("t", 3, 3)) == []
    assert [(r["version"], r["operation"]) for r in table.history("t").orderBy("version").collect()] == [(0, "create"), (1, "merge"), (2, "merge"), (3, "merge")]
    table.overwrite("t", df(spark, ("z", 1, 1)))
    with pytest.raises(ChangesUnavailable):
        table.changes("t", 3, 4)
    assert not table.readable_changes("t", 3, 4)


def test_replayed_batches_add_nothing(spark, store, rows):
    for n in (0, 0, 1, 1, 0):
        store.append("log", df(spark, ("a", n, 1)), txn=("w", n))
    assert rows(store.read("log"), "v") == [(0,), (1,)]


def test_update_properties_vacuum_and_conflict(spark, table, rows, monkeypatch):
    table.update("t", F.col("v") > 1, seq=F.lit(7))
    assert rows(table.read("t")) == [("a", 1, 1), ("b", 2, 7)]
    table.set_properties("t", owner="me")
    assert table.properties("t") == {"owner": "me"}
    assert table.vacuum("t") == 1 and rows(table.read("t")) == [("a", 1, 1), ("b", 2, 7)]
    assert not table.readable_changes("t", 0, 1)
    stale = table._record("t", 1)
    monkeypatch.setattr(table, "_record", lambda name, version=None: stale)
    with pytest.raises(ConcurrentCommit):
        table.append("t", df(spark, ("q", 1, 1)))


def test_empty_sources(spark, table, rows):
    merge_upsert(table, "t", df(spark), ["k"])
    merge_insert_new(table, "t", df(spark), ["k"])
    assert len(rows(table.read("t"))) == 2


def test_a_writer_that_loses_leaves_the_winners_rows(spark, store, rows, monkeypatch):
    """Two writers start from one version, in either way of writing; the first to commit stands, in full."""
    first = df(spark, ("a", 1, 1), ("b", 2, 1))
    store.ensure("t", first.schema, ["k"], 4)
    merge_upsert(store, "t", first, ["k"])
    for write in (lambda s: s.append("t", df(spark, ("q", 99, 1))), lambda s: merge_upsert(s, "t", df(spark, ("a", 99, 9)), ["k"]), lambda s: s.overwrite("t", df(spark, ("z", 99, 1)))):
        late, stale = Store(spark, store.root), store._record("t")
        merge_upsert(store, "t", df(spark, ("a", stale["version"], 9), ("c", 7, 1)), ["k"])
        want = rows(store.read("t"))
        monkeypatch.setattr(late, "_record", lambda name, version=None, stale=stale: stale)
        with pytest.raises(ConcurrentCommit):
            write(late)
        assert rows(store.read("t")) == want and rows(store.read("t").where("k = 'a'"), "v") == [(stale["version"],)]
    assert store.vacuum("t") > 0 and rows(store.read("t")) == want


def test_a_writer_that_dies_before_its_commit_or_in_it(spark, table, rows, monkeypatch, tmp_path):
    from tidemark.sources import files

    want = rows(table.read("t"))
    monkeypatch.setattr(table, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.append("t", df(spark, ("x", 1, 1)))
    monkeypatch.undo()
    assert rows(table.read("t")) == want

    def dies(spark, written, path):
        raise RuntimeError("killed")

    monkeypatch.setattr(files, "PUBLISH", {"file": dies})
    monkeypatch.setattr(files, "remove", lambda spark, path: None)
    with pytest.raises(RuntimeError):
        table.append("t", df(spark, ("y", 1, 1)))
    monkeypatch.undo()
    half = next(p for p in (tmp_path / "t" / "_log").iterdir() if p.name.startswith(".0") and not p.name.endswith(".crc"))
    half.write_text(half.read_text()[:20])  # a record half written
    assert rows(table.read("t")) == want and table.version("t") == 1
    table.append("t", df(spark, ("z", 3, 1)))
    assert rows(table.read("t")) == [*want, ("z", 3, 1)]


def test_unknown_file_systems_are_refused(spark, monkeypatch, tmp_path):
    from tidemark.sources import files

    monkeypatch.setattr(files, "PUBLISH", {})
    with pytest.raises(NotImplementedError):
        files.create_json(spark, f"file://{tmp_path}/x.json", {})


def test_compaction_keeps_rows_changes_and_versions(spark, table, rows):
    for n in range(4):
        merge_insert_new(table, "t", df(spark, *[(f"n{n}{i}", n, 1) for i in range(6)]), ["k"])
    want, before = rows(table.read("t")), table.version("t")
    assert table.compact("t", 2) == before + 1 and table.compact("t", 2) == before + 1
    assert rows(table.read("t")) == want and all(len(p) <= 2 for p in table._record("t")["parts"].values())
    assert rows(table.changes("t", before, before + 1)) == [] and table.readable_changes("t", before, before + 1)
    merge_upsert(table, "t", df(spark, ("n00", 50, 2)), ["k"])
    assert len(rows(table.read("t"))) == len(want) and rows(table.read("t", before)) == want
