import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"
SIZES = "doc_id bigint, source string, n_tokens bigint"


def sizes(spark, counts):
    """counts: documents per source; sizes vary from 1 to 40 tokens."""
    out = [(i + 1000 * k, s, 1 + (i * 7) % 40) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    return spark.createDataFrame(out, SIZES)


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), TARGETS)


@pytest.mark.parametrize("schedule", [[(0, 1), (1, 1)], mixing.RISING, mixing.FALLING, [(0, 0), (0.3, 2), (1, 0)], [(0, 5), (0.5, 0), (1, 0)]])
def test_due_inverts_the_integral(spark, schedule):
    shares = [i / 50 for i in range(51)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.due(F.col("s"), mixing._segments_column(schedule))).collect()]

    def integral(t):
        return sum(w * min(max(t - a, 0), b - a) + s * min(max(t - a, 0), b - a) ** 2 / 2 for (a, w, s, _), b in zip(pieces, ends))

    pieces = mixing.segments(schedule)
    ends = [*(p[0] for p in pieces[1:]), 1.0]
    assert all(abs(integral(t) - s) < 1e-6 for s, t in zip(shares, got)) and got == sorted(got)


def test_shares_caps_and_order(spark):
    s = sizes(spark, {"big": 400, "small": 40, "mid": 150})
    t = targets(spark, ("big", 0.5, 1), ("small", 0.2, 4), ("mid", 0.3, 2), ("absent", 0.1, 3), (None, 0.1, 1))
    out = mixing.mix(s, t)
    rows = out.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    cap = {"big": 1, "small": 4, "mid": 2}
    assert all(1 <= r["copy"] <= cap[r["source"]] for r in rows)
    got = {r["source"]: r for r in mixing.shares(out, t).collect()}
    for name, share in (("big", 0.5), ("small", 0.2), ("mid", 0.3)):
        assert abs(got[name]["actual_share"] - share) < 0.02
    assert got["absent"]["actual_share"] == 0 and got["small"]["most_used"] == 4 and None not in got
    held = {r["source"]: r["n"] for r in s.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got["small"]["tokens"] == 4 * held["small"]  # the source that bounds the mix is used up


def test_copies_come_in_turn_and_weights_move(spark):
    s = sizes(spark, {"a": 300, "b": 30})
    rows = mixing.mix(s, targets(spark, ("a", 0.8, 1), ("b", 0.2, 3))).collect()
    first = {}
    for r in rows:
        if r["source"] == "b":
            assert first.get(r["doc_id"], 0) == r["copy"] - 1
            first[r["doc_id"]] = r["copy"]
    half = lambda name, late: sum(r["n_tokens"] for r in rows if r["source"] == name and (r["position"] >= 0.5) == late)
    assert half("b", True) > 1.2 * half("b", False) and half("a", False) > 1.2 * half("a", True)


def test_against_a_plain_running_total(spark):
    s = sizes(spark, {"a": 120, "b": 35})
    t = targets(spark, ("a", 0.6, 1), ("b", 0.4, 2))
    want = {r["source"]: r for r in mixing.demands(s, t).collect()}
    order = s.withColumn("h", F.xxhash64(F.lit(0), "doc_id")).orderBy("h", "doc_id").collect()
    expected = set()
    for name, w in want.items():
        done = 0
        for copy in range(1, w["max_repeats"] + 1):
            for r in order:
                if r["source"] == name:
                    if done + r["n_tokens"] / 2 <= w["demand"]:
                        expected.add((r["doc_id"], copy))
                    done += r["n_tokens"]
    assert {(r["doc_id"], r["copy"]) for r in mixing.mix(s, t).collect()} == expected


def test_a_larger_total_falls_short_and_says_so(spark):
    s = sizes(spark, {"a": 200, "b": 10})
    t = targets(spark, ("a", 0.5, 1), ("b", 0.5, 2))
    total = 2 * s.where("source = 'a'").agg(F.sum("n_tokens")).first()[0]
    got = {r["source"]: r["actual_share"] for r in mixing.shares(mixing.mix(s, t, total_tokens=total), t).collect()}
    assert got["b"] < 0.1 and abs(sum(got.values()) - 1) < 1e-9


def test_nulls_empties_repeats_and_no_documents(spark):
    documents = spark.createDataFrame([(1, "a", "some words here"), (2, "a", ""), (3, "a", None), (4, None, "x"), (5, "z", "x"), (1, "a", "some words here")], "doc_id bigint, source string, text string")
    t = targets(spark, ("a", 1.0, None))
    s = mixing.sized(documents, t)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in s.collect()) == [(1, 3), (1, 3), (2, 0), (3, 0)]
    assert [r["doc_id"] for r in mixing.mix(s, t).collect()] == [1, 1]
    assert mixing.mix(s.limit(0), t).count() == 0
    assert [r["actual_share"] for r in mixing.shares(mixing.mix(s.limit(0), t), t).collect()] == [0]
    with pytest.raises(ValueError):
        mixing.segments([(0.2, 1), (1, 1)])


def test_a_source_that_may_not_be_used_leaves_the_others_whole(spark):
    s = sizes(spark, {"a": 120, "b": 60, "never": 50})
    t = targets(spark, ("a", 0.5, 1), ("b", 0.3, 1), ("never", 0.2, 0))
    got = {r["source"]: r for r in mixing.shares(mixing.mix(s, t), t).collect()}
    without = {r["source"]: r for r in mixing.shares(mixing.mix(s, t.where("max_repeats > 0")), t.where("max_repeats > 0")).collect()}
    assert got["never"]["tokens"] == 0 and got["never"]["actual_share"] == 0
    assert got["a"]["tokens"] == without["a"]["tokens"] > 0 and got["b"]["tokens"] == without["b"]["tokens"] > 0
    only = targets(spark, ("never", 1.0, 0))
    assert mixing.mix(s, only).count() == 0 and mixing.shares(mixing.mix(s, only), only).first()["actual_share"] == 0
