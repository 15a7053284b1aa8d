import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import quality, reconcile
from tidemark.operators.skew import hot_keys, salted_join

D = [dt.date(2024, 4, d) for d in (1, 2, 9)]
SCHEMA = "k string, price int, at timestamp, _malformed boolean, _rescued_data string, _raw string, _source_file string, _batch_date date"


def items(spark):
    t = dt.datetime(2024, 4, 1, 12)
    return spark.createDataFrame([
        ("a", 5, t, False, None, None, "f", D[0]), (None, -1, t, False, '{"x":"1"}', None, "f", D[0]), ("b", None, t, False, None, None, "f", D[0]),
        ("c", 1, t, False, None, None, "f", D[1]), ("c", 1, t, False, None, None, "f", D[1]), ("c", 1, t, False, None, None, "f", D[2]), (None, None, None, True, None, "junk", "f", D[2]),
    ], SCHEMA)


def rules():
    return [*quality.key_rules("k"), quality.Rule("not_positive", F.col("price") <= 0), quality.lateness_rule("at", 3, dt.date(2024, 3, 31))]


def test_every_broken_rule_in_order_and_null_passes(spark):
    got = [r["_failed_rules"] for r in quality.evaluate(items(spark), rules()).collect()]
    assert got == [[], ["missing_key", "not_positive"], [], [], [], ["too_late"], ["malformed_record", "missing_key"]]
    assert quality.evaluate(items(spark), []).where(F.size("_failed_rules") > 0).count() == 0


def test_metrics_count_a_row_once(spark):
    found = {(str(r["batch_date"]), r["rule"]): (r["failed_rows"], r["total_rows"]) for r in quality.metrics(quality.evaluate(items(spark), rules()), rules(), "t").collect()}
    assert found["2024-04-01", "__all__"] == (1, 3) and found["2024-04-01", "missing_key"] == (1, 3) and found["2024-04-02", "too_late"] == (0, 2) and found["2024-04-01", "rescued_data"] == (1, 3)
    assert len(found) == 3 * 6
    fired = quality.fired(quality.metrics(quality.evaluate(items(spark), rules()), rules(), "t"))
    assert fired.where("failed_rows = 0 AND rule NOT IN ('__all__', 'rescued_data')").count() == 0


def test_quarantine_split_and_duplicates(spark, rows):
    seen = quality.evaluate(items(spark), rules())
    good, bad = quality.split(seen)
    assert good.count() + bad.count() == seen.count() and "_failed_rules" not in good.columns
    assert rows(quality.quarantine(seen, ["k", "price"], "t"), "record", "raw") == [("{\"k\":\"c\",\"price\":1}", None), ("{\"price\":-1}", None), ("{}", "junk")]
    assert rows(quality.duplicate_metrics(items(spark), ["k"], "t"), "batch_date", "rule", "failed_rows") == [(D[0], "duplicate_already_loaded", 0), (D[0], "duplicate_in_batch", 0), (D[1], "duplicate_already_loaded", 0), (D[1], "duplicate_in_batch", 1), (D[2], "duplicate_already_loaded", 1), (D[2], "duplicate_in_batch", 0)]


def test_gate_is_inclusive_and_may_look_at_the_latest_batch_only(spark, rows):
    found = spark.createDataFrame([("t", D[0], "__all__", "error", 9, 10), ("t", D[1], "__all__", "error", 1, 20), ("u", D[1], "__all__", "error", 0, 0)], "table_name string, batch_date date, rule string, severity string, failed_rows bigint, total_rows bigint")
    assert rows(quality.gate(found, 0.05, True), "table_name", "bad_ratio", "passed") == [("t", 0.05, True), ("u", 0.0, True)]
    assert rows(quality.gate(found, 0.05), "table_name", "passed") == [("t", False), ("u", True)]
    with pytest.raises(quality.GateError, match="t"):
        quality.enforce(quality.gate(found, 0.05))
    quality.enforce(quality.gate(found.limit(0), 0.05))


def test_observed_counts_and_lookup(spark, rows):
    o = Observation()
    assert quality.observe(items(spark), rules(), o).count() == 7
    assert o.get["total_rows"] == 7 and o.get["missing_key"] == 2
    known = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    flagged = quality.known_flag(items(spark).select("k").distinct(), "k", known, "known")
    assert rows(flagged) == [(None, False), ("a", True), ("b", False), ("c", False)]
    lookups = quality.evaluate(flagged, quality.lookup_rules("k", "known"))
    assert rows(lookups, "k", "_failed_rules") == [(None, ["missing_k"]), ("a", []), ("b", ["unknown_k"]), ("c", ["unknown_k"])]


def test_difference_with_and_without_copies(spark, rows):
    a, b = (spark.createDataFrame(x, "k string, v double") for x in ([("a", 1.0), ("b", None)], [("a", 1.0), ("a", 1.0), ("b", None)]))
    assert rows(reconcile.difference(a, b)) == [(0, 1)] and rows(reconcile.difference(a, b, as_set=True)) == [(0, 0)]
    assert rows(reconcile.difference(a, a.limit(0))) == [(2, 0)] and rows(reconcile.difference(a.limit(0), a.limit(0))) == [(0, 0)]
    results = reconcile.evaluate([reconcile.Check("same", a, a), reconcile.Check("other", a, b, ("k",)), reconcile.Check("filtered", a, b, where="k = 'b'")])
    assert rows(results, "check", "passed") == [("filtered", True), ("other", False), ("same", True)]
    with pytest.raises(reconcile.Unequal, match="other"):
        reconcile.enforce(results)


def test_hot_keys_are_split_and_nothing_is_lost(spark, rows):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}" if i % 2 else None) for i in range(300)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    assert rows(hot_keys(left, "k", 60)) == [("hot", 4)]
    for how in ("inner", "left"):
        assert rows(salted_join(left, right, "k", ["id"], how, rows_per_task=60), "id", "k", "v") == rows(left.join(right, "k", how), "id", "k", "v")
