import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators.once import deliver_once

SCHEMA = "order_id string, order_item_id int, note string, _batch_date date, _ingested_at timestamp, _source_file string"
KEYS = ["order_id", "order_item_id"]
D = [dt.date(2024, 4, d) for d in (1, 2, 3)]
T = [dt.datetime(2024, 4, d, 2) for d in (1, 2, 3)]


def test_first_and_last_delivery(spark, rows):
    df = spark.createDataFrame([("a", 1, "old", D[0], T[0], "f1"), ("a", 1, "new", D[1], T[0], "f0"), ("a", 2, "x", D[0], T[0], "f1")], SCHEMA)
    assert rows(deliver_once(df, KEYS), "order_id", "order_item_id", "note") == [("a", 1, "old"), ("a", 2, "x")]
    assert rows(deliver_once(df, KEYS, first=False), "order_id", "order_item_id", "note") == [("a", 1, "new"), ("a", 2, "x")]
    assert rows(deliver_once(df, KEYS, copies="n"), "order_item_id", "n") == [(1, 2), (2, 1)]


def test_null_keys_and_null_delivery(spark, rows):
    df = spark.createDataFrame([(None, 1, "x", D[0], T[0], "f"), ("a", None, "x", D[0], T[0], "f"), ("a", 1, "dated", D[0], T[0], "f"), ("a", 1, "undated", None, None, None)], SCHEMA)
    assert rows(deliver_once(df, KEYS), *KEYS, "note") == [("a", 1, "dated")]
    assert rows(deliver_once(df, KEYS, first=False), *KEYS, "note") == [("a", 1, "dated")]


def test_ties_are_settled_alike_in_any_order(spark, rows):
    same = [("a", 1, n, D[0], T[0], "f") for n in ("x", "y", None, "")]
    once = rows(deliver_once(spark.createDataFrame(same, SCHEMA), KEYS))
    again = rows(deliver_once(spark.createDataFrame(same[::-1], SCHEMA).repartition(3), KEYS))
    assert once == again and len(once) == 1


def test_empty_only_keys_and_clashing_names(spark, rows):
    assert rows(deliver_once(spark.createDataFrame([], SCHEMA), KEYS)) == []
    only = spark.createDataFrame([("a", 1), ("a", 1)], "order_id string, order_item_id int")
    assert rows(deliver_once(only, KEYS, copies="n")) == [("a", 1, 2)]
    odd = spark.createDataFrame([("a", 1, 5, 6, {"k": "v"})], "order_id string, order_item_id int, _kept int, `a.b` int, m map<string,string>")
    got = deliver_once(odd, KEYS)
    assert got.columns == odd.columns and got.first()["_kept"] == 5 and got.first()["a.b"] == 6


def test_partial_aggregation_precedes_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "x", D[0], T[0], "f")] * 10, SCHEMA)
    plan = deliver_once(df, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") >= 1 and plan.count("Exchange hashpartitioning") == 1


row = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None]), st.sampled_from(["x", "y", None]), st.sampled_from([*D, None]), st.sampled_from([*T, None]), st.sampled_from(["f1", "f2", None]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=25))
def test_against_brute_force(spark, data):
    last = lambda x: (x is None, x if x is not None else 0)
    order = lambda r: (last(r[3]), last(r[4]), (r[5] is None, r[5] or ""))
    best = {}
    for r in data:
        if r[0] is not None and r[1] is not None:
            best[r[:2]] = min(best.get(r[:2], order(r)), order(r))
    got = {(r[0], r[1]): order(tuple(r)) for r in deliver_once(spark.createDataFrame(data, SCHEMA), KEYS).collect()}
    assert got == best
    assert pytest.approx(len(got)) == len(best)
