import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incremental, replay, star
from tidemark.sources.store import Store, merge_insert_new

C = "order_id string, customer_id string, order_status string, order_purchase_ts timestamp, order_approved_ts timestamp, order_delivered_carrier_ts timestamp, order_delivered_customer_ts timestamp, order_estimated_delivery_ts timestamp, change_seq int, change_ts timestamp"
OPEN = ["created", "approved", "shipped"]


def ts(day, hour=0):
    return dt.datetime(2024, 6, day, hour)


def changes(spark, *data):
    return spark.createDataFrame(list(data), C)


def none(spark, ddl):
    return spark.createDataFrame([], ddl)


ITEMS, CUSTOMERS = "order_id string, price decimal(12,2)", "customer_id string, customer_unique_id string, customer_state string"


def test_fulfillment_of_one_order(spark):
    row = ("o", "c", "delivered", ts(1, 10), ts(1, 12), ts(2, 10), ts(5, 22), ts(5), 4, ts(5, 22))
    odd = ("p", None, "shipped", ts(2), ts(2), ts(1), None, ts(9), 2, ts(2))
    ended = [("q", "d", s, ts(1), None, None, None, None, n, ts(n)) for n, s in ((1, "created"), (2, "canceled"), (3, "unavailable"))]
    scores = spark.createDataFrame([("o", 4), ("o", 5)], "order_id string, score int")
    got = {r["order_id"]: r for r in star.fulfillment_fact(changes(spark, row, odd, *ended), spark.createDataFrame([("o", Decimal(3))], ITEMS), none(spark, CUSTOMERS), scores, ["canceled", "unavailable"]).collect()}
    o = got["o"]
    assert [o[f"hours_{x}"] for x in ("to_approve", "to_ship", "in_transit", "total")] == [2, 22, 84, 108] and o["hours_late"] == -2 and o["is_on_time"]
    assert (o["item_count"], o["review_score"], o["review_count"], o["delivered_date_key"]) == (1, 4.5, 2, 20240605)
    assert got["p"]["hours_to_ship"] is None and got["p"]["has_inconsistent_milestones"] and got["p"]["shipped_ts"] == ts(1) and got["p"]["delivered_date_key"] == -1
    assert (got["q"]["end_reason"], got["q"]["ended_ts"], got["q"]["current_status"]) == ("canceled", ts(2), "unavailable")


def test_backlog_day_by_day(spark, rows):
    data = [("o", "c", s, ts(1), None, None, None, ts(4), n, ts(d)) for n, (s, d) in enumerate((("created", 1), ("approved", 1), ("shipped", 3), ("delivered", 6)), 1)]
    early = ("p", None, "created", ts(5), None, None, None, None, 1, ts(2))
    fact = star.backlog_fact(changes(spark, *data, early), none(spark, ITEMS), spark.createDataFrame([("c", "u", "S")], CUSTOMERS), OPEN)
    got = rows(fact, "snapshot_date_key", "order_status", "customer_state", "open_orders", "median_age_days", "overdue_orders")
    assert got == [(20240601, "approved", "S", 1, 0, 0), (20240602, "approved", "S", 1, 1, 0), (20240603, "shipped", "S", 1, 2, 0), (20240604, "shipped", "S", 1, 3, 0), (20240605, "created", "unknown", 1, 0, 0), (20240605, "shipped", "S", 1, 4, 1), (20240606, "created", "unknown", 1, 1, 0)]


def test_a_lower_sequence_that_comes_later_does_not_turn_the_state_back(spark, rows):
    data = [("o", "c", s, ts(1), None, None, None, None, n, ts(d)) for n, s, d in ((1, "created", 1), (3, "shipped", 2), (2, "approved", 3))]
    assert rows(star.backlog_fact(changes(spark, *data), none(spark, ITEMS), none(spark, CUSTOMERS), OPEN), "snapshot_date_key", "order_status") == [(20240601, "created"), (20240602, "shipped"), (20240603, "shipped")]
    assert rows(star.backlog_fact(changes(spark), none(spark, ITEMS), none(spark, CUSTOMERS), OPEN)) == []


def fact_inputs(spark):
    items = spark.createDataFrame([(o, i, "p", s, ts(d), Decimal(p), Decimal(1), 0, "extra") for o, i, s, d, p in (("o1", 1, "s", 2, 100), ("o1", 2, "s", 2, 30), ("o2", 1, "s", 8, 50), ("o3", 1, "t", 8, 7))], "order_id string, order_item_id int, product_id string, seller_id string, order_purchase_ts timestamp, price decimal(12,2), freight_value decimal(12,2), arrival_lag_days int, customer_id string")
    orders = changes(spark, ("o1", "c1", "delivered", ts(2), None, None, ts(4), ts(4, 9), 1, ts(4)), ("o2", "c2", "canceled", ts(8), None, None, None, ts(9), 1, ts(8)))
    customers = spark.createDataFrame([("c1", "u", "S")], CUSTOMERS)
    sellers = spark.createDataFrame([("s", 1, dt.date(1900, 1, 1), dt.date(2024, 6, 5), "SP", False, "x"), ("s", 2, dt.date(2024, 6, 5), None, "PR", True, "y")], "seller_id string, seller_sk bigint, valid_from date, valid_to date, seller_state string, is_current boolean, seller_city string")
    return items, orders, customers, sellers


def test_item_fact_point_in_time_and_unknown_orders(spark, rows):
    fact = star.item_fact(*fact_inputs(spark), ["canceled"], rows_per_task=1)
    assert rows(fact, "order_id", "order_item_id", "seller_sk", "order_status", "is_cancelled", "is_delivered", "is_on_time", "customer_unique_id") == [
        ("o1", 1, 1, "delivered", False, True, True, "u"), ("o1", 2, 1, "delivered", False, True, True, "u"), ("o2", 1, 2, "canceled", True, False, None, None), ("o3", 1, None, "unknown", None, False, None, None)]


def test_mart_weighs_orders_once_and_leaves_canceled_money_out(spark, rows):
    items, orders, customers, sellers = fact_inputs(spark)
    scores = spark.createDataFrame([("o1", 4), ("o1", 5), ("o2", 1)], "order_id string, score int")
    got = rows(star.seller_mart(star.item_fact(items, orders, customers, sellers, ["canceled"]), scores, sellers), "seller_id", "seller_state", "orders", "gmv", "items", "on_time_rate", "avg_review_score")
    assert got == [("s", "PR", 1, Decimal("130.00"), 2, 1.0, 2.75), ("t", None, 1, Decimal("7.00"), 1, None, None)]


def test_dimensions(spark, rows):
    d = star.date_dimension(spark, dt.date(2024, 6, 1), dt.date(2024, 6, 3))
    assert rows(d, "date_key", "day_of_week", "is_weekend") == [(-1, None, None), (20240601, 7, True), (20240602, 1, True), (20240603, 2, False)]
    customers = spark.createDataFrame([("c1", "u", "A"), ("c2", "u", "B"), ("c3", "v", "C"), ("c4", None, "D")], CUSTOMERS)
    orders = spark.createDataFrame([("c1", ts(1)), ("c2", ts(2))], "customer_id string, order_purchase_ts timestamp")
    assert rows(star.person_dimension(customers, orders, "customer_unique_id", "customer_id", ["customer_state"], "order_purchase_ts")) == [("u", "B", 2, ts(1)), ("v", "C", 1, None)]


def test_refresh_plans_and_equals_full(spark, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    df = lambda *x: spark.createDataFrame(list(x), "id string, n int, v int")
    store.ensure("src", df().schema, ["id", "n"], 4)
    fail = []

    def build(ids):
        if fail:
            raise RuntimeError("no")
        out = incremental.only(store.read("src"), ids).groupBy("id").agg(F.sum("v").alias("total"))
        out = out.withColumn("row_hash", star.row_hash(out, ["id"]))
        store.ensure("out", out.schema, ["id"], 4)
        store.merge("out", out, ["id"])

    run = lambda **k: incremental.refresh(store, "out", ["src"], {"src": lambda c: c.select("id")}, build, **k)
    merge_insert_new(store, "src", df(("a", 1, 1), ("b", 1, 2)), ["id", "n"])
    assert run().mode == "full"
    merge_insert_new(store, "src", df(("a", 2, 5), ("c", 1, 3)), ["id", "n"])
    fail.append(1)
    with pytest.raises(RuntimeError):
        run()
    fail.clear()
    p = run()
    assert p.mode == "incremental" and rows(store.read("out"), "id", "total") == [("a", 6), ("b", 2), ("c", 3)]
    assert rows(store.read(incremental.STATS), "mode", "changed_ids") == [("full", -1), ("incremental", 2)]
    before = store.version("out")
    assert run().mode == "incremental" and store.version("out") == before
    assert run(full=True).reason == "asked for"
    store.overwrite("src", df(("z", 1, 1)))
    assert run().mode == "full" and incremental.watermarks(store, "out") == {"src": store.version("src")}


def test_lifecycle_shows_only_what_has_happened(spark, rows):
    orders = spark.createDataFrame([("o", "canceled", ts(1), ts(2), None), ("p", "shipped", ts(1), ts(1), ts(3)), ("q", "x", None, None, None)], "order_id string, final string, a timestamp, b timestamp, c timestamp")
    got = rows(replay.lifecycle(orders, "order_id", [("a", "created"), ("b", "approved"), ("c", "shipped")], "final"), "order_id", "change_seq", "change_ts", "state", "b", "c")
    assert got == [("o", 1, ts(1), "created", None, None), ("o", 2, ts(2), "approved", ts(2), None), ("o", 3, ts(2, 1), "canceled", ts(2), None), ("p", 1, ts(1), "created", ts(1), None), ("p", 2, ts(1), "approved", ts(1), None), ("p", 3, ts(3), "shipped", ts(1), ts(3))]


def test_faults_are_counted_and_stay_in_the_window(spark):
    first, last = dt.date(2024, 6, 1), dt.date(2024, 6, 10)
    data = spark.range(20_000).select("id", F.lit("p").alias("product"), F.date_add(F.lit(first), (F.col("id") % 10).cast("int")).alias("day"))
    faults = [replay.Fault("again", 0, 1000, repeat=0), replay.Fault("next", 1000, 2000, repeat=1), replay.Fault("late", 2000, 3000, delay=5), replay.Fault("gone", 3000, 4000, values=(("product", F.lit(None).cast("string")),))]
    out = replay.inject(data, ["id"], "day", faults, last, first).cache()
    n = {r["_fault"]: r["n"] for r in out.groupBy("_fault").agg(F.count("*").alias("n")).collect()}
    assert out.count() == 20_000 + n["again"] + n["next"] and out.where("product IS NULL").count() == n["gone"]
    assert out.agg(F.max("day")).first()[0] == last and out.where(F.col("day") == F.lit(first)).where("_fault IS NOT NULL").count() == 0
    assert 0.05 * 18_000 < n["again"] < 0.15 * 18_000
    m = replay.manifest(out, "items", "day").collect()
    assert sum(r["row_count"] for r in m) == out.count() and sum(v for r in m for k, v in r["injected"].items() if k == "late") == n["late"]
    with pytest.raises(ValueError):
        replay.inject(data, ["id"], "day", [replay.Fault("a", 0, 10), replay.Fault("b", 5, 20)], last, first)
    days = [dt.date(2024, 6, d) for d in (2, 3)]
    moved = replay.relocated(data.select(F.col("id").cast("string").alias("k"), "day", F.lit("here").alias("city")), "k", "day", days, {"city": ["there", "here"]}, part=5000)
    assert 0 < moved.where("city = 'there'").count() < 10_000
