"""A deleted order is gone: its latest change decides, deletes too."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tests.test_landing_pipeline import DAYS, deliver, item
from tests.test_star_refresh_replay import CUSTOMERS, ITEMS, OPEN, C, none, ts
from tidemark.operators import star
from tidemark.plans import domain
from tidemark.sources.contracts import CONTRACTS
from tidemark.sources.store import Store
from tidemark.streaming.pipeline import Config, Pipeline


def changes(spark, *data):
    return spark.createDataFrame([(o, "c" if op != "D" else None, s, ts(1), None, None, None, ts(9), n, ts(d), op) for o, s, n, d, op in data], C + ", _op string")


GONE = [("gone", "created", 1, 1, "I"), ("gone", "canceled", 2, 2, "U"), ("gone", None, 3, 3, "D")]
BACK = [("back", "created", 1, 1, "I"), ("back", None, 2, 2, "D"), ("back", "shipped", 3, 3, "U")]


def test_orders_and_merge_leave_deleted_orders_out(spark, tmp_path, rows):
    lineage = {"_batch_date": F.when(F.col("change_seq") > 2, dt.date(2024, 6, 3)).otherwise(dt.date(2024, 3, 31)), "_ingested_at": F.lit(ts(3)), "_source_file": F.lit("f")}
    changes(spark, *GONE, *BACK).withColumns(lineage).write.parquet(f"{tmp_path}/orders_cdc.parquet")
    assert rows(domain.slv_orders(spark, str(tmp_path)), "order_id", "order_status") == [("back", "shipped")]
    assert rows(domain.mrg_forward_only(spark, str(tmp_path))) == [("back", 3, "shipped")]
    assert rows(domain.slv_changes(spark, str(tmp_path)), "order_id", "change_seq") == [("back", 1), ("back", 3), ("gone", 1), ("gone", 2)]


def test_facts_leave_deleted_orders_out(spark, rows):
    log = changes(spark, *GONE, *BACK)
    made = star.fulfillment_fact(log, none(spark, ITEMS), none(spark, CUSTOMERS), None, ["canceled"])
    assert rows(made, "order_id", "current_status", "end_reason", "last_change_seq") == [("back", "shipped", None, 3)]
    items = spark.createDataFrame([(o, 1, "p", "s", ts(1), Decimal(1), Decimal(1), 0) for o in ("gone", "back", "new")], "order_id string, order_item_id int, product_id string, seller_id string, order_purchase_ts timestamp, price decimal(12,2), freight_value decimal(12,2), arrival_lag_days int")
    sellers = none(spark, "seller_id string, seller_sk bigint, valid_from date, valid_to date")
    assert rows(star.item_fact(items, log.where("change_seq = 3"), none(spark, CUSTOMERS), sellers, ["canceled"]), "order_id", "order_status") == [("back", "shipped"), ("new", "unknown")]


def test_a_delete_ends_the_backlog(spark, rows):
    log = [("o", "created", 1, 1, "I"), ("o", None, 2, 3, "D"), ("late", "created", 1, 1, "I"), ("late", "shipped", 3, 2, "U"), ("late", None, 2, 3, "D"), ("end", "delivered", 1, 4, "I")]
    got = rows(star.backlog_fact(changes(spark, *log), none(spark, ITEMS), spark.createDataFrame([("c", "u", "S")], CUSTOMERS), OPEN), "snapshot_date_key", "order_status", "customer_state", "open_orders")
    assert got == [(20240601, "created", "S", 2), (20240602, "created", "S", 1), (20240602, "shipped", "S", 1), (20240603, "shipped", "S", 1), (20240604, "shipped", "S", 1)]


def change(o, status, seq, op):
    return (o, f"c-{o}", status, dt.datetime(2024, 3, 30), None, None, None, None, seq, dt.datetime.combine(DAYS[0], dt.time(seq)), op)


def test_pipeline_applies_deletes(spark, tmp_path, rows):
    base = f"file://{tmp_path}"
    p = Pipeline(spark, Config(base, DAYS[0], buckets=2))
    assert CONTRACTS["orders_cdc"].columns[-1] == "_op"
    deliver(spark, base, DAYS[0], [item("o1", 1, "p", DAYS[0]), item("o2", 1, "p", DAYS[0])], [change("o1", "created", 1, "insert"), change("o2", "created", 1, "I")], [("c-o1", "u", "1", "A", "X")], [("s", "1", "A", "X")], [("p", "cat", "cat", 1, 1)])
    p.run()
    assert rows(p.store.read("gold.fact_order_item"), "order_id") == [("o1",), ("o2",)]
    deliver(spark, base, DAYS[1], orders=[change("o1", None, 3, "DELETE")])
    p.run()
    deliver(spark, base, DAYS[2], orders=[change("o1", "shipped", 2, "update")])  # comes late: the order stays deleted
    p.run()
    assert rows(p.orders(), "order_id") == [("o2",)]
    assert rows(p.store.read("gold.fact_order_item"), "order_id") == [("o2",)]


def test_delete_and_its_change_feed(spark, tmp_path, rows):
    store = Store(spark, f"file://{tmp_path}")
    rows_ = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    store.ensure("t", rows_.schema, ["k"], 2)
    store.append("t", rows_)
    store.delete("t", spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "k string"))
    assert rows(store.read("t")) == [(None, 3), ("b", 2)]
    assert rows(store.changes("t", 1, 2), "k", "v", "_change_type") == [("a", 1, "delete")]
