import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators.quality import GateError
from tidemark.sources import landing
from tidemark.sources.contracts import CONTRACTS, parse_lines
from tidemark.streaming.pipeline import METRICS, QUARANTINE, Config, Pipeline

DAYS = [dt.date(2024, 3, 31), dt.date(2024, 4, 1), dt.date(2024, 4, 2)]


def test_every_outcome_of_a_line(spark):
    schema = CONTRACTS["order_items"].schema
    good = {"order_id": "o", "order_item_id": 1, "price": 1.5, "order_purchase_ts": "2024-04-01T10:00:00"}
    lines = [json.dumps(good), json.dumps(good | {"gift": True, "z": {"a": 1}}), json.dumps(good | {"price": "abc"}), json.dumps(good | {"order_item_id": 2.5, "seller_id": None}), "not json", "[1,2]", "123", "null", "", None]
    got = parse_lines(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string"), schema).orderBy("i").collect()
    assert [r["_malformed"] for r in got] == [False] * 4 + [True] * 6
    assert got[0]["price"] == Decimal("1.50") and got[0]["_rescued_data"] is None and got[0]["_raw"] is None
    assert json.loads(got[1]["_rescued_data"]) == {"gift": "true", "z": '{"a":1}'}
    assert got[2]["price"] is None and got[2]["order_id"] == "o" and json.loads(got[2]["_rescued_data"]) == {"price": "abc"}
    assert got[3]["order_item_id"] is None and json.loads(got[3]["_rescued_data"]) == {"order_item_id": "2.5"}
    assert got[4]["_raw"] == "not json" and got[4]["order_id"] is None and got[9]["_raw"] is None


def test_paths_csv_and_calendar(spark, tmp_path, rows):
    paths = spark.createDataFrame([("x/batch_date=2024-03-31/feed0007-1.json",), ("x/batch_date=2024-13-31/y.json",), ("x/y",), (None,)], "p string")
    assert [tuple(r) for r in paths.select(landing.batch_date_of(F.col("p")), landing.feed_of(F.col("p"))).collect()] == [(DAYS[0], "feed0007"), (None, None), (None, None), (None, None)]
    (tmp_path / "a.csv").write_text('﻿name,note\nx,"two\nlines, ""quoted"""\ny,\n', encoding="utf-8")
    got = landing.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert got.columns == ["name", "note"] and rows(got) == [("x", 'two\nlines, "quoted"'), ("y", None)]
    assert landing.calendar(spark, DAYS[0], DAYS[2]).count() == 3


def deliver(spark, base, day, items=(), orders=(), customers=(), sellers=(), products=()):
    for name, data in (("order_items", items), ("orders_cdc", orders), ("customers", customers), ("sellers", sellers), ("products", products)):
        c = CONTRACTS[name]
        if data:
            full = [tuple(r) + (None,) * (len(c.columns) - len(r)) for r in data]
            landing.drop(spark.createDataFrame(full, c.schema), f"{base}/landing/{name}", day, c.fmt, seed=1)


def item(order, n, product, day, price=10):
    return (order, n, product, "s", dt.datetime.combine(day, dt.time(9)), None, Decimal(price), Decimal(1))


def order(o, status, seq, day):
    return (o, f"c-{o}", status, dt.datetime(2024, 3, 30), None, None, None, None, seq, dt.datetime.combine(day, dt.time(seq)))


def test_daily_runs_end_to_end(spark, tmp_path, rows):
    base = f"file://{tmp_path}"
    p = Pipeline(spark, Config(base, DAYS[0], max_bad_ratio=0.4, buckets=2))
    deliver(spark, base, DAYS[0], [item("o1", 1, "p", DAYS[0]), item("o1", 1, "p", DAYS[0]), item("o2", 1, "p", DAYS[0]), item("o3", 1, "nope", DAYS[0])], [order("o1", "created", 1, DAYS[0]), order("o1", "shipped", 2, DAYS[0])], [("c-o1", "u", "1", "A", "X")], [("s", "1", "A", "X")], [("p", "cat", "cat", 1, 1)])
    p.run()
    assert rows(p.store.read("silver.order_items"), "order_id", "arrival_lag_days") == [("o1", 0), ("o2", 0)]
    assert rows(p.store.read("silver.orders"), "order_id", "order_status") == [("o1", "shipped")]
    assert rows(p.store.read(QUARANTINE), "failed_rules") == [(["unknown_product_id"],)]
    assert rows(p.store.read("gold.fact_order_item"), "order_id", "order_status", "customer_unique_id") == [("o1", "shipped", "u"), ("o2", "unknown", None)]

    versions = {t: p.store.version(t) for t in ("silver.order_items", "silver.orders", METRICS, "gold.fact_order_item")}
    p.run()  # nothing new: no table moves
    assert versions == {t: p.store.version(t) for t in versions}

    deliver(spark, base, DAYS[1], [item("o1", 1, "p", DAYS[0], 99), item("o4", 1, "p", DAYS[0]), item("o5", 1, "p", dt.date(2024, 3, 20))], [order("o1", "approved", 1, DAYS[0]), order("o2", "created", 1, DAYS[1])], [("c-o2", "v", "1", "A", "X")], [("s", "1", "B", "X")])
    p.run()
    assert rows(p.store.read("silver.order_items"), "order_id", "price", "arrival_lag_days") == [("o1", Decimal("10.00"), 0), ("o2", Decimal("10.00"), 0), ("o4", Decimal("10.00"), 1)]
    assert rows(p.store.read("silver.orders"), "order_id", "order_status") == [("o1", "shipped"), ("o2", "created")]
    assert rows(p.store.read("silver.order_changes"), "order_id", "change_seq", "order_status") == [("o1", 1, "created"), ("o1", 2, "shipped"), ("o2", 1, "created")]
    assert rows(p.store.read("silver.seller_history"), "seller_city", "valid_to") == [("A", DAYS[1]), ("B", None)]
    incremental = p.store.read("gold.fact_order_item").drop("row_hash")
    before = rows(incremental)
    assert cli.main(["gold", "--base", base, "--full", "--buckets", "2"], spark) == 0
    assert rows(p.store.read("gold.fact_order_item").drop("row_hash")) == before
    assert rows(p.store.read("gold.fact_order_item"), "order_id", "order_status") == [("o1", "shipped"), ("o2", "created"), ("o4", "unknown")]

    gold = p.store.version("gold.fact_order_item")
    deliver(spark, base, DAYS[2], [item("o6", 1, "bad", DAYS[2]), item("o7", 1, "bad", DAYS[2]), item("o8", 1, "p", DAYS[2])])
    with pytest.raises(GateError):
        p.run()
    assert p.store.version("gold.fact_order_item") == gold
    assert cli.main(["gate", "--base", base, "--max-bad-ratio", "0.1"], spark) == 2


def test_next_snapshot(spark, tmp_path):
    base = f"file://{tmp_path}"
    for d in DAYS:
        deliver(spark, base, d, sellers=[("s", "1", "A", "X")])
    at = f"{base}/landing/sellers"
    assert [landing.next_snapshot(spark, at, d) for d in (None, DAYS[0], DAYS[1], DAYS[2])] == [*DAYS, None]
    assert landing.next_snapshot(spark, f"{base}/none", None) is None
