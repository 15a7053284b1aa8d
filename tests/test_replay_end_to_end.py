"""A replay from raw files: what was injected is what the pipeline reports, a poisoned day alone is blocked, nothing moves on a
rerun, and what is kept equals what the whole gives."""

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import reconcile, replay
from tidemark.streaming.pipeline import GATE, METRICS, QUARANTINE, RECONCILED, Config, Pipeline
from tidemark.streaming.replayer import SOURCE_FILES

BACKFILL = dt.date(2024, 3, 31)
ORDERS = 900


def write(folder, key, columns, rows):
    with open(folder / SOURCE_FILES[key], "w", newline="", encoding="utf-8-sig" if key == "translation" else "utf-8") as f:
        csv.writer(f).writerows([columns, *rows])


def raw(folder, seed=5):
    rng = random.Random(seed)
    stamp = lambda t: t.strftime("%Y-%m-%d %H:%M:%S") if t else ""
    orders, items, customers, reviews = [], [], [], []
    for i in range(ORDERS):
        bought = dt.datetime(2024, 3, 29) + dt.timedelta(seconds=rng.randrange(7 * 86_400))
        approved = bought + dt.timedelta(minutes=rng.randrange(1, 300)) if rng.random() < 0.95 else None
        carrier = approved + dt.timedelta(hours=rng.randrange(1, 40)) if approved and rng.random() < 0.8 else None
        done = carrier + dt.timedelta(hours=rng.randrange(5, 60)) if carrier and rng.random() < 0.8 else None
        status = "delivered" if done else "shipped" if carrier else rng.choice(["approved" if approved else "created", "canceled"])
        orders.append((f"o{i}", f"c{i}", status, stamp(bought), stamp(approved), stamp(carrier), stamp(done), stamp(bought + dt.timedelta(days=9))))
        items += [(f"o{i}", n + 1, f"p{rng.randrange(30)}", f"s{rng.randrange(40)}", stamp(bought + dt.timedelta(days=2)), f"{rng.randrange(500, 9000) / 100:.2f}", "3.10") for n in range(rng.choice([1, 1, 2, 3]))]
        customers.append((f"c{i}", f"u{i // 2}", "01000", rng.choice(["a", "b"]), "SP"))
        if done:
            reviews.append((f"r{i}", f"o{i}", rng.randrange(1, 6), "", "two\nlines, \"quoted\"", stamp(done + dt.timedelta(days=1)), stamp(done + dt.timedelta(days=2))))
    write(folder, "orders", ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"], orders)
    write(folder, "items", ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"], items)
    write(folder, "customers", ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"], customers)
    write(folder, "reviews", ["review_id", "order_id", "review_score", "review_comment_title", "review_comment_message", "review_creation_date", "review_answer_timestamp"], reviews)
    write(folder, "sellers", ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"], [(f"s{i}", "02000", "x", "RJ") for i in range(40)])
    write(folder, "products", ["product_id", "product_category_name", "product_weight_g", "product_photos_qty"], [(f"p{i}", f"cat{i % 4}" if i % 5 else "", 100 + i, 2) for i in range(30)])
    write(folder, "translation", ["product_category_name", "product_category_name_english"], [(f"cat{i}", f"category {i}") for i in range(3)])


@pytest.fixture
def many_faults(monkeypatch):
    """The same faults over ranges ten times as wide, so that few rows hold some of each; sellers too."""
    wide = lambda faults, part: [replay.replace(f, first=f.first * part, end=f.end * part) for f in faults]
    monkeypatch.setattr(replay, "ITEM_FAULTS", wide(replay.ITEM_FAULTS, 2))
    monkeypatch.setattr(replay, "ORDER_FAULTS", wide(replay.ORDER_FAULTS, 10))
    monkeypatch.setattr(replay, "POISON", replay.replace(replay.POISON, first=1000, end=5000))
    moved = replay.relocated
    monkeypatch.setattr(replay, "relocated", lambda *a, **k: moved(*a, **{**k, "part": 3000}))


def test_what_is_injected_is_reported(spark, tmp_path, rows, many_faults, capsys):
    (tmp_path / "source").mkdir()
    raw(tmp_path / "source")
    base, poison = f"file://{tmp_path}", BACKFILL + dt.timedelta(days=2)
    args = ["--base", base, "--buckets", "2", "--replay-days", "3", "--poison-date", poison.isoformat(), "--max-bad-ratio", "0.12"]
    assert cli.main(["run-local", *args], spark) == 0
    said = capsys.readouterr().out.splitlines()
    assert len(said) == 4 and [d for d in said if "published" not in d] == [d for d in said if d.startswith(poison.isoformat()) or d.startswith((poison + dt.timedelta(days=1)).isoformat()) and "too many" in d]
    assert any(d.startswith(poison.isoformat()) and "order_items" in d for d in said)

    p = Pipeline(spark, Config(base, BACKFILL, buckets=2, replay_days=3))
    assert p.replay_next() is None and cli.main(["prepare", *args], spark) == 4
    made = {}
    for r in p.replay().manifest().collect():
        assert r["delivered_at"] is not None
        for tag, n in r["injected"].items():
            made[tag] = made.get(tag, 0) + n
        made["new_field"] = made.get("new_field", 0) + r["new_field_rows"]
    told = {(r["table_name"], r["rule"]): r["n"] for r in p.store.read(METRICS).groupBy("table_name", "rule").agg(F.sum("failed_rows").alias("n")).collect()}
    assert made["invalid_price"] > 0 and made["poison_invalid_price"] > 0 and made["duplicate_next_batch"] > 0 and made["cdc_out_of_order"] > 0
    assert told["order_items", "price_not_positive"] == made["invalid_price"] + made["poison_invalid_price"]
    for tag in ("missing_product_id", "unknown_product_id", "too_late"):
        assert told["order_items", tag] == made.get(tag, 0), tag
    assert told["order_items", "duplicate_in_batch"] == made["duplicate_same_batch"] and told["order_items", "duplicate_already_loaded"] == made["duplicate_next_batch"]
    assert told["orders_cdc", "delivered_before_purchase"] == made["invalid_delivery_ts"]
    assert told["orders_cdc", "duplicate_in_batch"] == made["cdc_duplicate"]
    assert told["order_items", "rescued_data"] == made["new_field"]
    assert p.store.read("silver.seller_history").where(~F.col("is_current")).count() == made.get("relocated", 0) > 0
    assert rows(p.store.read("silver.reviews").agg(F.max("review_score"))) == [(5,)] and p.store.read("silver.products").where("product_category_name_english IS NULL").count() > 0

    runs = p.store.read(GATE)
    assert runs.select("run_id").distinct().count() == 4 and runs.where("NOT passed").select("table_name").distinct().first()[0] == "order_items"
    assert p.store.read(QUARANTINE).where(F.col("run_id") == f"local-{poison.isoformat()}").count() > 0
    versions = {t: p.store.version(t) for t in ("silver.order_items", "silver.orders", METRICS, QUARANTINE)}
    p.bronze()
    p.silver()
    p.scd2()
    assert versions == {t: p.store.version(t) for t in versions}
    p.gold()
    p.mart()
    assert cli.main(["reconcile", *args, "--run-id", "checked"], spark) == 0
    log = p.store.read(RECONCILED).where("run_id = 'checked'")
    assert log.count() == 16 and log.where("NOT passed").count() == 0
    p.store.update("silver.customers", F.col("customer_id") == "c1", customer_city=F.lit("elsewhere"))
    assert reconcile.evaluate([c for c in p.checks() if c.name == "silver.customers"]).first()["only_left"] == 1


def test_faults_limits(spark):
    days = replay.Plan(BACKFILL, 4)
    df = spark.range(10_000).select(F.col("id").alias("k"), F.date_add(F.lit(BACKFILL), (F.col("id") % 5).cast("int")).alias("d"), F.lit(5).alias("price"), (F.col("id") % 2 == 0).alias("even"))
    faults = [replay.Fault("late", 0, 3000, delay=1, jitter=2), replay.Fault("bad", 3000, 6000, values=(("price", "-price"),), only=days.each()[2]), replay.Fault("odd", 6000, 9000, values=(("price", "0"),), where="NOT even")]
    out = replay.inject(df, ["k"], "d", faults, days.last, days.backfill).join(df.select("k", F.col("d").alias("was")), "k")
    late = out.where("_fault = 'late'").select(F.date_diff("d", "was").alias("n")).distinct()
    assert sorted(r[0] for r in late.collect()) == [1, 2] and out.agg(F.max("d")).first()[0] == days.last
    assert out.where("_fault = 'bad'").select("d").distinct().collect()[0][0] == days.each()[2] and out.where("price = 0 AND even").count() == 0
    assert out.where("_fault IS NULL AND price <> 5").count() == 0 and dict(out.dtypes)["price"] == "int"
