"""Queries p1 to p7: the general problems over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import day_int
from tidemark.operators import asof, drift, history, panes, snapshots
from tidemark.operators.changes import ChangedTable, is_delete
from tidemark.operators.once import DELIVERY, deliver_once
from tidemark.session import scratch
from tidemark.sources.contracts import CONTRACTS
from tidemark.sources.store import Store
from tidemark.sources.tables import table

ITEM = ["order_id", "order_item_id"]
BACKFILL = dt.date(2024, 3, 31)
ALLOWED_DAYS = 3
SELLER = ["seller_city", "seller_state", "seller_zip_code_prefix"]
PRODUCT = ["product_category_name", "product_category_name_english", "product_weight_g", "product_photos_qty"]
DRIFTING = ["price", "freight_value", "shipping_limit_ts", "product_id"]


def first_items(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each item by its row delivered first, with the columns named besides key and delivery."""
    rows = table(spark, folder, "order_items").select(*ITEM, *columns, "_batch_date", "_ingested_at", "_source_file")
    return deliver_once(rows, ITEM)


def sliced_items(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    items = first_items(spark, folder, "order_purchase_ts", *columns)
    return panes.slice_events(items, "order_purchase_ts", "_batch_date", ALLOWED_DAYS, BACKFILL)


def measures() -> dict[str, Column]:
    """What is kept of each pane."""
    return {"item_count": F.lit(1).cast("bigint"), "revenue": F.col("price")}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Late items by what they did to their day's window: they correct it where their batch emitted it again with more items.
    Items are read once: both sides of the join start from the same exchange."""
    sliced = sliced_items(spark, folder, "price")
    emitted = panes.window_results(panes.pane_changes(sliced, "_batch_date", measures()), "_batch_date", measures())
    late = panes.late_outcomes(sliced, emitted, "_batch_date", "item_count", BACKFILL)
    return late.select(*ITEM, day_int("order_purchase_ts").alias("event_day"), F.col("_outcome").alias("outcome"))


def _windows(spark: SparkSession, folder: str, size: int, slide: int) -> DataFrame:
    changes = panes.pane_changes(sliced_items(spark, folder, "price"), "_batch_date", measures())
    out = panes.window_results(changes, "_batch_date", measures(), size, slide)
    return out.select(
        day_int("window_start").alias("first_day"),
        day_int("_batch_date").alias("batch_day"),
        F.col("item_count").cast("bigint").alias("item_count"),
        F.col("revenue").cast("decimal(38,2)").alias("revenue"),
    )


def p1_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder, 1, 1)


def p1_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder, 7, 1)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    def of(name: str, key: str, attributes: list[str]) -> DataFrame:
        out = snapshots.snapshot_changes(table(spark, folder, name), key, attributes)
        return out.select(F.lit(name).alias("table_name"), "record_key", day_int("day").alias("batch_day"), "change")

    return of("sellers", "seller_id", SELLER).unionByName(of("products", "product_id", PRODUCT))


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "order_items")
    feed = F.regexp_extract("_source_file", r"(feed\d+)", 1)
    return rows.where(~F.coalesce(F.col("_malformed"), F.lit(False))).withColumn("_feed", F.when(feed != "", feed))


def _schemas(rows: DataFrame) -> DataFrame:
    """Schemas of the deliveries by the columns that drift, nested fields as deep as they go."""
    narrow = rows.select("_feed", "_batch_date", *DRIFTING, "_rescued_data")
    return drift.delivery_schemas(narrow, "_feed", "_batch_date", DRIFTING, "_rescued_data")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    scripts = drift.schema_scripts(_schemas(_deliveries(spark, folder)))
    return drift.top_level_changes(scripts).select("feed", day_int("day").alias("batch_day"), "field_name", "change")


def p3_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_scripts(_schemas(_deliveries(spark, folder))).withColumn("day", day_int("day"))


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """All rows under the contract's columns, whichever way a delivery sent them, and everything else it sent."""
    rows = _deliveries(spark, folder)
    columns, depth = CONTRACTS["order_items"].columns, drift.nesting(rows, "_rescued_data")
    narrow = rows.select("_feed", "_batch_date", *[c for c in columns if c not in ITEM], "_rescued_data")
    schemas = drift.delivery_schemas(narrow, "_feed", "_batch_date", [c for c in columns if c not in ITEM], "_rescued_data", depth)
    names = drift.steady_names(schemas, drift.schema_scripts(schemas), columns)
    out = drift.unify(rows.drop("_malformed", "_raw"), "_feed", "_batch_date", columns, "_rescued_data", names, ITEM, depth)
    return out.select(*columns, F.to_json("extra_fields").alias("extra_fields"), F.col("_feed").alias("feed"), day_int("_batch_date").alias("batch_day"), "_source_file")


def _seller_history(spark: SparkSession, folder: str) -> DataFrame:
    """The log of checkpoints and patches is written to a table and the versions are read back from it."""
    kept = history.HistoryTable(Store(spark, scratch(spark, "history")), "sellers", "seller_id", SELLER)
    kept.add(table(spark, folder, "sellers"))
    return kept.versions().withColumn("valid_from", day_int("valid_from")).withColumn("valid_to", F.coalesce(day_int("valid_to"), F.lit(-1)))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _seller_history(spark, folder).select("seller_id", "valid_from", "valid_to")


def p4_versions(spark: SparkSession, folder: str) -> DataFrame:
    return _seller_history(spark, folder)


def known_items(spark: SparkSession, folder: str) -> DataFrame:
    items = first_items(spark, folder, "seller_id", "order_purchase_ts").withColumn("_day", F.to_date("order_purchase_ts"))
    changes = asof.attribute_changes(table(spark, folder, "sellers"), "seller_id", SELLER)
    packed = asof.packed_histories(changes, "seller_id", SELLER)
    counted = table(spark, folder, "order_items").select("seller_id")
    return asof.known_at(items, "_day", packed, "seller_id", SELLER, ITEM, counted)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    known = known_items(spark, folder).where(F.col("_has_history") & F.col("_day").isNotNull())
    stale = known.where(~F.col("_known_since").eqNullSafe(F.col("_last_since")))
    return stale.select(*ITEM, F.coalesce(day_int("_known_since"), F.lit(-1)).alias("version_day"))


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    return known_items(spark, folder).select(*ITEM, "seller_id", day_int("_day").alias("event_day"), *SELLER)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "order_items").select(*ITEM, "_batch_date", "_ingested_at", "_source_file")
    once = deliver_once(rows, ITEM, copies="copies").where(F.col("copies") > 1)
    return once.select(*ITEM, F.col("_source_file").alias("kept_source_file"))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Whole rows; copies delivered by one file at one time are told apart by their values."""
    said = ["product_id", "seller_id", "price", "freight_value"]
    rows = table(spark, folder, "order_items").select(*ITEM, *said, *DELIVERY)
    kept = deliver_once(rows, ITEM, (*DELIVERY, *said), copies="copies")
    return kept.select(*ITEM, *said, day_int("_batch_date").alias("batch_day"), "copies")


def _rebuilt(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The backfill makes the table, the days after it are applied on top: two commits, the second copy-on-write."""
    feed = table(spark, folder, "orders_cdc").select("order_id", *columns, "change_seq", "_op", "_ingested_at", "_batch_date", "_source_file")
    target = ChangedTable(spark, scratch(spark, "orders"), ["order_id"], ["change_seq", "_ingested_at", "_batch_date", "_source_file"])
    target.apply(feed.where(F.coalesce(F.col("_batch_date") <= F.lit(BACKFILL), F.lit(True))), is_delete())
    target.apply(feed.where(F.col("_batch_date") > F.lit(BACKFILL)), is_delete())
    return target.current()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _rebuilt(spark, folder, ["order_status"]).select("order_id", "change_seq", "order_status")


def p7_orders(spark: SparkSession, folder: str) -> DataFrame:
    milestones = [f"order_{m}_ts" for m in ("purchase", "approved", "delivered_carrier", "delivered_customer", "estimated_delivery")]
    return _rebuilt(spark, folder, ["customer_id", "order_status", *milestones]).select("order_id", "customer_id", "order_status", *milestones, "change_seq")


QUERIES = {f.__name__: f for f in (p1_found, p1_daily, p1_weekly, p2_found, p3_found, p3_scripts, p3_table, p4_found, p4_versions, p5_found, p5_items, p6_found, p6_items, p7_found, p7_orders)}
