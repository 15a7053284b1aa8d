"""Queries of the pipeline's own operators over the test tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.columns import day_int
from tidemark.operators import history, incremental, quality, reconcile, replay, reports, scd, star
from tidemark.operators.changes import is_delete
from tidemark.operators.once import DELIVERY, deliver_once
from tidemark.operators.panes import slice_events
from tidemark.operators.rules import rules_of
from tidemark.plans.found import ALLOWED_DAYS, BACKFILL, ITEM, SELLER
from tidemark.session import scratch
from tidemark.sources import landing
from tidemark.sources.contracts import CONTRACTS, parse_lines
from tidemark.sources.store import Store, merge_forward_only, merge_hash_guarded, merge_insert_new, merge_upsert
from tidemark.sources.tables import table
from tidemark.streaming.ingest import each_batch, ingest
from tidemark.streaming.pipeline import Config, Pipeline, with_lateness
from tidemark.streaming.replayer import Replay

#: The states in which an order is open, and those that end it otherwise than by delivery.
OPEN, ENDED = ["created", "approved", "invoiced", "processing", "shipped"], ["canceled", "unavailable"]
#: The latest delivery of a customer; of one delivery's rows the greatest city.
LATEST_CUSTOMER = ("_batch_date", "_ingested_at", "customer_city")
#: Fixed value: the greatest part of bad rows that passes the gate.
THRESHOLD = 0.05
FIRST_DAY, LAST_DAY = dt.date(2023, 1, 1), dt.date(2025, 12, 31)
MILESTONES = {"approved": "order_approved_ts", "shipped": "order_delivered_carrier_ts", "delivered": "order_delivered_customer_ts"}


# -- sources


def src_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by feed and day, all read by the landing scan: files are dropped under the days and names that rows came by."""
    at, path = scratch(spark, "landing"), F.col("_source_file")
    rows = table(spark, folder, "order_items").select("order_id", "order_item_id", "_batch_date", F.coalesce(landing.feed_of(path), F.lit("none")).alias("feed"))
    rows.withColumn("batch_date", F.col("_batch_date").cast("string")).drop("_batch_date").repartition("batch_date", "feed").write.partitionBy("batch_date", "feed").json(f"{at}/order_items")
    seen = landing.scan(spark, f"{at}/order_items", CONTRACTS["order_items"])
    return seen.groupBy(landing.feed_of(F.col("_source_file")).alias("feed"), day_int("_batch_date").alias("path_day")).agg(F.count("*").alias("row_count"), F.count_if("_malformed").alias("malformed"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every outcome, made of the events: good, with an unknown field, of a wrong type, no object, empty."""
    e, k = table(spark, folder, "events"), F.get_json_object("props", "$.k")
    n = F.col("event_id") % 7
    value = F.when(n == 0, F.concat(F.lit('{"k":'), k, F.lit(',"extra":{"a":1}}'))).when(n == 1, F.lit("not json")).when(n == 2, F.lit('{"k":"abc"}')).when(n == 3, F.lit("[1,2]")).when(n == 4, F.lit("")).otherwise(F.col("props"))
    return e.select("event_id", value.alias("value"))


def src_parse_lines(spark: SparkSession, folder: str) -> DataFrame:
    out = parse_lines(_lines(spark, folder), StructType.fromDDL("k int"))
    return out.select("event_id", "k", F.col("_rescued_data").alias("rescued"), F.col("_malformed").alias("malformed"), F.col("_raw").alias("raw"))


def src_csv(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch(spark, "csv")
    table(spark, folder, "nation").write.csv(at, header=True)
    return landing.read_csv(spark, at)


def src_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots dropped in dated folders and found one after the other from the listing."""
    at = scratch(spark, "landing")
    rows = table(spark, folder, "sellers").select("seller_id", F.col("_batch_date").cast("string").alias("batch_date"))
    rows.repartition("batch_date").write.partitionBy("batch_date").parquet(at)
    found, day = [], None
    while (day := landing.next_snapshot(spark, at, day)) is not None:
        found.append(day)
    return spark.createDataFrame(list(zip(found, [*found[1:], None])), "day date, next date").select(day_int("day").alias("batch_day"), day_int("next").alias("next_day"))


def src_rescued_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields the contract doesn't know, by the parser: rows are written as lines with what was rescued from them and parsed
    again."""
    rows = table(spark, folder, "order_items").where(F.col("_rescued_data").isNotNull())
    sent = F.to_json(F.map_concat(F.map_filter(F.from_json("_rescued_data", "map<string,string>"), lambda k, v: v.isNotNull()), F.create_map(F.lit("order_id"), F.coalesce("order_id", F.lit("")))))
    seen = parse_lines(rows.select("_batch_date", sent.alias("value")), CONTRACTS["order_items"].schema)
    each = seen.where(F.col("_rescued_data").isNotNull()).select("_batch_date", F.explode(F.json_object_keys("_rescued_data")).alias("field_name"))
    unknown = each.where(~F.col("field_name").isin(CONTRACTS["order_items"].columns))
    return unknown.groupBy(day_int("_batch_date").alias("batch_day"), "field_name").agg(F.count("*").alias("row_count"))


def src_one_day(spark: SparkSession, folder: str) -> DataFrame:
    """One day of rows staged by day: the scan reads that day's folder only."""
    at = scratch(spark, "staging")
    rows = table(spark, folder, "customers").select(*CONTRACTS["customers"].columns, F.col("_batch_date").alias("_delivery_date"))
    replay.stage(rows, at)
    last = table(spark, folder, "customers").agg(F.max("_batch_date")).first()[0]
    return replay.staged_day(spark, at, last).select(*CONTRACTS["customers"].columns)


def str_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Customers dropped as JSON lines, a folder a day, ingested by a file stream twice: each file is taken once."""
    at, c = scratch(spark, "landing"), CONTRACTS["customers"]
    rows = table(spark, folder, "customers").select(*c.columns, "_batch_date")
    rows.withColumn("batch_date", F.col("_batch_date").cast("string")).drop("_batch_date").write.partitionBy("batch_date").json(f"{at}/customers")
    for _ in range(2):
        ingest(spark, f"{at}/customers", f"{at}/bronze", f"{at}/checkpoint", c)
    return spark.read.parquet(f"{at}/bronze").select(*c.columns, day_int("_batch_date").alias("batch_day"), "_malformed")


def str_ingest_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """Seller snapshots dropped as Parquet, a folder a day, ingested by a file stream."""
    at, c = scratch(spark, "landing"), CONTRACTS["sellers"]
    rows = table(spark, folder, "sellers").select(*c.columns, F.col("_batch_date").cast("string").alias("batch_date"))
    rows.repartition("batch_date").write.partitionBy("batch_date").parquet(f"{at}/sellers")
    ingest(spark, f"{at}/sellers", f"{at}/bronze", f"{at}/checkpoint", c)
    return spark.read.parquet(f"{at}/bronze").select(*c.columns, day_int("_batch_date").alias("batch_day"))


def str_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A table kept by micro-batches: customers streamed through a merge, the latest delivery standing."""
    at, c = scratch(spark, "stream"), CONTRACTS["customers"]
    table(spark, folder, "customers").withColumn("_source_file", F.lit("")).write.parquet(f"{at}/bronze")
    store = Store(spark, f"{at}/tables")

    def apply(batch: DataFrame, number: int) -> None:
        rows = deliver_once(batch, ["customer_id"], LATEST_CUSTOMER, first=False)
        store.ensure("customers", rows.schema, ["customer_id"], 4)
        merge_upsert(store, "customers", rows, ["customer_id"], newer="_batch_date", txn=("customers", number))

    each_batch(spark, f"{at}/bronze", f"{at}/checkpoint", apply)
    return store.read("customers").select(*c.columns, day_int("_batch_date").alias("batch_day"))


def str_two_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Files dropped by day and feed, taken in by the daily run: two streams read the change feed, each with its checkpoint, and
    the stream of items looks its products up. The keys of what is kept."""
    at, path = scratch(spark, "run"), F.col("_source_file")
    for name in ("orders_cdc", "order_items", "products"):
        c = CONTRACTS[name]
        rows = table(spark, folder, name).select(*c.columns, F.col("_batch_date").cast("string").alias("batch_date"), F.coalesce(landing.feed_of(path), F.lit("none")).alias("feed"))
        writer = rows.repartition("batch_date", "feed").write.partitionBy("batch_date", "feed").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        getattr(writer, c.fmt)(f"{at}/landing/{name}")
    p = Pipeline(spark, Config(at, BACKFILL, ALLOWED_DAYS, THRESHOLD, 4))
    p.bronze()
    p.silver()
    keys = lambda rows, name, n: rows.select(F.lit(name).alias("kept_in"), "order_id", F.col(n).alias("number"))
    out = keys(p.orders(), "orders", "change_seq").unionByName(keys(p.store.read("silver.order_changes"), "order_changes", "change_seq"))
    return out.unionByName(keys(p.store.read("silver.order_items"), "order_items", "order_item_id"))


# -- rules and silver tables


def item_rules(rows: DataFrame) -> list[quality.Rule]:
    return rules_of("order_items", rows, allowed_days=ALLOWED_DAYS, backfill=BACKFILL)


def checked_items(spark: SparkSession, folder: str) -> DataFrame:
    flagged = quality.known_flag(table(spark, folder, "order_items"), "product_id", table(spark, folder, "products"), "_known")
    return quality.evaluate(flagged, item_rules(flagged))


def checked(spark: SparkSession, folder: str, feed: str) -> DataFrame:
    rows = table(spark, folder, feed)
    return quality.evaluate(rows, rules_of(feed, rows))


def checked_changes(spark: SparkSession, folder: str) -> DataFrame:
    return checked(spark, folder, "orders_cdc")


def silver_items(spark: SparkSession, folder: str) -> DataFrame:
    good = quality.split(checked_items(spark, folder))[0].drop("_raw", "_rescued_data", "_malformed", "_known")
    return with_lateness(deliver_once(good, ITEM), "order_purchase_ts", BACKFILL)


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """The change log: each (order, sequence number) once, as delivered first, deletes too."""
    return deliver_once(quality.split(checked_changes(spark, folder))[0], ["order_id", "change_seq"])


def silver_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The log's states; deletes have none."""
    return change_log(spark, folder).where(~is_delete())


def standing_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The latest change of each order; of a deleted order that is its delete."""
    return deliver_once(change_log(spark, folder), ["order_id"], ("change_seq",), first=False)


def silver_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders that exist, as their latest change left them."""
    return standing_orders(spark, folder).where(~is_delete())


def silver_customers(spark: SparkSession, folder: str) -> DataFrame:
    good = quality.split(checked(spark, folder, "customers"))[0]
    return deliver_once(good, ["customer_id"], LATEST_CUSTOMER, first=False)


def silver_products(spark: SparkSession, folder: str) -> DataFrame:
    return deliver_once(table(spark, folder, "products"), ["product_id"], ("_batch_date", "_ingested_at"), first=False)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in for reviews, which the test tables lack: a score for each delivered order, from its purchase minute."""
    rows = silver_orders(spark, folder).where(F.col("order_delivered_customer_ts").isNotNull() & F.col("order_purchase_ts").isNotNull())
    return rows.select("order_id", (1 + F.minute("order_purchase_ts") % 5).alias("score"))


def slv_items(spark: SparkSession, folder: str) -> DataFrame:
    return silver_items(spark, folder).select(*ITEM, "product_id", "seller_id", "price", day_int("event_date").alias("event_day"), "arrival_lag_days", day_int("_batch_date").alias("batch_day"))


def slv_changes(spark: SparkSession, folder: str) -> DataFrame:
    return silver_changes(spark, folder).select("order_id", "change_seq", "order_status", "change_ts", day_int("_batch_date").alias("batch_day"))


def slv_orders(spark: SparkSession, folder: str) -> DataFrame:
    return silver_orders(spark, folder).select("order_id", "customer_id", "order_status", "change_seq", "change_ts")


def slv_customers(spark: SparkSession, folder: str) -> DataFrame:
    return silver_customers(spark, folder).select(*CONTRACTS["customers"].columns, day_int("_batch_date").alias("batch_day"))


def slv_products(spark: SparkSession, folder: str) -> DataFrame:
    return silver_products(spark, folder).select(*CONTRACTS["products"].columns, day_int("_batch_date").alias("batch_day"))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in for the feed of reviews, which the test tables lack: one for each change that shows a delivery, in text as files
    hold it; scores from 0 to 6, answered the day after or not at all."""
    rows = table(spark, folder, "orders_cdc").where(F.col("order_delivered_customer_ts").isNotNull() & F.col("order_purchase_ts").isNotNull() & F.col("change_seq").isNotNull())
    score, created = F.minute("order_purchase_ts") % 7, F.col("order_delivered_customer_ts")
    answered = F.when(F.second("order_purchase_ts") % 3 > 0, created + F.make_dt_interval(F.col("change_seq")))
    text = {"review_id": F.col("order_id"), "order_id": F.when(score < 6, F.col("order_id")), "review_score": score, "review_creation_date": created, "review_answer_timestamp": answered}
    return rows.select(*[c.cast("string").alias(k) for k, c in text.items()], *DELIVERY)


def typed_reviews(spark: SparkSession, folder: str) -> DataFrame:
    typed = replay.project(reviews(spark, folder), replay.REVIEW_COLUMNS, DELIVERY)
    return quality.evaluate(typed, rules_of("reviews", typed))


def slv_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Of a review delivered again the latest stands, in one delivery the one answered last."""
    good = quality.split(typed_reviews(spark, folder))[0]
    kept = deliver_once(good, ["review_id", "order_id"], ("_batch_date", "review_answer_ts", "_ingested_at", "_source_file", "review_creation_ts", "review_score"), first=False)
    return kept.select("review_id", "order_id", "review_score", "review_creation_ts", "review_answer_ts", day_int("_batch_date").alias("batch_day"))


# -- quality


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of items, changes, customers and snapshots, by table, day and rule."""
    items = checked_items(spark, folder)
    parts = [quality.metrics(items, item_rules(items), "order_items")]
    for feed in ("orders_cdc", "customers", "sellers", "products"):
        rows = checked(spark, folder, feed)
        parts.append(quality.metrics(rows, rules_of(feed, rows), feed))
    return reduce(lambda a, b: a.unionByName(b), parts)


def dq_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).withColumn("batch_date", day_int("batch_date"))


def dq_fired(spark: SparkSession, folder: str) -> DataFrame:
    return quality.fired(_metrics(spark, folder)).withColumn("batch_date", day_int("batch_date"))


def dq_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_metrics(table(spark, folder, "order_items"), ITEM, "order_items").withColumn("batch_date", day_int("batch_date"))


def dq_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    kept = quality.quarantine(checked_items(spark, folder), CONTRACTS["order_items"].columns, "order_items")
    return kept.select(day_int("batch_date").alias("batch_day"), F.array_join("failed_rules", ", ").alias("rules"), F.get_json_object("record", "$.order_id").alias("order_id"), "raw", "source_file")


def dq_rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    bad = quality.split(checked_items(spark, folder))[1]
    return bad.select("_batch_date", F.explode("_failed_rules").alias("rule")).groupBy(day_int("_batch_date").alias("batch_day"), "rule").agg(F.count("*").alias("row_count"))


def dq_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicates of a run: items after the backfill against themselves and against what the backfill loaded."""
    rows = table(spark, folder, "order_items").where(~quality.missing(*ITEM)).select(*ITEM, "_batch_date")
    before = rows.where(F.col("_batch_date") <= F.lit(BACKFILL)).select(*ITEM).distinct()
    found = quality.duplicate_metrics(rows.where(F.col("_batch_date") > F.lit(BACKFILL)), ITEM, "order_items", loaded=before)
    return found.withColumn("batch_date", day_int("batch_date"))


def dq_reviews(spark: SparkSession, folder: str) -> DataFrame:
    seen = typed_reviews(spark, folder)
    return quality.metrics(seen, rules_of("reviews", seen), "reviews").withColumn("batch_date", day_int("batch_date"))


def dq_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Expectations that only count: hits of the rules of customers and changes, observed while the rows pass by."""
    out = []
    for feed in ("customers", "orders_cdc"):
        rows, seen = table(spark, folder, feed), Observation()
        quality.observe(rows, rules_of(feed, rows), seen).write.format("noop").mode("overwrite").save()
        out += [(feed, rule, n) for rule, n in seen.get.items()]
    return spark.createDataFrame(out, "table_name string, rule string, row_count bigint")


def dq_milestones(spark: SparkSession, folder: str) -> DataFrame:
    return quality.table_metric(order_fact(spark, folder), "fact_order_fulfillment", "inconsistent_milestones", F.col("has_inconsistent_milestones")).drop("batch_date")


def gate_run(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's delivery as a run of its own."""
    return quality.gate(_metrics(spark, folder), THRESHOLD, run="batch_date").withColumn("batch_date", day_int("batch_date"))


def dq_gate(spark: SparkSession, folder: str) -> DataFrame:
    return quality.gate(_metrics(spark, folder), THRESHOLD)


def dq_gate_latest(spark: SparkSession, folder: str) -> DataFrame:
    return quality.gate(_metrics(spark, folder), THRESHOLD, latest_only=True)


# -- merges, change feed, histories


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The latest row of each customer as it was after the backfill, and of each customer sent after it."""
    rows = table(spark, folder, "customers").select(*CONTRACTS["customers"].columns, "_batch_date", "_ingested_at")
    of = lambda part: deliver_once(rows.where(part), ["customer_id"], LATEST_CUSTOMER, first=False)
    return of(F.col("_batch_date") <= F.lit(BACKFILL)), of(F.col("_batch_date") > F.lit(BACKFILL))


def _customers_store(spark: SparkSession, folder: str) -> tuple[Store, DataFrame]:
    before, after = _halves(spark, folder)
    store = Store(spark, scratch(spark, "tables"))
    store.ensure("customers", before.schema, ["customer_id"], 4)
    merge_upsert(store, "customers", before, ["customer_id"])
    return store, after


def _city(rows: DataFrame) -> DataFrame:
    return rows.select("customer_id", "customer_city", day_int("_batch_date").alias("batch_day"))


def mrg_insert_new(spark: SparkSession, folder: str) -> DataFrame:
    store, after = _customers_store(spark, folder)
    merge_insert_new(store, "customers", after, ["customer_id"])
    return _city(store.read("customers"))


def mrg_upsert(spark: SparkSession, folder: str) -> DataFrame:
    store, after = _customers_store(spark, folder)
    merge_upsert(store, "customers", after, ["customer_id"], newer="_batch_date")
    return _city(store.read("customers"))


def mrg_delete_missing(spark: SparkSession, folder: str) -> DataFrame:
    store, after = _customers_store(spark, folder)
    store.merge("customers", after, ["customer_id"], delete_missing=True)
    return _city(store.read("customers"))


def mrg_update(spark: SparkSession, folder: str) -> DataFrame:
    """UPDATE: the city of customers of the backfill without one is set."""
    store, _ = _customers_store(spark, folder)
    store.update("customers", F.col("customer_city").isNull() | (F.col("customer_state") == "SP"), customer_city=F.upper(F.coalesce("customer_city", F.lit("nowhere"))))
    return _city(store.read("customers"))


def mrg_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """CREATE OR REPLACE: rows and columns are replaced, the version before stays readable."""
    store, after = _customers_store(spark, folder)
    before = store.version("customers")
    store.overwrite("customers", after.select("customer_id", "customer_city", "_batch_date"))
    now = store.read("customers").select(F.lit("now").alias("version"), "customer_id", "customer_city")
    return now.unionByName(store.read("customers", before).select(F.lit("before").alias("version"), "customer_id", "customer_city"))


def mrg_guarded_delete(spark: SparkSession, folder: str) -> DataFrame:
    """What a guarded merge with delete-missing did, and the rows that its change feed tells of."""
    store = Store(spark, scratch(spark, "tables"))
    for rows in _halves(spark, folder):
        content = rows.select("customer_id", "customer_city", "customer_state")
        hashed = content.withColumn("row_hash", star.row_hash(content, ["customer_id"]))
        store.ensure("customers", hashed.schema, ["customer_id"])
        merge_hash_guarded(store, "customers", hashed, ["customer_id"], delete_missing=True)
    feed = store.changes("customers", 1, 2)
    return feed.groupBy(F.col("_change_type").alias("change_type")).agg(F.count("*").alias("row_count"))


def mrg_forward_only(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's latest change, from the second half of the feed merged first and the first half after it. Deletes stay
    in the table, so that the first half can't bring their orders back, and are left out of the result."""
    rows = change_log(spark, folder).select("order_id", "change_seq", "order_status", "_op", "_batch_date")
    store = Store(spark, scratch(spark, "tables"))
    store.ensure("orders", rows.schema, ["order_id"], 4)
    for part in (F.col("_batch_date") > F.lit(BACKFILL), F.col("_batch_date") <= F.lit(BACKFILL)):
        merge_forward_only(store, "orders", deliver_once(rows.where(part), ["order_id"], ("change_seq",), first=False), ["order_id"], "change_seq")
    return store.read("orders").where(~is_delete()).select("order_id", "change_seq", "order_status")


def mrg_hash_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """What a guarded merge did: rows inserted, updated because their hash differs, kept."""
    store = Store(spark, scratch(spark, "tables"))
    for rows in _halves(spark, folder):
        content = rows.select("customer_id", "customer_city", "customer_state")
        hashed = content.withColumn("row_hash", star.row_hash(content, ["customer_id"]))
        store.ensure("customers", hashed.schema, ["customer_id"])
        merge_hash_guarded(store, "customers", hashed, ["customer_id"])
    m = F.col("metrics")
    return store.history("customers").where("version = 2").select(m["insert"].alias("inserted"), m["update"].alias("updated"), m["keep"].alias("kept"))


def cdf_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The change feed of an upsert, rows by kind of change."""
    store, after = _customers_store(spark, folder)
    version = store.version("customers")
    merge_upsert(store, "customers", after, ["customer_id"])
    feed = store.changes("customers", version, store.version("customers"))
    return feed.groupBy(F.col("_change_type").alias("change_type")).agg(F.count("*").alias("row_count"), F.count_distinct("customer_id").alias("customers"))


def scd_one_pass(spark: SparkSession, folder: str) -> DataFrame:
    v = history.versions(table(spark, folder, "sellers"), "seller_id", SELLER)
    d = scd.as_dimension(v, "seller_id", SELLER)
    return d.select("seller_id", *SELLER, day_int("valid_from").alias("valid_from"), F.coalesce(day_int("valid_to"), F.lit(-1)).alias("valid_to"), "is_current")


def scd_applied(spark: SparkSession, folder: str) -> DataFrame:
    """The same history, kept by applying snapshot after snapshot to a table; applying them again changes nothing."""
    store = Store(spark, scratch(spark, "tables"))
    snapshots = table(spark, folder, "sellers")
    scd.apply_snapshots(store, "sellers", snapshots, "seller_id", SELLER)
    scd.apply_snapshots(store, "sellers", snapshots, "seller_id", SELLER)
    return store.read("sellers").select("seller_id", *SELLER, day_int("valid_from").alias("valid_from"), F.coalesce(day_int("valid_to"), F.lit(-1)).alias("valid_to"), "is_current")


def late_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    sliced = slice_events(silver_items(spark, folder), "order_purchase_ts", "_batch_date", ALLOWED_DAYS, BACKFILL)
    return sliced.groupBy(F.col("arrival_lag_days").alias("lag"), F.col("_outcome").alias("outcome")).agg(F.count("*").alias("row_count"))


# -- star schema


def seller_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return scd.as_dimension(history.versions(table(spark, folder, "sellers"), "seller_id", SELLER), "seller_id", SELLER).withColumnRenamed("version_key", "seller_sk")


def item_fact(spark: SparkSession, folder: str) -> DataFrame:
    return star.item_fact(silver_items(spark, folder), standing_orders(spark, folder), silver_customers(spark, folder), seller_dimension(spark, folder), ENDED)


def order_fact(spark: SparkSession, folder: str) -> DataFrame:
    return star.fulfillment_fact(change_log(spark, folder), silver_items(spark, folder), silver_customers(spark, folder), scores(spark, folder), ENDED)


def gold_dim_date(spark: SparkSession, folder: str) -> DataFrame:
    return star.date_dimension(spark, FIRST_DAY, LAST_DAY).drop("date")


def gold_dim_customer(spark: SparkSession, folder: str) -> DataFrame:
    attributes = ["customer_zip_code_prefix", "customer_city", "customer_state"]
    return star.person_dimension(silver_customers(spark, folder), silver_orders(spark, folder), "customer_unique_id", "customer_id", attributes, "order_purchase_ts")


def gold_dim_product(spark: SparkSession, folder: str) -> DataFrame:
    return silver_products(spark, folder).select(*CONTRACTS["products"].columns)


def gold_fact_order_item(spark: SparkSession, folder: str) -> DataFrame:
    f, d = item_fact(spark, folder), seller_dimension(spark, folder).select("seller_sk", day_int("valid_from").alias("version_from"))
    return f.join(d, "seller_sk", "left").drop("seller_sk")


def gold_fact_order_fulfillment(spark: SparkSession, folder: str) -> DataFrame:
    return order_fact(spark, folder)


def backlog(spark: SparkSession, folder: str) -> DataFrame:
    return star.backlog_fact(change_log(spark, folder), silver_items(spark, folder), silver_customers(spark, folder), OPEN)


def gold_fact_daily_backlog(spark: SparkSession, folder: str) -> DataFrame:
    return backlog(spark, folder).drop("snapshot_date")


def mart(spark: SparkSession, folder: str) -> DataFrame:
    return star.seller_mart(item_fact(spark, folder), scores(spark, folder), seller_dimension(spark, folder))


def gold_mart_seller(spark: SparkSession, folder: str) -> DataFrame:
    return mart(spark, folder)


# -- incremental refresh, reconciliation, replay


def _order_totals(items: DataFrame) -> DataFrame:
    out = items.groupBy("order_id").agg(F.count("*").alias("item_count"), F.sum("price").cast("decimal(38,2)").alias("order_value"))
    return out.withColumn("row_hash", star.row_hash(out, ["order_id"]))


def _kept(rows: DataFrame) -> DataFrame:
    """The rows written once, for plans that read them several times."""
    at = scratch(rows.sparkSession, "kept")
    rows.write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def _refreshed(spark: SparkSession, folder: str) -> tuple[Store, incremental.Plan]:
    """Order totals, built in full after the backfill and refreshed from the change feed after the other days."""
    rows = _kept(silver_items(spark, folder).select(*ITEM, "price", "_batch_date"))
    store = Store(spark, scratch(spark, "tables"))
    store.ensure("items", rows.schema, ITEM, 4)

    def build(ids: DataFrame | None) -> None:
        out = _order_totals(incremental.only(store.read("items"), ids))
        store.ensure("totals", out.schema, ["order_id"], 4)
        merge_hash_guarded(store, "totals", out, ["order_id"])

    plan = None
    for part in (F.col("_batch_date") <= F.lit(BACKFILL), F.col("_batch_date") > F.lit(BACKFILL)):
        merge_insert_new(store, "items", rows.where(part), ITEM)
        plan = incremental.refresh(store, "totals", ["items"], {"items": lambda c: c.select("order_id")}, build, total=lambda: store.read("items").select("order_id"))
    return store, plan


def inc_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _refreshed(spark, folder)[0].read("totals").drop("row_hash")


def inc_stats(spark: SparkSession, folder: str) -> DataFrame:
    """How each refresh was done, and how many orders it processed of how many there are."""
    return _refreshed(spark, folder)[0].read(incremental.STATS).select("mode", "reason", "changed_ids", "processed_ids", "total_ids")


def inc_fulfillment(spark: SparkSession, folder: str) -> DataFrame:
    """The accumulating snapshot kept by refreshes: in full after the backfill, then for the orders that changed."""
    store = Store(spark, scratch(spark, "tables"))
    log, items, scored, people = (_kept(make(spark, folder)) for make in (change_log, silver_items, scores, silver_customers))
    store.ensure("changes", log.schema, ["order_id", "change_seq"], 4)
    store.ensure("items", items.schema, ITEM, 4)

    def build(ids: DataFrame | None) -> None:
        fact = star.fulfillment_fact(incremental.only(store.read("changes"), ids), incremental.only(store.read("items"), ids), people, incremental.only(scored, ids), ENDED)
        hashed = fact.withColumn("row_hash", star.row_hash(fact, ["order_id"]))
        store.ensure("fact", hashed.schema, ["order_id"], 4)
        incremental.merge_rebuilt(store, "fact", hashed, ["order_id"], ids)

    ids = lambda c: c.select("order_id")
    for part in (F.col("_batch_date") <= F.lit(BACKFILL), F.col("_batch_date") > F.lit(BACKFILL)):
        merge_insert_new(store, "changes", log.where(part), ["order_id", "change_seq"])
        merge_insert_new(store, "items", items.where(part), ITEM)
        incremental.refresh(store, "fact", ["changes", "items"], {"changes": ids, "items": ids}, build)
    return store.read("fact").drop("row_hash")


def _by_window(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key by a window, the second formulation that the operators are held against."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.where(~quality.missing(*keys)).withColumn("_n", F.row_number().over(ranked)).where("_n = 1").drop("_n")


def rec_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Operators against a second formulation: windows in place of aggregations, applied merges in place of one pass, exploded
    hits in place of counted ones, the incremental fact in place of the whole."""
    delivered, latest = [F.col(c) for c in DELIVERY], [F.desc(c) for c in ("_batch_date", "_ingested_at", "customer_city")]
    good = lambda seen: quality.split(seen)[0]
    items, changes = checked_items(spark, folder), checked_changes(spark, folder)
    log = _by_window(good(changes), ["order_id", "change_seq"], *delivered)
    last = _by_window(log, ["order_id"], F.desc("change_seq")).where(~is_delete())
    hits = quality.split(items)[1].select("_batch_date", F.explode("_failed_rules").alias("rule")).groupBy(F.col("_batch_date").alias("batch_date"), "rule").agg(F.count("*").alias("failed_rows"))
    counted = quality.metrics(items, item_rules(items), "order_items").where((F.col("failed_rows") > 0) & ~F.col("rule").isin(quality.ALL, quality.RESCUED)).select("batch_date", "rule", "failed_rows")
    kept = quality.quarantine(items, CONTRACTS["order_items"].columns, "order_items").select("failed_rules", "source_file", "raw")
    aside = items.where(F.exists("_failed_rules", lambda r: r.isNotNull())).select(F.col("_failed_rules").alias("failed_rules"), F.col("_source_file").alias("source_file"), F.col("_raw").alias("raw"))
    stored = Store(spark, scratch(spark, "tables"))
    scd.apply_snapshots(stored, "sellers", table(spark, folder, "sellers"), "seller_id", SELLER)
    seller = ("seller_id", *SELLER, "valid_from", "valid_to", "is_current")
    fact = ("order_id", "current_status", "hours_total", "item_count", "order_value", "end_reason")
    customers = [*CONTRACTS["customers"].columns]
    return reconcile.evaluate([
        reconcile.Check("items", silver_items(spark, folder), _by_window(good(items), ITEM, *delivered), tuple(ITEM)),
        reconcile.Check("order_changes", change_log(spark, folder), log, ("order_id", "change_seq", "order_status")),
        reconcile.Check("orders", silver_orders(spark, folder), last, ("order_id", "change_seq", "order_status")),
        reconcile.Check("customers", silver_customers(spark, folder), _by_window(good(checked(spark, folder, "customers")), ["customer_id"], *latest), tuple(customers)),
        reconcile.Check("products", silver_products(spark, folder).select("product_id"), table(spark, folder, "products").where("product_id IS NOT NULL").select("product_id").distinct()),
        reconcile.Check("dim_seller", seller_dimension(spark, folder), stored.read("sellers"), seller),
        reconcile.Check("fact_order_fulfillment", order_fact(spark, folder), inc_fulfillment(spark, folder), fact),
        reconcile.Check("quarantine", kept, aside, as_set=True),
        reconcile.Check("dq_metrics", counted, hits, as_set=True),
    ])


def rec_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of items against the items themselves: the rows that de-duplication takes away, and none besides."""
    rows = table(spark, folder, "order_items").where(~quality.missing(*ITEM)).select(*ITEM)
    return reconcile.difference(rows, rows.distinct())


def rpl_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    steps = [("order_purchase_ts", "created"), *[(c, s) for s, c in MILESTONES.items()]]
    orders = silver_orders(spark, folder).where(F.col("order_purchase_ts").isNotNull()).select("order_id", "order_status", *[c for c, _ in steps])
    out = replay.lifecycle(orders, "order_id", steps, "order_status")
    return out.select("order_id", F.col("change_seq").cast("int").alias("change_seq"), "change_ts", "state", F.col("order_delivered_customer_ts").isNotNull().alias("shows_delivery"))


def rpl_manifest(spark: SparkSession, folder: str) -> DataFrame:
    items = silver_items(spark, folder).withColumn("_delivery_date", replay.delivery_day("order_purchase_ts", BACKFILL))
    out = replay.inject(items, ITEM, "_delivery_date", replay.ITEM_FAULTS, LAST_DELIVERY, BACKFILL)
    return replay.manifest(out, "order_items", "_delivery_date").select(day_int("batch_date").alias("batch_day"), "feed", "row_count", F.to_json("injected").alias("injected"))


LAST_DELIVERY = dt.date(2024, 5, 10)


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables in the form that raw files have: all text, without lineage."""
    text = lambda df, **names: df.select(*[F.col(c).cast("string").alias(n) for n, c in names.items()])
    o = "order_id", "customer_id", "order_status"
    orders = text(silver_orders(spark, folder), **{c: c for c in o}, order_purchase_timestamp="order_purchase_ts", order_approved_at="order_approved_ts", order_delivered_carrier_date="order_delivered_carrier_ts", order_delivered_customer_date="order_delivered_customer_ts", order_estimated_delivery_date="order_estimated_delivery_ts")
    items = text(silver_items(spark, folder), **{c: c for c in ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")}, shipping_limit_date="shipping_limit_ts")
    products = silver_products(spark, folder)
    return {
        "orders": orders, "items": items, "customers": text(silver_customers(spark, folder), **{c: c for c in CONTRACTS["customers"].columns}), "reviews": reviews(spark, folder),
        "sellers": text(deliver_once(table(spark, folder, "sellers"), ["seller_id"], ("_batch_date", "_ingested_at"), first=False), **{c: c for c in CONTRACTS["sellers"].columns}),
        "products": text(products, **{c: c for c in ("product_id", "product_category_name", "product_weight_g", "product_photos_qty")}),
        "translation": text(products.where("product_category_name IS NOT NULL").groupBy("product_category_name").agg(F.min("product_category_name_english").alias("e")), product_category_name="product_category_name", product_category_name_english="e"),
    }


def rpl_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """The feeds built from raw tables: rows by feed and day of delivery, with one value of each that only its join brings."""
    plan = replay.Plan(BACKFILL, (LAST_DELIVERY - BACKFILL).days)
    out = []
    for name, feed in replay.feeds(raw_tables(spark, folder), plan).items():
        brings = {"order_items": "order_purchase_ts", "products": "product_category_name_english"}.get(name, feed.columns[0])
        out.append(feed.groupBy(day_int("_delivery_date").alias("batch_day")).agg(F.count("*").alias("row_count"), F.count(brings).alias("held")).select(F.lit(name).alias("feed"), "batch_day", "row_count", "held"))
    return reduce(lambda a, b: a.unionByName(b), out)


def rpl_delivered(spark: SparkSession, folder: str) -> DataFrame:
    """A replay prepared, its first two days delivered: what lies in the landing folders against the manifest."""
    at = scratch(spark, "replay")
    player = Replay(Store(spark, f"{at}/tables"), at, replay.Plan(BACKFILL, (LAST_DELIVERY - BACKFILL).days))
    player.prepare(raw_tables(spark, folder))
    days = [player.deliver(player.next_day()) for _ in range(2)]
    planned = player.manifest().where(F.col("delivered_at").isNotNull()).select("feed", "batch_date", "row_count")
    landed = reduce(lambda a, b: a.unionByName(b), [
        landing.scan(spark, f"{at}/landing/{n}", CONTRACTS[n]).groupBy(F.col("_batch_date").alias("batch_date")).agg(F.count("*").alias("landed")).select(F.lit(n).alias("feed"), "batch_date", "landed")
        for n in ("orders_cdc", "order_items", "customers", "reviews", "sellers", "products")
    ])
    return planned.join(landed, ["feed", "batch_date"], "full").select("feed", day_int("batch_date").alias("batch_day"), (F.col("row_count") == F.col("landed")).alias("all_landed"), F.lit(len(days)).alias("days"))


# -- reports


def _frames(spark: SparkSession, folder: str) -> dict:
    return {
        "metrics": lambda: _metrics(spark, folder), "fact": lambda: item_fact(spark, folder), "orders_fact": lambda: order_fact(spark, folder),
        "backlog": lambda: backlog(spark, folder), "mart": lambda: mart(spark, folder), "dim_date": lambda: star.date_dimension(spark, FIRST_DAY, LAST_DAY),
        "dim_seller": lambda: seller_dimension(spark, folder), "gate": lambda: quality.gate(_metrics(spark, folder), THRESHOLD),
        "gates": lambda: quality.gate(_metrics(spark, folder), THRESHOLD, run="batch_date"),
        "bad": lambda: quality.quarantine(checked_items(spark, folder), CONTRACTS["order_items"].columns, "order_items"),
    }


def _report(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        text, made = reports.REPORTS[name].sql(), _frames(spark, folder)
        used = {n: make() for n, make in made.items() if f"{{{n}}}" in text}
        out = spark.sql(text, **used)
        if name == "bi_dq_ratio":  # with the threshold as a series of its own
            out = out.unionByName(reports.REPORTS["bi_dq_threshold"].run(spark, metrics=used["metrics"]))
        return out

    run.__name__ = name
    return run


QUERIES = {f.__name__: f for f in (
    src_lineage, src_parse_lines, src_csv, src_snapshots, src_rescued_fields, src_one_day, str_ingest, str_ingest_parquet, str_upsert, str_two_streams, slv_items, slv_changes, slv_orders, slv_customers, slv_products,
    slv_reviews, dq_metrics, dq_fired, dq_duplicates, dq_loaded, dq_quarantine, dq_rule_hits, dq_reviews, dq_observed, dq_milestones, dq_gate, dq_gate_latest, gate_run, mrg_insert_new, mrg_upsert, mrg_update, mrg_overwrite,
    mrg_delete_missing, mrg_guarded_delete, mrg_forward_only, mrg_hash_guarded, cdf_changes, scd_one_pass, scd_applied, late_outcomes, gold_dim_date, gold_dim_customer, gold_dim_product, gold_fact_order_item,
    gold_fact_order_fulfillment, gold_fact_daily_backlog, gold_mart_seller, inc_totals, inc_stats, inc_fulfillment, rec_checks, rec_difference, rpl_lifecycle, rpl_manifest, rpl_feeds, rpl_delivered,
    *[_report(n) for n in reports.REPORTS if n != "bi_dq_threshold"],
)}
