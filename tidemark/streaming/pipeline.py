"""The daily run: files to bronze, rules and merges to silver, histories, gate, derived tables."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field
from dataclasses import replace as dc_replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import incremental, quality, reconcile, replay, scd, star
from tidemark.operators.changes import is_delete
from tidemark.operators.once import DELIVERY, deliver_once
from tidemark.operators.rules import rules_of
from tidemark.sources.contracts import CONTRACTS, LINEAGE
from tidemark.sources.files import names_in
from tidemark.sources.store import Store, merge_forward_only, merge_hash_guarded, merge_insert_new, merge_upsert
from tidemark.streaming.ingest import append_once, each_batch, ingest
from tidemark.streaming.replayer import Replay, raw_files

METRICS, QUARANTINE, GATE, JUDGED, RECONCILED = "ops.dq_metrics", "ops.quarantine", "ops.dq_gate_log", "ops.dq_gate_judged", "ops.reconcile_log"
ITEM_FACT, ORDER_FACT, BACKLOG, MART = "gold.fact_order_item", "gold.fact_order_fulfillment", "gold.fact_daily_order_backlog", "gold.mart_seller"

#: What of several deliveries of one key stands: the latest, a review's by its answer.
LATEST = {"reviews": ("_batch_date", "review_answer_ts", "_ingested_at", "_source_file")}
#: The tables that every run appends to.
METRIC = "table_name string, batch_date date, rule string, severity string, failed_rows bigint, total_rows bigint, batch_number int, run_id string, measured_at timestamp"
ASIDE = "table_name string, batch_date date, failed_rules array<string>, record string, raw string, source_file string, run_id string, quarantined_at timestamp"
DECISION = "table_name string, bad_rows bigint, total_rows bigint, bad_ratio double, threshold double, passed boolean, run_id string, evaluated_at timestamp"


@dataclass(frozen=True)
class Config:
    """Paths and policy of a pipeline."""

    base: str
    backfill: dt.date
    allowed_days: int = 3
    max_bad_ratio: float = 0.05
    buckets: int = 8
    cancelled: tuple[str, ...] = ("canceled", "unavailable")
    open: tuple[str, ...] = ("created", "approved", "invoiced", "processing", "shipped")
    calendar: tuple[dt.date, dt.date] = (dt.date(2023, 1, 1), dt.date(2025, 12, 31))
    #: Names what a run writes in metrics, quarantine and logs; one is made up where none is given.
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    replay_days: int = 10
    poison: dt.date | None = None
    #: Folders a bucket may consist of before it is written as one.
    compact_after: int = 16

    def path(self, *parts: str) -> str:
        return "/".join([self.base.rstrip("/"), *parts])


class Pipeline:
    """One engine over one base folder."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.store = Store(spark, config.path("tables"))

    # -- replay

    def replay(self) -> Replay:
        return Replay(self.store, self.config.base, replay.Plan(self.config.backfill, self.config.replay_days, self.config.poison))

    def setup(self) -> None:
        """Makes the tables that every run appends to, so that readers find them before the first run."""
        for name, schema in ((METRICS, METRIC), (QUARANTINE, ASIDE), (GATE, DECISION)):
            self.store.ensure(name, self.spark.createDataFrame([], schema).schema)

    def prepare(self, force: bool = False) -> None:
        """Plans a replay of the raw files below ``source``."""
        self.replay().prepare(raw_files(self.spark, self.config.path("source")), force)

    def replay_next(self, day: dt.date | None = None) -> dt.date | None:
        """Delivers a day, by default the next; None where all were delivered."""
        player = self.replay()
        day = day or player.next_day()
        return day and player.deliver(day)

    def run_local(self) -> list[tuple[dt.date, str]]:
        """Setup, a new plan, and a run for each day, named after it; what a gate said of a day is noted and the next goes on."""
        self.setup()
        self.prepare()
        out = []
        while (day := self.replay_next()) is not None:
            self.config = dc_replace(self.config, run_id=f"local-{day.isoformat()}")
            try:
                self.run()
                out.append((day, "published"))
            except quality.GateError as e:
                out.append((day, str(e)))
        return out

    # -- bronze and silver

    def bronze(self) -> None:
        for name, c in CONTRACTS.items():
            if names_in(self.spark, self.config.path("landing", name)):
                ingest(self.spark, self.config.path("landing", name), self.config.path("bronze", name), self.config.path("checkpoints", f"bronze-{name}"), c)

    def _stamped(self, rows: DataFrame, time: str) -> DataFrame:
        return rows.withColumn("run_id", F.lit(self.config.run_id)).withColumn(time, F.current_timestamp())

    def _rules(self, feed: str, rows: DataFrame) -> list[quality.Rule]:
        return rules_of(feed, rows, allowed_days=self.config.allowed_days, backfill=self.config.backfill)

    def _checked(self, rows: DataFrame, feed: str, number: int) -> DataFrame:
        """Metrics and quarantine of a batch, written once; the good rows come back."""
        rules = self._rules(feed, rows)
        seen = quality.evaluate(rows, rules)
        found = quality.metrics(seen, rules, feed).withColumn("batch_number", F.lit(number))
        append_once(self.store, METRICS, self._stamped(found, "measured_at"), feed, number)
        aside = quality.quarantine(seen, [c for c in CONTRACTS[feed].columns if c in rows.columns], feed)
        append_once(self.store, QUARANTINE, self._stamped(aside, "quarantined_at"), feed, number)
        return quality.split(seen)[0]

    def _repeats(self, good: DataFrame, feed: str, target: str, keys: list[str], number: int) -> None:
        """What of a batch comes twice, or was loaded before: told, and judged by no gate."""
        loaded = self.store.read(target) if self.store.exists(target) else None
        found = quality.duplicate_metrics(good, keys, feed, loaded=loaded).withColumn("batch_number", F.lit(number))
        append_once(self.store, METRICS, self._stamped(found, "measured_at"), f"{target}-duplicates", number)

    def _stream(self, source: str, target: str, apply) -> None:
        at = self.config.path("bronze", source)
        if any(n.endswith(".parquet") for n in names_in(self.spark, at)):
            each_batch(self.spark, at, self.config.path("checkpoints", f"silver-{target}"), apply)

    def silver(self) -> None:
        """Products first: items are checked against them. Two streams read the change feed, each with its checkpoint."""
        self._stream("products", "products", lambda b, n: self._upsert("products", b, n))
        self._stream("order_items", "order_items", self._items)
        self._stream("orders_cdc", "orders", self._orders)
        self._stream("orders_cdc", "order_changes", self._order_changes)
        for name in ("customers", "reviews"):
            self._stream(name, name, lambda b, n, name=name: self._upsert(name, b, n))

    def scd2(self) -> None:
        """The history of sellers, snapshot by snapshot."""
        self._stream("sellers", "seller_history", self._sellers)

    def _upsert(self, name: str, batch: DataFrame, number: int) -> None:
        c = CONTRACTS[name]
        good = self._checked(batch, name, number)
        rows = deliver_once(good.select(*c.columns, *LINEAGE), list(c.keys), LATEST.get(name, DELIVERY), first=False)
        self.store.ensure(f"silver.{name}", rows.schema, list(c.keys), self.config.buckets)
        merge_upsert(self.store, f"silver.{name}", rows, list(c.keys), newer="_batch_date", txn=(name, number))

    def _items(self, batch: DataFrame, number: int) -> None:
        c, keys = CONTRACTS["order_items"], ["order_id", "order_item_id"]
        known = self.store.read("silver.products") if self.store.exists("silver.products") else self.spark.createDataFrame([], "product_id string")
        good = self._checked(quality.known_flag(batch, "product_id", known, "_known"), "order_items", number)
        self._repeats(good, "order_items", "silver.order_items", keys, number)
        rows = with_lateness(deliver_once(good.select(*c.columns, *LINEAGE), keys), "order_purchase_ts", self.config.backfill)
        self.store.ensure("silver.order_items", rows.schema, keys, self.config.buckets)
        merge_insert_new(self.store, "silver.order_items", rows, keys, txn=("order_items", number))
        self.store.compact("silver.order_items", self.config.compact_after)

    def orders(self) -> DataFrame:
        """The orders that exist. ``silver.orders`` keeps deletes too, so that a late change can't bring an order back."""
        return self.store.read("silver.orders").where(~is_delete())

    def _orders(self, batch: DataFrame, number: int) -> None:
        good = self._checked(batch, "orders_cdc", number)
        rows = deliver_once(good.select(*CONTRACTS["orders_cdc"].columns, *LINEAGE), ["order_id"], ("change_seq", "_ingested_at"), first=False)
        self.store.ensure("silver.orders", rows.schema, ["order_id"], self.config.buckets)
        merge_forward_only(self.store, "silver.orders", rows, ["order_id"], "change_seq", txn=("orders", number))

    def _order_changes(self, batch: DataFrame, number: int) -> None:
        keys = ["order_id", "change_seq"]
        good = quality.split(quality.evaluate(batch, self._rules("orders_cdc", batch)))[0]
        self._repeats(good, "orders_cdc", "silver.order_changes", keys, number)
        rows = deliver_once(good.select(*CONTRACTS["orders_cdc"].columns, *LINEAGE), keys)
        self.store.ensure("silver.order_changes", rows.schema, keys, self.config.buckets)
        merge_insert_new(self.store, "silver.order_changes", rows, keys, txn=("order_changes", number))
        self.store.compact("silver.order_changes", self.config.compact_after)

    def _sellers(self, batch: DataFrame, number: int) -> None:
        good = self._checked(batch, "sellers", number)
        scd.apply_snapshots(self.store, "silver.seller_history", good, "seller_id", [a for a in CONTRACTS["sellers"].columns if a != "seller_id"])

    # -- gate and gold

    def gate(self) -> None:
        """Judges all that was taken in since the gate last passed, whatever its days; blocks by raising. What a blocked
        gate has judged is judged again with what comes in after it, since none of it has been published. Every decision is
        logged with the run and the time."""
        if not self.store.exists(METRICS):
            return
        found = self.store.read(METRICS).where(F.col("rule") == quality.ALL)
        if self.store.exists(JUDGED):
            done = self.store.read(JUDGED).select("table_name", F.col("batch_number").alias("_done"))
            found = found.join(done, "table_name", "left").where(F.col("_done").isNull() | (F.col("batch_number") > F.col("_done"))).drop("_done")
        if found.isEmpty():
            return
        decisions = quality.gate(found, self.config.max_bad_ratio)
        self.store.append(GATE, self._stamped(decisions, "evaluated_at"))
        quality.enforce(decisions)
        judged = found.groupBy("table_name").agg(F.max("batch_number").alias("batch_number"))
        self.store.ensure(JUDGED, judged.schema, ["table_name"])
        self.store.merge(JUDGED, judged, ["table_name"])

    def gold(self, full: bool = False) -> None:
        """Facts refreshed from what changed in their sources, backlog kept by a merge, dimensions written anew."""
        s = self.store
        if s.exists("silver.products"):
            s.overwrite("gold.dim_product", self._dim_product())
        sources = ["silver.order_items", "silver.orders", "silver.customers", "silver.seller_history"]
        if not all(s.exists(x) for x in [*sources, "silver.order_changes"]):
            return
        ids = lambda c: c.select("order_id")
        of_customers = lambda c: s.read("silver.orders").join(c.select("customer_id").distinct(), "customer_id", "left_semi").select("order_id")
        mapping = {
            "silver.order_items": ids,
            "silver.orders": ids,
            "silver.order_changes": ids,
            "silver.reviews": ids,
            "silver.customers": of_customers,
            "silver.seller_history": lambda c: s.read("silver.order_items").join(c.select("seller_id").distinct(), "seller_id", "left_semi").select("order_id"),
        }
        s.overwrite("gold.dim_customer", self._dim_customer())
        s.overwrite("gold.dim_seller", self._dim_seller())

        def refresh(name: str, keys: list[str], sources: list[str], make, whole: bool = False) -> None:
            """``whole``: built from all orders whenever any changed."""

            def build(changed: DataFrame | None) -> None:
                changed = None if whole else changed
                fact = make(changed)
                hashed = fact.withColumn("row_hash", star.row_hash(fact, keys))
                s.ensure(name, hashed.schema, keys, self.config.buckets)
                self._merge_fact(name, hashed, keys, changed)

            incremental.refresh(s, name, sources, mapping, build, full, total=lambda: s.read("silver.orders").select("order_id"))

        refresh(ITEM_FACT, ["order_id", "order_item_id"], sources, self._item_fact)
        before = s.version(ORDER_FACT)
        logged = ["silver.order_changes", "silver.order_items", "silver.customers"]
        refresh(ORDER_FACT, ["order_id"], [*logged, *(["silver.reviews"] if s.exists("silver.reviews") else [])], self._order_fact)
        if s.version(ORDER_FACT) != before:
            self._milestone_metric()
        refresh(BACKLOG, ["snapshot_date_key", "order_status", "customer_state"], logged, lambda _: self._backlog(), whole=True)
        s.overwrite("gold.dim_date", self._dim_date())

    def _item_fact(self, changed: DataFrame | None = None) -> DataFrame:
        s = self.store
        return star.item_fact(incremental.only(s.read("silver.order_items"), changed), incremental.only(s.read("silver.orders"), changed), s.read("silver.customers"), self._dim_seller(), list(self.config.cancelled))

    def _order_fact(self, changed: DataFrame | None = None) -> DataFrame:
        s = self.store
        log, items, scores = (incremental.only(x, changed) for x in (s.read("silver.order_changes"), s.read("silver.order_items"), self._scores()))
        return star.fulfillment_fact(log, items, s.read("silver.customers"), scores, list(self.config.cancelled))

    def _backlog(self) -> DataFrame:
        s = self.store
        return star.backlog_fact(s.read("silver.order_changes"), s.read("silver.order_items"), s.read("silver.customers"), list(self.config.open))

    def _scores(self) -> DataFrame:
        if not self.store.exists("silver.reviews"):
            return self.spark.createDataFrame([], "order_id string, score int")
        return self.store.read("silver.reviews").select("order_id", F.col("review_score").alias("score"))

    def _dim_product(self) -> DataFrame:
        return self.store.read("silver.products").select(*CONTRACTS["products"].columns)

    def _dim_customer(self) -> DataFrame:
        attributes = ["customer_zip_code_prefix", "customer_city", "customer_state"]
        return star.person_dimension(self.store.read("silver.customers"), self.orders(), "customer_unique_id", "customer_id", attributes, "order_purchase_ts")

    def _dim_seller(self) -> DataFrame:
        return self.store.read("silver.seller_history").drop("attr_hash", "seen_on").withColumnRenamed("version_key", "seller_sk")

    def _dim_date(self) -> DataFrame:
        """The calendar from the first to the last day that a fact has, at least that of the config."""
        s, first, last = self.store, *self.config.calendar
        days = {ITEM_FACT: ["order_purchase_ts"], ORDER_FACT: [f"{m}_ts" for m in ("purchase", "approved", "shipped", "delivered", "estimated")], BACKLOG: ["snapshot_date"]}
        for name, columns in days.items():
            found = s.read(name).agg(*[f(F.to_date(c)) for c in columns for f in (F.min, F.max)]).first()
            seen = [d for d in found if d is not None]
            first, last = min([first, *seen]), max([last, *seen])
        return star.date_dimension(self.spark, first, last)

    def _milestone_metric(self) -> None:
        """Warns of orders whose milestones contradict each other; the gate doesn't judge it."""
        found = quality.table_metric(self.store.read(ORDER_FACT), "fact_order_fulfillment", "inconsistent_milestones", F.col("has_inconsistent_milestones"))
        self.store.append(METRICS, self._stamped(found.withColumn("batch_number", F.lit(None).cast("int")), "measured_at"))

    def mart(self) -> None:
        if self.store.exists(ITEM_FACT) and self.store.exists("gold.dim_seller"):
            self.store.overwrite(MART, self._mart())

    def _mart(self) -> DataFrame:
        return star.seller_mart(self.store.read(ITEM_FACT), self._scores(), self.store.read("gold.dim_seller"))

    def _bronze(self, feed: str) -> DataFrame:
        return self.spark.read.parquet(self.config.path("bronze", feed))

    def _judged_whole(self, feed: str) -> DataFrame:
        rows = self._bronze(feed)
        if feed == "order_items":
            rows = quality.known_flag(rows, "product_id", self.store.read("silver.products"), "_known")
        return quality.evaluate(rows, self._rules(feed, rows))

    def _silver_anew(self, feed: str, keys: list[str], *order: Column) -> DataFrame:
        """What the whole feed gives in one batch, by a window."""
        ranked = Window.partitionBy(*keys).orderBy(*order)
        good = quality.split(self._judged_whole(feed))[0]
        return good.where(~quality.missing(*keys)).withColumn("_n", F.row_number().over(ranked)).where("_n = 1").drop("_n")

    def checks(self) -> list[reconcile.Check]:
        """What is kept, held against what the whole of bronze and silver gives anew: six silver tables, four dimensions, three
        facts, the mart, and as sets the quarantine and the metrics of rules that fired. Tables not made yet are left out."""
        s, c = self.store, CONTRACTS
        first, newest = [F.col(x) for x in DELIVERY], F.desc("_batch_date")
        items = lambda: with_lateness(self._silver_anew("order_items", ["order_id", "order_item_id"], *first), "order_purchase_ts", self.config.backfill)
        answered = F.desc_nulls_last("review_answer_ts")
        silver = {
            "silver.orders": ("orders_cdc", lambda: self._silver_anew("orders_cdc", ["order_id"], F.desc("change_seq"), F.desc("_ingested_at"))),
            "silver.order_changes": ("orders_cdc", lambda: self._silver_anew("orders_cdc", ["order_id", "change_seq"], *first)),
            "silver.order_items": ("order_items", items),
            "silver.customers": ("customers", lambda: self._silver_anew("customers", ["customer_id"], newest, F.desc("_ingested_at"), F.desc("_source_file"))),
            "silver.reviews": ("reviews", lambda: self._silver_anew("reviews", list(c["reviews"].keys), newest, answered, F.desc("_ingested_at"))),
            "silver.products": ("products", lambda: self._silver_anew("products", ["product_id"], newest, F.desc("_ingested_at"), F.desc("_source_file"))),
        }
        more = {"silver.order_items": ["event_date", "arrival_lag_days"]}
        out = [reconcile.Check(name, make(), s.read(name), tuple([*c[feed].columns, *more.get(name, [])])) for name, (feed, make) in silver.items() if s.exists(name)]
        gold = {
            "gold.dim_date": self._dim_date, "gold.dim_product": self._dim_product, "gold.dim_customer": self._dim_customer, "gold.dim_seller": self._dim_seller,
            ITEM_FACT: self._item_fact, ORDER_FACT: self._order_fact, BACKLOG: self._backlog, MART: self._mart,
        }
        for name, make in gold.items():
            if s.exists(name):
                again = make()
                out.append(reconcile.Check(name, again, s.read(name), tuple(again.columns)))
        feeds = [n for n in CONTRACTS if any(x.endswith(".parquet") for x in names_in(self.spark, self.config.path("bronze", n)))]
        if s.exists(QUARANTINE) and feeds:
            judged = {n: self._judged_whole(n) for n in feeds if n != "order_items" or s.exists("silver.products")}
            aside = [quality.quarantine(df, [x for x in c[n].columns if x in df.columns], n) for n, df in judged.items()]
            out.append(reconcile.Check(QUARANTINE, reduce(lambda a, b: a.unionByName(b), aside), s.read(QUARANTINE), ("table_name", "batch_date", "failed_rules", "record"), as_set=True))
            found = [quality.metrics(df, self._rules(n, df), n) for n, df in judged.items()]
            kept = s.read(METRICS).where(F.col("severity").isin(quality.ERROR, quality.WARN) & F.col("batch_date").isNotNull())
            kept = kept.groupBy("table_name", "batch_date", "rule", "severity").agg(F.sum("failed_rows").alias("failed_rows"), F.sum("total_rows").alias("total_rows"))
            columns = ("table_name", "batch_date", "rule", "severity", "failed_rows", "total_rows")
            out.append(reconcile.Check(METRICS, reduce(lambda a, b: a.unionByName(b), found), kept, columns, f"failed_rows > 0 OR rule IN ('{quality.ALL}', '{quality.RESCUED}')", as_set=True))
        return out

    def reconcile(self) -> None:
        """Evaluates all checks, logs each with run and time, and raises where two sides differ."""
        checks = self.checks()
        if checks:
            results = reconcile.evaluate(checks)
            self.store.append(RECONCILED, self._stamped(results, "evaluated_at"))
            mine = self.store.read(RECONCILED).where(F.col("run_id") == self.config.run_id)
            reconcile.enforce(mine.where(F.col("evaluated_at") == mine.agg(F.max("evaluated_at")).scalar()))

    def _merge_fact(self, name: str, hashed: DataFrame, keys: list[str], changed: DataFrame | None) -> None:
        incremental.merge_rebuilt(self.store, name, hashed, keys, changed)

    def run(self) -> None:
        """A whole run; a blocked gate stops it before derived tables."""
        self.bronze()
        self.silver()
        self.scd2()
        self.gate()
        self.gold()
        self.mart()


def with_lateness(rows: DataFrame, event_time: str, backfill: dt.date) -> DataFrame:
    """Adds the event's day and how many days after it the row came; 0 in the backfill."""
    lag = F.when(F.col("_batch_date") > F.lit(backfill), F.date_diff("_batch_date", F.to_date(event_time))).otherwise(F.lit(0))
    return rows.withColumn("event_date", F.to_date(event_time)).withColumn("arrival_lag_days", lag)
