"""Replay of a static data set as dated deliveries with counted faults.

What happens to a row is decided by a hash bucket of its key, so a replay is the same wherever and however often it runs,
and each fault's rows can be counted against what the pipeline reports.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 10_000


@dataclass(frozen=True)
class Fault:
    """Rows of the buckets ``first <= b < end`` are hit: ``repeat`` after so many days, delivered ``delay`` days late (up to
    ``jitter - 1`` more, by the bucket), or with columns set anew (to a column, or an expression as text). ``only`` limits it to
    a day of delivery, ``where`` to rows for which it is true."""

    name: str
    first: int
    end: int
    repeat: int | None = None
    delay: int = 0
    values: tuple[tuple[str, Column | str], ...] = ()
    jitter: int = 1
    only: dt.date | None = None
    where: str | None = None

    def late(self) -> Column:
        return F.lit(self.delay) + F.pmod(F.col("_b"), F.lit(self.jitter)).cast("int")


#: The faults of a replay by ranges of buckets, their names and what they do.
TOLERANCE = 3
ITEM_FAULTS = [
    Fault("duplicate_same_batch", 0, 100, repeat=0),
    Fault("duplicate_next_batch", 100, 150, repeat=1),
    Fault("late_within_tolerance", 150, 300, delay=1, jitter=2),
    Fault("too_late", 300, 330, delay=TOLERANCE + 2),
    Fault("invalid_price", 330, 380, values=(("price", "-price"),)),
    Fault("missing_product_id", 380, 410, values=(("product_id", "CAST(NULL AS STRING)"),)),
    Fault("unknown_product_id", 410, 440, values=(("product_id", "concat('unknown-', product_id)"),)),
]
ORDER_FAULTS = [
    Fault("cdc_duplicate", 0, 100, repeat=0),
    Fault("cdc_out_of_order", 100, 250, delay=2),
    Fault("invalid_delivery_ts", 250, 300, values=(("order_delivered_customer_ts", "order_purchase_ts - INTERVAL 3 DAYS"),), where="order_delivered_customer_ts IS NOT NULL AND order_purchase_ts IS NOT NULL"),
]
POISON = Fault("poison_invalid_price", 1000, 2200, values=(("price", "-price"),))
NEW_FIELD, NEW_FIELD_AFTER = "discount_amount", 5
RELOCATIONS = {"seller_city": ["curitiba", "recife", "manaus", "goiania"], "seller_state": ["PR", "PE", "AM", "GO"]}
#: Which raw column each column of a feed is made of, and its type.
ITEM_COLUMNS = {
    "order_id": ("order_id", "string"), "order_item_id": ("order_item_id", "int"), "product_id": ("product_id", "string"), "seller_id": ("seller_id", "string"),
    "order_purchase_ts": ("order_purchase_timestamp", "timestamp"), "shipping_limit_ts": ("shipping_limit_date", "timestamp"), "price": ("price", "decimal(12,2)"), "freight_value": ("freight_value", "decimal(12,2)"),
}
ORDER_COLUMNS = {
    "order_id": ("order_id", "string"), "customer_id": ("customer_id", "string"), "final_status": ("order_status", "string"), "order_purchase_ts": ("order_purchase_timestamp", "timestamp"),
    "order_approved_ts": ("order_approved_at", "timestamp"), "order_delivered_carrier_ts": ("order_delivered_carrier_date", "timestamp"),
    "order_delivered_customer_ts": ("order_delivered_customer_date", "timestamp"), "order_estimated_delivery_ts": ("order_estimated_delivery_date", "timestamp"),
}
REVIEW_COLUMNS = {
    "review_id": ("review_id", "string"), "order_id": ("order_id", "string"), "review_score": ("review_score", "int"),
    "review_creation_ts": ("review_creation_date", "timestamp"), "review_answer_ts": ("review_answer_timestamp", "timestamp"),
}
PRODUCT_COLUMNS = {
    "product_id": ("product_id", "string"), "product_category_name": ("product_category_name", "string"), "product_category_name_english": ("product_category_name_english", "string"),
    "product_weight_g": ("product_weight_g", "int"), "product_photos_qty": ("product_photos_qty", "int"),
}
MILESTONES = [("order_purchase_ts", "created"), ("order_approved_ts", "approved"), ("order_delivered_carrier_ts", "shipped"), ("order_delivered_customer_ts", "delivered")]
DAY = "_delivery_date"


@dataclass(frozen=True)
class Plan:
    """The days of a replay: a backfill, and so many days after it; on ``poison`` many prices are bad."""

    backfill: dt.date
    days: int
    poison: dt.date | None = None
    seed: int = 42

    @property
    def last(self) -> dt.date:
        return self.backfill + dt.timedelta(days=self.days)

    def each(self) -> list[dt.date]:
        return [self.backfill + dt.timedelta(days=i) for i in range(self.days + 1)]


def bucket(seed: int, salt: str, *columns: str) -> Column:
    """A row's bucket from 0 to ``BUCKETS`` - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *columns), F.lit(BUCKETS))


def within(b: Column, first: int, end: int) -> Column:
    """True in the half-open range."""
    return (b >= first) & (b < end)


def delivery_day(event_time: str, backfill: dt.date) -> Column:
    """The day a row is delivered: that of its event, everything up to the backfill together."""
    return F.greatest(F.to_date(event_time), F.lit(backfill))


def lifecycle(orders: DataFrame, key: str, milestones: list[tuple[str, str]], final: str | None = None) -> DataFrame:
    """One after-image per state change of rows that hold a time per milestone.

    ``milestones``: (column, state) in their order. Each image shows only the milestones reached by then. If the last
    state isn't ``final`` (a column), a closing change an hour later brings it. Columns: all of ``orders``, ``change_seq``
    from 1, ``change_ts``, ``state``.
    """
    steps = F.filter(F.array(*[F.struct(F.col(c).alias("at"), F.lit(i).alias("rank"), F.lit(s).alias("state")) for i, (c, s) in enumerate(milestones)]), lambda x: x["at"].isNotNull())
    ordered = F.array_sort(steps)
    if final:
        last = F.try_element_at(ordered, F.lit(-1))
        closing = F.array(F.struct((last["at"] + F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit(len(milestones)).alias("rank"), F.col(final).alias("state")))
        ordered = F.when(F.col(final).isNotNull() & (last["state"] != F.col(final)), F.concat(ordered, closing)).otherwise(ordered)
    shown = [c for c, _ in milestones]
    rows = orders.select("*", F.posexplode(ordered).alias("_pos", "_step"))
    seen = {c: F.when(F.col(c) <= F.col("_step.at"), F.col(c)) for c in shown}
    return rows.select(*[seen[c].alias(c) if c in seen else F.col(c) for c in orders.columns], (F.col("_pos") + 1).alias("change_seq"), F.col("_step.at").alias("change_ts"), F.col("_step.state").alias("state"))


def inject(rows: DataFrame, keys: list[str], day: str, faults: list[Fault], last: dt.date, first: dt.date, seed: int = 42) -> DataFrame:
    """Rows as they will be delivered, with ``_fault`` naming what was done to a row (null for nothing).

    Ranges of faults must be disjoint. Only rows delivered after ``first`` (the backfill) are hit; a row whose delay or
    repeat would fall after ``last`` is left as it is, and isn't tagged, so that tags count what can be observed.
    """
    spans = sorted((f.first, f.end) for f in faults)
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
        raise ValueError("ranges of faults overlap")
    b = rows.withColumn("_b", bucket(seed, "fault", *keys))
    live = F.col(day) > F.lit(first)
    tag, out_day = F.lit(None).cast("string"), F.col(day)
    values: dict[str, Column] = {}
    for f in faults:
        late = F.greatest(f.late(), F.lit(f.repeat or 0))
        hit = live & within(F.col("_b"), f.first, f.end) & (F.date_add(F.col(day), late) <= F.lit(last))
        if f.only:
            hit = hit & (F.col(day) == F.lit(f.only))
        if f.where:
            hit = hit & F.coalesce(F.expr(f.where), F.lit(False))
        tag = F.when(hit, f.name).otherwise(tag)
        if f.delay:
            out_day = F.when(hit, F.date_add(F.col(day), late)).otherwise(out_day)
        for c, v in f.values:
            values[c] = F.when(hit, F.expr(v) if isinstance(v, str) else v).otherwise(values.get(c, F.col(c)))
    hit_rows = b.select(*[values[c].cast(b.schema[c].dataType).alias(c) if c in values else out_day.alias(c) if c == day else F.col(c) for c in rows.columns], tag.alias("_fault"))
    repeats = {f.name: f.repeat for f in faults if f.repeat is not None}
    if not repeats:
        return hit_rows
    again = F.create_map(*[x for k, v in repeats.items() for x in (F.lit(k), F.lit(v))])
    copies = F.when(F.col("_fault").isin(list(repeats)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    doubled = hit_rows.withColumn("_copy", F.explode(copies))
    shifted = F.when(F.col("_copy") == 1, F.date_add(F.col(day), F.try_element_at(again, F.col("_fault")))).otherwise(F.col(day))
    return doubled.select(*[shifted.alias(c) if c == day else F.col(c) for c in rows.columns], F.when((F.col("_copy") == 1) | ~F.col("_fault").isin(list(repeats)), F.col("_fault")).alias("_fault"))


def relocated(snapshots: DataFrame, key: str, day: str, days: list[dt.date], columns: dict[str, list[str]], part: int = 200, seed: int = 42) -> DataFrame:
    """Snapshots in which ``part`` of ``BUCKETS`` keys change their columns once, on a day that the key's hash picks and to a
    place it picks; ``_fault`` tags the first day of a change."""
    pick = bucket(seed, "day", key) % len(days)
    moves = within(bucket(seed, "moves", key), 0, part)
    on = F.element_at(F.array(*[F.lit(d) for d in days]), (pick + 1).cast("int"))
    place = (bucket(seed, "place", key) % len(next(iter(columns.values()))) + 1).cast("int")
    new = {c: F.element_at(F.array(*[F.lit(v) for v in vs]), place) for c, vs in columns.items()}
    differs = F.lit(False)
    for c, v in new.items():
        differs = differs | ~F.col(c).eqNullSafe(v)
    moved = moves & differs & (F.col(day) >= on)
    return snapshots.select(*[F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in snapshots.columns], F.when(moved & (F.col(day) == on), "relocated").alias("_fault"))


def project(rows: DataFrame, columns: dict[str, tuple[str, str]], kept: tuple[str, ...] = ()) -> DataFrame:
    """Raw text columns under the feed's names and types; what can't be read is null. ``kept`` are carried along."""
    return rows.select(*[F.col(raw).try_cast(kind).alias(name) for name, (raw, kind) in columns.items()], *kept)


def feeds(raw: dict[str, DataFrame], plan: Plan) -> dict[str, DataFrame]:
    """The feeds that raw tables (orders, items, customers, reviews, products, translation, sellers) turn into, each row with
    its day of delivery, up to the last day of the plan.

    Orders become changes, a row a state; items take the purchase time of their order and are left out without one, customers
    arrive with their first order; reviews need both keys; products take their category's translation if there is one; sellers
    are listed in full every day, a few moving once. Rows without a time are delivered with the backfill.
    """
    orders = project(raw["orders"], ORDER_COLUMNS).where(F.col("order_purchase_ts").isNotNull())
    states = lifecycle(orders, "order_id", MILESTONES, "final_status").withColumn("order_status", F.col("state")).withColumn("_op", F.lit(None).cast("string"))
    changes = states.select("order_id", "customer_id", "order_status", *[c for c in ORDER_COLUMNS if c.endswith("_ts")], F.col("change_seq").cast("int").alias("change_seq"), "change_ts", "_op")
    bought = raw["orders"].select("order_id", "order_purchase_timestamp")
    first = orders.groupBy("customer_id").agg(F.min("order_purchase_ts").alias("_seen"))
    people = raw["customers"].join(first, "customer_id")
    listed = raw["sellers"].withColumn(DAY, F.explode(F.array(*[F.lit(d) for d in plan.each()])))
    on = lambda df, time: df.withColumn(DAY, delivery_day(time, plan.backfill))
    made = {
        "orders_cdc": on(changes, "change_ts"),
        "order_items": on(project(raw["items"].join(bought, "order_id"), ITEM_COLUMNS), "order_purchase_ts"),
        "customers": on(people, "_seen").drop("_seen"),
        "reviews": on(project(raw["reviews"], REVIEW_COLUMNS).where(F.col("review_id").isNotNull() & F.col("order_id").isNotNull()), "review_creation_ts"),
        "products": project(raw["products"].join(raw["translation"], "product_category_name", "left"), PRODUCT_COLUMNS).withColumn(DAY, F.lit(plan.backfill)),
        "sellers": listed,
    }
    return {name: df.where(F.col(DAY) <= F.lit(plan.last)) for name, df in made.items()}


def with_faults(made: dict[str, DataFrame], plan: Plan) -> dict[str, DataFrame]:
    """The feeds as a replay delivers them: with faults, with sellers that move, and with a field that items have from some
    day on; ``_fault`` tags what was done."""
    items = inject(made["order_items"], ["order_id", "order_item_id"], DAY, [*ITEM_FAULTS, *([replace(POISON, only=plan.poison)] if plan.poison else [])], plan.last, plan.backfill, plan.seed)
    from_day = plan.backfill + dt.timedelta(days=1 + NEW_FIELD_AFTER)
    share = F.pmod(F.xxhash64("order_id"), F.lit(6)) / 100
    items = items.withColumn(NEW_FIELD, F.when(F.col(DAY) >= F.lit(from_day), F.round(F.col("price") * share, 2).cast("decimal(12,2)")))
    orders = inject(made["orders_cdc"], ["order_id", "change_seq"], DAY, ORDER_FAULTS, plan.last, plan.backfill, plan.seed)
    sellers = relocated(made["sellers"], "seller_id", DAY, plan.each()[1:] or plan.each(), RELOCATIONS, seed=plan.seed)
    return {**{n: df.withColumn("_fault", F.lit(None).cast("string")) for n, df in made.items()}, "order_items": items, "orders_cdc": orders, "sellers": sellers}


def stage(rows: DataFrame, at: str, day: str = DAY) -> None:
    """Writes rows by day of delivery, replacing what was staged before."""
    rows.repartition(F.col(day)).write.mode("overwrite").partitionBy(day).parquet(at)


def staged_day(spark: SparkSession, at: str, day: dt.date, column: str = DAY) -> DataFrame:
    """One day of what was staged; only its folder is read."""
    return spark.read.parquet(at).where(F.col(column) == F.lit(day))


def manifest(deliveries: DataFrame, feed: str, day: str, field: str | None = None) -> DataFrame:
    """One row a day: rows, the number of rows by fault as a map (empty for none), and those that hold ``field``."""
    held = F.count(field) if field in deliveries.columns else F.lit(0).cast("bigint")
    by_fault = deliveries.groupBy(day, "_fault").agg(F.count("*").alias("_n"), held.alias("_held"))
    injected = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("_fault").isNotNull(), F.struct("_fault", "_n")))))
    return by_fault.groupBy(F.col(day).alias("batch_date")).agg(F.lit(feed).alias("feed"), F.sum("_n").alias("row_count"), injected.alias("injected"), F.sum("_held").alias("new_field_rows"))


def next_undelivered(found: DataFrame):
    """The earliest day of a manifest with ``delivered_at`` still null, or None."""
    return found.where(F.col("delivered_at").isNull()).agg(F.min("batch_date")).first()[0]
