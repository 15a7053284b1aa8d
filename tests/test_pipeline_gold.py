"""The daily run keeps the whole star schema."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_landing_pipeline import DAYS, deliver, item, order
from tidemark import cli
from tidemark.streaming.pipeline import BACKLOG, MART, METRICS, ORDER_FACT, Config, Pipeline


def test_run_keeps_every_gold_table(spark, tmp_path, rows):
    base = f"file://{tmp_path}"
    p = Pipeline(spark, Config(base, DAYS[0], buckets=2))
    old = dt.date(1970, 1, 2)
    deliver(spark, base, DAYS[0], [item("o1", 1, "p", DAYS[0]), item("o2", 1, "p", old)], [order("o1", "created", 1, DAYS[0]), order("o2", "created", 1, DAYS[0])], [("c-o1", "u", "1", "A", "X")], [("s", "1", "A", "X")], [("p", "cat", "cat", 1, 1)])
    p.run()
    deliver(spark, base, DAYS[1], orders=[order("o1", "delivered", 2, DAYS[0]), order("o2", "shipped", 2, DAYS[1])])
    p.run()
    assert rows(p.store.read(ORDER_FACT), "order_id", "current_status") == [("o1", "delivered"), ("o2", "shipped")]
    assert rows(p.store.read(BACKLOG), "snapshot_date_key", "order_status", "open_orders") == [(20240331, "created", 1), (20240401, "shipped", 1)]
    assert rows(p.store.read(MART), "seller_id", "year_month", "orders") == [("s", "1970-01", 1), ("s", "2024-03", 1)]
    assert [p.store.read(f"gold.dim_{d}").count() for d in ("customer", "product", "seller")] == [1, 1, 1]
    assert p.store.read("gold.dim_date").where(F.col("date_key").isin(19700102, 20251231, -1)).count() == 3
    assert p.store.read(METRICS).where("rule = 'inconsistent_milestones'").count() == 2
    versions = {t: p.store.version(t) for t in (ORDER_FACT, BACKLOG, METRICS)}
    p.run()  # nothing new
    assert versions == {t: p.store.version(t) for t in versions}
    assert cli.main(["reconcile", "--base", base], spark) == 0
    p.store.update(ORDER_FACT, F.col("order_id") == "o1", current_status=F.lit("lost"))
    assert cli.main(["reconcile", "--base", base], spark) == 3
