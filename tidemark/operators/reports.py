"""Reports: measures defined once, put together with what they are broken down by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: What the reports measure, over the frames named in braces where they are used.
MEASURES = {
    "gmv": "CAST(sum(price) FILTER (WHERE NOT is_cancelled) AS DECIMAL(38,2))",
    "item_value": "CAST(sum(price) AS DECIMAL(38,2))",
    "orders": "count(DISTINCT order_id)",
    "sold_orders": "count(DISTINCT CASE WHEN NOT is_cancelled THEN order_id END)",
    "on_time_rate": "round(avg(CAST(is_on_time AS INT)) FILTER (WHERE is_delivered), 6)",
    "row_count": "count(*)",
    "failed": "sum(failed_rows)",
    "bad_ratio": "round(try_divide(sum(failed_rows), sum(total_rows)), 6)",
    "open_orders": "sum(open_orders)",
    "avg_hours": "round(avg(hours), 1)",
    "avg_review_score": "round(avg(review_score), 2)",
    "mart_gmv": "sum(gmv)",
    "mart_orders": "sum(orders)",
    "mart_on_time_rate": "round(try_divide(sum(on_time_orders), sum(delivered_orders)), 3)",
    "avg_of_months": "round(avg(avg_review_score), 2)",
}


@dataclass(frozen=True)
class Report:
    """``source``: what is read, frames in braces; ``by``: name to expression; ``measures``: a name of ``MEASURES``, or name
    to one of these, or name to an expression; rows by ``where``, ``order`` and ``top`` (a report of so many rows)."""

    source: str
    by: tuple[tuple[str, str], ...] = ()
    measures: tuple[str | tuple[str, str], ...] = ()
    where: str = ""
    order: str = ""
    top: int = 0

    def sql(self) -> str:
        named = [(m, m) if isinstance(m, str) else m for m in self.measures]
        columns = [f"{e} AS {n}" for n, e in self.by] + [f"{MEASURES.get(e, e)} AS {n}" for n, e in named]
        parts = [f"SELECT {', '.join(columns)} FROM {self.source}", f"WHERE {self.where}" if self.where else "", "GROUP BY ALL" if self.by and self.measures else ""]
        parts += [f"ORDER BY {self.order}" if self.order else "", f"LIMIT {self.top}" if self.top else ""]
        return " ".join(p for p in parts if p)

    def run(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The report over frames given by name; nothing is registered in the session."""
        return spark.sql(self.sql(), **frames)


def steps(column: str, bounds: list[tuple[float, str]], beyond: str) -> str:
    """The label of the first bound that a value doesn't exceed."""
    return "CASE " + " ".join(f"WHEN {column} <= {b} THEN '{label}'" for b, label in bounds) + f" ELSE '{beyond}' END"


#: The bounds of lateness in hours and how the report names what lies up to them, and beyond.
LATENESS = [(-168, "1. 7+ days early"), (0, "2. 0-7 days early"), (72, "3. 1-3 days late"), (168, "4. 4-7 days late")]
LATER = "5. 8+ days late"
#: The stages of an order, and the numbers of top sellers.
STAGES = [("1 purchase → approved", "hours_to_approve"), ("2 approved → carrier", "hours_to_ship"), ("3 carrier → customer", "hours_in_transit")]
TOP, TOP_WITH_SCORES = 15, 20
#: Fixed value: the number of quarantined rows shown.
LATEST = 200

_DAY = lambda c: f"year({c}) * 10000 + month({c}) * 100 + day({c})"
_DAILY = ("batch_day", _DAY("batch_date"))
_AFTER = "failed_rows > 0 AND batch_date > DATE'2024-03-31'"
_SELLER = (("seller_id", "seller_id"), ("seller_state", "seller_state"))
_SELLER_MEASURES = (("gmv", "mart_gmv"), ("orders", "mart_orders"), ("on_time_rate", "mart_on_time_rate"), ("avg_review_score", "avg_of_months"))
_STACKED = "(SELECT purchase_ts, stage, hours FROM {orders_fact} LATERAL VIEW stack(3, " + ", ".join(f"'{n}', {c}" for n, c in STAGES) + ") s AS stage, hours)"

REPORTS = {
    "bi_kpi_ops": Report("{gate}", (), (("tables", "count(*)"), ("blocked", "count_if(NOT passed)"), ("quarantined", "(SELECT count(*) FROM {bad})"))),
    "bi_dq_ratio": Report("{metrics}", (_DAILY, ("series", "table_name")), ("bad_ratio",), "rule = '__all__'"),
    "bi_dq_threshold": Report("{metrics}", (_DAILY, ("series", "'threshold'")), (("bad_ratio", "max(CAST(0.05 AS DOUBLE))"),)),
    "bi_dq_errors": Report("{metrics}", (("rule", "rule"),), (("row_count", "failed"),), f"severity = 'error' AND rule <> '__all__' AND {_AFTER}"),
    "bi_dq_handled": Report("{metrics}", (("rule", "rule"),), (("row_count", "failed"),), f"severity IN ('info', 'warn') AND {_AFTER}"),
    "bi_dq_rules": Report("{metrics}", (_DAILY, ("table_name", "table_name"), ("rule", "rule"), ("severity", "severity")), (("row_count", "failed"),), "rule <> '__all__' AND failed_rows > 0"),
    "bi_dq_gate": Report("{gate}", tuple((c, c) for c in ("table_name", "bad_rows", "total_rows")) + (("bad_pct", "round(bad_ratio * 100, 2)"), ("passed", "passed")), (), "total_rows > 0", "table_name"),
    "bi_gate_history": Report("{gates}", (("run_day", _DAY("batch_date")),) + tuple((c, c) for c in ("table_name", "bad_rows", "total_rows")) + (("bad_pct", "round(bad_ratio * 100, 2)"), ("passed", "passed")), (), "", "run_day DESC, table_name"),
    "bi_dq_quarantine": Report("{bad}", (("rules", "array_join(failed_rules, ', ')"),), ("row_count",)),
    "bi_dq_latest": Report("{bad}", (_DAILY, ("table_name", "table_name"), ("rules", "array_join(failed_rules, ', ')"), ("order_id", "get_json_object(record, '$.order_id')"), ("raw", "raw"), ("source_file", "source_file")), (), "",
        "batch_day DESC NULLS LAST, source_file NULLS LAST, order_id NULLS LAST, rules, raw NULLS LAST", LATEST),
    "bi_kpi_biz": Report("{fact}", (), ("gmv", "orders", "sold_orders", "on_time_rate")),
    "bi_monthly": Report("{fact} f LEFT JOIN {dim_date} d ON d.date_key = f.order_date_key", (("year_month", "coalesce(d.year_month, 'outside the calendar')"),), ("gmv", "on_time_rate")),
    "bi_state": Report("{fact} f JOIN {dim_seller} s ON s.seller_sk = f.seller_sk", (("seller_state", "s.seller_state"),), ("orders", ("gmv", "item_value"), "on_time_rate"), "NOT is_cancelled"),
    "bi_stages": Report(_STACKED, (("month", "date_format(purchase_ts, 'yyyy-MM')"), ("stage", "stage")), ("avg_hours", ("orders", "row_count")), "hours IS NOT NULL"),
    "bi_backlog": Report("{backlog}", (("snapshot_date_key", "snapshot_date_key"), ("order_status", "order_status")), ("open_orders",)),
    "bi_lateness": Report("{orders_fact}", (("lateness", steps("hours_late", LATENESS, LATER)),), (("orders", "row_count"), "avg_review_score"), "delivered_ts IS NOT NULL AND review_score IS NOT NULL"),
    "bi_top_sellers": Report("{mart}", _SELLER, _SELLER_MEASURES, "", "gmv DESC NULLS LAST, seller_id", TOP),
    "bi_top_sellers_20": Report("{mart}", _SELLER, _SELLER_MEASURES, "", "gmv DESC NULLS LAST, seller_id", TOP_WITH_SCORES),
}
