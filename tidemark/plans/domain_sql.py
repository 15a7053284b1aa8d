"""The SQL (DuckDB) that states the results of the queries in ``plans.domain``."""

from __future__ import annotations

from tidemark.plans.found_sql import _VERSIONS, _day

STATES = "('created', 'approved', 'invoiced', 'processing', 'shipped', 'delivered', 'canceled', 'unavailable')"
OPEN = "('created', 'approved', 'invoiced', 'processing', 'shipped')"
DELETES = "('d', 'del', 'delete', 'deleted')"

_ITEM_RULES = {
    "malformed_record": "_malformed",
    "missing_key": "order_id IS NULL OR order_item_id IS NULL",
    "price_not_positive": "price IS NULL OR price <= 0",
    "freight_negative": "freight_value < 0",
    "missing_product_id": "product_id IS NULL",
    "unknown_product_id": "product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM products WHERE product_id IS NOT NULL)",
    "too_late": "_batch_date > DATE '2024-03-31' AND date_diff('day', CAST(order_purchase_ts AS DATE), _batch_date) > 3",
}
_CHANGE_RULES = {
    "missing_key": "order_id IS NULL OR change_seq IS NULL OR change_ts IS NULL",
    "unknown_status": f"order_status NOT IN {STATES}",
    "delivered_before_purchase": "order_delivered_customer_ts < order_purchase_ts",
    "change_before_purchase": "change_ts < order_purchase_ts",
}
_CUSTOMER_RULES = {"missing_key": "customer_id IS NULL OR customer_unique_id IS NULL"}


def _failed(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for n, c in rules.items()) + "], lambda x: x IS NOT NULL)"


_CHECKED_ITEMS = f"SELECT *, {_failed(_ITEM_RULES)} AS failed FROM order_items"
_CHECKED_CHANGES = f"SELECT *, {_failed(_CHANGE_RULES)} AS failed FROM orders_cdc"
_CHECKED_CUSTOMERS = f"SELECT *, {_failed(_CUSTOMER_RULES)} AS failed FROM customers"
_DELIVERED = "_batch_date NULLS LAST, _ingested_at NULLS LAST, _source_file NULLS LAST"

_ITEMS = f"""
  SELECT *, CAST(order_purchase_ts AS DATE) AS event_date,
    CASE WHEN _batch_date > DATE '2024-03-31' THEN CAST(date_diff('day', CAST(order_purchase_ts AS DATE), _batch_date) AS INTEGER) ELSE 0 END AS arrival_lag_days
  FROM ({_CHECKED_ITEMS}) WHERE len(failed) = 0
  QUALIFY row_number() OVER (PARTITION BY order_id, order_item_id ORDER BY {_DELIVERED}) = 1"""
_DELETED = f"lower(trim(coalesce(_op, ''))) IN {DELETES}"
#: Every change once, deletes too; of each order the change that decides.
_WHOLE_LOG = f"""
  SELECT *, {_DELETED} AS deleted FROM ({_CHECKED_CHANGES}) WHERE len(failed) = 0
  QUALIFY row_number() OVER (PARTITION BY order_id, change_seq ORDER BY {_DELIVERED}) = 1"""
_LOG = f"SELECT * FROM ({_WHOLE_LOG}) WHERE NOT deleted"
_LATEST = f"SELECT * FROM ({_WHOLE_LOG}) QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY change_seq DESC) = 1"
_ORDERS = f"SELECT * FROM ({_LATEST}) WHERE NOT deleted"
_GONE = f"SELECT order_id FROM ({_LATEST}) WHERE deleted"
_CUSTOMERS = f"""
  SELECT * FROM ({_CHECKED_CUSTOMERS}) WHERE len(failed) = 0
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _batch_date DESC NULLS LAST, _ingested_at DESC NULLS LAST, customer_city DESC NULLS LAST) = 1"""
_PRODUCTS = """
  SELECT * FROM products WHERE product_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY _batch_date DESC NULLS LAST, _ingested_at DESC NULLS LAST) = 1"""
_SCORES = f"""
  SELECT order_id, 1 + minute(order_purchase_ts) % 5 AS score FROM ({_ORDERS})
  WHERE order_delivered_customer_ts IS NOT NULL AND order_purchase_ts IS NOT NULL"""
_SELLERS = f"""
  SELECT seller_id, seller_city, seller_state, seller_zip_code_prefix,
    CASE WHEN row_number() OVER (PARTITION BY seller_id ORDER BY valid_from) = 1 THEN DATE '1900-01-01' ELSE valid_from END AS valid_from,
    valid_to, valid_to IS NULL AS is_current FROM ({_VERSIONS})"""


def _key(x: str) -> str:
    return f"CAST(coalesce({_day(x)}, -1) AS INTEGER)"


def _hours(a: str, b: str) -> str:
    """To two places, halves away from zero."""
    s = f"date_diff('second', {a}, {b})"
    return f"(CAST(sign({s}) * ((abs({s}) + 18) // 36) AS DOUBLE) / 100.0e0)"


_FACT = f"""
  SELECT i.order_id, i.order_item_id, {_day('i.event_date')} AS order_date_key, c.customer_unique_id, i.product_id, i.seller_id,
    coalesce(o.order_status, 'unknown') AS order_status, i.order_purchase_ts, o.order_delivered_customer_ts,
    o.order_estimated_delivery_ts, i.price, i.freight_value, o.order_status IN ('canceled', 'unavailable') AS is_cancelled,
    o.order_delivered_customer_ts IS NOT NULL AS is_delivered,
    CASE WHEN o.order_delivered_customer_ts IS NOT NULL THEN CAST(o.order_delivered_customer_ts AS DATE) <= CAST(o.order_estimated_delivery_ts AS DATE) END AS is_on_time,
    i.arrival_lag_days, {_day('s.valid_from')} AS version_from, s.seller_state
  FROM ({_ITEMS}) i LEFT JOIN ({_ORDERS}) o USING (order_id) LEFT JOIN ({_CUSTOMERS}) c ON c.customer_id = o.customer_id
  LEFT JOIN ({_SELLERS}) s ON s.seller_id = i.seller_id AND i.event_date >= s.valid_from AND (s.valid_to IS NULL OR i.event_date < s.valid_to)
  WHERE i.order_id NOT IN ({_GONE})"""

_STAGES = {"hours_to_approve": ("purchase_ts", "approved_ts"), "hours_to_ship": ("approved_ts", "shipped_ts"), "hours_in_transit": ("shipped_ts", "delivered_ts"), "hours_total": ("purchase_ts", "delivered_ts")}
_ORDER_FACT = f"""
  WITH s AS (SELECT order_id, customer_id, order_status AS current_status, order_purchase_ts AS purchase_ts, order_approved_ts AS approved_ts,
      order_delivered_carrier_ts AS shipped_ts, order_delivered_customer_ts AS delivered_ts, order_estimated_delivery_ts AS estimated_ts, change_seq AS last_change_seq FROM ({_ORDERS})),
  e AS (SELECT order_id, change_ts AS ended_ts, order_status AS end_reason FROM ({_LOG}) WHERE order_status IN ('canceled', 'unavailable')
      QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY change_ts, change_seq) = 1),
  l AS (SELECT order_id, CAST(count(*) AS INTEGER) AS item_count, CAST(sum(price) AS DECIMAL(22,2)) AS order_value FROM ({_ITEMS}) GROUP BY 1),
  r AS (SELECT order_id, round(avg(score), 2) AS review_score, CAST(count(*) AS INTEGER) AS review_count FROM ({_SCORES}) GROUP BY 1)
  SELECT s.order_id, c.customer_unique_id, current_status, purchase_ts, approved_ts, shipped_ts, delivered_ts, estimated_ts,
    {', '.join(f"{_key(m + '_ts')} AS {m}_date_key" for m in ('purchase', 'approved', 'shipped', 'delivered', 'estimated'))},
    ended_ts, end_reason, {', '.join(f"CASE WHEN {_hours(a, b)} >= 0 THEN {_hours(a, b)} END AS {k}" for k, (a, b) in _STAGES.items())},
    {_hours("CAST(CAST(estimated_ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)", "delivered_ts")} AS hours_late,
    CASE WHEN delivered_ts IS NOT NULL THEN CAST(delivered_ts AS DATE) <= CAST(estimated_ts AS DATE) END AS is_on_time,
    {' OR '.join(f"coalesce({_hours(a, b)} < 0, false)" for a, b in _STAGES.values())} AS has_inconsistent_milestones,
    coalesce(item_count, 0) AS item_count, order_value, review_score, coalesce(review_count, 0) AS review_count, last_change_seq
  FROM s LEFT JOIN e USING (order_id) LEFT JOIN l USING (order_id) LEFT JOIN r USING (order_id) LEFT JOIN ({_CUSTOMERS}) c ON c.customer_id = s.customer_id"""

_BACKLOG = f"""
  WITH g AS (SELECT * FROM ({_WHOLE_LOG}) WHERE change_ts IS NOT NULL),
  d AS (SELECT order_id, customer_id, CAST(change_ts AS DATE) AS cd, change_seq, CAST(order_purchase_ts AS DATE) AS p, CAST(order_estimated_delivery_ts AS DATE) AS e, deleted
        FROM g QUALIFY row_number() OVER (PARTITION BY order_id, CAST(change_ts AS DATE) ORDER BY change_seq DESC) = 1),
  w AS (SELECT *, max(change_seq) OVER (PARTITION BY order_id ORDER BY cd ROWS UNBOUNDED PRECEDING) AS sq,
        coalesce(lead(cd) OVER (PARTITION BY order_id ORDER BY cd) - 1, (SELECT max(CAST(change_ts AS DATE)) FROM g)) AS until FROM d),
  f AS (SELECT w.order_id, w.cd, w.until, g.order_status, CASE WHEN w.deleted THEN g.customer_id ELSE w.customer_id END AS customer_id,
        CASE WHEN w.deleted THEN CAST(g.order_purchase_ts AS DATE) ELSE w.p END AS p, CASE WHEN w.deleted THEN CAST(g.order_estimated_delivery_ts AS DATE) ELSE w.e END AS e
        FROM w JOIN g ON g.order_id = w.order_id AND g.change_seq = w.sq WHERE NOT g.deleted AND g.order_status IN {OPEN}),
  o AS (SELECT *, greatest(cd, p) AS start FROM f),
  x AS (SELECT o.*, CAST(unnest(generate_series(start, until, INTERVAL 1 DAY)) AS DATE) AS sd FROM o WHERE start <= until),
  v AS (SELECT order_id, sum(price) AS v FROM ({_ITEMS}) GROUP BY 1)
  SELECT {_key('sd')} AS snapshot_date_key, order_status, coalesce(customer_state, 'unknown') AS customer_state, count(*) AS open_orders,
    CAST(coalesce(sum(v), 0) AS DECIMAL(38,2)) AS open_order_value, CAST(quantile_disc(date_diff('day', p, sd), 0.5) AS INTEGER) AS median_age_days,
    CAST(count(*) FILTER (date_diff('day', p, sd) > 30) AS BIGINT) AS orders_open_over_30_days, CAST(count(*) FILTER (sd > e) AS BIGINT) AS overdue_orders
  FROM x LEFT JOIN v USING (order_id) LEFT JOIN ({_CUSTOMERS}) c ON c.customer_id = x.customer_id GROUP BY ALL"""

_MART = f"""
  WITH f AS ({_FACT}),
  o AS (SELECT seller_id, strftime(order_purchase_ts, '%Y-%m') AS year_month, order_id, max(CAST(NOT coalesce(is_cancelled, false) AS INTEGER)) AS sold,
      max(CAST(is_delivered AS INTEGER)) AS dl, max(CAST(is_on_time AS INTEGER)) AS ot, sum(CASE WHEN NOT coalesce(is_cancelled, false) THEN price END) AS gmv,
      sum(CASE WHEN NOT coalesce(is_cancelled, false) THEN freight_value END) AS fr, count(*) FILTER (NOT coalesce(is_cancelled, false)) AS n FROM f GROUP BY ALL)
  SELECT o.seller_id, year_month, s.seller_city, s.seller_state, CAST(sum(sold) AS BIGINT) AS orders, CAST(sum(dl) AS BIGINT) AS delivered_orders, CAST(sum(ot) AS BIGINT) AS on_time_orders,
    round(CASE WHEN sum(dl) <> 0 THEN CAST(sum(ot) AS DOUBLE) / sum(dl) END, 4) AS on_time_rate, round(avg(r.score), 2) AS avg_review_score,
    CAST(sum(gmv) AS DECIMAL(38,2)) AS gmv, CAST(sum(fr) AS DECIMAL(38,2)) AS freight, CAST(nullif(sum(n), 0) AS BIGINT) AS items
  FROM o LEFT JOIN (SELECT order_id, avg(score) AS score FROM ({_SCORES}) GROUP BY 1) r USING (order_id)
  LEFT JOIN (SELECT * FROM ({_SELLERS}) WHERE is_current) s ON s.seller_id = o.seller_id GROUP BY ALL"""


def _metric(checked: str, name: str, rules: dict[str, str], rescued: bool = False) -> str:
    def one(rule: str, severity: str, condition: str) -> str:
        return f"SELECT '{name}' AS table_name, _batch_date, '{rule}' AS rule, '{severity}' AS severity, CAST(count(*) FILTER ({condition}) AS BIGINT) AS failed_rows, count(*) AS total_rows FROM ({checked}) GROUP BY _batch_date"

    parts = [one(r, "error", f"list_contains(failed, '{r}')") for r in rules] + [one("__all__", "error", "len(failed) > 0")]
    return " UNION ALL ".join(parts + ([one("rescued_data", "warn", "_rescued_data IS NOT NULL")] if rescued else []))


def _snapshot_metric(name: str, key: str) -> str:
    rules = {"missing_key": f"{key} IS NULL"}
    return _metric(f"SELECT *, {_failed(rules)} AS failed FROM {name}", name, rules)


_METRICS = " UNION ALL ".join([
    _metric(_CHECKED_ITEMS, "order_items", _ITEM_RULES, True), _metric(_CHECKED_CHANGES, "orders_cdc", _CHANGE_RULES), _metric(_CHECKED_CUSTOMERS, "customers", _CUSTOMER_RULES),
    _snapshot_metric("sellers", "seller_id"), _snapshot_metric("products", "product_id"),
])
_METRIC_COLUMNS = f"table_name, {_day('_batch_date')} AS batch_date, rule, severity, failed_rows, total_rows"


def _gate(metrics: str) -> str:
    return f"""SELECT table_name, CAST(sum(failed_rows) AS BIGINT) AS bad_rows, CAST(sum(total_rows) AS BIGINT) AS total_rows,
    CAST(sum(failed_rows) AS DOUBLE) / sum(total_rows) AS bad_ratio, CAST(0.05 AS DOUBLE) AS threshold, CAST(sum(failed_rows) AS DOUBLE) / sum(total_rows) <= 0.05 AS passed
  FROM ({metrics}) WHERE rule = '__all__' GROUP BY table_name"""


_BEFORE, _AFTER = (f"""SELECT * FROM customers WHERE customer_id IS NOT NULL AND _batch_date {op} DATE '2024-03-31'
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _batch_date DESC NULLS LAST, _ingested_at DESC NULLS LAST, customer_city DESC NULLS LAST) = 1""" for op in ("<=", ">"))
_CITY = f"customer_id, customer_city, {_day('_batch_date')} AS batch_day"
_PAIRS = f"(SELECT a.customer_id AS a, b.customer_id AS b, a.customer_city IS DISTINCT FROM b.customer_city OR a.customer_state IS DISTINCT FROM b.customer_state AS differs FROM ({_BEFORE}) a FULL JOIN ({_AFTER}) b ON a.customer_id = b.customer_id)"
_BAD = f"SELECT * FROM ({_CHECKED_ITEMS}) WHERE len(failed) > 0"
_SCD = f"SELECT seller_id, seller_city, seller_state, seller_zip_code_prefix, {_day('valid_from')} AS valid_from, coalesce({_day('valid_to')}, -1) AS valid_to, is_current FROM ({_SELLERS})"
_REVIEWS = """
  SELECT order_id AS review_id, CASE WHEN minute(order_purchase_ts) % 7 < 6 THEN order_id END AS order_id, CAST(minute(order_purchase_ts) % 7 AS INTEGER) AS review_score,
    order_delivered_customer_ts AS review_creation_ts, CASE WHEN second(order_purchase_ts) % 3 > 0 THEN order_delivered_customer_ts + to_days(change_seq) END AS review_answer_ts,
    _batch_date, _ingested_at, _source_file
  FROM orders_cdc WHERE order_delivered_customer_ts IS NOT NULL AND order_purchase_ts IS NOT NULL AND change_seq IS NOT NULL"""
_REVIEW_RULES = {"missing_key": "review_id IS NULL OR order_id IS NULL", "score_out_of_range": "review_score NOT BETWEEN 1 AND 5"}
_CHECKED_REVIEWS = f"SELECT *, {_failed(_REVIEW_RULES)} AS failed FROM ({_REVIEWS})"
#: Life cycles of orders, a row a state.
_STATES = f"""WITH o AS (SELECT * FROM ({_ORDERS}) WHERE order_purchase_ts IS NOT NULL),
      m AS (SELECT order_id, order_status, order_delivered_customer_ts AS dl, unnest([order_purchase_ts, order_approved_ts, order_delivered_carrier_ts, order_delivered_customer_ts]) AS ts, unnest([0, 1, 2, 3]) AS rk,
              unnest(['created', 'approved', 'shipped', 'delivered']) AS state FROM o),
      k AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, rk DESC) AS back FROM m WHERE ts IS NOT NULL),
      a AS (SELECT order_id, dl, ts, rk, state FROM k UNION ALL SELECT order_id, dl, ts + INTERVAL 1 HOUR, 4, order_status FROM k WHERE back = 1 AND order_status <> state)"""


def _delivered_on(time: str) -> str:
    return f"greatest(CAST({time} AS DATE), DATE '2024-03-31')"


def _feed(name: str, rows: str, held: str) -> str:
    return f"SELECT '{name}' AS feed, {_day('d')} AS batch_day, count(*) AS row_count, count({held}) AS held FROM ({rows}) WHERE d <= DATE '2024-05-10' GROUP BY d"


_FEEDS = " UNION ALL ".join([
    _feed("orders_cdc", f"{_STATES} SELECT order_id, {_delivered_on('ts')} AS d FROM a", "order_id"),
    _feed("order_items", f"SELECT o.order_purchase_ts, {_delivered_on('o.order_purchase_ts')} AS d FROM ({_ITEMS}) i JOIN ({_ORDERS}) o USING (order_id)", "order_purchase_ts"),
    _feed("customers", f"SELECT c.customer_id, {_delivered_on('s.seen')} AS d FROM ({_CUSTOMERS}) c JOIN (SELECT customer_id, min(order_purchase_ts) AS seen FROM ({_ORDERS}) WHERE order_purchase_ts IS NOT NULL GROUP BY 1) s USING (customer_id)", "customer_id"),
    _feed("reviews", f"SELECT review_id, {_delivered_on('review_creation_ts')} AS d FROM ({_REVIEWS}) WHERE order_id IS NOT NULL", "review_id"),
    _feed("products", f"""SELECT e, DATE '2024-03-31' AS d FROM ({_PRODUCTS}) p LEFT JOIN (SELECT product_category_name, min(product_category_name_english) AS e FROM ({_PRODUCTS})
        WHERE product_category_name IS NOT NULL GROUP BY 1) t USING (product_category_name)""", "e"),
    _feed("sellers", """SELECT seller_id, CAST(unnest(generate_series(DATE '2024-03-31', DATE '2024-05-10', INTERVAL 1 DAY)) AS DATE) AS d
        FROM (SELECT DISTINCT seller_id FROM sellers WHERE seller_id IS NOT NULL)""", "seller_id"),
])
_RATE = "round(avg(CASE WHEN is_delivered THEN CAST(is_on_time AS INTEGER) END), 6)"
_SOLD = "CAST(sum(CASE WHEN NOT is_cancelled THEN price END) AS DECIMAL(38,2))"

SQL = {
    "src_lineage": f"SELECT regexp_extract(_source_file, 'feed[0-9]+') AS feed, {_day('_batch_date')} AS path_day, count(*) AS row_count, CAST(0 AS BIGINT) AS malformed FROM order_items GROUP BY ALL",
    "src_parse_lines": """WITH x AS (SELECT event_id, event_id % 7 AS n, json_extract_string(props, '$.k') AS k, props FROM events)
      SELECT event_id, CASE WHEN n NOT IN (1, 2, 3, 4) THEN CAST(k AS INTEGER) END AS k, CASE n WHEN 0 THEN '{"extra":"{\\"a\\":1}"}' WHEN 2 THEN '{"k":"abc"}' END AS rescued,
        n IN (1, 3, 4) AS malformed, CASE n WHEN 1 THEN 'not json' WHEN 3 THEN '[1,2]' WHEN 4 THEN '' END AS raw FROM x""",
    "src_csv": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
    "src_snapshots": f"SELECT {_day('d')} AS batch_day, {_day('lead(d) OVER (ORDER BY d)')} AS next_day FROM (SELECT DISTINCT _batch_date AS d FROM sellers)",
    "src_rescued_fields": f"""SELECT {_day('_batch_date')} AS batch_day, f AS field_name, count(*) AS row_count FROM (SELECT _batch_date, _rescued_data, unnest(json_keys(_rescued_data)) AS f FROM order_items WHERE _rescued_data IS NOT NULL)
      WHERE json_extract_string(_rescued_data, '$."' || f || '"') IS NOT NULL AND f NOT IN ('order_id', 'order_item_id', 'product_id', 'seller_id', 'order_purchase_ts', 'shipping_limit_ts', 'price', 'freight_value') GROUP BY ALL""",
    "src_one_day": "SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state FROM customers WHERE _batch_date = (SELECT max(_batch_date) FROM customers)",
    "str_ingest_parquet": f"SELECT seller_id, seller_zip_code_prefix, seller_city, seller_state, {_day('_batch_date')} AS batch_day FROM sellers",
    "slv_reviews": f"""SELECT review_id, order_id, review_score, review_creation_ts, review_answer_ts, {_day('_batch_date')} AS batch_day FROM ({_CHECKED_REVIEWS}) WHERE len(failed) = 0
      QUALIFY row_number() OVER (PARTITION BY review_id, order_id ORDER BY _batch_date DESC NULLS LAST, review_answer_ts DESC NULLS LAST, _ingested_at DESC NULLS LAST, _source_file DESC NULLS LAST,
        review_creation_ts DESC NULLS LAST, review_score DESC NULLS LAST) = 1""",
    "dq_reviews": f"SELECT {_METRIC_COLUMNS} FROM ({_metric(_CHECKED_REVIEWS, 'reviews', _REVIEW_RULES)})",
    "dq_observed": " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, 'total_rows' AS rule, count(*) AS row_count FROM {t}" for t in ("customers", "orders_cdc")]
        + [f"SELECT '{t}', '{n}', count(*) FILTER (coalesce({c}, false)) FROM {t}" for t, rules in (("customers", _CUSTOMER_RULES), ("orders_cdc", _CHANGE_RULES)) for n, c in rules.items()]),
    "dq_milestones": f"SELECT 'fact_order_fulfillment' AS table_name, 'inconsistent_milestones' AS rule, 'warn' AS severity, count(*) FILTER (has_inconsistent_milestones) AS failed_rows, count(*) AS total_rows FROM ({_ORDER_FACT})",
    "dq_loaded": f"""WITH k AS (SELECT order_id, order_item_id, _batch_date AS b, count(*) AS n FROM order_items WHERE order_id IS NOT NULL AND order_item_id IS NOT NULL AND _batch_date > DATE '2024-03-31' GROUP BY ALL),
      l AS (SELECT DISTINCT order_id, order_item_id FROM order_items WHERE _batch_date <= DATE '2024-03-31'),
      f AS (SELECT k.*, l.order_id IS NOT NULL OR b > min(b) OVER (PARTITION BY k.order_id, k.order_item_id) AS before FROM k LEFT JOIN l USING (order_id, order_item_id)),
      s AS (SELECT b, sum(n) AS t, sum(n - 1) AS i, count(*) FILTER (before) AS l FROM f GROUP BY b)
      SELECT 'order_items' AS table_name, {_day('b')} AS batch_date, 'duplicate_in_batch' AS rule, 'info' AS severity, CAST(i AS BIGINT) AS failed_rows, CAST(t AS BIGINT) AS total_rows FROM s
      UNION ALL SELECT 'order_items', {_day('b')}, 'duplicate_already_loaded', 'info', l, CAST(t AS BIGINT) FROM s""",
    "str_ingest": f"SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state, {_day('_batch_date')} AS batch_day, false AS _malformed FROM customers",
    "str_upsert": f"""SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state, {_day('_batch_date')} AS batch_day FROM customers WHERE customer_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _batch_date DESC NULLS LAST, _ingested_at DESC NULLS LAST, customer_city DESC NULLS LAST) = 1""",
    "str_two_streams": f"""SELECT 'orders' AS kept_in, order_id, change_seq AS number FROM ({_ORDERS}) UNION ALL SELECT 'order_changes', order_id, change_seq FROM ({_WHOLE_LOG})
      UNION ALL SELECT 'order_items', order_id, order_item_id FROM ({_ITEMS})""",
    "slv_items": f"SELECT order_id, order_item_id, product_id, seller_id, price, {_day('event_date')} AS event_day, arrival_lag_days, {_day('_batch_date')} AS batch_day FROM ({_ITEMS})",
    "slv_changes": f"SELECT order_id, change_seq, order_status, change_ts, {_day('_batch_date')} AS batch_day FROM ({_LOG})",
    "slv_orders": f"SELECT order_id, customer_id, order_status, change_seq, change_ts FROM ({_ORDERS})",
    "slv_customers": f"SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state, {_day('_batch_date')} AS batch_day FROM ({_CUSTOMERS})",
    "slv_products": f"SELECT product_id, product_category_name, product_category_name_english, product_weight_g, product_photos_qty, {_day('_batch_date')} AS batch_day FROM ({_PRODUCTS})",
    "dq_metrics": f"SELECT {_METRIC_COLUMNS} FROM ({_METRICS})",
    "dq_fired": f"SELECT {_METRIC_COLUMNS} FROM ({_METRICS}) WHERE failed_rows > 0 OR rule IN ('__all__', 'rescued_data')",
    "dq_duplicates": f"""WITH k AS (SELECT order_id, order_item_id, _batch_date AS b, count(*) AS n FROM order_items WHERE order_id IS NOT NULL AND order_item_id IS NOT NULL GROUP BY ALL),
      f AS (SELECT *, min(b) OVER (PARTITION BY order_id, order_item_id) AS first FROM k),
      s AS (SELECT b, sum(n) AS t, sum(n - 1) AS i, count(*) FILTER (b > first) AS l FROM f GROUP BY b)
      SELECT 'order_items' AS table_name, {_day('b')} AS batch_date, 'duplicate_in_batch' AS rule, 'info' AS severity, CAST(i AS BIGINT) AS failed_rows, CAST(t AS BIGINT) AS total_rows FROM s
      UNION ALL SELECT 'order_items', {_day('b')}, 'duplicate_already_loaded', 'info', l, CAST(t AS BIGINT) FROM s""",
    "dq_quarantine": f"SELECT {_day('_batch_date')} AS batch_day, array_to_string(failed, ', ') AS rules, order_id, _raw AS raw, _source_file AS source_file FROM ({_BAD})",
    "dq_rule_hits": f"SELECT {_day('_batch_date')} AS batch_day, rule, count(*) AS row_count FROM (SELECT _batch_date, unnest(failed) AS rule FROM ({_BAD})) GROUP BY ALL",
    "dq_gate": _gate(_METRICS),
    "dq_gate_latest": _gate(f"SELECT * FROM ({_METRICS}) QUALIFY _batch_date = max(_batch_date) OVER (PARTITION BY table_name)"),
    "gate_run": f"""SELECT {_day('_batch_date')} AS batch_date, table_name, CAST(sum(failed_rows) AS BIGINT) AS bad_rows, CAST(sum(total_rows) AS BIGINT) AS total_rows,
      CAST(sum(failed_rows) AS DOUBLE) / sum(total_rows) AS bad_ratio, CAST(0.05 AS DOUBLE) AS threshold, CAST(sum(failed_rows) AS DOUBLE) / sum(total_rows) <= 0.05 AS passed
      FROM ({_METRICS}) WHERE rule = '__all__' GROUP BY _batch_date, table_name""",
    "mrg_update": f"SELECT customer_id, CASE WHEN customer_city IS NULL OR customer_state = 'SP' THEN upper(coalesce(customer_city, 'nowhere')) ELSE customer_city END AS customer_city, {_day('_batch_date')} AS batch_day FROM ({_BEFORE})",
    "mrg_overwrite": f"SELECT 'now' AS version, customer_id, customer_city FROM ({_AFTER}) UNION ALL SELECT 'before', customer_id, customer_city FROM ({_BEFORE})",
    "mrg_guarded_delete": f"""SELECT change_type, count(*) AS row_count FROM (SELECT unnest(CASE WHEN a IS NULL THEN ['insert'] WHEN b IS NULL THEN ['delete'] WHEN differs THEN ['update_preimage', 'update_postimage'] ELSE [] END) AS change_type FROM {_PAIRS}) GROUP BY 1""",
    "mrg_insert_new": f"SELECT {_CITY} FROM ({_BEFORE}) UNION ALL SELECT {_CITY} FROM ({_AFTER}) WHERE customer_id NOT IN (SELECT customer_id FROM ({_BEFORE}))",
    "mrg_upsert": f"SELECT {_CITY} FROM ({_AFTER}) UNION ALL SELECT {_CITY} FROM ({_BEFORE}) WHERE customer_id NOT IN (SELECT customer_id FROM ({_AFTER}))",
    "mrg_delete_missing": f"SELECT {_CITY} FROM ({_AFTER})",
    "mrg_forward_only": f"SELECT order_id, change_seq, order_status FROM ({_ORDERS})",
    "mrg_hash_guarded": f"SELECT count(*) FILTER (a IS NULL) AS inserted, count(*) FILTER (differs AND a IS NOT NULL AND b IS NOT NULL) AS updated, count(*) FILTER (b IS NULL OR (a IS NOT NULL AND NOT differs)) AS kept FROM {_PAIRS}",
    "cdf_changes": f"""SELECT change_type, count(*) AS row_count, count(*) AS customers FROM (SELECT unnest(CASE WHEN a IS NULL THEN ['insert'] WHEN b IS NULL THEN [] ELSE ['update_preimage', 'update_postimage'] END) AS change_type FROM {_PAIRS}) GROUP BY 1""",
    "scd_one_pass": _SCD,
    "scd_applied": _SCD,
    "late_outcomes": f"""SELECT arrival_lag_days AS lag, CASE WHEN _batch_date <= DATE '2024-03-31' OR arrival_lag_days <= 0 THEN 'on_time' WHEN arrival_lag_days <= 3 THEN 'corrects' ELSE 'too_late' END AS outcome, count(*) AS row_count
      FROM ({_ITEMS}) WHERE order_purchase_ts IS NOT NULL GROUP BY ALL""",
    "gold_dim_date": f"""SELECT {_day('d')} AS date_key, strftime(d, '%Y-%m-%d') AS date_label, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, strftime(d, '%Y-%m') AS year_month,
        CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend
      FROM (SELECT CAST(unnest(generate_series(DATE '2023-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
      UNION ALL SELECT -1, 'not yet happened', NULL, NULL, 'not yet happened', NULL, NULL""",
    "gold_dim_customer": f"""WITH j AS (SELECT c.*, o.order_purchase_ts AS p FROM ({_CUSTOMERS}) c LEFT JOIN ({_ORDERS}) o USING (customer_id) WHERE c.customer_unique_id IS NOT NULL)
      SELECT n.customer_unique_id, n.customer_zip_code_prefix, n.customer_city, n.customer_state, s.order_count, s.first_order_ts
      FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY p DESC NULLS LAST, customer_id DESC) = 1) n
      JOIN (SELECT customer_unique_id, count(DISTINCT customer_id) AS order_count, min(p) AS first_order_ts FROM j GROUP BY 1) s USING (customer_unique_id)""",
    "gold_dim_product": f"SELECT product_id, product_category_name, product_category_name_english, product_weight_g, product_photos_qty FROM ({_PRODUCTS})",
    "gold_fact_order_item": f"SELECT * EXCLUDE (seller_state) FROM ({_FACT})",
    "gold_fact_order_fulfillment": _ORDER_FACT,
    "gold_fact_daily_backlog": _BACKLOG,
    "gold_mart_seller": _MART,
    "inc_totals": f"SELECT order_id, count(*) AS item_count, CAST(sum(price) AS DECIMAL(38,2)) AS order_value FROM ({_ITEMS}) GROUP BY 1",
    "inc_stats": f"""WITH i AS (SELECT order_id, _batch_date > DATE '2024-03-31' AS later FROM ({_ITEMS}))
      SELECT 'full' AS mode, 'no target yet' AS reason, CAST(-1 AS BIGINT) AS changed_ids, count(DISTINCT order_id) AS processed_ids, count(DISTINCT order_id) AS total_ids FROM i WHERE NOT later
      UNION ALL SELECT 'incremental', 'change feeds', count(DISTINCT CASE WHEN later THEN order_id END), count(DISTINCT CASE WHEN later THEN order_id END), count(DISTINCT order_id) FROM i""",
    "inc_fulfillment": _ORDER_FACT,
    "rpl_feeds": _FEEDS,
    "rpl_delivered": f"SELECT DISTINCT feed, batch_day, true AS all_landed, 2 AS days FROM ({_FEEDS}) WHERE batch_day IN (20240331, 20240401)",
    "rec_checks": "SELECT unnest(['items', 'order_changes', 'orders', 'customers', 'products', 'dim_seller', 'fact_order_fulfillment', 'quarantine', 'dq_metrics']) AS check, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, true AS passed",
    "rec_difference": "SELECT CAST(count(*) - count(DISTINCT (order_id, order_item_id)) AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM order_items WHERE order_id IS NOT NULL AND order_item_id IS NOT NULL",
    "rpl_lifecycle": f"""{_STATES}
      SELECT order_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY ts, rk) AS INTEGER) AS change_seq, ts AS change_ts, state, coalesce(dl <= ts, false) AS shows_delivery FROM a""",
    "bi_kpi_ops": f"SELECT count(*) AS tables, count(*) FILTER (NOT passed) AS blocked, (SELECT count(*) FROM ({_BAD})) AS quarantined FROM ({_gate(_METRICS)})",
    "bi_dq_ratio": f"""SELECT {_day('_batch_date')} AS batch_day, table_name AS series, round(CAST(sum(failed_rows) AS DOUBLE) / sum(total_rows), 6) AS bad_ratio FROM ({_METRICS}) WHERE rule = '__all__' GROUP BY ALL
      UNION ALL SELECT DISTINCT {_day('_batch_date')}, 'threshold', CAST(0.05 AS DOUBLE) FROM ({_METRICS})""",
    "bi_dq_errors": f"SELECT rule, CAST(sum(failed_rows) AS BIGINT) AS row_count FROM ({_METRICS}) WHERE severity = 'error' AND rule <> '__all__' AND failed_rows > 0 AND _batch_date > DATE '2024-03-31' GROUP BY ALL",
    "bi_dq_handled": f"SELECT rule, CAST(sum(failed_rows) AS BIGINT) AS row_count FROM ({_METRICS}) WHERE severity IN ('info', 'warn') AND failed_rows > 0 AND _batch_date > DATE '2024-03-31' GROUP BY ALL",
    "bi_dq_gate": f"SELECT table_name, bad_rows, total_rows, round(bad_ratio * 100, 2) AS bad_pct, passed FROM ({_gate(_METRICS)})",
    "bi_dq_quarantine": f"SELECT array_to_string(failed, ', ') AS rules, count(*) AS row_count FROM ({_BAD}) GROUP BY ALL",
    "bi_dq_rules": f"SELECT {_day('_batch_date')} AS batch_day, table_name, rule, severity, CAST(sum(failed_rows) AS BIGINT) AS row_count FROM ({_METRICS}) WHERE rule <> '__all__' AND failed_rows > 0 GROUP BY ALL",
    "bi_gate_history": f"""SELECT {_day('_batch_date')} AS run_day, table_name, CAST(sum(failed_rows) AS BIGINT) AS bad_rows, CAST(sum(total_rows) AS BIGINT) AS total_rows,
      round(CAST(sum(failed_rows) AS DOUBLE) / sum(total_rows) * 100, 2) AS bad_pct, CAST(sum(failed_rows) AS DOUBLE) / sum(total_rows) <= 0.05 AS passed FROM ({_METRICS}) WHERE rule = '__all__' GROUP BY _batch_date, table_name""",
    "bi_dq_latest": f"""SELECT {_day('_batch_date')} AS batch_day, 'order_items' AS table_name, array_to_string(failed, ', ') AS rules, order_id, _raw AS raw, _source_file AS source_file FROM ({_BAD})
      ORDER BY batch_day DESC NULLS LAST, source_file NULLS LAST, order_id NULLS LAST, rules, raw NULLS LAST LIMIT 200""",
    "bi_kpi_biz": f"SELECT {_SOLD} AS gmv, count(DISTINCT order_id) AS orders, count(DISTINCT CASE WHEN NOT is_cancelled THEN order_id END) AS sold_orders, {_RATE} AS on_time_rate FROM ({_FACT})",
    "bi_monthly": f"""SELECT CASE WHEN order_purchase_ts >= TIMESTAMP '2023-01-01' AND order_purchase_ts < TIMESTAMP '2026-01-01' THEN strftime(order_purchase_ts, '%Y-%m') ELSE 'outside the calendar' END AS year_month,
      {_SOLD} AS gmv, {_RATE} AS on_time_rate FROM ({_FACT}) GROUP BY 1""",
    "bi_state": f"SELECT seller_state, count(DISTINCT order_id) AS orders, CAST(sum(price) AS DECIMAL(38,2)) AS gmv, {_RATE} AS on_time_rate FROM ({_FACT}) WHERE NOT is_cancelled AND version_from IS NOT NULL GROUP BY 1",
    "bi_stages": f"""SELECT strftime(purchase_ts, '%Y-%m') AS month, stage, round(avg(hours), 1) AS avg_hours, count(*) AS orders FROM (SELECT purchase_ts, unnest(['1 purchase → approved', '2 approved → carrier', '3 carrier → customer']) AS stage,
      unnest([hours_to_approve, hours_to_ship, hours_in_transit]) AS hours FROM ({_ORDER_FACT})) WHERE hours IS NOT NULL GROUP BY ALL""",
    "bi_backlog": f"SELECT snapshot_date_key, order_status, CAST(sum(open_orders) AS BIGINT) AS open_orders FROM ({_BACKLOG}) GROUP BY ALL",
    "bi_lateness": f"""SELECT CASE WHEN hours_late <= -168 THEN '1. 7+ days early' WHEN hours_late <= 0 THEN '2. 0-7 days early' WHEN hours_late <= 72 THEN '3. 1-3 days late' WHEN hours_late <= 168 THEN '4. 4-7 days late' ELSE '5. 8+ days late' END AS lateness,
      count(*) AS orders, round(avg(review_score), 2) AS avg_review_score FROM ({_ORDER_FACT}) WHERE delivered_ts IS NOT NULL AND review_score IS NOT NULL GROUP BY ALL""",
    **{name: f"""SELECT seller_id, seller_state, CAST(sum(gmv) AS DECIMAL(38,2)) AS gmv, CAST(sum(orders) AS BIGINT) AS orders, round(CASE WHEN sum(delivered_orders) <> 0 THEN CAST(sum(on_time_orders) AS DOUBLE) / sum(delivered_orders) END, 3) AS on_time_rate,
      round(avg(avg_review_score), 2) AS avg_review_score FROM ({_MART}) GROUP BY seller_id, seller_state ORDER BY gmv DESC NULLS LAST, seller_id LIMIT {n}""" for name, n in (("bi_top_sellers", 15), ("bi_top_sellers_20", 20))},
}
