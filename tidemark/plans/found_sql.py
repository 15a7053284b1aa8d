"""The SQL (DuckDB) that states the results of p1 to p7."""

from __future__ import annotations


def _day(x: str) -> str:
    return f"CAST(year({x}) * 10000 + month({x}) * 100 + day({x}) AS INTEGER)"


#: Each item by its row delivered first.
_FIRST = """
  SELECT * FROM order_items WHERE order_id IS NOT NULL AND order_item_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY order_id, order_item_id
                             ORDER BY _batch_date NULLS LAST, _ingested_at NULLS LAST, _source_file NULLS LAST) = 1"""

_COUNTED = f"""
  SELECT CAST(order_purchase_ts AS DATE) AS d, _batch_date AS b, count(*) AS n, sum(price) AS r FROM ({_FIRST})
  WHERE order_purchase_ts IS NOT NULL
    AND (_batch_date <= DATE '2024-03-31' OR date_diff('day', CAST(order_purchase_ts AS DATE), _batch_date) <= 3)
  GROUP BY ALL"""


def _windows(size: int) -> str:
    return f"""
WITH p AS ({_COUNTED}),
w AS (SELECT d - CAST(k AS INTEGER) AS s, b, sum(n) AS n, sum(r) AS r FROM p, (SELECT unnest(range({size})) AS k) GROUP BY ALL)
SELECT {_day('s')} AS first_day, {_day('b')} AS batch_day,
  CAST(sum(n) OVER (PARTITION BY s ORDER BY b) AS BIGINT) AS item_count,
  CAST(sum(r) OVER (PARTITION BY s ORDER BY b) AS DECIMAL(38,2)) AS revenue
FROM w"""


def _changes(name: str, key: str, attributes: list[str]) -> str:
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in attributes)
    return f"""
SELECT '{name}' AS table_name, record_key, {_day('d2')} AS batch_day, change FROM (
  WITH s AS (SELECT {key} AS k, _batch_date AS d, {', '.join(attributes)} FROM {name} WHERE {key} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {key}, _batch_date ORDER BY _ingested_at DESC NULLS LAST) = 1),
  p AS (SELECT d AS d1, lead(d) OVER (ORDER BY d) AS d2 FROM (SELECT DISTINCT _batch_date AS d FROM {name})),
  o AS (SELECT s.*, p.d2 FROM s JOIN p ON s.d = p.d1 WHERE p.d2 IS NOT NULL),
  n AS (SELECT s.*, p.d2 FROM s JOIN p ON s.d = p.d2)
  SELECT coalesce(a.k, b.k) AS record_key, coalesce(a.d2, b.d2) AS d2,
    CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM o a FULL JOIN n b ON a.k = b.k AND a.d2 = b.d2 WHERE a.k IS NULL OR b.k IS NULL OR NOT ({same}))"""


SELLER = ["seller_city", "seller_state", "seller_zip_code_prefix"]
PRODUCT = ["product_category_name", "product_category_name_english", "product_weight_g", "product_photos_qty"]

#: Versions of sellers, by comparing whole rows.
_VERSIONS = """
  SELECT seller_id, seller_city, seller_state, seller_zip_code_prefix, d AS valid_from,
    lead(d) OVER (PARTITION BY seller_id ORDER BY d) AS valid_to
  FROM (
    SELECT *, lag(v) OVER (PARTITION BY seller_id ORDER BY d) AS w FROM (
      SELECT seller_id, _batch_date AS d, seller_city, seller_state, seller_zip_code_prefix,
        row(seller_city, seller_state, seller_zip_code_prefix)::VARCHAR AS v
      FROM sellers WHERE seller_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY seller_id, _batch_date ORDER BY _ingested_at DESC NULLS LAST) = 1))
  WHERE w IS NULL OR v <> w"""

_ITEMS_KNOWN = f"""
  SELECT i.order_id, i.order_item_id, i.seller_id, CAST(i.order_purchase_ts AS DATE) AS d, v.* EXCLUDE (seller_id)
  FROM ({_FIRST}) i LEFT JOIN ({_VERSIONS}) v ON v.seller_id = i.seller_id
    AND CAST(i.order_purchase_ts AS DATE) >= v.valid_from AND (v.valid_to IS NULL OR CAST(i.order_purchase_ts AS DATE) < v.valid_to)"""

_STANDING = """
  SELECT * FROM orders_cdc WHERE order_id IS NOT NULL AND change_seq IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY change_seq DESC, _ingested_at DESC NULLS LAST,
                             _batch_date DESC NULLS LAST, _source_file DESC NULLS LAST) = 1"""
_EXISTS = f"SELECT * FROM ({_STANDING}) WHERE lower(coalesce(_op, '')) NOT IN ('d', 'delete')"

#: Measured schemas of deliveries, top level.
_KIND = r"""CASE WHEN regexp_full_match(v, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*') THEN 'number'
  WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean'
  WHEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?') THEN 'timestamp'
  WHEN v LIKE '{%' AND json_valid(v) THEN 'object' ELSE 'text' END"""

SQL = {
    "p1_found": f"""
SELECT order_id, order_item_id, {_day('order_purchase_ts')} AS event_day,
  CASE WHEN date_diff('day', CAST(order_purchase_ts AS DATE), _batch_date) <= 3 THEN 'corrects' ELSE 'too_late' END AS outcome
FROM ({_FIRST}) WHERE order_purchase_ts IS NOT NULL AND _batch_date > DATE '2024-03-31' AND _batch_date > CAST(order_purchase_ts AS DATE)""",
    "p1_daily": _windows(1),
    "p1_weekly": _windows(7),
    "p2_found": _changes("sellers", "seller_id", SELLER) + " UNION ALL " + _changes("products", "product_id", PRODUCT),
    "p4_found": f"SELECT seller_id, {_day('valid_from')} AS valid_from, coalesce({_day('valid_to')}, -1) AS valid_to FROM ({_VERSIONS})",
    "p4_versions": f"SELECT seller_id, seller_city, seller_state, seller_zip_code_prefix, {_day('valid_from')} AS valid_from, coalesce({_day('valid_to')}, -1) AS valid_to FROM ({_VERSIONS})",
    "p5_found": f"""
WITH k AS ({_ITEMS_KNOWN}), l AS (SELECT seller_id, max(valid_from) AS last FROM ({_VERSIONS}) GROUP BY 1)
SELECT order_id, order_item_id, coalesce({_day('valid_from')}, -1) AS version_day
FROM k JOIN l USING (seller_id) WHERE d IS NOT NULL AND valid_from IS DISTINCT FROM last""",
    "p5_items": f"SELECT order_id, order_item_id, seller_id, {_day('d')} AS event_day, seller_city, seller_state, seller_zip_code_prefix FROM ({_ITEMS_KNOWN})",
    "p6_found": """
SELECT order_id, order_item_id, arg_min(_source_file, (_batch_date, _ingested_at, _source_file)) AS kept_source_file
FROM order_items WHERE order_id IS NOT NULL AND order_item_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "p6_items": f"""
SELECT order_id, order_item_id, product_id, seller_id, price, freight_value, {_day('_batch_date')} AS batch_day, copies
FROM (SELECT *, count(*) OVER (PARTITION BY order_id, order_item_id) AS copies FROM order_items WHERE order_id IS NOT NULL AND order_item_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY order_id, order_item_id ORDER BY _batch_date NULLS LAST, _ingested_at NULLS LAST, _source_file NULLS LAST,
    product_id NULLS LAST, seller_id NULLS LAST, price NULLS LAST, freight_value NULLS LAST) = 1)""",
    "p7_found": f"SELECT order_id, change_seq, order_status FROM ({_EXISTS})",
    "p7_orders": f"""
SELECT order_id, customer_id, order_status, order_purchase_ts, order_approved_ts, order_delivered_carrier_ts,
  order_delivered_customer_ts, order_estimated_delivery_ts, change_seq FROM ({_EXISTS})""",
}
SQL["p3_found"] = f"""
WITH rows AS (SELECT regexp_extract(_source_file, 'feed[0-9]+') AS feed, _batch_date AS b, * FROM order_items WHERE NOT coalesce(_malformed, false)),
sizes AS (SELECT feed, b, count(*) AS n, lag(b) OVER (PARTITION BY feed ORDER BY b) AS before FROM rows GROUP BY feed, b),
cells AS (
  SELECT feed, b, 'price' AS f, 'number' AS k, count(price) AS n FROM rows GROUP BY ALL
  UNION ALL SELECT feed, b, 'freight_value', 'number', count(freight_value) FROM rows GROUP BY ALL
  UNION ALL SELECT feed, b, 'shipping_limit_ts', 'timestamp', count(shipping_limit_ts) FROM rows GROUP BY ALL
  UNION ALL SELECT feed, b, 'product_id', 'text', count(product_id) FROM rows GROUP BY ALL
  UNION ALL SELECT feed, b, f, {_KIND} AS k, count(*) FROM (
    SELECT feed, b, f, json_extract_string(_rescued_data, '$."' || f || '"') AS v
    FROM (SELECT feed, b, _rescued_data, unnest(json_keys(_rescued_data)) AS f FROM rows WHERE _rescued_data IS NOT NULL))
    WHERE v IS NOT NULL GROUP BY ALL),
fields AS (SELECT feed, b, f, arg_min(k, (-c.n, k)) AS k FROM cells c JOIN sizes s USING (feed, b)
           WHERE c.n > 0 GROUP BY feed, b, f, s.n HAVING sum(c.n) * 2 > s.n),
pairs AS (
  SELECT coalesce(o.feed, n.feed) AS feed, coalesce(o.b2, n.b) AS b, coalesce(o.f, n.f) AS f, o.k AS ok, n.k AS nk
  FROM (SELECT s.feed, s.b AS b2, f, k FROM fields JOIN sizes s ON fields.feed = s.feed AND fields.b = s.before) o
  FULL JOIN (SELECT fields.* FROM fields JOIN sizes s USING (feed, b) WHERE s.before IS NOT NULL) n
    ON o.feed = n.feed AND o.b2 = n.b AND o.f = n.f),
ended AS (SELECT *, row_number() OVER (PARTITION BY feed, b, ok ORDER BY f) AS r FROM pairs WHERE nk IS NULL),
begun AS (SELECT *, row_number() OVER (PARTITION BY feed, b, nk ORDER BY f) AS r FROM pairs WHERE ok IS NULL)
SELECT feed, {_day('b')} AS batch_day, f AS field_name, 'retyped' AS change FROM pairs WHERE ok <> nk
UNION ALL SELECT begun.feed, {_day('begun.b')}, begun.f, CASE WHEN e.f IS NULL THEN 'added' ELSE 'renamed' END
  FROM begun LEFT JOIN ended e ON e.feed = begun.feed AND e.b = begun.b AND e.ok = begun.nk AND e.r = begun.r
UNION ALL SELECT e.feed, {_day('e.b')}, e.f, 'removed'
  FROM ended e LEFT JOIN begun n ON e.feed = n.feed AND e.b = n.b AND e.ok = n.nk AND e.r = n.r WHERE n.f IS NULL"""
