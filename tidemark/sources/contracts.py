"""Declared contracts of landing feeds and the parsing of lines against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

APPEND, CDC, SNAPSHOT = "append", "cdc", "snapshot"
LINEAGE = ["_source_file", "_batch_date", "_ingested_at"]


@dataclass(frozen=True)
class Contract:
    """A feed: its name, the format of its files (json or parquet), the kind that decides how its rows are merged (append,
    cdc or snapshot), its columns and its key."""

    name: str
    fmt: str
    kind: str
    schema: T.StructType
    keys: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "money": T.DecimalType(12, 2)}


def _contract(name: str, fmt: str, kind: str, columns: str, *keys: str) -> Contract:
    pairs = [c.split() for c in columns.split(", ")]
    return Contract(name, fmt, kind, T.StructType([T.StructField(c, _TYPES[t]) for c, t in pairs]), keys)


#: The columns the landing feeds are contracted to send.
CONTRACTS = {
    c.name: c
    for c in (
        _contract("orders_cdc", "json", CDC, "order_id string, customer_id string, order_status string, order_purchase_ts timestamp, order_approved_ts timestamp, order_delivered_carrier_ts timestamp, order_delivered_customer_ts timestamp, order_estimated_delivery_ts timestamp, change_seq int, change_ts timestamp, _op string", "order_id"),
        _contract("order_items", "json", APPEND, "order_id string, order_item_id int, product_id string, seller_id string, order_purchase_ts timestamp, shipping_limit_ts timestamp, price money, freight_value money", "order_id", "order_item_id"),
        _contract("customers", "json", APPEND, "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string", "customer_id"),
        _contract("reviews", "json", APPEND, "review_id string, order_id string, review_score int, review_creation_ts timestamp, review_answer_ts timestamp", "review_id", "order_id"),
        _contract("sellers", "parquet", SNAPSHOT, "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string", "seller_id"),
        _contract("products", "parquet", SNAPSHOT, "product_id string, product_category_name string, product_category_name_english string, product_weight_g int, product_photos_qty int", "product_id"),
    )
}


def parse_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON lines as the contract's columns, ``_rescued_data``, ``_malformed`` and ``_raw``; other columns are kept.

    A value that doesn't fit its type leaves its column null and is rescued; so are unknown fields. ``_rescued_data`` is a
    JSON object of strings, null when empty. A line that isn't an object (broken, a list, a number, empty, null) is
    malformed: all its columns are null, and ``_raw`` holds the line. Nested values are rescued as JSON text.
    """
    kept = [c for c in lines.columns if c != value]
    read = lines.select(*kept, F.col(value).alias("_raw"), F.from_json(value, schema).alias("_r"), F.from_json(value, "map<string,string>").alias("_m"))
    unfit = [F.when(F.col(f"_r.{c}").isNull(), F.lit(c)) for c in schema.fieldNames()]
    rescued = F.map_filter("_m", lambda k, v: v.isNotNull() & (~k.isin(*schema.fieldNames()) | F.array_contains(F.array_compact(F.array(*unfit)), k)))
    malformed = F.col("_m").isNull()
    return read.select(
        *kept,
        *[F.when(~malformed, F.col(f"_r.{c}")).alias(c) for c in schema.fieldNames()],
        F.when(F.size(rescued) > 0, F.to_json(rescued)).alias("_rescued_data"),
        malformed.alias("_malformed"),
        F.when(malformed, F.col("_raw")).alias("_raw"),
    )
