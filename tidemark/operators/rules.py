"""The quality rules of the landing feeds, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.quality import Rule, compiled, declare

#: The states of the feed's contract.
STATES = ["created", "approved", "invoiced", "processing", "shipped", "delivered", "canceled", "unavailable"]
#: The names of the feeds' rules in their order, and their bounds.
RULES = {
    "order_items": declare("""
        malformed_record: _malformed | is true
        missing_key: order_id, order_item_id | is missing
        price_not_positive: price | is missing or at most | 0
        freight_negative: freight_value | is below | 0
        missing_product_id: product_id | is missing
        unknown_product_id: product_id, _known | is unknown
        too_late: order_purchase_ts, _batch_date | comes late | {allowed_days}, {backfill}
    """),
    "orders_cdc": declare("""
        malformed_record: _malformed | is true
        missing_key: order_id, change_seq, change_ts | is missing
        unknown_status: order_status | is not among | {states}
        delivered_before_purchase: order_delivered_customer_ts, order_purchase_ts | is before
        change_before_purchase: change_ts, order_purchase_ts | is before
    """),
    "customers": declare("""
        malformed_record: _malformed | is true
        missing_key: customer_id, customer_unique_id | is missing
    """),
    "reviews": declare("""
        malformed_record: _malformed | is true
        missing_key: review_id, order_id | is missing
        score_out_of_range: review_score | is not between | 1, 5
    """),
    "sellers": declare("missing_key: seller_id | is missing"),
    "products": declare("missing_key: product_id | is missing"),
}


def rules_of(feed: str, rows: DataFrame, **given) -> list[Rule]:
    """The rules of a feed that its rows have the columns for. ``given``: ``allowed_days`` and ``backfill`` of the items."""
    return compiled(RULES[feed], rows.columns, states=STATES, **given)
