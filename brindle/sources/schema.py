"""Schemas, natural keys and enumerations of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "listings": "source string, source_id string, title string, description string, brand string, object_type string, decor array<string>, size_cm double, pieces int, condition string, sale_type string, price_huf long, bid_count int, status string, relevance string, first_seen timestamp, last_seen timestamp, last_checked timestamp, missing_runs int, extra map<string,string>",
    "price_records": "source string, source_ref string, market string, price_type string, currency string, amount double, premium double, observed_at timestamp, title string, description string, url string, dedup_key string, corpus string",
    "observations": "source string, source_id string, observed_at timestamp, price_huf long, current_bid_huf long, bid_count int, status string, via string",
    "estimates": "source string, source_id string, model_version string, input_hash string, created_at timestamp, payload string",
    "catalog_items": "sku_key string, brand string, form_no string, pattern_code string, name string, object_type string, size_cm double, retail_price double, currency string, url string",
    "frontier": "run_id string, url string, kind string, page int, priority int, status string, attempts int",
    "coverage": "run_id string, source string, scope string, reported_total long, pages_fetched int, listings_seen long, exhausted boolean",
    "meta": "key string, value string",
}
KEYS = {
    "listings": ["source", "source_id"], "price_records": ["source", "source_ref", "price_type", "market"], "observations": [], "estimates": ["source", "source_id", "model_version"],
    "catalog_items": ["sku_key"], "frontier": ["run_id", "url"], "coverage": ["run_id", "source", "scope"], "meta": ["key"],
}
# Admitted price types and markets of a price file.
PRICE_TYPES = ["auction_hammer", "realized_sale", "asking_active", "asking_ended", "auction_start", "retail"]
MARKETS = ["HU", "US", "EU"]


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order; missing ones are null, others are dropped (additive migration of older files)."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(SCHEMAS[table]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
