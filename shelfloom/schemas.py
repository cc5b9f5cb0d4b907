"""Schemas of the five stored tables and of the marketplace page input."""

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "attributes": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PRODUCTS = _schema(
    "product_id bigint, sku string, title string, description string, "
    "generated_description string, category string, brand string, price double, "
    "currency string, status string, attributes attributes, raw_data string, "
    "seo_title string, seo_keywords string, created_at timestamp, updated_at timestamp"
)

DATA_ISSUES = _schema(
    "issue_id bigint, product_id bigint, issue_type string, severity string, "
    "description string, field_name string, expected_value string, actual_value string, "
    "resolved boolean, resolved_at timestamp, created_at timestamp"
)

COMPETITOR_PRICES = _schema(
    "price_id bigint, product_id bigint, source string, competitor_title string, "
    "competitor_url string, competitor_price double, competitor_currency string, "
    "in_stock boolean, scraped_at timestamp"
)

COMPETITOR_ALERTS = _schema(
    "alert_id bigint, product_id bigint, alert_type string, source string, message string, "
    "our_price double, competitor_price double, price_difference double, "
    "acknowledged boolean, created_at timestamp"
)

INGESTION_JOBS = _schema(
    "job_id bigint, filename string, total_rows bigint, processed_rows bigint, "
    "new_products bigint, updated_products bigint, issues_found bigint, status string, "
    "error_message string, started_at timestamp, completed_at timestamp"
)

# Files that feed streams have taken in.
FEED_FILES = _schema("file string, job_id bigint")

# Statistics of the whole catalog, one row, and products' open issues: see plans/kept_counts.py.
CATALOG_COUNTS = _schema(
    "name string, total_products bigint, active_products bigint, flagged_products bigint, "
    "products_without_description bigint, open_issues bigint, recent_alerts bigint, last_ingestion timestamp"
)
OPEN_ISSUES = _schema("product_id bigint, open_issues bigint")

# Feed rows over a width that the caller set.
QUARANTINE = _schema(
    "job_id bigint, sku string, title string, raw_data string, reject_reason string"
)

PAGES = _schema(
    "page_id bigint, product_id bigint, source string, url string, html string, "
    "fetched_at timestamp"
)

# A listing read off a marketplace page, with the defaults a bare one takes.
LISTING = _schema(
    "page_id bigint, product_id bigint, source string, listing_rank int, title string, "
    "price double, currency string, in_stock boolean, url string"
)
