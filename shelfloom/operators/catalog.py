"""Read queries over the stored tables."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.functions.text import normalize_text
from shelfloom.session import settle


# Fields that a search looks at.
SEARCHED = ("title", "sku", "brand")


def _empty(column: str) -> Column:
    """Null or ''; never null."""
    return F.coalesce(F.col(column) == "", F.lit(True))


# --- products --------------------------------------------------------------

def matching(rows: DataFrame, wanted: dict) -> DataFrame:
    """Rows whose columns have the wanted values; a wanted None does not filter."""
    tests = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return rows.filter(reduce(and_, tests)) if tests else rows


def filter_products(products: DataFrame, status: str = None, category: str = None,
                    search: str = None) -> DataFrame:
    """Equality on status and category, substring of title, SKU or brand.

    Empty arguments do not filter. % and _ in ``search`` are wildcards.
    """
    rows = matching(products, {"status": status or None, "category": category or None})
    found = [F.col(name).ilike(f"%{search}%") for name in SEARCHED]
    return rows.filter(reduce(or_, found)) if search else rows


def product_page(products: DataFrame, skip: int = 0, limit: int = 50, after: tuple = None,
                 **filters) -> DataFrame:
    """A page of products, newest change first, ties by id.

    ``after`` = (updated_at, product_id) of the last row seen goes on from there
    without sorting the pages before, which ``skip`` cannot.
    """
    rows = filter_products(products, **filters)
    if after is not None:
        stamp, last_id = after
        same = F.col("updated_at") == F.lit(stamp)
        rows = rows.filter(
            (F.col("updated_at") < F.lit(stamp)) | (same & (F.col("product_id") > F.lit(last_id)))
        )
    return rows.orderBy(F.desc("updated_at"), F.asc("product_id")).offset(skip).limit(limit)


def open_issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("product_id").agg(
        F.count_if(~F.col("resolved")).alias("issue_count")
    )


def with_issue_counts(products: DataFrame, issues: DataFrame) -> DataFrame:
    """Products with their number of unresolved issues.

    Issues are counted per product before the join.
    """
    return products.join(open_issue_counts(issues), "product_id", "left").withColumn(
        "issue_count", F.coalesce("issue_count", F.lit(0))
    )


def list_products(products: DataFrame, issues: DataFrame, skip: int = 0, limit: int = 50,
                  after: tuple = None, **filters) -> DataFrame:
    """A page of products with each one's number of unresolved issues.

    The page is written out first: at most ``limit`` rows, whose true size lets
    Spark broadcast them to the issues instead of shuffling those.
    """
    page = settle(product_page(products, skip, limit, after, **filters), "page")
    return with_issue_counts(page, issues_of(issues, page)).orderBy(
        F.desc("updated_at"), F.asc("product_id")
    )


def products_by_id(products: DataFrame, ids: DataFrame) -> DataFrame:
    return products.join(ids.select("product_id").distinct(), "product_id", "left_semi")


def products_by_sku(products: DataFrame, skus: DataFrame) -> DataFrame:
    return products.join(skus.select("sku").distinct(), "sku", "left_semi")


def issues_of(issues: DataFrame, products: DataFrame) -> DataFrame:
    return issues.join(products.select("product_id").distinct(), "product_id", "left_semi")


def categories(products: DataFrame) -> DataFrame:
    return (
        products.filter(F.col("category").isNotNull()).select("category").distinct().orderBy("category")
    )


# --- issues and jobs -------------------------------------------------------

def list_issues(issues: DataFrame, resolved: bool = False, limit: int = 100) -> DataFrame:
    return (
        issues.filter(F.col("resolved") == resolved)
        .orderBy(F.desc("created_at"), F.desc("issue_id")).limit(limit)
    )


def list_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), F.desc("job_id")).limit(limit)


# --- statistics ------------------------------------------------------------

def dashboard_stats(products: DataFrame, issues: DataFrame, alerts: DataFrame, jobs: DataFrame,
                    prices: DataFrame = None) -> DataFrame:
    """One row of counts; each table is read once and reduced to one row.

    The one-row results are stacked and added up, so nothing is joined.
    """
    undescribed = _empty("description") & _empty("generated_description")
    parts = [
        products.agg(
            F.count(F.lit(1)).alias("total_products"),
            F.count_if(F.col("status") == "active").alias("active_products"),
            F.count_if(F.col("status") == "flagged").alias("flagged_products"),
            F.count_if(undescribed).alias("products_without_description"),
        ),
        issues.agg(F.count_if(~F.col("resolved")).alias("open_issues")),
        alerts.agg(F.count_if(~F.col("acknowledged")).alias("recent_alerts")),
        jobs.agg(F.max("started_at").alias("last_ingestion")),
    ]
    if prices is not None:
        parts.append(prices.agg(F.max("scraped_at").alias("last_scrape")))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    times = [c for c in stacked.columns if c.startswith("last_")]
    counts = [c for c in stacked.columns if c not in times]
    return stacked.agg(
        *[F.sum(c).alias(c) for c in counts], *[F.max(c).alias(c) for c in times]
    )


def duplicate_titles(products: DataFrame) -> DataFrame:
    """Titles, compared in lower case and with single spaces, that more than one SKU has."""
    return (
        products.groupBy(F.lower(normalize_text(F.col("title"))).alias("title"))
        .agg(F.count_distinct("sku").alias("skus"))
        .filter(F.col("skus") > 1)
    )
