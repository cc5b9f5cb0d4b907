"""The catalog's statistics and open issues per product, kept up to date by every commit.

A commit adds rows to tables or replaces the rows of some buckets. What it adds to a count is the
count over the rows it wrote, less the count over the rows it replaced, so a commit costs the
buckets that it touches, and a reader one row for all statistics or one row for each product
with open issues; no table is scanned. A store keeps counts from its first ``recount`` on.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.operators.catalog import dashboard_stats
from shelfloom.session import intermediate, settle
from shelfloom.sources.tables import Change, Tables

COUNTED = ("products", "data_issues", "competitor_alerts", "ingestion_jobs")
_TIMES = ("last_ingestion",)


def _stats(rows: Callable) -> DataFrame:
    """One row of statistics over the tables that ``rows`` gives by name."""
    return dashboard_stats(*map(rows, COUNTED))


def _open_issues(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("resolved")).groupBy("product_id").agg(F.count(F.lit(1)).alias("open_issues"))


def _negative(counts: DataFrame, *kept: str) -> DataFrame:
    """The counts to be taken off; a latest time can only grow."""
    return counts.select(*[
        F.lit(None).cast("timestamp").alias(c) if c in _TIMES else F.col(c) if c in kept else (-F.col(c)).alias(c)
        for c in counts.columns])


def _added_up(stats: DataFrame) -> DataFrame:
    return stats.agg(*[
        F.max(c).alias(c) if c in _TIMES else F.coalesce(F.sum(c), F.lit(0)).alias(c)
        for c in stats.columns]).withColumn("name", F.lit("catalog"))


def keep_counts(change: Change) -> None:
    """Bring the kept counts up to what a change has written, if its store keeps any; for its last step."""
    if not change.holds("catalog_counts"):
        return
    before = change.read("catalog_counts").drop("name")
    stats = before.unionByName(_stats(change.written)).unionByName(_negative(_stats(change.replaced)))
    change.replace("catalog_counts", settle(_added_up(stats), "catalog-counts"))
    if not change.changes("data_issues"):
        return
    moved = _open_issues(change.written("data_issues")).unionByName(
        _negative(_open_issues(change.replaced("data_issues")), "product_id"))
    moved = settle(moved.groupBy("product_id").agg(F.sum("open_issues").alias("open_issues")).filter("open_issues <> 0"),
                   "moved-issues")
    buckets = change.buckets_of("open_issues", moved)
    if buckets:
        counts = change.read("open_issues", buckets).unionByName(moved).groupBy("product_id").agg(
            F.sum("open_issues").alias("open_issues")).filter("open_issues <> 0")
        change.replace("open_issues", settle(counts, "open-issues"), buckets)


def recount(tables: Tables, name: str = "first") -> None:
    """Count everything once; from then on the store's commits keep the counts."""
    change = tables.begin(f"recount:{name}")
    if change is None:
        return
    with intermediate(tables.spark):
        change.replace("catalog_counts", settle(_added_up(_stats(change.read)), "catalog-counts"))
        change.replace("open_issues", _open_issues(change.read("data_issues")))
        change.commit()


def kept_stats(tables: Tables) -> DataFrame:
    """The row of ``dashboard_stats``, without reading the tables that it counts."""
    return tables.read("catalog_counts").drop("name")


def with_kept_issue_counts(products: DataFrame, tables: Tables) -> DataFrame:
    """``with_issue_counts``, without reading the issues."""
    kept = tables.read("open_issues").withColumnRenamed("open_issues", "issue_count")
    return products.join(kept, "product_id", "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
