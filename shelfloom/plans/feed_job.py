"""The feed job: read, clean, check, upsert, and log one supplier feed."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.fixed_values import (
    EMPTY_FEED_TEXT, NOT_CSV_TEXT, NO_SKU_TEXT, OTHER_ERROR_TEXT, PARSE_ERROR_TEXT,
)
from shelfloom.operators.changes import new_product_id, upsert_products
from shelfloom.operators.cleaning import (
    clean_rows, feed_rows, is_storable, last_per_sku, lines_of_skus, map_headers, quarantine, storable_rows,
)
from shelfloom.operators.quality import data_issues, status_from_issues, with_issues
from shelfloom.plans.kept_counts import keep_counts
from shelfloom.schemas import INGESTION_JOBS
from shelfloom.session import at_once, intermediate, settle
from shelfloom.sources.feeds import OVERFLOW, is_csv_name, open_feed
from shelfloom.sources.tables import Change, LostRace, Tables


@dataclass
class FeedResult:
    """What one feed leads to. ``products`` is None when nothing changes.

    ``job_values`` are those of its row in the job log, ``quarantine`` the rows over a width,
    if there are widths, ``files`` the files that count as taken in, if they are kept, ``error`` what made the job fail.
    """

    spark: SparkSession
    job_values: dict
    products: DataFrame = None
    issues: DataFrame = None
    quarantine: DataFrame = None
    files: DataFrame = None
    error: Exception = None

    @property
    def job(self) -> DataFrame:
        row = {f.name: self.job_values.get(f.name) for f in INGESTION_JOBS.fields}
        for name in ("total_rows", "processed_rows", "new_products", "updated_products", "issues_found"):
            row[name] = row[name] or 0
        return self.spark.createDataFrame([tuple(row.values())], INGESTION_JOBS)


def checked_rows(good: DataFrame) -> DataFrame:
    """Clean rows with their issues and the status that follows."""
    return with_issues(good).withColumn("status", status_from_issues(F.col("issues")))


def known_skus(latest: DataFrame, current: DataFrame) -> DataFrame:
    """(sku, lines, product_id) of a feed's SKUs; the id is null for new ones."""
    return latest.select("sku", "lines").join(current.select("sku", "product_id"), "sku", "left")


def feed_counts(known: DataFrame) -> DataFrame:
    """processed_rows, new_products and updated_products of a feed's ``known_skus``.

    A new SKU's first line creates it; each further line of any SKU updates it.
    """
    return known.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("processed_rows"),
        F.count_if(F.col("product_id").isNull()).alias("new_products"),
    ).withColumn("updated_products", F.col("processed_rows") - F.col("new_products"))


def failed_feed(spark: SparkSession, message: str, run_ts: datetime, job_id: int,
                filename: str, error: Exception = None) -> FeedResult:
    """A feed that was not processed, as its row in the job log."""
    return FeedResult(spark, dict(
        job_id=job_id, filename=filename, started_at=run_ts, completed_at=run_ts,
        status="failed", error_message=message,
    ), error=error)


def overlong_text(lines: int) -> str:
    return f"{lines} lines have more fields than the header"


def process_rows(rows: DataFrame, headers: list, current, run_ts: datetime, job_id: int,
                 filename: str = "", widths: dict = None) -> FeedResult:
    """Outcome of a feed that has been read into columns c0, c1, ... and _order.

    ``current`` is the catalog, or a function that gives the part of it in which the
    given SKUs (a table with a column sku) lie; ``products`` is then the part in which known SKUs
    lie, and the new rows.
    """
    spark = rows.sparkSession
    job = new_job(job_id, filename, run_ts)
    if not headers:
        message = OTHER_ERROR_TEXT.format(error="No columns to parse from file")
        return FeedResult(spark, job | {"status": "failed", "error_message": message, "completed_at": run_ts})
    has_sku = "sku" in map_headers(headers)
    lines = feed_rows(rows, headers)
    if has_sku:
        # All outputs read the checked rows, so the feed is read and checked once.
        checked = settle(checked_lines(lines, headers, widths), "feed-rows")
        total, broken, found = checked.agg(*line_counts()).first()
    else:
        total, broken = lines.agg(F.count(F.lit(1)), F.count_if(_is_overlong(lines))).first()
    job["total_rows"] = total
    if broken:
        message = PARSE_ERROR_TEXT.format(error=overlong_text(broken))
        return FeedResult(spark, job | {"status": "failed", "error_message": message, "completed_at": run_ts})
    if total and not has_sku:
        message = NO_SKU_TEXT.format(columns=", ".join(headers))
        return FeedResult(spark, job | {"status": "failed", "error_message": message})
    return checked_result(checked if has_sku else lines, total, found if has_sku else 0, current, job, widths)


def new_job(job_id: int, filename: str, run_ts: datetime) -> dict:
    """The first values of a feed's row in the job log."""
    return {"job_id": job_id, "filename": filename, "started_at": run_ts}


def _is_overlong(rows: DataFrame):
    return F.col(OVERFLOW).isNotNull() if OVERFLOW in rows.columns else F.lit(False)


def checked_lines(lines: DataFrame, headers: list, widths: dict = None) -> DataFrame:
    """``feed_rows`` cleaned and checked, with ``_overlong``."""
    return checked_rows(clean_rows(lines.withColumn("_overlong", _is_overlong(lines)).drop(OVERFLOW), headers, widths))


def line_counts() -> list:
    """Lines, overlong lines and issues found, over ``checked_lines``."""
    found_issues = F.sum(F.when(is_storable(), F.size("issues")))
    return [F.count(F.lit(1)).alias("total"), F.count_if("_overlong").alias("broken"),
            F.coalesce(found_issues, F.lit(0)).alias("found")]


def stored_skus(good: DataFrame, touched) -> tuple:
    """(``lines_of_skus``, ``known_skus``, their counts, the part of the catalog in which known SKUs lie) of a feed's rows.

    ``touched`` gives the part of the catalog in which some SKUs lie. Of it only rows of the feed's SKUs are moved.
    """
    skus, current = at_once(lambda: settle(lines_of_skus(good), "feed-lines"), lambda: touched(good.select("sku")))
    current = current.select("sku", "product_id").join(skus.select("sku"), "sku", "left_semi")
    known = settle(known_skus(skus, current), "feed-ids")
    # Where no SKU is known, rows are only added; buckets that hold some are rewritten.
    return skus, known, *at_once(feed_counts(known).first, lambda: touched(known.filter("product_id IS NOT NULL")))


def checked_result(checked: DataFrame, total: int, found: int, current, job: dict, widths: dict = None) -> FeedResult:
    """Outcome of ``checked_lines`` without an overlong one, that hold so many lines and issues; ``job`` is its
    ``new_job``, ``current`` as for ``process_rows``."""
    spark, job_id, run_ts = checked.sparkSession, job["job_id"], job["started_at"]
    job["total_rows"] = total
    if not total:
        return FeedResult(spark, job | {"status": "completed", "error_message": EMPTY_FEED_TEXT})
    good = storable_rows(checked.drop("_overlong"))

    if callable(current):
        skus, known, counts, catalog = stored_skus(good, current)
        latest = last_per_sku(good.drop("issues"), skus)
    else:
        latest, catalog = settle(last_per_sku(good.drop("issues")), "feed-skus"), current
        # One narrow join with the catalog gives the counts and the ids.
        known = settle(known_skus(latest, catalog), "feed-ids")
        counts = feed_counts(known).first()
    identified = good.join(known.drop("lines"), "sku").withColumn(
        "product_id", F.coalesce("product_id", new_product_id(F.col("sku"))))
    job |= counts.asDict() | {"issues_found": found, "status": "completed", "completed_at": run_ts}
    products, issues = at_once(
        lambda: upsert_products(catalog, latest, run_ts), lambda: data_issues(identified, run_ts, job_id))
    return FeedResult(
        spark, job, products=products, issues=issues,
        quarantine=quarantine(checked).select(
            F.lit(job_id).cast("bigint").alias("job_id"), "sku", "title", "raw_data", "reject_reason"
        ) if widths else None,
    )


def run_feed(spark: SparkSession, path: str, current, run_ts: datetime, job_id: int,
             widths: dict = None) -> FeedResult:
    """Outcome of the CSV feed at ``path`` (a file, or a folder of files).

    ``widths`` are longest texts by field, for a target that has some.
    """
    filename = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in filename and not is_csv_name(filename):
        return failed_feed(spark, NOT_CSV_TEXT, run_ts, job_id, filename)
    try:
        feed = open_feed(spark, path)
        return process_rows(feed.rows(), feed.headers, current, run_ts, job_id, filename, widths)
    except Exception as error:  # any failure ends in the job log
        return failed_feed(spark, OTHER_ERROR_TEXT.format(error=error), run_ts, job_id, filename, error)


def touched_products(change: Change):
    """The catalog as a feed needs it: the buckets in which its SKUs lie."""
    return lambda skus: change.read("products", change.buckets_of("products", skus))


def store(result: FeedResult, change: Change) -> None:
    """Write a feed's outcome in one commit.

    The feed has run on ``touched_products`` of the same change.

    The results are computed here, so this may fail; then nothing of the feed is
    stored but its row in the job log, as failed, and the error goes on. The feed may
    come again after that.
    """
    try:
        writes = [lambda: change.append("ingestion_jobs", result.job)]
        if result.products is not None:
            writes.append(lambda: change.append("data_issues", result.issues))
            if result.quarantine is not None:
                writes.append(lambda: change.append("quarantine", result.quarantine))
            writes.append(lambda: change.replace("products", result.products, change.touched["products"]))
        if result.files is not None:
            writes.append(lambda: change.append("feed_files", result.files))
        at_once(*writes)
        keep_counts(change)
        change.commit()
    except LostRace:
        raise
    except Exception as error:
        change.abandon()
        job = result.job_values
        message = OTHER_ERROR_TEXT.format(error=error)
        failed = failed_feed(result.spark, message, job["started_at"], job["job_id"], job["filename"], error)
        change.append("ingestion_jobs", failed.job)
        keep_counts(change)
        change.commit(done=False)
        raise


def ingest_feed(tables: Tables, path: str, run_ts: datetime, job_id: int = None, widths: dict = None):
    """Run the feed at ``path`` and store its outcome; returns its row of the job log.

    Without a number the job takes the store's next one. Repeating a stored job does
    nothing and returns None; a number that another feed has used is refused.
    """
    job_id = tables.next_job_id() if job_id is None else job_id
    change = tables.begin(f"feed:{job_id}", path)
    if change is None:
        return None
    change.job_id = job_id
    with intermediate(tables.spark):
        result = run_feed(tables.spark, path, touched_products(change), run_ts, job_id, widths)
        store(result, change)
    return result.job.first()
