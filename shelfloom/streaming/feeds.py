"""Streaming feed ingest: files dropped into a folder, one commit per micro-batch.

The stream brings lines of text with their file, not cells, so that every file goes by its own header
line and fails by itself.
"""

from datetime import datetime
from typing import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfloom.fixed_values import NO_SKU_TEXT, PARSE_ERROR_TEXT
from shelfloom.operators.cleaning import feed_rows, map_headers
from shelfloom.operators.steps import Steps
from shelfloom.plans.feed_job import (
    checked_lines, checked_result, failed_feed, line_counts, new_job, overlong_text, store, touched_products,
)
from shelfloom.plans.kept_counts import keep_counts
from shelfloom.plans.store_changes import merge_parts
from shelfloom.session import at_once, intermediate, settle
from shelfloom.sources.feeds import CSV_FILES, ORDER, OVERFLOW, Feed, told_feed
from shelfloom.sources.records import placed, text_lines
from shelfloom.sources.tables import BUCKETS, Change, Tables
from shelfloom.streaming.progress import stream_id


def feed_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Lines of the CSV files in a drop folder, whatever their headers."""
    reader = spark.readStream.options(
        pathGlobFilter=CSV_FILES, lineSep="\n", maxFilesPerTrigger=str(files_per_batch))
    return text_lines(reader.text(folder))


def short_name(file: str) -> str:
    return unquote(file).rsplit("/", 1)[-1]


def without_sku(feed: Feed, fresh: dict) -> dict:
    """File -> what is wrong with it, for those (file -> header line) that have no SKU column."""
    return {file: NO_SKU_TEXT.format(columns=", ".join(feed.found[line])) for file, line in fresh.items()
            if "sku" not in map_headers(feed.found[line])}


def ingest_feeds(stream: DataFrame, root: str, checkpoint: str, clock: Callable = datetime.now,
                 buckets: int = BUCKETS, trigger: dict = None) -> StreamingQuery:
    """Run every micro-batch through the feed job, into the tables under ``root``.

    A batch is one commit, which rewrites the catalog's buckets that it touches. A batch
    repeated after a failure is stored once, and files that the store has taken in before
    are passed over, also when the stream's checkpoint was lost. A broken file is a failed job of
    its own in that commit; the other files of its batch are one job. ``trigger`` goes to
    ``writeStream.trigger``; without one, the stream takes what there is and ends.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        change = Tables(spark, root, buckets).begin(
            f"feeds:{stream_id(spark, checkpoint)}:{batch_id}", counted=True)
        if change is None:
            return
        with intermediate(spark):
            feed = told_feed(placed(batch))
            files = {step["file"]: step["first_line"] for step in feed.steps if step["first_line"] is not None}
            known = change.read("feed_files").select("file").filter(F.col("file").isin([*files]))
            rows, known = at_once(feed.rows, known.collect)
            fresh = {file: files[file] for file in {*files} - {row["file"] for row in known}}
            if fresh:
                take(feed, rows, fresh, change)
        merge_parts(change.tables)

    # The steps of a feed's cleaning and checks, by its headers.
    known_steps = {}

    def checked_of(rows: DataFrame, headers: list) -> DataFrame:
        if tuple(headers) not in known_steps:
            lines = feed_rows(Steps(rows), headers, OVERFLOW)
            known_steps[tuple(headers)] = checked_lines(lines, headers)
        return known_steps[tuple(headers)].on(rows)

    def take(feed: Feed, rows: DataFrame, fresh: dict, change: Change) -> None:
        spark, file, wrong = change.tables.spark, F.col(f"{ORDER}._file"), without_sku(feed, fresh)
        if len(wrong) < len(fresh):
            rows = rows.filter(file.isin([f for f in fresh if f not in wrong]))
            # Lines cost more to check than to move from few splits to all cores.
            cores = spark.sparkContext.defaultParallelism
            rows = rows.repartition(cores) if len(feed.steps) < cores else rows
            checked = settle(checked_of(rows, feed.headers), "feed-rows")
            counts = {row["file"]: row for row in checked.groupBy(file.alias("file")).agg(*line_counts()).collect()}
            overlong = {f: PARSE_ERROR_TEXT.format(error=overlong_text(row["broken"]))
                        for f, row in counts.items() if row["broken"]}
            checked = checked.filter(~file.isin([*overlong])) if overlong else checked
            wrong |= overlong
        jobs = []
        for name in sorted(wrong):
            failed = failed_feed(spark, wrong[name], clock(), change.job_id, short_name(name))
            change.append("ingestion_jobs", failed.job)
            jobs.append((name, change.job_id))
            change.job_id += 1
        good = sorted(f for f in fresh if f not in wrong)
        files = spark.createDataFrame(jobs + [(name, change.job_id) for name in good], "file string, job_id bigint")
        if good:
            total, found = (sum(counts[f][what] for f in good if f in counts) for what in ("total", "found"))
            job = new_job(change.job_id, ", ".join(map(short_name, good)), clock())
            result = checked_result(checked, total, found, touched_products(change), job)
            result.files = files
            store(result, change)
        else:
            change.job_id -= 1
            change.append("feed_files", files)
            keep_counts(change)
            change.commit()

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
