"""Runs and micro-batches that are repeated, and work whose tasks are repeated."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfloom.plans.feed_job import run_feed, store
from shelfloom.plans import feed_job
from shelfloom.schemas import COMPETITOR_PRICES, DATA_ISSUES, PRODUCTS
from shelfloom.sources.tables import Tables
from shelfloom.streaming import feeds as feed_streams
from shelfloom.streaming.feeds import feed_stream, ingest_feeds
from shelfloom.streaming.prices import monitor_prices
from tests.test_prices import as_set, products, random_rows, table

NOW = datetime(2024, 6, 1)


def test_feed_batch_that_failed_half_way_is_repeated_whole(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "drops", str(tmp_path / "tables")
    folder.mkdir()
    (folder / "a.csv").write_text("sku,title\n1,a\n2,b\n")

    def run(state="state"):
        stream = feed_stream(spark, str(folder))
        ingest_feeds(stream, root, str(tmp_path / state), lambda: NOW).awaitTermination()

    run()
    (folder / "b.csv").write_text("sku,title\n2,B\n3,c\n")

    def half(result, change):
        change.append("data_issues", result.issues)
        raise RuntimeError("lost")

    monkeypatch.setattr(feed_streams, "store", half)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(feed_streams, "store", store)
    run()

    def check():
        tables = Tables(spark, root)
        rows = {r["sku"]: r["title"] for r in tables.read("products").collect()}
        assert rows == {"1": "a", "2": "B", "3": "c"}
        # Two issues per line (no description, no attributes), each stored once.
        assert tables.read("data_issues").count() == 8
        assert tables.read("data_issues").select("issue_id").distinct().count() == 8
        assert tables.read("ingestion_jobs").count() == 2

    check()
    run("fresh")  # the checkpoint is lost: both files come again
    check()


def test_price_batches_repeated_after_a_lost_checkpoint(spark, tmp_path):
    rows = sorted(random_rows(60, 9), key=lambda r: (r[8], r[0]))
    ours = products(spark)
    root = str(tmp_path)

    def run(state):
        stream = spark.readStream.schema(COMPETITOR_PRICES).parquet(f"{root}/drops")
        monitor_prices(stream, lambda: ours, f"{root}/tables", f"{root}/{state}").awaitTermination()

    for part in (rows[:25], rows[25:]):
        table(spark, *part).coalesce(1).write.mode("append").parquet(f"{root}/drops")
        run("state")
    alerts = as_set(Tables(spark, f"{root}/tables").read("competitor_alerts"))
    run("fresh")  # has lost the progress and takes both drops in one batch
    tables = Tables(spark, f"{root}/tables")
    assert tables.read("competitor_prices").count() == 60
    assert tables.read("competitor_alerts").count() == len(alerts) > 0
    assert as_set(tables.read("competitor_alerts")) == alerts


def test_ids_do_not_depend_on_how_the_work_is_cut(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("sku,title\n" + "".join(f"s{i % 40},t{i}\n" for i in range(400)))
    empty = spark.createDataFrame([], PRODUCTS)
    found = []
    for partitions in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        result = run_feed(spark, str(path), empty, NOW, 5)
        found.append((
            as_set(result.issues.select("issue_id", "product_id", "issue_type")),
            as_set(result.products.select("product_id", "sku", "title")),
        ))
    assert found[0] == found[1] and len(found[0][0]) == 800


def test_any_error_ends_in_the_job_log(spark, tmp_path, monkeypatch):
    path = tmp_path / "f.csv"
    path.write_text("sku,title\n1,a\n")

    def broken(*_):
        raise RuntimeError("disk full")

    monkeypatch.setattr(feed_job, "clean_rows", broken)
    result = run_feed(spark, str(path), spark.createDataFrame([], PRODUCTS), NOW, 5)
    row = result.job.first()
    assert (row["status"], row["error_message"], row["completed_at"]) == ("failed", "Unexpected error: disk full", NOW)
    assert isinstance(result.error, RuntimeError)


def test_an_error_while_writing_leaves_a_failed_job_and_the_feed_can_come_again(spark, tmp_path, monkeypatch):
    path = tmp_path / "f.csv"
    path.write_text("sku,title\n1,a\n")
    tables = Tables(spark, str(tmp_path / "store"))

    def broken(*_):
        return spark.range(1).select(F.raise_error(F.lit("lost block")).cast("bigint").alias("issue_id"), *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in DATA_ISSUES.fields[1:]])

    monkeypatch.setattr(feed_job, "data_issues", broken)
    with pytest.raises(Exception, match="lost block"):
        feed_job.ingest_feed(tables, str(path), NOW)
    job = tables.read("ingestion_jobs").first()
    assert job["status"] == "failed" and "lost block" in job["error_message"]
    assert tables.read("products").count() == 0
    monkeypatch.undo()
    feed_job.ingest_feed(tables, str(path), NOW)
    assert tables.read("products").count() == 1
    assert [r["status"] for r in tables.read("ingestion_jobs").orderBy("job_id").collect()] == ["failed", "completed"]


def test_a_third_of_a_feed_in_one_sku(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("sku,title,price\n" + "".join(
        f"{'hot' if i % 3 == 0 else f's{i}'},t{i},{i}\n" for i in range(3000)))
    result = run_feed(spark, str(path), spark.createDataFrame([], PRODUCTS), NOW, 5)
    job = result.job.first()
    assert (job["processed_rows"], job["new_products"], job["updated_products"]) == (3000, 2001, 999)
    hot = result.products.filter(F.col("sku") == "hot").first()
    assert (hot["title"], hot["price"]) == ("t2997", 2997.0)
    assert result.issues.count() == 6000
