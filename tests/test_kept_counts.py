"""Kept counts equal the counts over whole tables after every kind of change."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfloom.operators.catalog import dashboard_stats, with_issue_counts
from shelfloom.plans import kept_counts
from shelfloom.plans.feed_job import ingest_feed
from shelfloom.plans.store_changes import acknowledge_stored, delete_stored, generate_stored, resolve_stored
from shelfloom.sources.tables import Tables
from shelfloom.streaming.prices import monitor_prices
from tests.test_prices import snapshot, table

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "store"), buckets=4)


def feed(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(["sku,title,description,price", *lines]) + "\n")
    return str(path)


def check(tables):
    whole = dashboard_stats(*[tables.read(n) for n in kept_counts.COUNTED])
    assert kept_counts.kept_stats(tables).select(*whole.columns).collect() == whole.collect()
    products = tables.read("products")
    counts = [{(r["sku"], r["issue_count"]) for r in rows.collect()} for rows in (
        kept_counts.with_kept_issue_counts(products, tables), with_issue_counts(products, tables.read("data_issues")))]
    assert counts[0] == counts[1]
    return whole.first()


def test_counts_follow_all_changes(tables, spark, tmp_path):
    kept_counts.recount(tables)
    assert check(tables)["total_products"] == 0
    good = "This lamp has a warm light for the evening. " * 9
    ingest_feed(tables, feed(tmp_path, "a.csv", f"a,A,{good},1", "b,B,,2", "c,C,short,3", f"d,D,{good},4"), T1)
    assert check(tables)["open_issues"] > 0
    ingest_feed(tables, feed(tmp_path, "b.csv", "b,B2,,2", f"c,C2,{good},3", "e,E,,5", "e,E,,6"), T2)
    assert check(tables)["total_products"] == 5
    ingest_feed(tables, feed(tmp_path, "c.txt"), T2)  # a failed job
    check(tables)
    issues = tables.read("data_issues").filter("issue_type = 'missing_description'")
    resolve_stored(tables, issues.select("issue_id", "product_id"), T2, "r1")
    resolve_stored(tables, tables.read("data_issues").select("issue_id").limit(1), T2, "r2")
    check(tables)
    ids = [r["product_id"] for r in tables.read("products").collect()]
    prices = [snapshot(n, 0.5, product=i) for n, i in enumerate(ids)]
    table(spark, *prices).coalesce(1).write.parquet(f"{tmp_path}/drops")
    stream = spark.readStream.schema(tables.read("competitor_prices").schema).parquet(f"{tmp_path}/drops")
    monitor_prices(stream, lambda: tables.read("products"), tables.root, f"{tmp_path}/state").awaitTermination()
    assert check(tables)["recent_alerts"] == len(ids)
    acknowledge_stored(tables, tables.read("competitor_alerts").select("alert_id", "product_id").limit(2), "a1")
    assert check(tables)["recent_alerts"] == len(ids) - 2

    def write(system, prompt, temperature, max_tokens):
        return "A text." if "JSON" not in system else '{"seo_title": "s", "seo_keywords": "k"}'

    generate_stored(tables, tables.read("products").select("product_id"), write, T2, "g1")
    assert check(tables)["products_without_description"] == 0
    doomed = tables.read("products").filter("sku IN ('b', 'c')").select("product_id", "sku")
    delete_stored(tables, spark.createDataFrame(doomed.collect(), doomed.schema), "d1")
    assert check(tables)["total_products"] == 3


def test_a_store_without_counts_keeps_none_and_may_begin_later(tables, tmp_path):
    ingest_feed(tables, feed(tmp_path, "a.csv", "a,A,,1"), T1)
    assert tables.read("catalog_counts").count() == 0
    kept_counts.recount(tables)
    kept_counts.recount(tables)  # again: does nothing
    assert check(tables)["total_products"] == 1
    ingest_feed(tables, feed(tmp_path, "b.csv", "b,B,,1"), T2)
    assert check(tables)["last_ingestion"] == T2


def test_resolving_by_product_reads_only_its_buckets(tables, spark, tmp_path, monkeypatch):
    ingest_feed(tables, feed(tmp_path, "a.csv", *[f"s{i},T,,1" for i in range(40)]), T1)
    one = tables.read("data_issues").select("issue_id", "product_id").limit(1)
    one = spark.createDataFrame(one.collect(), one.schema)
    read = []
    whole = Tables._read
    monkeypatch.setattr(Tables, "_read", lambda self, state, name, buckets, times: read.append((name, buckets)) or whole(
        self, state, name, buckets, times))
    resolve_stored(tables, one, T2, "r1")
    assert [r for r in read if r[0] == "data_issues"] and all(len(b or range(9)) == 1 for n, b in read if n == "data_issues")
    monkeypatch.undo()
    assert tables.read("data_issues").filter(F.col("resolved")).count() == 1
