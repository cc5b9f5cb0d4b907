"""The store: commits, numbers, buckets, changed child tables."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfloom.plans.feed_job import ingest_feed
from shelfloom.plans.price_job import scrape
from shelfloom.plans.store_changes import (
    acknowledge_stored, delete_stored, generate_stored, merge_parts, resolve_stored,
)
from shelfloom.session import shared_folder
from shelfloom.sources.tables import LostRace, Tables

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "store"), buckets=8)


def feed(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(["sku,title,price", *lines]) + "\n")
    return str(path)


def skus(tables):
    return {r["sku"]: r["title"] for r in tables.read("products").collect()}


def test_two_feeds_without_numbers_keep_both(tables, tmp_path):
    ingest_feed(tables, feed(tmp_path, "a.csv", "a,A,1", "b,B,2"), T1)
    ingest_feed(tables, feed(tmp_path, "b.csv", "b,B2,2", "c,C,3"), T2)
    assert skus(tables) == {"a": "A", "b": "B2", "c": "C"}
    assert [r["job_id"] for r in tables.read("ingestion_jobs").orderBy("job_id").collect()] == [1, 2]
    assert tables.read("data_issues").count() == 8


def test_lower_equal_and_repeated_numbers(tables, tmp_path):
    one, two = feed(tmp_path, "a.csv", "a,A,1"), feed(tmp_path, "b.csv", "b,B,2")
    ingest_feed(tables, one, T1, 17)
    ingest_feed(tables, two, T2, 5)
    assert skus(tables) == {"a": "A", "b": "B"}  # a lower number loses nothing
    with pytest.raises(ValueError, match="has stored"):
        ingest_feed(tables, two, T2, 17)  # another feed's number
    assert ingest_feed(tables, one, T2, 17) is None  # the same again does nothing
    assert tables.read("ingestion_jobs").count() == 2 and tables.next_job_id() == 18


def test_a_commit_from_an_old_base_fails_and_leaves_nothing(tables, spark, tmp_path):
    rows = spark.createDataFrame([("f", 1)], "file string, job_id bigint")
    late, first = tables.begin("late"), tables.begin("first")
    for change in (late, first):
        change.append("feed_files", rows)
    first.commit()
    with pytest.raises(LostRace):
        late.commit()
    assert tables.read("feed_files").count() == 1
    assert len(os.listdir(tmp_path / "store/feed_files")) == 1
    with pytest.raises(LostRace):  # the file of a commit is made only once
        again = tables.begin("again")
        (tmp_path / f"store/_commits/{again.number:010d}.json").write_text("")
        again.commit()
    # What a lost writer left half written is passed over.
    next_one = tables.begin("next")
    next_one.append("feed_files", rows)
    next_one.commit()
    assert tables.read("feed_files").count() == 2


def test_a_batch_rewrites_the_buckets_it_touches(tables, spark, tmp_path):
    ingest_feed(tables, feed(tmp_path, "a.csv", *[f"s{i},T,1" for i in range(60)]), T1)
    whole = tables._newest()[0]["tables"]["products"]
    assert [len(p["buckets"]) for p in whole] == [8]
    ingest_feed(tables, feed(tmp_path, "b.csv", "s1,New,2"), T2)
    parts = tables._newest()[0]["tables"]["products"]
    assert sorted(len(p["buckets"]) for p in parts) == [1, 7]
    assert skus(tables)["s1"] == "New" and len(skus(tables)) == 60


def test_a_whole_part_is_one_folder_to_list(tables, spark, tmp_path):
    """One that is cut is a folder for each bucket left."""
    ingest_feed(tables, feed(tmp_path, "a.csv", *[f"s{i},T,1" for i in range(60)]), T1)
    whole = tables._newest()[0]["tables"]["products"]
    ingest_feed(tables, feed(tmp_path, "b.csv", "s1,New,2"), T2)
    parts = tables._newest()[0]["tables"]["products"]
    listed = {len(p["buckets"]): len(tables._paths("products", p, p["buckets"])) for p in (*whole, *parts)}
    assert listed == {8: 1, 1: 1, 7: 7}
    assert skus(tables) == {r["sku"]: r["title"] for b in range(8) for r in tables.read("products", [b]).collect()}


def test_only_two_commits_are_kept(tables, spark, tmp_path):
    for number in range(5):
        change = tables.begin(f"w{number}")
        change.replace("feed_files", spark.createDataFrame([(f"f{number}", 1)], "file string, job_id bigint"))
        change.commit()
    assert len(os.listdir(tmp_path / "store/_commits")) <= 6  # with checksum files, at most three commits
    left = [d for d, _, names in os.walk(tmp_path / "store/feed_files") if any(n.endswith(".parquet") for n in names)]
    assert len(left) == 2
    assert [r["file"] for r in tables.read("feed_files").collect()] == ["f4"]


def test_counted_writers_and_readers_by_time(tables, spark):
    schema = ("price_id bigint, product_id bigint, source string, competitor_title string, competitor_url string, "
              "competitor_price double, competitor_currency string, in_stock boolean, scraped_at timestamp")
    for number, day in enumerate((1, 5, 9)):
        change = tables.begin(f"stream:x:{number}", counted=True)
        change.append("competitor_prices", spark.createDataFrame(
            [(day, 1, "a", None, None, 1.0, "USD", True, datetime(2024, 3, day))], schema))
        change.commit()
    assert tables.begin("stream:x:1", counted=True) is None and tables.begin("stream:x:3", counted=True) is not None
    micros = [int(datetime(2024, 3, d).replace(tzinfo=None).timestamp()) * 1_000_000 for d in (4, 6)]
    shift = spark.sql("SELECT unix_micros(TIMESTAMP '2024-03-04 00:00:00')").first()[0] - micros[0]
    found = tables.read("competitor_prices", times=[m + shift for m in micros])
    assert [r["price_id"] for r in found.collect()] == [5]


def test_issues_and_alerts_change_and_products_go_with_them(tables, spark, tmp_path):
    ingest_feed(tables, feed(tmp_path, "a.csv", "a,A,1", "b,B,2", "c,C,3"), T1)
    issues = tables.read("data_issues").filter(F.col("issue_type") == "missing_description")
    resolve_stored(tables, issues.select("issue_id"), T2, "r1")
    resolve_stored(tables, issues.select("issue_id"), T2, "r1")  # again: does nothing
    done = tables.read("data_issues").filter("resolved")
    assert done.count() == 3 and {r["resolved_at"] for r in done.collect()} == {T2}
    change = tables.begin("alerts")
    ids = [r["product_id"] for r in tables.read("products").collect()]
    change.append("competitor_alerts", spark.createDataFrame(
        [(n, i, "undercut", "amazon", "m", 1.0, 1.0, 0.0, False, T1) for n, i in enumerate(ids)],
        "alert_id bigint, product_id bigint, alert_type string, source string, message string, our_price double, "
        "competitor_price double, price_difference double, acknowledged boolean, created_at timestamp"))
    change.commit()
    acknowledge_stored(tables, spark.createDataFrame([(1,), (9,)], "alert_id bigint"), "a1")
    assert [r["alert_id"] for r in tables.read("competitor_alerts").filter("acknowledged").collect()] == [1]
    doomed = tables.read("products").filter("sku = 'b'").select("product_id")
    delete_stored(tables, spark.createDataFrame(doomed.collect(), doomed.schema), "d1")
    assert set(skus(tables)) == {"a", "c"}
    assert tables.read("data_issues").count() == 4 and tables.read("competitor_alerts").count() == 2


def test_generated_texts_and_closed_issues_are_stored_together(tables, spark, tmp_path):
    ingest_feed(tables, feed(tmp_path, "a.csv", "a,A,1", "b,B,2"), T1)
    ids = tables.read("products").select("product_id")

    def write(system, prompt, temperature, max_tokens):
        return "A text." if "JSON" not in system else '{"seo_title": "s", "seo_keywords": "k"}'

    summary = generate_stored(tables, ids, write, T2, "g1")
    assert (summary["succeeded"], summary["requested"]) == (2, 2)
    assert {(r["generated_description"], r["seo_title"]) for r in tables.read("products").collect()} == {("A text.", "s")}
    closed = tables.read("data_issues").filter("resolved").collect()
    assert {r["issue_type"] for r in closed} == {"missing_description"} and len(closed) == 2
    assert generate_stored(tables, ids, write, T2, "g1") is None


def test_the_price_job_is_stored_once(tables, spark, tmp_path):
    ingest_feed(tables, feed(tmp_path, "a.csv", "a,A,100"), T1)
    product = tables.read("products").first()["product_id"]
    html = ('<div data-component-type="s-search-result"><h2><a href="/dp/1"><span>A</span></a></h2>'
            '<span class="a-price-whole">50.</span><span class="a-price-fraction">00</span></div>')
    pages = spark.createDataFrame([(1, product, "amazon", "u", html)],
                                  "page_id bigint, product_id bigint, source string, url string, html string")
    for _ in range(2):
        scrape(tables, pages, T2, "run-1")
    assert tables.read("competitor_prices").count() == 1 and tables.read("latest_prices").count() == 1
    assert [r["alert_type"] for r in tables.read("competitor_alerts").collect()] == ["undercut"]


def test_a_stored_job_leaves_no_intermediate_tables(tables, spark, tmp_path):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    ingest_feed(tables, feed(tmp_path, "a.csv", "a,A,1"), T1)
    pages = spark.createDataFrame([], "page_id bigint, product_id bigint, source string, url string, html string")
    scrape(tables, pages, T2, "run-1")
    assert set(os.listdir(folder)) == before


def test_parts_do_not_grow_with_the_history(tables, spark):
    """Many small commits: the list of parts stays short, no row is lost, old folders go."""
    held = []
    for number in range(24):
        change = tables.begin(f"stream:x:{number}", counted=True)
        change.append("competitor_alerts", spark.createDataFrame(
            [(number, number % 3, "undercut", "amazon", "m", 1.0, 1.0, 0.0, False, T1)], tables.read("competitor_alerts").schema))
        change.commit()
        merge_parts(tables, 3)
        held.append(len(tables._newest()[0]["tables"]["competitor_alerts"]))
    assert max(held) <= 9
    assert sorted(r["alert_id"] for r in tables.read("competitor_alerts").collect()) == list(range(24))
    state = tables._newest()[0]
    assert len(state["writers"]) == 2
    change = tables.begin("x")
    change.replace("competitor_alerts", change.read("competitor_alerts", [0]).limit(0), [0])
    change.commit()
    assert tables.full_tables(3) == []


def test_a_merge_gives_way_to_another_commit(tables, spark, monkeypatch):
    rows = spark.createDataFrame([("f", 1)], "file string, job_id bigint")

    def add(name):
        change = tables.begin(name)
        change.append("feed_files", rows)
        change.commit()

    for name in "abc":
        add(name)
    whole = Tables.begin
    monkeypatch.setattr(Tables, "begin", lambda self, name, *a, **k: (whole(self, name, *a, **k), monkeypatch.undo(), add("other"))[0])
    merge_parts(tables, 3)
    assert tables.read("feed_files").count() == 4
    merge_parts(tables, 3)
    assert tables.read("feed_files").count() == 4 and len(tables._newest()[0]["tables"]["feed_files"]) == 1


def test_a_feed_rewrites_only_buckets_with_known_skus(spark, tmp_path):
    """New SKUs are added beside what is stored; a known one costs its bucket."""
    tables = Tables(spark, str(tmp_path / "tables"))

    def parts(number, *skus):
        path = tmp_path / f"{number}.csv"
        path.write_text("sku,title\n" + "".join(f"{sku},title {number}\n" for sku in skus))
        ingest_feed(tables, str(path), datetime(2024, 6, number))
        return {p["part"]: p["buckets"] for p in tables._newest()[0]["tables"]["products"]}

    first = parts(1, *[f"A{i}" for i in range(60)])
    second = parts(2, *[f"B{i}" for i in range(60)])
    assert first.items() <= second.items() and len(second) == 2
    third = parts(3, "A7", "C1")
    moved = tables.buckets_of("products", spark.createDataFrame([("A7",)], "sku string"))
    assert {part: sorted({*buckets} - {*moved}) for part, buckets in second.items()}.items() <= third.items()
    titles = {r["sku"]: r["title"] for r in tables.read("products").collect()}
    assert len(titles) == tables.read("products").count() == 121 and titles["A7"] == "title 3" and titles["A8"] == "title 1"
