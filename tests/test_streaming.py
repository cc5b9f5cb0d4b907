"""The streams leave what the batch jobs would."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfloom.operators import cleaning, prices as px
from shelfloom.plans import feed_job, testviews as tv
from shelfloom.plans.feed_job import checked_lines, run_feed
from shelfloom.plans.store_changes import acknowledge_stored
from shelfloom.operators.steps import Steps
from shelfloom.schemas import COMPETITOR_PRICES, PRODUCTS
from shelfloom.session import at_once, intermediate, settle
from shelfloom.sources.tables import Tables
from shelfloom.streaming.feeds import feed_stream, ingest_feeds
from shelfloom.streaming.prices import monitor_prices
from tests.test_prices import as_set, products, random_rows, snapshot, table

NOW = datetime(2024, 6, 1)


def test_price_stream_equals_batch(spark, tmp_path):
    rows = sorted(random_rows(150, 5), key=lambda r: (r[8], r[0]))
    ours = products(spark)
    root = str(tmp_path)

    def drop(part):
        table(spark, *part).coalesce(1).write.mode("append").parquet(f"{root}/drops")
        stream = spark.readStream.schema(COMPETITOR_PRICES).parquet(f"{root}/drops")
        monitor_prices(stream, lambda: ours, f"{root}/tables", f"{root}/state", 20).awaitTermination()

    for part in (rows[:60], rows[60:110], rows[110:]):
        drop(part)
    tables = Tables(spark, f"{root}/tables")
    assert as_set(tables.read("competitor_alerts")) == as_set(px.history_alerts(table(spark, *rows), ours))
    stored = tables.read("competitor_prices")
    assert stored.count() == 150
    before = as_set(tables.read("latest_prices"))
    # A late snapshot without a predecessor is stored, moves no state and has no change to tell.
    drop([snapshot(999, 500.0, day=-3, product=1, source=rows[0][2])])
    assert as_set(tables.read("latest_prices")) == before
    late = tables.read("competitor_alerts").filter(F.col("created_at") < px.F.lit(rows[0][8]))
    assert late.filter(F.col("alert_type").startswith("price_")).count() == 0


def drops_of(spark, root, ours, parts, state="state", rows_per_task=20):
    for part in parts:
        table(spark, *part).coalesce(1).write.mode("append").parquet(f"{root}/drops")
        stream = spark.readStream.schema(COMPETITOR_PRICES).parquet(f"{root}/drops")
        monitor_prices(stream, lambda: ours, f"{root}/tables", f"{root}/{state}", rows_per_task).awaitTermination()
    return Tables(spark, f"{root}/tables")


@pytest.mark.parametrize("seed, rows_per_task", [(1, 1000), (2, 15)])
def test_any_order_of_drops_gives_the_alerts_of_one_batch(spark, tmp_path, seed, rows_per_task):
    rows = random_rows(160, 30 + seed)
    random.Random(seed).shuffle(rows)
    ours = products(spark)
    parts = [rows[:50], rows[50:90], rows[90:91], rows[91:]]
    tables = drops_of(spark, str(tmp_path), ours, parts, rows_per_task=rows_per_task)
    want = as_set(px.history_alerts(table(spark, *rows), ours))
    assert as_set(tables.read("competitor_alerts")) == want
    assert tables.read("competitor_alerts").count() == len(want) > 50
    assert as_set(tables.read("latest_prices")) == as_set(px.latest_priced(table(spark, *rows)))
    # A lost checkpoint brings all drops again.
    stream = spark.readStream.schema(COMPETITOR_PRICES).parquet(f"{tmp_path}/drops")
    monitor_prices(stream, lambda: ours, f"{tmp_path}/tables", f"{tmp_path}/fresh").awaitTermination()
    assert as_set(tables.read("competitor_alerts")) == want and tables.read("competitor_prices").count() == 160


def test_a_late_snapshot_withdraws_the_alert_behind_it(spark, tmp_path):
    ours = spark.createDataFrame([(1, 1.0, "USD")], "product_id bigint, price double, currency string")
    first = [snapshot(1, 100.0), snapshot(5, 200.0), snapshot(9, 300.0)]
    tables = drops_of(spark, str(tmp_path), ours, [first])

    def kinds():
        return {(r["created_at"].day - 1, r["alert_type"], r["price_difference"], r["acknowledged"])
                for r in tables.read("competitor_alerts").collect()}

    assert kinds() == {(5, "price_increase", 100.0, False), (9, "price_increase", 100.0, False)}
    acknowledge_stored(tables, tables.read("competitor_alerts").select("alert_id"), "all")
    drops_of(spark, str(tmp_path), ours, [[snapshot(3, 250.0)]])
    assert kinds() == {(3, "price_increase", 150.0, False), (5, "price_drop", 50.0, False), (9, "price_increase", 100.0, True)}
    # One of the same price as its predecessor leaves the alert behind it as it is.
    drops_of(spark, str(tmp_path), ours, [[snapshot(7, 200.0)], [snapshot(6, None)]])
    assert (9, "price_increase", 100.0, True) in kinds() and len(kinds()) == 3
    # Without a change of ten percent to the new predecessor, the alert goes.
    drops_of(spark, str(tmp_path), ours, [[snapshot(8, 299.0)]])
    assert {k[0] for k in kinds()} == {3, 5, 8}


def test_feed_stream_equals_batch_per_file(spark, tmp_path):
    lines = {
        "a.csv": ["SKU,name,price,Colour", "1,Red lamp,5,blk", "2,Chair,6,", '3,"Two\nlines",7,wht'],
        "b.CSV": ["SKU,name,price,Colour", "2,Chair two,,grn", "4,Desk,9,", "2,Chair three,8,"],
        "c.txt": ["SKU,name,price,Colour", "5,not a feed,1,"],
    }
    folder = tmp_path / "drops"
    folder.mkdir()
    root = str(tmp_path / "tables")
    current = spark.createDataFrame([], PRODUCTS)
    issues = 0
    for number, (name, text) in enumerate(lines.items()):
        (folder / name).write_text("\n".join(text) + "\n")
        stream = feed_stream(spark, str(folder))
        ingest_feeds(stream, root, str(tmp_path / "state"), lambda: NOW + timedelta(number)).awaitTermination()
        if name.lower().endswith(".csv"):
            result = run_feed(spark, str(folder / name), current, NOW + timedelta(number), number)
            current = spark.createDataFrame(result.products.collect(), PRODUCTS)
            issues += result.issues.count()
    tables = Tables(spark, root)
    columns = [c for c in PRODUCTS.fieldNames() if c != "attributes"]
    key = lambda r: r["sku"]
    assert sorted(tables.read("products").select(*columns).collect(), key=key) == sorted(
        current.select(*columns).collect(), key=key)
    assert tables.read("data_issues").count() == issues
    jobs = tables.read("ingestion_jobs").orderBy("job_id").collect()
    assert [(j["new_products"], j["updated_products"]) for j in jobs] == [(3, 0), (1, 2)]


def test_files_of_one_batch_go_by_their_own_headers_and_fail_alone(spark, tmp_path):
    folder, root = tmp_path / "drops", str(tmp_path / "tables")
    folder.mkdir()
    files = {"a b.csv": ["sku,title,price", "1,one,5", '2,"two\nlines",6'], "b.csv": ["title,sku", "three,3"],
             "c.csv": ["sku,title", "4,four,too much", "5,five"], "d.csv": ["price,sku,title", "7,1,one again"]}
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + "\n")

    def run(state):
        stream = feed_stream(spark, str(folder), files_per_batch=4)
        ingest_feeds(stream, root, str(tmp_path / state), lambda: NOW).awaitTermination()

    def jobs():
        return [(j["job_id"], j["filename"], j["status"], j["processed_rows"])
                for j in Tables(spark, root).read("ingestion_jobs").orderBy("job_id").collect()]

    run("state")
    tables = Tables(spark, root)
    assert jobs() == [(1, "c.csv", "failed", 0), (2, "a b.csv, b.csv, d.csv", "completed", 4)]
    error = tables.read("ingestion_jobs").filter("status = 'failed'").first()["error_message"]
    assert error == "Failed to parse CSV: 1 lines have more fields than the header"
    rows = {r["sku"]: (r["title"], r["price"]) for r in tables.read("products").collect()}
    assert rows == {"1": ("one again", 7.0), "2": ("two lines", 6.0), "3": ("three", None)}
    assert tables.read("feed_files").count() == 4
    run("fresh")  # a lost checkpoint brings all files again
    assert len(jobs()) == 2
    (folder / "e.csv").write_text("name,price\nno sku,3\n")
    (folder / "f.csv").write_text("sku,title\n9,nine\n")
    run("state")
    assert jobs()[2:] == [(3, "e.csv", "failed", 0), (4, "f.csv", "completed", 1)]
    (folder / "g.csv").write_text("name,price\nno sku,3\n")
    run("state")
    (folder / "h.csv").write_text("sku,title\n9,ten\n")
    run("state")
    assert [j[:2] for j in jobs()[4:]] == [(5, "g.csv"), (6, "h.csv")]


def test_a_feed_of_many_batches_makes_its_columns_once(spark, tmp_path, monkeypatch):
    """Making them is much of a small batch's time."""
    folder, calls, whole = tmp_path / "drops", [], feed_job.clean_rows
    folder.mkdir()
    monkeypatch.setattr(feed_job, "clean_rows", lambda *args: calls.append(args[1]) or whole(*args))
    for name in "abcd":
        (folder / f"{name}.csv").write_text("".join(["sku,title\n", *[f'{name}{i},"t\n{i}"\n' for i in range(9)], f"{name}1,again\n"]))
    (folder / "e.csv").write_text("title,sku\nother,e1\n")
    stream = feed_stream(spark, str(folder))
    ingest_feeds(stream, str(tmp_path / "tables"), str(tmp_path / "state"), lambda: NOW).awaitTermination()
    assert len(calls) == 2  # one for each order of columns
    tables = Tables(spark, str(tmp_path / "tables"))
    found = {r["sku"]: r["title"] for r in tables.read("products").collect()}
    want = {f"{name}{i}": "again" if i == 1 else f"t {i}" for name in "abcd" for i in range(9)}
    assert found == want | {"e1": "other"}
    jobs = tables.read("ingestion_jobs").orderBy("filename").collect()
    assert [(j["new_products"], j["updated_products"]) for j in jobs] == [(9, 1), (9, 1), (9, 1), (9, 1), (1, 0)]


def test_an_overlong_line_without_other_values_fails_its_file(spark, tmp_path):
    folder = tmp_path / "drops"
    folder.mkdir()
    (folder / "a.csv").write_text("sku,title\n1,one\n,,more\n")
    (folder / "b.csv").write_text("sku,title\n,\n2,two\n")
    (folder / "c.csv").write_text("sku,title\n,\n")
    stream = feed_stream(spark, str(folder), files_per_batch=3)
    ingest_feeds(stream, str(tmp_path / "tables"), str(tmp_path / "state"), lambda: NOW).awaitTermination()
    tables = Tables(spark, str(tmp_path / "tables"))
    assert [r["sku"] for r in tables.read("products").collect()] == ["2"]
    jobs = tables.read("ingestion_jobs").orderBy("job_id").collect()
    assert [(j["filename"], j["status"], j["total_rows"]) for j in jobs] == [("a.csv", "failed", 0), ("b.csv, c.csv", "completed", 1)]


def test_steps_taken_on_another_table_give_the_same(spark):
    names = [f"c{i}" for i in range(len(tv.FEED_HEADERS))]
    schema = ", ".join(f"{n} string" for n in [*names, "_overflow"]) + ", _order bigint"

    def rows(start):
        cells = [[f" S{k}", f"Red  lamp {k}", "A blue lamp. It shines.", "n/a", "x", "$5", None, "blk", "lg", "", "3kg", " air", None, k]
                 for k in range(start, start + 5)]
        return spark.createDataFrame(cells, schema)

    def checked(frame):
        return checked_lines(cleaning.feed_rows(frame, tv.FEED_HEADERS), tv.FEED_HEADERS)

    taken = checked(Steps(rows(0)))
    assert taken.columns == checked(rows(0)).columns
    for start in (0, 7):
        found = sorted(map(repr, taken.on(rows(start)).collect()))
        assert len(found) == 5 and found == sorted(map(repr, checked(rows(start)).collect()))


def test_steps_run_at_once_share_the_block_and_end_before_an_error(spark):
    ended = []

    def fails():
        raise ValueError("lost")

    with intermediate(spark):
        one, two = at_once(lambda: settle(spark.range(3), "one"), lambda: settle(spark.range(5), "two"))
        assert (one.count(), two.count()) == (3, 5)
        with pytest.raises(ValueError, match="lost"):
            at_once(fails, lambda: ended.append(settle(spark.range(7), "three").count()))
        assert ended == [7]
    with pytest.raises(Exception, match="(?i)not.*exist"):
        two.collect()
