"""Feeds: reading, header mapping, cleaning, checks, upsert and the job log."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfloom.operators.changes import upsert_products
from shelfloom.operators.cleaning import (
    clean_rows, feed_rows, last_per_sku, map_headers, storable_rows,
)
from shelfloom.plans import queries
from shelfloom.plans.feed_job import ingest_feed, run_feed
from shelfloom.schemas import PRODUCTS
from shelfloom.sources.feeds import header_names, is_csv_name, open_feed
from shelfloom.sources.tables import Tables

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)

HEADER = "sku,title,description,category,brand,price,currency,color,size,material,weight"
SAMPLE = [
    'G1,Fern Garden Gloves,"The Fern gloves protect hands from thorns and stay dry in wet grass.",Garden,Fern,14.25,eur,Green,m,ctn,0.12kg',
    "G2,Oak Plant Stand,Solid stand,Furniture,Oakley,89.5,EUR,Walnut,,Oak Wood,7kg",
    "G3,Miller's Apron,,Kitchen,Miller's,22.00,usd,Grn,lg,nyl,0.3kg",
    "G4,Lamp Nova 40,A lamp with warm light,Lighting,Nova,61.99,USD,blk,,,1.4kg",
    'G5,Kettle Brio,"",Kitchen,Brio,45,,Gold,,Porcelain,2kg',
    "G6,Travel Mug,n/a,Kitchen,Brio,18.4,USD,Matte Black,,,",
]


def empty_products(spark):
    return spark.createDataFrame([], PRODUCTS)


def write_feed(folder, name, lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def clean(spark, path):
    feed = open_feed(spark, path)
    return storable_rows(clean_rows(feed_rows(feed.rows(), feed.headers), feed.headers))


def job(result):
    return result.job.first().asDict()


def test_csv_names():
    assert is_csv_name("a.CSV") and is_csv_name("b.csv") and not is_csv_name("b.csv.gz")


def test_header_names_are_made_distinct():
    assert header_names(["a", "", "a", "a"]) == ["a", "Unnamed: 1", "a.1", "a.2"]


def test_first_alias_in_preference_order_wins_and_last_of_equal_headers():
    found = map_headers(["list_price", " Price ", "NAME", "Color", "COLOR", "asin"])
    assert found == {"sku": 5, "title": 2, "price": 1, "color": 4}


def test_sample_feed(spark, tmp_path):
    result = run_feed(spark, write_feed(tmp_path, "feed.csv", [HEADER, *SAMPLE]),
                      empty_products(spark), T1, job_id=1)
    row = job(result)
    assert (row["total_rows"], row["processed_rows"], row["new_products"], row["updated_products"]) == (6, 6, 6, 0)
    assert row["status"] == "completed" and row["completed_at"] == T1 and row["filename"] == "feed.csv"
    products = {r["sku"]: r for r in result.products.collect()}
    assert {sku: r["attributes"] for sku, r in products.items()} == {
        "G1": {"color": "Green", "size": "M", "material": "Cotton", "weight": "0.12Kg"},
        "G2": {"color": "Walnut", "material": "Oak Wood", "weight": "7Kg"},
        "G3": {"color": "Green", "size": "L", "material": "Nylon", "weight": "0.3Kg"},
        "G4": {"color": "Black", "weight": "1.4Kg"},
        "G5": {"color": "Gold", "material": "Porcelain", "weight": "2Kg"},
        "G6": {"color": "Matte Black"},
    }
    assert {sku: (r["price"], r["currency"]) for sku, r in products.items()} == {
        "G1": (14.25, "EUR"), "G2": (89.5, "EUR"), "G3": (22.0, "USD"), "G4": (61.99, "USD"), "G5": (45.0, "USD"),
        "G6": (18.4, "USD")}
    assert {r["status"] for r in products.values()} == {"flagged"}
    assert products["G5"]["description"] is None and products["G6"]["description"] is None
    issues = {}
    for r in result.issues.collect():
        issues.setdefault(r["product_id"], []).append(r)
    types = {
        sku: sorted(r["issue_type"] for r in issues[p["product_id"]]) for sku, p in products.items()
    }
    assert types == {
        "G1": ["thin_content"],
        "G2": ["attribute_contradiction", "attribute_contradiction", "thin_content"],  # "tan" in "stand", twice
        "G3": ["missing_description"],
        "G4": ["missing_attributes", "thin_content"],
        "G5": ["missing_description"],
        "G6": ["missing_attributes", "missing_description"],
    }
    assert row["issues_found"] == sum(len(v) for v in issues.values()) == 10
    found = sorted(r["actual_value"] for r in issues[products["G2"]["product_id"]]
                   if r["issue_type"] == "attribute_contradiction")
    assert found == ["'tan' found in description", "'tan' found in title"]


def test_aliases_extras_prices_and_text_keys(spark, tmp_path):
    path = write_feed(tmp_path, "alias.csv", [
        "product_code,Name,details,manufacturer,list_price,sale_price,colour,ean,Ship Class,Currency_Code",
        '00123,"  Big   box ",none,ACME,"1,299.00",$9,wht,0042,A b,eur',
        'P2,,"two\nlines, quoted ""x""",nan,$5,N/A,None,,n/a,',
        "P3,x,y,z,USD 12,3,,, NONE ,usd",
        "P4,x,y,z,12d,3,,,q,",
        ",no sku,,,1,,,,,",
        ",,,,,,,,,",
    ])
    rows = {r["sku"]: r for r in clean(spark, path).collect()}
    assert set(rows) == {"00123", "P2", "P3", "P4"}
    first = rows["00123"]
    assert first["title"] == "Big box" and first["description"] is None
    assert first["price"] == 1299.0 and first["currency"] == "EUR" and first["brand"] == "ACME"
    assert first["attributes"] == {"color": "White", "upc": "0042", "sale_price": "$9", "ship_class": "A b"}
    second = rows["P2"]
    assert second["title"] == "P2" and second["description"] == 'two lines, quoted "x"'
    assert second["price"] == 5.0 and second["currency"] == "USD" and second["brand"] is None
    assert second["attributes"] == {}
    assert rows["P3"]["price"] is None and rows["P4"]["price"] is None
    assert rows["P3"]["attributes"] == {"sale_price": "3"}
    assert '"Ship Class":null' in second["raw_data"]


def test_headers_equal_up_to_case(spark, tmp_path):
    path = write_feed(tmp_path, "case.csv", ["SKU,Color,COLOR", "a,blk,wht"])
    row = clean(spark, path).first()
    # The last of the two is the color; the first is an extra of the same name and wins.
    assert row["attributes"] == {"color": "blk"}
    assert row["raw_data"] == '{"SKU":"a","Color":"blk","COLOR":"wht"}'


def test_duplicate_skus_last_line_wins_currency_of_first(spark, tmp_path):
    path = write_feed(tmp_path, "dup.csv", [
        "sku,title,currency,price", "a,one,eur,1", "b,x,usd,2", "a,two,gbp,", "a,three,inr,4",
    ])
    result = run_feed(spark, path, empty_products(spark), T1, 1)
    row = job(result)
    assert (row["processed_rows"], row["new_products"], row["updated_products"]) == (4, 2, 2)
    products = {r["sku"]: r for r in result.products.collect()}
    assert products["a"]["title"] == "three" and products["a"]["currency"] == "EUR"
    assert products["a"]["price"] == 4.0
    # Every line is checked, so a's issues appear three times.
    assert result.issues.filter(F.col("product_id") == products["a"]["product_id"]).count() == 6
    assert result.issues.select("issue_id").distinct().count() == result.issues.count() == 8


@pytest.mark.parametrize("lines, status, message, completed", [
    (["sku,title"], "completed", "CSV file is empty or contains only headers.", None),
    (["sku,title", ",", "  ".strip() + ",N/A"], "completed",
     "CSV file is empty or contains only headers.", None),
    (["code,title", "a,b"], "failed",
     "CSV must contain a SKU/product_id column. Found columns: code, title", None),
    (["sku,title", "a,b,c"], "failed",
     "Failed to parse CSV: 1 lines have more fields than the header", T1),
])
def test_job_outcome_without_rows(spark, tmp_path, lines, status, message, completed):
    result = run_feed(spark, write_feed(tmp_path, "x.csv", lines), empty_products(spark), T1, 1)
    row = job(result)
    assert (row["status"], row["error_message"], row["completed_at"]) == (status, message, completed)
    assert result.products is None


def test_a_file_that_is_no_csv_is_refused(spark, tmp_path):
    path = write_feed(tmp_path, "feed.xlsx", ["sku,title", "a,b"])
    row = job(run_feed(spark, path, empty_products(spark), T1, 1))
    assert (row["status"], row["error_message"]) == ("failed", "File must be a CSV file (.csv extension).")
    loud = write_feed(tmp_path, "FEED.CSV", ["sku,title", "a,b"])
    assert job(run_feed(spark, loud, empty_products(spark), T1, 1))["status"] == "completed"


def test_unreadable_feed_is_a_failed_job(spark, tmp_path):
    row = job(run_feed(spark, str(tmp_path / "none.csv"), empty_products(spark), T1, 1))
    assert row["status"] == "failed" and row["error_message"].startswith("Unexpected error: ")
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    row = job(run_feed(spark, str(empty), empty_products(spark), T1, 1))
    assert row["error_message"] == "Unexpected error: No columns to parse from file"


def test_texts_of_any_length_reach_the_catalog(spark, tmp_path):
    lines = ["sku,title,currency", "a,ok,EUR", f"{'x' * 101},{'t' * 1000},{'c' * 16}"]
    path = write_feed(tmp_path, "long.csv", lines)
    rows = {r["sku"]: r for r in run_feed(spark, path, empty_products(spark), T1, 1).products.collect()}
    assert set(rows) == {"a", "x" * 101} and rows["x" * 101]["title"] == "t" * 1000


def test_widths_are_the_callers(spark, tmp_path):
    path = write_feed(tmp_path, "long.csv", ["sku,title", "a,ok", f"{'x' * 101},t", f"b,{'t' * 501}"])
    tables = Tables(spark, str(tmp_path / "store"))
    ingest_feed(tables, path, T1, 4, widths={"sku": 100, "title": 500})
    assert [r["sku"] for r in tables.read("products").collect()] == ["a"]
    assert sorted(r["reject_reason"] for r in tables.read("quarantine").collect()) == [
        "sku is longer than 100 characters", "title is longer than 500 characters"]
    assert tables.read("data_issues").count() == 2


def test_second_feed_overwrites_with_null_and_keeps_the_rest(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "store"))
    first = write_feed(tmp_path, "one.csv", ["sku,title,brand,price,currency", "a,A,B,5,eur", "b,B,B,6,usd"])
    ingest_feed(tables, first, T1)
    change = tables.begin("generated texts")
    change.replace("products", change.read("products").withColumn("generated_description", F.lit("gen")))
    change.commit()
    second = write_feed(tmp_path, "two.csv", ["sku,title,price,currency", "a,A2,,usd", "c,C,1,inr"])
    ingest_feed(tables, second, T2)
    rows = {r["sku"]: r for r in tables.read("products").collect()}
    assert rows["a"]["title"] == "A2" and rows["a"]["price"] is None and rows["a"]["brand"] is None
    assert rows["a"]["currency"] == "EUR" and rows["a"]["generated_description"] == "gen"
    assert (rows["a"]["created_at"], rows["a"]["updated_at"]) == (T1, T2)
    assert rows["b"]["updated_at"] == T1 and rows["c"]["created_at"] == T2
    assert rows["c"]["generated_description"] is None
    jobs = {r["job_id"]: r for r in tables.read("ingestion_jobs").collect()}
    assert (jobs[2]["new_products"], jobs[2]["updated_products"]) == (1, 1)
    assert tables.read("data_issues").count() == 4 + 4


def test_files_of_a_folder_go_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    write_feed(folder, "a.csv", ["sku,title,price", "A1,x,1"])
    write_feed(folder, "b.csv", ["title,sku", "y,A2"])
    write_feed(folder, "c.csv", ["colour,price,sku,title", "blk,3,A3,z", ",4,A1,again"])
    result = run_feed(spark, str(folder), empty_products(spark), T1, 1)
    rows = {r["sku"]: (r["title"], r["price"], r["attributes"]) for r in result.products.collect()}
    assert rows == {"A1": ("again", 4.0, {}), "A2": ("y", None, {}), "A3": ("z", 3.0, {"color": "Black"})}
    write_feed(folder, "d.csv", ["title,sku", "y,A2,too much"])
    row = job(run_feed(spark, str(folder), empty_products(spark), T1, 2))
    assert row["error_message"] == "Failed to parse CSV: 1 lines have more fields than the header"


def test_upsert_moves_only_what_changes(spark, tmp_path):
    feed = write_feed(tmp_path, "f.csv", [HEADER, *SAMPLE])
    empty = empty_products(spark)
    current = run_feed(spark, feed, empty, T1, 1).products
    other = write_feed(tmp_path, "g.csv", [HEADER, SAMPLE[0], SAMPLE[1].replace("89.5", "7"),
                                           SAMPLE[2].replace("G3", "Z3")])
    checked = clean(spark, other).withColumn("status", F.lit("flagged"))
    latest = last_per_sku(checked)
    order = sorted(PRODUCTS.fieldNames())
    after = upsert_products(current, latest, T2).select(*order).collect()
    moved = {r["sku"]: r["updated_at"] for r in after}
    assert len(after) == len(moved) == 7
    assert moved["G1"] == T1 and moved["G2"] == T2 and moved["Z3"] == T2 and moved["G5"] == T1


def test_last_lines_are_picked_without_sorting_texts(spark):
    feed = spark.createDataFrame([], "sku string, title string, currency string, _order struct<_file:string,_start:bigint,_line:bigint>")
    plan = last_per_sku(feed)._jdf.queryExecution().executedPlan().toString()
    sorted_by = [line for line in plan.split("\n") if "SortAggregate" in line]
    assert not any("title" in line for line in sorted_by)


def test_split_files_keep_feed_order(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for part in range(3):
        write_feed(folder, f"p{part}.csv", ["sku,title", *[f"s{i},part{part}" for i in range(50)]])
    latest = last_per_sku(clean(spark, str(folder)))
    assert latest.count() == 50
    assert {(r["title"], r["lines"]) for r in latest.collect()} == {("part2", 3)}


def test_large_feed_is_written_as_several_files(spark):
    lines = spark.range(1000).repartition(9)
    assert queries._whole_files(lines, 0).rdd.getNumPartitions() == 1
    assert queries._whole_files(lines, queries.FILE_BYTES).rdd.getNumPartitions() == 1
    many = queries._whole_files(lines, 3 * queries.FILE_BYTES + 1)
    assert many.rdd.getNumPartitions() == 4 and many.count() == 1000
