"""Reads, partial updates, creation, deletion, resolving, acknowledging."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfloom.operators import catalog, changes
from shelfloom.operators.quality import issue_rows, with_issues
from tests.test_content import NOW, OLD, issue, product, products
from shelfloom.schemas import DATA_ISSUES, INGESTION_JOBS


def ids(frame, name="product_id"):
    return [r[name] for r in frame.collect()]


def catalog_rows(spark):
    return products(
        spark,
        product(1, title="Red Lamp", brand="Acme", category="Home", status="active", updated_at=OLD),
        product(2, title="Blue lamp", brand=None, category="Home", status="flagged", updated_at=NOW),
        product(3, title="Chair", brand="REDwood", category=None, status="active", updated_at=NOW),
        product(4, title="50% off", brand="x_y", category="Sale", status="draft", updated_at=OLD),
    )


def test_filters_and_search(spark):
    rows = catalog_rows(spark)

    def found(**filters):
        return sorted(ids(catalog.filter_products(rows, **filters)))

    assert found() == found(status="", category="", search="") == [1, 2, 3, 4]
    assert found(status="active") == [1, 3] and found(category="Home", status="flagged") == [2]
    assert found(search="red") == [1, 3] and found(search="sku-4") == [4]
    assert found(search="l_mp") == [1, 2] and found(search="b%lamp") == [2]


def test_pages_by_offset_and_by_key(spark):
    rows = catalog_rows(spark)
    assert ids(catalog.product_page(rows)) == [2, 3, 1, 4]
    assert ids(catalog.product_page(rows, skip=1, limit=2)) == [3, 1]
    assert ids(catalog.product_page(rows, limit=2, after=(NOW, 2))) == [3, 1]
    assert ids(catalog.product_page(rows, after=(OLD, 1))) == [4]


def test_issue_counts_and_lists(spark):
    rows = catalog_rows(spark)
    issues = spark.createDataFrame(
        [issue(1, 1, "thin_content"), issue(2, 1, "thin_content", True), issue(3, 2, "thin_content", True),
         issue(4, 1, "missing_attributes")], DATA_ISSUES)
    counts = {r["product_id"]: r["issue_count"] for r in catalog.with_issue_counts(rows, issues).collect()}
    assert counts == {1: 2, 2: 0, 3: 0, 4: 0}
    assert ids(catalog.list_issues(issues, limit=1), "issue_id") == [4]
    assert ids(catalog.list_issues(issues, resolved=True), "issue_id") == [3, 2]
    listed = catalog.list_products(rows, issues, skip=1, limit=2).collect()
    assert [(r["product_id"], r["issue_count"]) for r in listed] == [(3, 0), (1, 2)]
    page = rows.filter("product_id = 2")
    assert ids(catalog.issues_of(issues, page), "issue_id") == [3]


def test_categories_and_duplicates(spark):
    rows = catalog_rows(spark)
    assert ids(catalog.categories(rows), "category") == ["Home", "Sale"]
    twice = rows.unionByName(products(spark, product(9, title=" RED  LAMP ")))
    assert [tuple(r) for r in catalog.duplicate_titles(twice).collect()] == [("red lamp", 2)]


def test_stats_on_empty_and_filled_tables(spark):
    jobs = spark.createDataFrame([], INGESTION_JOBS)
    issues = spark.createDataFrame([issue(1, 1, "thin_content"), issue(2, 1, "thin_content", True)], DATA_ISSUES)
    alerts = spark.createDataFrame([(True,), (False,), (False,)], "acknowledged boolean")
    stats = catalog.dashboard_stats(catalog_rows(spark), issues, alerts, jobs).first().asDict()
    assert stats == {
        "total_products": 4, "active_products": 2, "flagged_products": 1, "products_without_description": 4,
        "open_issues": 1, "recent_alerts": 2, "last_ingestion": None}
    log = spark.createDataFrame(
        [(n, "f", 0, 0, 0, 0, 0, "completed", None, OLD + timedelta(days=n), None) for n in range(30)],
        INGESTION_JOBS)
    assert catalog.dashboard_stats(catalog_rows(spark), issues, alerts, log).first()["last_ingestion"] == OLD + timedelta(days=29)
    assert ids(catalog.list_jobs(log), "job_id") == list(range(29, 9, -1))


def test_patches(spark):
    rows = catalog_rows(spark)
    patches = spark.createDataFrame(
        [(1, "New", None, ["title", "brand"], 1), (1, "Newer", "ignored", ["title"], 2), (2, "Blue lamp", "n", ["title"], 1)],
        "product_id bigint, title string, brand string, set_fields array<string>, seq int")
    after = {r["product_id"]: r for r in changes.patch_products(rows, patches, NOW + timedelta(1), "seq").collect()}
    assert (after[1]["title"], after[1]["brand"]) == ("Newer", None)
    assert after[1]["updated_at"] == NOW + timedelta(1)
    # Setting a value a product already has does not touch it.
    assert after[2]["updated_at"] == NOW and after[2]["brand"] is None
    assert after[3]["brand"] == "REDwood"


def test_create_rejects_known_skus(spark):
    requested = spark.createDataFrame([("SKU-1", "again", None), ("N", "new", 3.0)], "sku string, title string, price double")
    created, rejected = changes.create_products(catalog_rows(spark), requested, NOW)
    row = created.first()
    assert created.count() == 1 and (row["sku"], row["status"], row["currency"], row["price"]) == ("N", "draft", "USD", 3.0)
    assert row["attributes"] == {} and row["created_at"] == NOW
    assert ids(rejected, "sku") == ["SKU-1"]


def test_delete_with_children(spark):
    children = spark.createDataFrame([(i % 5, i) for i in range(10)], "product_id bigint, n int")
    doomed = spark.createDataFrame([(1,), (1,), (77,)], "product_id bigint")
    left, rest = changes.delete_products(doomed, catalog_rows(spark), children)
    assert sorted(ids(left)) == [2, 3, 4] and rest.count() == 8


def test_resolve_and_acknowledge(spark):
    issues = spark.createDataFrame([issue(1, 1, "a"), issue(2, 1, "a", True), issue(3, 1, "a")], DATA_ISSUES)
    chosen = spark.createDataFrame([(1,), (2,), (1,), (9,)], "issue_id bigint")
    after = {r["issue_id"]: (r["resolved"], r["resolved_at"]) for r in changes.resolve_issues(issues, chosen, NOW).collect()}
    assert after == {1: (True, NOW), 2: (True, NOW), 3: (False, None)}
    alerts = spark.createDataFrame([(1, False), (2, True), (3, False)], "alert_id bigint, acknowledged boolean")
    acked = changes.acknowledge_alerts(alerts, spark.createDataFrame([(1,)], "alert_id bigint"))
    assert {r["alert_id"]: r["acknowledged"] for r in acked.collect()} == {1: True, 2: True, 3: False}


def test_issue_order_within_a_product(spark):
    frame = spark.createDataFrame(
        [("S", "Red thing", None, {"color": "Blue"})],
        "sku string, title string, description string, attributes map<string,string>")
    rows = issue_rows(with_issues(frame), ["sku"]).orderBy("position").collect()
    assert [(r["position"], r["issue_type"], r["severity"]) for r in rows] == [
        (0, "missing_description", "high"), (1, "attribute_contradiction", "high"), (2, "missing_attributes", "low")]
    assert rows[2]["description"] == (
        "Product 'S' is missing attributes: size, material. Adding these can improve content quality.")


def test_reads_are_pushed_down(spark, tmp_path):
    catalog_rows(spark).write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    plan = catalog.filter_products(rows, status="active").select("sku")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,active)" in plan and "ReadSchema: struct<sku:string,status:string>" in plan
    top = catalog.product_page(rows.select("product_id", "updated_at"), limit=5)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
