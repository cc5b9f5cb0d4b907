"""The registered queries: each operator run over the whole of the given tables."""

from datetime import datetime
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.functions import money, search, text
from shelfloom.functions.attributes import normalize_with_dictionary
from shelfloom.functions.content import (
    description_prompt, display_description, seo_keyword_list, seo_prompt, seo_reply,
)
from shelfloom.functions.quality import with_content_score, with_contradictions
from shelfloom.operators import catalog, changes, cleaning, content, prices as px
from shelfloom.operators.quality import dictionary_contradictions, issue_rows
from shelfloom.plans import testviews as tv
from shelfloom.plans.feed_job import (
    checked_rows, feed_counts, ingest_feed, known_skus, run_feed,
)
from shelfloom.plans.kept_counts import kept_stats, recount, with_kept_issue_counts
from shelfloom.plans.page_directory import stored_page, write_directory
from shelfloom.plans.search_index import add_to_index, search_stored
from shelfloom.plans.store_changes import acknowledge_stored, delete_stored, resolve_stored
from shelfloom.schemas import COMPETITOR_ALERTS, PRODUCTS
from shelfloom.session import empty, new_folder, settle
from shelfloom.sources.pages import best_listings, read_listings
from shelfloom.sources.tables import Tables
from shelfloom.streaming.feeds import feed_stream, ingest_feeds
from shelfloom.streaming.prices import monitor_prices

RUN = datetime(2024, 6, 1)
NEXT_RUN = datetime(2024, 6, 2)
SEARCHES = ("blue", "SKU-12", "rand#1", "la%ge", "d_h", "no such thing", "ot r")
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def entries(attributes) -> F:
    """A map as sorted key=value text."""
    pairs = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";")


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- text and attributes ---------------------------------------------------

@query
def q_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tv.read(spark, sf_dir, "documents")
    clean = docs.select("doc_id", text.normalize_text(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.length("clean").cast("bigint").alias("chars"), F.md5("clean").alias("digest"))


@query
def q_title_case(spark, sf_dir):
    part = tv.read(spark, sf_dir, "part")
    raw = F.concat_ws("-", F.lit("levi's 0.8kg"), F.upper("p_name"), F.lower("p_brand"))
    return part.select("p_partkey", text.title_case(raw).alias("titled"))


@query
def q_attr_normalize(spark, sf_dir):
    attributes = F.col("attributes")
    return tv.products(spark, sf_dir, described=False).select(
        "product_id",
        *[attributes[name].alias(name) for name in ("color", "size", "material", "weight", "ship_class")],
    )


@query
def q_attr_dictionary(spark, sf_dir):
    """A user's own dictionary table: brand name to its lowest part type."""
    part = tv.read(spark, sf_dir, "part")
    dictionary = part.groupBy(F.lower("p_brand").alias("variant")).agg(
        F.min("p_type").alias("canonical"))
    values = part.select("p_partkey", F.upper("p_brand").alias("brand"))
    return normalize_with_dictionary(values, dictionary, "variant", "canonical", "brand")


@query
def q_na_tokens(spark, sf_dir):
    raw = tv.read(spark, sf_dir, "part").select(
        "p_partkey", tv.pick(tv.RAW_TOKENS, F.col("p_partkey")).alias("raw"))
    kept = raw.withColumn("kept", text.null_if_na(F.col("raw")))
    return kept.withColumn("filled", text.null_if_blank(text.normalize_text(F.col("kept"))))


# --- quality ---------------------------------------------------------------

@query
def q_content_score(spark, sf_dir):
    scored = with_content_score(tv.read(spark, sf_dir, "documents"), "text")
    c = F.col("content")
    return scored.select(
        "doc_id", c["score"].alias("score"), c["label"].alias("label"),
        c["word_count"].alias("word_count"), c["sentence_count"].alias("sentence_count"),
        F.array_join(c["issues"], "; ").alias("issues"),
    )


@query
def q_content_label_counts(spark, sf_dir):
    scored = with_content_score(tv.read(spark, sf_dir, "documents"), "text")
    return scored.groupBy(F.col("content.label").alias("label")).agg(F.count(F.lit(1)).alias("documents"))


@query
def q_contradictions(spark, sf_dir):
    found = with_contradictions(tv.products(spark, sf_dir))
    rows = found.select("product_id", F.posexplode_outer("contradictions").alias("position", "c"))
    return rows.filter(F.col("c").isNotNull()).select("product_id", "position", "c.field", "c.source", "c.expected", "c.actual")


@query
def q_brand_contradictions(spark, sf_dir):
    """Titles that start with another word than the brand attribute."""
    first = F.substring_index("p_name", " ", 1)
    brand = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.upper(first)).otherwise(F.col("p_brand"))
    rows = tv.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"),
        F.create_map(F.lit("Brand"), brand).alias("attributes"))
    found = with_contradictions(rows).select("product_id", F.explode_outer("contradictions").alias("c"))
    return found.filter(F.col("c").isNotNull()).select("product_id", "c.field", "c.source", "c.expected", "c.actual")


@query
def q_word_contradictions(spark, sf_dir):
    """Color contradictions by whole words."""
    found = with_contradictions(tv.products(spark, sf_dir), word_boundary=True)
    rows = found.select("product_id", F.posexplode_outer("contradictions").alias("position", "c"))
    return rows.filter(F.col("c").isNotNull()).select("product_id", "position", "c.field", "c.source", "c.expected", "c.actual")


@query
def q_dictionary_contradictions(spark, sf_dir):
    """Titles that name another entry of a dictionary than the part's own: all first words and names of parts, and all brands."""
    part = tv.read(spark, sf_dir, "part")
    words = part.select(F.substring_index("p_name", " ", 1).alias("word")).unionByName(
        part.select(F.col("p_name").alias("word"))).unionByName(part.select(F.col("p_brand").alias("word"))).distinct()
    rows = part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.concat_ws(
        " - ", "p_brand", "p_type").alias("description"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.col(
            "p_brand")).otherwise(F.element_at(F.split("p_name", " "), -1)).alias("value"))
    return dictionary_contradictions(rows, words.withColumn("rank", F.lower("word")), "finish")


@query
def q_issues(spark, sf_dir):
    return issue_rows(tv.checked_products(spark, sf_dir), ["product_id"])


@query
def q_issue_summary(spark, sf_dir):
    rows = issue_rows(tv.checked_products(spark, sf_dir), ["product_id"])
    return rows.groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query
def q_product_status(spark, sf_dir):
    checked = tv.checked_products(spark, sf_dir)
    return checked.select("product_id", F.size("issues").alias("issue_count"), "status")


# --- feeds and upsert ------------------------------------------------------

def _cleaned(spark, sf_dir):
    rows = cleaning.feed_rows(tv.feed_lines(spark, sf_dir), tv.FEED_HEADERS)
    return cleaning.storable_rows(cleaning.clean_rows(rows, tv.FEED_HEADERS))


def _clean_columns(rows):
    return rows.select(
        "sku", "title", F.md5("description").alias("description"), "category", "brand", "price",
        "currency", entries("attributes").alias("attributes"),
    )


@query
def q_feed_clean(spark, sf_dir):
    return _clean_columns(_cleaned(spark, sf_dir))


@query
def q_raw_data(spark, sf_dir):
    """The raw line kept as JSON, read back by its original headers."""
    raw = F.col("raw_data")
    return _cleaned(spark, sf_dir).select(
        "sku",
        *[F.get_json_object(raw, f"$['{h}']").alias(h.lower().replace(" ", "_"))
          for h in ("product_code", "Name", "list_price", "Colour", "Ship Class")],
    )


# Lines of one file of a feed that is written out.
LINES_PER_FILE = 5000


def _empty_products(spark):
    return empty(spark, PRODUCTS)


@query
def q_csv_feed(spark, sf_dir):
    """The feed written as CSV files, then read, cleaned and stored by the feed job."""
    folder = new_folder(spark, "csv-feed")
    lines = tv.feed_lines(spark, sf_dir).drop(cleaning.ORDER).toDF(*tv.FEED_HEADERS)
    lines.write.options(header=True, escape='"', maxRecordsPerFile=LINES_PER_FILE).csv(folder)
    result = run_feed(spark, folder, _empty_products(spark), RUN, 1)
    return _clean_columns(result.products)


def _updates(spark, sf_dir):
    return checked_rows(tv.update_lines(spark, sf_dir))


def _latest(spark, sf_dir):
    """Only the last line of a SKU sets its status, so only that one is checked."""
    return checked_rows(cleaning.last_per_sku(tv.update_lines(spark, sf_dir))).drop("issues")


def _catalog(spark, sf_dir):
    """Products as stored rows, status draft."""
    rows = tv.products(spark, sf_dir, described=False).withColumn("status", F.lit("draft"))
    missing = [f for f in PRODUCTS.fields if f.name not in rows.columns]
    full = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    return full.select(*[F.col(f.name).cast(f.dataType) for f in PRODUCTS.fields])


@query
def q_upsert(spark, sf_dir):
    latest = _latest(spark, sf_dir)
    after = changes.upsert_products(_catalog(spark, sf_dir), latest, RUN)
    return after.select(
        "sku", "title", "description", "category", "brand", "price", "currency", "status",
        "generated_description", stamp("updated_at").alias("updated_at"),
        entries("attributes").alias("attributes"),
    )


@query
def q_upsert_counters(spark, sf_dir):
    updates = _updates(spark, sf_dir)
    latest = cleaning.last_per_sku(updates.select("sku", "currency", cleaning.ORDER))
    counts = feed_counts(known_skus(latest, _catalog(spark, sf_dir)))
    issues = updates.agg(F.sum(F.size("issues")).alias("issues_found"))
    stacked = counts.unionByName(issues, allowMissingColumns=True)
    return stacked.agg(*[F.sum(c).cast("bigint").alias(c) for c in stacked.columns])


@query
def q_create_reject_dup(spark, sf_dir):
    """New products named after suppliers; those with a known SKU are rejected."""
    requested = tv.read(spark, sf_dir, "supplier").select(
        F.when(F.col("s_acctbal") > 0, tv.sku_of(F.col("s_suppkey")))
        .otherwise(F.col("s_name")).alias("sku"),
        F.col("s_name").alias("title"),
    )
    created, rejected = changes.create_products(_catalog(spark, sf_dir), requested, RUN)
    columns = ["sku", "title", "currency", "status"]
    refused = rejected.select("sku", "title", F.lit(None).cast("string").alias("currency"),
                              F.lit("rejected").alias("status"))
    return created.select(*columns).unionByName(refused)


@query
def q_patch(spark, sf_dir):
    """Partial updates from lineitem: price always, category sometimes, last one wins."""
    sets_category = F.col("l_tax") > 0.04
    patches = tv.read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_tax") < 0.08, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_discount") > 0.02, F.col("l_linestatus")).alias("category"),
        F.when(sets_category, F.array(F.lit("price"), F.lit("category")))
        .otherwise(F.array(F.lit("price"))).alias("set_fields"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice").alias("position"),
    )
    after = changes.patch_products(_catalog(spark, sf_dir), patches, RUN, order="position")
    return after.select("product_id", "title", "price", "category", stamp("updated_at").alias("updated_at"))


@query
def q_delete_cascade(spark, sf_dir):
    """Delete the products of one type; what is left of each table."""
    products = tv.products(spark, sf_dir)
    doomed = products.filter(F.col("category") == "PROMO").select("product_id")
    issues = issue_rows(tv.checked_products(spark, sf_dir), ["product_id"])
    names = ["products", "issues", "prices"]
    left = changes.delete_products(doomed, products, issues, tv.prices(spark, sf_dir))
    counts = [
        table.agg(F.count(F.lit(1)).alias("rows"), F.sum("product_id").alias("id_sum"))
        .select(F.lit(name).alias("table_name"), "rows", "id_sum")
        for name, table in zip(names, left)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _issue_table(checked):
    rows = issue_rows(checked, ["product_id"])
    return rows.select(
        (F.col("product_id") * 10 + F.col("position")).alias("issue_id"), "*",
        (F.col("issue_type") == "missing_attributes").alias("resolved"),
        F.when(F.col("issue_type") == "missing_attributes", F.lit("2024-01-01").cast("timestamp"))
        .alias("resolved_at"),
    )


@query
def q_resolve_issues(spark, sf_dir):
    """Resolve the issues whose ids equal some supplier key."""
    ids = tv.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("issue_id"))
    after = changes.resolve_issues(_issue_table(tv.checked_products(spark, sf_dir)), ids, RUN)
    return after.select("issue_id", "issue_type", "resolved", stamp("resolved_at").alias("resolved_at"))


def _alert_table(spark, sf_dir):
    orders = tv.read(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("product_id"),
        (F.col("o_orderstatus") == "F").alias("acknowledged"), F.col("o_orderdate").alias("created_at"),
    )


@query
def q_ack_alerts(spark, sf_dir):
    ids = tv.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("alert_id"))
    after = changes.acknowledge_alerts(_alert_table(spark, sf_dir), ids)
    return after.select("alert_id", "product_id", "acknowledged", stamp("created_at").alias("created_at"))


# --- the store -------------------------------------------------------------

def _write_feed(lines, folder):
    lines.write.options(header=True, escape='"', maxRecordsPerFile=LINES_PER_FILE).mode("append").csv(folder)


def _two_feeds(spark, sf_dir, begin=lambda tables: None):
    """A store after two feeds: all parts, then each of them twice, half of them under new SKUs."""
    root = new_folder(spark, "two-feeds")
    part, key = tv.read(spark, sf_dir, "part"), F.col("p_partkey")
    first = part.select(tv.sku_of(key).alias("sku"), F.col("p_name").alias("title"),
                        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    new = F.concat(F.lit("NEW-"), key.cast("string"))
    second = part.select(F.when(F.pmod(key, F.lit(2)) == 0, tv.sku_of(key)).otherwise(new).alias("sku"),
                         F.col("p_name").alias("title"), (F.col("p_retailprice") + 1).alias("price"))
    _write_feed(first, f"{root}/first")
    _write_feed(second.unionByName(second), f"{root}/second")
    tables = Tables(spark, f"{root}/tables")
    begin(tables)
    ingest_feed(tables, f"{root}/first", RUN)
    ingest_feed(tables, f"{root}/second", NEXT_RUN)
    return tables


@query
def q_feed_twice(spark, sf_dir):
    """The job log, the catalog and the issues that two feeds leave."""
    tables = _two_feeds(spark, sf_dir)
    jobs = tables.read("ingestion_jobs").select(
        F.concat_ws(" ", F.lit("job"), "job_id", "filename", "status").alias("what"), "total_rows", "new_products",
        "updated_products", "issues_found")
    again = F.col("created_at") < F.col("updated_at")
    stored = tables.read("products").agg(
        F.lit("catalog").alias("what"), F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("created_at") == F.lit(NEXT_RUN)).alias("new_products"),
        F.count_if(again).alias("updated_products"), F.count_if(F.col("brand").isNull()).alias("issues_found"))
    issues = tables.read("data_issues").groupBy(F.concat(F.lit("issue "), "issue_type").alias("what")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("created_at") == F.lit(NEXT_RUN)).alias("new_products"),
        F.count_distinct("product_id").alias("updated_products"), F.count_if("resolved").alias("issues_found"))
    return jobs.unionByName(stored).unionByName(issues)


@query
def q_store_resolved(spark, sf_dir):
    """Stored issues resolved and stored alerts acknowledged, read back from the store."""
    tables = _two_feeds(spark, sf_dir)
    alerts = _alert_table(spark, sf_dir)
    missing = [f for f in COMPETITOR_ALERTS.fields if f.name not in alerts.columns]
    change = tables.begin("alerts")
    change.append("competitor_alerts", alerts.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]))
    change.commit()
    undescribed = tables.read("data_issues").filter(F.col("issue_type") == "missing_description")
    resolve_stored(tables, undescribed.select("issue_id"), NEXT_RUN, "undescribed")
    seen = tv.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("alert_id")).distinct()
    acknowledge_stored(tables, seen, "seen")
    issues = tables.read("data_issues").groupBy("issue_type", F.col("resolved").alias("done")).agg(
        F.count(F.lit(1)).alias("rows"), stamp(F.max("resolved_at")).alias("done_at"))
    acknowledged = tables.read("competitor_alerts").groupBy(F.col("acknowledged").alias("done")).agg(
        F.count(F.lit(1)).alias("rows"))
    return issues.withColumnRenamed("issue_type", "kind").unionByName(
        acknowledged.withColumn("kind", F.lit("alert")), allowMissingColumns=True)


@query
def q_store_cascade(spark, sf_dir):
    """Stored products deleted with their issues; what the store has left."""
    tables = _two_feeds(spark, sf_dir)
    doomed = tables.read("products").filter(F.startswith("sku", F.lit("NEW-"))).select("product_id")
    delete_stored(tables, settle(doomed, "doomed"), "new ones")
    counts = [tables.read(name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
              for name in ("products", "data_issues", "ingestion_jobs")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def q_kept_counts(spark, sf_dir):
    """Statistics and open issues that a store has kept through two feeds, resolved issues and deleted products."""
    tables = _two_feeds(spark, sf_dir, recount)
    undescribed = tables.read("data_issues").filter(F.col("issue_type") == "missing_description")
    resolve_stored(tables, settle(undescribed.select("issue_id", "product_id"), "undescribed"), NEXT_RUN, "undescribed")
    doomed = tables.read("products").filter(F.startswith("sku", F.lit("NEW-"))).select("product_id", "sku")
    delete_stored(tables, settle(doomed, "doomed"), "new ones")
    stats = kept_stats(tables)
    counts = [c for c in stats.columns if c != "last_ingestion"]
    found = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("found")) for c in counts
    ], F.struct(F.lit("last_ingestion").alias("what"), stamp("last_ingestion").alias("found")))).alias("one")).select("one.*")
    issues = with_kept_issue_counts(tables.read("products"), tables).groupBy(
        F.concat(F.lit("products with open issues: "), "issue_count").alias("what")).agg(
        F.count(F.lit(1)).cast("string").alias("found"))
    return found.unionByName(issues)


def _stored_catalog(spark, sf_dir, name):
    root = new_folder(spark, name)
    tables = Tables(spark, f"{root}/tables", buckets=64)
    change = tables.begin("catalog")
    key = F.col("product_id")
    change.append("products", _catalog(spark, sf_dir).withColumns({
        "sku": tv.sku_of(key), "updated_at": F.timestamp_seconds(F.pmod(key * 7919, F.lit(100_000)))}))
    change.commit()
    return tables, f"{root}/index"


@query
def q_indexed_search(spark, sf_dir):
    """Substring searches of a stored catalog by its trigrams: words, parts of SKUs, wildcards, nothing found."""
    tables, folder = _stored_catalog(spark, sf_dir, "search")
    add_to_index(tables.read("products"), folder)
    found = [search_stored(tables, folder, pattern).select(F.lit(pattern).alias("pattern"), "product_id", "sku")
             for pattern in SEARCHES]
    return reduce(DataFrame.unionByName, found)


@query
def q_directory_page(spark, sf_dir):
    """The page at nine tenths of a stored catalog, by its directory of the order."""
    tables, folder = _stored_catalog(spark, sf_dir, "pages")
    products = tables.read("products")
    write_directory(products, folder, 20)
    page = stored_page(tables, folder, products.count() * 9 // 10, 50)
    return page.select("product_id", "sku", stamp("updated_at").alias("updated_at"))


@query
def q_feed_outcomes(spark, sf_dir):
    """The job log after feeds without a SKU column, without a CSV file, with overlong lines, whole, misnamed."""
    root = new_folder(spark, "outcomes")
    supplier = tv.read(spark, sf_dir, "supplier")
    sku, name = F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("sku"), F.col("s_name").alias("title")
    _write_feed(supplier.select("s_name", "s_acctbal"), f"{root}/no-sku")
    supplier.select(F.concat_ws(",", sku, name)).write.text(f"{root}/no-csv")
    long_lines = supplier.select(F.concat_ws(",", sku, name, F.lit("more")).alias("sku,title"))
    long_lines.write.options(header=True, sep="\u0001").csv(f"{root}/long-lines")
    _write_feed(supplier.select(sku, name), f"{root}/whole")
    _write_feed(supplier.select(sku, name), f"{root}/whole.txt")
    tables = Tables(spark, f"{root}/tables")
    for feed in ("no-sku", "no-csv", "long-lines", "whole", "whole.txt"):
        ingest_feed(tables, f"{root}/{feed}", RUN)
    return tables.read("ingestion_jobs").select(
        "job_id", "filename", "status", "total_rows", "processed_rows", "issues_found", "error_message")


@query
def q_feed_column_orders(spark, sf_dir):
    """A feed whose files order their columns differently, and of which some have one more."""
    folder = new_folder(spark, "column-orders")
    supplier, key = tv.read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = supplier.select(F.concat(F.lit("S-"), key.cast("string")).alias("sku"), F.col("s_name").alias("title"),
                           key.alias("price"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("nation"), key)
    even = F.pmod("s_suppkey", F.lit(2)) == 0
    _write_feed(rows.filter(even).select("sku", "title", "price"), folder)
    _write_feed(rows.filter(~even).select("nation", "price", "title", "sku"), folder)
    products = run_feed(spark, folder, _empty_products(spark), RUN, 1).products
    return products.select("sku", "title", "price", entries("attributes").alias("attributes"))


# --- catalog reads ---------------------------------------------------------

@query
def q_list_search_page(spark, sf_dir):
    """Second page of a search, with each product's open issues."""
    products = tv.products(spark, sf_dir, described=False).withColumn("status", F.lit("active"))
    page = catalog.list_products(products, _issue_table(tv.checked_products(spark, sf_dir)), skip=50, limit=50,
                                 status="active", search="RED")
    return page.select(
        "product_id", "sku", "title", "brand", stamp("updated_at").alias("updated_at"), "issue_count"
    )


@query
def q_keyset_page(spark, sf_dir):
    """The same order of products, gone on from a given row instead of by offset."""
    products = tv.products(spark, sf_dir, described=False)
    page = catalog.product_page(products, limit=100, after=(datetime(2024, 1, 31), 5), category="ECONOMY")
    return page.select("product_id", stamp("updated_at").alias("updated_at"))


@query
def q_filter_category(spark, sf_dir):
    rows = catalog.filter_products(tv.products(spark, sf_dir, described=False), category="STANDARD", search="_ew %")
    return rows.select("product_id", "title", "category")


@query
def q_lookup_by_id_and_sku(spark, sf_dir):
    products = tv.products(spark, sf_dir, described=False)
    suppliers = tv.read(spark, sf_dir, "supplier")
    by_id = catalog.products_by_id(products, suppliers.select(F.col("s_nationkey").cast("bigint").alias("product_id")))
    by_sku = catalog.products_by_sku(products, suppliers.select(tv.sku_of(F.col("s_suppkey")).alias("sku")))
    return by_id.select(F.lit("id").alias("found_by"), "product_id", "sku").unionByName(
        by_sku.select(F.lit("sku").alias("found_by"), "product_id", "sku"))


@query
def q_issue_counts(spark, sf_dir):
    products = tv.products(spark, sf_dir, described=False)
    return catalog.with_issue_counts(products, _issue_table(tv.checked_products(spark, sf_dir))).select("product_id", "issue_count")


@query
def q_product_issues(spark, sf_dir):
    """All issues of the products of one category."""
    chosen = catalog.filter_products(tv.products(spark, sf_dir, described=False), category="SMALL")
    return catalog.issues_of(_issue_table(tv.checked_products(spark, sf_dir)), chosen).select(
        "issue_id", "product_id", "issue_type", "severity", "resolved")


@query
def q_issue_list(spark, sf_dir):
    issues = _issue_table(tv.checked_products(spark, sf_dir)).withColumn("created_at", F.lit(RUN).cast("timestamp"))
    return catalog.list_issues(issues, resolved=False).select("issue_id", "issue_type", "severity")


def _job_table(spark, sf_dir):
    """One ingestion job per customer order."""
    return tv.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("filename"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"),
    )


@query
def q_job_list(spark, sf_dir):
    return catalog.list_jobs(_job_table(spark, sf_dir)).select(
        "job_id", "filename", "status", stamp("started_at").alias("started_at"))


@query
def q_categories(spark, sf_dir):
    return catalog.categories(tv.products(spark, sf_dir, described=False))


@query
def q_dashboard_stats(spark, sf_dir):
    # The checks run once; products and issues read their results.
    checked = settle(tv.checked_products(spark, sf_dir).select(
        "product_id", "status", "description", "generated_description", "issues"), "checked-products")
    stats = catalog.dashboard_stats(
        checked, _issue_table(checked), _alert_table(spark, sf_dir), _job_table(spark, sf_dir),
        tv.prices(spark, sf_dir),
    )
    times = ["last_ingestion", "last_scrape"]
    return stats.select(*[c for c in stats.columns if c not in times],
                        *[stamp(c).alias(c) for c in times])


@query
def q_needs_content(spark, sf_dir):
    return content.needs_content(tv.products(spark, sf_dir)).select("product_id", "sku", "title")


@query
def q_all_needing_content(spark, sf_dir):
    return content.all_needing_content(tv.products(spark, sf_dir)).select("product_id", "sku")


@query
def q_open_content_issues(spark, sf_dir):
    ids = tv.products(spark, sf_dir, described=False).filter(F.col("category") == "LARGE")
    return content.open_content_issues(_issue_table(tv.checked_products(spark, sf_dir)), ids).select("issue_id", "issue_type")


@query
def q_duplicate_titles(spark, sf_dir):
    return catalog.duplicate_titles(tv.products(spark, sf_dir, described=False))


# --- prices ----------------------------------------------------------------

@query
def q_search_query_url(spark, sf_dir):
    products = tv.products(spark, sf_dir, described=False)
    source = tv.pick(["amazon", "Walmart", "FLIPKART", "elsewhere"], F.col("product_id"))
    brand = F.when(F.col("category") == "PROMO", F.substring("title", 1, 3)).when(
        F.col("category") == "SMALL", " ").when(F.col("category") == "LARGE", None).otherwise(F.col("brand"))
    queried = products.select("product_id", search.search_query(brand, F.col("title")).alias("query"),
                              source.alias("source"))
    return queried.select("product_id", "query", search.search_url(F.col("query"), F.col("source")).alias("url"))


@query
def q_products_x_sources(spark, sf_dir):
    products = tv.products(spark, sf_dir, described=False).withColumn("status", F.when(F.col("category") == "PROMO", "draft").otherwise("active"))
    targets = px.search_targets(px.products_to_scrape(products))
    return targets.select("product_id", "source", "search_url")


@query
def q_scrape_ids(spark, sf_dir):
    """Search targets of given products at one marketplace, whatever their status."""
    products = tv.products(spark, sf_dir, described=False).withColumn("status", F.lit("draft"))
    ids = tv.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("product_id"))
    targets = px.search_targets(px.products_to_scrape(products, ids), ["walmart", "walmart"])
    return targets.select("product_id", "source", "search_url")


PRICE_TEXTS = ["$%", "Rs. %,500", "% / 2.5", "from %.", "1,%", "call us", "", "%.%.%"]


@query
def q_price_extract(spark, sf_dir):
    """Prices read out of texts made from every line item."""
    shown = F.replace(tv.pick(PRICE_TEXTS, F.col("l_suppkey")), F.lit("%"),
                      F.col("l_quantity").cast("int").cast("string"))
    rows = tv.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shown.alias("shown"))
    return rows.withColumn("price", money.extract_price(F.col("shown")))


@query
def q_feed_price(spark, sf_dir):
    raw = F.replace(tv.pick(tv.RAW_PRICES, F.col("l_suppkey")), F.lit("%"),
                    F.col("l_quantity").cast("string"))
    rows = tv.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return rows.withColumn("price", money.feed_price(F.col("raw")))


@query
def q_fx_normalized(spark, sf_dir):
    ours = tv.products(spark, sf_dir, described=False).select(
        "product_id", F.col("price").alias("our_price"), F.col("currency").alias("our_currency"))
    joined = tv.prices(spark, sf_dir).filter(F.col("competitor_price").isNotNull()).join(ours, "product_id")
    theirs = money.in_our_currency(F.col("competitor_price"), F.col("competitor_currency"), F.col("our_currency"))
    return joined.select(
        "price_id", "product_id", stamp("scraped_at").alias("scraped_at"), theirs.alias("in_our_currency"),
        money.undercut_percent(F.col("our_price"), theirs).alias("below_percent"),
    )


@query
def q_prev_price(spark, sf_dir):
    compared = px.previous_value(
        px.priced(tv.prices(spark, sf_dir)), px.SERIES, px.SERIES_ORDER, "competitor_price", "previous_price")
    return compared.select("price_id", "product_id", "source", stamp("scraped_at").alias("scraped_at"),
                           "competitor_price", "previous_price")


def _alerts(spark, sf_dir):
    alerts = px.history_alerts(tv.prices(spark, sf_dir), tv.products(spark, sf_dir, described=False))
    return alerts.withColumn("created_at", stamp("created_at"))


def _one_kind(spark, sf_dir, *kinds):
    return _alerts(spark, sf_dir).filter(F.col("alert_type").isin(*kinds)).select(
        "product_id", "alert_type", "source", "our_price", "competitor_price", "price_difference",
        "created_at")


@query
def q_alert_undercut(spark, sf_dir):
    return _one_kind(spark, sf_dir, "undercut")


@query
def q_alert_oos(spark, sf_dir):
    return _one_kind(spark, sf_dir, "out_of_stock")


@query
def q_alert_change(spark, sf_dir):
    return _one_kind(spark, sf_dir, "price_drop", "price_increase")


@query
def q_alerts_all(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("alert_type", "source").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("price_difference").alias("largest"))


@query
def q_alert_messages(spark, sf_dir):
    return _alerts(spark, sf_dir).select("product_id", "source", "alert_type", "created_at", "message")


@query
def q_alerts_sliced(spark, sf_dir):
    """All alerts again, with the series of more than 15 snapshots taken as hot."""
    alerts = px.history_alerts(
        tv.prices(spark, sf_dir), tv.products(spark, sf_dir, described=False),
        rows_per_task=15)
    return alerts.groupBy("product_id", "alert_type").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("price_difference").alias("largest"))


@query
def q_alerts_hot_series(spark, sf_dir):
    """All alerts where one product holds a third of all snapshots.

    The snapshots of returned items are put on product 0, whose three series are
    then cut into slices, while all others go the usual way.
    """
    prices = tv.prices(spark, sf_dir).withColumn(
        "product_id", F.when(F.col("in_stock") | F.col("in_stock").isNull(), F.col("product_id")).otherwise(0))
    share = max(1000, prices.count() // 100)
    alerts = px.history_alerts(
        prices, tv.products(spark, sf_dir, described=False), rows_per_task=share)
    return alerts.groupBy("alert_type", "source").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("price_difference").alias("largest"),
        F.count_if(F.col("product_id") == 0).alias("of_product_0"))


@query
def q_batch_alerts(spark, sf_dir):
    """Alerts of the snapshots from 2000 on, on top of the state left by those before."""
    prices = tv.prices(spark, sf_dir)
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    latest = settle(px.latest_priced(prices.filter(F.col("scraped_at") < start)), "latest")
    batch = prices.filter(F.col("scraped_at") >= start)
    alerts = px.batch_alerts(latest, batch, tv.products(spark, sf_dir, described=False))
    return alerts.select("product_id", "source", "alert_type", "price_difference",
                         stamp("created_at").alias("created_at"))


@query
def q_latest_prices(spark, sf_dir):
    return px.latest_priced(tv.prices(spark, sf_dir)).select(
        "product_id", "source", "price_id", "competitor_price", "competitor_currency",
        stamp("scraped_at").alias("scraped_at"))


@query
def q_price_list(spark, sf_dir):
    return px.list_prices(tv.prices(spark, sf_dir), source="walmart").select(
        "price_id", "product_id", "source", "competitor_price", stamp("scraped_at").alias("scraped_at"))


@query
def q_alert_list(spark, sf_dir):
    return px.list_alerts(_alert_table(spark, sf_dir), acknowledged=False).select(
        "alert_id", "product_id", stamp("created_at").alias("created_at"))


@query
def q_product_lists(spark, sf_dir):
    """Newest snapshots and alerts of one product."""
    newest = px.list_prices(tv.prices(spark, sf_dir), product_id=7).select(
        F.lit("price").alias("kind"), F.col("price_id").alias("id"), "product_id", stamp("scraped_at").alias("at"))
    alerts = px.list_alerts(_alert_table(spark, sf_dir), product_id=7).select(
        F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), "product_id", stamp("created_at").alias("at"))
    return newest.unionByName(alerts)


@query
def q_price_comparison(spark, sf_dir):
    return px.price_comparison(tv.products(spark, sf_dir, described=False), tv.prices(spark, sf_dir))


@query
def q_back_in_stock(spark, sf_dir):
    return px.back_in_stock(tv.prices(spark, sf_dir)).select(
        "price_id", "product_id", "source", stamp("scraped_at").alias("scraped_at"))


# --- marketplace pages -----------------------------------------------------

@query
def q_page_listings(spark, sf_dir):
    return read_listings(tv.market_pages(spark, sf_dir))


@query
def q_page_forms(spark, sf_dir):
    """Listings with absolute links, and with the first choice of container, title and link."""
    return read_listings(tv.other_market_pages(spark, sf_dir)).drop("currency", "in_stock")


def _targets(spark, sf_dir):
    products = tv.products(spark, sf_dir, described=False)
    return products, px.search_targets(products)


@query
def q_snapshots(spark, sf_dir):
    """Each found product's snapshot from the first listing on its page."""
    _, targets = _targets(spark, sf_dir)
    best = best_listings(read_listings(tv.market_pages(spark, sf_dir)))
    return px.snapshots(targets, best, RUN).drop("price_id").withColumn("scraped_at", stamp("scraped_at"))


@query
def q_unmatched_listings(spark, sf_dir):
    _, targets = _targets(spark, sf_dir)
    best = best_listings(read_listings(tv.market_pages(spark, sf_dir)))
    return px.unmatched_targets(targets, best).select("product_id", "source", "search_url")


@query
def q_scrape_summary(spark, sf_dir):
    products, targets = _targets(spark, sf_dir)
    best = best_listings(read_listings(tv.market_pages(spark, sf_dir)))
    taken = settle(px.snapshots(targets, best, RUN), "snapshots")
    latest = taken.filter(F.lit(False))
    return px.scrape_summary(products, taken, px.batch_alerts(latest, taken, products))


# --- generated content -----------------------------------------------------

@query
def q_prompts(spark, sf_dir):
    prompts = tv.products(spark, sf_dir).select("product_id", description_prompt(tone="luxury").alias("prompt"))
    return prompts.select("product_id", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("digest"))


@query
def q_seo_prompts(spark, sf_dir):
    category = F.when(F.col("category") != "PROMO", F.col("category"))
    brand = F.when(F.col("category") == "SMALL", "").otherwise(F.col("brand"))
    rows = tv.products(spark, sf_dir, described=False).withColumn("category", category).withColumn("brand", brand)
    return rows.select("product_id", seo_prompt(F.col("sku")).alias("prompt"))


@query
def q_seo_parse(spark, sf_dir):
    reply = F.replace(tv.pick(tv.REPLIES, F.col("p_partkey")), F.lit("%"), F.col("p_name"))
    rows = tv.read(spark, sf_dir, "part").select("p_partkey", seo_reply(reply).alias("r"))
    return rows.select("p_partkey", "r.parsed", "r.usable", "r.seo_title", "r.seo_keywords")


@query
def q_seo_keywords(spark, sf_dir):
    words = F.concat_ws(",", F.lit(" a"), F.col("p_name"), F.lit(""), F.col("p_brand"))
    rows = tv.read(spark, sf_dir, "part").select("p_partkey", F.posexplode(seo_keyword_list(words)).alias("position", "keyword"))
    return rows


@query
def q_display_description(spark, sf_dir):
    return tv.products(spark, sf_dir).select("product_id", F.md5(display_description()).alias("digest"))


def _stub():
    """A generator that answers from the prompt alone and fails for PROMO items."""

    def generator(system, prompt, temperature, max_tokens):
        lines = dict(line[2:].split(": ", 1) for line in prompt.split("\n")
                     if line.startswith("- ") and ": " in line)
        if "Return only valid JSON" not in system:
            if lines["Category"] == "PROMO":
                raise ValueError("refused")
            return f"\n About {lines['Title']} ({lines['SKU']}). \n"
        if lines["Category"] == "LARGE":
            return "sorry"
        return '```json\n{"seo_title": "' + lines["Title"] + '", "seo_keywords": "' + lines["Brand"] + '"}\n```'

    return generator


def _generated(spark, sf_dir):
    """Results for every part and, as unknown ids, the negated supplier keys."""
    products = tv.products(spark, sf_dir)
    unknown = tv.read(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("product_id"))
    ids = products.select("product_id").unionByName(unknown)
    return products, content.generate(ids, products, _stub())


@query
def q_generate_stub(spark, sf_dir):
    return _generated(spark, sf_dir)[1]


@query
def q_generate_ledger(spark, sf_dir):
    """The same results by a ledger, of which the first half of the products is asked by a job before."""
    products, ledger = tv.products(spark, sf_dir), new_folder(spark, "ledger")
    first = products.filter(F.pmod("product_id", F.lit(2)) == 0).select("product_id")
    settle(content.generate(first, products, _stub(), ledger=ledger, slices=2), "first-half")
    unknown = tv.read(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("product_id"))
    return content.generate(products.select("product_id").unionByName(unknown), products, _stub(), ledger=ledger, slices=2)


@query
def q_generate_counts(spark, sf_dir):
    return content.batch_summary(_generated(spark, sf_dir)[1])


@query
def q_generate_plain(spark, sf_dir):
    """Descriptions without SEO texts; every product is requested twice."""
    products = tv.products(spark, sf_dir)
    ids = products.select("product_id")
    return content.generate(ids.unionByName(ids), products, _stub(), include_seo=False)


@query
def q_store_content(spark, sf_dir):
    current = _catalog(spark, sf_dir).withColumn("seo_title", F.lit("old"))
    after = content.store_content(current, _generated(spark, sf_dir)[1], RUN)
    return after.select("product_id", "generated_description", "seo_title", "seo_keywords",
                        stamp("updated_at").alias("updated_at"))


@query
def q_resolve_content_issues(spark, sf_dir):
    results = settle(_generated(spark, sf_dir)[1], "generated")
    after = content.resolve_content_issues(_issue_table(tv.checked_products(spark, sf_dir)), results, RUN)
    return after.select("issue_id", "issue_type", "resolved", stamp("resolved_at").alias("resolved_at"))


# --- streams ---------------------------------------------------------------

def _streamed_alerts(spark, sf_dir, name, drops):
    """Alerts of the event log as a price stream in two drops by time, against a price of 10."""
    root = new_folder(spark, name)
    rows = tv.events_as_prices(tv.read(spark, sf_dir, "events"))
    middle = F.lit(rows.agg(F.timestamp_seconds(
        (F.unix_timestamp(F.min("scraped_at")) + F.unix_timestamp(F.max("scraped_at"))) / 2)).first()[0])
    products = settle(rows.select("product_id").distinct().select(
        "product_id", F.lit(10.0).alias("price"), F.lit("USD").alias("currency")), "stream-products")
    for drop in drops(F.col("scraped_at"), middle):
        rows.filter(drop).write.mode("append").parquet(f"{root}/drops")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/drops")
        monitor_prices(stream, lambda: products, f"{root}/tables", f"{root}/state").awaitTermination()
    alerts = Tables(spark, f"{root}/tables").read("competitor_alerts")
    return alerts.select("product_id", "source", "alert_type", "competitor_price", "price_difference", "message")


@query
def q_stream_prices(spark, sf_dir):
    """The older half of the events, then the newer one."""
    return _streamed_alerts(spark, sf_dir, "price-stream", lambda at, middle: (at < middle, at >= middle))


@query
def q_stream_late_prices(spark, sf_dir):
    """All but a day in the middle of every four, then those days: late snapshots between stored ones."""
    day = F.pmod(F.datediff("scraped_at", F.lit("2000-01-01")), F.lit(4)) == 1
    return _streamed_alerts(spark, sf_dir, "late-prices", lambda at, middle: (~day, day))


@query
def q_stream_feed(spark, sf_dir):
    """The feed dropped as CSV files and taken in by the stream; the catalog it leaves."""
    root = new_folder(spark, "feed-stream")
    lines = tv.feed_lines(spark, sf_dir).drop(cleaning.ORDER).toDF(*tv.FEED_HEADERS)
    lines.write.options(header=True, escape='"', maxRecordsPerFile=LINES_PER_FILE).csv(f"{root}/drops")
    stream = feed_stream(spark, f"{root}/drops", files_per_batch=2)
    ingest_feeds(stream, f"{root}/tables", f"{root}/state", lambda: RUN).awaitTermination()
    return _clean_columns(Tables(spark, f"{root}/tables").read("products"))


@query
def q_stream_feed_headers(spark, sf_dir):
    """Files of two column orders and a broken one in one drop: what the catalog and the job log hold."""
    root = new_folder(spark, "mixed-feeds")
    supplier, key = tv.read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = supplier.select(F.concat(F.lit("S-"), key.cast("string")).alias("sku"),
                           F.concat("s_name", F.lit("\nsecond \"line\"")).alias("title"), key.alias("price"), key)
    even = F.pmod("s_suppkey", F.lit(2)) == 0
    _write_feed(rows.filter(even).select("sku", "title", "price"), f"{root}/drops")
    _write_feed(rows.filter(~even).select("price", "title", "sku"), f"{root}/drops")
    broken = rows.select(F.concat_ws(",", "sku", F.lit("x"), F.lit("y")).alias("sku,title"))
    broken.coalesce(1).write.mode("append").options(header=True, sep="\u0001").csv(f"{root}/drops")
    stream = feed_stream(spark, f"{root}/drops", files_per_batch=1000)
    ingest_feeds(stream, f"{root}/tables", f"{root}/state", lambda: RUN).awaitTermination()
    tables = Tables(spark, f"{root}/tables")
    jobs = tables.read("ingestion_jobs").groupBy(F.concat(F.lit("job "), "status").alias("sku")).agg(
        F.max("error_message").alias("title"), F.sum("processed_rows").cast("double").alias("price"))
    return tables.read("products").select("sku", "title", "price").unionByName(jobs)


# Bytes of descriptions in one file of q_csv_one_file: some splits of the default size.
FILE_BYTES = 256 << 20


def _whole_files(lines, text_bytes):
    """Lines in so few partitions, and so files, that each holds about ``FILE_BYTES``."""
    return lines.coalesce(max(1, ceil(text_bytes / FILE_BYTES)))


@query
def q_csv_one_file(spark, sf_dir):
    """The feed as one file, whose descriptions hold line breaks within quotes, read by all tasks.

    One task writes a file, so beyond ``FILE_BYTES`` there are several, each of more splits than one.
    """
    folder = new_folder(spark, "one-file")
    lines = tv.feed_lines(spark, sf_dir).drop(cleaning.ORDER).toDF(*tv.FEED_HEADERS)
    texts = tv.read(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    _whole_files(lines, texts or 0).write.options(header=True, escape='"').csv(folder)
    return _clean_columns(run_feed(spark, folder, _empty_products(spark), RUN, 1).products)
