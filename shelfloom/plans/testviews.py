"""Catalog tables derived from the given TPC-H-like tables.

Products come from ``part`` (with descriptions from ``documents``), snapshots
from ``lineitem``, marketplace pages from ``pages``. Values are made messy on
purpose; every row of the source tables is used.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.fixed_values import SOURCES
from shelfloom.functions.attributes import with_attributes
from shelfloom.operators.quality import status_from_issues, with_issues
from shelfloom.sources.feeds import ORDER

RAW_COLORS = [
    "blk", "Grn", "navy", "gray", "Red", "midnight blue", "", "n/a", " wht ", "Space Gray",
    "None", "rd", "tan",
]
RAW_SIZES = [
    "lg", "med", "32x30", "", "extra small", "2xl", "N/A", "xx-large", "10", "one size", "none",
]
RAW_MATERIALS = ["die-cast metal", "ctn", "", "poly", "n/a", "ss", "genuine  leather"]
RAW_PRICES = ["$%", "1,%", "%", "USD %", "%d", "", " % ", "n/a"]
RAW_TOKENS = [
    "", "n/a", "N/A", "NA", "NaN", "nan", "NULL", "null", "None", "none", "#N/A", "<NA>", "-nan",
    "NONE", " nan ", "nil", "0", "na",
]
FEED_HEADERS = [
    "product_code", "Name", "details", "Department", "vendor", "list_price", "Currency_Code",
    "Colour", "Sizes", "Fabric", "shipping_weight", "Ship Class",
]
LONG_TEXT = (
    "This item ships from our own warehouse and comes with a full set of parts, "
    "a printed manual and a two year warranty. Returns are free for thirty days."
)
REPLIES = [
    '{"seo_title": "%", "seo_keywords": "one, two,% , three"}',
    '```json\n{"seo_title": "%", "seo_keywords": "fenced"}\n```',
    "```json",
    "% is not JSON",
    '{"seo_title": "%"}',
    '["%"]',
    '{"seo_title": "%", "seo_keywords": null}',
    '  ```\n{"seo_keywords": "x,,y"}',
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: list, key: Column) -> Column:
    """One of the values, by the key modulo their number."""
    position = F.pmod(key, F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), position)


def sku_of(key: Column) -> Column:
    return F.concat(F.lit("SKU-"), key.cast("string"))


def products(spark: SparkSession, sf_dir: str, described: bool = True) -> DataFrame:
    """Products; with descriptions only if wanted, which costs a join."""
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    rupees = F.pmod(key, F.lit(5)) == 0
    rows = part.select(
        key.alias("product_id"),
        sku_of(key).alias("sku"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.when(rupees, F.col("p_retailprice") * 83.0).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(rupees, "INR").otherwise("USD").alias("currency"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("p_size"))).alias(
            "updated_at"
        ),
        F.when(F.col("p_size") <= 10, F.concat(F.lit("Generated for "), F.col("p_name")))
        .when(F.col("p_size") <= 20, "").alias("generated_description"),
        F.col("p_size").alias("_size"),
    )
    rows = with_attributes(
        rows.withColumn("_weight", F.concat(F.col("_size").cast("string"), F.lit("kg"))),
        {
            "color": pick(RAW_COLORS, F.col("product_id")),
            "size": pick(RAW_SIZES, F.col("product_id")),
            "material": pick(RAW_MATERIALS, F.col("product_id")),
            "weight": F.col("_weight"),
        },
        [("Ship Class", F.col("category"))],
    ).drop("_size", "_weight")
    if not described:
        return rows.withColumn("description", F.lit(None).cast("string"))
    texts = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("product_id"), F.col("text").alias("description")
    )
    return rows.join(texts, "product_id", "left")


def checked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their issues and status."""
    return with_issues(products(spark, sf_dir)).withColumn(
        "status", status_from_issues(F.col("issues"))
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots from lineitem: some unpriced, some priced 0, Flipkart in INR."""
    source = pick(SOURCES, F.col("l_suppkey"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        read(spark, sf_dir, "lineitem")
        .withColumn("source", source)
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("price_id"),
            F.col("l_partkey").alias("product_id"),
            "source",
            F.concat(F.lit("Listing "), F.col("l_orderkey").cast("string")).alias("competitor_title"),
            F.lit(None).cast("string").alias("competitor_url"),
            F.when(F.col("l_tax") == 0.08, F.lit(None).cast("double"))
            .when(F.col("l_tax") == 0.07, F.lit(0.0))
            .when(F.col("source") == "flipkart", unit * 83.0)
            .otherwise(unit).alias("competitor_price"),
            F.when(F.col("source") == "flipkart", "INR").otherwise("USD").alias("competitor_currency"),
            F.when(F.col("l_returnflag") == "R", F.lit(False))
            .when(F.col("l_linenumber") == 6, F.lit(None).cast("boolean"))
            .otherwise(F.lit(True)).alias("in_stock"),
            (F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_suppkey").cast("decimal(18,6)")))
            .alias("scraped_at"),
        )
    )


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier feed as text columns c0, c1, ... in the order of FEED_HEADERS."""
    part = read(spark, sf_dir, "part")
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    key, name = F.col("p_partkey"), F.col("p_name")
    price = F.replace(pick(RAW_PRICES, key), F.lit("%"), F.col("p_retailprice").cast("string"))
    cells = [
        F.when(F.col("p_size") == 13, "None").otherwise(F.concat(F.lit(" "), sku_of(key))),
        F.when(F.col("p_size") == 7, "nan").otherwise(F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("  ")), F.lit(" "))),
        F.col("text"),
        F.when(F.col("p_size") == 9, "N/A").otherwise(F.col("p_type")),
        F.col("p_brand"),
        price,
        F.when(F.col("p_size") < 25, "eur"),
        pick(RAW_COLORS, key),
        pick(RAW_SIZES, key),
        pick(RAW_MATERIALS, key),
        F.concat(F.col("p_size").cast("string"), F.lit("kg")),
        F.when(F.col("p_size") < 40, F.concat(F.lit(" "), F.col("p_type"))).otherwise("none"),
    ]
    return part.join(texts, key == F.col("doc_id"), "left").select(
        *[cell.alias(f"c{i}") for i, cell in enumerate(cells)], F.struct(key).alias(ORDER)
    )


def update_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean feed rows from lineitem: many lines per SKU, known and new ones."""
    # Order number and line repeat in the given tables; all six together do not.
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    new = F.col("l_returnflag") == "N"
    attributes = F.create_map(F.lit("color"), F.lit("Black"), F.lit("size"), F.col("l_linestatus"))
    return read(spark, sf_dir, "lineitem").select(
        F.when(new, F.concat(F.lit("NEW-"), F.col("l_suppkey").cast("string")))
        .otherwise(sku_of(F.col("l_partkey"))).alias("sku"),
        F.concat(F.lit("Item "), F.col("l_linenumber").cast("string")).alias("title"),
        F.when(F.col("l_linestatus") == "F", F.lit(LONG_TEXT)).alias("description"),
        F.when(F.col("l_tax") > 0.04, F.lit("Updated")).alias("category"),
        F.concat(F.lit("Brand "), F.col("l_returnflag")).alias("brand"),
        F.when(F.col("l_tax") < 0.08, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_discount") > 0.05, "INR").otherwise("USD").alias("currency"),
        attributes.alias("attributes"),
        F.to_json(F.struct(*key)).alias("raw_data"),
        F.struct(*key).alias(ORDER),
    )


def containers(template: str) -> Column:
    """Seven listings of a page, the second without a title."""
    number = F.col("page_id").cast("string")
    parts = []
    for n in range(7):
        title = F.lit("") if n == 1 else F.concat(F.lit(f"Offer {n} of "), number)
        text = F.lit(template.replace("#", str(n)))
        parts.append(F.replace(F.replace(text, F.lit("@title"), title), F.lit("@page"), number))
    return F.concat(*parts)


def pages_with(spark: SparkSession, sf_dir: str, source: Column, block: Column) -> DataFrame:
    """The given pages as marketplace pages, with a block put after <body>."""
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.col("page_id").alias("product_id"),
        source.alias("source"),
        "url",
        F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), block)).alias("html"),
    )


def other_market_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the forms that ``market_pages`` does not have: absolute links, first choices."""
    walmart = containers(
        '<div data-item-id="#"><a href="/no">x</a><a link-identifier="#" href="https://other.example/@page-#">go</a>'
        '<span data-automation-id="product-title">@title</span>'
        '<div data-automation-id="product-price"><span>$@page</span></div></div>'
    )
    flipkart = containers(
        '<div class="_1AtVbE"><div class="_4rR01T">@title</div><a class="_1fQZEK" href="/p/@page-#">go</a>'
        '<a class="IRpwTa" href="/other">other</a><div class="_30jeq3">@page</div></div>'
    )
    odd = F.pmod("page_id", F.lit(2)) == 1
    return pages_with(spark, sf_dir, F.when(odd, "walmart").otherwise("flipkart"),
                      F.when(odd, walmart).otherwise(flipkart))


def market_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with a marketplace's result list put after <body>.

    The marketplace goes by page id; each list has seven containers, the second
    without a title, and every eighth page has none at all.
    """
    page = F.col("page_id")
    amazon = containers(
        '<div data-component-type="s-search-result"><h2><a href="/dp/@page-#"><span> @title</span>'
        '</a></h2><span class="x a-price-whole">1,@page<span>.</span></span>'
        '<span class="a-price-fraction">#5</span></div>'
    )
    walmart = containers(
        '<div data-item-id="#"><a link-identifier="#" href="/ip/@page-#">go</a>'
        '<span data-automation-id="product-title">@title </span>'
        '<div data-automation-id="product-price">now <span>$@page.#0</span></div></div>'
    )
    flipkart = containers(
        '<div class="row tUxRFH"><a class="IRpwTa" href="/p/@page-#">@title</a>'
        '<div class="_30jeq3">Rs. @page,#00</div></div>'
    )
    block = (
        F.when(F.pmod(page, F.lit(8)) == 7, "")
        .when(F.pmod(page, F.lit(3)) == 0, amazon)
        .when(F.pmod(page, F.lit(3)) == 1, walmart)
        .otherwise(flipkart)
    )
    return pages_with(spark, sf_dir, pick(SOURCES, page), block)


def events_as_prices(events: DataFrame) -> DataFrame:
    """The event log read as a price log: user as product, event type as source."""
    return events.select(
        F.col("event_id").alias("price_id"),
        F.col("user_id").alias("product_id"),
        F.col("event_type").alias("source"),
        F.lit(None).cast("string").alias("competitor_title"),
        F.lit(None).cast("string").alias("competitor_url"),
        F.col("value").alias("competitor_price"),
        F.lit("USD").alias("competitor_currency"),
        F.lit(True).alias("in_stock"),
        F.col("ts").cast("timestamp").alias("scraped_at"),
    )
