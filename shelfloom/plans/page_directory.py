"""Pages of a stored catalog by a directory of its order.

The directory holds the catalog's order, newest change first and ties by id, as narrow rows in ranges
that follow each other, and the number of rows in each. The page at an offset lies in one range or
two, so only these are read, and the products they name from the buckets of their SKUs. A directory is of the
moment when it was written; a catalog that has changed needs another.
"""

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.session import settle
from shelfloom.sources.tables import Tables

RANGES = 1000
_ROW = "updated_at timestamp, product_id bigint, sku string"


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("updated_at"), F.asc("product_id"))


def write_directory(products: DataFrame, folder: str, ranges: int = RANGES) -> None:
    """Write the order of ``products`` in at most ``ranges`` ranges, and their sizes, in two passes over narrow rows."""
    keys = settle(products.select("updated_at", "product_id", "sku"), "page-keys")
    dealt = keys.repartitionByRange(ranges, F.desc("updated_at"), F.asc("product_id")).withColumn(
        "range", F.spark_partition_id())
    dealt.sortWithinPartitions(F.desc("updated_at"), F.asc("product_id")).write.partitionBy("range").parquet(f"{folder}/rows")
    spark = products.sparkSession
    held = spark.read.schema(f"{_ROW}, range int").parquet(f"{folder}/rows")
    held.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{folder}/sizes")


def ranges_of(sizes: list, skip: int, limit: int) -> tuple:
    """(the ranges that rows ``skip`` to ``skip + limit`` lie in, rows before the first of them)."""
    ends = list(accumulate(rows for _, rows in sizes))
    begins = [0, *ends[:-1]]
    met = [i for i, (a, b) in enumerate(zip(begins, ends, strict=False)) if a < skip + limit and b > skip]
    return [sizes[i][0] for i in met], begins[met[0]] if met else 0


def stored_page(tables: Tables, folder: str, skip: int = 0, limit: int = 50) -> DataFrame:
    """``product_page`` of the catalog as it was when the directory was written, less what was deleted since."""
    spark = tables.spark
    # One small row for each range, of which there are at most as many as were asked for.
    sizes = [tuple(r) for r in spark.read.schema("range int, rows bigint").parquet(f"{folder}/sizes").orderBy("range").collect()]
    ranges, before = ranges_of(sizes, skip, limit)
    if not ranges:
        return tables.read("products").limit(0)
    rows = spark.read.schema(_ROW).parquet(*[f"{folder}/rows/range={r}" for r in ranges])
    page = settle(_ordered(rows).offset(skip - before).limit(limit), "page-keys")
    near = tables.read("products", tables.buckets_of("products", page))
    named = page.select("sku", F.col("updated_at").alias("_updated_at"), F.col("product_id").alias("_product_id"))
    return near.join(named, "sku").orderBy(F.desc("_updated_at"), F.asc("_product_id")).select(*near.columns)
