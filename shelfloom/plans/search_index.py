"""Substring search of a stored catalog by an index of trigrams.

Every run of three characters in a lower-cased title, SKU or brand is a posting (trigram, field, product,
SKU), written in the order of trigrams, so that a lookup reads the row groups of its own trigrams. A
pattern's literal runs give the trigrams that a matching field has to hold. The rarest of
them are looked up and intersected, and what they name is read from the buckets of its SKUs and
tested by ``ilike``, as ``filter_products`` does for all rows. Postings of texts that have changed since do no
harm, as every candidate is tested; new and changed products are added with ``add_to_index``.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.operators.catalog import SEARCHED, filter_products
from shelfloom.session import settle
from shelfloom.sources.tables import Tables

# Trigrams of a pattern that are looked up; the test of the candidates sees to the rest.
LOOKED_UP = 4


def trigrams(text: Column) -> Column:
    """The different trigrams of a text, lower-cased as ``ilike`` does."""
    lowered = F.lower(text)
    places = F.sequence(F.lit(1), F.char_length(lowered) - 2)
    return F.when(F.char_length(lowered) >= 3, F.array_distinct(
        F.transform(places, lambda i: F.substring(lowered, i, F.lit(3)))))


def postings(products: DataFrame) -> DataFrame:
    """(trigram, field, product_id, sku) of all searched fields, in one pass."""
    fields = F.array(*[F.struct(F.lit(name).alias("field"), trigrams(F.col(name)).alias("trigrams")) for name in SEARCHED])
    each = products.select("product_id", "sku", F.explode(fields).alias("one")).select("product_id", "sku", "one.*")
    return each.select(F.explode("trigrams").alias("trigram"), "field", "product_id", "sku")


def add_to_index(products: DataFrame, folder: str) -> None:
    """Add the postings of new or changed products.

    Postings are range-partitioned by trigram and product, so a trigram that a third of all
    products have is spread over as many files as its size asks for.
    """
    ordered = postings(products).repartitionByRange("trigram", "product_id").sortWithinPartitions("trigram", "product_id")
    ordered.write.mode("append").parquet(f"{folder}/postings")


def literal_trigrams(pattern: str) -> list:
    """The trigrams that every match of a pattern holds; % and _ match anything."""
    # A backslash escapes what follows, so it ends a run as well.
    runs = re.split(r"[%_\\]", pattern.lower())
    return list(dict.fromkeys(run[i:i + 3] for run in runs for i in range(len(run) - 2)))


def candidates(index: DataFrame, wanted: list) -> DataFrame:
    """(product_id, sku) of the products of which one field holds the rarest of the wanted trigrams."""
    lists = index.filter(F.col("trigram").isin(wanted))
    # At most one row for each trigram of the pattern.
    counts = {row["trigram"]: row["n"] for row in lists.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = sorted(wanted, key=lambda t: (counts.get(t, 0), t))[:LOOKED_UP]
    if any(t not in counts for t in rare):
        return index.select("product_id", "sku").limit(0)
    met = index.filter(F.col("trigram").isin(rare)).groupBy("field", "product_id", "sku").agg(
        F.count_distinct("trigram").alias("held"))
    return met.filter(F.col("held") == len(rare)).select("product_id", "sku").distinct()


def search_stored(tables: Tables, folder: str, search: str, status: str = None, category: str = None) -> DataFrame:
    """``filter_products`` of the stored catalog, reading only the buckets of candidates.

    A pattern without a run of three literal characters is a scan.
    """
    wanted = literal_trigrams(search)
    if not wanted:
        return filter_products(tables.read("products"), status, category, search)
    index = tables.spark.read.schema("trigram string, field string, product_id bigint, sku string").parquet(f"{folder}/postings")
    found = settle(candidates(index, wanted), "search-candidates")
    near = tables.read("products", tables.buckets_of("products", found))
    return filter_products(near.join(found.select("sku").distinct(), "sku", "left_semi").select(*near.columns), status, category, search)
