"""The search index and the page directory against whole reads."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfloom.operators.catalog import filter_products, product_page
from shelfloom.plans import page_directory, search_index
from shelfloom.schemas import PRODUCTS
from shelfloom.sources.tables import Tables

PATTERNS = ["lamp", "LAMP", "a%p", "la_p", "100%", "oak tab", "%", "_", "ab", "", "sku-01", "É", "éclair", "x_y_z", "no such", "lamp%oak",
            "\\%off", "brand 3", "ır", "  "]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    """A stored catalog of 400 products whose order has ties."""
    chance = random.Random(7)
    words = ["lamp", "Lamp", "oak table", "Éclair", "100% wool", "x_y_z", "50%off", "chair", "ab", "İr"]
    rows = []
    for i in range(400):
        title = " ".join(chance.choice(words) for _ in range(chance.randrange(1, 4)))
        stamp = datetime(2024, 1, 1) + timedelta(hours=chance.randrange(60))
        rows.append((i, f"SKU-{i:03}", title, chance.choice([None, "", f"Brand {i % 5}"]), ["active", "flagged"][i % 2], stamp))
    frame = spark.createDataFrame(rows, "product_id bigint, sku string, title string, brand string, status string, updated_at timestamp")
    missing = [f for f in PRODUCTS.fields if f.name not in frame.columns]
    tables = Tables(spark, str(tmp_path_factory.mktemp("catalog")), buckets=32)
    change = tables.begin("all")
    change.append("products", frame.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]))
    change.commit()
    return tables


def ids(rows):
    return [r["product_id"] for r in rows.select("product_id").collect()]


def test_searches_equal_scans(spark, catalog, tmp_path):
    folder, products = str(tmp_path), catalog.read("products")
    search_index.add_to_index(products.filter("product_id < 300"), folder)
    search_index.add_to_index(products.filter("product_id >= 250"), folder)  # postings may come twice
    for pattern in PATTERNS:
        want = sorted(ids(filter_products(products, "active", None, pattern)))
        assert sorted(ids(search_index.search_stored(catalog, folder, pattern, status="active"))) == want, pattern


def test_a_search_reads_the_buckets_of_its_candidates(spark, catalog, tmp_path, monkeypatch):
    folder = str(tmp_path)
    search_index.add_to_index(catalog.read("products"), folder)
    read, whole = [], Tables._read
    monkeypatch.setattr(Tables, "_read", lambda self, state, name, buckets, times: read.append(buckets) or whole(
        self, state, name, buckets, times))
    assert ids(search_index.search_stored(catalog, folder, "sku-123")) == [123]
    assert len(read) == 1 and len(read[0]) == 1


def test_literal_trigrams():
    assert search_index.literal_trigrams("ABcd%e_fgh") == ["abc", "bcd", "fgh"]
    assert search_index.literal_trigrams("a%b") == [] and search_index.literal_trigrams("aaaa") == ["aaa"]


def test_pages_equal_the_sorted_catalog(spark, catalog, tmp_path, monkeypatch):
    folder, products = str(tmp_path), catalog.read("products")
    page_directory.write_directory(products, folder, 12)
    read, whole = [], Tables._read
    monkeypatch.setattr(Tables, "_read", lambda self, state, name, buckets, times: read.append(buckets) or whole(
        self, state, name, buckets, times))
    for skip, limit in ((0, 10), (360, 10), (395, 50), (33, 1), (400, 5), (10_000, 5), (0, 400)):
        assert ids(page_directory.stored_page(catalog, folder, skip, limit)) == ids(product_page(products, skip, limit))
    assert all(len(buckets) <= 10 for buckets in read[1:2])


def test_a_page_reads_one_or_two_ranges():
    sizes = [(i, 100) for i in range(50)]
    assert page_directory.ranges_of(sizes, 4500, 50) == ([45], 4500)
    assert page_directory.ranges_of(sizes, 4480, 50) == ([44, 45], 4400)
    assert page_directory.ranges_of(sizes, 5000, 50) == ([], 0)
    assert page_directory.ranges_of([], 0, 50) == ([], 0)
