"""The shared folder comes from the session."""

import os

import pytest
from pyspark.sql import functions as F

from shelfloom.schemas import PRODUCTS
from shelfloom.session import empty, intermediate, new_folder, settle, shared_folder


def test_folder_is_the_sessions_setting(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named and shared_folder(spark) == named
    assert new_folder(spark, "x").startswith(f"{named}/x-")


def test_settle_keeps_schema_and_rows(spark):
    frame = spark.createDataFrame([(1, {"a": "b"}, None)], "n int, m map<string,string>, t timestamp")
    kept = settle(frame, "kept")
    assert kept.dtypes == frame.dtypes and kept.collect() == frame.collect()
    assert settle(frame.limit(0), "none").count() == 0


def test_without_a_setting_the_folder_lies_below_the_warehouse(spark):
    class Bare:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, *default):
                return default[0] if default else "hdfs://warehouse/"

    assert shared_folder(Bare) == "hdfs://warehouse/_intermediate"


def test_tables_of_a_block_are_removed_with_it(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with pytest.raises(ValueError), intermediate(spark):
        outer = settle(spark.range(3), "outer")
        with intermediate(spark):
            assert settle(spark.range(3), "inner").count() == 3
        assert outer.count() == 3 and len(set(os.listdir(folder)) - before) == 1
        raise ValueError
    assert set(os.listdir(folder)) == before
    settle(spark.range(1), "kept")
    assert len(set(os.listdir(folder)) - before) == 1


def test_join_with_an_empty_table_moves_nothing(spark):
    nothing = empty(spark, PRODUCTS)
    assert nothing.schema == PRODUCTS and nothing.count() == 0
    rows = spark.range(5).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sku"))
    joined = rows.join(nothing.select("sku", "product_id"), "sku", "left")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {r["product_id"] for r in joined.collect()} == {None} and joined.count() == 5
