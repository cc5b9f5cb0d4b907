"""Ordered look-back over keys of which a few may hold most rows."""

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.session import settle

# A key with more rows than this is cut into slices of about this size.
ROWS_PER_TASK = 4_000_000


def hot_keys(df: DataFrame, keys: list, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Table (keys, n) of the keys with more than ``rows_per_task`` rows.

    At most total / rows_per_task keys can qualify. The counts are combined
    before the shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return settle(counts.filter(F.col("n") > rows_per_task), "hot-keys")


def lag_by_key(df: DataFrame, keys: list, order: list, value: str, out: str) -> DataFrame:
    """Previous ``value`` within each key; one task sorts one key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.lag(value).over(window))


def lag_by_slice(df: DataFrame, keys: list, order: list, value: str, out: str,
                 slices: int) -> DataFrame:
    """The same result as ``lag_by_key`` with each key spread over many tasks.

    Rows are range-partitioned by (key, order), which cuts a hot key wherever its
    rows lie, also when they share one timestamp. Each slice looks back within
    itself; the first row of a key in a slice takes the key's last value from
    the slice before, out of a table with one row per key and slice.
    """
    ranged = df.repartitionByRange(slices, *keys, *order).withColumn(
        "_slice", F.spark_partition_id()
    )
    # Written out so that both readers below see the same slice numbers.
    ranged = settle(ranged, "slices")
    ordering = F.struct(*order)
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    # As many tasks as slices, whatever the session's number of shuffle partitions.
    spread = ranged.repartition(slices, *keys, "_slice")
    looked_back = spread.withColumn(out, F.lag(value).over(within)).withColumn(
        "_row", F.row_number().over(within)
    )
    edges = (
        ranged.groupBy(*keys, "_slice")
        .agg(F.max_by(value, ordering).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")))
        .drop("_last")
    )
    return (
        looked_back.join(edges, [*keys, "_slice"], "left")
        .withColumn(out, F.when(F.col("_row") == 1, F.col("_carry")).otherwise(F.col(out)))
        .drop("_slice", "_row", "_carry")
    )


def slices_for(hot: DataFrame, rows_per_task: int) -> int:
    """How many slices the rows of all hot keys together are cut into; 0 without any.

    A slice is a task. Small ``rows_per_task`` make no more of them than the session has shuffle
    partitions, or than slices of ``ROWS_PER_TASK`` need; a slice then holds more rows.
    """
    rows = hot.agg(F.sum("n")).first()[0] or 0
    partitions = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(ceil(rows / rows_per_task), max(partitions, ceil(rows / ROWS_PER_TASK)))


def previous_value(df: DataFrame, keys: list, order: list, value: str, out: str,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``out``: the value of the preceding row of the same key.

    ``order`` must be unique within a key. Keys with few rows use one window;
    hot keys are taken apart and sliced.
    """
    hot = hot_keys(df, keys, rows_per_task)
    slices = slices_for(hot, rows_per_task)
    if not slices:
        return lag_by_key(df, keys, order, value, out)
    names = hot.select(*keys)
    cold_part = lag_by_key(df.join(names, keys, "left_anti"), keys, order, value, out)
    hot_part = lag_by_slice(
        df.join(names, keys, "left_semi"), keys, order, value, out,
        slices,
    )
    return cold_part.unionByName(hot_part).select(*df.columns, out)
