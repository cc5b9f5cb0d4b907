"""Streaming price monitor: alerts for each micro-batch of snapshots.

The state is the last priced snapshot of each series, a table in buckets by product; a
batch reads and rewrites the buckets it touches. The look-back of a batch is the batch
operator itself: it runs in the JVM and cuts a series that fills a third of a batch into
slices, where a keyed state function would have to sort that series in one task.

A snapshot may come after newer ones of its series. Such series are looked back on in their whole stored
history: the late snapshot gets its alerts, and the change alerts of the snapshot behind it are
withdrawn and made again. So the alerts do not depend on the order in which snapshots come.
"""

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfloom.operators.prices import (
    SERIES, advance_latest, batch_alerts, late_series, revised_alerts, without_void_alerts,
)
from shelfloom.operators.skew import ROWS_PER_TASK
from shelfloom.plans.kept_counts import keep_counts
from shelfloom.plans.store_changes import merge_parts
from shelfloom.session import intermediate, settle
from shelfloom.sources.tables import BUCKETS, Change, Tables, time_range
from shelfloom.streaming.progress import stream_id


def new_snapshots(batch: DataFrame, change: Change) -> DataFrame:
    """Snapshots that are not stored yet: a stream that lost its checkpoint brings old ones again.

    Only stored parts that reach into the batch's range of times are read.
    """
    times = time_range(batch, "scraped_at")
    if times is None:
        return batch
    stored = change.read("competitor_prices", times=times)
    return batch.join(stored.select("price_id"), "price_id", "left_anti").select(*batch.columns)


def store_late(change: Change, timely: DataFrame, taken: DataFrame, late: DataFrame, products: DataFrame,
               rows_per_task: int) -> None:
    """Alerts of a batch with late snapshots: ``timely`` ones, and those of the ``late`` series' snapshots."""
    stored = change.read("competitor_prices", change.buckets_of("competitor_prices", late))
    history = stored.join(late, SERIES, "left_semi").select(*taken.columns)
    made, revised = revised_alerts(history, taken, products, rows_per_task=rows_per_task)
    made = settle(made.unionByName(timely), "price-alerts")
    buckets = change.buckets_of("competitor_alerts", revised)
    if not buckets:
        change.append("competitor_alerts", made)
        return
    before = change.read("competitor_alerts", buckets)
    kept = settle(without_void_alerts(before, revised, made), "kept-alerts")
    # An alert that is made again as it was stays, acknowledged or not.
    change.replace("competitor_alerts", kept.unionByName(made.join(kept.select("alert_id"), "alert_id", "left_anti").select(
        *kept.columns)), buckets)


def monitor_prices(stream: DataFrame, products: Callable[[], DataFrame], root: str,
                   checkpoint: str, rows_per_task: int = ROWS_PER_TASK, buckets: int = BUCKETS,
                   trigger: dict = None) -> StreamingQuery:
    """Append snapshots and alerts of every micro-batch to the tables under ``root``.

    ``products`` gives the catalog to compare with and is asked for each batch. A
    repeated batch is stored once. ``trigger`` goes to ``writeStream.trigger``; without
    one, the stream takes what there is and ends.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        change = Tables(spark, root, buckets).begin(
            f"prices:{stream_id(spark, checkpoint)}:{batch_id}", counted=True)
        if change is None:
            return
        with intermediate(spark):
            arrived = settle(batch, "price-batch")
            taken = settle(new_snapshots(arrived, change), "new-prices")
            touched = change.buckets_of("latest_prices", taken)
            latest = change.read("latest_prices", touched)
            late = settle(late_series(latest, taken), "late-series")
            if late.isEmpty():
                change.append("competitor_alerts", batch_alerts(latest, taken, products(), rows_per_task=rows_per_task))
            else:
                timely = batch_alerts(latest, taken.join(late, SERIES, "left_anti"), products(), rows_per_task=rows_per_task)
                store_late(change, timely, taken.join(late, SERIES, "left_semi"), late, products(), rows_per_task)
            change.append("competitor_prices", taken)
            change.replace("latest_prices", advance_latest(latest, taken), touched)
            keep_counts(change)
            change.commit()
        merge_parts(change.tables)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
