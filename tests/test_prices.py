"""Snapshots, look-back, alerts, comparisons, and hot series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfloom.operators import prices as px
from shelfloom.operators.skew import hot_keys, lag_by_key, previous_value, slices_for
from shelfloom.plans.price_job import run_prices
from shelfloom.schemas import COMPETITOR_PRICES, PAGES

DAY = datetime(2024, 3, 1)
PRODUCT = "product_id bigint, price double, currency string"


def snapshot(number, price, day=None, product=1, source="amazon", currency="USD", in_stock=True):
    when = DAY + timedelta(days=number if day is None else day)
    return (number, product, source, f"t{number}", None, price, currency, in_stock, when)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), COMPETITOR_PRICES)


def alerts(spark, rows, product=(1, 100.0, "USD"), **options):
    found = px.history_alerts(
        table(spark, *rows), spark.createDataFrame([product], PRODUCT), **options)
    order = {"undercut": 0, "out_of_stock": 1, "price_drop": 2, "price_increase": 2}
    return sorted(
        (r["created_at"].day - 1, order[r["alert_type"]], r["alert_type"], r["price_difference"], r["message"])
        for r in found.collect()
    )


def kinds(found):
    return [(day, kind) for day, _, kind, _, _ in found]


def test_undercut_from_five_percent(spark):
    found = alerts(spark, [snapshot(0, 95.01), snapshot(1, 95.0), snapshot(2, 94.0)])
    assert kinds(found) == [(1, "undercut"), (2, "undercut")]
    assert found[0][3] == 5.0
    assert found[0][4] == (
        "Amazon is selling a similar product at USD 95.00, which is 5.0% lower than your price of USD 100.00.")


def test_undercut_across_currencies_keeps_both_prices(spark):
    found = alerts(spark, [snapshot(0, 7470.0, source="flipkart", currency="INR")])
    assert kinds(found) == [(0, "undercut")] and found[0][3] == pytest.approx(10.0)
    assert "at INR 7470.00, which is 10.0% lower than your price of USD 100.00." in found[0][4]
    found = alerts(spark, [snapshot(0, 100.0)], product=(1, 10000.0, "INR"))
    assert kinds(found) == [(0, "undercut")] and found[0][3] == 1700.0
    assert alerts(spark, [snapshot(0, 100.0, currency="EUR")]) == []


def test_out_of_stock_and_unknown_stock(spark):
    found = alerts(spark, [snapshot(0, 100.0, in_stock=False), snapshot(1, 100.0, in_stock=None), snapshot(2, 100.0)])
    assert kinds(found) == [(0, "out_of_stock"), (1, "out_of_stock")]
    assert found[0][3] is None and found[0][4].startswith("Competitor on Amazon is OUT OF STOCK")


def test_change_from_ten_percent_in_order(spark):
    found = alerts(spark, [snapshot(0, 200.0), snapshot(1, 180.0), snapshot(2, 198.0), snapshot(3, 180.0)])
    assert kinds(found) == [(1, "price_drop"), (2, "price_increase")]
    assert found[0][4] == "Competitor on Amazon dropped price by 10.0% (from 200.00 to 180.00)."
    assert found[1][3] == 18.0


def test_no_alerts_without_prices_and_after_zero(spark):
    rows = [snapshot(0, None, in_stock=False), snapshot(1, 0.0, in_stock=False), snapshot(2, 150.0),
            snapshot(3, None), snapshot(4, 300.0)]
    # The 150 follows a 0: no change. The 300 looks past the missing price to the 150.
    assert kinds(alerts(spark, rows)) == [(4, "price_increase")]
    for price in (None, 0.0):
        assert alerts(spark, [snapshot(0, 5.0, in_stock=False)], product=(1, price, "USD")) == []


def test_equal_times_go_by_id_and_series_are_apart(spark):
    rows = [snapshot(2, 300.0, day=0), snapshot(1, 200.0, day=0), snapshot(3, 900.0, day=0, source="walmart")]
    found = alerts(spark, rows)
    assert [(k, d) for _, _, k, d, _ in found] == [("price_increase", 100.0)]


def test_thresholds_and_rate_are_parameters(spark):
    rows = [snapshot(0, 99.0), snapshot(1, 98.0)]
    assert kinds(alerts(spark, rows, undercut_from=1, change_from=1)) == [
        (0, "undercut"), (1, "undercut"), (1, "price_drop")]


def random_rows(count, seed):
    random.seed(seed)
    rows = []
    for number in range(count):
        product = 1 if random.random() < 0.5 else random.randint(2, 12)
        rows.append(snapshot(
            number, random.choice([None, 0.0, *[float(random.randint(50, 150)) for _ in range(6)]]),
            day=random.randint(0, 4), product=product, source=random.choice(px.SOURCES),
            in_stock=random.random() < 0.9))
    return rows


def products(spark, count=13):
    return spark.createDataFrame([(i, 100.0, "USD") for i in range(count)], PRODUCT)


def as_set(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_hot_series_give_the_same_alerts(spark):
    rows = table(spark, *random_rows(400, 1))
    usual = as_set(px.history_alerts(rows, products(spark)))
    assert usual and as_set(px.history_alerts(rows, products(spark), rows_per_task=15)) == usual
    assert as_set(px.back_in_stock(rows)) == as_set(px.back_in_stock(rows, rows_per_task=15))


def test_hot_key_with_a_single_time_is_sliced_exactly(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.lit(7).alias("t"), "id", F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"))
    hot = hot_keys(rows, ["k"], 100)
    assert [(r["k"], r["n"]) for r in hot.collect()] == [(0, 1000)]
    sliced = previous_value(rows, ["k"], ["t", "id"], "v", "p", rows_per_task=100)
    assert as_set(sliced) == as_set(lag_by_key(rows, ["k"], ["t", "id"], "v", "p"))


def test_slices_do_not_outnumber_the_tasks_that_they_need(spark):
    """Many hot keys of a few rows each: the slices go by the session, not by the rows."""
    hot = spark.range(1_000_000).select(F.col("id").alias("k"), F.lit(16).alias("n"))
    assert slices_for(hot, 15) == 8
    assert slices_for(hot, 16_000_000) == 1 and slices_for(hot.limit(0), 15) == 0
    assert slices_for(hot.withColumn("n", F.lit(4_000)), 15) == 1000


def test_batches_on_state_equal_the_whole_history(spark):
    rows = sorted(random_rows(200, 2), key=lambda r: (r[8], r[0]))
    whole = as_set(px.history_alerts(table(spark, *rows), products(spark)))
    latest, found = table(spark), set()
    for part in (rows[:70], rows[70:120], rows[120:]):
        batch = table(spark, *part)
        found |= as_set(px.batch_alerts(latest, batch, products(spark), rows_per_task=20))
        latest = spark.createDataFrame(px.advance_latest(latest, batch).collect(), COMPETITOR_PRICES)
    assert found == whole


def test_late_snapshot_raises_no_change_and_moves_nothing(spark):
    latest = table(spark, snapshot(10, 100.0, day=5))
    batch = table(spark, snapshot(11, 200.0, day=3), snapshot(12, 210.0, day=4), snapshot(13, 120.0, day=6))
    found = px.batch_alerts(latest, batch, products(spark)).collect()
    assert [(r["alert_type"], r["competitor_price"], r["price_difference"]) for r in found] == [
        ("price_increase", 120.0, 20.0)]
    late = px.advance_latest(latest, table(spark, snapshot(11, 200.0, day=3))).first()
    assert late["price_id"] == 10


def test_search_targets(spark):
    frame = spark.createDataFrame(
        [(1, "Shoe", "Acme", "active"), (2, "Hat", None, "draft"), (3, "Cap", "", "flagged")],
        "product_id bigint, title string, brand string, status string")
    targets = px.search_targets(px.products_to_scrape(frame), ["walmart", "amazon", "walmart"])
    assert sorted((r["product_id"], r["source"], r["query"]) for r in targets.collect()) == [
        (1, "amazon", "Acme Shoe"), (1, "walmart", "Acme Shoe"), (3, "amazon", "Cap"), (3, "walmart", "Cap")]
    chosen = px.products_to_scrape(frame, spark.createDataFrame([(2,), (2,)], "product_id bigint"))
    assert [r["product_id"] for r in chosen.collect()] == [2]


def test_price_comparison(spark):
    rows = [snapshot(n, float(n), day=n) for n in range(1, 13)] + [
        snapshot(20, 0.0, product=2), snapshot(21, None, product=2)]
    frame = spark.createDataFrame([(1, 9.0, "USD"), (2, None, "INR"), (3, 5.0, "USD")], PRODUCT)
    found = {}
    for r in px.price_comparison(frame, table(spark, *rows)).collect():
        found.setdefault(r["product_id"], []).append((r["position"], r["name"], r["source"], r["price"], r["currency"]))
    assert sorted(found) == [1, 2]
    assert found[2] == [(0, "Your Price", "ours", 0.0, "INR")]
    assert sorted(found[1])[:2] == [(0, "Your Price", "ours", 9.0, "USD"), (1, "Amazon", "amazon", 12.0, "USD")]
    assert len(found[1]) == 11 and min(p for _, _, s, p, _ in found[1] if s == "amazon") == 3.0


def test_lists(spark):
    rows = table(spark, *[snapshot(n, 1.0, product=n % 2, source=px.SOURCES[n % 3]) for n in range(9)])
    assert [r["price_id"] for r in px.list_prices(rows, limit=3).collect()] == [8, 7, 6]
    assert [r["price_id"] for r in px.list_prices(rows, product_id=1, source="walmart").collect()] == [7, 1]
    frame = spark.createDataFrame(
        [(i, i % 2, i % 3 == 0, DAY) for i in range(6)],
        "alert_id bigint, product_id bigint, acknowledged boolean, created_at timestamp")
    assert [r["alert_id"] for r in px.list_alerts(frame, acknowledged=False, product_id=1).collect()] == [5, 1]
    assert px.list_alerts(frame, limit=2).count() == 2


def test_price_job(spark):
    page = '<div data-item-id="1"><span data-automation-id="product-title">W</span>' \
           '<div data-automation-id="product-price"><span>$80</span></div></div>'
    pages = spark.createDataFrame([(1, 1, "walmart", "u", page, DAY), (2, 1, "amazon", "u", "<p>", DAY)], PAGES)
    frame = spark.createDataFrame(
        [(1, "Shoe", "Acme", "active", 100.0, "USD")],
        "product_id bigint, title string, brand string, status string, price double, currency string")
    result = run_prices(pages, frame, table(spark, snapshot(5, 160.0, source="walmart")), datetime(2024, 6, 1))
    taken = result.snapshots.collect()
    assert [(r["source"], r["competitor_title"], r["competitor_price"]) for r in taken] == [("walmart", "W", 80.0)]
    assert sorted(r["alert_type"] for r in result.alerts.collect()) == ["price_drop", "undercut"]
    assert sorted(r["source"] for r in result.unmatched.collect()) == ["amazon", "flipkart"]
    assert tuple(result.summary.first()) == (1, 1, 2)
    assert [r["competitor_price"] for r in result.latest.collect()] == [80.0]
