"""Competitor price snapshots: search targets, alerts, comparisons, histories."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.fixed_values import (
    CHANGE_PERCENT, INR_PER_USD, OUT_OF_STOCK_TEXT, PRICE_DROP_TEXT, PRICE_INCREASE_TEXT,
    SCRAPED_STATUSES, SOURCES, UNDERCUT_PERCENT, UNDERCUT_TEXT,
)
from shelfloom.functions.money import change_percent, in_our_currency, undercut_percent
from shelfloom.functions.search import search_query, search_url
from shelfloom.functions.text import fill, fixed_decimals, kept_in_order, title_case
from shelfloom.operators.catalog import matching
from shelfloom.operators.skew import (
    ROWS_PER_TASK, hot_keys, lag_by_key, lag_by_slice, previous_value, slices_for,
)
from shelfloom.session import settle

SERIES = ["product_id", "source"]
SERIES_ORDER = ["scraped_at", "price_id"]
ALERT_TYPE = "array<struct<alert_type:string,price_difference:double>>"


# --- what to look up -------------------------------------------------------

def products_to_scrape(products: DataFrame, ids: DataFrame = None) -> DataFrame:
    """The products with the given ids, or all active and flagged ones."""
    if ids is not None:
        return products.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    return products.filter(F.col("status").isin(SCRAPED_STATUSES))


def search_targets(products: DataFrame, sources: list = None) -> DataFrame:
    """One row per product and marketplace with its search query and address.

    The few sources are an array on each row; nothing is joined or shuffled. A
    source named twice is searched once.
    """
    names = list(dict.fromkeys(sources or SOURCES))
    queried = products.withColumn("query", search_query(F.col("brand"), F.col("title")))
    targets = queried.withColumn("source", F.explode(F.array(*[F.lit(n) for n in names])))
    return targets.withColumn("search_url", search_url(F.col("query"), F.col("source")))



def snapshots(targets: DataFrame, best: DataFrame, run_ts) -> DataFrame:
    """Price snapshots of the targets for which a listing was found.

    ``best`` has at most one listing per product and source. The id is a hash
    of product, source and time, and so the same in every recomputation.
    """
    stamp = F.lit(run_ts).cast("timestamp")
    found = best.join(targets.select(*SERIES), SERIES, "left_semi")
    return found.select(
        F.xxhash64(*SERIES, stamp).alias("price_id"),
        *SERIES,
        F.col("title").alias("competitor_title"),
        F.col("url").alias("competitor_url"),
        F.col("price").alias("competitor_price"),
        F.col("currency").alias("competitor_currency"),
        "in_stock",
        stamp.alias("scraped_at"),
    )


def unmatched_targets(targets: DataFrame, best: DataFrame) -> DataFrame:
    """Targets for which no listing was found."""
    return targets.join(best.select(*SERIES), SERIES, "left_anti")


# --- alerts ----------------------------------------------------------------

def priced(prices: DataFrame) -> DataFrame:
    """Snapshots with a price; a price of 0 stays in as a predecessor."""
    return prices.filter(F.col("competitor_price").isNotNull())


def latest_priced(prices: DataFrame) -> DataFrame:
    """The last priced snapshot of each series.

    Its place in the order is picked from narrow columns, combined before the shuffle,
    and its row is then found by series and place.
    """
    rows = priced(prices)
    last = rows.groupBy(*SERIES).agg(F.max(F.struct(*SERIES_ORDER)).alias("_last")).select(
        *SERIES, "_last.*")
    same = [rows[c].eqNullSafe(last[c]) for c in (*SERIES, *SERIES_ORDER)]
    # A snapshot that was given twice is taken once.
    return rows.join(last, same, "left_semi").dropDuplicates(SERIES).select(*prices.columns)


def _offers(products: DataFrame) -> DataFrame:
    """Our side of a comparison; products without a price raise no alerts."""
    return products.filter(F.col("price").isNotNull() & (F.col("price") != 0)).select(
        "product_id", F.col("price").alias("our_price"), F.col("currency").alias("our_currency")
    )


def compared_prices(prices: DataFrame, products: DataFrame,
                    rows_per_task: int = ROWS_PER_TASK, hot: DataFrame = None) -> DataFrame:
    """Priced snapshots with our price and the previous price of their series.

    The join with our products and the look-back share one shuffle by product.
    Series with more than ``rows_per_task`` snapshots go another way: they are
    cut into slices, and meet only their own few products. ``hot`` (series, n) names
    them where they are counted already. If rows are marked by ``_new``, ``_seen``
    is the place in the order of the series' row that is not new.
    """
    rows, offers = priced(prices), _offers(products)
    hot = hot_keys(rows, SERIES, rows_per_task) if hot is None else hot
    slices = slices_for(hot, rows_per_task)
    marked = "_new" in rows.columns

    def look_back(part: DataFrame) -> DataFrame:
        looked = lag_by_key(part.join(offers, "product_id"), SERIES, SERIES_ORDER,
                            "competitor_price", "previous_price")
        if not marked:
            return looked
        old = F.when(~F.col("_new"), F.struct(*SERIES_ORDER))
        return looked.withColumn("_seen", F.max(old).over(Window.partitionBy(*SERIES)))

    if not slices:
        return look_back(rows)
    names = hot.select(*SERIES)
    # At most one product per hot series, so this table is as small as ``hot``.
    hot_offers = settle(
        offers.join(names.select("product_id").distinct(), "product_id", "left_semi"), "hot-offers"
    )
    sliced = lag_by_slice(
        rows.join(names, SERIES, "left_semi"), SERIES, SERIES_ORDER,
        "competitor_price", "previous_price", slices,
    )
    if marked:
        known = rows.join(names, SERIES, "left_semi").filter(~F.col("_new")).select(
            *SERIES, F.struct(*SERIES_ORDER).alias("_seen"))
        sliced = sliced.join(known, SERIES, "left")
    cold = look_back(rows.join(names, SERIES, "left_anti"))
    return cold.unionByName(sliced.join(hot_offers, "product_id").select(*cold.columns))


def _alert(alert_type: str, difference: Column = None) -> Column:
    difference = F.lit(None) if difference is None else difference
    return F.struct(
        F.lit(alert_type).alias("alert_type"), difference.cast("double").alias("price_difference")
    )


def with_alerts(compared: DataFrame, rate: float = INR_PER_USD,
                undercut_from: float = UNDERCUT_PERCENT,
                change_from: float = CHANGE_PERCENT) -> DataFrame:
    """Add the array ``alerts`` of a snapshot: undercut, out of stock, change.

    Also adds the two percentages that the messages name.
    """
    theirs, ours, previous = F.col("competitor_price"), F.col("our_price"), F.col("previous_price")
    staged = compared.withColumns({
        "_fx": in_our_currency(theirs, F.col("competitor_currency"), F.col("our_currency"), rate),
        "change_percent": F.when(theirs != 0, change_percent(theirs, previous)),
    }).withColumn("below_percent", undercut_percent(ours, F.col("_fx")))

    priced_now = theirs != 0
    undercut = priced_now & (F.col("_fx") < ours) & (F.col("below_percent") >= undercut_from)
    changed = F.col("change_percent") >= change_from
    alerts = kept_in_order([
        (undercut, _alert("undercut", ours - F.col("_fx"))),
        (priced_now & ~F.coalesce("in_stock", F.lit(False)), _alert("out_of_stock")),
        (changed & (theirs < previous), _alert("price_drop", F.abs(theirs - previous))),
        (changed & (theirs >= previous), _alert("price_increase", F.abs(theirs - previous))),
    ], ALERT_TYPE)
    return staged.withColumn("alerts", alerts).drop("_fx")


def _message() -> Column:
    """Text of an alert row by its kind."""
    source = title_case(F.col("source"))
    theirs = fixed_decimals(F.col("competitor_price"), 2)
    change = {
        "source": source, "percent": fixed_decimals(F.col("change_percent"), 1),
        "previous": fixed_decimals(F.col("previous_price"), 2), "price": theirs,
    }
    undercut = fill(
        UNDERCUT_TEXT, source=source,
        currency=F.coalesce("competitor_currency", F.lit("None")), price=theirs,
        percent=fixed_decimals(F.col("below_percent"), 1),
        our_currency=F.coalesce("our_currency", F.lit("None")),
        our_price=fixed_decimals(F.col("our_price"), 2),
    )
    kind = F.col("alert_type")
    return (
        F.when(kind == "undercut", undercut)
        .when(kind == "out_of_stock", fill(OUT_OF_STOCK_TEXT, source=source))
        .when(kind == "price_drop", fill(PRICE_DROP_TEXT, **change))
        .otherwise(fill(PRICE_INCREASE_TEXT, **change))
    )


def alert_rows(with_array: DataFrame, created_at: Column = None) -> DataFrame:
    """Rows for the append-only alert table; texts are made for alerts alone."""
    exploded = with_array.select(
        "price_id", *SERIES, "our_price", "our_currency", "competitor_price", "competitor_currency",
        "previous_price", "below_percent", "change_percent", "scraped_at",
        F.explode_outer("alerts").alias("_alert"),
    )
    # Outer with a filter behind it: see issue_rows.
    kept = exploded.filter(F.col("_alert").isNotNull()).select("*", "_alert.*")
    return kept.select(
        F.xxhash64("price_id", "alert_type").alias("alert_id"),
        "product_id",
        "alert_type",
        "source",
        _message().alias("message"),
        "our_price",
        "competitor_price",
        "price_difference",
        F.lit(False).alias("acknowledged"),
        (created_at if created_at is not None else F.col("scraped_at")).alias("created_at"),
    )


def history_alerts(prices: DataFrame, products: DataFrame, rate: float = INR_PER_USD,
                   undercut_from: float = UNDERCUT_PERCENT, change_from: float = CHANGE_PERCENT,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Alerts for every snapshot of a history, against today's catalog prices."""
    compared = compared_prices(prices, products, rows_per_task)
    return alert_rows(with_alerts(compared, rate, undercut_from, change_from))


def batch_alerts(latest: DataFrame, batch: DataFrame, products: DataFrame,
                 rate: float = INR_PER_USD, undercut_from: float = UNDERCUT_PERCENT,
                 change_from: float = CHANGE_PERCENT,
                 rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Alerts for a batch of new snapshots.

    ``latest`` holds the last priced snapshot of each series before the batch
    (``latest_priced``), so the history itself is not read again. A snapshot
    that arrives late, with a time before its series' last one, is compared with
    our price but raises no change alert.
    """
    # One narrow row for each series of the batch: it picks the state and names hot series.
    touched = settle(batch.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")), "touched-series")
    before = latest.join(touched.select(*SERIES), SERIES, "left_semi").withColumn("_new", F.lit(False))
    rows = before.unionByName(batch.withColumn("_new", F.lit(True)))
    hot = touched.filter(F.col("n") >= rows_per_task)
    compared = compared_prices(rows, products, rows_per_task, hot).filter("_new")
    late = F.coalesce(F.struct(*SERIES_ORDER) < F.col("_seen"), F.lit(False))
    timely = compared.withColumn(
        "previous_price", F.when(~late, F.col("previous_price"))
    ).drop("_seen", "_new")
    return alert_rows(with_alerts(timely, rate, undercut_from, change_from))


def late_series(latest: DataFrame, batch: DataFrame) -> DataFrame:
    """The series of a batch in which a priced snapshot lies before the series' last one so far."""
    first = priced(batch).groupBy(*SERIES).agg(F.min(F.struct(*SERIES_ORDER)).alias("_first"))
    return first.join(latest, SERIES).filter(F.col("_first") < F.struct(*SERIES_ORDER)).select(*SERIES)


def revised_alerts(history: DataFrame, batch: DataFrame, products: DataFrame,
                   rate: float = INR_PER_USD, undercut_from: float = UNDERCUT_PERCENT,
                   change_from: float = CHANGE_PERCENT,
                   rows_per_task: int = ROWS_PER_TASK) -> tuple:
    """(alerts, revised) for a batch of snapshots that may lie anywhere in their series.

    ``history`` are the stored snapshots of the batch's series. A new snapshot is compared with the
    one before it, stored or new. The stored snapshot that now follows a new one has another
    predecessor: its change alerts are made again, and ``revised`` (price_id, product_id) names it,
    since those it had are void.
    """
    rows = priced(history.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True))))
    paired = rows.withColumn("_price", F.struct("competitor_price", "_new"))
    looked = previous_value(paired, SERIES, SERIES_ORDER, "_price", "_before", rows_per_task).drop("_price")
    followed = F.coalesce("_before._new", F.lit(False))
    compared = settle(
        looked.filter(F.col("_new") | followed)
        .withColumn("previous_price", F.col("_before.competitor_price")).drop("_before"), "revised-prices")
    met = with_alerts(compared.join(_offers(products), "product_id"), rate, undercut_from, change_from)
    # What a stored snapshot says of our price and of its stock has not changed.
    only_change = F.filter("alerts", lambda alert: alert["alert_type"].startswith("price_"))
    met = met.withColumn("alerts", F.when(F.col("_new"), F.col("alerts")).otherwise(only_change)).drop("_new")
    return alert_rows(met), compared.filter(~F.col("_new")).select("price_id", "product_id")


def without_void_alerts(alerts: DataFrame, revised: DataFrame, made: DataFrame) -> DataFrame:
    """Stored alerts without the change alerts of ``revised`` snapshots that ``made`` does not repeat."""
    void = revised.select(F.explode(F.array(*[
        F.xxhash64("price_id", F.lit(kind)) for kind in ("price_drop", "price_increase")])).alias("alert_id"))
    same = ["alert_id", "message"]
    gone = void.join(alerts.select(*same), "alert_id").join(made.select(*same), same, "left_anti")
    return alerts.join(gone.select("alert_id"), "alert_id", "left_anti").select(*alerts.columns)


def advance_latest(latest: DataFrame, batch: DataFrame) -> DataFrame:
    """``latest_priced`` after a batch, from itself and the batch alone."""
    return latest_priced(latest.unionByName(batch))


def scrape_summary(scraped: DataFrame, taken: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: products_scraped, results_found, alerts_generated.

    Three one-row counts are stacked and added up, so nothing is joined.
    """
    tables = {"products_scraped": scraped, "results_found": taken, "alerts_generated": alerts}
    counts = [table.agg(F.count(F.lit(1)).alias(name)) for name, table in tables.items()]
    stacked = counts[0]
    for count in counts[1:]:
        stacked = stacked.unionByName(count, allowMissingColumns=True)
    return stacked.agg(*[F.sum(name).alias(name) for name in tables])


# --- reading ---------------------------------------------------------------

def list_prices(prices: DataFrame, product_id: int = None, source: str = None,
                limit: int = 50) -> DataFrame:
    """Newest snapshots, optionally of one product or marketplace."""
    rows = matching(prices, {"product_id": product_id or None, "source": source or None})
    return rows.orderBy(F.desc("scraped_at"), F.desc("price_id")).limit(limit)


def list_alerts(alerts: DataFrame, acknowledged: bool = None, product_id: int = None,
                limit: int = 50) -> DataFrame:
    """Newest alerts, optionally by state or of one product."""
    rows = matching(alerts, {"acknowledged": acknowledged, "product_id": product_id or None})
    return rows.orderBy(F.desc("created_at"), F.desc("alert_id")).limit(limit)


def newest_per_product(prices: DataFrame, count: int = 10) -> DataFrame:
    """The ``count`` newest snapshots of each product, with their rank.

    Spark keeps the top rows of each product per task before the shuffle, so a
    product with very many snapshots sends only a few.
    """
    window = Window.partitionBy("product_id").orderBy(F.desc("scraped_at"), F.desc("price_id"))
    return prices.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= count)


def price_comparison(products: DataFrame, prices: DataFrame, newest: int = 10) -> DataFrame:
    """Per product: our price, then the non-zero ones among its newest snapshots.

    Products without any snapshot do not appear. Each row keeps its currency.
    """
    top = newest_per_product(prices, newest).select(
        "product_id", "rank", "source", "competitor_price", "competitor_currency"
    )
    ours = products.select(
        "product_id", F.col("price").alias("_price"), F.col("currency").alias("_currency")
    )
    joined = top.join(ours, "product_id")

    def bar(position, name, source, price, currency):
        return F.struct(
            position.cast("int").alias("position"), name.alias("name"), source.alias("source"),
            price.alias("price"), currency.alias("currency"),
        )

    own = bar(F.lit(0), F.lit("Your Price"), F.lit("ours"),
              F.coalesce("_price", F.lit(0.0)), F.col("_currency"))
    source = F.col("source")
    name = F.concat(F.upper(F.substring(source, 1, 1)), F.substr(source, F.lit(2)))
    other = bar(F.col("rank"), name, source, F.col("competitor_price"), F.col("competitor_currency"))
    shown = F.array_compact(F.array(
        F.when(F.col("rank") == 1, own), F.when(F.col("competitor_price") != 0, other)
    ))
    return joined.select("product_id", F.explode(shown).alias("_bar")).select("product_id", "_bar.*")


# --- declared kinds without a rule of their own ----------------------------

def back_in_stock(prices: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Snapshots in stock whose predecessor in the series was out of stock."""
    looked = previous_value(prices, SERIES, SERIES_ORDER, "in_stock", "_before", rows_per_task)
    return looked.filter(F.col("in_stock") & ~F.col("_before")).drop("_before")
