"""The price job: from stored marketplace pages to snapshots and alerts."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from shelfloom.operators.prices import (
    advance_latest, batch_alerts, products_to_scrape, scrape_summary, search_targets, snapshots,
    unmatched_targets,
)
from shelfloom.plans.kept_counts import keep_counts
from shelfloom.session import intermediate, settle
from shelfloom.sources.pages import best_listings, read_listings
from shelfloom.sources.tables import Change, Tables


@dataclass
class PriceResult:
    snapshots: DataFrame
    alerts: DataFrame
    unmatched: DataFrame
    latest: DataFrame
    summary: DataFrame


def run_prices(pages: DataFrame, products: DataFrame, latest, run_ts: datetime,
               sources: list = None, ids: DataFrame = None) -> PriceResult:
    """Outcome of one run over fetched pages.

    ``latest`` is the last priced snapshot of each series so far, or a function that gives
    it for the products of some snapshots. A product without a listing goes to
    ``unmatched``; no price is made up for it. Pages are parsed once and alerts
    computed once: both are written out and read by all outputs.
    """
    scraped = products_to_scrape(products, ids)
    targets = search_targets(scraped, sources)
    best = settle(best_listings(read_listings(pages)), "best-listings")
    taken = settle(snapshots(targets, best, run_ts), "snapshots")
    state = latest(taken) if callable(latest) else latest
    alerts = settle(batch_alerts(state, taken, products), "alerts")
    return PriceResult(
        snapshots=taken,
        alerts=alerts,
        unmatched=unmatched_targets(targets, best).select(
            "product_id", "source", "query", "search_url"),
        latest=advance_latest(state, taken),
        summary=scrape_summary(scraped, taken, alerts),
    )


def latest_of(change: Change):
    """The state of the series of some snapshots' products: the buckets in which they lie."""
    return lambda taken: change.read("latest_prices", change.buckets_of("latest_prices", taken))


def store_prices(result: PriceResult, change: Change) -> None:
    """Write a run's snapshots, alerts and state in one commit.

    ``result`` was run with ``latest_of(change)``.
    """
    change.append("competitor_prices", result.snapshots)
    change.append("competitor_alerts", result.alerts)
    change.replace("latest_prices", result.latest, change.touched["latest_prices"])
    keep_counts(change)
    change.commit()


def scrape(tables: Tables, pages: DataFrame, run_ts: datetime, run: str, sources: list = None,
           ids: DataFrame = None):
    """Run the price job named ``run`` on the store; a run that is stored already does nothing.

    Returns the summary row, or None.
    """
    change = tables.begin(f"prices:{run}", str(run_ts))
    if change is None:
        return None
    with intermediate(tables.spark):
        result = run_prices(pages, change.read("products"), latest_of(change), run_ts, sources, ids)
        store_prices(result, change)
        return result.summary.first()
