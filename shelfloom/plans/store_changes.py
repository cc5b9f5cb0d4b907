"""Changes of stored rows: resolve, acknowledge, delete, generate. Each rewrites the buckets it touches."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame

from shelfloom.operators import changes
from shelfloom.operators.content import resolve_content_issues, store_content
from shelfloom.plans.content_job import run_content
from shelfloom.plans.kept_counts import keep_counts
from shelfloom.session import intermediate
from shelfloom.sources.tables import KEYS, PARTS, Change, LostRace, Tables

# Tables whose rows go with their product.
CHILDREN = ("data_issues", "competitor_prices", "competitor_alerts", "latest_prices")


def _rewrite(change: Change, name: str, buckets: list, rows: Callable) -> None:
    if buckets:
        change.replace(name, rows(change.read(name, buckets)), buckets)


def _commit(change: Change) -> None:
    with intermediate(change.tables.spark):
        keep_counts(change)
        change.commit()


def _marked(change: Change, name: str, ids: DataFrame, key: str) -> list:
    """Buckets of the rows with the given ids.

    Ids that come with the column a table lies by name their buckets; otherwise the ids of the whole
    table are read.
    """
    if KEYS[name] in ids.columns:
        return change.buckets_of(name, ids)
    return change.buckets_of(name, change.read(name).join(ids.select(key), key, "left_semi"))


def resolve_stored(tables: Tables, ids: DataFrame, run_ts: datetime, name: str) -> None:
    """Resolve stored issues (issue_id, and product_id to read only its buckets); ``name`` tells this change from others."""
    change = tables.begin(f"resolve:{name}")
    if change is not None:
        _rewrite(change, "data_issues", _marked(change, "data_issues", ids, "issue_id"),
                 lambda rows: changes.resolve_issues(rows, ids, run_ts))
        _commit(change)


def acknowledge_stored(tables: Tables, ids: DataFrame, name: str) -> None:
    """Acknowledge stored alerts (alert_id, and product_id to read only its buckets)."""
    change = tables.begin(f"acknowledge:{name}")
    if change is not None:
        _rewrite(change, "competitor_alerts", _marked(change, "competitor_alerts", ids, "alert_id"),
                 lambda rows: changes.acknowledge_alerts(rows, ids))
        _commit(change)


def delete_stored(tables: Tables, doomed: DataFrame, name: str) -> None:
    """Delete stored products (product_id) with all that belongs to them, in one commit."""
    change = tables.begin(f"delete:{name}")
    if change is not None:
        buckets = _marked(change, "products", doomed, "product_id")
        _rewrite(change, "products", buckets, lambda rows: changes.delete_products(doomed, rows)[0])
        for child in CHILDREN:
            _rewrite(change, child, change.buckets_of(child, doomed),
                     lambda rows: changes.delete_products(doomed, rows)[0])
        _commit(change)


def generate_stored(tables: Tables, ids: DataFrame, generator: Callable, run_ts: datetime, name: str,
                    **options):
    """Run the content job for stored products and store texts and resolved issues in one commit.

    Returns the job's summary row, or None if it is stored already.
    """
    change = tables.begin(f"content:{name}", str(run_ts))
    if change is None:
        return None
    with intermediate(tables.spark):
        result = run_content(ids, change.read("products"), change.read("data_issues"), generator, run_ts, **options)
        done = result.results.filter("success")
        _rewrite(change, "products", _marked(change, "products", done, "product_id"),
                 lambda rows: store_content(rows, result.results, run_ts))
        _rewrite(change, "data_issues", change.buckets_of("data_issues", done),
                 lambda rows: resolve_content_issues(rows, result.results, run_ts))
        _commit(change)
        return result.summary.first()


def merge_parts(tables: Tables, most: int = PARTS) -> None:
    """Put the small parts of tables that are only added to into fewer, so that a commit's list of parts
    does not grow with the history. One commit for each table; another writer's commit goes first."""
    for name in tables.full_tables(most):
        change = tables.begin(f"merge-{name}:{tables.next_number()}", counted=True)
        change.merge(name, most)
        try:
            change.commit()
        except LostRace:
            return  # the next call finds the same parts
