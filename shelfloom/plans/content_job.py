"""The content job: generate for a batch of products and store the outcome."""

from dataclasses import dataclass
from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame

from shelfloom.operators.content import (
    batch_summary, generate, resolve_content_issues, store_content,
)
from shelfloom.session import settle


@dataclass
class ContentResult:
    results: DataFrame
    products: DataFrame
    issues: DataFrame
    summary: DataFrame


def run_content(ids: DataFrame, products: DataFrame, issues: DataFrame, generator: Callable,
                run_ts: datetime, tone: str = "professional", include_seo: bool = True,
                parallelism: int = None, ledger: str = None) -> ContentResult:
    """Outcome of a batch; ``ids`` must not be empty. ``ledger`` keeps replies beyond this job.

    The results are written out first, so that the generator is asked once and
    all outputs agree.
    """
    if ids.isEmpty():
        raise ValueError("At least one product_id is required.")
    results = settle(
        generate(ids, products, generator, tone, include_seo, parallelism, ledger), "content-results"
    )
    return ContentResult(
        results=results,
        products=store_content(products, results, run_ts),
        issues=resolve_content_issues(issues, results, run_ts),
        summary=batch_summary(results),
    )
