"""From a feed's text columns to clean catalog rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.fixed_values import DEFAULT_CURRENCY, HEADER_ALIASES
from shelfloom.functions.attributes import with_attributes
from shelfloom.functions.money import feed_price
from shelfloom.functions.text import (
    normalize_text, null_if_blank, null_if_na, strip,
)
from shelfloom.sources.feeds import ORDER, raw_columns


TEXT_FIELDS = ["title", "description", "category", "brand"]


def map_headers(headers: list) -> dict:
    """Standard field -> position of the column that fills it.

    Headers are compared in lower case without outer blanks. A field takes its
    most preferred spelling; of headers equal after that, the last one.
    """
    position = {header.lower().strip(): index for index, header in enumerate(headers)}
    found = {}
    for field, spellings in HEADER_ALIASES.items():
        present = [position[s] for s in spellings if s in position]
        if present:
            found[field] = present[0]
    return found


def feed_rows(rows: DataFrame, headers: list, *kept_for: str) -> DataFrame:
    """Missing-value texts as null, lines without any value dropped, also in the columns ``kept_for``."""
    columns = raw_columns(headers)
    others = [c for c in rows.columns if c not in columns]
    nulled = rows.select(*[null_if_na(F.col(c)).alias(c) for c in columns], *others)
    return nulled.dropna(how="all", subset=[*columns, *kept_for])


def _over_width(widths: dict) -> Column:
    reason = F
    for field, width in widths.items():
        reason = reason.when(
            F.length(field) > width, F.lit(f"{field} is longer than {width} characters")
        )
    return reason if widths else F.lit(None).cast("string")


def clean_rows(rows: DataFrame, headers: list, widths: dict = None) -> DataFrame:
    """Clean catalog rows from ``feed_rows``, one per line, in typed columns.

    Every text stays text, so numbers used as SKU or UPC keep leading zeros. A
    line without a SKU has a null one. Texts have no width here; for a target that
    has some, ``widths`` names them by field and ``reject_reason`` is set for
    longer rows.
    """
    position = map_headers(headers)
    columns = raw_columns(headers)
    mapped = {field: F.col(columns[index]) for field, index in position.items()}
    extras = [
        (header, F.col(columns[index]))
        for index, header in enumerate(headers) if index not in position.values()
    ]
    absent = F.lit(None).cast("string")

    named = F.struct(*[F.col(c).alias(h) for c, h in zip(columns, headers)])
    kept = [c for c in rows.columns if c not in columns]
    # Texts are normalized in one step and read in the next, so once per row.
    texts = with_attributes(rows, mapped, extras).select(
        *kept,
        "attributes",
        strip(mapped["sku"]).alias("sku"),
        *[normalize_text(mapped.get(f, absent)).alias(f) for f in TEXT_FIELDS],
        feed_price(mapped.get("price", absent)).alias("price"),
        strip(mapped.get("currency", absent)).alias("currency"),
        F.to_json(named, {"ignoreNullFields": "false"}).alias("raw_data"),
    )
    filled = texts.withColumns({
        **{f: null_if_blank(F.col(f)) for f in ("sku", *TEXT_FIELDS)},
        "currency": F.coalesce(
            F.upper(null_if_blank(F.col("currency"))), F.lit(DEFAULT_CURRENCY)),
    })
    return filled.withColumn("title", F.coalesce("title", "sku")).withColumn(
        "reject_reason", _over_width(widths or {})
    )


def is_storable() -> Column:
    """Lines that become catalog rows; those without a SKU are skipped silently."""
    return F.col("sku").isNotNull() & F.col("reject_reason").isNull()


def storable_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(is_storable()).drop("reject_reason")


def quarantine(cleaned: DataFrame) -> DataFrame:
    """Rows that cannot be stored, with the reason."""
    return cleaned.filter(F.col("sku").isNotNull() & F.col("reject_reason").isNotNull())


def lines_of_skus(feed: DataFrame) -> DataFrame:
    """(sku, position of its last line, currency of its first, lines) of every SKU."""
    return feed.groupBy("sku").agg(
        F.max(ORDER).alias("_last"),
        F.min(F.struct(ORDER, "currency")).alias("_first"),
        F.count(F.lit(1)).alias("lines"),
    ).select("sku", F.col("_last").alias(ORDER), F.col("_first.currency").alias("currency"), "lines")


def last_per_sku(feed: DataFrame, picked: DataFrame = None) -> DataFrame:
    """One row per SKU: the values of its last line, the currency of its first.

    ``lines`` counts the SKU's lines; ``picked`` are the feed's ``lines_of_skus``, if they are known. The last positions are picked from SKU,
    position and currency alone, combined before the shuffle. Their lines are then
    found by position, which no two lines share, so a SKU that fills a third of a
    feed brings no task more rows than another.
    """
    fields = [c for c in feed.columns if c not in ("sku", "currency", ORDER)]
    picked = (lines_of_skus(feed) if picked is None else picked).drop("sku")
    return feed.drop("currency").join(picked, ORDER).select("sku", *fields, "currency", "lines")
