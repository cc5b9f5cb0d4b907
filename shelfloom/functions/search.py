"""Marketplace search queries and addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom.fixed_values import DEFAULT_SEARCH_SOURCE, SEARCH_URLS
from shelfloom.functions.text import lookup, strip


def search_query(brand: Column, title: Column) -> Column:
    """The title, with the brand in front unless it already starts with it."""
    brand = strip(F.coalesce(brand, F.lit("")))
    title = strip(F.coalesce(title, F.lit("")))
    has_brand = (brand == "") | F.startswith(F.lower(title), F.lower(brand))
    return F.when(has_brand, title).otherwise(strip(F.concat_ws(" ", brand, title)))


def search_url(query: Column, source: Column) -> Column:
    start = lookup(SEARCH_URLS, F.lower(source), F.lit(SEARCH_URLS[DEFAULT_SEARCH_SOURCE]))
    return F.concat(start, F.replace(query, F.lit(" "), F.lit("+")))
