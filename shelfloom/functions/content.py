"""Prompts for generated content and reading of the replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom.fixed_values import (
    ATTRIBUTE_LINE, DESCRIPTION_PROMPT, NO_ATTRIBUTES, NOT_SPECIFIED, ORIGINAL_LINE,
    SEO_NO_BRAND, SEO_NO_CATEGORY, SEO_PROMPT,
)
from shelfloom.functions.text import (
    fill, or_else, plain_number, strip, title_case,
)

FENCE = "```"


def description_prompt(title="title", sku="sku", category="category", brand="brand",
                       price="price", currency="currency", description="description",
                       attributes="attributes", tone: str = "professional") -> Column:
    lines = F.transform(
        F.map_entries(attributes),
        lambda e: fill(
            ATTRIBUTE_LINE,
            name=title_case(F.replace(e["key"], F.lit("_"), F.lit(" "))),
            value=F.coalesce(e["value"], F.lit("None")),
        ),
    )
    listed = F.coalesce(F.array_join(lines, ""), F.lit(""))
    price = F.col(price)
    return fill(
        DESCRIPTION_PROMPT,
        tone=tone,
        title=F.col(title),
        sku=F.col(sku),
        category=or_else(F.col(category), NOT_SPECIFIED),
        brand=or_else(F.col(brand), NOT_SPECIFIED),
        price=F.when(price != 0, plain_number(price)).otherwise(NOT_SPECIFIED),
        currency=F.col(currency),
        original=F.when(
            F.col(description) != "", fill(ORIGINAL_LINE, description=F.col(description))
        ).otherwise(""),
        attributes=or_else(listed, NO_ATTRIBUTES),
    )


def seo_prompt(description: Column, title="title", category="category", brand="brand") -> Column:
    return fill(
        SEO_PROMPT,
        title=F.col(title),
        category=or_else(F.col(category), SEO_NO_CATEGORY),
        brand=or_else(F.col(brand), SEO_NO_BRAND),
        description=description,
    )


def unfenced(reply: Column) -> Column:
    """The reply without a surrounding code fence; null for a one-line fence.

    A fenced reply loses its first line and everything from its last fence on.
    """
    text = strip(reply)
    body = F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1)
    inner = strip(F.regexp_replace(body, r"(?s)```(?!.*```).*$", ""))
    fenced = F.when(F.contains(text, F.lit("\n")), inner)
    return F.when(F.startswith(text, F.lit(FENCE)), fenced).otherwise(text)


def seo_reply(reply: Column) -> Column:
    """Struct (parsed, is_object, seo_title, seo_keywords, usable) of an SEO reply.

    ``parsed`` is false for text that is not JSON: both fields are then null. A
    missing key gives ''. ``usable`` is false for JSON that cannot be stored: no
    object, or a field that is neither text nor null.
    """
    text = unfenced(reply)
    # Read by columns, of a repeated key the last value counts and NaN is a number, both of which
    # the variant parser refuses; the variant tells other JSON from no JSON. The text is read as the
    # one element of a list, because what follows a whole object would be passed over otherwise.
    fields = ["seo_title", "seo_keywords"]
    listed = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")),
        f"array<struct<{', '.join(f'{name}: variant' for name in fields)}>>", {"allowSingleQuotes": "false"})
    read = F.get(listed, F.lit(0))
    opens = F.startswith(F.ltrim(text), F.lit("{"))
    is_object = F.coalesce(opens & (F.size(listed) == 1) & read.isNotNull(), F.lit(False))
    parsed = is_object | (~F.coalesce(opens, F.lit(False)) & F.try_parse_json(text).isNotNull())

    def field(name: str) -> Column:
        found = F.when(read[name].isNull(), "").otherwise(F.try_variant_get(read[name], "$", "string"))
        return F.when(is_object, found)

    def storable(name: str) -> Column:
        return read[name].isNull() | F.schema_of_variant(read[name]).isin("STRING", "VOID")

    usable = F.lit(True)
    for name in fields:
        usable = usable & storable(name)
    return F.struct(
        parsed.alias("parsed"),
        is_object.alias("is_object"),
        *[field(name).alias(name) for name in fields],
        (~parsed | (is_object & usable)).alias("usable"),
    )


def seo_keyword_list(keywords: Column) -> Column:
    """The single keywords of a comma-separated list, trimmed, blanks kept."""
    return F.transform(F.split(keywords, ","), strip)


def display_description(generated="generated_description", original="description") -> Column:
    return or_else(F.col(generated), F.col(original))
