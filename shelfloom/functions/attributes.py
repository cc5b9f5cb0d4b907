"""Attribute value normalization and the attribute map of a feed row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.fixed_values import (
    ATTRIBUTE_FIELDS, BLANK_ATTRIBUTE_WORDS, COLOR_KEYS, COLORS, MATERIAL_KEYS,
    MATERIALS, SIZE_KEYS, SIZES,
)
from shelfloom.functions.text import (
    lookup, normalize_text, null_if_blank, strip, title_case,
)

EMPTY_MAP = "map<string,string>"


def _standard(name: str, text: Column) -> Column:
    """Standard spelling of a normalized, lower-case value."""
    if name in SIZE_KEYS:
        return lookup(SIZES, text, F.upper(text))
    if name in COLOR_KEYS:
        return lookup(COLORS, text, title_case(text))
    if name in MATERIAL_KEYS:
        return lookup(MATERIALS, text, title_case(text))
    return title_case(text)


def normalize_attribute(key: str, value: Column) -> Column:
    """Standard spelling of one attribute value; '' for a missing value."""
    return _standard(key.lower(), F.lower(normalize_text(value)))


def normalize_with_dictionary(values: DataFrame, dictionary: DataFrame, variant: str,
                              canonical: str, out: str) -> DataFrame:
    """Replace a column's values through a user's own (large) dictionary table.

    ``dictionary`` has one row per lower-case ``variant``. Spark broadcasts it
    when it is under spark.sql.autoBroadcastJoinThreshold and shuffles otherwise.
    """
    text = F.lower(normalize_text(F.col(out)))
    keyed = dictionary.select(
        F.col(variant).alias("_variant"), F.col(canonical).alias("_canonical")
    )
    joined = values.withColumn("_text", text).join(
        keyed, F.col("_text") == F.col("_variant"), "left"
    )
    return joined.withColumn(
        out, F.coalesce("_canonical", title_case(F.col("_text")))
    ).drop("_text", "_variant", "_canonical")


def with_attributes(df: DataFrame, mapped: dict, extras: list, out: str = "attributes") -> DataFrame:
    """Add the attribute map of a feed row.

    ``mapped`` holds the columns found for standard fields; ``extras`` is a list
    of (header, column) for all columns no standard field took. Extra columns
    keep their raw text and win over a standard attribute of the same name.

    The steps are columns of their own, so that each text is cleaned once
    although several rules read it.
    """
    fields = [f for f in ATTRIBUTE_FIELDS if f in mapped]
    names = {field: f"_attribute_{field}" for field in fields}
    extra_names = [f"_extra_{position}" for position in range(len(extras))]
    texts = df.select(
        "*",
        *[normalize_text(mapped[f]).alias(names[f]) for f in fields],
        *[strip(column).alias(name) for (_, column), name in zip(extras, extra_names)],
    )
    lowered = texts.withColumns({names[f]: F.lower(names[f]) for f in fields})
    values = lowered.withColumns({
        **{
            names[f]: F.when(
                ~F.col(names[f]).isin(BLANK_ATTRIBUTE_WORDS), _standard(f, F.col(names[f])))
            for f in fields
        },
        **{name: null_if_blank(F.col(name)) for name in extra_names},
    })
    candidates: dict = {}
    for field in fields:
        candidates.setdefault(field, []).append(F.col(names[field]))
    for (header, _), name in zip(extras, extra_names):
        candidates.setdefault(header.lower().replace(" ", "_"), []).append(F.col(name))
    pairs = []
    for key, options in candidates.items():
        pairs += [F.lit(key), F.coalesce(*reversed(options))]
    filled = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
    attributes = (filled if pairs else F.create_map()).cast(EMPTY_MAP)
    return values.withColumn(out, attributes).drop(*names.values(), *extra_names)
