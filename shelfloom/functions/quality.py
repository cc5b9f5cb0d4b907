"""Description scoring, contradictions and quality issues.

Each function adds columns in a few select steps, so that a lower-cased text or
a count is computed once per row and then read by several rules.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.fixed_values import (
    BRAND_FOUND_TEXT, COLOR_FOUND_TEXT, CONTRADICTION_COLOR_KEYS, FEW_SENTENCES,
    GENERIC_FOUND_TEXT, GENERIC_PENALTY, GENERIC_PHRASES, KNOWN_COLORS,
    NO_DESCRIPTION, SCORE_LABELS, SHORT, TOO_LONG, VERY_THIN,
)
from shelfloom.functions.text import (
    fill, first_word, is_filled, kept_in_order, sentence_count, spaced_words, word_count,
)

CONTRADICTION_TYPE = (
    "array<struct<field:string,source:string,expected:string,actual:string>>"
)


def _mentions(text: Column, phrases: list, template: str = "{phrase}", within: str = "{phrase}") -> Column:
    """The phrases that occur in the text, in list order, put into a template.

    ``within`` is what has to occur for a phrase.
    """
    return kept_in_order([
        (F.contains(text, F.lit(within.format(phrase=p))), F.lit(template.format(phrase=p))) for p in phrases
    ])


def with_content_score(df: DataFrame, description: str = "description",
                       out: str = "content") -> DataFrame:
    """Add struct ``out`` (score, label, word_count, sentence_count, issues)."""
    text = F.col(description)
    counted = df.select(
        "*",
        is_filled(text).alias("_filled"),
        word_count(text).alias("_words"),
        sentence_count(text).alias("_sentences"),
        F.lower(text).alias("_lower"),
    ).withColumn("_generic", _mentions(F.col("_lower"), GENERIC_PHRASES, GENERIC_FOUND_TEXT))

    words = F.col("_words")
    # The three bounds exclude each other.
    length_rules = [
        (words < VERY_THIN[0], VERY_THIN),
        ((words >= VERY_THIN[0]) & (words < SHORT[0]), SHORT),
        (words > TOO_LONG[0], TOO_LONG),
    ]
    length_penalty = F
    for test, (_, penalty, _) in length_rules:
        length_penalty = length_penalty.when(test, F.lit(penalty))
    few = F.col("_sentences") < FEW_SENTENCES[0]
    raw_score = (
        F.lit(100)
        - length_penalty.otherwise(0)
        - F.when(few, FEW_SENTENCES[1]).otherwise(0)
        - F.size("_generic") * GENERIC_PENALTY
    )
    scored = counted.withColumn("_score", F.greatest(F.lit(0), F.least(F.lit(100), raw_score)))

    label = F
    for name, lowest in SCORE_LABELS.items():
        label = label.when(F.col("_score") >= lowest, F.lit(name))
    messages = F.concat(
        kept_in_order([
            *[(test, F.lit(message)) for test, (_, _, message) in length_rules],
            (few, F.lit(FEW_SENTENCES[2])),
        ]),
        "_generic",
    )
    score = F.struct(
        F.col("_score").cast("int").alias("score"),
        label.alias("label"),
        words.cast("int").alias("word_count"),
        F.col("_sentences").cast("int").alias("sentence_count"),
        messages.alias("issues"),
    )
    missing = F.struct(
        F.lit(0).alias("score"),
        F.lit("Missing").alias("label"),
        F.lit(0).alias("word_count"),
        F.lit(None).cast("int").alias("sentence_count"),
        F.array(F.lit(NO_DESCRIPTION)).alias("issues"),
    )
    return scored.withColumn(out, F.when(F.col("_filled"), score).otherwise(missing)).drop(
        "_filled", "_words", "_sentences", "_lower", "_generic", "_score"
    )


def _color_mention(key: Column, value: Column, source: str, word_boundary: bool):
    """(test, contradiction) for the first known color in a text that the value is not."""
    text = F.col(f"_{source}_lower")
    said = F.contains(F.col(f"_{source}_words"), spaced_words(value)) if word_boundary else F.contains(text, F.lower(value))
    other = F.get(F.array_remove(F.col(f"_{source}_colors"), F.lower(value)), F.lit(0))
    hit = F.struct(
        key.alias("field"),
        F.lit(source).alias("source"),
        value.alias("expected"),
        fill(COLOR_FOUND_TEXT, color=other, source=source).alias("actual"),
    )
    return (text != "") & ~said & other.isNotNull(), hit


def _brand_mention(key: Column, value: Column):
    title = F.col("_title_lower")
    word = first_word(title)
    hit = F.struct(
        key.alias("field"),
        F.lit("title").alias("source"),
        value.alias("expected"),
        fill(BRAND_FOUND_TEXT, word=word).alias("actual"),
    )
    unsaid = (title != "") & ~F.contains(title, F.lower(value))
    return unsaid & (word != F.lower(value)) & (F.length(word) > 2), hit


def with_contradictions(df: DataFrame, title: str = "title", description: str = "description",
                        attributes: str = "attributes", out: str = "contradictions",
                        word_boundary: bool = False) -> DataFrame:
    """Add array ``out`` of (field, source, expected, actual).

    A color attribute contradicts a text that does not contain it but does
    contain another known color; matching is by substring, so that "standard" names tan,
    or with ``word_boundary`` by whole words. A brand attribute contradicts a title that
    starts with some other word. For dictionaries of any size see ``dictionary_contradictions``.
    """
    lowered = df.select(
        "*",
        F.lower(F.coalesce(F.col(title), F.lit(""))).alias("_title_lower"),
        F.lower(F.coalesce(F.col(description), F.lit(""))).alias("_description_lower"),
    )
    texts, within = ["_title_lower", "_description_lower"], "{phrase}"
    if word_boundary:
        lowered = lowered.select("*", spaced_words(F.col("_title_lower")).alias("_title_words"),
                                 spaced_words(F.col("_description_lower")).alias("_description_words"))
        texts, within = ["_title_words", "_description_words"], " {phrase} "
    seen = lowered.select(
        "*",
        _mentions(F.col(texts[0]), KNOWN_COLORS, within=within).alias("_title_colors"),
        _mentions(F.col(texts[1]), KNOWN_COLORS, within=within).alias("_description_colors"),
    )

    none = F.array().cast(CONTRADICTION_TYPE)

    def check(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        colors = [_color_mention(key, value, source, word_boundary) for source in ("title", "description")]
        brand = [_brand_mention(key, value)]
        is_color, is_brand = F.lower(key).isin(CONTRADICTION_COLOR_KEYS), F.lower(key) == "brand"
        return (
            F.when(~is_filled(value), none)
            .when(is_color, kept_in_order(colors, CONTRADICTION_TYPE))
            .when(is_brand, kept_in_order(brand, CONTRADICTION_TYPE))
            .otherwise(none)
        )

    found = F.coalesce(F.flatten(F.transform(F.map_entries(attributes), check)), none)
    return seen.withColumn(out, found).drop(
        "_title_lower", "_description_lower", "_title_colors", "_description_colors", "_title_words", "_description_words"
    )
