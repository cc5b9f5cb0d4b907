"""Text expressions with Unicode-aware whitespace, built from Spark functions."""

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom.fixed_values import BLANK_WORDS, NA_TOKENS

# Whitespace in the Unicode sense, plus the four separators \x1c-\x1f that
# Java's Unicode class leaves out. Plain \s would be ASCII only.
_SPACE = r"\s\x1c-\x1f"
_SPACES = rf"(?U)[{_SPACE}]+"
_EDGES = rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$"
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
_WORD = rf"(?U)[^{_SPACE}]+"
_SENTENCE = rf"(?U)[^.!?{_SPACE}][^.!?]*"


def null_if_na(value: Column) -> Column:
    """Null where the whole field is one of the missing-value tokens."""
    return F.when(~value.isin(NA_TOKENS), value)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, _EDGES, "")


def normalize_text(value: Column) -> Column:
    """Trimmed, whitespace runs collapsed to one space, null as ''."""
    return F.coalesce(F.trim(F.regexp_replace(value, _SPACES, " ")), F.lit(""))


def null_if_blank(value: Column) -> Column:
    """Null for '', 'nan' and 'none' in any case."""
    return F.when((value != "") & ~F.lower(value).isin(BLANK_WORDS), value)


def is_filled(value: Column) -> Column:
    """True for a non-empty text; never null."""
    return F.coalesce(value != "", F.lit(False))


def or_else(value: Column, fallback) -> Column:
    """The value unless it is null or empty."""
    return F.when(value != "", value).otherwise(fallback)


def title_case(value: Column) -> Column:
    """Upper-case the first letter of every run of cased letters, lower-case the rest.

    A run ends at anything that has no case, so "die-cast" gives "Die-Cast", "levi's"
    gives "Levi'S" and a caseless letter starts a new run behind it; Spark's initcap only
    starts words at spaces.
    """
    runs = F.regexp_extract_all(value, F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"), 1)
    by_runs = F.array_join(F.transform(runs, F.initcap), "")
    # Most values hold only cased letters and spaces, for which initcap alone does the same.
    return F.when(F.rlike(value, F.lit(f"[^{_CASED} ]")), by_runs).otherwise(F.initcap(value))


def word_count(value: Column) -> Column:
    return F.regexp_count(value, F.lit(_WORD))


def sentence_count(value: Column) -> Column:
    """Pieces between . ! ? that hold more than whitespace.

    Each such piece matches once, from its first visible character to its end.
    """
    return F.regexp_count(value, F.lit(_SENTENCE))


def spaced_words(value: Column) -> Column:
    """Lower-cased runs of letters and digits with one space between, before and behind them."""
    runs = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(runs), F.lit(" "))


def first_word(value: Column) -> Column:
    return F.regexp_extract(value, f"({_WORD})", 1)


def fixed_decimals(value: Column, places: int) -> Column:
    """Half-even on the exact binary value, no thousands separators.

    format_string rounds the decimal spelling instead (0.125 -> 0.13).
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def plain_number(value: Column) -> Column:
    """Shortest spelling of a double with at least one decimal, no exponent."""
    return F.call_function("format_number", value, F.lit("0.0" + "#" * 16))


def fill(template: str, **values) -> Column:
    """Fill a {named} template with columns (or plain values) by concat."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            value = values[name]
            parts.append(value if isinstance(value, Column) else F.lit(value))
    return F.concat(*parts)


def kept_in_order(choices: list, kind: str = "array<string>") -> Column:
    """Array of the values whose test holds, from (test, value) pairs.

    Unlike array_compact this stays within generated code.
    """
    none = F.array().cast(kind)
    return F.concat(*[F.when(test, F.array(value)).otherwise(none) for test, value in choices])


def lookup(table: dict, key: Column, default: Column) -> Column:
    """Value from a small literal dictionary, else the default."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[key], default)
