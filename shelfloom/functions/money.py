"""Price reading, currency conversion and price comparison."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom.fixed_values import INR_PER_USD
from shelfloom.functions.text import strip

# A plain decimal number, as digits with optional single underscores between.
_DIGITS = r"\d+(_\d+)*"
_NUMBER = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"


def feed_price(raw: Column) -> Column:
    """A feed's price text as double: commas and dollar signs dropped.

    Anything else around the number makes it null. The pattern check comes
    first because Spark's cast also takes spellings such as "12d".
    """
    text = strip(F.translate(raw, ",$", ""))
    number = F.translate(text, "_", "").try_cast("double")
    return F.when(text.rlike(_NUMBER), number)


def extract_price(text: Column) -> Column:
    """First run of digits, commas and dots in a text, read as a number."""
    run = F.regexp_extract(text, r"(\d[\d,.]*)", 1)
    digits = F.translate(F.regexp_replace(run, r"\.+$", ""), ",", "")
    return F.when(digits != "", digits.try_cast("double"))


def in_our_currency(price: Column, currency: Column, our_currency: Column,
                    rate: float = INR_PER_USD) -> Column:
    """Convert between USD and INR; any other pair is left as it is."""
    return (
        F.when((currency == "INR") & (our_currency == "USD"), price / F.lit(rate))
        .when((currency == "USD") & (our_currency == "INR"), price * F.lit(rate))
        .otherwise(price)
    )


def undercut_percent(ours: Column, theirs: Column) -> Column:
    """How far below our price theirs lies; null where ours is 0."""
    return F.when(ours != 0, ((ours - theirs) / ours) * 100)


def change_percent(current: Column, previous: Column) -> Column:
    """Size of the change since the previous price; null where that was 0."""
    return F.when(previous != 0, F.abs((current - previous) / previous) * 100)
