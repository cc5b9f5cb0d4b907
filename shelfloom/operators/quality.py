"""Quality issues of catalog rows, as an array per row and as issue rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.fixed_values import (
    COLOR_FOUND_TEXT, CONTRADICTION_TEXT, MISSING_ATTRIBUTES_FROM, MISSING_ATTRIBUTES_TEXT,
    MISSING_DESCRIPTION_TEXT, REQUIRED_ATTRIBUTES, THIN_CONTENT_TEXT, THIN_SCORE,
)
from shelfloom.functions.quality import with_content_score, with_contradictions
from shelfloom.functions.text import fill, is_filled, kept_in_order, spaced_words
from shelfloom.session import settle

ISSUE_FIELDS = [
    "issue_type", "severity", "description", "field_name", "expected_value", "actual_value",
]
ISSUE_TYPE = f"array<struct<{','.join(f'{name}:string' for name in ISSUE_FIELDS)}>>"


def _issue(issue_type, severity, description, field_name=None, expected=None, actual=None) -> Column:
    def text(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    values = [issue_type, severity, description, field_name, expected, actual]
    return F.struct(*[text(v).alias(name) for v, name in zip(values, ISSUE_FIELDS)])


def missing_attributes(attributes: Column) -> Column:
    """Which of the required attributes the map lacks, in fixed order."""
    return kept_in_order([
        (~F.map_contains_key(attributes, name), F.lit(name)) for name in REQUIRED_ATTRIBUTES
    ])


def with_issues(products: DataFrame, thin_score: int = THIN_SCORE, out: str = "issues") -> DataFrame:
    """Add the array of a row's issues, in the order of the four checks.

    Reads sku, title, description and attributes. All checks run in one pass
    over the rows, without a shuffle or a union.
    """
    empty_map = F.create_map().cast("map<string,string>")
    checked = with_contradictions(
        with_content_score(products, out="_content"), out="_contradictions"
    ).withColumn("_missing", missing_attributes(F.coalesce("attributes", empty_map)))

    sku, content = F.col("sku"), F.col("_content")
    described = is_filled(F.col("description"))
    missing = _issue(
        "missing_description", "high", fill(MISSING_DESCRIPTION_TEXT, sku=sku), "description"
    )
    thin = _issue(
        "thin_content", "medium",
        fill(
            THIN_CONTENT_TEXT, sku=sku,
            score=content["score"].cast("string"),
            words=content["word_count"].cast("string"),
            issues=F.array_join(content["issues"], ", "),
        ),
        "description",
        actual=F.concat(content["word_count"].cast("string"), F.lit(" words")),
    )
    contradicted = F.transform("_contradictions", lambda c: _issue(
        "attribute_contradiction", "high",
        fill(CONTRADICTION_TEXT, field=c["field"], expected=c["expected"], actual=c["actual"]),
        c["field"], c["expected"], c["actual"],
    ))
    names = F.array_join("_missing", ", ")
    lacking = _issue(
        "missing_attributes", "low", fill(MISSING_ATTRIBUTES_TEXT, sku=sku, missing=names), names
    )
    issues = F.concat(
        kept_in_order(
            [(~described, missing), (described & (content["score"] < thin_score), thin)], ISSUE_TYPE),
        contradicted,
        kept_in_order([(F.size("_missing") >= MISSING_ATTRIBUTES_FROM, lacking)], ISSUE_TYPE),
    )
    return checked.withColumn(out, issues).drop("_content", "_contradictions", "_missing")


def issue_rows(checked: DataFrame, keys: list, issues: str = "issues") -> DataFrame:
    """One row per issue: the key columns, ``position`` in its row, the fields.

    The outer form with a filter behind it, because for the plain one the
    optimizer puts a filter on the array's size below all the steps that build
    the array, which computes every check twice.
    """
    exploded = checked.select(*keys, F.posexplode_outer(issues).alias("position", "_issue"))
    return exploded.filter(F.col("_issue").isNotNull()).select(
        *keys, "position", *[F.col(f"_issue.{f}").alias(f) for f in ISSUE_FIELDS]
    )


def status_from_issues(issues: Column) -> Column:
    """A row with any issue is flagged, any other active."""
    return F.when(F.size(issues) > 0, "flagged").otherwise("active")


def data_issues(checked: DataFrame, run_ts, job_id=0, order: str = "_order") -> DataFrame:
    """Rows for the append-only issue table; ``checked`` has product_id and issues.

    Ids are hashes of job, product, feed position and place in the row, so a
    recomputed task gives the same ids.
    """
    keys = ["product_id"] + ([order] if order in checked.columns else [])
    rows = issue_rows(checked, keys)
    stamp = F.lit(run_ts).cast("timestamp")
    return rows.select(
        F.xxhash64(F.lit(job_id), *keys, "position").alias("issue_id"),
        "product_id",
        *ISSUE_FIELDS,
        F.lit(False).alias("resolved"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        stamp.alias("created_at"),
    )


def word_grams(words: Column, longest: int) -> Column:
    """The different runs of one to ``longest`` words of an array of words, as texts."""
    def runs(n: int) -> Column:
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, longest + 1)]))


def dictionary_contradictions(rows: DataFrame, dictionary: DataFrame, field: str, id_col: str = "product_id",
                              value_col: str = "value", texts: tuple = ("title", "description"),
                              word: str = "word", rank: str = "rank") -> DataFrame:
    """(id, field, source, expected, actual): texts that name another value of a dictionary than the row's own.

    The rule is that of ``with_contradictions`` by whole words, for a user's dictionary table of
    (``word``, ``rank``) of any size: a text that does not say the row's value, but says words of the
    dictionary, contradicts it by the one of lowest rank. Texts are cut into runs of as many words as
    the dictionary's longest entry has, and met with it by one join, which broadcasts a small dictionary and
    shuffles a large one; nothing grows with the number of its values but that join.
    """
    said = F.trim(spaced_words(F.col(word)))
    known = settle(dictionary.select(said.alias("gram"), F.col(rank).alias("rank")).filter("gram <> ''")
                   .groupBy("gram").agg(F.min("rank").alias("rank")), "dictionary")
    longest = known.agg(F.max(F.size(F.split("gram", " ")))).first()[0]
    if not longest:
        longest = 1
    sources = F.explode(F.array(*[F.struct(F.lit(t).alias("source"), spaced_words(F.col(t)).alias("said")) for t in texts]))
    own = F.trim(spaced_words(F.col(value_col)))
    spoken = rows.filter(is_filled(F.col(value_col))).select(
        F.col(id_col), F.col(value_col).alias("expected"), own.alias("own"), sources.alias("text")).select("*", "text.*")
    silent = spoken.filter(F.col("said").isNotNull() & ~F.contains("said", F.concat(F.lit(" "), F.col("own"), F.lit(" "))))
    grams = silent.select(id_col, "expected", "source", F.explode(
        word_grams(F.split(F.trim("said"), " "), longest)).alias("gram")).filter("gram <> ''")
    met = grams.join(known, "gram").groupBy(id_col, "expected", "source").agg(
        F.min(F.struct("rank", "gram")).alias("first"))
    return met.select(
        id_col, F.lit(field).alias("field"), "source", "expected",
        fill(COLOR_FOUND_TEXT, color=F.col("first.gram"), source=F.col("source")).alias("actual"))
