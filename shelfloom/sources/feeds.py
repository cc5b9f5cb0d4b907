"""Supplier feeds as CSV, read by position so that any header works."""

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.session import settle
from shelfloom.sources.records import HEADER_PLACE, read_lines, records, split_steps

CSV_FILES = "*.[cC][sS][vV]"
OVERFLOW = "_overflow"
ORDER = "_order"
BYTE_ORDER_MARK = chr(0xFEFF)
CARRIAGE_RETURN = "\r"


def is_csv_name(filename: str) -> bool:
    """Whether a single file is a feed; of a folder, ``CSV_FILES`` takes the same files."""
    return filename.lower().endswith(".csv")


def header_names(cells: list) -> list:
    """Distinct column names from the cells of a header line.

    An empty cell becomes "Unnamed: <position>", a repeated name gets ".1", ".2"
    and so on.
    """
    names: list = []
    repeats: dict = {}
    for position, cell in enumerate(cells):
        name = cell or f"Unnamed: {position}"
        candidate = name
        while candidate in names:
            repeats[name] = repeats.get(name, 0) + 1
            candidate = f"{name}.{repeats[name]}"
        names.append(candidate)
    return names


def raw_columns(headers) -> list:
    return [f"c{position}" for position in range(len(headers))]


def line_names(line: str) -> list:
    """Column names in a header line."""
    return header_names(next(csv.reader([line.removeprefix(BYTE_ORDER_MARK)]), []))


def headers_of(files: DataFrame) -> dict:
    """Header line -> column names, for the different first lines of (file, line) by file name."""
    found = files.groupBy("line").agg(F.min("file").alias("file")).orderBy("file").collect()
    return {row["line"]: names_in(row["line"]) for row in found}


def names_in(first_line: str) -> list:
    return line_names(first_line.removesuffix(CARRIAGE_RETURN))


def all_names(found: dict) -> list:
    """Column names of a feed: those of its first file, then others that further files have.

    Empty for an empty feed.
    """
    return list(dict.fromkeys(name for names in found.values() for name in names))


@dataclass
class Feed:
    """A feed's lines, the first line of each file, and the column names that follow."""

    lines: DataFrame
    steps: DataFrame | list
    files: DataFrame
    found: dict

    @property
    def headers(self) -> list:
        return all_names(self.found)

    def rows(self) -> DataFrame:
        """The feed as text columns c0, c1, ... in the order of ``headers``, with the place of each line.

        Every file's cells go by its own header line, so files may order their columns differently.
        Names play no part in the schema, so headers equal up to case do not clash.
        """
        return with_columns_of(self.headers, self.found, self.files, parsed(self.lines, self.steps, self.files, self.found))


def feed_of(lines: DataFrame) -> Feed:
    """A feed from the lines of its files, in one pass over them; further passes are made by ``rows``."""
    steps = settle(split_steps(lines), "feed-splits")
    files = steps.filter("first_line IS NOT NULL").select("file", F.col("first_line").alias("line"))
    return Feed(lines, steps, files, headers_of(files))


def told_feed(lines: DataFrame) -> Feed:
    """A feed of so few files and splits that the driver may hold a row for each, as those of one trigger."""
    steps = split_steps(lines).collect()
    first_lines = {step["file"]: step["first_line"] for step in sorted(steps, key=lambda s: s["file"]) if step["first_line"] is not None}
    files = lines.sparkSession.createDataFrame(list(first_lines.items()), "file string, line string")
    return Feed(lines, steps, files, {line: names_in(line) for line in first_lines.values()})


def open_feed(spark: SparkSession, path) -> Feed:
    """The feed at ``path``; large files are split over tasks, also with line breaks inside quotes."""
    return feed_of(read_lines(spark, path, CSV_FILES))


def parsed(lines: DataFrame, steps, files: DataFrame, found: dict) -> DataFrame:
    """Records as cells c0, c1, ... as wide as the widest header, one overflow column, and their place."""
    widest = range(max(map(len, found.values()), default=0))
    body = records(lines, steps).filter(F.col("place") != HEADER_PLACE)
    # Carriage returns belong to the line ends of files whose first line ends in one.
    returns = {line.endswith(CARRIAGE_RETURN) for line in found}
    plain = F.regexp_replace(F.replace("record", F.lit(CARRIAGE_RETURN + "\n"), F.lit("\n")), CARRIAGE_RETURN + "$", "")
    if returns == {True}:
        body = body.withColumn("record", plain)
    elif True in returns:
        named = files.select("file", F.col("line").endswith(CARRIAGE_RETURN).alias("returns"))
        body = body.join(named, "file").withColumn("record", F.when(F.col("returns"), plain).otherwise(F.col("record")))
    cells = F.from_csv("record", feed_schema(widest).simpleString(), {"quote": '"', "escape": '"'}).alias("cells")
    place = F.struct(F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("place").alias("_line"))
    # Empty lines are passed over.
    return body.filter("record <> ''").select(cells, place.alias(ORDER)).select("cells.*", ORDER)


def with_columns_of(headers: list, found: dict, files: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells in the order of ``headers`` instead of that of each file's own header line."""
    if all(names == headers for names in found.values()):
        return rows
    widest = range(max(map(len, found.values()), default=0))
    names = rows.sparkSession.createDataFrame(list(found.items()), "line string, _names array<string>")
    named = files.join(names, "line").select("file", "_names")
    placed_rows = rows.join(named, F.col(f"{ORDER}._file") == F.col("file"))
    cells = F.array(*raw_columns(widest))
    beyond = F.filter(
        F.slice(cells, F.size("_names") + 1, F.lit(len(widest))), lambda cell: cell.isNotNull())
    return placed_rows.select(
        *[F.get(cells, F.array_position("_names", F.lit(name)).cast("int") - 1).alias(column)
          for name, column in zip(headers, raw_columns(headers))],
        F.coalesce(OVERFLOW, F.get(beyond, F.lit(0))).alias(OVERFLOW), ORDER,
    )


def feed_schema(headers) -> T.StructType:
    """All columns as text, plus one that only an overlong line fills."""
    return T.StructType(
        [T.StructField(name, T.StringType()) for name in [*raw_columns(headers), OVERFLOW]]
    )
