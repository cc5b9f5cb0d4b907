"""Small helpers that the text operators share."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows whose texts a task holds as Python objects at one time.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a text column, None for null."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``rows``, so few texts are unpacked at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def filtered(docs: DataFrame, text_col: str, keep: Callable) -> DataFrame:
    """The rows of ``docs`` that ``keep`` marks; it gets a batch's column of texts as Arrow.

    Columns travel under plain names, since theirs may hold dots.
    """
    place = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(place)), pa.bool_()))

    return plain.mapInArrow(lambda batches: kept(slices(batches)), plain.schema).toDF(*docs.columns)


def text_key(text: Column) -> Column:
    """64-bit hash of a text. Together with the id it names a document, so rows that
    repeat an id with another text stay apart."""
    return F.xxhash64(text)


def same_document(left: DataFrame, right: DataFrame, names: list) -> Column:
    """Null-safe equality of the named columns of two frames."""
    condition = None
    for name in names:
        equal = left[name].eqNullSafe(right[name])
        condition = equal if condition is None else condition & equal
    return condition


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def counted(marks: np.ndarray) -> tuple:
    """Starts and ends of the runs of True in ``marks``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return edges[::2], edges[1::2]
