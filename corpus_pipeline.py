"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame that is written as Parquet and read again as the next stage's ``docs``. All
but the last return the columns of ``documents``.

Defined results: every stage takes null ids, null texts, repeated rows, extra columns and empty
tables as its operator does; ``n_chars`` follows the text where a stage shortens it; a text
that loses all its lines stays as an empty text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.llm import decontaminate, line_dedup, near_copies, pieces, quality
from shelfloom.llm.queries import piece_model
from shelfloom.llm.texts import table
from shelfloom.session import settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share."""
    made = line_dedup.dedup_lines(docs)
    return made.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else made


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, pairs by SimHash fingerprints and
    their byte index, completed by shared rare shingles, Jaccard similarity of 0.8."""
    return near_copies.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold nothing of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and digests."""
    return pieces.token_digests(pieces.encode_documents(docs, piece_model()), piece_model())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("tokens", to_tokens),
]

# Hash fingerprints and piece merges are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
