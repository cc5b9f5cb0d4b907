"""The registered queries of the text operators, and SQL where it can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfloom.llm import (
    bbit_minhash, chat, decontaminate, hard_negatives, language, line_dedup, line_frequency, pieces,
    quality, simhash, spelling, suffix_dedup, warc,
)
from shelfloom.llm.texts import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query
    return keep


def piece_model() -> str:
    """Place of the public merge-type model."""
    return public_tokenizers.path("piece_bpe_32k.model")


@register("op1_warc_chunks", warc.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@register("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model())
    return pieces.token_digests(encoded, piece_model()).drop("ids")


@register("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark the documents hold."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return language.identify(table(spark, sf_dir, "documents"))


@register("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and their groups."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op6_chat_formatting", chat.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, and read back from their formatted text."""
    conversations = chat.with_control_strings(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(conversations))


@register("op7_line_dedup", line_dedup.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@register("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings that also start in an earlier document are cut."""
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


@register("op9_quality_ranking")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, ranked by labelled pairs."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_line_frequency_rules", line_frequency.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, and documents depleted by lines that their host repeats."""
    return line_frequency.line_quality(table(spark, sf_dir, "documents"))


@register("op11_hard_negatives", hard_negatives.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as an anchor's positives do."""
    rows = hard_negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives.hard_negatives(hard_negatives.prepared(rows))


@register("op12_spelling_variants", spelling.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, and the commoner words that they misspell."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@register("op13_bbit_minhash", bbit_minhash.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that share four fifths of their four-word shingles."""
    return bbit_minhash.minhash_duplicates(table(spark, sf_dir, "documents"))
