"""Quality rules: base counts of a text, and lines that repeat across a host's documents.

Base counts look at one document; they fail texts of too few words or with too many
words in repeated five-word windows. The method's own verdict counts, for every host,
in how many documents a normalised line occurs. A line in more than ``max_docs``
documents of a host is removed, and a document that keeps less than ``min_left`` of
its words is rejected as depleted.

A document is an (id, text), so copies of a text under other ids count each. ``count_copies=False``
counts different texts instead, for tables whose copies are still to be removed.

Each text is read once: a row of counts and the hashes of its lines with their words
is written, and everything else runs on that. A line that most documents of a host
share is counted in two steps that combine before the shuffle; only the lines over
the limit are joined back, as an ordinary join that splits a heavy key.

Defined results: a null, empty or white-space text has no words, fails the base rules
and is not kept; a null host is a host of its own; rows that repeat a document are one
document and get equal results each; a null id is an id like others; extra columns are
ignored; an empty table gives an empty result. Ties at a limit pass: only counts above
``max_docs`` remove, only shares below ``min_left`` reject.
"""

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, id_type, same_document, slices, text_key
from shelfloom.session import settle

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

# The method's limits: documents of one host that may share a line, and the share of
# its words that a document has to keep: with less than half of them it is mostly boilerplate.
MAX_DOCS = 20
MIN_LEFT = 0.5

_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_DIGITS = bytes.maketrans(b"0123456789", b"0000000000")


def repeated_words(words: list, window: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = (mixed ^ ids[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    # Equal hashes are compared word by word, so that a collision counts for nothing.
    hit = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    values = [tuple(ids[i:i + window].tolist()) for i in hit.tolist()]
    times = Counter(values)
    inside = np.zeros(len(words) + 1, np.int64)
    for place, value in zip(hit.tolist(), values, strict=True):
        if times[value] > 1:
            inside[place] += 1
            inside[place + window] -= 1
    return int((np.cumsum(inside) > 0).sum())


def base_counts(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = text.split()
    if not words:
        return 0, 0, len(text.translate(None, _NOT_SYMBOLS)), 0, 0
    chars = b"".join(words)
    word_chars = len(chars) if chars.isascii() else len(chars.decode("utf-8", "replace"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), word_chars, len(text.translate(None, _NOT_SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def normal_line(line: bytes) -> bytes:
    """A line's words with single spaces, A-Z lower-cased, digits alike."""
    return b" ".join(line.lower().translate(_DIGITS).split())


def line_words(text: bytes) -> tuple:
    """(packed hashes, packed word counts) of a text's different normalised lines."""
    lines = {}
    for line in text.split(b"\n"):
        normal = normal_line(line)
        if normal:
            key = xxhash.xxh64_intdigest(normal)
            lines[key] = lines.get(key, 0) + normal.count(b" ") + 1
    return list(lines), list(lines.values())


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per row of ``docs``: base counts, and its lines' hashes and words."""
    kinds = id_type(docs, id_col), id_type(docs, host_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in as_bytes(batch.column(3))]
            counts = list(zip(*map(base_counts, texts), strict=True)) or [()] * 5
            lines = [line_words(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([np.array(h, np.uint64).view(np.int64) for h, _ in lines], pa.list_(pa.int64())),
                 pa.array([w for _, w in lines], pa.list_(pa.int32()))],
                ["doc", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "lines", "words"],
            )

    narrow = docs.select(F.col(id_col), F.col(host_col), text_key(F.col(text_col)), F.col(text_col)).toDF(
        "doc", "host", "text_hash", "text")
    return narrow.mapInArrow(
        measure, f"doc {kinds[0]}, host {kinds[1]}, text_hash bigint, n_words bigint, word_chars bigint, "
        "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, words array<int>")


def frequent_lines(rows: DataFrame, max_docs: int, count_copies: bool = True) -> DataFrame:
    """(host, line) of the lines in more than ``max_docs`` different documents of a host."""
    document = F.struct("doc", "text_hash") if count_copies else F.col("text_hash")
    lines = rows.select("host", document.alias("document"), F.explode("lines").alias("line"))
    return (
        lines.groupBy("host", "line").agg(F.count_distinct("document").alias("docs"))
        .filter(F.col("docs") > max_docs).select("host", "line")
    )


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, count_copies: bool = True) -> DataFrame:
    """Base counts and verdicts of every row, and the words it loses to frequent lines."""
    rows = settle(measured(docs, id_col, text_col, host_col), "line-counts")
    frequent = settle(frequent_lines(rows, max_docs, count_copies), "frequent-lines")
    spread = rows.select("doc", "host", "text_hash", F.explode(F.arrays_zip("lines", "words")).alias("part")).select(
        "doc", "host", "text_hash", F.col("part.lines").alias("line"), F.col("part.words").alias("words"))
    met = spread.join(
        frequent, (spread["line"] == frequent["line"]) & spread["host"].eqNullSafe(frequent["host"]), "left_semi")
    # Repeated rows of a document bring its lines again; each line counts once.
    lost = (
        met.groupBy("doc", "host", "text_hash", "line").agg(F.max("words").alias("words"))
        .groupBy("doc", "host", "text_hash").agg(F.sum("words").alias("n_removed_words"))
    )
    counts = rows.drop("lines", "words")
    joined = counts.join(lost, same_document(counts, lost, ["doc", "host", "text_hash"]), "left").select(
        *[counts[c] for c in counts.columns], F.coalesce(lost["n_removed_words"], F.lit(0)).alias("n_removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < min_left * F.col("n_words")
    return joined.select(
        F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words")


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                           max_docs: int = MAX_DOCS, count_copies: bool = True) -> DataFrame:
    """(doc_id, text): every text without the lines that its host repeats over the limit."""
    rows = settle(measured(docs, id_col, text_col, host_col), "line-counts")
    frequent = settle(frequent_lines(rows, max_docs, count_copies), "frequent-lines")
    spread = rows.select("doc", "host", "text_hash", F.explode("lines").alias("line"))
    met = spread.join(
        frequent, (spread["line"] == frequent["line"]) & spread["host"].eqNullSafe(frequent["host"]), "left_semi")
    gone = met.groupBy("doc", "host", "text_hash").agg(F.collect_set("line").alias("gone"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, lines in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if text is not None and lines:
                    drop = {struct.unpack("<Q", struct.pack("<q", x))[0] for x in lines}
                    text = b"\n".join(
                        x for x in text.split(b"\n") if xxhash.xxh64_intdigest(normal_line(x)) not in drop)
                texts.append(None if text is None else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    named = docs.select(F.col(id_col), F.col(host_col), text_key(F.col(text_col)), F.col(text_col)).toDF(
        "doc", "host", "text_hash", "text")
    joined = named.join(gone, same_document(named, gone, ["doc", "host", "text_hash"]), "left").select(
        named["doc"], named["text"], gone["gone"])
    return joined.mapInArrow(reduce, f"doc_id {id_type(docs, id_col)}, text string")


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), spot AS (
  SELECT doc_id, place, list_slice(words, place, place + 4) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS place FROM doc WHERE len(words) >= 5)
), again AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM spot
  ) WHERE times > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT word_at) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(place, place + 5)) AS word_at FROM again) GROUP BY doc_id
), counts AS (
  SELECT doc.doc_id, source, body, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM doc LEFT JOIN repeated ON doc.doc_id = repeated.doc_id
), line AS (
  SELECT doc_id, source,
         array_to_string(list_filter(string_split_regex(
           regexp_replace(translate(text_line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS normal
  FROM (SELECT doc_id, source, body, unnest(lines) AS text_line FROM doc)
), frequent AS (
  SELECT source, normal FROM line WHERE normal <> ''
  GROUP BY source, normal HAVING count(DISTINCT doc_id) > {max_docs}
), lost AS (
  SELECT line.doc_id, sum(len(string_split(line.normal, ' '))) AS n_removed_words
  FROM line JOIN frequent ON line.normal = frequent.normal AND line.source IS NOT DISTINCT FROM frequent.source
  GROUP BY line.doc_id
)
SELECT counts.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT (n_words - coalesce(n_removed_words, 0) < {min_left} * n_words) AS kept,
       CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
FROM counts LEFT JOIN lost ON counts.doc_id = lost.doc_id
""".format(max_docs=MAX_DOCS, min_left=MIN_LEFT)
