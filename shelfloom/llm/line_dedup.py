"""Line dedup: range-partitioned line hashes, streamed in order, kept as bitmaps.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. Keys of at least ``min_chars`` code points that occur in at least
``min_docs`` documents keep their lines only in the largest document id.

The lines travel as 128-bit hashes. They are range-partitioned by hash and, within
one hash, by document, so a line that a third of all documents share is cut into
many ranges. Each task streams its sorted range, holds at most ``min_docs`` documents
of one line, and decides every line that lies wholly inside the range. A line that
touches the range's first or last position is settled by one row per range and line.
What comes out is a compressed bitmap for each document that loses lines.

Defined results: a null or empty text is one empty line and stays; a null document id
counts as smaller than any other; rows that repeat an id count as one document, so
repeated rows all keep their lines; equal keys within one document count once; extra
columns are passed through by ``dedup_lines`` and never read; an empty table gives an
empty result.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, id_type, same_document, slices, text_key
from shelfloom.session import settle

MIN_CHARS = 40
MIN_DOCS = 5

# What a streamed row says.
DROP, OPEN, SEEN = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per document and long line key: its hash and the lines' packed positions."""
    kind = id_type(docs, id_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            high, low, owner, packed = [], [], [], []
            for row, text in enumerate(as_bytes(batch.column(2))):
                places = {}
                for place, line in enumerate((text or b"").split(b"\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if _long_enough(key, min_chars):
                            places.setdefault(xxhash.xxh3_128_digest(key), []).append(place)
                for digest, lines in places.items():
                    a, b = struct.unpack(">qq", digest)
                    high.append(a)
                    low.append(b)
                    owner.append(row)
                    packed.append(struct.pack(f"<{len(lines)}I", *lines))
            chosen = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(high, pa.int64()), pa.array(low, pa.int64()), batch.column(0).take(chosen),
                 batch.column(1).take(chosen), pa.array(packed, pa.binary())],
                ["high", "low", "doc", "text_hash", "lines"],
            )

    narrow = docs.select(F.col(id_col), text_key(F.col(text_col)), F.col(text_col)).toDF("doc", "text_hash", "text")
    return narrow.mapInArrow(hashed, f"high bigint, low bigint, doc {kind}, text_hash bigint, lines binary")


class _Run:
    """The rows of one line key within one range, largest document first."""

    def __init__(self, key, opened):
        self.key, self.opened, self.first, self.docs, self.last, self.held = key, opened, None, 0, None, []

    def add(self, row, min_docs, out):
        doc = row[2]
        if self.docs == 0 or doc != self.last:
            self.docs += 1
            self.last = doc
            if self.docs == 1:
                self.first = doc
            if self.docs == min_docs and not self.opened:
                out.extend((*held, DROP) for held in self.held if held[2] != self.first)
                self.held = []
        if self.opened:
            out.append((*row, OPEN))
        elif self.docs < min_docs:
            self.held.append(row)
        elif doc != self.first:
            out.append((*row, DROP))

    def close_last(self, min_docs, out):
        """At the end of a range the line may go on in the next one."""
        if not self.opened:
            if self.docs >= min_docs:
                out.append((*self.key, self.first, 0, b"", SEEN))
            else:
                out.extend((*held, OPEN) for held in self.held)


def stream_ranges(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """Rows to drop, and the rows of lines that lie at the ends of a range."""
    schema = occurrences.schema.simpleString()[len("struct<"):-1]

    def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, out, like = None, [], None
        for batch in batches:
            like = batch.schema
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if run is None or row[:2] != run.key:
                    run = _Run(row[:2], run is None)
                run.add(row, min_docs, out)
                if len(out) >= 8192:
                    yield _packed(out, like)
                    out = []
        if run is not None:
            run.close_last(min_docs, out)
            yield _packed(out, like)

    def _packed(rows, like):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        arrays = [pa.array(columns[i], like.field(i).type) for i in range(5)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[5], pa.int32())], [*like.names, "state"])

    order = [F.col("high"), F.col("low"), F.col("doc").desc()]
    ranged = occurrences.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(first_occurrences, f"{schema}, state int")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Packed positions of the lines each document loses, a row for each line key."""
    # Written first: the ranges are found by a pass of their own over these narrow rows.
    occurrences = settle(line_occurrences(docs, id_col, text_col, min_chars), "line-hashes")
    streamed = settle(stream_ranges(occurrences, min_docs), "line-runs")
    at_ends = streamed.filter(F.col("state") != DROP)
    # At most two lines for each range, whatever the size of the corpus.
    decided = (
        at_ends.groupBy("high", "low")
        .agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("largest"),
             F.max((F.col("state") == SEEN).cast("int")).alias("seen"),
             F.max(F.col("doc").isNull().cast("int")).alias("unnamed"))
        .filter((F.col("docs") + F.col("unnamed") >= min_docs) | (F.col("seen") == 1))
        .select("high", "low", "largest")
    )
    kept = ["doc", "text_hash", "lines"]
    late = (
        at_ends.filter(F.col("state") == OPEN)
        .join(F.broadcast(decided), ["high", "low"])
        .filter(~F.col("doc").eqNullSafe(F.col("largest")))
    )
    return streamed.filter(F.col("state") == DROP).select(*kept).unionByName(late.select(*kept))


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """Compressed bits, 1 for keep, in whole bytes up to the last dropped line."""
    bits = np.ones((int(dropped.max()) // 8 + 1) * 8, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    """True for each line that stays; lines beyond the bitmap stay."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[:len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_hash, n_dropped, bitmap) of every document that loses lines."""
    kind = id_type(docs, id_col)

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, packed = [], []
            for parts in batch.column(2).to_pylist():
                # Repeated rows of one document bring the same positions again.
                places = np.unique(np.frombuffer(b"".join(parts), np.uint32))
                counts.append(len(places))
                packed.append(pack_bitmap(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                ["doc", "text_hash", "n_dropped", "bitmap"],
            )

    lost = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    grouped = lost.groupBy("doc", "text_hash").agg(F.collect_set("lines").alias("parts"))
    return grouped.mapInArrow(bitmaps, f"doc {kind}, text_hash bigint, n_dropped bigint, bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, bitmap): each row of ``docs`` as a struct beside its bitmap, null for none."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc"),
                       text_key(F.col(text_col)).alias("text_hash"))
    return rows.join(bitmaps, same_document(rows, bitmaps, ["doc", "text_hash"]), "left").select("row", "bitmap")


def kept_text(text: bytes, bitmap: bytes) -> tuple:
    """(text without its dropped lines, lines before, lines dropped)."""
    lines = (text or b"").split(b"\n")
    if bitmap is None:
        return text or b"", len(lines), 0
    keep = unpack_bitmap(bitmap, len(lines))
    left = [line for line, stays in zip(lines, keep.tolist(), strict=True) if stays]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, for every document."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, **limits)
    kind = id_type(docs, id_col)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [kept_text(*pair) for pair in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[1] for m in made], pa.int64()),
                 pa.array([m[2] for m in made], pa.int64()),
                 pa.array([hashlib.sha256(m[0]).hexdigest() for m in made], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    joined = with_bitmaps(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bitmaps, "doc_id", "text")
    return joined.select("row.doc_id", "row.text", "bitmap").mapInArrow(
        report, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with every text reduced to the lines that stay; null texts stay null."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, **limits)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, bits = as_bytes(batch.column(1)), batch.column(2).to_pylist()
            left = [t if b is None else kept_text(t, b)[0] for t, b in zip(texts, bits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if t is None else t.decode() for t in left], pa.string())],
                ["rest", "text"],
            )

    others = [c for c in docs.columns if c != text_col]
    joined = with_bitmaps(docs, bitmaps, id_col, text_col)
    narrow = joined.select(F.struct(*[F.col(f"row.`{c}`") for c in others]).alias("rest"),
                           F.col(f"row.`{text_col}`").alias("text"), "bitmap")
    made = narrow.mapInArrow(reduce, narrow.select("rest", "text").schema)
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH line AS (
  SELECT doc_id, place, text_line,
         translate(regexp_replace(regexp_replace(text_line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (
    SELECT doc_id, unnest(lines) AS text_line, generate_subscripts(lines, 1) AS place
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
  )
), shared AS (
  SELECT line_key, max(doc_id) AS keeper
  FROM line WHERE length(line_key) >= 40
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT line.*, shared.line_key IS NOT NULL AND line.doc_id <> shared.keeper AS gone
  FROM line LEFT JOIN shared ON line.line_key = shared.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(text_line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
