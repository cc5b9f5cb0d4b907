"""SimHash near-duplicates by an inverted index over byte positions.

A fingerprint is eight bytes, each with its position. Fingerprints that differ in at
most ``max_bits`` bits differ in at most that many bytes, so they share at least
``8 - max_bits`` positional bytes: that is the guaranteed minimum of the count filter.
Postings of single positional bytes would each hold 1/256 of the corpus, so the index
is kept over sets of positional bytes: one posting list for every choice of
``8 - max_bits`` positions and their values. A pair is in a common list exactly if its
tally reaches the minimum, and a list has room for at most 256**max_bits different
fingerprints (65,536 for two bits), whatever the corpus. Within a list the tally of
shared bytes is taken again, the differing bits are counted, and what passes is
joined to the smallest fingerprint of its group in the list: one link for each member,
not all pairs. Equal fingerprints are one entry of the index, so copies cost nothing.

Defined results: a null, empty or white-space text has no words and the fingerprint
zero, which links like any other; fewer words than a shingle give one shingle of all
words; repeated shingles count each time; a bit is set if it is set in more than half
of the hashes; a null id never becomes a component's id unless all are null; repeated
rows each get a row; extra columns are ignored; an empty table gives an empty result.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.components import components
from shelfloom.llm.texts import as_bytes, id_type, slices
from shelfloom.session import settle

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42

# Shingles whose bits are unpacked at one time.
_AT_ONCE = 16_384


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-words_each])).tolist()
    stops = (ends[words_each - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    return fingerprint_of(shingle_hashes(text or b"", words_each))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _AT_ONCE):
        part = hashes[start:start + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's text as a signed 64-bit integer."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = np.array([fingerprint(t, words_each) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(marked, f"doc_id {id_type(docs, id_col)}, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def shared_bytes(difference: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes that two fingerprints share, from their xor."""
    return (difference.reshape(-1, 1).view(np.uint8) == 0).sum(axis=1)


def _passes(difference: np.ndarray, max_bits: int) -> np.ndarray:
    return (shared_bytes(difference) >= 8 - max_bits) & (np.bitwise_count(difference) <= max_bits)


def _groups(entries: np.ndarray, max_bits: int) -> np.ndarray:
    """Smallest entry that each entry of one posting list reaches within the list."""
    low = entries.copy()
    if len(entries) <= 256:
        near = _passes((entries[:, None] ^ entries[None, :]).ravel(), max_bits).reshape(len(entries), -1)
        while True:
            least = np.where(near, low[None, :], np.uint64(2**64 - 1)).min(axis=1)
            if (least == low).all():
                return low
            low = least
    # Long lists: look up every fingerprint within reach instead of comparing pairs.
    free = np.bitwise_or.reduce(entries ^ entries[0])
    bits = [np.uint64(1 << i) for i in range(64) if int(free) >> i & 1]
    masks = [np.bitwise_or.reduce(np.array(c, np.uint64)) for n in range(1, max_bits + 1) for c in combinations(bits, n)]
    reach = []
    for mask in masks:
        other = entries ^ mask
        at = np.minimum(np.searchsorted(entries, other), len(entries) - 1)
        hit = np.flatnonzero((entries[at] == other) & _passes(entries ^ other, max_bits))
        if len(hit):
            reach.append((hit, at[hit]))
    while True:
        before = low.copy()
        for here, there in reach:
            low[here] = np.minimum(low[here], low[there])
        if (low == before).all():
            return low


def list_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of posting lists: each entry to the smallest it reaches in its list."""
    for batch in batches:
        column = batch.column(0)
        values = np.asarray(column.flatten()).view(np.uint64)
        offsets = np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths(), np.int64))))
        sizes = np.diff(offsets)
        # Lists of two, the commonest, at once.
        two = offsets[:-1][sizes == 2]
        x, y = values[two], values[two + 1]
        near = _passes(x ^ y, max_bits)
        a, b = x[near].view(np.int64).tolist(), y[near].view(np.int64).tolist()
        for start, stop in zip(offsets[:-1][sizes > 2].tolist(), offsets[1:][sizes > 2].tolist(), strict=True):
            entries = np.unique(values[start:stop])
            low = _groups(entries, max_bits)
            moved = low != entries
            a += entries[moved].view(np.int64).tolist()
            b += low[moved].view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_links(entries: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links between the different fingerprints of a table with one column fp."""
    masks = [sum(0xFF << 8 * place for place in chosen) for chosen in combinations(range(8), 8 - max_bits)]
    posted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("places"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bytes"))
        for i, mask in enumerate(masks)
    ])).alias("posting")
    lists = (
        entries.select("fp", posted)
        .groupBy("posting.places", "posting.bytes")
        .agg(F.collect_list("fp").alias("entries"))
        .filter(F.size("entries") > 1)
    )
    return lists.select("entries").mapInArrow(lambda batches: list_links(batches, max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words_each: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    marked = settle(fingerprints(docs, id_col, text_col, words_each), "fingerprints")
    entries = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "index-entries")
    linked = components(near_links(entries.select("fp"), max_bits))
    # From here on one row for each linked fingerprint; all others are their own component.
    grouped = entries.join(linked.withColumnRenamed("node", "fp"), "fp")
    smallest = grouped.groupBy("component").agg(F.min("least").alias("first"))
    firsts = grouped.join(smallest, "component").select("fp", "first")
    own = entries.join(firsts, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    # Written, so that the last join is of two plain tables, of which Spark splits a fingerprint
    # that very many rows share.
    own = settle(own, "fingerprint-components")
    return marked.join(own, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
