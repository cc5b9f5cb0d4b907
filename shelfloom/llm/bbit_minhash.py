"""Near-duplicates by b-bit MinHash: bands propose, packed signatures estimate, full sets decide.

A text is the set of its word shingles. Each of ``MINIMA`` hash functions has a minimum over
the set; two sets share a minimum with the probability of their Jaccard similarity.

1. Bands. The minima are cut into bands of ``BAND_ROWS``; sets that agree in a whole band meet in
   a bucket. Sets of a similarity of 0.8 miss each other in all 36 bands with a probability of 6e-9.
2. Signatures. Of each minimum the lowest ``BITS`` bits are kept and packed, 72 bytes a text. Equal
   bits of two signatures are counted; different minima agree by chance in one of 2**BITS
   cases, and the estimate is corrected for that. A pair is dropped if its estimate lies six
   standard deviations below the similarity asked for. Parity bits, 256 bytes, sharpen this: every
   shingle that only one of two sets holds flips one bit, so the sets differ in at least as many shingles
   as bits, which drops no similar pair and few of the others pass.
3. Sets. Pairs that pass are compared on their full sets, so every link is a true one.

Pairs are not listed within a bucket. First each set meets one or two members of its bucket, the hubs;
the likeliest of all its hubs is verified, which joins a large group of copies at a cost for each
member. Then only buckets are left that still hold several groups. Their sets are compared by their
packed bits, in blocks of a bounded number of members that are spread over tasks; of all pairs
between two groups the likeliest is verified. What is still apart after that is compared once more, and
now every pair that passes is verified. Sets that are equal are one entry from the start.

Defined results: a null, empty or white-space text has the empty set, which is linked with nothing;
fewer words than a shingle give one shingle of all words; A-Z count as a-z; repeated rows each get a
row; a null id is never a component's id unless all its group's are null, and counts as kept
then; rows of one id with different texts are linked only by their texts; very long texts are taken
in pieces; extra columns are ignored; an empty table gives an empty result. Sets are told apart by
a 64-bit hash of their shingles' 64-bit hashes.
"""

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.components import components
from shelfloom.llm.simhash import shingle_hashes
from shelfloom.llm.texts import as_bytes, id_type, same_document, slices, text_key
from shelfloom.session import settle

SHINGLE_WORDS = 4
PERCENT = 80
BANDS, BAND_ROWS = 36, 4
MINIMA = BANDS * BAND_ROWS
BITS = 4
DEVIATIONS = 6

PARITY_BITS = 2048

# Members of a bucket that one task compares with as many others.
BLOCK = 1024

# Slots of text hashes that are told to all tasks: a number for each, however many texts there are.
SLOTS = 1 << 20

# Shingles whose hashes are worked out at one time.
_AT_ONCE = 2048

# Odd multipliers, one for each hash function.
_FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {i}") | 1 for i in range(MINIMA)], np.uint64)

# Equal four-bit halves of a byte that is the exclusive or of two.
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def shingle_set(text: bytes, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", words_each))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set that is not empty."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _AT_ONCE):
        np.minimum(least, np.multiply.outer(_FACTORS, shingles[start:start + _AT_ONCE]).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """The lowest bits of the minima's upper halves, two to a byte."""
    low = (least >> np.uint64(32) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


def parities(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles that fall on each of some bits."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def band_keys(least: np.ndarray) -> list:
    """A bucket's name for each band, as signed integers."""
    raw, size = least.tobytes(), 8 * BAND_ROWS
    return np.array([xxhash.xxh64_intdigest(raw[i * size:(i + 1) * size], i) for i in range(BANDS)], np.uint64).view(np.int64)


def equal_minima(similarity: float) -> float:
    """Share of equal low bits expected of two sets: what is shared, and what agrees by chance."""
    chance = 0.5 ** BITS
    return chance + (1 - chance) * similarity


def estimated_similarity(equal: np.ndarray) -> np.ndarray:
    """The estimate from counts of equal low bits, corrected for chance."""
    chance = 0.5 ** BITS
    return (equal / MINIMA - chance) / (1 - chance)


def fewest_equal(percent: int) -> int:
    """Counts of equal low bits below this speak against a similarity of ``percent``."""
    share = equal_minima(percent / 100)
    return floor(MINIMA * share - DEVIATIONS * sqrt(MINIMA * share * (1 - share)))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets have at least this Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str, text_col: str, words_each: int) -> DataFrame:
    """(doc, text_hash, entry, size, signature, parity, bands) of every row; the empty set has no entry."""
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            entries, sizes, signatures, parity, bands = [], [], [], [], []
            for text in as_bytes(batch.column(2)):
                shingles = shingle_set(text, words_each)
                sizes.append(len(shingles))
                if not len(shingles):
                    for column in (entries, signatures, parity, bands):
                        column.append(None)
                    continue
                least = minima(shingles)
                entries.append(xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63))
                signatures.append(packed(least))
                parity.append(parities(shingles))
                bands.append(band_keys(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(entries, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(signatures, pa.binary()), pa.array(parity, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc", "text_hash", "entry", "size", "signature", "parity", "bands"])

    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc"), text_key(text).alias("text_hash"), text.alias("text"))
    return narrow.mapInArrow(
        sketched, f"doc {id_type(docs, id_col)}, text_hash bigint, entry bigint, size bigint, signature binary, "
        "parity binary, bands array<bigint>")


def buckets(entries: DataFrame) -> DataFrame:
    """(bucket, entry) of the buckets that hold several entries, with two hubs each.

    Hubs are the first and last entries in one of four orders, which the bucket's name chooses, so
    that a set whose buckets have the same members meets some more of them.
    """
    posted = entries.select("entry", F.explode("bands").alias("bucket")).withColumn(
        "turned", F.col("entry").bitwiseXOR(F.shiftleft(F.col("bucket").bitwiseAND(F.lit(3)), 62)))
    ends = posted.groupBy("bucket").agg(F.min("turned").alias("low"), F.max("turned").alias("high")).filter("low < high")
    back = F.shiftleft(F.col("bucket").bitwiseAND(F.lit(3)), 62)
    hubs = F.array(F.col("low").bitwiseXOR(back), F.col("high").bitwiseXOR(back)).alias("hubs")
    return posted.join(ends, "bucket").select("bucket", "entry", hubs)


class Sketches:
    """Sizes, signatures and parities of some entries."""

    def __init__(self, sizes: np.ndarray, signatures: np.ndarray, parities: np.ndarray):
        self.sizes, self.signatures, self.parities = sizes, signatures, parities

    def __getitem__(self, places) -> "Sketches":
        return Sketches(self.sizes[places], self.signatures[places], self.parities[places])

    def likely(self, other: "Sketches", percent: int) -> tuple:
        """(whether each pair may be similar, its differing parity bits, its equal low bits)."""
        small, large = np.minimum(self.sizes, other.sizes), np.maximum(self.sizes, other.sizes)
        differ = np.bitwise_count(self.parities ^ other.parities).sum(axis=1, dtype=np.int64)
        equal = _EQUAL[self.signatures ^ other.signatures].sum(axis=1, dtype=np.int64)
        good = (100 * small >= percent * large) & (equal >= fewest_equal(percent))
        return good & (differ * (100 + percent) <= (small + large) * (100 - percent)), differ, equal


def _sketches(sizes: list, signatures: list, parities: list) -> Sketches:
    return Sketches(np.array(sizes, np.int64), np.frombuffer(b"".join(signatures), np.uint8).reshape(len(sizes), -1),
                    np.frombuffer(b"".join(parities), np.uint64).reshape(len(sizes), -1))


def likely(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, estimate) of the pairs whose sizes, signatures and parities allow the similarity."""
    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            left, right = (_sketches(*(batch.column(i).to_pylist() for i in at)) for at in ((2, 3, 4), (5, 6, 7)))
            good, _, equal = left.likely(right, percent)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).filter(pa.array(good)) for i in (0, 1)), pa.array(estimated_similarity(equal[good]))],
                ["a", "b", "estimate"])

    names = ("size", "signature", "parity")
    a, b = (entries.select(F.col("entry").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in names]) for n in "ab")
    columns = [f"{c}_{n}" for n in "ab" for c in names]
    return pairs.join(a, "a").join(b, "b").select("a", "b", *columns).mapInArrow(
        estimated, "a bigint, b bigint, estimate double")


def full_sets(wanted: DataFrame, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str,
              words_each: int) -> DataFrame:
    """(entry, shingles): the full sets of the wanted entries, packed, from one text of each."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, words_each).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["entry", "shingles"])

    # One text of each wanted set: its copies stay where they are.
    places = settle(rows.join(wanted, "entry", "left_semi").groupBy("entry").agg(
        F.min(F.struct("text_hash", "doc")).alias("place")).select("entry", "place.doc", "place.text_hash"), "set-places")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), text_key(F.col(f"`{text_col}`")).alias("text_hash"),
                        F.col(f"`{text_col}`").alias("text"))
    # Most texts are not wanted and need not be shuffled: those whose hash falls on no slot of a wanted one.
    slots = places.select(F.pmod("text_hash", F.lit(SLOTS)).alias("slot")).distinct()
    texts = texts.withColumn("slot", F.pmod("text_hash", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi")
    met = texts.join(places, same_document(texts, places, ["doc", "text_hash"])).select("entry", "text")
    return met.mapInArrow(sets, "entry bigint, shingles binary").dropDuplicates(["entry"])


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs of entries (a, b) whose ``full_sets`` are similar."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = ([np.frombuffer(s, np.uint64) for s in batch.column(i).to_pylist()] for i in (2, 3))
            hit = pa.array([similar(x, y, percent) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(hit) for i in (0, 1)], ["a", "b"])

    a, b = (found.select(F.col("entry").alias(n), F.col("shingles").alias(f"{n}_shingles")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_shingles", "b_shingles").mapInArrow(
        compared, "a bigint, b bigint")


def pairs_between(groups: np.ndarray, sketches: Sketches, cut: int, best_only: bool, percent: int) -> tuple:
    """Places of the likely pairs of different groups, among all rows, or across ``cut`` if that is not 0.

    With ``best_only`` one pair for each two groups: that with the fewest differing bits.
    """
    found = [], [], []
    for i in range(cut or len(groups)):
        near = np.flatnonzero(groups[cut or i + 1:] != groups[i]) + (cut or i + 1)
        if not len(near):
            continue
        good, differ, _ = sketches[i:i + 1].likely(sketches[near], percent)
        near = near[good]
        for column, values in zip(found, (np.full(len(near), i), near, differ[good]), strict=True):
            column.append(values)
    if not found[0]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, two, differ = (np.concatenate(c) for c in found)
    if best_only:
        low, high = np.minimum(groups[one], groups[two]), np.maximum(groups[one], groups[two])
        order = np.lexsort((differ, high, low))
        low, high = low[order], high[order]
        order = order[np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[:len(order)]]
        one, two = one[order], two[order]
    return one, two


def open_pairs(shared: DataFrame, entries: DataFrame, known: DataFrame, best_only: bool, percent: int) -> DataFrame:
    """(a, b): likely pairs of different groups in the buckets that hold several groups.

    A bucket's members are dealt into blocks by a hash; each pair of blocks is one group of rows, so
    no task sees more than two blocks at a time, however large the bucket is.
    """
    grouped = shared.join(known, F.col("entry") == F.col("node"), "left").select(
        "bucket", "entry", F.coalesce("component", "entry").alias("group"))
    left = grouped.groupBy("bucket").agg(
        F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("members")).filter("low < high")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")
    members = grouped.join(left.select("bucket", blocks), "bucket").join(entries.drop("bands"), "entry")
    own = F.pmod(F.xxhash64("entry", "bucket"), F.col("blocks")).cast("int").alias("own")
    dealt = members.select("*", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"), "own", "entry", "group", "size",
        "signature", "parity")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, name = [], None
        for batch in batches:
            found = []
            for *key, own, entry, group, size, signature, parity in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != name:
                    found += _compare(rows, best_only, percent)
                    rows, name = [], key
                rows.append((own, entry, group, size, signature, parity))
            yield _pairs(found)
        yield _pairs(_compare(rows, best_only, percent))

    spread = dealt.repartition("bucket", "i", "k").sortWithinPartitions("bucket", "i", "k", "own")
    return spread.mapInArrow(compared, "a bigint, b bigint").distinct()


def _compare(rows: list, best_only: bool, percent: int) -> list:
    if len(rows) < 2:
        return []
    own, entry, group, *bits = zip(*rows, strict=True)
    cut = own.count(own[0])
    one, two = pairs_between(np.array(group), _sketches(*bits), cut if cut < len(rows) else 0, best_only, percent)
    return [(min(entry[i], entry[k]), max(entry[i], entry[k])) for i, k in zip(one.tolist(), two.tolist(), strict=True)]


def _pairs(found: list) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, words_each: int, percent: int) -> DataFrame:
    """(node, component) of every entry of ``rows`` that is linked to another."""
    entries = settle(
        rows.filter("entry IS NOT NULL").select("entry", "size", "signature", "parity", "bands").dropDuplicates(["entry"]), "entries")
    shared = settle(buckets(entries), "buckets")
    stars = shared.select("entry", F.explode("hubs").alias("hub")).filter("entry <> hub").select(
        F.least("entry", "hub").alias("a"), F.greatest("entry", "hub").alias("b")).distinct()
    stars = settle(likely(stars, entries, percent), "stars")
    # Each set's likeliest hub; the others are met again below, if the groups differ then.
    either = stars.select(F.col("a").alias("one"), "a", "b", "estimate").unionByName(
        stars.select(F.col("b").alias("one"), "a", "b", "estimate"))
    best = either.groupBy("one").agg(F.max(F.struct("estimate", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    best = settle(best, "best-stars")
    # Texts are read and shuffled once, for all rounds.
    found = settle(full_sets(shared.select("entry").distinct(), docs, rows, id_col, text_col, words_each), "sets")
    links = settle(verified(best, found, percent), "links")
    known = settle(components(links), "groups")
    tested, members = best, shared.select("bucket", "entry")
    for best_only in (True, False):
        pairs = open_pairs(members, entries, known, best_only, percent).join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs, "open-pairs")
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        links = links.unionByName(settle(verified(pairs, found, percent), "links"))
        known = settle(components(links), "groups")
    return known


def minhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words_each: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = settle(sketches(docs, id_col, text_col, words_each), "sketches")
    linked = near_links(docs, rows, id_col, text_col, words_each, percent)
    narrow = rows.select("doc", "entry", "size")
    # Sums per set before groups, so that copies are combined before they are shuffled.
    sets = settle(narrow.filter("entry IS NOT NULL").groupBy("entry").agg(F.min("doc").alias("least")), "set-owners")
    grouped = sets.join(linked.withColumnRenamed("node", "entry"), "entry")
    firsts = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("first")), "component").select("entry", "first")
    own = settle(sets.join(firsts, "entry", "left").select("entry", F.coalesce("first", "least").alias("component_id")),
                 "set-components")
    return narrow.join(own, "entry", "left").select(
        F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"),
        F.when(F.col("entry").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1),
             lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) AS gram
    FROM doc WHERE len(words) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN size s ON s.doc_id = a.doc_id JOIN size t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(s.n) + any_value(t.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc JOIN least ON doc.doc_id = least.a LEFT JOIN size ON doc.doc_id = size.doc_id
"""
