"""Near copies by exact Jaccard similarity of word shingles, one document kept of each group.

A text is the set of its five-word shingles; texts whose sets have a Jaccard similarity of
``percent`` or more are linked, and linked texts form a group. The result is that of comparing
all pairs:

1. Every set has a SimHash fingerprint, of its distinct shingles. Fingerprints within ``MAX_BITS`` bits are found
   by the inverted index over byte positions of ``simhash.py`` and propose pairs. Those are most near copies,
   but not all: a pair at the limit may differ in ten bits. The other steps find the rest.
2. Every set's shingles are put into one order, rare ones first. Similar sets share one of the
   first ``n - ceil(n * percent / 100) + 1`` shingles, whatever the order, so only these are
   posted. The order comes from counts of all texts in a bounded table; it decides how long the lists
   get, never what is found.
3. Sets that meet in a list are compared by size and by parity bits: each shingle in one
   of two sets flips one bit, so at least as many shingles differ as bits do.
4. What is proposed is verified on the sets themselves. First the pairs of the index and each set of a list with
   two of its list, its ends. Then lists of more than three sets that no link has joined so far are met by another
   of their sets in each of ``ROUNDS`` rounds, with one pair for each two groups, and last by all pairs of what
   is still apart, so that a large group of copies costs links for each member, not for all pairs.

Postings are shuffled once, as (shingle, entry); sizes and parity bits join the pairs, and only the members of
lists that are still open. Texts are shuffled only if they are in a pair, rows only if their group may have others:
the wanted hashes are told to all tasks as bits of a table of bounded size, and an exact join follows.

Defined results: texts of equal sets are one entry; a null, empty or white-space text has
the empty set, which equals only itself; fewer words than a shingle give one shingle of all words;
A-Z count as a-z; an empty table gives an empty result. Of a group the smallest id stays, a null id
is larger than any other, and of equal ids the smaller hash of the text, then of the row.
Documents that share nothing but their id, or have none, are documents of their own. Rows that are
equal in all columns are one document.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import simhash
from shelfloom.llm.components import components
from shelfloom.llm.simhash import MAX_BITS, fingerprint_of, shingle_hashes
from shelfloom.llm.texts import as_bytes, id_type, same_document, slices, text_key
from shelfloom.session import settle

SHINGLE_WORDS = 5
PERCENT = 80

# Without effect: the shingles of all texts are counted. A test sets it.
SAMPLE_BYTES = None
_PARTS, _PART = 128, 1 << 16
_WORDS = 8  # 64-bit words of parity bits
# Rounds in which the sets of open lists meet one set of their list.
ROUNDS = 1
# Words of 64 slots that are told to all tasks, however many texts there are.
SLOT_WORDS = 1 << 20


def shingle_set(text: bytes, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", words_each))


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(_PARTS * _PART)).astype(np.int64)


def frequencies(texts: DataFrame, words_each: int) -> np.ndarray:
    """Number of binary digits of how often the shingles of each bucket occur in a one-column table."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pack = np.zeros(_PARTS * _PART, np.uint32), zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            for text in as_bytes(batch.column(0)):
                np.add.at(counts, _buckets(shingle_set(text, words_each)), 1)
        for number, part in enumerate(counts.reshape(_PARTS, _PART)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], ["part", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total, unpack = np.zeros(_PART, np.uint64), zstandard.ZstdDecompressor().decompress
        for value in table.column("counts").to_pylist():
            total += np.frombuffer(unpack(value), np.uint32)
        digits = np.ceil(np.log2(total + np.uint64(1))).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "digits": pa.array([digits.tobytes()], pa.binary())})

    made = texts.mapInArrow(counted, "part int, counts binary").groupBy("part").applyInArrow(
        summed, "part int, digits binary").toArrow()
    out = np.zeros((_PARTS, _PART), np.uint8)
    for number, digits in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True):
        out[number] = np.frombuffer(digits, np.uint8)
    return out.ravel()


def posted(shingles: np.ndarray, digits: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, of which every similar set shares one."""
    n = len(shingles)
    count = n + (-n * percent) // 100 + 1 if n else 0
    return shingles[np.lexsort((shingles, digits[_buckets(shingles)]))[:count]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles that fall on each of some bits, as signed integers."""
    odd = np.bincount(((shingles >> np.uint64(23)) % np.uint64(64 * _WORDS)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _row_hash(docs: DataFrame) -> Column:
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def _named(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.col(f"`{id_col}`").alias("doc"), text_key(F.col(f"`{text_col}`")).alias("text_hash"),
            _row_hash(docs).alias("row_hash")]


def entries_of(docs: DataFrame, id_col: str, text_col: str, words_each: int, percent: int) -> DataFrame:
    """(doc, text_hash, row_hash, entry, size, fp, parity, posted) of every row; an entry is the hash of a set.

    ``posted`` is null where an earlier row of the same task has the set, so copies post once for each task.
    """
    text = F.col(f"`{text_col}`")
    digits = docs.sparkSession.sparkContext.broadcast(frequencies(docs.select(text.alias("text")), words_each))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            sets = [shingle_set(t, words_each) for t in as_bytes(batch.column(3))]
            hashes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            first = [not (h in seen or seen.add(h)) for h in hashes.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(hashes), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array(np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)),
                 pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                 pa.array([posted(s, digits.value, percent).view(np.int64) if new else None
                           for s, new in zip(sets, first, strict=True)], pa.list_(pa.int64()))],
                ["doc", "text_hash", "row_hash", "entry", "size", "fp", "parity", "posted"])

    narrow = docs.select(*_named(docs, id_col, text_col), text.alias("text"))
    return narrow.mapInArrow(
        marked, f"doc {id_type(docs, id_col)}, text_hash bigint, row_hash bigint, entry bigint, size int, "
        "fp bigint, parity array<bigint>, posted array<bigint>")


def slots_of(hashes: DataFrame) -> DataFrame:
    """(word, bits): the slots on which the values of a one-column table of hashes fall."""
    value = F.col(f"`{hashes.columns[0]}`")
    return settle(hashes.select(_word(value), _bit(value).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")),
                  "near-slots")


def on_slots(frame: DataFrame, name: str, slots: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose hash ``name`` falls on a slot, or with ``left_anti`` those that do not, without a shuffle.

    All wanted hashes are on their slots, and some others: an exact join has to follow.
    """
    marked = frame.withColumns({"word": _word(F.col(name)), "bit": _bit(F.col(name))})
    same = (marked["word"] == slots["word"]) & (marked["bit"].bitwiseAND(slots["bits"]) != 0)
    return marked.join(F.broadcast(slots), same, how).drop("word", "bit")


def _word(value: Column) -> Column:
    return F.shiftright(value, 6).bitwiseAND(F.lit(SLOT_WORDS - 1)).alias("word")


def _bit(value: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), value.bitwiseAND(F.lit(63)).cast("int"))


def _differing(a: str, b: str) -> Column:
    """Number of parity bits in which the structs ``a`` and ``b`` differ."""
    return sum((F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(_WORDS)), F.lit(0))


def _may_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether sizes and parity bits of the structs ``a`` and ``b`` allow the similarity."""
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return (small * 100 >= large * percent) & (_differing(a, b) * (100 + percent) <= (small + large) * (100 - percent))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets have at least this Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of entries (a, b) whose sizes and parity bits allow the similarity."""
    for name, side in (("a", "one"), ("b", "two")):
        pairs = pairs.join(sets.select(F.col("entry").alias(name), F.struct("size", "parity").alias(side)), name)
    return pairs.filter(_may_be_similar("one", "two", percent)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, words_each: int, percent: int) -> DataFrame:
    """The pairs of entries (a, b) whose sets are similar."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = (as_bytes(batch.column(i)) for i in (2, 3))
            sets = {t: shingle_set(t, words_each) for t in {*left, *right}}
            hit = pa.array([similar(sets[x], sets[y], percent) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(hit) for i in (0, 1)], ["a", "b"])

    wanted = pairs.select(F.col("a").alias("entry")).unionByName(pairs.select(F.col("b").alias("entry"))).distinct()
    places = rows.select("entry", "text_hash").join(wanted, "entry", "left_semi").groupBy("entry").agg(
        F.min("text_hash").alias("text_hash"))
    places = settle(places, "near-places")
    texts = docs.select(text_key(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    # Most texts are in no pair and stay where they are. Texts travel, not their sets: words compress, hashes do not.
    texts = on_slots(texts, "text_hash", slots_of(places.select("text_hash"))).dropDuplicates(["text_hash"])
    found = settle(texts.join(places, "text_hash").select("entry", "text"), "near-texts")
    a, b = (found.select(F.col("entry").alias(n), F.col("text").alias(f"{n}_text")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(compared, "a bigint, b bigint")


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def indexed_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of entries (a, b) that the index over the bytes of their fingerprints (entry, fp) proposes.

    Entries of one fingerprint go with the first of them, linked fingerprints by their first entries.
    """
    firsts = settle(sets.groupBy("fp").agg(F.min("entry").alias("first")), "near-fingerprints")
    linked = simhash.near_links(firsts.select("fp"), MAX_BITS).distinct()
    for name in "ab":
        linked = linked.join(firsts.select(F.col("fp").alias(name), F.col("first").alias(f"first_{name}")), name)
    alike = sets.select("entry", "fp").join(firsts, "fp").filter("entry <> first")
    return linked.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")).unionByName(
        alike.select(F.col("first").alias("a"), F.col("entry").alias("b")))


def near_links(docs: DataFrame, rows: DataFrame, text_col: str, words_each: int, percent: int) -> DataFrame:
    """(node, component) of every entry of ``rows`` that is similar to another."""
    sets = settle(rows.select("entry", "size", "fp", "parity").dropDuplicates(["entry"]), "near-entries")
    proposed = settle(indexed_pairs(sets), "near-indexed")
    # The filter is that of both readers, so that they read one shuffle of the postings.
    lists = rows.select("entry", F.explode("posted").alias("shingle")).filter(
        "entry IS NOT NULL AND shingle IS NOT NULL").repartition("shingle")
    # Lists of the same members have one of four orders, so a set meets some others than the first.
    turn = F.shiftleft(F.col("shingle").bitwiseAND(F.lit(3)), 62)
    turned = F.col("entry").bitwiseXOR(turn)
    ends = lists.groupBy("shingle").agg(
        F.min(turned).alias("low"), F.max(turned).alias("high"), F.count(F.lit(1)).alias("members")).filter("low < high")
    shared = settle(lists.join(ends, "shingle").select(
        "shingle", "entry", F.col("low").bitwiseXOR(turn).alias("low"), F.col("high").bitwiseXOR(turn).alias("high"),
        (F.col("members") > 3).alias("long")).distinct(), "near-lists")

    stars = shared.select("entry", F.explode(F.array("low", "high")).alias("end")).filter("entry <> end").select(
        *_pairs("entry", "end")).distinct()
    stars = settle(likely(stars, sets, percent).unionByName(proposed).distinct(), "near-pairs")
    links = settle(verified(stars, docs, rows, text_col, words_each, percent), "near-links")

    tested = stars
    for turn in range(ROUNDS):
        opened = open_lists(shared, sets, links)
        pairs = settle(hub_pairs(opened, tested, turn, percent), "near-pairs")
        if pairs.isEmpty():
            break
        tested = tested.unionByName(pairs)
        links = links.unionByName(settle(verified(pairs, docs, rows, text_col, words_each, percent), "near-links"))

    opened = open_lists(shared, sets, links)
    left = opened.select("shingle", "one", F.col("group").alias("group_one"))
    right = opened.select("shingle", F.col("one").alias("two"), F.col("group").alias("group_two"))
    rest = left.join(right, (left["shingle"] == right["shingle"]) & (F.col("group_one") < F.col("group_two"))
                     & _may_be_similar("one", "two", percent))
    rest = settle(rest.select(*_pairs("one.entry", "two.entry")).distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
    more = verified(rest, docs, rows, text_col, words_each, percent)
    return components(links.unionByName(more))


def open_lists(shared: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(shingle, one, group) of the lists that hold several groups by these links; with both ends compared,
    nothing is left of lists of up to three sets."""
    known = settle(components(links), "near-groups")
    grouped = shared.filter("long").select("shingle", "entry").join(known, F.col("entry") == F.col("node"), "left").select(
        "shingle", "entry", F.coalesce("component", "entry").alias("group"))
    several = grouped.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high")
    grouped = grouped.join(several.select("shingle"), "shingle", "left_semi").join(
        sets.select("entry", F.struct("entry", "size", "parity").alias("one")), "entry")
    return settle(grouped.select("shingle", "one", "group"), "near-open")


def hub_pairs(opened: DataFrame, tested: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): one pair for each two groups, of those between a list's sets and one of them, another in each turn."""
    hub = F.min(F.struct(F.xxhash64("one.entry", "shingle", F.lit(turn)).alias("place"), F.col("one").alias("two"),
                         F.col("group").alias("group_two"))).alias("hub")
    hubs = opened.groupBy("shingle").agg(hub).select("shingle", "hub.two", "hub.group_two")
    met = opened.join(hubs, "shingle").filter((F.col("group") != F.col("group_two")) & _may_be_similar("one", "two", percent))
    met = met.select(F.least("group", "group_two").alias("low"), F.greatest("group", "group_two").alias("high"),
                     *_pairs("one.entry", "two.entry"), _differing("one", "two").alias("differ"))
    best = met.join(tested, ["a", "b"], "left_anti").groupBy("low", "high").agg(F.min(F.struct("differ", "a", "b")).alias("best"))
    return best.select("best.a", "best.b")


def grouped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_each: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc, text_hash, row_hash, component) of every row."""
    rows = settle(entries_of(docs, id_col, text_col, words_each, percent), "near-rows")
    linked = near_links(docs, rows, text_col, words_each, percent)
    return rows.select("doc", "text_hash", "row_hash", "entry").join(
        linked.withColumnRenamed("node", "entry"), "entry", "left").select(
        "doc", "text_hash", "row_hash", F.coalesce("component", "entry").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    names = ["doc", "text_hash", "row_hash"]
    grouped = settle(grouped_rows(docs, id_col, text_col, **limits), "near-grouped")
    first = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), *names)).alias("first")
    chosen = settle(grouped.groupBy("component").agg(first, F.count(F.lit(1)).alias("rows")).select(
        "component", "rows", "first.*").drop("unnamed"), "near-chosen")
    # Rows alone in their group stay where they are; only those on a slot of a larger group are shuffled.
    larger = slots_of(chosen.filter("rows > 1").select("component"))
    disputed = slots_of(on_slots(grouped, "component", larger).select("text_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_named(docs, id_col, text_col))
    alone = on_slots(rows, "text_hash", disputed, "left_anti")
    met, first = on_slots(rows, "text_hash", disputed), on_slots(chosen, "text_hash", disputed)
    kept = met.join(first, same_document(met, first, names), "left_semi").dropDuplicates(names)
    return alone.select("row").unionByName(kept.select("row")).select("row.*")
