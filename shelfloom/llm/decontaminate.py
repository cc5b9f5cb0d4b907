"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words: A-Z lower-cased, runs of 0-9, a-z and everything beyond
ASCII. A benchmark item is known by its windows of ``window`` consecutive words; a
shorter item is one window. All windows of all items make one automaton, and each
document is scanned once. The scan runs over the words joined by single spaces, and
every match is mapped back to word numbers and to the original text.

The automaton is sent to the tasks. Its size is checked: ``shard_bytes`` bounds the
benchmark text of one automaton, and a larger benchmark is dealt by item to several,
which a task builds one after another for each batch of documents, so memory stays
bounded. The results are the same; only then a text is scanned once per automaton.

Defined results: a null, empty or wordless text has no words, no hits and is clean; a
null or wordless item matches nothing, an item without an id is left out; items that
repeat an id count once; a window that several items share counts for each of them;
repeated document rows each get a row; extra columns are ignored by ``scan`` and passed
through by ``drop_contaminated``; an empty benchmark finds nothing.
"""

from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, counted, filtered, id_type, slices

WINDOW_WORDS = 10
SHARD_BYTES = 32 << 20

# Bytes of normalised text that the automaton is fed at one time.
_FED = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TO_WORDS = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).translate(_LOWER)
)


def normal_words(text: bytes) -> list:
    return text.translate(_TO_WORDS).split()


def windows(words: list, size: int) -> list:
    """The windows of an item as the texts that the automaton looks for."""
    spans = [words] if 0 < len(words) < size else [words[i:i + size] for i in range(len(words) - size + 1)]
    return [(b" " + b" ".join(span) + b" ").decode("latin-1") for span in spans]


def build_automaton(items: list, size: int = WINDOW_WORDS):
    """Automaton over (item id, text) pairs, or None if no item has a word.

    Its values are (number of words, item ids). Bytes stand in it as the characters of
    the same number, so that places in it are places in the UTF-8 text.
    """
    owners = {}
    for item, text in items:
        if item is not None:
            for window in windows(normal_words((text or "").encode()), size):
                owners.setdefault(window, set()).add(item)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        automaton.add_word(window, (window.count(" ") - 1, len(window), frozenset(ids)))
    automaton.make_automaton()
    return automaton


def find_windows(words: list, automaton) -> list:
    """(first word, number of words, item ids) of every occurrence of a window."""
    if automaton is None or not words:
        return []
    scanned = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = []
    feed = automaton.iter(scanned[:_FED])
    for start in range(0, len(scanned), _FED):
        if start:
            feed.set(scanned[start:start + _FED])
        found += feed
    if not found:
        return []
    # Word k starts in the scanned text where k spaces stand before it.
    starts = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])
    firsts = np.searchsorted(starts, [end - width + 2 for end, (_, width, _) in found])
    return [(first, value[0], value[2]) for first, (_, value) in zip(firsts.tolist(), found, strict=True)]


def word_places(text: bytes) -> tuple:
    """Byte offsets in the original text where its words start and end."""
    return counted(np.frombuffer(text.translate(_TO_WORDS), np.uint8) != 0x20)


def original_spans(text: bytes, hit: np.ndarray) -> list:
    """Code point ranges of the original text that hold the runs of hit words."""
    if not hit.any():
        return []
    starts, ends = word_places(text)
    first, last = counted(hit)
    spans = []
    for a, b in zip(starts[first].tolist(), ends[last - 1].tolist(), strict=True):
        before = len(text[:a].decode("utf-8", "replace"))
        spans.append((before, before + len(text[a:b].decode("utf-8", "replace"))))
    return spans


def scan_text(text: bytes, automata: list) -> tuple:
    """(number of words, hit words as booleans, ids of the items found)."""
    words = normal_words(text)
    change, items = np.zeros(len(words) + 1, np.int64), set()
    for automaton in automata:
        for first, length, ids in find_windows(words, automaton):
            change[first] += 1
            change[first + length] -= 1
            items |= ids
    return len(words), np.cumsum(change[:-1]) > 0, items


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_bytes: int) -> list:
    """The benchmark as broadcast lists of at most about ``shard_bytes`` each."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(
        F.col("item").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, ceil(total / shard_bytes))
    context = benchmark.sparkSession.sparkContext
    dealt = F.pmod(F.xxhash64("item"), F.lit(parts))
    return [context.broadcast([tuple(r) for r in items.filter(dealt == i).collect()]) for i in range(parts)]


class _Automata:
    """The automata of a task: one is kept, several are built in turn."""

    def __init__(self, shards: list, window: int):
        self.shards, self.window = shards, window
        self.only = [build_automaton(shards[0].value, window)] if len(shards) == 1 else None

    def scan(self, texts: list) -> list:
        if self.only is not None:
            return [scan_text(t, self.only) for t in texts]
        made = None
        for shard in self.shards:
            automaton = [build_automaton(shard.value, self.window)]
            now = [scan_text(t, automaton) for t in texts]
            made = now if made is None else [(n, a | b, x | y) for (n, a, x), (_, b, y) in zip(made, now, strict=True)]
        return made


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS,
         shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): what of the benchmark each document holds.

    ``items`` are ids as sorted strings, ``spans`` the code point ranges of the
    original text that hold hit words.
    """
    shards = _shards(benchmark, item_col, item_text_col, shard_bytes)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = None
        for batch in slices(batches, 1024):
            automata = automata or _Automata(shards, window)
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            made = automata.scan(texts)
            spans = [[{"start": a, "end": b} for a, b in original_spans(t, hit)]
                     for t, (_, hit, _) in zip(texts, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in made], pa.int64()),
                 pa.array([int(hit.sum()) for _, hit, _ in made], pa.int64()),
                 pa.array([sorted(map(str, items)) for _, _, items in made], pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(scanned, f"doc_id {id_type(docs, id_col)}, n_words bigint, n_hit bigint, "
                             "items array<string>, spans array<struct<start: bigint, end: bigint>>")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The scan with digests: n_items, items_sha256 and whether a document is contaminated."""
    found = scan(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", window: int = WINDOW_WORDS,
                      shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs."""
    shards = _shards(benchmark, item_col, item_text_col, shard_bytes)

    held = []

    def clean(texts: pa.Array) -> list:
        # A task's automata are built with its first rows.
        held[:] = held or [_Automata(shards, window)]
        return [not items for _, _, items in held[0].scan([t or b"" for t in as_bytes(texts)])]

    return filtered(docs, text_col, clean)
