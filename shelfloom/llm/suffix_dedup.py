"""Repeated byte strings across documents, by a hash-compared sort of sampled suffixes.

Every byte covered by a ``length``-byte string that also starts in a document with a
smaller id is removed; overlaps count and strings are judged on the input.

Sorting all suffixes would move many times the input, so suffixes are sampled by content:
of every ``length`` consecutive bytes the position whose ``anchor`` bytes hash lowest is an
anchor. Equal strings choose equal anchors, so any repeated string holds an anchor that its
other occurrence holds too.

1. The anchors' hashes are dealt into buckets, packed. A bucket names the anchors that occur
   in two different texts; nothing else goes on.
2. Of those anchors the surroundings that a string around them can reach are dealt by the
   anchor's hash. Within a bucket, the texts to the right of equal anchors are sorted by a merge
   sort that compares two suffixes by their prefix polynomial hashes: binary search for the
   longest equal prefix, then one byte. The texts to the left are sorted likewise, backwards.
   Equal neighbours' extensions are verified byte by byte; a collision sorts the bucket
   again with another base. From the two orders follows, for each place a string can have around its
   anchor, which strings are equal, and each class's smallest document.
3. Covered ranges return to their texts and are united.

Copies of a text are one text with its smallest id; a later copy is removed as a whole. Entries are
combined before every shuffle: an anchor that many texts of a task share sends one entry,
and of equal surroundings one entry with the smallest id goes on while the others are covered at
once. Equal strings of one text send one entry too, and what is covered of a text covers all
occurrences in it, so a megabyte of one byte costs no more than its few different strings. Anchors that occur more than ``hot_anchor`` times (at most ``HOT_SHARE`` anchors, so their
list is small) go on as whole strings instead of surroundings, so that a common phrase
does not bring all its surroundings to one task.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; ids are
64-bit integers and a null id counts as larger than any other; equal ids are one document, so
nothing is removed between them; repeated rows each get a row; extra columns are never read; an empty
table gives an empty result.
"""

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, counted, slices
from shelfloom.session import settle

LENGTH = 50
ANCHOR = 20

# Text bytes whose anchors meet in one bucket, and surroundings that meet in one.
BUCKET_BYTES = 16 << 20
BUCKET_ENTRIES = 100_000

# An anchor is hot beyond this many occurrences, or beyond this share of all anchors.
HOT_ANCHOR = 20_000
HOT_SHARE = 4_000_000

# Text bytes that a task gathers before it sends their entries.
_GATHERED = 8 << 20
_BLOCK = 1 << 18

_LARGEST = np.int64(2**63 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SMALL_BASES = [np.uint64(b) for b in (0x100000001B3, 0x27D4EB2F165667C5, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_PAD = 0xFF  # no byte of UTF-8


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


class Anchors:
    """Choice of anchors in a text."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, anchor
        size = _BLOCK + 2 * length
        self.up = _powers(_BASE, size)
        self.down = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), size)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Mixed polynomial hash of the ``anchor`` bytes from every position, by prefix sums."""
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.up[:len(data)], out=prefix[1:])
        starts = len(data) - self.anchor + 1
        return _mix((prefix[self.anchor:] - prefix[:starts]) * self.down[:starts])

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        """The same hashes of anchors given as rows of bytes."""
        return _mix(_mix((rows * self.up[:self.anchor]).sum(axis=1, dtype=np.uint64)))

    def find(self, text: bytes) -> tuple:
        """(positions, hashes) of the anchors of a text.

        Anchors have low hashes, so these are mixed once more to spread over the buckets.
        """
        data, width = np.frombuffer(text, np.uint8), self.length - self.anchor + 1
        places, found = [], []
        for start in range(0, len(data) - self.length + 1, _BLOCK):
            hashed = self.hashes(data[start:start + _BLOCK + self.length - 1])
            least = _sliding(hashed, width, np.minimum)
            framed = np.zeros(len(hashed) + width - 1, np.uint64)
            framed[width - 1:width - 1 + len(least)] = least
            chosen = np.flatnonzero(_sliding(framed, width, np.maximum) == hashed)
            places.append(chosen + start)
            found.append(hashed[chosen])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        places, kept = np.unique(np.concatenate(places), return_index=True)
        return places, _mix(np.concatenate(found)[kept])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; ``_unpack`` needs their types."""
    sizes = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(value: bytes, *types) -> list:
    data = zstandard.ZstdDecompressor().decompress(value)
    sizes, at, out = np.frombuffer(data, np.int64, len(types)).tolist(), 8 * len(types), []
    for kind, size in zip(types, sizes, strict=True):
        kind = np.dtype(kind)
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


def _joined(values: list, *types) -> list:
    parts = [_unpack(v, *types) for v in values]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in enumerate(types)]


def _groups(*keys: np.ndarray) -> tuple:
    """(order, starts) that bring rows with equal keys together."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.flatnonzero(new)


def _sizes(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.concatenate((starts, [total])))


_PACKED = "bucket int, kind int, packed binary"
# Kinds of packed rows: entries to be judged, whole strings to be judged, and what is already known.
ENTRIES, STRINGS, KNOWN = 0, 1, 2

_ANCHOR_TYPES = (np.uint32, np.uint32, np.uint32, np.uint32, np.int64, np.int64)


def _packed_batch(rows: list) -> pa.RecordBatch:
    bucket, kind, packed = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(packed, pa.binary())],
        ["bucket", "kind", "packed"])


def _send_anchors(texts: list, buckets: int) -> Iterator[tuple]:
    """Rows for the buckets from ((h1, h2), positions, hashes) of a task's different texts."""
    keys = np.array([t[0] for t in texts], np.int64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(texts)), [len(t[1]) for t in texts])
    place = np.concatenate([t[1] for t in texts]).astype(np.uint32)
    hashed = np.concatenate([t[2] for t in texts])
    order, starts = _groups(hashed)
    owner, place, hashed = owner[order], place[order], hashed[order]
    sizes = _sizes(starts, len(order))
    # lexsort is stable, so an anchor's texts come in order: it is in several if its ends differ.
    several = owner[starts] != owner[starts + sizes - 1]
    known = np.repeat(several, sizes)
    if known.any():
        yield 0, KNOWN, (keys[owner[known]], place[known])
    # Of an anchor in several texts one entry goes on, with the number of its occurrences; it is
    # marked by a count beyond 1. Others are sent one by one, in the order of their texts.
    sent = ~known
    sent[starts[several]] = True
    times = np.where(known, np.repeat(sizes, sizes), 1)[sent].astype(np.uint32)
    owner, place, hashed = owner[sent], place[sent], hashed[sent]
    bucket = _bucket(hashed, buckets)
    order = np.lexsort((place, owner, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for number in np.flatnonzero(np.diff(cuts)).tolist():
        part = order[cuts[number]:cuts[number + 1]]
        texts_here, index = np.unique(owner[part], return_inverse=True)
        yield number, ENTRIES, _pack(hashed[part].astype(np.uint32), index.astype(np.uint32), place[part], times[part],
                                     keys[texts_here, 0], keys[texts_here, 1])


# Columns of numbers with the two hashes of the text that they belong to, packed by the task that
# gathers what belongs to one text.
_FOR_TEXTS = "target int, packed binary, entries bigint"
_NO_TEXT = -1


def _for_texts(targets: int, first: np.ndarray, second: np.ndarray, *columns: np.ndarray) -> list:
    """(target, packed, entries) rows; one for each target among the texts."""
    target = _bucket(_mix(first.view(np.uint64)), targets)
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(targets + 1))
    rows = []
    for number in np.flatnonzero(np.diff(cuts)).tolist():
        part = order[cuts[number]:cuts[number + 1]]
        keys, text = np.unique(np.stack((first[part], second[part]), axis=1), axis=0, return_inverse=True)
        packed = _pack(keys[:, 0], keys[:, 1], text.astype(np.uint32), *(c[part].astype(np.uint32) for c in columns))
        rows.append((number, packed, len(part)))
    return rows


def _for_texts_table(rows: list) -> pa.Table:
    target, packed, entries = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"target": pa.array(target, pa.int32()), "packed": pa.array(packed, pa.binary()),
                     "entries": pa.array(entries, pa.int64())})


def by_text(rows: DataFrame, columns: int, name: str) -> DataFrame:
    """(h1, h2, ``name``): one row for each text, with its numbers packed as little-endian integers."""
    def gather(table: pa.Table) -> pa.Table:
        parts = [_unpack(v, np.int64, np.int64, *[np.uint32] * (1 + columns)) for v in table.column("packed").to_pylist()]
        first, second = (np.concatenate([p[i][p[2]] for p in parts]) for i in (0, 1))
        order, starts = _groups(first, second)
        numbers = np.stack([np.concatenate([p[3 + i] for p in parts])[order] for i in range(columns)], axis=1).astype("<u4")
        ends = np.concatenate((starts[1:], [len(order)])).tolist()
        packed = [numbers[start:stop].tobytes() for start, stop in zip(starts.tolist(), ends, strict=True)]
        return pa.table({"h1": pa.array(first[order[starts]]), "h2": pa.array(second[order[starts]]),
                         name: pa.array(packed, pa.binary())})

    return rows.filter(F.col("target") != _NO_TEXT).groupBy("target").applyInArrow(gather, f"h1 bigint, h2 bigint, {name} binary")


def anchor_entries(texts: DataFrame, buckets: int, choice: tuple) -> DataFrame:
    """Packed anchors of a table (h1, h2, text)."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, seen, size = Anchors(*choice), [], set(), 0

        def flush():
            rows = []
            for number, kind, value in _send_anchors(held, buckets):
                if kind == KNOWN:
                    keys, place = value
                    # What is known already may be carried by any bucket.
                    number = int(held[0][0][0]) % buckets
                    value = _pack(keys[:, 0], keys[:, 1], place)
                rows.append((number, kind, value))
            return _packed_batch(rows)

        for batch in slices(batches, 64):
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, text in zip(keys, as_bytes(batch.column(2)), strict=True):
                if text and len(text) >= choice[0] and key not in seen:
                    seen.add(key)
                    held.append((key, *anchors.find(text)))
                    size += len(text)
                    if size >= _GATHERED:
                        yield flush()
                        held, seen, size = [], set(), 0
        if held:
            yield flush()

    return texts.select("h1", "h2", "text").mapInArrow(entries, _PACKED)


def _judge_anchors(table: pa.Table, hot_times: int, targets: int) -> pa.Table:
    """The anchors of one bucket that occur in two texts, and those that occur too often."""
    bucket, kinds = table.column("bucket")[0].as_py(), table.column("kind").to_pylist()
    values = table.column("packed").to_pylist()
    found = [_unpack(v, np.int64, np.int64, np.uint32) for k, v in zip(kinds, values, strict=True) if k == KNOWN]
    rows = []
    parts = [_unpack(v, *_ANCHOR_TYPES) for k, v in zip(kinds, values, strict=True) if k == ENTRIES]
    if parts:
        hashed, place, times = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
        # A text that several tasks have sent gets one number.
        keys = np.concatenate([np.stack(p[4:], axis=1) for p in parts])
        keys, number = np.unique(keys, axis=0, return_inverse=True)
        ends = np.cumsum([len(p[4]) for p in parts])
        text = np.concatenate([number[end - len(p[4]):end][p[1]] for p, end in zip(parts, ends.tolist(), strict=True)])
        text, parts = text.astype(np.uint32), None
        order, starts = _groups(hashed)
        sizes = _sizes(starts, len(order))
        ordered = text[order]
        other = (ordered != np.repeat(ordered[starts], sizes)) | (times[order] > 1)
        shared = np.logical_or.reduceat(other, starts)
        often = np.add.reduceat(times[order], starts, dtype=np.int64) > hot_times
        chosen = order[np.repeat(shared, sizes)]
        # An entry that stood for several is known to its texts already.
        chosen = chosen[times[chosen] == 1]
        found.append((keys[text[chosen], 0], keys[text[chosen], 1], place[chosen]))
        hot = hashed[order[starts[often & shared]]].astype(np.uint64) | np.uint64(bucket << 32)
        if len(hot):
            rows.append((_NO_TEXT, hot.tobytes(), len(hot)))
    if found:
        rows += _for_texts(targets, *(np.concatenate([f[i] for f in found]) for i in range(3)))
    return _for_texts_table(rows)


def shared_anchors(entries: DataFrame, hot_times: int, targets: int) -> DataFrame:
    """Packed places of the anchors that occur in two texts, and (target ``_NO_TEXT``) anchors that occur
    too often, each as its bucket and 32-bit hash."""
    def judge(table: pa.Table) -> pa.Table:
        return _judge_anchors(table, hot_times, targets)

    return entries.repartition(targets, "bucket").groupBy("bucket").applyInArrow(judge, _FOR_TEXTS)


# --- surroundings -----------------------------------------------------------------------------------------------


def _around_types(width: int) -> tuple:
    return (np.dtype((np.void, width)), np.uint8, np.uint8, np.int64, np.int64, np.int64, np.uint32)


class _Rows:
    """Strings of equal width with the room on both sides, the smallest id, text and place of each."""

    def __init__(self, data, left, right, first, h1, h2, place):
        self.data, self.left, self.right, self.first = data, left, right, first
        self.h1, self.h2, self.place = h1, h2, place

    def __len__(self):
        return len(self.first)

    def take(self, rows) -> "_Rows":
        return _Rows(*(getattr(self, n)[rows] for n in ("data", "left", "right", "first", "h1", "h2", "place")))

    def pack(self) -> bytes:
        flat = np.ascontiguousarray(self.data).view(np.dtype((np.void, self.data.shape[1]))).ravel()
        return _pack(flat, self.left, self.right, self.first, self.h1, self.h2, self.place)

    @staticmethod
    def unpack(values: list, width: int) -> "_Rows":
        data, *rest = _joined(values, *_around_types(width))
        return _Rows(np.ascontiguousarray(data).view(np.uint8).reshape(-1, width), *rest)

    @staticmethod
    def join(parts: list) -> "_Rows":
        return _Rows(*(np.concatenate([getattr(p, n) for p in parts])
                       for n in ("data", "left", "right", "first", "h1", "h2", "place")))


def _row_hash(rows: _Rows) -> np.ndarray:
    total = (rows.left.astype(np.uint64) << np.uint64(8)) + rows.right
    powers = _powers(_BASE, rows.data.shape[1] + 1)[1:]
    for start in range(0, len(rows), 16_384):
        part = slice(start, start + 16_384)
        total[part] += (rows.data[part] * powers).sum(axis=1, dtype=np.uint64)
    return _mix(total)


def smallest_of_equal(rows: _Rows) -> tuple:
    """(of each group of equal rows those with the smallest id; the rows with larger ids; repeats).

    Of the equal rows of one text only one stays on either side. The others are the repeats, which
    ``all_occurrences`` covers.
    """
    hashed = _row_hash(rows)
    order = np.lexsort((rows.h2, rows.h1, rows.first, hashed))
    new = np.ones(len(order), bool)
    same = hashed[order][1:] == hashed[order][:-1]
    # Neighbours with equal hashes are equal only if their bytes are.
    at = np.flatnonzero(same)
    for start in range(0, len(at), 65_536):
        part = at[start:start + 65_536]
        a, b = order[part], order[part + 1]
        same[part] = ((rows.data[a] == rows.data[b]).all(axis=1) & (rows.left[a] == rows.left[b])
                      & (rows.right[a] == rows.right[b]))
    new[1:] = ~same
    starts = np.flatnonzero(new)
    least = np.repeat(rows.first[order[starts]], _sizes(starts, len(order)))
    larger = rows.first[order] > least
    again = np.zeros(len(order), bool)
    again[1:] = same & (rows.h1[order][1:] == rows.h1[order][:-1]) & (rows.h2[order][1:] == rows.h2[order][:-1])
    return rows.take(order[~larger & ~again]), rows.take(order[larger & ~again]), rows.take(order[again])


def _marks(repeats: _Rows) -> tuple:
    """An empty range for each text that has repeats."""
    keys = np.unique(np.stack((repeats.h1, repeats.h2), axis=1), axis=0)
    none = np.zeros(len(keys), np.uint32)
    return keys[:, 0], keys[:, 1], none, none


def surroundings(text: bytes, places: np.ndarray, first: int, key: tuple, length: int, anchor: int) -> _Rows:
    """What strings around the anchors at ``places`` can reach."""
    room = length - anchor
    edge = np.full(room, _PAD, np.uint8)
    framed = np.concatenate((edge, np.frombuffer(text, np.uint8), edge))
    data = np.lib.stride_tricks.sliding_window_view(framed, anchor + 2 * room)[places]
    n = len(places)
    return _Rows(data, np.minimum(places, room).astype(np.uint8), np.minimum(len(text) - anchor - places, room).astype(np.uint8),
                 np.full(n, first, np.int64), np.full(n, key[0], np.int64), np.full(n, key[1], np.int64), places.astype(np.uint32))


def whole_strings(rows: _Rows, length: int, anchor: int) -> _Rows:
    """Every string around the anchors of ``rows``."""
    room, parts = length - anchor, []
    none = np.zeros(len(rows), np.uint8)
    for before in range(room + 1):
        fits = np.flatnonzero((rows.left >= before) & (rows.right >= room - before))
        parts.append(_Rows(rows.data[fits, room - before:room - before + length], none[fits], none[fits], rows.first[fits],
                           rows.h1[fits], rows.h2[fits], (rows.place[fits] - before).astype(np.uint32)))
    return _Rows.join(parts)


def squeezed(texts: DataFrame) -> DataFrame:
    """The rows of (doc, h1, h2, text) with their texts compressed, as they are to be shuffled twice."""
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            small = [pack(t or b"") for t in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(small, pa.binary())],
                                             ["doc", "h1", "h2", "small"])

    return texts.select("doc", "h1", "h2", "text").mapInArrow(squeeze, "doc bigint, h1 bigint, h2 bigint, small binary")


def _whole(column: pa.Array) -> list:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in column.to_pylist()]


def _covered(rows: _Rows, low: np.ndarray, high: np.ndarray) -> bytes:
    return _pack(rows.h1, rows.h2, low.astype(np.uint32), high.astype(np.uint32))


def _reach(rows: _Rows, width: int) -> tuple:
    """The whole range that rows of ``width`` central bytes stand for."""
    place = rows.place.astype(np.int64)
    return place - rows.left, place + width + rows.right


def surrounding_entries(touched: DataFrame, buckets: int, choice: tuple, anchor_buckets: int, hot) -> DataFrame:
    """Packed surroundings of the shared anchors of (first, h1, h2, small, places)."""
    length, anchor = choice

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, count = Anchors(length, anchor), [], 0

        def settled(rows, width, out):
            kept, larger, repeats = smallest_of_equal(rows)
            if len(larger):
                out.append((int(larger.h1[0]) % buckets, KNOWN, _covered(larger, *_reach(larger, width))))
            if len(repeats):
                out.append((int(repeats.h1[0]) % buckets, KNOWN, _pack(*_marks(repeats))))
            return kept

        def send(rows, kind, width, out):
            kept = settled(rows, width, out)
            # Surroundings meet by their anchor, whole strings by all their bytes.
            room = (kept.data.shape[1] - anchor) // 2
            hashed = _row_hash(kept) if kind == STRINGS else anchors.of_rows(kept.data[:, room:room + anchor])
            bucket = _bucket(_mix(hashed), buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for number in np.flatnonzero(np.diff(cuts)).tolist():
                out.append((number, kind, kept.take(order[cuts[number]:cuts[number + 1]]).pack()))

        def flush():
            out = []
            # A run of one byte makes equal surroundings at each of its places; one of them goes on.
            rows = settled(_Rows.join(held), anchor, out)
            room = length - anchor
            hashed = anchors.of_rows(rows.data[:, room:room + anchor])
            named = (_bucket(hashed, anchor_buckets).astype(np.uint64) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))
            at = np.minimum(np.searchsorted(hot.value, named), max(0, len(hot.value) - 1))
            often = hot.value[at] == named if len(hot.value) else np.zeros(len(named), bool)
            if not often.all():
                send(rows.take(np.flatnonzero(~often)), ENTRIES, anchor, out)
            for start in range(0, int(often.sum()), 5_000):
                some = rows.take(np.flatnonzero(often)[start:start + 5_000])
                send(whole_strings(some, length, anchor), STRINGS, length, out)
            return _packed_batch(out)

        for batch in slices(batches, 64):
            first, h1, h2, parts = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for least, a, b, text, places in zip(first, h1, h2, _whole(batch.column(3)), parts, strict=True):
                found = np.unique(np.frombuffer(places, "<u4")).astype(np.int64)
                # A text with very many anchors is sent in parts.
                for start in range(0, len(found), 50_000):
                    some = found[start:start + 50_000]
                    held.append(surroundings(text, some, _LARGEST if least is None else least, (a, b), length, anchor))
                    count += len(some)
                    if count >= 60_000:
                        yield flush()
                        held, count = [], 0
        if held:
            yield flush()

    return touched.select("first", "h1", "h2", "small", "places").mapInArrow(entries, _PACKED)


class SuffixOrder:
    """Rows of bytes in sorted order within groups, and the equal extensions of neighbours.

    ``group`` numbers the groups of rows in ascending order. Suffixes are compared by prefix
    polynomial hashes: binary search for the longest equal prefix, then the next byte.
    """

    def __init__(self, data: np.ndarray, group: np.ndarray):
        self.data, self.group, self.width = data, group, data.shape[1]
        for base in _SMALL_BASES:
            self.prefix = self._prefixes(base)
            self.order = self._sorted()
            if self._verified():
                return
        raise RuntimeError("all hash bases collide")

    def _prefixes(self, base: np.uint64) -> np.ndarray:
        prefix = np.zeros((self.width + 1, len(self.data)), np.uint64)
        for i in range(self.width):
            prefix[i + 1] = prefix[i] * base + self.data[:, i] + np.uint64(1)
        return prefix

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal prefix of rows ``a`` and ``b``, by binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        for _ in range(self.width.bit_length()):
            middle = (low + high + 1) >> 1
            equal = self.prefix[middle, a] == self.prefix[middle, b]
            low = np.where(equal, middle, low)
            high = np.where(equal, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row ``a`` sorts before row ``b``."""
        same = self.extension(a, b)
        at = np.minimum(same, self.width - 1)
        return (same < self.width) & (self.data[a, at] < self.data[b, at])

    def _sorted(self) -> np.ndarray:
        n = len(self.group)
        order = np.argsort(self.group, kind="stable")
        grouped = self.group[order]
        starts = np.flatnonzero(np.concatenate(([True], grouped[1:] != grouped[:-1]))) if n else np.empty(0, np.int64)
        sizes = _sizes(starts, n)
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        rank = np.arange(n) - start
        width = 1
        while len(sizes) and width < sizes.max():
            # Merge neighbouring runs of ``width`` rows: a row moves by the rows of the other run
            # that come before it, which are counted by binary search.
            run = rank // width
            sibling = start + (run ^ 1) * width
            here = np.flatnonzero((size > width) & (sibling < start + size))
            own, odd = order[here], (run[here] & 1).astype(bool)
            base = sibling[here]
            low = np.zeros(len(here), np.int64)
            high = np.minimum(width, start[here] + size[here] - base)
            while (low < high).any():
                open_rows = np.flatnonzero(low < high)
                middle = (low[open_rows] + high[open_rows]) >> 1
                other = order[base[open_rows] + middle]
                mine = own[open_rows]
                # Rows of the left run stay in front of equal rows of the right one.
                first = np.where(odd[open_rows], ~self.before(mine, other), self.before(other, mine))
                low[open_rows] = np.where(first, middle + 1, low[open_rows])
                high[open_rows] = np.where(first, high[open_rows], middle)
            moved = order.copy()
            pair = start[here] + (run[here] >> 1) * 2 * width
            moved[pair + (rank[here] - run[here] * width) + low] = own
            order = moved
            width *= 2
        return order

    def _verified(self) -> bool:
        """Compare neighbours byte by byte with what the hashes said."""
        self.equal = np.zeros(len(self.order), np.int64)
        grouped = self.group[self.order]
        inside = np.flatnonzero(grouped[1:] == grouped[:-1]) if len(grouped) else np.empty(0, np.int64)
        for at in range(0, len(inside), 65_536):
            part = inside[at:at + 65_536]
            a, b = self.order[part], self.order[part + 1]
            differs = self.data[a] != self.data[b]
            true = np.where(differs.any(axis=1), differs.argmax(axis=1), self.width)
            if (true != self.extension(a, b)).any():
                return False
            last = np.minimum(true, self.width - 1)
            if (self.data[a, last] > self.data[b, last]).any():
                return False
            self.equal[part + 1] = true
        return True

    def classes(self, depth: int) -> np.ndarray:
        """A number for each row, equal for rows of one group that share ``depth`` bytes."""
        grouped = self.group[self.order]
        new = np.ones(len(self.order), bool)
        new[1:] = (grouped[1:] != grouped[:-1]) | (self.equal[1:] < depth)
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(new)
        return out


def covered_around(rows: _Rows, length: int, anchor: int) -> tuple:
    """(rows, low, high): ranges whose strings all are strings of smaller ids, around the anchors of ``rows``."""
    room = length - anchor
    middle = rows.data[:, room:room + anchor]
    hashed = Anchors(length, anchor).of_rows(middle)
    order, starts = _groups(hashed)
    sizes = _sizes(starts, len(order))
    # An anchor that only one of the rows has repeats nothing.
    order = order[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    rows = rows.take(order)
    # Whether the string that begins so many bytes before a row's anchor is covered.
    covered = np.zeros((len(rows), room + 3), bool)
    bounds, groups = np.concatenate(([0], np.cumsum(sizes))), np.repeat(np.arange(len(sizes)), sizes)
    start = 0
    while start < len(rows):
        # Whole groups, some ten thousand rows at a time.
        stop = int(bounds[max(np.searchsorted(bounds, start + 30_000, side="right") - 1, np.searchsorted(bounds, start, side="right"))])
        part = rows.take(slice(start, stop))
        group = groups[start:stop]
        # The anchor itself is part of what is sorted, so rows whose hashes collide part here.
        ahead = SuffixOrder(np.ascontiguousarray(part.data[:, room:]), group)
        behind = SuffixOrder(np.ascontiguousarray(part.data[:, :room][:, ::-1]), group)
        for before in range(room + 1):
            fits = np.flatnonzero((part.left >= before) & (part.right >= room - before))
            if len(fits):
                a, b = behind.classes(before)[fits], ahead.classes(anchor + room - before)[fits]
                together, begins = _groups(a, b)
                least = np.minimum.reduceat(part.first[fits][together], begins)
                least = np.repeat(least, _sizes(begins, len(together)))
                hit = fits[together[part.first[fits][together] > least]] + start
                covered[hit, before + 1] = True
        start = stop
    # A range for each run of covered strings: what lies between two runs is no string of a smaller id,
    # though all its bytes may be covered.
    found, nearest = np.nonzero(covered[:, 1:] & ~covered[:, :-1])
    farthest = np.nonzero(covered[:, :-1] & ~covered[:, 1:])[1] - 1
    place = rows.place[found].astype(np.int64)
    return rows.take(found), place - farthest, place - nearest + length


def covered_ranges(entries: DataFrame, choice: tuple, buckets: int, targets: int) -> DataFrame:
    """Packed byte ranges, for their texts, that strings of smaller ids cover."""
    length, anchor = choice
    width = 2 * length - anchor

    def judge(table: pa.Table) -> pa.Table:
        kinds, values = table.column("kind").to_pylist(), table.column("packed").to_pylist()
        found = [_unpack(v, np.int64, np.int64, np.uint32, np.uint32) for k, v in zip(kinds, values, strict=True) if k == KNOWN]
        for kind, size, centre in ((ENTRIES, width, anchor), (STRINGS, length, length)):
            own = [v for k, v in zip(kinds, values, strict=True) if k == kind]
            if own:
                kept, larger, repeats = smallest_of_equal(_Rows.unpack(own, size))
                found.append((larger.h1, larger.h2, *_reach(larger, centre)))
                found.append(_marks(repeats))
                if kind == ENTRIES:
                    rows, low, high = covered_around(kept, length, anchor)
                    found.append((rows.h1, rows.h2, low, high))
        made = _for_texts(targets, *(np.concatenate([f[i] for f in found]) for i in range(4))) if found else []
        return _for_texts_table(made)

    return entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judge, _FOR_TEXTS)


def _marked(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in one of some ranges."""
    change = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def all_occurrences(text: bytes, begins: np.ndarray, length: int) -> np.ndarray:
    """Where the strings of ``length`` bytes that begin at the marked places begin, all their occurrences included.

    Strings are grouped by a polynomial hash; a place is added if its bytes equal those of its group's
    marked one.
    """
    data = np.frombuffer(text, np.uint8)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)))
    hashed = (sums[length:] - sums[:-length]) * _powers(inverse, len(data))[:len(data) - length + 1]
    known, first = np.unique(hashed[begins], return_index=True)
    first = np.flatnonzero(begins)[first]
    at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
    found = np.flatnonzero((known[at] == hashed) & ~begins)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    marked = begins.copy()
    for start in range(0, len(found), 65_536):
        part = found[start:start + 65_536]
        marked[part] = (windows[part] == windows[first[at[part]]]).all(axis=1)
    return marked


def remaining(text: bytes, ranges: bytes, length: int = LENGTH) -> tuple:
    """(bytes removed, number of removed runs, what remains) of a text with covered ranges.

    A range is made of strings of ``length`` bytes. An empty one says that the text has repeats, of which
    others may stand for: then the strings are removed wherever they occur in the text.
    """
    pairs = np.frombuffer(ranges, "<u4").reshape(-1, 2).astype(np.int64)
    some = pairs[pairs[:, 1] > 0]
    if not len(some):
        return 0, 0, text
    if len(some) < len(pairs):
        strings = len(text) - length + 1
        at = np.flatnonzero(all_occurrences(text, _marked(strings, some[:, 0], some[:, 1] - length + 1), length))
        some = np.stack((at, at + length), axis=1)
    gone = _marked(len(text), some[:, 0], some[:, 1])
    return int(gone.sum()), len(counted(gone)[0]), np.frombuffer(text, np.uint8)[~gone].tobytes()


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    anchor: int = ANCHOR, hot_anchor: int = HOT_ANCHOR) -> tuple:
    """(texts, ranges): each compressed text that holds shared anchors, and covered ranges of texts.

    A text is known by two 64-bit hashes, h1 and h2; ``first`` is its smallest document id.
    """
    named = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(F.col(text_col)).alias("h1"),
                        F.xxhash64(F.lit(7), F.col(text_col)).alias("h2"), F.col(text_col).alias("text"))
    spark, choice = docs.sparkSession, (length, anchor)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, ceil(size / BUCKET_BYTES))
    anchors = 2 * size // (length - anchor + 2)
    hot_times = max(hot_anchor, anchors // HOT_SHARE)
    shared = settle(shared_anchors(anchor_entries(named, buckets, choice), hot_times, buckets), "shared-anchors")
    # At most HOT_SHARE anchors can occur more than hot_times times.
    often = shared.filter(F.col("target") == _NO_TEXT).select("packed").toArrow().column(0).to_pylist()
    sent = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(often), np.uint64)))

    places = by_text(shared, 1, "places")
    firsts = named.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    wanted = places.join(firsts, ["h1", "h2"]).select("first", F.col("h1").alias("k1"), F.col("h2").alias("k2"), "places")
    touched = settle(
        squeezed(named).join(wanted, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("doc").eqNullSafe(F.col("first")))
        .select("first", "h1", "h2", "small", "places"), "touched-texts")
    count = shared.filter(F.col("target") != _NO_TEXT).agg(F.sum("entries")).first()[0] or 0
    parts = max(least, ceil(count / BUCKET_ENTRIES))
    ranges = covered_ranges(surrounding_entries(touched, parts, choice, buckets, sent), choice, parts, buckets)
    return touched.select("h1", "h2", "small"), by_text(ranges, 2, "ranges")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 anchor: int = ANCHOR, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what remains, for every row."""
    texts, ranges = repeated_ranges(docs, id_col, text_col, length, anchor, hot_anchor)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [remaining(t, r, length) for t, r in zip(_whole(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.int64()),
                 pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string())],
                ["h1", "h2", "removed", "spans", "kept"])

    # Rows that repeat a document bring its text twice.
    cuts = settle(
        texts.join(ranges, ["h1", "h2"]).select("h1", "h2", "small", "ranges")
        .mapInArrow(cut, "h1 bigint, h2 bigint, removed bigint, spans bigint, kept string").dropDuplicates(["h1", "h2"]),
        "cut-texts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h1"),
                       F.xxhash64(F.lit(7), F.col(text_col)).alias("h2"), F.octet_length(text).cast("bigint").alias("n_bytes"),
                       F.sha2(text, 256).alias("whole"))
    firsts = rows.groupBy("h1", "h2").agg(F.min(F.col("doc_id").cast("bigint")).alias("first"))
    known = firsts.join(cuts, ["h1", "h2"], "left").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first", "removed", "spans", "kept")
    joined = rows.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    # A null id is larger than any other; if all copies have none, none is smaller.
    later = (F.col("n_bytes") >= length) & F.col("first").isNotNull() & ~F.col("doc_id").cast("bigint").eqNullSafe(F.col("first"))
    return joined.select(
        "doc_id", "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(later, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(later, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
