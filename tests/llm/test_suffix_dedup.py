"""Suffix dedup against a table of all fixed-length strings."""

import random

import numpy as np
import pytest

from shelfloom.llm import suffix_dedup
from shelfloom.llm.suffix_dedup import Anchors, SuffixOrder
from tests.llm.cases import collected, edge_documents, empty_documents, rows_of, sha

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=50):
    first = {}
    for doc, text in rows:
        data, doc = (text or "").encode(), float("inf") if doc is None else doc
        for q in range(len(data) - length + 1):
            key = data[q:q + length]
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        data, number = (text or "").encode(), float("inf") if doc is None else doc
        gone = np.zeros(len(data), bool)
        for q in range(len(data) - length + 1):
            if first[data[q:q + length]] < number:
                gone[q:q + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), runs, sha(np.frombuffer(data, np.uint8)[~gone].tobytes())))
    return sorted(out, key=repr)


def test_equals_brute_force_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert collected(suffix_dedup.suffix_dedup(frame), *NAMES) == want and sum(w[2] for w in want)


def mosaic():
    chance = random.Random(2)
    parts = ["ab", "cd", "the ", " of ", "xyz", "é", "\n"]
    phrases = ["".join(chance.choice(parts) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(160):
        pool = [*phrases, *["".join(chance.choice(parts) for _ in range(chance.randrange(1, 60)))] * 3]
        text = "".join(chance.choice(pool) for _ in range(chance.randrange(0, 8)))
        rows.append((1000 - i if i % 3 else i, text if i % 17 else None))
    return rows + [(2000, "a" * 400), (2001, "a" * 300), (3000, rows[5][1]), (3001, rows[5][1]), (4, "b" * 49)]


@pytest.mark.parametrize(("hot", "anchor"), [(20_000, 20), (5, 8), (1, 20)])
def test_shared_passages_and_hot_anchors(spark, hot, anchor):
    rows = mosaic()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collected(suffix_dedup.suffix_dedup(frame, hot_anchor=hot, anchor=anchor), *NAMES) == brute(rows)


def test_defined_cases(spark):
    frame = edge_documents(spark)
    want = brute([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert collected(suffix_dedup.suffix_dedup(frame), *NAMES) == want
    assert suffix_dedup.suffix_dedup(empty_documents(spark)).count() == 0
    nothing = spark.createDataFrame([(None, None), (None, "x" * 60), (None, "x" * 60)], "doc_id bigint, text string")
    assert {r["n_removed"] for r in suffix_dedup.suffix_dedup(nothing).collect()} == {0}


def test_equal_strings_choose_equal_anchors(monkeypatch):
    chance = np.random.default_rng(1)
    data = chance.integers(97, 101, 4000).astype(np.uint8).tobytes()
    whole = set(Anchors(50, 20).find(data)[0].tolist())
    for start in (0, 1, 777, 3000):
        inside = Anchors(50, 20).find(data[start:start + 50])[0] + start
        assert len(inside) and set(inside.tolist()) <= whole
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 64)
    assert set(Anchors(50, 20).find(data)[0].tolist()) == whole


def test_suffix_order_is_sorted_by_group_and_bytes():
    chance = np.random.default_rng(2)
    data = chance.integers(0, 2, (700, 12)).astype(np.uint8)
    group = np.sort(chance.integers(0, 9, 700))
    order = SuffixOrder(data, group)
    rows = [(int(group[i]), data[i].tobytes()) for i in order.order]
    assert rows == sorted(rows)
    for depth in (0, 3, 12):
        number = order.classes(depth)
        keys = [(int(g), d.tobytes()[:depth]) for g, d in zip(group, data, strict=True)]
        assert len(set(number)) == len(set(keys)) == len(set(zip(number, keys, strict=True)))


def test_colliding_hashes_are_noticed(monkeypatch):
    data = np.array([[1, 2, 3], [1, 2, 4], [1, 1, 9]], np.uint8)
    monkeypatch.setattr(suffix_dedup, "_SMALL_BASES", [np.uint64(0), np.uint64(0x100000001B3)])
    order = SuffixOrder(data, np.zeros(3, np.int64))
    assert order.order.tolist() == [2, 0, 1] and order.equal.tolist() == [0, 1, 2]


@pytest.mark.parametrize("hot", [20_000, 10])
def test_long_runs_of_repeated_bytes(spark, hot, monkeypatch):
    """Runs of one byte and of short periods, in several documents, send few rows."""
    sent = []
    whole = suffix_dedup.whole_strings
    monkeypatch.setattr(suffix_dedup, "whole_strings", lambda *a: sent.append(len(a[0])) or whole(*a))
    rows = [(1, "start " + "-" * 30_000 + " first end"), (2, "other " + "-" * 20_000 + "|" + "-" * 45 + " second " + "ab" * 4000),
            (3, "ab" * 300 + "third " + "=" * 2000 + "-" * 10), (4, "=" * 5000 + "ba" * 100), (4, "x" + "=" * 3000 + "-" * 60),
            (None, "abc" * 500 + "-" * 700)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    assert collected(suffix_dedup.suffix_dedup(frame, hot_anchor=hot), *NAMES) == brute(rows)


def test_equal_rows_of_a_text_are_sent_once():
    text = b"head" + b"-" * 60_000 + b"tail"
    places = np.arange(4, 4 + 60_000 - 20)
    rows = suffix_dedup.surroundings(text, places, 1, (5, 6), 50, 20)
    kept, larger, repeats = suffix_dedup.smallest_of_equal(rows)
    assert len(kept) < 100 and not len(larger) and len(kept) + len(repeats) == len(rows)
    assert [x.tolist() for x in suffix_dedup._marks(repeats)] == [[5], [6], [0], [0]]
    other = suffix_dedup.surroundings(text + b"!", places, 2, (7, 8), 50, 20)
    kept, larger, _ = suffix_dedup.smallest_of_equal(suffix_dedup._Rows.join([rows, other]))
    assert len(kept) < 100 and 0 < len(larger) < 100


def test_all_occurrences_of_marked_strings():
    chance = np.random.default_rng(6)
    for _ in range(30):
        text = bytes(chance.choice([97, 98], 300).tolist())
        length = 5
        begins = chance.random(296) < 0.02
        strings = {text[i:i + length] for i in np.flatnonzero(begins)}
        want = [text[i:i + length] in strings for i in range(296)]
        if begins.any():
            assert suffix_dedup.all_occurrences(text, begins, length).tolist() == want


@pytest.mark.parametrize("hot", [20_000, 1])
def test_what_lies_between_two_covered_strings_is_covered_only_there(spark, hot):
    chance, rows = random.Random(9), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    for group in range(12):
        word = "".join(chance.choice(letters) for _ in range(90))
        gap = chance.randrange(2, 40)
        between = word[gap // 2:gap // 2 + 50]
        rows += [(3 * group, f"1{word[:50]}1"), (3 * group + 1, f"2{word[gap:gap + 50]}2"),
                 (1000 + group, f"#{between}# {word[:gap + 50]} ({between})")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert any(w[3] == 1 and w[2] < 100 for w in want)
    assert collected(suffix_dedup.suffix_dedup(frame, hot_anchor=hot), *NAMES) == want
