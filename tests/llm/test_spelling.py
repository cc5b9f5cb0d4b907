"""Spelling variants against plain edit distances of all pairs of words."""

import random
import re
import zlib

from shelfloom.llm import spelling
from tests.llm.cases import collected, edge_documents, empty_documents

NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    counts = {}
    for doc, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    out, forms = {}, {}
    for word, n in counts.items():
        near = [w for w in counts if abs(len(w) - len(word)) <= 1 and distance(w, word) == 1]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best and counts[best] >= 10 * n else None
        forms[word] = form
        out[word] = (n, len(near), counts[form] if form else None)
    rows = []
    for word, form in forms.items():
        root = word
        while forms[root]:
            root = forms[root]
        rows.append((word, form, root, *out[word]))
    return sorted(rows, key=repr)


def noisy_texts():
    """Words with one or two changed letters, in numbers from 2 to 300, and chains of three forms."""
    chance, rows = random.Random(12), []
    words = ["".join(chance.choice("abceéÿ") for _ in range(chance.randrange(7, 12))) for _ in range(25)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "abababa"]
    for word in list(words):
        for _ in range(6):
            letters = list(word)
            for _ in range(chance.randrange(1, 3)):
                at = chance.randrange(len(letters))
                letters[at:at + 1] = chance.choice([[], ["x"], [letters[at], "é"], ["A"]])
            words.append("".join(letters))
    for doc in range(60):
        rows.append((doc, ", ".join(chance.choice(words) for _ in range(chance.choice([0, 5, 40])))))
    for times, word in ((2, "colourful"), (25, "colorful"), (2, "colorfull"), (300, "colerful"), (2, "cölourful")):
        rows.append((100 + times, f"{word} " * times))
    return rows


def test_equals_all_pairs(spark):
    rows = noisy_texts()
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert collected(spelling.spelling_variants(frame), *NAMES) == want


def test_scan_equals_all_pairs():
    chance = random.Random(3)
    for size in (1, 2, 9, 60, 200):
        words = sorted({"".join(chance.choice("abé") for _ in range(chance.randrange(5, 9))) for _ in range(size)})
        want = {(i, k) for i in range(len(words)) for k in range(i + 1, len(words)) if distance(words[i], words[k]) == 1}
        assert set(spelling.one_edit_pairs(words)) == want


def test_partial_counts_add_up(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 3)
    rows = noisy_texts()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert collected(spelling.spelling_variants(frame), *NAMES) == brute(rows)


def test_defined_cases(spark):
    frame = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    long = "a" * 30_000
    rows += [(50, long), (51, long), (52, long + "a"), (53, long + "a"), (54, long[1:]), (54, long[1:])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = collected(spelling.spelling_variants(frame), *NAMES)
    short = [r for r in brute(rows[:-6])]
    assert [r for r in found if len(r[0]) < 9000] == [r for r in short if len(r[0]) < 9000]
    assert sorted((len(r[0]), r[4]) for r in found if len(r[0]) > 9000) == [(29_999, 1), (30_000, 2), (30_001, 1)]
    assert spelling.spelling_variants(empty_documents(spark)).count() == 0
