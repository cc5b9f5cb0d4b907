"""b-bit MinHash groups against the Jaccard similarity of all pairs."""

import random
import re

import numpy as np

from shelfloom.llm import bbit_minhash
from tests.llm.cases import collected, edge_documents, empty_documents, rows_of
from tests.llm.test_near_copies import near_texts

NAMES = ("doc_id", "n_shingles", "component_id", "kept")


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) <= 4:
        return frozenset([" ".join(words)] if words else [])
    return frozenset(" ".join(words[i:i + 4]) for i in range(len(words) - 3))


def brute(rows, percent=80):
    sets, root = [shingles(text) for _, text in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and (
                    100 * len(a & b) >= percent * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        first = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), first, rows[i][0] == first) for i in members]
    return sorted(out, key=repr)


def found(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return collected(bbit_minhash.minhash_duplicates(frame), *NAMES)


def test_equals_all_pairs(spark):
    for rows in (near_texts(), [(r["doc_id"], r["text"]) for r in rows_of("documents")]):
        want = brute(rows)
        assert sum(not r[3] for r in want) > 10
        assert found(spark, rows) == want


def test_buckets_of_unlike_texts_in_blocks(spark, monkeypatch):
    """A passage that most of each text consists of: they meet in buckets, few are similar."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 7)
    chance, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(120)]
    for family in range(12):
        own = [f"f{family}x{i}" for i in range(30)]
        for member in range(8):
            extra = [f"m{family}x{member}x{i}" for i in range(chance.choice([5, 15, 25, 40]))]
            rows.append((100 * family + member, " ".join(own + passage + extra)))
    want = brute(rows)
    assert 12 < len({r[2] for r in want}) < len(rows)
    assert found(spark, rows) == want


def test_chain_of_near_copies(spark):
    """Each text is similar to its neighbours only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(900 - i, " ".join(words[6 * i:6 * i + 100])) for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_estimate_is_corrected_for_chance():
    chance = np.random.default_rng(2)
    for percent in (0, 30, 80, 95):
        errors = []
        for _ in range(60):
            values = chance.integers(0, 2**63, 1000, dtype=np.uint64)
            shared = 1000 * percent // 100
            a = np.unique(values[:(1000 + shared) // 2])
            b = np.unique(np.concatenate((values[:shared], values[(1000 + shared) // 2:])))
            left, right = (np.frombuffer(bbit_minhash.packed(bbit_minhash.minima(x)), np.uint8) for x in (a, b))
            equal = bbit_minhash._EQUAL[left ^ right].sum()
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(bbit_minhash.estimated_similarity(equal) - true)
        assert abs(np.mean(errors)) < 0.02
    assert 0.5 < bbit_minhash.estimated_similarity(bbit_minhash.fewest_equal(80)) < 0.7


def test_long_sets_are_taken_in_pieces(monkeypatch):
    values = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64)
    whole = bbit_minhash.minima(values)
    monkeypatch.setattr(bbit_minhash, "_AT_ONCE", 37)
    assert (bbit_minhash.minima(values) == whole).all()


def test_defined_cases(spark):
    frame = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert collected(bbit_minhash.minhash_duplicates(frame), *NAMES) == brute(rows)
    assert bbit_minhash.minhash_duplicates(empty_documents(spark)).count() == 0


def test_parities_drop_no_similar_pair():
    chance = np.random.default_rng(5)
    kept = []
    for _ in range(200):
        a = np.unique(chance.integers(0, 2**63, chance.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate((a[chance.random(len(a)) < chance.choice([0.7, 0.9, 1])],
                                      chance.integers(0, 2**63, chance.integers(0, 40), dtype=np.uint64))))
        if len(b):
            x, y = (bbit_minhash._sketches([len(s)], [bbit_minhash.packed(bbit_minhash.minima(s))], [bbit_minhash.parities(s)])
                    for s in (a, b))
            kept.append((bbit_minhash.similar(a, b), bool(x.likely(y, 80)[0][0])))
    assert (True, False) not in kept and kept.count((True, True)) > 20 and kept.count((False, False)) > 20


def test_many_loose_copies_of_one_text(spark):
    """Copies with few and many changes: half of them are linked, the others resemble but are not similar."""
    chance, rows = random.Random(4), []
    text = [f"w{chance.randrange(900)}" for _ in range(120)]
    for doc in range(150):
        words = text[:]
        for _ in range(chance.choice([0, 1, 2, 3, 4, 6, 8])):
            words[chance.randrange(120)] = f"x{chance.randrange(10_000)}"
        rows.append((doc, " ".join(words)))
    want = brute(rows)
    assert 10 < len({r[2] for r in want}) < 100
    assert found(spark, rows) == want
