"""Near-duplicates against all pairs of a small table."""

import random
from itertools import combinations
import re

import numpy as np
import pytest
import xxhash

from shelfloom.llm import simhash
from shelfloom.llm.components import components
from tests.llm.cases import collected, edge_documents, empty_documents, rows_of

NAMES = ("doc_id", "fingerprint", "component_id")


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids, prints):
    marks, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(marks)):
        for j in np.flatnonzero(np.bitwise_count(marks[i + 1:] ^ marks[i]) <= 2) + i + 1:
            root[find(i)] = find(int(j))
    least = {}
    for i, doc in enumerate(ids):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(known, doc)
    return sorted(((doc, f"{prints[i]:016x}", least[find(i)]) for i, doc in enumerate(ids)), key=repr)


def test_equals_all_pairs_on_documents(spark):
    rows = rows_of("documents")
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id bigint, text string")
    want = grouped([r["doc_id"] for r in rows], [plain_fingerprint(r["text"]) for r in rows])
    assert collected(simhash.near_duplicates(frame), *NAMES) == want


def test_equals_all_pairs_on_chains_of_copies(spark):
    chance = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = []
    for family in range(12):
        text = [chance.choice(words) + str(chance.randrange(300)) for _ in range(400)]
        for _ in range(14):
            text = text[:]
            text[chance.randrange(len(text))] = chance.choice(words)
            rows.append((chance.randrange(10**6), " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = [plain_fingerprint(t) for _, t in rows]
    want = grouped([d for d, _ in rows], prints)
    assert len({w[2] for w in want}) < len(set(prints))  # there are links between different texts
    assert collected(simhash.near_duplicates(frame), *NAMES) == want


def test_defined_cases(spark):
    frame = edge_documents(spark)
    rows = frame.collect()
    want = grouped([r["doc_id"] for r in rows], [plain_fingerprint(r["text"]) for r in rows])
    assert collected(simhash.near_duplicates(frame), *NAMES) == want
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("size", [3, 200, 900])
def test_links_within_one_list(size):
    """Short lists compare pairs, long ones look up what is in reach; both reach the same."""
    chance = np.random.default_rng(3)
    base = np.uint64(0xABCDEF0123456789)
    low = chance.choice(65536, size, replace=False).astype(np.uint64)
    entries = np.unique((base & ~np.uint64(0xFF0000FF)) | ((low & np.uint64(0xFF)) | ((low >> np.uint64(8)) << np.uint64(24))))
    near = np.bitwise_count(entries[:, None] ^ entries[None, :]) <= 2
    want = entries.copy()
    for _ in range(size):
        want = np.where(near, want[None, :], np.uint64(2**64 - 1)).min(axis=1)
    assert (simhash._groups(entries, 2) == want).all()


def test_every_near_pair_meets_in_a_list(spark):
    chance = random.Random(9)
    prints = [chance.getrandbits(64) for _ in range(200)]
    near = [p ^ (1 << a) ^ (1 << b) for p in prints for a, b in [(chance.randrange(64), chance.randrange(64))]]
    signed = [simhash._signed(x) for x in {*prints, *near}]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    found = {r["node"]: r["component"] for r in components(links).collect()}
    for a, b in zip(prints, near, strict=True):
        assert a == b or found[simhash._signed(a)] == found[simhash._signed(b)]


def test_common_lists_are_the_count_filter(spark):
    """Two fingerprints are in a common list exactly if they share six of eight positional bytes or more."""
    chance = random.Random(10)
    first = chance.getrandbits(64)
    prints = {first}
    for count in range(9):
        for _ in range(6):
            mask = sum(0xFF << 8 * i for i in chance.sample(range(8), count))
            prints.add(first ^ (chance.getrandbits(64) & mask))
    masks = [sum(0xFF << 8 * i for i in chosen) for chosen in combinations(range(8), 6)]
    for a in prints:
        for b in prints:
            common = any(a & mask == b & mask for mask in masks)
            tally = sum((a >> 8 * i) & 0xFF == (b >> 8 * i) & 0xFF for i in range(8))
            assert common == (tally >= 6)
            assert simhash.shared_bytes(np.array([a ^ b], np.uint64))[0] == tally


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (7, 7)]
    found = dict(collected(components(spark.createDataFrame(links, "a bigint, b bigint")), "node", "component"))
    assert {found[i] for i in range(301)} == {0} and {found[i] for i in range(1000, 1200)} == {1000}
    assert 5000 not in found
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
