"""Hard negatives against plain inner products of all pairs."""

import math
import random

import numpy as np
import pytest

from shelfloom.llm import hard_negatives
from tests.llm.cases import collected

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, rank string, `a.b` string, id string"


def usable(rows):
    out = {}
    for name, vector, label in rows:
        if name is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if any(abs(math.floor(256 * x)) >= 1 << 26 for x in vector):
            continue
        held = (label, [math.floor(256 * x) for x in vector])
        out[name] = min(out.get(name, held), held)
    return out


def brute(rows, every=100):
    kept, out = usable(rows), []
    for anchor, (label, vector) in kept.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v, strict=False)), name, other)
                        for name, (other, v) in kept.items() if name != anchor)
        for p_score, positive, _ in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and 80 * -p_score <= 100 * -s[0] <= 100 * -p_score][:5]
            out += [(anchor, positive, rank, name, -p_score, -score) for rank, (score, name, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every=100):
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    return collected(hard_negatives.hard_negatives(hard_negatives.prepared(frame), every), *NAMES)


def vectors(seed, count, width=20, spread=0.4):
    chance = random.Random(seed)
    centres = [[chance.uniform(-1, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [c + chance.uniform(-spread, spread) for c in chance.choice(centres)], chance.randrange(3))
            for i in range(-40, count)]


@pytest.mark.parametrize("spread", [0.4, 900.0])
def test_equals_all_pairs(spark, spread):
    rows = vectors(5, 400, spread=spread)
    rows += [(1000 + i, rows[45][1], i % 3) for i in range(60)]  # ties
    want = brute(rows, 20)
    assert len(want) > 100
    assert mined(spark, rows, 20) == want


def test_blocks_and_tiles_add_up(spark, monkeypatch):
    for name, size in (("BLOCK", 7), ("_TABLES", 3), ("_ROWS", 11)):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = vectors(6, 260)
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_lookups_equal_products():
    chance = np.random.default_rng(1)
    for largest in (1, 2, 255, 256, 2**25):
        for rows, width in ((1, 8), (5, 16), (40, 64)):
            a, b = (chance.integers(-largest, largest, (n, width), endpoint=True) for n in (rows, 3))
            planes, _ = hard_negatives.bit_planes(a)
            assert (hard_negatives.scores(planes, hard_negatives.subset_sums(b)) == a @ b.T).all()


def test_defined_cases(spark):
    rows = vectors(7, 120)
    rows += [(None, [1.0] * 20, 1), (200, None, 1), (300, [1.0] * 20, None), (400, [1.0, None], 1), (500, [math.nan], 1),
             (600, [math.inf, 1.0], 1), (700, [1e9] * 20, 1), (800, [], 2), (900, [2.0, -1.0, 0.5], 0), (901, [2.0] * 31, 0),
             (100, rows[60][1], 0), (100, rows[61][1], 0), (5, rows[45][1], rows[45][2]), (1000, [0.0] * 20, 0)]
    want = brute(rows, 20)
    assert {r[0] for r in want} >= {1000}
    assert mined(spark, rows, 20) == want
    assert mined(spark, []) == []
    lonely = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [1.0, 2.0], 2)]
    assert mined(spark, lonely) == []
