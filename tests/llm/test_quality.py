"""Pairwise ranking: held-out accuracy, its cut, and defined cases."""

import numpy as np
import pytest

from shelfloom.llm import quality
from tests.llm.cases import FOLDER, collected, edge_documents, empty_documents

LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    judged = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    rows = judged.select("predicted", "quality").collect()
    assert len(rows) > 60
    assert sum(r[0] == r[1] for r in rows) >= 0.95 * len(rows)
    assert quality.classify(docs, labels).count() == docs.count()


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality "
                               "END AS quality", "toxic")
    assert collected(quality.classify(docs, labels), "doc_id", "score") == collected(quality.classify(docs, turned), "doc_id", "score")


def test_defined_cases(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(4, 1), (9, 1), (11, 0), (12, 0), (None, 1), (5, None), (6, 7), (9, 1)],
                                   "doc_id bigint, quality int")
    ranking = quality.fit(docs, labels)
    rows = quality.score(docs, ranking).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    judged = {r["doc_id"]: r["score"] >= quality.THRESHOLD for r in rows}
    assert judged[9] and judged[4] and not judged[11] and not judged[12]
    for few in (labels.limit(0), labels.filter("quality = 1")):
        assert [r["score"] for r in quality.score(docs, quality.fit(docs, few)).collect()] == pytest.approx([0.7] * docs.count())
        assert {r["predicted"] for r in quality.classify(docs, few).collect()} == {1}
    assert quality.classify(empty_documents(spark), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.keep_good(empty_documents(spark), labels).count() == 0


def test_pairs_learn_an_order():
    chance = np.random.default_rng(0)
    better, worse = chance.normal(1, 1, (400, 3)), chance.normal(0, 1, (400, 3))
    weights = quality.fit_pairs(better, worse, 5000)
    assert (weights > 0).all() and (better @ weights).mean() > (worse @ weights).mean() + 1


def test_cut_is_in_the_middle_of_the_gap():
    scores, good = np.array([1.0, 2.0, 5.0, 6.0]), np.array([False, False, True, True])
    assert quality.best_cut(scores, good, np.ones(4)) == 3.5
    assert quality.best_cut(scores, np.ones(4, bool), np.ones(4)) <= 1.0
    # Ties are never split.
    tied = np.array([1.0, 1.0, 1.0, 2.0])
    cut = quality.best_cut(tied, np.array([False, True, True, True]), np.ones(4))
    assert cut <= 1.0 or cut > 1.0 and (tied >= cut).sum() in (0, 1, 4)


def test_features_of_odd_texts():
    for text in (b"", b" ", b"a", b"\x00", "é日".encode(), b"--- ... ###", b"x" * 10**6, b"a " * 10**5):
        row = quality.features(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()


def test_weights_are_those_of_least_pair_loss():
    """Against a plain descent on the loss of the same pairs, from another start."""
    chance = np.random.default_rng(3)
    better, worse = chance.normal(0.6, 1, (60, 4)), chance.normal(0, 1, (50, 4))
    pairs, ridge = 900, 1e-3
    weights = quality.fit_pairs(better, worse, pairs, ridge)
    drawn = np.random.default_rng(7)
    gap = better[drawn.integers(0, 60, pairs)] - worse[drawn.integers(0, 50, pairs)]

    def loss(w):
        return np.mean(np.log1p(np.exp(-gap @ w))) + ridge / 2 * w @ w

    plain = np.ones(4)
    for _ in range(20_000):
        plain = plain - 0.3 * (ridge * plain - gap.T @ (1 / (1 + np.exp(gap @ plain))) / pairs)
    assert np.abs(plain - weights).max() < 1e-5
    assert all(loss(weights) <= loss(weights + chance.normal(0, 0.01, 4)) for _ in range(200))


def test_scores_equal_a_plain_form(spark):
    """Score by score from the written model: features, standardised and clipped, weighted, put through the logistic curve."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    ranking = quality.taught_by(docs, labels)
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.classify(docs, labels).collect()}
    for row in docs.collect():
        total = 0.0
        for value, mean, scale, weight in zip(quality.features((row["text"] or "").encode()), ranking.mean, ranking.scale,
                                              ranking.weights, strict=True):
            total += max(-8.0, min(8.0, (value - mean) / scale)) * weight
        odds = np.exp(max(-60.0, min(60.0, total - ranking.cut + np.log(0.7 / 0.3))))
        score, predicted = found[row["doc_id"]]
        assert abs(score - odds / (1 + odds)) < 1e-9 and predicted == (score >= 0.7)
