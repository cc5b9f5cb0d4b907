"""Quality classifier: Bradley-Terry pairwise ranking on counts of a text.

Each text gets a row of simple features. The model learns one score for each document
from preference pairs: a document labelled 1 is preferred to one labelled 0, and the
logistic loss of the difference of their scores is minimised, that is, of the weights
times the difference of their features. The cut is a quantile of the scores of the
labelled documents, each class weighted by its share of all labels: the quantile whose
split agrees best with the labels. ``score`` is the logistic of the distance to the cut,
moved so that the cut lies at 0.7.

The model is fitted on a bounded sample: about ``labelled_per_class`` labelled documents
of each class, chosen by a hash of their id, and ``pairs`` pairs of them. These bounds are
parameters. Counts of labels cover the whole table, and every document is scored.

Defined results: labels other than 0 and 1, and documents without an id, teach nothing; a
null text counts as empty, and the empty text has a score like any other; without labels of
both classes every score is 0.7 and every document is accepted; repeated rows each get a
row and equal texts equal scores; extra columns are never read.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, filtered, id_type, slices

LABELLED_PER_CLASS = 8_000
PAIRS = 60_000
THRESHOLD = 0.7

_SYMBOLS = b"#*$%&|<>@^~=+_{}[]\\/"
_ENDS = b".,;:!?"


def _keep(chars: bytes) -> bytes:
    return bytes(b for b in range(256) if b not in chars)


_NOT_SYMBOLS, _NOT_ENDS = _keep(_SYMBOLS), _keep(_ENDS)
_NOT_DIGITS, _NOT_CAPITALS = _keep(b"0123456789"), _keep(bytes(range(65, 91)))
_ASCII = bytes(range(128))

FEATURES = (
    "log_words", "mean_word", "spread_word", "log_longest_word", "symbols", "root_symbols", "ends", "digits",
    "root_digits", "capitals", "root_capitals", "beyond_ascii", "different_words", "same_as_before", "root_same_as_before",
    "top_word", "repeated_pairs", "words_per_line", "repeated_lines", "one_letter_words", "no_letter_words",
    "root_no_letter_words", "empty",
)


def features(text: bytes) -> list:
    """The features of a text, in the order of ``FEATURES``."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    lengths = np.fromiter(map(len, words), np.int64, n)
    size = int(lengths.sum())
    symbols = len(text.translate(None, _NOT_SYMBOLS)) / size
    digits = len(text.translate(None, _NOT_DIGITS)) / size
    capitals = len(text.translate(None, _NOT_CAPITALS)) / size
    times = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:])))  # noqa: B905  the last word starts no pair
    lines = [line for line in text.split(b"\n") if line]
    bare = sum(c for w, c in times.items() if w.isascii() and not w.strip(b"0123456789" + _SYMBOLS + _ENDS + b"()-'\"")) / n
    return [
        np.log1p(n), size / n, float(lengths.std()), np.log1p(int(lengths.max())), symbols, symbols ** 0.5,
        len(text.translate(None, _NOT_ENDS)) / n, digits, digits ** 0.5, capitals, capitals ** 0.5,
        len(text.translate(None, _ASCII)) / size, len(times) / n ** 0.8, same, same ** 0.5, max(times.values()) / n,
        1 - pairs / max(1, n - 1), np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        int((lengths == 1).sum()) / n, bare, bare ** 0.5, 0.0,
    ]


@dataclass
class Ranking:
    """Scores are ``(features - mean) / scale @ weights``; ``cut`` is the score of 0.7."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float = THRESHOLD

    def raw(self, rows: np.ndarray) -> np.ndarray:
        # Features far beyond all labelled texts count as far, not as infinitely far.
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        at_cut = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.raw(rows) - self.cut + at_cut, -60, 60)))


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs: int, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights of least logistic loss on the differences of ``pairs`` pairs, by Newton's steps."""
    chance = np.random.default_rng(7)
    gap = better[chance.integers(0, len(better), pairs)] - worse[chance.integers(0, len(worse), pairs)]
    weights = np.zeros(gap.shape[1])
    for _ in range(steps):
        lost = 1 / (1 + np.exp(np.clip(gap @ weights, -40, 40)))
        slope = gap.T @ lost / pairs - ridge * weights
        bend = (gap * (lost * (1 - lost))[:, None]).T @ gap / pairs + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return weights


def best_cut(scores: np.ndarray, good: np.ndarray, weight: np.ndarray) -> float:
    """The quantile of the scores whose split agrees best with the labels.

    Of quantiles that agree equally the middle one is taken, so the cut lies halfway in a
    gap between the classes.
    """
    order = np.argsort(scores, kind="stable")
    s, g, w = scores[order], good[order], weight[order]
    agree = np.concatenate(([(w * g).sum()], (w * g).sum() + np.cumsum(np.where(g, -w, w))))
    places = np.flatnonzero(agree >= agree.max() - 1e-12)
    at = int(places[len(places) // 2])
    if at == 0:
        return float(s[0])
    return float((s[at - 1] + s[at]) / 2) if at < len(s) else float(s[-1] + 1)


def _rows(column: pa.Array) -> np.ndarray:
    return np.array([features(t or b"") for t in as_bytes(column)], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", labelled_per_class: int = LABELLED_PER_CLASS, pairs: int = PAIRS) -> Ranking:
    """Learn from the documents that ``labels`` names; see the bounds above."""
    marked = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("doc").isNotNull() & F.col("label").isin(0, 1))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    if len(counts) < 2:
        return nothing
    share = F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    wanted = F.when(F.col("label") == 1, labelled_per_class / counts[1]).otherwise(labelled_per_class / counts[0])
    # About 2 * labelled_per_class narrow rows at most, so their size is bounded.
    sample = F.broadcast(marked.filter(share < wanted))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(_rows(batch.column(1))), pa.list_(pa.float64()))], ["label", "features"])

    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    taught = texts.join(sample, "doc").select("label", "text").mapInArrow(measured, "label int, features array<double>")
    found = taught.collect()
    good = np.array([r["label"] == 1 for r in found], bool)
    if not len(found) or good.all() or not good.any():
        return nothing
    rows = np.array([r["features"] for r in found])
    order = np.lexsort((*rows.T, good))  # whatever order the rows came in
    rows, good = rows[order], good[order]
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    made = Ranking(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(rows.shape[1]), 0.0)
    level = np.clip((rows - made.mean) / made.scale, -8, 8)
    made.weights = fit_pairs(level[good], level[~good], pairs)
    weight = np.where(good, counts[1] / good.sum(), counts[0] / (~good).sum()) / sum(counts.values())
    made.cut = best_cut(level @ made.weights, good, weight)
    return made


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ranking.score(_rows(batch.column(1))))], ["doc_id", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(scored, f"doc_id {id_type(docs, id_col)}, score double")


def is_held_out(doc_id, parts: int = 4, left_out: int = 2):
    """Rows whose labels are not to be learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == left_out, F.lit(False))


def taught_by(docs: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking of the registered query and the pipeline, which leave one row in four out."""
    return fit(docs, labels.filter(~is_held_out(F.col("doc_id"))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs, taught_by(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    ranking = taught_by(docs, labels)
    return filtered(docs, text_col, lambda texts: ranking.score(_rows(texts)) >= THRESHOLD)
