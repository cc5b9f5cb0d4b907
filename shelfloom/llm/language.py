"""Language identification, words first, then ever shorter character n-grams.

A text's words are its lower-cased runs of letters. A word of the model's table is scored
by the logarithm of its frequency in each language. A word that is not there is scored by
its character n-grams, with ``^`` and ``$`` at its ends: by the mean log frequency of those
known of the longest length, or else of the next shorter length, down to single characters.
A word with no known character counts for no language. The language with the highest sum is
predicted, the first by name among equals; ``score`` is its share of the likelihood.

The model is fitted on a bounded sample: about ``docs_per_language`` documents of each
language, chosen by a hash of their id; it keeps the ``max_words`` most frequent words and
the ``max_grams`` most frequent n-grams. These bounds are parameters and also bound what
is sent to the tasks. Counts of documents cover the whole table and every text is predicted.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every
text if there is nothing to learn from; documents without id, text or language teach nothing;
repeated rows each get a row; extra columns are never read.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, id_type, slices
from shelfloom.session import settle

DOCS_PER_LANGUAGE = 5_000
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
LONGEST_GRAM = 5
UNKNOWN = "und"

# Scores of unseen words that a task keeps.
KNOWN_BACKOFFS = 150_000

_RUNS = re.compile(r"[^\W\d_]+").findall
_SMOOTHING = 0.5


def word_counts(text: str) -> Counter:
    """How often each word of letters occurs in a text."""
    counts = Counter(_RUNS(text.lower()))
    # The pattern also takes numerals that are no digits.
    for word in [w for w in counts if not w.isalpha()]:
        times = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += times
    return counts


def grams(word: str, size: int) -> list:
    marked = f"^{word}$"
    if size == 1:
        return list(word)
    return [marked[i:i + size] for i in range(len(marked) - size + 1)]


class LanguageModel:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, languages: list, words: dict, gram_counts: dict):
        self.languages, self.longest = languages, LONGEST_GRAM
        self.words = dict(zip(words, _log_frequencies(list(words.values()), len(languages)), strict=True))
        self.grams = {}
        for size in range(1, LONGEST_GRAM + 1):
            of_size = {g: c for g, c in gram_counts.items() if len(g) == size}
            self.grams |= zip(of_size, _log_frequencies(list(of_size.values()), len(languages)), strict=True)
        self.backoffs = {}
        self.none = np.zeros(len(languages))

    def backoff(self, word: str) -> np.ndarray:
        known = self.grams
        for size in range(self.longest, 0, -1):
            met = [known[g] for g in grams(word, size) if g in known]
            if met:
                return sum(met) / len(met)
        return self.none

    def word_scores(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is None:
            found = self.backoffs.get(word)
            if found is None:
                found = self.backoff(word)
                if len(self.backoffs) < KNOWN_BACKOFFS:
                    self.backoffs[word] = found
        return found

    def predict(self, text: str) -> tuple:
        """(language, score) of a text."""
        counts = word_counts(text or "")
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        rows = np.array([self.word_scores(w) for w in counts])
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ rows
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _log_frequencies(counts: list, languages: int) -> np.ndarray:
    if not counts:
        return np.empty((0, languages))
    table = np.array(counts, np.float64) + _SMOOTHING
    return np.log(table / table.sum(axis=0))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_language: int = DOCS_PER_LANGUAGE, max_words: int = MAX_WORDS,
        max_grams: int = MAX_GRAMS) -> tuple:
    """(languages, words, n-grams) with their counts by language, learnt from ``docs``."""
    taught = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("doc").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], {}, {}
    share = F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    wanted = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(docs_per_language / counts[lang]))])
    sample = taught.filter(share < wanted[F.col("lang")]).select("lang", "text")

    def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(word_counts(text))
            rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
            yield _counted(rows)

    def counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams(word, size):
                        found[lang, gram] += n
            yield _counted([(*key, n) for key, n in found.items()])

    kind = "lang string, term string, n bigint"
    words = settle(sample.mapInArrow(counted_words, kind).groupBy("lang", "term").agg(F.sum("n").alias("n")), "words")
    gram_counts = words.mapInArrow(counted_grams, kind)
    return languages, _most_frequent(words, languages, max_words), _most_frequent(gram_counts, languages, max_grams)


def _counted(rows: list) -> pa.RecordBatch:
    lang, term, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64())], ["lang", "term", "n"])


def _most_frequent(counts: DataFrame, languages: list, most: int) -> dict:
    """term -> its counts by language, for the ``most`` terms with the highest counts."""
    by_language = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}")
                   for i, lang in enumerate(languages)]
    rows = counts.groupBy("term").agg(F.sum("n").alias("total"), *by_language).orderBy(
        F.desc("total"), "term").limit(most).collect()
    return {r["term"]: [r[f"n{i}"] for i in range(len(languages))] for r in rows}


def predict(docs: DataFrame, fitted: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in slices(batches):
            model = model or LanguageModel(*sent.value)
            made = [model.predict((t or b"").decode()) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(predicted, f"doc_id {id_type(docs, id_col)}, lang_pred string, score double")


def is_held_out(doc_id, parts: int = 3, left_out: int = 1):
    """Rows that are not to be learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == left_out, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learnt from the rows not held out."""
    fitted = fit(docs.filter(~is_held_out(F.col("doc_id"))))
    return predict(docs, fitted).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
