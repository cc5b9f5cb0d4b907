"""Language identification: held-out accuracy, backoff, and defined cases."""

import re
import zlib
from collections import Counter
from math import exp, log

from shelfloom.llm import language
from tests.llm.cases import collected, edge_documents, empty_documents

LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert found.count() == docs.count()


def test_held_out_languages_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    turned = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'xx' ELSE lang END AS lang",
                             "'other' AS source")
    assert collected(language.identify(docs), "doc_id", "lang_pred", "score") == \
        collected(language.identify(turned), "doc_id", "lang_pred", "score")


def test_words_first_then_shorter_grams():
    model = language.LanguageModel(
        ["de", "en"], {"haus": [5, 0], "house": [0, 5]},
        {"haus$": [4, 0], "ouse$": [0, 4], "aus$": [4, 0], "us": [5, 6], "zz": [1, 9], "z": [2, 8], "h": [9, 1]})
    assert (model.word_scores("haus") == model.words["haus"]).all()
    assert (model.word_scores("grouse") == model.grams["ouse$"]).all()  # five characters
    assert (model.word_scores("klaus") == model.grams["aus$"]).all()  # then four
    assert (model.word_scores("izzo") == model.grams["zz"]).all()  # then two
    assert (model.word_scores("oh") == model.grams["h"]).all()  # then one
    assert (model.word_scores("ooo") == 0).all()
    assert model.predict("Haus")[0] == "de" and model.predict("12 house!")[0] == "en"
    assert model.predict("ooo") == ("de", 0.5)  # equal: the first by name


def test_defined_cases(spark):
    docs = edge_documents(spark)
    rows = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language.identify(docs).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (12, "und", False)} <= rows
    assert all(0 <= r["score"] <= 1 for r in language.identify(docs).collect())
    assert language.identify(docs).count() == docs.count()
    none = language.predict(docs, language.fit(docs.filter("lang IS NULL")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(empty_documents(spark)).count() == 0


def test_letters_only():
    assert language.word_counts("Été ½a b2c _d_ 日本 x½") == {"été": 1, "a": 1, "b": 1, "c": 1, "d": 1, "日本": 1, "x": 1}
    assert not language.word_counts("½ 12 ... _")


def plain_words(text):
    return [w for w in re.split("[^a-zA-Z\u00aa-\U0010ffff]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())) if w]


def plain_grams(word):
    marked = f"^{word}$"
    yield from word
    for size in range(2, 6):
        yield from (marked[i:i + size] for i in range(len(marked) - size + 1))


def test_equals_a_plain_scorer(spark):
    """Counts and scores text by text, without tables of scores or batches."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    words, grams = {}, {}
    for doc, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc).encode()) % 3 != 1:
            for word in plain_words(text):
                words.setdefault(word, Counter())[lang] += 1
    for word, counts in words.items():
        for gram in plain_grams(word):
            for lang, n in counts.items():
                grams.setdefault(gram, Counter())[lang] += n

    def most(table):
        return dict(sorted(table.items(), key=lambda x: (-sum(x[1].values()), x[0]))[:60_000])

    languages = sorted({lang for counts in words.values() for lang in counts})
    words, grams = most(words), most(grams)
    totals = {0: {lang: sum(c[lang] + 0.5 for c in words.values()) for lang in languages}}
    for size in range(1, 6):
        totals[size] = {lang: sum(c[lang] + 0.5 for g, c in grams.items() if len(g) == size) for lang in languages}

    def of_word(word, lang):
        if word in words:
            return log((words[word][lang] + 0.5) / totals[0][lang])
        for size in range(5, 0, -1):
            marked = word if size == 1 else f"^{word}$"
            met = [g for g in (marked[i:i + size] for i in range(len(marked) - size + 1)) if g in grams]
            if met:
                return sum(log((grams[g][lang] + 0.5) / totals[size][lang]) for g in met) / len(met)
        return 0.0

    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    assert len(found) == len(rows)
    for doc, text, _ in rows[::9]:
        counts = Counter(plain_words(text))
        if not counts:
            assert found[doc] == ("und", 0.0)
            continue
        sums = {lang: sum(n * of_word(w, lang) for w, n in counts.items()) for lang in languages}
        best = max(languages, key=lambda lang: sums[lang])
        assert found[doc][0] == best
        assert abs(found[doc][1] - 1 / sum(exp(max(-700, s - sums[best])) for s in sums.values())) < 1e-6
