"""Benchmark decontamination against plain windows of words."""

import re

import pytest

from shelfloom.llm import decontaminate
from tests.llm.cases import collected, edge_documents, empty_documents, rows_of, sha

NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for window in [tuple(w)] if 0 < len(w) < size else [tuple(w[i:i + size]) for i in range(len(w) - size + 1)]:
            if item is not None:
                windows.setdefault(window, set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for length in {len(x) for x in windows}:
            for i in range(len(w) - length + 1):
                found = windows.get(tuple(w[i:i + length]))
                if found:
                    hit |= set(range(i, i + length))
                    met |= found
        out.append((doc, len(w), len(hit), len(met), sha(",".join(sorted(map(str, met)))), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [32 << 20, 1500])
def test_equals_brute_force_on_documents(spark, shard_bytes):
    docs = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    items = [(r["item_id"], r["text"]) for r in rows_of("benchmark")]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"), shard_bytes=shard_bytes)
    want = brute(docs, items)
    assert collected(found, *NAMES) == want and any(w[-1] for w in want)


ITEMS = [(1, "one two"), (1, "three"), (2, None), (3, ""), (None, "a"), (4, "Word1 word2 word3 word4 word5 word6 word7 word8 "
         "word9 word10 word11"), (5, "日本語のテキスト"), (6, "one  TWO!"), (7, "word976 word0 word1")]


def test_defined_cases(spark):
    docs = edge_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.contamination(docs, items)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)
    assert collected(found, *NAMES) == want
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(empty_documents(spark), items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_spans_lie_on_the_original_text(spark):
    text = "Ünder — ONE,\n\ntwo; and then 日本語 One (two)!"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "one two")], "item_id bigint, text string")
    spans = decontaminate.scan(docs, items).first()["spans"]
    assert [text[s["start"]:s["end"]] for s in spans] == ["ONE,\n\ntwo", "One (two"]


def test_matches_across_the_fed_parts(monkeypatch):
    monkeypatch.setattr(decontaminate, "_FED", 7)
    automaton = decontaminate.build_automaton([(1, "bb cc dd"), (2, "dd ee")], 10)
    assert decontaminate.scan_text(b"aa bb cc dd ee ff", [automaton])[1].tolist() == [False, True, True, True, True, False]
