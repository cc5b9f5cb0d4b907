"""Near copies against the Jaccard similarity of all pairs."""

import random
import re

import numpy as np

import corpus_pipeline
from shelfloom.llm import near_copies
from tests.llm.cases import FOLDER, collected, edge_documents, empty_documents, rows_of


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) <= 5:
        return frozenset([" ".join(words)] if words else [])
    return frozenset(" ".join(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows, percent=80):
    """Groups of places in ``rows`` whose texts are linked."""
    sets, root = [shingles(text) for _, text in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (100 * min(len(a), len(b)) >= percent * max(len(a), len(b))
                          and 100 * len(a & b) >= percent * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def survivors(rows, groups):
    """Smallest id of each group; None where no row has one."""
    return sorted((min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in groups), key=repr)


def near_texts():
    """Families around a similarity of 0.8, chains, and a phrase that nearly all texts share."""
    chance, rows, number = random.Random(4), [], 0
    phrase = "this phrase stands in nearly all of the texts that are made here for the test"
    for family in range(40):
        text = [f"w{chance.randrange(4000)}" for _ in range(chance.choice([3, 6, 12, 30, 80, 250]))]
        for _ in range(chance.randrange(1, 9)):
            other = text[:]
            for _ in range(chance.randrange(0, 1 + len(text) // 30)):
                other[chance.randrange(len(other))] = f"w{chance.randrange(4000)}"
            number += 1
            rows.append((9000 - number, " ".join(other) + (f" {phrase}" if family % 4 else "")))
            if chance.random() < 0.5:
                text = other
    return rows


def test_groups_equal_all_pairs(spark):
    for rows in (near_texts(), [(r["doc_id"], r["text"]) for r in rows_of("documents")]):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        want = brute(rows)
        found = {}
        for doc, component in collected(near_copies.grouped_rows(frame), "doc", "component"):
            found.setdefault(component, []).append(doc)
        assert sorted(map(sorted, found.values())) == sorted(sorted(rows[i][0] for i in g) for g in want)
        assert len(want) < len({shingles(t) for _, t in rows})  # there are links between different texts


def test_stage_finds_pairs_of_eighty_percent(spark):
    """One changed word in a short text is more than two bits away, yet a near copy."""
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert [k[0] for k in collected(kept, "doc_id")] == survivors(rows, brute(rows))


def test_fingerprints_within_two_bits_propose_pairs(spark, monkeypatch):
    rows = near_texts()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    marked = near_copies.entries_of(frame, "doc_id", "text", 5, 80)
    sets = {r["entry"]: r["fp"] for r in marked.collect()}
    pairs = {(r["a"], r["b"]) for r in near_copies.indexed_pairs(marked.dropDuplicates(["entry"])).collect()}
    assert pairs and all(a < b and {a, b} <= set(sets) for a, b in pairs)
    root = {e: e for e in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    for a, x in sets.items():
        for b, y in sets.items():
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                assert find(a) == find(b)
    asked, whole = [], near_copies.indexed_pairs
    monkeypatch.setattr(near_copies, "indexed_pairs", lambda sets: asked.append(sets) or whole(sets))
    corpus_pipeline.drop_near_copies(spark, frame, FOLDER)
    assert asked


def test_order_of_shingles_does_not_matter(spark, monkeypatch):
    rows = near_texts()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_copies, "SAMPLE_BYTES", 2000)
    assert [k[0] for k in collected(near_copies.keep_one(frame), "doc_id")] == survivors(rows, brute(rows))


def test_all_texts_are_counted(spark, monkeypatch):
    """Also those beyond the bytes that were once sampled."""
    frame = spark.createDataFrame(near_texts(), "doc_id bigint, text string")
    counted, whole = [], near_copies.frequencies
    monkeypatch.setattr(near_copies, "SAMPLE_BYTES", 2000)
    monkeypatch.setattr(near_copies, "frequencies", lambda texts, *more: counted.append(texts.count()) or whole(texts, *more))
    near_copies.entries_of(frame, "doc_id", "text", 5, 80)
    assert counted == [len(near_texts())]


def test_any_order_of_shingles_finds_the_same(spark, monkeypatch):
    rows = near_texts()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    digits = np.random.default_rng(3).integers(0, 30, len(near_copies.frequencies(frame.select("text"), 5))).astype(np.uint8)
    monkeypatch.setattr(near_copies, "frequencies", lambda *_: digits)
    assert [k[0] for k in collected(near_copies.keep_one(frame), "doc_id")] == survivors(rows, brute(rows))


def test_defined_cases(spark):
    frame = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    kept = near_copies.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == survivors(rows, brute(rows))
    assert near_copies.keep_one(empty_documents(spark)).count() == 0


def test_texts_without_ids_or_with_reused_ids_stay(spark):
    words = [" ".join(f"{name}{i}" for i in range(20)) for name in "abcdef"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (7, words[2]), (7, words[3]), (7, words[3]),
            (8, words[4]), (9, words[4]), (9, words[5]), (None, words[5])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (8, words[4]), (9, words[5])]
    assert collected(corpus_pipeline.drop_near_copies(spark, docs, FOLDER), "doc_id", "text") == sorted(want, key=repr)


def test_postings_are_stored_once_and_lists_without_parities(spark, monkeypatch):
    stored, whole = [], near_copies.settle
    monkeypatch.setattr(near_copies, "settle", lambda df, name: stored.append((name, df)) or whole(df, name))
    near_copies.keep_one(spark.createDataFrame(near_texts(), "doc_id bigint, text string"))
    assert sum("posted" in df.columns for _, df in stored) == 1
    assert all("parity" not in df.schema.json() for name, df in stored if name == "near-lists")
    assert not any("shingles" in df.columns for _, df in stored)  # texts, not their sets


def test_copies_post_once_a_task(spark):
    rows = [(i, f"one two three four five six seven {i % 3}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    marked = near_copies.entries_of(frame, "doc_id", "text", 5, 80).collect()
    assert len(marked) == 60 and sum(r["posted"] is not None for r in marked) == 3


def test_rows_alone_in_their_group_are_not_shuffled(spark):
    words = [" ".join(f"{name}{i}" for i in range(20)) for name in "abcdefgh"]
    frame = spark.createDataFrame(list(enumerate(words + words[:1])), "doc_id bigint, text string")
    kept = near_copies.keep_one(frame)
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == list(range(8))
    plan = kept._jdf.queryExecution().sparkPlan()
    while plan.children().size() == 1:
        plan = plan.children().head()
    assert plan.nodeName() == "Union"
    alone = plan.children().head().toString()
    assert "LeftAnti" in alone and "BroadcastHashJoin" in alone and "SortMergeJoin" not in alone


def test_full_slots_lose_nothing(spark, monkeypatch):
    """With one word of slots nearly all hashes meet on wanted ones."""
    monkeypatch.setattr(near_copies, "SLOT_WORDS", 1)
    rows = near_texts()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [k[0] for k in collected(near_copies.keep_one(frame), "doc_id")] == survivors(rows, brute(rows))


def test_slots_hold_all_wanted_hashes(spark):
    hashes = [0, -1, 63, 64, 1 << 62, -(1 << 63), 42]
    frame = spark.createDataFrame([(h,) for h in [*hashes, 7, 65, 12345]], "h bigint")
    slots = near_copies.slots_of(spark.createDataFrame([(h,) for h in hashes], "h bigint"))
    on, off = (collected(near_copies.on_slots(frame, "h", slots, how), "h") for how in ("left_semi", "left_anti"))
    assert on == sorted([(h,) for h in hashes], key=repr) and off == sorted([(7,), (65,), (12345,)], key=repr)


def test_lists_of_two_to_nine_are_compared_whole(spark):
    """Sets of chains, of which only neighbours are similar: none of their lists may lose a pair."""
    rows = [(10 * n + i, " ".join(f"chain{n}word{k}" for k in range(6 * i, 6 * i + 70))) for n in range(2, 10) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(10 * n,) for n in range(2, 10)]
    assert collected(near_copies.keep_one(frame), "doc_id") == want == [(k,) for k in survivors(rows, brute(rows))]


def test_rounds_of_hubs_leave_fewer_pairs(spark, monkeypatch):
    """A large group of copies of which many pairs are just below the limit."""
    chance, rows = random.Random(7), []
    base = [f"w{i}" for i in range(120)]
    for number in range(150):
        other = base[:]
        for place in chance.sample(range(120), chance.choice([1, 2, 2])):
            other[place] = f"x{chance.randrange(10**6)}"
        rows.append((number, " ".join(other)))
    frame, whole, counts = spark.createDataFrame(rows, "doc_id bigint, text string"), near_copies.settle, []
    for rounds in (0, 3):
        stored = []
        monkeypatch.setattr(near_copies, "ROUNDS", rounds, raising=False)
        monkeypatch.setattr(near_copies, "settle", lambda df, name, to=stored: to.append((name, whole(df, name))) or to[-1][1])
        assert [k[0] for k in collected(near_copies.keep_one(frame), "doc_id")] == survivors(rows, brute(rows))
        counts.append([df.count() for name, df in stored if name == "near-pairs"][-1])
    assert counts[1] < counts[0]
