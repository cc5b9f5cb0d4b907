"""Encoding and decoding against the sentencepiece library."""

import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfloom.llm import pieces
from shelfloom.llm.queries import piece_model
from tests.llm.cases import TEXTS, collected, edge_documents, empty_documents, rows_of, sha

NAMES = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def own():
    return pieces.MergePieces(piece_model())


def expected(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "")
        out.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    return sorted(out, key=repr)


def test_equals_library_on_documents(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    encoded = pieces.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), piece_model())
    assert collected(pieces.token_digests(encoded, piece_model()), *NAMES) == expected(library, rows)


def test_defined_cases(spark, library):
    frame = edge_documents(spark)
    digests = pieces.token_digests(pieces.encode_documents(frame, piece_model()), piece_model())
    assert collected(digests, *NAMES) == expected(library, TEXTS)
    assert pieces.encode_documents(empty_documents(spark), piece_model()).count() == 0
    assert pieces.library_differences(frame, piece_model()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁.,!’“²…\n\t<>x0aéß日😀"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(own, library, text):
    assert own.encode(text).tolist() == library.encode(text)


def test_long_words_and_runs(own, library):
    chance = random.Random(4)
    for text in ("a" * 3000, " " * 500, "ab" * 900 + " " * 40 + "c", "\n" * 100, "<s></s><unk><0x41>",
                 "".join(chance.choice("abcdefgh") for _ in range(5000))):
        assert own.encode(text).tolist() == library.encode(text)


def test_a_full_table_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 5)
    monkeypatch.setattr(pieces, "KNOWN_SEGMENTS", 5)
    small = pieces.MergePieces(piece_model())
    text = " ".join(f"word{i} other{i}," for i in range(300))
    assert small.encode(text).tolist() == library.encode(text) and len(small.words) == 5
    small.check_new_words()


def test_a_wrong_word_is_noticed(own):
    table = pieces.MergePieces(piece_model())
    table.encode("hello world")
    table.words["▁hello"] = table.words["▁world"]
    with pytest.raises(ValueError, match="hello"):
        table.check_new_words()


@pytest.mark.parametrize("text, word", [("one, two", ","), ("a  b", "▁"), ("x" * 90, "▁" + "x" * 90), ("tab\there", "\t"),
                                        ("done.\n\nnext", "."), ("    deep", "▁▁▁▁")])
def test_unmarked_long_and_lone_words_are_compared(text, word, monkeypatch):
    table = pieces.MergePieces(piece_model())
    table.encode(text)
    named = [w for w in table.words.new if w.startswith(word)]
    assert named, table.words.new
    table.check_new_words()
    table = pieces.MergePieces(piece_model())
    whole = table.segment_ids
    monkeypatch.setattr(table, "segment_ids", lambda w: [5, *whole(w)] if w == named[0] else whole(w))
    table.encode(text)
    with pytest.raises(ValueError, match="the library encodes"):
        table.check_new_words()


def test_words_behind_a_full_table_are_compared(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 5)
    table = pieces.MergePieces(piece_model())
    table.encode(" ".join(f"word{i}" for i in range(300)))
    table.check_new_words()
    table.encode("seen word299 late1 late2")
    assert len(table.words.new) >= 2 and len(table.words) == 5
    first, *_, last = table.words.new
    table.words.new[last] = table.words.new[first]
    with pytest.raises(ValueError, match="the library encodes"):
        table.check_new_words()
