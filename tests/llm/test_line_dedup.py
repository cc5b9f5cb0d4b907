"""Line dedup against a plain count over all lines."""

import numpy as np
import pytest

from shelfloom.llm import line_dedup
from shelfloom.llm.line_dedup import kept_text, pack_bitmap, unpack_bitmap
from tests.llm.cases import collected, edge_documents, empty_documents, rows_of, sha

NAMES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def brute(rows, min_chars=40, min_docs=5):
    owners = {}

    def key(line):
        return line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})

    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                owners.setdefault(key(line), set()).add(doc)
    keeper = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in owners.items() if len(d) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def test_equals_brute_force_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collected(line_dedup.line_report(frame), *NAMES) == brute(rows)


def shared_lines():
    hot = "A line that nearly every document of this table holds, near its end"
    rare = "A line that only four documents hold, so that it has to stay here"
    rows = []
    for i in range(400):
        lines = [f"own line number {i} of a document, long enough to be a key", "  " + (hot.upper() if i % 2 else hot) + "\t"]
        lines += [rare] * (i in (7, 70, 170, 270)) + [hot] * (i % 5 == 0) + ["short"] * 3
        rows.append((i * 3 % 401, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_lines_cut_by_range_ends(spark, ranges):
    """A line of all documents reaches over many ranges and is settled as if it were in one."""
    rows = shared_lines()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert collected(line_dedup.line_report(frame), *NAMES) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_defined_cases(spark):
    frame = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    for limits in ({"min_docs": 5}, {"min_docs": 2, "min_chars": 10}, {"min_docs": 1, "min_chars": 1}):
        assert collected(line_dedup.line_report(frame, **limits), *NAMES) == brute(rows, **limits)
    assert line_dedup.line_report(empty_documents(spark)).count() == 0


def test_ids_that_are_missing_count_as_smallest(spark):
    line = "a line that is long enough to be counted by its key"
    rows = [(None, line), (None, line), (-5, line), (-9, line)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = collected(line_dedup.line_report(frame, min_docs=3), *NAMES)
    assert kept == brute(rows, min_docs=3) and [r[2] for r in kept] == [0, 1, 1, 1]


def test_texts_keep_their_other_columns(spark):
    frame = edge_documents(spark)
    made = line_dedup.dedup_lines(frame, min_docs=2, min_chars=10)
    assert made.columns == frame.columns
    before = {(r["doc_id"], r["n_chars"]): r["text"] for r in frame.collect()}
    for r in made.collect():
        old = before[r["doc_id"], r["n_chars"]]
        assert (r["text"] is None) == (old is None) and len(r["text"] or "") <= len(old or "")
        assert r["bitmap"] == "x"
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_bitmaps_come_back():
    for dropped, n in (([0], 1), ([7], 8), ([8], 9), ([1, 5, 30], 31), ([3], 1000)):
        keep = unpack_bitmap(pack_bitmap(np.array(dropped)), n)
        assert len(keep) == n and np.flatnonzero(~keep).tolist() == dropped
    assert unpack_bitmap(None, 3).all()
    assert kept_text(b"a\nb\nc", pack_bitmap(np.array([0, 1, 2]))) == (b"", 3, 3)
