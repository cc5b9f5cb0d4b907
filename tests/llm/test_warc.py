"""Archives: an exact round trip, digests of parts, and what the headers say."""

import gzip
import hashlib
import io

import pyarrow.parquet as pq
import pytest

from shelfloom.llm import warc
from shelfloom.session import new_folder
from tests.llm.cases import FOLDER, collected

NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
BIG = "".join(f"<p>{i} paragraph</p>\n" for i in range(120_000))
PAGES = [(1, "http://a/1", "x" * 999), (2, "http://a/2", "x" * 999), (3, "http://a/3", "é" * 500), (4, None, "é" * 500),
         (5, "http://a/5\r\nX: y", "é" * 500), (6, "http://a/6", None), (7, "http://a/7", ""), (8, "http://a/8", BIG),
         (9, "http://a/9", BIG), (9, "http://a/9b", BIG), (None, "http://a/n", BIG), (None, None, None), (10, "u", "a\r\n\r\nWARC/1.1\r\n"),
         (11, "u", BIG + "!"), (9, "u", "é" * 500)]


def expected(pages):
    newest = {}
    for page, _, html in pages:
        html = html or ""
        newest[html] = max(newest.get(html, -1), -1 if page is None else page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= 1000 and page != newest[html or ""]
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", newest[html] if again else None))
    return sorted(out, key=repr)


def frame(spark, extra=True):
    rows = [(*p, "x", "y") for p in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record_id string, payload string")


def test_round_trip_of_pages(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()]
    got = warc.round_trip(spark, spark.read.parquet(f"{FOLDER}/pages.parquet"))
    assert collected(got, *NAMES) == expected(rows)


def test_defined_cases(spark):
    got = warc.round_trip(spark, frame(spark))
    assert collected(got, *NAMES) == expected(PAGES)
    assert all(r["intact"] for r in got.collect())
    assert warc.round_trip(spark, frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1000, 65_536])
def test_payloads_come_back_in_chunks(spark, chunk):
    records = frame(spark).selectExpr("page_id AS record_id", "url", "html AS payload").filter("record_id IS NOT NULL")
    chunks = warc.chunk_records(records, chunk_bytes=chunk)
    folder = new_folder(spark, "archives-test")
    manifest = warc.write_archives(warc.ordered_chunks(chunks), folder)
    assert manifest.agg({"records": "sum"}).first()[0] == records.select("record_id", "payload").distinct().count()
    rows = warc.read_archives(manifest, chunk_bytes=chunk).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["chunk_no"]):
        assert len(r["data"]) <= chunk
        data = found[r["record_id"], r["payload_digest"]] = found.get((r["record_id"], r["payload_digest"]), b"") + r["data"]
        if r["record_type"] == "response" and r["record_id"] != 9:
            assert r["bytes_so_far"] == len(data) and r["digest_so_far"] == hashlib.sha1(data).hexdigest()
    texts = {p: (h or "").encode() for p, _, h in PAGES if p is not None and p != 9}
    for (record, digest), data in found.items():
        if record in texts and data:
            assert data == texts[record]


def test_archives_are_plain_members(spark):
    rows = [(1, "http://a/1", "é" * 600), (2, "http://a/2", "é" * 600)]
    records = spark.createDataFrame(rows, "record_id bigint, url string, payload string").coalesce(1)
    manifest = warc.write_archives(warc.ordered_chunks(warc.chunk_records(records)).coalesce(1), new_folder(spark, "archives-test"))
    paths = [r["path"] for r in manifest.collect()]
    whole = b"".join(gzip.decompress(open(p.removeprefix("file://"), "rb").read()) for p in paths)
    assert whole.count(b"WARC/1.1\r\n") == 2 and whole.count(b"WARC-Type: revisit") == 1
    assert b"WARC-Refers-To: <urn:page:2:" in whole and whole.endswith(b"\r\n\r\n")


def test_broken_archives_are_noticed():
    head = warc.record_head({"payload_bytes": 5, "record_type": "response", "record_id": 1, "payload_digest": "d", "url": "u",
                             "refers_to": None}, "2024-01-01T00:00:00Z")
    good = gzip.compress(head + b"12345\r\n\r\n")
    assert [r[-1] for r in warc.read_records(io.BytesIO(good), 2)] == [b"12", b"34", b"5"]
    for broken in (gzip.compress(head + b"123"), gzip.compress(head + b"1234567\r\n\r\n"), gzip.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(broken), 2))


def test_chunks_carry_running_digests():
    rows = list(warc.chunked(b"abcdefg", 3))
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, False, 3), (1, False, 6), (2, True, 7)]
    assert rows[1][3] == hashlib.sha1(b"abcdef").hexdigest()
    assert [(r[0], r[1], r[2], bytes(r[4])) for r in warc.chunked(b"", 3)] == [(0, True, 0, b"")]
