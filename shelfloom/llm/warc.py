"""WARC archives written and read as a chunked record table.

A record travels as rows of its id, a chunk number and at most ``chunk_bytes`` of its
payload; the rows carry the SHA-1 and the length of the payload up to and with that chunk,
so the last chunk's digest is the payload's, and no step holds a record beside its row in
the input. Writing streams chunks into gzip members, one for each record; reading streams
the members back into chunk rows of the same form.

The digests decide, before anything is written, which of the records with equal payloads
is the response: the largest id; the others become revisits without a payload. Records below
``revisit_bytes`` are always responses. This runs on (id, digest, length) alone.

Each task writes one archive to the shared folder, under a name of its own attempt, and
returns it in the manifest; archives of attempts that were lost are in no manifest and are
never read. Archives are opened through ``pyarrow.fs``, so the folder may be on any file
system that it knows.

Defined results: a null payload is empty; rows that repeat an id with equal payload are
records of equal kind (so several responses if they are the largest id); a null id is
smaller than any other and is written as none; a revisit keeps digest and length of the full
payload; extra columns are never read; an empty table gives no archive and an empty result.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, id_type, same_document, slices, text_key
from shelfloom.session import new_folder, settle

CHUNK_BYTES = 1 << 20
REVISIT_BYTES = 1000

# The capture time of records made from a table without one.
CAPTURED = datetime(2024, 1, 1, tzinfo=timezone.utc)

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_READ = 1 << 18

CHUNKS = ("record_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
          "payload_digest string, chunk_no int, last boolean, bytes_so_far bigint, digest_so_far string, data binary")
_CHUNK_NAMES = [part.split()[0] for part in CHUNKS.split(", ")]


def chunked(payload: bytes, chunk_bytes: int) -> Iterator[tuple]:
    """(chunk number, last, bytes so far, digest so far, data) of a payload; an empty one has one chunk."""
    view, state, count = memoryview(payload), hashlib.sha1(), max(1, -(-len(payload) // chunk_bytes))
    for number in range(count):
        data = view[number * chunk_bytes:(number + 1) * chunk_bytes]
        state.update(data)
        yield number, number == count - 1, min(len(payload), (number + 1) * chunk_bytes), state.hexdigest(), data


def _batch(rows: list, names: list, types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_CHUNK_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(),
                pa.int64(), pa.string(), pa.binary()]


def digests(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record_id, payload_key, payload_bytes, payload_digest) of (record_id, payload) rows.

    The key is a 64-bit hash that finds the payload's row again; the digest is summed up
    chunk by chunk.
    """
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for payload in as_bytes(batch.column(2)):
                for _, _, size, digest, _ in chunked(payload or b"", chunk_bytes):
                    pass
                made.append((size, digest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.string())],
                ["record_id", "payload_key", "payload_bytes", "payload_digest"])

    return records.select("record_id", text_key(F.col("payload")), "payload").mapInArrow(
        summed, f"record_id {id_type(records, 'record_id')}, payload_key bigint, payload_bytes bigint, payload_digest string")


def revisits(summed: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(record_id, payload_digest, refers_to) of the records that repeat a payload."""
    large = summed.filter(F.col("payload_bytes") >= revisit_bytes)
    repeated = (
        large.groupBy("payload_digest").agg(F.max("record_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).drop("n")
    )
    return (
        large.join(repeated, "payload_digest")
        .filter(~F.col("record_id").eqNullSafe(F.col("refers_to")))
        .select("record_id", "payload_digest", "refers_to").distinct()
    )


def chunk_records(records: DataFrame, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The chunk table of (record_id, url, payload) rows, each record's chunks one after another.

    A revisit has one chunk without data.
    """
    summed = settle(digests(records, chunk_bytes), "payload-digests")
    kinds = settle(revisits(summed, revisit_bytes), "revisits")
    marked = summed.join(kinds, same_document(summed, kinds, ["record_id", "payload_digest"]), "left").select(
        summed["record_id"], "payload_key", summed["payload_digest"], "payload_bytes", "refers_to",
        kinds["payload_digest"].isNotNull().alias("revisit")).distinct()
    payloads = records.select("record_id", "url", "payload", text_key(F.col("payload")).alias("payload_key"))
    joined = payloads.join(marked, same_document(payloads, marked, ["record_id", "payload_key"])).select(
        payloads["record_id"], "url", "payload", "payload_digest", "payload_bytes", "refers_to", "revisit")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32):
            payloads, rest = as_bytes(batch.column(2)), [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            rows, held = [], 0
            for payload, (record, url, digest, size, refers_to, revisit) in zip(payloads, zip(*rest, strict=True), strict=True):
                kind = "revisit" if revisit else "response"
                parts = [(0, True, size, digest, b"")] if revisit else chunked(payload or b"", chunk_bytes)
                for number, last, so_far, state, data in parts:
                    rows.append((record, url, kind, refers_to, size, digest, number, last, so_far, state, data))
                    held += len(data)
                    if held >= chunk_bytes:
                        yield _batch(rows, _CHUNK_NAMES, _CHUNK_TYPES)
                        rows, held = [], 0
            yield _batch(rows, _CHUNK_NAMES, _CHUNK_TYPES)

    return joined.mapInArrow(cut, CHUNKS)


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """A chunk table in any order, brought into the order that writing needs.

    A chunk that is there twice is written once.
    """
    keys = ["record_id", "payload_digest"]
    once = chunks.dropDuplicates([*keys, "chunk_no"])
    return once.repartition(*keys).sortWithinPartitions(*keys, "chunk_no")


def record_name(record, digest: str) -> str:
    return f"urn:page:{'none' if record is None else record}:{digest}"


def record_head(row: dict, made: str) -> bytes:
    """The WARC header of a record and the HTTP header that its block begins with."""
    http = _HTTP % row["payload_bytes"]
    block = len(http) + (row["payload_bytes"] if row["record_type"] == "response" else 0)
    fields = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{record_name(row['record_id'], row['payload_digest'])}>",
        f"WARC-Date: {made}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {block}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["url"] is not None:
        fields.insert(3, "WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: <{record_name(row['refers_to'], row['payload_digest'])}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def _filesystem(uri: str):
    # Hadoop writes local folders as file:/..., which is no URI to pyarrow.
    return fs.FileSystem.from_uri(uri.removeprefix("file:") if uri.startswith("file:/") and "://" not in uri else uri)


def write_archives(chunks: DataFrame, folder: str, captured: datetime = CAPTURED) -> DataFrame:
    """Write a chunk table to gzip archives below ``folder``; returns the manifest (path, records, bytes).

    The chunks of a record have to follow each other within a partition, as
    ``chunk_records`` and ``ordered_chunks`` leave them. The manifest is written before it is returned.
    """
    made = captured.strftime("%Y-%m-%dT%H:%M:%SZ")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = _filesystem(folder)
        path = f"{path.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        out, member, records = None, None, 0
        for batch in batches:
            for row in slices(iter([batch]), 8):
                for chunk in row.to_pylist():
                    if out is None:
                        place.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = place.open_output_stream(path, compression=None)
                    if chunk["chunk_no"] == 0:
                        member = zlib.compressobj(4, zlib.DEFLATED, 31)
                        records += 1
                        out.write(member.compress(record_head(chunk, made)))
                    out.write(member.compress(chunk["data"]))
                    if chunk["last"]:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            size = out.tell()
            out.close()
            yield _batch([(f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}", records, size)],
                         ["path", "records", "bytes"], [pa.string(), pa.int64(), pa.int64()])

    return settle(chunks.mapInArrow(written, "path string, records bigint, bytes bigint"), "manifest")


class _Members:
    """Bytes of a gzip archive, unpacked as they are asked for."""

    def __init__(self, stream):
        self.stream, self.packed, self.ready, self.member = stream, b"", b"", None

    def fill(self) -> bool:
        """Unpack some more; False at the end of the archive."""
        if not self.packed:
            self.packed = self.stream.read(_READ)
            if not self.packed:
                return False
        if self.member is None:
            self.member = zlib.decompressobj(31)
        self.ready += self.member.decompress(self.packed, _READ)
        self.packed = self.member.unconsumed_tail
        if self.member.eof:
            self.packed, self.member = self.member.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``, which is passed over; nothing at the end of the archive."""
        while mark not in self.ready:
            if not self.fill():
                if self.ready:
                    raise ValueError("the archive ends inside a record")
                return b""
        found, _, self.ready = self.ready.partition(mark)
        return found

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces."""
        while size:
            if not self.ready and not self.fill():
                raise ValueError("the archive ends inside a record")
            piece, self.ready = self.ready[:size], self.ready[size:]
            size -= len(piece)
            if piece:
                yield piece


def _fields(head: bytes) -> dict:
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def _named(text: str) -> tuple:
    record, digest = text.strip("<>").rsplit(":", 2)[1:]
    return None if record == "none" else int(record), digest


def read_records(stream, chunk_bytes: int) -> Iterator[tuple]:
    """The chunk rows of one archive, in its order."""
    members = _Members(stream)
    while head := members.until(b"\r\n\r\n"):
        fields = _fields(head)
        record, digest = _named(fields["warc-record-id"])
        refers_to = _named(fields["warc-refers-to"])[0] if "warc-refers-to" in fields else None
        same = (record, fields.get("warc-target-uri"), fields["warc-type"], refers_to,
                int(fields["x-payload-length"]), digest)
        left = int(fields["content-length"]) - len(members.until(b"\r\n\r\n")) - 4
        state, number, so_far, held = hashlib.sha1(), 0, 0, bytearray()
        for piece in members.take(left):
            held += piece
            while len(held) > chunk_bytes:
                data = bytes(held[:chunk_bytes])
                del held[:chunk_bytes]
                state.update(data)
                so_far += len(data)
                yield (*same, number, False, so_far, state.hexdigest(), data)
                number += 1
        state.update(held)
        so_far += len(held)
        if same[2] == "revisit":
            yield (*same, 0, True, same[4], digest, b"")
        else:
            yield (*same, number, True, so_far, state.hexdigest(), bytes(held))
        if b"".join(members.take(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than its header says")


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in a manifest; without data if only the digests are wanted."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                place, path = _filesystem(uri)
                with place.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for row in read_records(stream, chunk_bytes):
                        rows.append(row if with_data else (*row[:-1], None))
                        held += len(row[-1]) if with_data else 0
                        if held >= chunk_bytes or len(rows) >= 1024:
                            yield _batch(rows, _CHUNK_NAMES, _CHUNK_TYPES)
                            rows, held = [], 0
                    yield _batch(rows, _CHUNK_NAMES, _CHUNK_TYPES)

    session = manifest.sparkSession
    archives = manifest.count()
    # One task for each archive, up to the number of tasks that a scheduler handles well.
    dealt = manifest.select("path").repartition(max(1, min(archives, 100_000)), "path")
    return dealt.mapInArrow(read, CHUNKS) if archives else session.createDataFrame([], CHUNKS)


def verified_records(chunks: DataFrame) -> DataFrame:
    """One row for each record of a chunk table that was read, with its digest recomputed."""
    ends = chunks.filter("last")
    return ends.select(
        F.col("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to",
        (F.col("chunk_no") + 1).alias("chunks"),
        ((F.col("digest_so_far") == F.col("payload_digest")) & (F.col("bytes_so_far") == F.col("payload_bytes"))).alias("intact"),
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive a table of (page_id, url, html) and read the archives back."""
    records = pages.select(F.col("page_id").cast("bigint").alias("record_id"), F.col("url").cast("string").alias("url"),
                           F.col("html").alias("payload"))
    manifest = write_archives(chunk_records(records), new_folder(spark, "archives"))
    return verified_records(read_archives(manifest, with_data=False))


ORACLE = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), kept AS (
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS newest FROM page
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 1
            ELSE greatest(1, CAST(ceil(payload_bytes / 1048576.0) AS INTEGER)) END AS chunks,
       true AS intact
FROM kept
"""
