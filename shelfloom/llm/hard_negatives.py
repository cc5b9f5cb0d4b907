"""Hard negatives by exact inner products from tables of subset sums.

Vectors become integers. An anchor's components are taken in groups of eight dimensions;
for each group a table holds the sums of all 256 subsets of its components. A candidate's
integers are cut into bit planes, and a plane's eight bits of a group are one byte, which picks
the sum of the anchor's components at the bits that are set. A plane's sums over all groups,
shifted by the plane's place and added up (the sign's plane is taken off), are the inner
product: no multiplication, no rounding, every pair of an anchor and a candidate.

Anchors are a share of all rows, so they are taken in blocks of ``BLOCK`` rows. A block's
vectors, a few megabytes whatever the table, travel to the tasks; every task packs its
candidates once for a block and keeps the first rows per anchor, which are merged afterwards. Of
each block the positives are found first; their scores bound the negatives of the second
pass. What a block found is written before the next begins.

Defined results: rows without id, label or vector, with a null or non-finite component, or
with a component whose integer needs more than 26 bits (its scores might not fit 64 bits) take no
part; vectors of different lengths are filled up with zeros; of rows that share an id, the one
with the smallest label, then vector, stands for all; ties go to the smaller id; an anchor
without positives, or a positive without negatives in its range, has no rows (so have all positives
of a score below zero, whose range is empty); extra columns are ignored; an empty table
gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.session import settle

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT, HIGH_PERCENT = 80, 100
ANCHOR_EVERY = 100

# Anchors of a block, anchors whose tables are held at a time, and candidates scored at a time.
BLOCK = 4096
_TABLES = 64
_ROWS = 4096
_LARGEST = 1 << 26


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part, vectors as integers, one row for each id."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    scaled = F.transform(vector, lambda x: F.when(F.abs(x) < _LARGEST / SCALE, F.floor(SCALE * x).cast("int")))
    named = rows.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
        scaled.alias("vector"))
    usable = settle(
        named.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"),
        "vectors")
    repeated = settle(usable.groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("id"), "repeated-ids")
    once = usable.join(repeated, "id", "left_anti")
    first = usable.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("first"))
    return once.unionByName(first.select("id", "first.label", "first.vector"))


def bit_planes(vectors: np.ndarray) -> tuple:
    """(planes, rows, groups) of the packed bits of integers in two's complement, and their number."""
    count = int(max(np.abs(vectors + (vectors < 0)).max(initial=0), 1)).bit_length() + 1
    planes = [np.packbits((vectors >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(count)]
    return np.stack(planes), count


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for every group of eight dimensions the sums of all its subsets."""
    parts = anchors.T.reshape(-1, 8, len(anchors))
    sums = np.zeros((len(parts), 256, len(anchors)), np.int64)
    for bit in range(8):
        sums[:, 1 << bit:2 << bit] = sums[:, :1 << bit] + parts[:, bit:bit + 1]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors): inner products by looking up bytes, shifting and adding."""
    count, rows, groups = planes.shape
    # A plane's sums are small numbers as a rule; half the width is twice the speed.
    narrow = sums.astype(np.int32) if np.abs(sums).max(initial=0) * max(groups, 1) < 2**31 else sums
    total = np.zeros((rows, sums.shape[2]), np.int64)
    plane_sum, found = np.empty(total.shape, narrow.dtype), np.empty(total.shape, narrow.dtype)
    for plane in range(count - 1, -1, -1):
        plane_sum[:] = 0
        for group in range(groups):
            np.take(narrow[group], planes[plane, :, group], axis=0, out=found, mode="clip")
            plane_sum += found
        total <<= 1
        if plane == count - 1:
            total -= plane_sum
        else:
            total += plane_sum
    return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix whose width is a multiple of eight."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    width = -(-max(width, int(lengths.max(initial=0))) // 8) * 8
    values = np.asarray(column.flatten(), np.int64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _firsts(column: np.ndarray, allowed: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows by score, ties by id, of those allowed."""
    at = np.flatnonzero(allowed)
    if len(at) > most:
        least = np.partition(column[at], len(at) - most)[len(at) - most]
        at = at[column[at] >= least]
    return at[np.lexsort((ids[at], -column[at]))[:most]]


class Anchors:
    """A block of anchors: ids, labels and vectors, and for the second pass their positives' scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.positives = [[] for _ in ids]  # (score, id) of each anchor's positives

    def tiles(self, width: int) -> Iterator[tuple]:
        """(places, sums) of some anchors at a time, filled up to a width of candidates."""
        vectors = np.pad(self.vectors, ((0, 0), (0, max(0, width - self.vectors.shape[1]))))
        for start in range(0, len(self.ids), _TABLES):
            yield range(start, min(start + _TABLES, len(self.ids))), subset_sums(vectors[start:start + _TABLES])

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(anchor's place, ids, labels, scores) of every anchor with some candidates at a time."""
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                ids, labels = (np.asarray(part.column(i), np.int64) for i in (0, 1))
                vectors = _matrix(part.column(2), self.vectors.shape[1])
                planes, _ = bit_planes(vectors)
                for places, sums in self.tiles(vectors.shape[1]):
                    products = scores(planes, sums).T.copy()
                    for place, line in zip(places, products, strict=True):
                        yield place, ids, labels, line

    def best_positives(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in self.ids]
        for place, ids, labels, line in self.scored(batches):
            allowed = (labels == self.labels[place]) & (ids != self.ids[place])
            at = _firsts(line, allowed, ids, POSITIVES)
            best[place] = sorted([*best[place], *zip((-line[at]).tolist(), ids[at].tolist(), strict=True)])[:POSITIVES]
        rows = [(int(self.ids[p]), i, -s) for p, found in enumerate(best) for s, i in found]
        yield _batch(rows, ["anchor_id", "id", "score"])

    def best_negatives(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for place, ids, labels, line in self.scored(batches):
            other = labels != self.labels[place]
            for score, positive in self.positives[place]:
                allowed = other & (HIGH_PERCENT * score >= 100 * line) & (100 * line >= LOW_PERCENT * score)
                at = _firsts(line, allowed, ids, NEGATIVES)
                if len(at):
                    held = [*best.get((place, positive, score), ()), *zip((-line[at]).tolist(), ids[at].tolist(), strict=True)]
                    best[place, positive, score] = sorted(held)[:NEGATIVES]
        rows = [(int(self.ids[p]), positive, score, i, -s)
                for (p, positive, score), found in best.items() for s, i in found]
        yield _batch(rows, ["anchor_id", "positive_id", "positive_score", "id", "score"])


def _batch(rows: list, names: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def first_rows(found: DataFrame, keys: list, most: int) -> DataFrame:
    """The first rows of each key by score, ties by id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine_block(vectors: DataFrame, block: Anchors) -> DataFrame:
    """Negatives of one block of anchors among all rows."""
    positives = first_rows(
        vectors.mapInArrow(block.best_positives, "anchor_id bigint, id bigint, score bigint"), ["anchor_id"], POSITIVES)
    places = {name: place for place, name in enumerate(block.ids.tolist())}
    for row in positives.collect():  # at most POSITIVES for each anchor of the block
        block.positives[places[row["anchor_id"]]].append((row["score"], row["id"]))
    kinds = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
    negatives = first_rows(
        vectors.mapInArrow(block.best_negatives, kinds), ["anchor_id", "positive_id", "positive_score"], NEGATIVES)
    return negatives.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _block_of(anchors: DataFrame, number: int) -> Anchors:
    held = anchors.filter(F.col("block") == number).select("id", "label", "vector").orderBy("id").toArrow()
    vectors = pa.chunked_array(held.column("vector").chunks, held.column("vector").type).combine_chunks()
    ids, labels = (np.asarray(held.column(c), np.int64) for c in ("id", "label"))
    return Anchors(ids, labels, _matrix(vectors, 0))


def hard_negatives(vectors: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``prepared`` rows.

    Anchors are the rows whose id is divisible by ``every``.
    """
    vectors = settle(vectors, "mining-vectors")
    anchors = vectors.filter(F.col("id") % every == 0)
    count = anchors.count()
    blocks = -(-count // BLOCK)
    # Blocks by a hash of the id hold some more or less than BLOCK anchors.
    numbered = settle(anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1)))), "anchors")
    found = None
    for number in range(max(blocks, 1)):
        made = settle(mine_block(vectors, _block_of(numbered, number)), "hard-negatives")
        found = made if found is None else found.unionByName(made)
    return found


def relabelled(rows: DataFrame) -> DataFrame:
    """The given table with every seventh row's label moved, as the registered query takes it."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.withColumn("label", moved)


ORACLE = r"""
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) <= 5
"""
