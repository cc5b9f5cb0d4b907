"""Delimited text read in splits, with records whose quoted fields hold line breaks put together again.

A text source cuts files into splits at line ends, and a line end may lie within quotes. Whether it
does follows from the whole file before it, so it is found out in three steps:

1. For each line, whether a quoted field is open behind it if none, or if one, was open before it. Both
   are column expressions on the line alone. A split's lines make this one step from its beginning to
   its end: (open behind it if closed before, open behind it if open before).
2. These steps, a narrow row for each split, are put in order by file, which gives every split's beginning.
3. Each split's lines are joined to records from there. What reaches over a split's border is a fragment,
   one at most at each end, and fragments of a record are joined by their order.

A quote opens a field only as its first character, ``""`` in a field is a quote, and a quote that
neither ends its field nor is doubled leaves the field unquoted, as Spark's own reader has it. A
field that is never closed takes the rest of its file as one record.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.session import settle

# Splits that begin within a record and may be told to all tasks: a split is some 100 MB of input, its
# row some 100 bytes. Beyond that, lines are dealt out by split and sorted.
TOLD_SPLITS = 50_000

HEADER_PLACE = -1

_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)


def text_lines(reader) -> DataFrame:
    """(line, file, start) of a reader of text, batch or stream, whose ``text`` was called with a path."""
    return reader.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))


def read_lines(spark: SparkSession, path, files: str) -> DataFrame:
    """(line, file, start, place) of all files whose names match; a line keeps its carriage return."""
    return placed(text_lines(spark.read.options(pathGlobFilter=files, lineSep="\n").text(path)))


def placed(lines: DataFrame) -> DataFrame:
    """``lines`` with their place, taken before anything moves them."""
    return lines.withColumn("place", F.monotonically_increasing_id())


def _left_open(text: Column) -> Column:
    """Whether a quoted field is open at the end of a text that begins outside of quotes."""
    single = F.replace(text, F.lit('""'), F.lit(""))
    return F.regexp_replace(single, r'(?<=^|,)"[^"]*+"(?=,|\r?$)', "").rlike(r'(?<=^|,)"[^"]*+$')


def _with_steps(lines: DataFrame) -> DataFrame:
    # A line without a quote leaves everything as it was; most lines are such.
    quoted = F.contains("line", F.lit('"'))
    return lines.withColumns({
        "if_closed": F.when(quoted, _left_open(F.col("line"))).otherwise(False),
        "if_open": F.when(quoted, _left_open(F.concat(F.lit('"'), F.col("line")))).otherwise(True)})


def _runs(batch: pa.RecordBatch) -> list:
    """(file, start, from, to) of the lines of each split in a batch with columns file and start."""
    file, start = batch.column(0), batch.column(1)
    if not len(start):
        return []
    same_file = pc.equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(start.to_numpy()) | ~same_file) + 1
    bounds = [0, *cuts.tolist(), len(start)]
    return [(file[i].as_py(), start[i].as_py(), i, j) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _marks(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def open_behind(if_closed: np.ndarray, if_open: np.ndarray, is_open: bool) -> np.ndarray:
    """Whether a quoted field is open behind each of some lines; ``is_open`` is that before the first."""
    at = np.arange(len(if_closed))
    # The last line so far whose end does not depend on its beginning, and the changes since then.
    fixed = np.maximum.accumulate(np.where(if_closed == if_open, at, -1))
    turns = np.cumsum(if_closed & ~if_open)
    begun = np.where(fixed < 0, is_open, if_closed[fixed])
    return begun ^ ((turns - np.where(fixed < 0, 0, turns[fixed])) % 2 == 1)


def split_steps(lines: DataFrame) -> DataFrame:
    """(file, start, first_line, if_closed, if_open) of every split, in one pass."""
    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, rows = None, None, []
        for batch in batches:
            if_closed, if_open = _marks(batch.column(3)), _marks(batch.column(4))
            for file, start, i, j in _runs(batch):
                if (file, start) != name:
                    if name:
                        rows.append((*name, *state))
                    name, state = (file, start), [batch.column(2)[i].as_py(), False, True]
                state[1:] = (bool(open_behind(if_closed[i:j], if_open[i:j], before)[-1]) for before in state[1:])
        if name:
            rows.append((*name, *state))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                         ["file", "start", "first_line", "if_closed", "if_open"])

    # Only a file's first split holds its first line.
    first = F.when(F.col("start") == 0, F.substring("line", 1, 100_000))
    return _with_steps(lines).select("file", "start", first.alias("line"), "if_closed", "if_open").mapInArrow(
        stepped, "file string, start bigint, first_line string, if_closed boolean, if_open boolean")


def split_states(steps: DataFrame) -> DataFrame:
    """(file, start, open_before, open_behind): whether a quoted field is open around each split.

    A split whose end does not depend on its beginning sets the state anew; of the others,
    those that change it are counted from there on.
    """
    order = Window.partitionBy("file").orderBy("start")
    until, before = (order.rowsBetween(Window.unboundedPreceding, last) for last in (0, -1))
    turns = (F.col("if_closed") & ~F.col("if_open")).cast("int")
    counted = steps.withColumn("turns", F.sum(turns).over(until))
    fixed = F.when(F.col("if_closed") == F.col("if_open"), F.struct(F.col("if_closed").cast("int").alias("state"), "turns"))
    since = counted.withColumns({"fixed": F.last(fixed, True).over(before), "turned": F.max("turns").over(before)})
    state = F.coalesce("fixed.state", F.lit(0)) + F.coalesce("turned", F.lit(0)) - F.coalesce("fixed.turns", F.lit(0))
    known = since.withColumn("open_before", state % 2 == 1)
    behind = F.when(F.col("open_before"), F.col("if_open")).otherwise(F.col("if_closed"))
    return known.select("file", "start", "open_before", behind.alias("open_behind"))


def told_states(steps: list) -> tuple:
    """(the (file, start) of splits that begin within quotes, whether any ends so) for collected ``split_steps``."""
    begun, crossing, file, is_open = set(), False, None, False
    for step in sorted(steps, key=lambda s: (s["file"], s["start"])):
        is_open, file = is_open and step["file"] == file, step["file"]
        if is_open:
            begun.add((file, step["start"]))
        is_open = step["if_open"] if is_open else step["if_closed"]
        crossing |= is_open
    return frozenset(begun), crossing


def _joined_lines(lines: DataFrame, begun: frozenset = None) -> DataFrame:
    """(file, start, place, kind, record) from lines in order with ``open_before`` of their split, or with the
    (file, start) of those splits for which it is true."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, first, is_open, kind, made_any = None, [], None, False, _WHOLE, False
        for batch in batches:
            places, opened = batch.column(2).to_numpy(), _marks(batch.column(6)) if begun is None else None
            if_closed, if_open = _marks(batch.column(4)), _marks(batch.column(5))
            made = []
            for file, start, i, j in _runs(batch):
                if (file, start) != name:
                    if held:
                        made.append(_records(name, [first], [kind + _HEAD], held, [0, sum(map(len, held))]))
                    name, held, made_any = (file, start), [], False
                    is_open = name in begun if opened is None else bool(opened[i])
                    kind = _MIDDLE - _HEAD if is_open else _WHOLE
                if not held:
                    first = int(places[i]) if start or made_any else HEADER_PLACE
                    made_any = True
                behind = open_behind(if_closed[i:j], if_open[i:j], is_open)
                is_open = bool(behind[-1])
                ends = i + 1 + np.flatnonzero(~behind)
                last = int(ends[-1]) if len(ends) else i
                if len(ends):
                    before = sum(map(len, held))
                    held.append(batch.column(3).slice(i, last - i))
                    firsts = np.concatenate(([first], places[ends[:-1]]))
                    kinds = [_TAIL if kind else _WHOLE, *[_WHOLE] * (len(ends) - 1)]
                    made.append(_records(name, firsts, kinds, held, np.concatenate(([0], ends - i + before))))
                    held, kind = [], _WHOLE
                if last < j:
                    if len(ends):
                        first = int(places[last])
                    held.append(batch.column(3).slice(last, j - last))
            yield from pa.Table.from_batches(made, _RECORDS).combine_chunks().to_batches()
        if held:
            yield _records(name, [first], [kind + _HEAD], held, [0, sum(map(len, held))])

    names = ["file", "start", "place", "line", "if_closed", "if_open", *(["open_before"] if begun is None else [])]
    return _with_steps(lines).select(*names).mapInArrow(
        joined, "file string, start bigint, place bigint, kind int, record string")


_RECORDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()),
                      ("record", pa.string())])


def _records(name: tuple, places: Sequence, kinds: list, lines: list, offsets: Sequence) -> pa.RecordBatch:
    """Records of a split; ``lines`` are arrays of their lines, each record's begin at its offset."""
    file, start = name
    parts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([x.cast(pa.string()) for x in lines]))
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(file, pa.string()), len(kinds)), pa.repeat(pa.scalar(start, pa.int64()), len(kinds)),
         pa.array(places, pa.int64()), pa.array(kinds, pa.int32()), pc.binary_join(parts, "\n")], schema=_RECORDS)


def _joined_fragments(fragments: DataFrame) -> DataFrame:
    """Records that reach over the borders of splits, each at the place where it begins."""
    order = Window.partitionBy("file").orderBy("start", "place")
    numbered = fragments.withColumn("number", F.count_if(F.col("kind") == _HEAD).over(order))
    one = F.struct("start", "place", "record")
    return numbered.groupBy("file", "number").agg(
        F.min(F.struct("start", "place")).alias("at"), F.array_sort(F.collect_list(one)).alias("parts")).select(
        "file", "at.start", "at.place", F.array_join(F.col("parts.record"), "\n").alias("record"))


def records(lines: DataFrame, steps) -> DataFrame:
    """(file, start, place, record) of all records; ``steps`` are the ``split_steps`` of the lines, settled or collected.

    A file's first record has the place ``HEADER_PLACE``.
    """
    if isinstance(steps, list):
        begun, crossing = told_states(steps)
        return _with_fragments(_joined_lines(lines, begun), crossing)
    states = settle(split_states(steps), "split-states")
    inside, crossing = states.agg(F.count_if("open_before"), F.count_if("open_behind")).first()
    if inside:
        begun = states.filter("open_before")
        begun = F.broadcast(begun) if inside <= TOLD_SPLITS else begun
        lines = lines.join(begun.select("file", "start", "open_before"), ["file", "start"], "left").withColumn(
            "open_before", F.coalesce("open_before", F.lit(False)))
        if inside > TOLD_SPLITS:
            lines = lines.repartition("file", "start").sortWithinPartitions("file", "start", "place")
    else:
        lines = lines.withColumn("open_before", F.lit(False))
    return _with_fragments(_joined_lines(lines), crossing, lambda fragments: settle(fragments, "record-fragments"))


def _with_fragments(made: DataFrame, crossing: bool, kept: Callable = lambda fragments: fragments) -> DataFrame:
    """All records of ``_joined_lines``, of whose splits some are ``crossing`` into the next."""
    if not crossing:
        return made.drop("kind")
    fragments = _joined_fragments(kept(made.filter(F.col("kind") != _WHOLE)))
    return made.filter(F.col("kind") == _WHOLE).drop("kind").unionByName(fragments)
