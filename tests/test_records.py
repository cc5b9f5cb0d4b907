"""Feeds read in splits against Spark's own reading of whole files, which takes one task for each."""

import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.sources import records
from shelfloom.sources.feeds import CSV_FILES, ORDER, feed_schema, open_feed, told_feed


@contextmanager
def splits_of(spark, size):
    """Files are read in splits of ``size`` bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1",
             "spark.sql.files.minPartitionNum": "16"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


def whole(spark, path, width):
    """The one-task reading."""
    rows = spark.read.schema(feed_schema(range(width))).options(
        header=True, multiLine=True, quote='"', escape='"').csv(path)
    return [tuple(r) for r in rows.collect()]


def in_splits(spark, path, size):
    with splits_of(spark, size):
        rows = open_feed(spark, path).rows()
        return [tuple(r)[:-1] for r in rows.orderBy(f"{ORDER}._file", f"{ORDER}._start", f"{ORDER}._line").collect()]


CELLS = ["", "plain", '"quoted, with comma"', '"two\nlines"', '"three\n\n""lines"",\n"', '""', '"a ""word"""', 'in"ch', ' "spaced"',
         '"stray" quote', '"""', '"x\n""', "é😀", '","', '"\n"', '"\r\n"', "1,299", "'"]


def random_feed(chance, lines, end="\n"):
    out = ["a,b,c"]
    for number in range(lines):
        # A quote that stays open only in the last line.
        cells = [c for c in (chance.choice(CELLS) for _ in range(chance.randrange(1, 4))) if c not in ('"""', '"x\n""')]
        out.append(f"{number}," + ",".join(cells))
        if chance.random() < 0.05:
            out.append("")
    return end.join(out) + end


@pytest.mark.parametrize("size", [15, 60, 10_000])
def test_any_feed_is_read_as_in_one_task(spark, tmp_path, size):
    path = tmp_path / "a.csv"
    path.write_text(random_feed(random.Random(size), 40), newline="")
    want = whole(spark, str(path), 3)
    assert len(want) > 30
    assert in_splits(spark, str(path), size) == want


def test_open_quotes_to_the_end_and_carriage_returns(spark, tmp_path):
    texts = {"open": 'a,b\n1,x\n2,"open\n3,y\n4,z', "returns": random_feed(random.Random(5), 40, "\r\n"),
             "header": "a,b\n", "line": "a,b", "mixed": 'a,b\n1,x\r\n2,"y\r\nz"\n'}
    for name, text in texts.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text, newline="")
        width = 3 if name == "returns" else 2
        assert in_splits(spark, str(path), 25) == whole(spark, str(path), width), name


def test_many_splits_begin_within_quotes(spark, tmp_path, monkeypatch):
    """A field of many splits, and more such splits than are told to all tasks."""
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" + "".join(f'{i},"' + "line\n" * 12 + '"\n' for i in range(8)))
    want = whole(spark, str(path), 2)
    assert in_splits(spark, str(path), 30) == want
    monkeypatch.setattr(records, "TOLD_SPLITS", 0)
    assert in_splits(spark, str(path), 30) == want


def test_one_large_file_takes_many_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    with path.open("w") as out:
        out.write("sku,title,note\n")
        for i in range(100_000):
            out.write(f'S{i},"Title {i}\nsecond, ""line""",{"plain" if i % 3 else chr(34) + chr(10) + chr(34)}\n')
    with splits_of(spark, 400_000):
        rows = open_feed(spark, str(path)).rows()
        tasks = {r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}
        assert len(tasks) >= 8
        found = rows.agg(F.count("c0"), F.count_if(F.col("c1").endswith('\nsecond, "line"')), F.count_if(F.col("c2") == "plain"),
                         F.count_distinct("c0"), F.count("_overflow")).first()
        assert tuple(found) == (100_000, 100_000, 66_666, 100_000, 0)
        digest = F.sum(F.xxhash64("c0", "c1", "c2").cast("decimal(38,0)"))
        one = spark.read.schema(feed_schema(range(3))).options(header=True, multiLine=True, quote='"', escape='"').csv(str(path))
        assert rows.agg(digest).first() == one.agg(digest).first()


def test_states_of_splits(spark):
    """Splits that set, keep and turn the state, in every order."""
    chance = random.Random(2)
    rows, want = [], []
    for file in range(30):
        state = False
        for start in range(12):
            closed, opened = chance.choice([(False, False), (True, True), (False, True), (True, False)])
            rows.append((f"f{file}", start, None, closed, opened))
            behind = opened if state else closed
            want.append((f"f{file}", start, state, behind))
            state = behind
    chance.shuffle(rows)
    steps = spark.createDataFrame(rows, "file string, start bigint, first_line string, if_closed boolean, if_open boolean")
    assert sorted(tuple(r) for r in records.split_states(steps).collect()) == sorted(want)


def test_told_splits_give_the_same_records(spark, tmp_path):
    for name, seed in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.csv").write_text(random_feed(random.Random(seed), 40), newline="")
    (tmp_path / "c.csv").write_text('c,b,a\n1,"open\n3,y\n4,z', newline="")
    place = [f"{ORDER}.{n}" for n in ("_file", "_start", "_line")]
    with splits_of(spark, 40):
        whole = open_feed(spark, str(tmp_path))
        told = told_feed(records.read_lines(spark, str(tmp_path), CSV_FILES))
        assert told.found == whole.found and list(told.found) == list(whole.found)
        assert sorted(told.files.collect()) == sorted(whole.files.collect())
        want = whole.rows().orderBy(*place).collect()
        assert len(want) > 80 and told.rows().orderBy(*place).collect() == want


def test_told_states_of_splits(spark):
    chance, rows = random.Random(3), []
    for file in "ab":
        for start in range(40):
            rows.append((file, start, None, *chance.choice([(False, False), (True, True), (False, True), (True, False)])))
    chance.shuffle(rows)
    steps = spark.createDataFrame(rows, "file string, start bigint, first_line string, if_closed boolean, if_open boolean")
    states = records.split_states(steps).collect()
    begun, crossing = records.told_states(steps.collect())
    assert begun == {(s["file"], s["start"]) for s in states if s["open_before"]} and crossing
    assert records.told_states([]) == (frozenset(), False)


def test_open_behind_equals_line_by_line():
    chance = random.Random(9)
    for _ in range(300):
        steps = [(chance.random() < 0.3, chance.random() < 0.7) for _ in range(chance.randrange(1, 30))]
        for is_open in (False, True):
            want, state = [], is_open
            for if_closed, if_open in steps:
                state = if_open if state else if_closed
                want.append(state)
            closed, opened = (np.array(c) for c in zip(*steps, strict=True))
            assert records.open_behind(closed, opened, is_open).tolist() == want
