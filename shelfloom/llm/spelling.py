"""Spelling variants: words one edit apart, found by scanning sorted lists.

Words are counted over all texts and sorted. For a word, the rows of the edit matrix
against the words behind it in the list are worked out from left to right, three cells
wide, since a distance above one needs no more. Adjacent words share a prefix, whose rows
are kept; where every cell of a row exceeds one edit, all words that share the prefix up to
that row are skipped.

One list of all words would be one task. Words are taken apart instead into lists whose members
agree outside one third: an edit lies in one third of the shorter word, so the two words
have all characters before and behind that third in common. A word stands in six lists, three
for each length that the shorter word can have. A pair is taken in the list of its own
shorter length, and in the first of the thirds that fit, so it is found once.

The likeliest spelling of a word (its form) is the commonest word one edit away, if that is at
least ``factor`` times as common. Counts grow along a chain of forms by that factor, so a chain
is short, and doubling steps follow it to its end in a few rounds.

Defined results: a null or empty text has no words; a null id stands for an empty one in the
hash that deletes letters; repeated rows are counted each; ties between forms go to the
first in code-point order; very long words are words like others; extra columns are ignored; an
empty table gives an empty result. A list is held by one task; its members differ in a third
of their letters only, so its size is bounded by the letters that may stand there, not by the corpus.
"""

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, slices
from shelfloom.session import settle

MIN_LENGTH = 7
MIN_COUNT = 2
FACTOR = 10
LETTERS = "a-zÀ-ÿ"  # behind the lower-casing of A-Z
ONE_IN = 31  # share of a text's different runs that lose a letter

# Different words that a task counts before it passes them on.
_HELD = 200_000


def with_deletions(run: str, seed: int) -> str:
    """The run, or the run without one letter where its hash says so."""
    h = crc32(run.encode(), seed)
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough over all texts."""
    long_run = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in slices(batches):
            for name, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1)), strict=True):
                if not text:
                    continue
                seed = crc32((name or b"") + b":")
                # The hash is one of the id and the run, so equal runs of a text have equal fates.
                for run, times in Counter(long_run.findall(text.lower().decode())).items():
                    word = with_deletions(run, seed)
                    if len(word) >= min_length:
                        counts[word] += times
            if len(counts) > _HELD:
                yield _batch(counts)
                counts.clear()
        yield _batch(counts)

    narrow = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return (
        narrow.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def _batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def third(length: int, part: int) -> tuple:
    """Where a third of a word of this length begins and ends."""
    return part * length // 3, (part + 1) * length // 3


def lists(words: DataFrame) -> DataFrame:
    """(shorter, part, list, word, n): each word in the lists of its six pairs of length and third."""
    length = F.char_length("word")
    shorter = F.explode(F.array(length - 1, length)).alias("shorter")
    spread = words.select("word", "n", shorter).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part"))
    start = (F.col("part") * F.col("shorter") / 3).cast("int")
    behind = F.col("shorter") - ((F.col("part") + 1) * F.col("shorter") / 3).cast("int")
    return spread.select(
        "shorter", "part", F.xxhash64(F.substring("word", F.lit(1), start), F.right("word", behind)).alias("list"),
        "word", "n")


def same_list(a: str, b: str, shorter: int, part: int) -> bool:
    """Whether two words agree outside this third."""
    start, end = third(shorter, part)
    behind = shorter - end
    return a[:start] == b[:start] and a[len(a) - behind:] == b[len(b) - behind:]


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def one_edit_pairs(words: list) -> Iterator[tuple]:
    """(i, k), i < k, of the different words of a sorted list that are one edit apart.

    A row of the matrix at depth d holds the distances of the first d letters of the scanned
    word to the first d - 1, d and d + 1 letters of the word at hand.
    """
    shared = [0, *(common_prefix(a, b) for a, b in zip(words, words[1:], strict=False))]
    for i in range(len(words) - 1):
        own, size = words[i] + "\0\0", len(words[i])
        k, base, rows = i + 1, len(own), []
        while k < len(words):
            word, depth = words[k], shared[k]
            if depth <= base:
                # On the word's own path the distances are known.
                base, rows = depth, [(1 if depth else 2, 0, 1)]
            else:
                depth = min(depth, base + len(rows) - 1)
                del rows[depth - base + 1:]
            low, same, high = rows[-1]
            end = len(word)
            while depth < end:
                letter = word[depth]
                new_low = min(low + (letter != own[depth - 1]), same + 1)
                new_same = min(same + (letter != own[depth]) if depth < size else 2, high + 1, new_low + 1)
                high = min(high + (letter != own[depth + 1]) if depth + 1 < size else 2, new_same + 1)
                low, same = new_low, new_same
                depth += 1
                if low > 1 and same > 1 and high > 1:
                    break
                rows.append((low, same, high))
            else:
                if -1 <= size - end <= 1 and (low, same, high)[size - end + 1] == 1:
                    yield i, k
                k += 1
                continue
            k += 1
            while k < len(words) and shared[k] >= depth:
                k += 1


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words one edit apart."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members, found = None, [], ([], [], [])

        def closed() -> None:
            names = [w for w, _ in members]
            for i, k in one_edit_pairs(names) if len(names) > 1 else ():
                a, b = names[i], names[k]
                shorter, part, _ = name
                if min(len(a), len(b)) == shorter and same_list(a, b, shorter, part) and not any(
                        same_list(a, b, shorter, p) for p in range(part)):
                    for x, y in ((i, k), (k, i)):
                        for column, value in zip(found, (names[x], names[y], members[y][1]), strict=True):
                            column.append(value)

        for batch in batches:
            for shorter, part, number, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != (shorter, part, number):
                    closed()
                    name, members = (shorter, part, number), []
                members.append((word, n))
            yield _links(found)
            found = ([], [], [])
        closed()
        yield _links(found)

    sorted_lists = lists(words).repartition("shorter", "part", "list").sortWithinPartitions("shorter", "part", "list", "word")
    return sorted_lists.mapInArrow(scanned, "word string, near string, near_n bigint")


def _links(columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
        ["word", "near", "near_n"])


def chain_ends(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of the chain that begins with each word of (word, form)."""
    current = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "word-forms")
    while not current.filter("moved").isEmpty():
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        current = settle(current.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-forms")
    return current.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR,
                      **limits) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = settle(word_counts(docs, id_col, text_col, **limits), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    common = -F.col("best.less") >= factor * F.col("n")
    marked = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.less")).alias("form_n")), "word-marks")
    roots = chain_ends(marked.filter("form IS NOT NULL").select("word", "form"))
    return marked.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(CAST(length(hex(name)) / 2 AS BIGINT)),
             lambda i: CAST('0x' || substr(hex(name), 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM run, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         times
  FROM hashed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), less AS (
  SELECT word, n, place, left(word, place) || substr(word, place + 2) AS left_over
  FROM (SELECT word, n, unnest(range(length(word))) AS place FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b
  ON a.left_over = b.left_over AND a.place = b.place AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.left_over = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.left_over = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near,
         max(near_n) AS near_n FROM near GROUP BY word
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 10 * words.n THEN near END AS form,
         CASE WHEN near_n >= 10 * words.n THEN near_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.at = formed.word WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.form, chain.at AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN chain ON formed.word = chain.word JOIN formed ends ON ends.word = chain.at AND ends.form IS NULL
"""
