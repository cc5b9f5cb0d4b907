"""Documents that every operator has to take, and rows of the smallest tables."""

import hashlib

import pyarrow.parquet as pq

FOLDER = "/root/testdata/sf0.001"

# Names that operators use inside themselves, here as extra columns of the input.
CLASHING = ("row", "doc", "text_hash", "lines", "bitmap", "fp", "h1", "first", "places", "label", "features", "ids",
            "item", "keeper", "rest", "host", "words", "entry", "bucket", "group", "size", "word", "n", "form", "a.b", "c0")

LONG = "".join(f"Word{i % 977} stands, {i % 13} times\n" if i % 9 == 8 else f"word{i % 977} " for i in range(60_000))

TEXTS = [
    (1, None), (2, ""), (3, " \t\r\n \x0b"), (4, "one"), (5, "One two"), (6, "one two three"), (7, "ONE TWO THREE"),
    (8, "naïve café — déjà vu, 日本語のテキスト and ½ 😀"), (9, LONG), (10, LONG), (11, "a" * 5000), (12, "...\n---\n###"),
    (13, "same text for two rows, long enough to count as a line of its own"),
    (13, "same text for two rows, long enough to count as a line of its own"),
    (13, "another text with the same id, which is as long as the one before it"), (None, "a text without an id, which has "
     "to be long enough to count"), (None, None), (14, "\x00 nul \x7f and \x1c separators \x85 here"),
]


def edge_documents(spark, extra=True):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, [None, "en", "fr"][n % 3], [None, "src0"][n % 2], None if t is None else len(t))
            for n, (i, t) in enumerate(TEXTS)]
    if not extra:
        return spark.createDataFrame(rows, schema)
    schema += "".join(f", `{name}` string" for name in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)


def empty_documents(spark):
    return edge_documents(spark).limit(0)


def rows_of(name, folder=FOLDER):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def collected(frame, *names):
    """Rows as sorted tuples; sorts None with anything."""
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)
