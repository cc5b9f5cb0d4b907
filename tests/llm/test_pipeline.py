"""The pipeline and the registered queries."""

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from shelfloom.llm import quality
from shelfloom.llm.queries import ORACLE, QUERIES
from tests.llm import test_decontaminate, test_line_dedup, test_near_copies, test_pieces
from tests.llm.cases import FOLDER, collected, edge_documents, empty_documents, rows_of

TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")


def test_every_operator_has_one_query():
    found = queries()
    assert all(sum(name.startswith(f"op{n}_") for name in found) == 1 for n in range(1, 14))
    assert found["pipeline"] is corpus_pipeline.run and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = base.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    frame = QUERIES[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(names)
    assert collected(frame, *names) == sorted(result.fetchall(), key=repr)


def test_pipeline_equals_brute_force(spark):
    """Each stage's plain form on the rows that the stage before left."""
    import sentencepiece

    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    ranking = quality.taught_by(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    rows = [(d, t) for d, t in rows if ranking.score(quality._rows(_column([t])))[0] >= quality.THRESHOLD]
    assert len(rows) < len(rows_of("documents"))
    rows = _kept_lines(rows)
    first = {min(rows[i][0] for i in group) for group in test_near_copies.brute(rows)}
    assert len(first) < len(rows)
    rows = [(d, t) for d, t in rows if d in first]
    items = [(r["item_id"], r["text"]) for r in rows_of("benchmark")]
    clean = {d for d, *_, bad in test_decontaminate.brute(rows, items) if not bad}
    assert len(clean) < len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=test_pieces.piece_model())
    want = test_pieces.expected(library, [(d, t) for d, t in rows if d in clean])
    assert collected(corpus_pipeline.run(spark, FOLDER), *test_pieces.NAMES) == want


def _column(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def _kept_lines(rows):
    owners = {}

    def key(line):
        return line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})

    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                owners.setdefault(key(line), set()).add(doc)
    return [(doc, "\n".join(x for x in (text or "").split("\n")
                            if len(owners.get(key(x), ())) < 5 or max(owners[key(x)]) == doc)) for doc, text in rows]


@pytest.mark.parametrize("make", [edge_documents, empty_documents])
def test_stages_take_odd_documents(spark, make):
    docs = make(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


def test_line_dedup_form_is_the_tested_one():
    rows = test_line_dedup.shared_lines()
    kept = {d: s for d, _, _, s in test_line_dedup.brute(rows)}
    from tests.llm.cases import sha

    assert {d: sha(t) for d, t in _kept_lines(rows)} == kept
