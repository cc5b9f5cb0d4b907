"""Generated descriptions: which products need one, batches, storing results."""

import json
from typing import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.fixed_values import (
    CONTENT_ISSUE_TYPES, DESCRIPTION_CALL, DESCRIPTION_SYSTEM, GENERATION_FAILED_TEXT,
    PRODUCT_NOT_FOUND_TEXT, SEO_CALL, SEO_SYSTEM,
)
from shelfloom.functions.content import description_prompt, seo_prompt, seo_reply
from shelfloom.functions.text import fill, strip
from shelfloom.operators.changes import patch_products, resolve_issues
from shelfloom.session import settle

RESULT_COLUMNS = [
    "product_id", "generated_description", "seo_title", "seo_keywords", "success", "error",
]


def needs_content(products: DataFrame, limit: int = 50) -> DataFrame:
    """Products without a description or never generated for, lowest ids first.

    An empty generated text counts as generated; thin content does not qualify.
    """
    rows = all_needing_content(products)
    return rows.orderBy("product_id").limit(limit)


def all_needing_content(products: DataFrame) -> DataFrame:
    return products.filter(
        F.col("description").isNull() | (F.col("description") == "")
        | F.col("generated_description").isNull()
    )


def open_content_issues(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """Unresolved missing- or thin-content issues of the given products."""
    return issues.filter(
        F.col("issue_type").isin(CONTENT_ISSUE_TYPES) & ~F.col("resolved")
    ).join(ids.select("product_id").distinct(), "product_id", "left_semi")


LEDGER = "request string, reply string, error string"

# Parts of a job's requests that are written one after the other.
SLICES = 8

# Prompts that are asked before their replies leave the task.
REPLIES_AT_ONCE = 16


def call_generator(rows: DataFrame, generator: Callable, prompt: str, reply: str, error: str,
                   system: str, **options) -> DataFrame:
    """Put ``reply`` (the generator's text for ``prompt``) and ``error`` in the place of ``prompt``.

    Prompts hold whole descriptions, so they go no further than to the generator.

    ``generator(system, prompt, temperature=, max_tokens=)`` runs inside the
    tasks, row by row; rows with a null prompt are not sent. A lost task is
    repeated, so the generator must stand being asked twice; how many prompts that
    are goes by the tasks (``parallelism`` of ``generate``), and how many rows a task
    is handed at a time by ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    text_type = T.StringType()
    schema = T.StructType([
        *[f for f in rows.schema.fields if f.name != prompt], T.StructField(reply, text_type), T.StructField(error, text_type)
    ])
    position = rows.columns.index(prompt)
    others = [i for i in range(len(rows.columns)) if i != position]

    def ask(text):
        try:
            return generator(system, text, **options), None
        except Exception as problem:
            return None, str(problem)

    def run(batches):
        for batch in (b.slice(i, REPLIES_AT_ONCE) for b in batches for i in range(0, b.num_rows, REPLIES_AT_ONCE)):
            asked = [ask(t) if t is not None else (None, None) for t in batch[position].to_pylist()]
            added = [pa.array(column, pa.string()) for column in zip(*asked)] or [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in others), *added], names=[*(batch.schema.names[i] for i in others), reply, error]
            )

    return rows.mapInArrow(run, schema)


def request_keys(rows: DataFrame, prompt: str, system: str, options: dict) -> DataFrame:
    """Add ``request``: a hash of all that a generator is given; null without a prompt."""
    asked = F.concat_ws("\u0000", F.lit(system), F.lit(json.dumps(options, sort_keys=True)), F.col(prompt))
    return rows.withColumn("request", F.when(F.col(prompt).isNotNull(), F.sha2(asked, 256)))


def ledger_answers(spark: SparkSession, ledger: str) -> DataFrame:
    """(request, reply, error): one row for each request of the ledger; a reply goes before any error."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        # Nothing has been asked yet.
        rows = spark.createDataFrame([], LEDGER)
    kept = rows.groupBy("request").agg(F.min("reply").alias("reply"), F.min("error").alias("error"))
    return kept.withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))


def call_with_ledger(rows: DataFrame, generator: Callable, prompt: str, reply: str, error: str,
                     system: str, ledger: str, slices: int, parallelism: int, **options) -> DataFrame:
    """``call_generator`` that asks for each different prompt once and keeps the answers in a ledger.

    Requests without a reply in the folder ``ledger`` are asked in ``slices``, each written whole
    before the next begins. A job that ends half way, or is run again, asks again only what has no
    reply: at most the slice that was open, and what failed. Rows find their answers by
    the request's hash, so a prompt that very many rows share is asked for once.
    """
    spark = rows.sparkSession
    keyed = settle(request_keys(rows, prompt, system, options), "requests")
    different = keyed.filter("request IS NOT NULL").select("request", prompt).dropDuplicates(["request"])
    done = ledger_answers(spark, ledger).filter("reply IS NOT NULL").select("request")
    slice_of = F.pmod(F.xxhash64("request"), F.lit(slices)).alias("slice")
    unanswered = settle(different.join(done, "request", "left_anti").select("*", slice_of), "unanswered")
    for row in unanswered.select("slice").distinct().orderBy("slice").collect():  # at most ``slices``
        part = unanswered.filter(F.col("slice") == row["slice"]).drop("slice")
        if parallelism:
            part = part.repartition(parallelism, "request")
        asked = call_generator(part, generator, prompt, "reply", "error", system, **options)
        asked.select("request", "reply", "error").write.mode("append").parquet(ledger)
    answers = ledger_answers(spark, ledger).select(
        "request", F.col("reply").alias(reply), F.col("error").alias(error))
    others = [c for c in rows.columns if c != prompt]
    return keyed.join(answers, "request", "left").select(*others, reply, error)


def generate(ids: DataFrame, products: DataFrame, generator: Callable,
             tone: str = "professional", include_seo: bool = True,
             parallelism: int = None, ledger: str = None, slices: int = SLICES) -> DataFrame:
    """One result row per requested id, in the columns RESULT_COLUMNS.

    An id that is requested several times is asked for once and has as many rows.
    An unknown id, a failing generator or an SEO reply that cannot be stored
    gives success = false with the reason; other rows go on. ``parallelism``
    spreads the requests over that many tasks. With ``ledger``, a folder, replies outlive the
    job: see ``call_with_ledger``.
    """
    def call(rows: DataFrame, prompt: str, reply: str, error: str, system: str, options: dict) -> DataFrame:
        if ledger is None:
            return call_generator(rows, generator, prompt, reply, error, system, **options)
        return call_with_ledger(rows, generator, prompt, reply, error, system, ledger, slices, parallelism, **options)

    requested = ids.groupBy("product_id").agg(F.count(F.lit(1)).cast("int").alias("times"))
    columns = ["product_id", "sku", "title", "category", "brand", "price", "currency",
               "description", "attributes"]
    known = requested.join(products.select(*columns), "product_id", "left")
    prompts = known.select(
        "product_id", "title", "category", "brand", "times",
        F.col("sku").isNotNull().alias("found"),
        F.when(F.col("sku").isNotNull(), description_prompt(tone=tone)).alias("prompt"),
    )
    if parallelism:
        prompts = prompts.repartition(parallelism, "product_id")
    described = call(
        prompts, "prompt", "text", "text_error", DESCRIPTION_SYSTEM, DESCRIPTION_CALL
    ).withColumn("text", strip(F.col("text")))
    if include_seo:
        asked = described.withColumn("seo_prompt", seo_prompt(F.col("text")))
        replied = call(
            asked, "seo_prompt", "seo_text", "seo_error", SEO_SYSTEM, SEO_CALL
        ).withColumn("seo", seo_reply(F.col("seo_text")))
    else:
        replied = described.withColumn("seo_error", F.lit(None).cast("string")).withColumn(
            "seo", seo_reply(F.lit(None).cast("string"))
        )
    reason = F.coalesce(
        "text_error", "seo_error",
        F.when(~F.col("seo.usable"), F.lit("the SEO reply does not hold the two texts")),
    )
    result = replied.withColumn(
        "error",
        F.when(~F.col("found"), fill(
            PRODUCT_NOT_FOUND_TEXT, product_id=F.col("product_id").cast("string")))
        .when(reason.isNotNull(), fill(
            GENERATION_FAILED_TEXT, product_id=F.col("product_id").cast("string"), error=reason)),
    ).withColumn("success", F.col("error").isNull())
    each = result.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.select(
        "product_id",
        F.when(F.col("success"), F.col("text")).otherwise("").alias("generated_description"),
        F.when(F.col("success"), F.col("seo.seo_title")).alias("seo_title"),
        F.when(F.col("success"), F.col("seo.seo_keywords")).alias("seo_keywords"),
        "success", "error",
    )


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("success").alias("succeeded"), F.count(F.lit(1)).alias("requested")
    )


def store_content(products: DataFrame, results: DataFrame, run_ts) -> DataFrame:
    """Products with the successful results; SEO fields are overwritten even by null."""
    fields = ["generated_description", "seo_title", "seo_keywords"]
    patches = results.filter("success").select(
        "product_id", *fields, F.array(*[F.lit(f) for f in fields]).alias("set_fields")
    )
    return patch_products(products, patches, run_ts)


def resolve_content_issues(issues: DataFrame, results: DataFrame, run_ts) -> DataFrame:
    """Issues with the content issues of successful products resolved."""
    closed = open_content_issues(issues, results.filter("success"))
    return resolve_issues(issues, closed.select("issue_id"), run_ts)
