"""Content generation with a ledger: what is asked again, and what is not."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfloom.operators.content import call_generator, call_with_ledger, generate, ledger_answers
from shelfloom.schemas import PRODUCTS
from tests.test_content import product, products


def noted(folder, stop_at=None):
    """A generator that notes each prompt in a file; the prompt of one product kills its task, once."""
    def write(system, prompt, temperature, max_tokens):
        sku = next(line.split(": ")[1] for line in prompt.split("\n") if line.startswith("- SKU"))
        kind = "seo" if "JSON" in system else "text"
        fd = os.open(f"{folder}/asked", os.O_WRONLY | os.O_APPEND | os.O_CREAT)
        os.write(fd, f"{kind} {sku}\n".encode())
        os.close(fd)
        if sku == stop_at and not os.path.exists(f"{folder}/killed"):
            open(f"{folder}/killed", "w").close()
            os._exit(1)
        if sku == "SKU-7" and not os.path.exists(f"{folder}/works"):
            raise ValueError("refused")
        return f"About {sku}."

    return write


def asked(folder):
    with open(f"{folder}/asked") as lines:
        return Counter(line.strip() for line in lines)


def catalog(spark, count=40):
    return products(spark, *[product(i) for i in range(count)])


def test_a_killed_task_loses_one_slice_at_most(spark, tmp_path):
    rows, ledger = catalog(spark), str(tmp_path / "ledger")
    options = dict(include_seo=False, ledger=ledger, slices=5, parallelism=2)
    with pytest.raises(Exception):
        generate(rows.select("product_id"), rows, noted(tmp_path, "SKU-11"), **options).collect()
    before = {r["request"] for r in ledger_answers(spark, ledger).collect()}
    done = generate(rows.select("product_id"), rows, noted(tmp_path, "SKU-11"), **options).collect()
    assert {r["generated_description"] for r in done if r["success"]} == {f"About SKU-{i}." for i in range(40) if i != 7}
    times = asked(tmp_path)
    assert len(times) == 40 and max(times.values()) <= 2
    # What was answered in slices that were written is not asked for again.
    assert sum(times.values()) <= 40 + (40 - len(before)) and len(before) + sum(n > 1 for n in times.values()) <= 40


def test_a_repeated_job_asks_only_what_failed(spark, tmp_path):
    rows, ledger = catalog(spark), str(tmp_path / "ledger")
    ids = rows.select("product_id").unionByName(rows.select("product_id"))
    for _ in range(2):
        results = generate(ids, rows, noted(tmp_path), include_seo=False, ledger=ledger).collect()
        assert len(results) == 80
        assert {r["product_id"]: r["error"] for r in results if not r["success"]} == {
            7: "Content generation failed for product 7: refused"}
    times = asked(tmp_path)
    assert times.pop("text SKU-7") == 2 and set(times.values()) == {1}
    (tmp_path / "works").touch()
    assert all(r["success"] for r in generate(ids, rows, noted(tmp_path), include_seo=False, ledger=ledger).collect())
    # Other prompts and options are other requests.
    generate(ids, rows, noted(tmp_path), tone="casual", include_seo=False, ledger=ledger).collect()
    assert asked(tmp_path)["text SKU-1"] == 2


def test_equal_prompts_are_asked_once(spark, tmp_path):
    same = products(spark, *[product(i, sku="SKU-1", title="T") for i in range(30)])
    results = generate(same.select("product_id"), same, noted(tmp_path), include_seo=False, ledger=str(tmp_path / "l")).collect()
    assert {r["generated_description"] for r in results} == {"About SKU-1."} and len(results) == 30
    assert asked(tmp_path) == {"text SKU-1": 1}
    none = spark.createDataFrame([], PRODUCTS)
    unknown = generate(same.select("product_id"), none, noted(tmp_path), ledger=str(tmp_path / "m"))
    assert unknown.filter(F.col("success")).count() == 0 and unknown.count() == 30


def test_prompts_end_at_the_generator(spark, tmp_path):
    """What a task hands back, and what is written and joined after it, holds no prompts."""
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, prompt string")
    names = ("prompt", "reply", "error", "system")
    plain = call_generator(rows, lambda system, prompt: prompt.upper(), *names)
    kept = call_with_ledger(rows, lambda system, prompt: prompt.upper(), *names, str(tmp_path / "l"), 2, None)
    for made in (plain, kept):
        assert made.columns == ["id", "reply", "error"]
        assert sorted(map(tuple, made.collect())) == [(1, "A", None), (2, None, None)]
