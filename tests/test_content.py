"""Prompts, replies, generation and what follows from it."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfloom.functions.content import (
    description_prompt, display_description, seo_keyword_list, seo_prompt, seo_reply,
)
from shelfloom.operators.content import needs_content, open_content_issues
from shelfloom.plans.content_job import run_content
from shelfloom.schemas import DATA_ISSUES, PRODUCTS

NOW = datetime(2024, 6, 1)
OLD = datetime(2024, 1, 1)


def product(number, **given):
    row = {f.name: None for f in PRODUCTS.fields}
    row.update(product_id=number, sku=f"SKU-{number}", title=f"Title {number}", currency="USD",
               attributes={}, created_at=OLD, updated_at=OLD)
    row.update(given)
    return tuple(row[f.name] for f in PRODUCTS.fields)


def products(spark, *rows):
    return spark.createDataFrame(list(rows), PRODUCTS)


def prompt(spark, tone="professional", **given):
    return products(spark, product(1, **given)).select(description_prompt(tone=tone).alias("p")).first()["p"]


def test_full_prompt(spark):
    text = prompt(spark, title="Air Shoe", category="Footwear", brand="Acme", price=129.99,
                  description="Classic shoe", attributes={"color": "White", "ship_class": "A"})
    for part in ("- Title: Air Shoe\n", "- SKU: SKU-1\n", "- Category: Footwear\n", "- Brand: Acme\n",
                 "- Price: 129.99 USD\n- Original Description: Classic shoe\n\nPRODUCT ATTRIBUTES:\n",
                 "  - Color: White\n  - Ship Class: A\n\n\nWrite the product description now:",
                 "in a professional tone", "STRICT RULES", "Do NOT invent"):
        assert part in text


@pytest.mark.parametrize("price", [None, 0.0])
def test_prompt_fallbacks(spark, price):
    text = prompt(spark, tone="casual", price=price, brand="", attributes={})
    for part in ("Category: Not specified", "Brand: Not specified", "Price: Not specified USD\n\n\nPRODUCT",
                 "  No additional attributes available.\n\nWrite", "casual"):
        assert part in text


@pytest.mark.parametrize("tone", ["professional", "casual", "luxury", "technical"])
def test_tones(spark, tone):
    assert f"Write in a {tone} tone" in prompt(spark, tone=tone)


def test_seo_prompt(spark):
    row = products(spark, product(1, title="Head", brand=None, category="")).select(
        seo_prompt(F.lit("Premium.")).alias("p")).first()["p"]
    for part in ("- Title: Head\n- Category: General\n- Brand: Unknown\n- Description: Premium.\n",
                 '{\n  "seo_title": "An', '"seo_keywords": ', "}\n\nReturn ONLY the JSON object"):
        assert part in row


@pytest.mark.parametrize("reply, title, keywords, usable", [
    ('{"seo_title":"A","seo_keywords":"x, y"}', "A", "x, y", True),
    ('```json\n{"seo_title":"A","seo_keywords":"x"}\n```', "A", "x", True),
    ("```", None, None, True), ('```{"seo_title":"A"}```', None, None, True),
    ("not json", None, None, True), ('{"seo_title":"T"}', "T", "", True),
    ('{"seo_title":null}', None, "", True), ("[1]", None, None, False),
    ('{"seo_title":"T","seo_keywords":["a"]}', "T", '["a"]', False),
    ('  ```\n{"seo_title":"A```b"}\n``` bye', "A```b", "", True),
    ('```json\n{"seo_title":"open"}', "open", "", True),
    # Of a repeated key the last value counts; NaN is a number, which no text field takes.
    ('{"seo_title":"a","seo_title":"b","seo_keywords":"k"}', "b", "k", True),
    ('{"seo_title":NaN,"seo_keywords":"k"}', "NaN", "k", False), ('{"x":NaN,"seo_title":"t"}', "t", "", True),
    ('{"seo_title":"t"} and more', None, None, True), ("{'seo_title':'t'}", None, None, True), ("null", None, None, False),
])
def test_seo_reply(one, reply, title, keywords, usable):
    found = one(seo_reply(F.col("r")), r=reply)
    assert (found["seo_title"], found["seo_keywords"], found["usable"]) == (title, keywords, usable)


def test_keywords_and_display(spark, one):
    assert one(seo_keyword_list(F.col("k")), k=" a, b c ,,d") == ["a", "b c", "", "d"]
    rows = products(spark, product(1, description="d", generated_description="g"),
                    product(2, description="d", generated_description=""), product(3))
    assert [r["v"] for r in rows.select(display_description().alias("v")).collect()] == ["g", "d", None]


def test_needs_content(spark):
    rows = products(
        spark, product(4, description="d", generated_description="g"), product(3, description="d"),
        product(2, description="", generated_description="g"), product(1, generated_description="g"),
        product(5, description="d", generated_description=""))
    assert [r["product_id"] for r in needs_content(rows).collect()] == [1, 2, 3]
    assert [r["product_id"] for r in needs_content(rows, limit=2).collect()] == [1, 2]


def issue(number, product_id, kind, resolved=False):
    return (number, product_id, kind, "high", "d", None, None, None, resolved, OLD if resolved else None, OLD)


def stub(system, prompt, temperature, max_tokens):
    if "SKU-2" in prompt:
        raise RuntimeError("no answer")
    if system.startswith("You are an SEO"):
        assert (temperature, max_tokens) == (0.3, 200)
        if "Title 3" in prompt:
            return "no JSON"
        return '["list"]' if "Title 4" in prompt else '```\n{"seo_title": "S"}\n```'
    assert (temperature, max_tokens) == (0.7, 500)
    return "  About it.  "


def test_content_job(spark):
    rows = products(spark, *[product(n, seo_title="old") for n in (1, 2, 3, 4, 5)])
    issues = spark.createDataFrame(
        [issue(1, 1, "missing_description"), issue(2, 1, "attribute_contradiction"),
         issue(3, 2, "missing_description"), issue(4, 3, "thin_content", True), issue(5, 5, "thin_content"),
         issue(6, 3, "thin_content")], DATA_ISSUES)
    ids = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 9, 1)], "product_id bigint")
    result = run_content(ids, rows, issues, stub, NOW, tone="luxury", parallelism=3)
    found = {r["product_id"]: r for r in result.results.collect()}
    assert sorted(found) == [1, 2, 3, 4, 9]
    assert (found[1]["generated_description"], found[1]["seo_title"], found[1]["seo_keywords"]) == ("About it.", "S", "")
    assert found[2]["error"] == "Content generation failed for product 2: no answer"
    assert found[3]["success"] and found[3]["seo_title"] is None
    assert not found[4]["success"] and found[4]["generated_description"] == ""
    assert found[9]["error"] == "Product with ID 9 not found." and not found[9]["success"]
    # Product 1 was requested twice: it has two results.
    assert [r["product_id"] for r in result.results.orderBy("product_id").collect()] == [1, 1, 2, 3, 4, 9]
    assert tuple(result.summary.first()) == (3, 6)
    after = {r["product_id"]: r for r in result.products.collect()}
    assert (after[1]["generated_description"], after[1]["seo_title"], after[1]["updated_at"]) == ("About it.", "S", NOW)
    assert after[3]["seo_title"] is None and after[2]["seo_title"] == "old" and after[2]["updated_at"] == OLD
    closed = {r["issue_id"]: (r["resolved"], r["resolved_at"]) for r in result.issues.collect()}
    assert closed == {1: (True, NOW), 2: (False, None), 3: (False, None), 4: (True, OLD), 5: (False, None),
                      6: (True, NOW)}
    assert [r["issue_id"] for r in open_content_issues(issues, ids).orderBy("issue_id").collect()] == [1, 3, 6]


def test_without_seo_and_without_ids(spark):
    rows = products(spark, product(1, seo_title="old"))
    issues = spark.createDataFrame([], DATA_ISSUES)
    ids = spark.createDataFrame([(1,)], "product_id bigint")
    result = run_content(ids, rows, issues, stub, NOW, include_seo=False)
    after = result.products.first()
    assert after["generated_description"] == "About it." and after["seo_title"] is None
    with pytest.raises(ValueError):
        run_content(ids.limit(0), rows, issues, stub, NOW)
