"""Scalar rules: text, attributes, prices, search addresses, scores, contradictions."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfloom import fixed_values
from shelfloom.functions import money, search, text
from shelfloom.functions.attributes import normalize_attribute, with_attributes
from shelfloom.functions.quality import with_content_score, with_contradictions
from shelfloom.operators.quality import dictionary_contradictions


def values(spark, expression, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    found = rows.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in found]


@pytest.mark.parametrize("expression, cases", [
    (text.normalize_text, {
        "  hello world  ": "hello world", "hello   world": "hello world", "": "", None: "",
        "hello\t\nworld": "hello world", " a 　b\x1c\u0085": "a b",
    }),
    (text.title_case, {
        "die-cast": "Die-Cast", "levi's": "Levi'S", "0.8kg": "0.8Kg", "MIDNIGHT blue": "Midnight Blue",
        "32x30": "32X30", "élan d'été": "Élan D'Été",
    }),
    (lambda x: text.null_if_blank(text.null_if_na(x)), {
        "NaN": None, "n/a": None, "N/A": None, "": None, "NONE": None, "Nan": None, "nil": "nil",
        "<NA>": None, " ": " ",
    }),
    (money.extract_price, {
        "19.99": 19.99, "$129.99": 129.99, "1,299.00": 1299.0, "Rs. 45,999": 45999.0, "": None,
        None: None, "out of stock": None, "1.2.3": None, "1.299,00": 1.299, "5.": 5.0, "12,.": 12.0,
    }),
    (money.feed_price, {
        "1,299.00": 1299.0, "$5": 5.0, "USD 12": None, "12d": None, " 7 ": 7.0, "1e3": 1000.0,
        "1_000": 1000.0, "₹12": None, ".5": 0.5, "-3": -3.0, "": None, None: None, "1__0": None,
    }),
    (lambda x: normalize_attribute("size", x), {
        "extra small": "XS", "sm": "S", "medium": "M", "lg": "L", "extra large": "XL", "": "",
        "32x30": "32X30", " 3XL ": "XXXL",
    }),
    (lambda x: normalize_attribute("Colour", x), {
        "blk": "Black", "wht": "White", "blu": "Blue", "midnight blue": "Midnight Blue",
        "gray": "Grey", "navy": "Navy Blue", "Grey": "Grey",
    }),
    (lambda x: normalize_attribute("fabric", x), {
        "ss": "Stainless Steel", "ctn": "Cotton", "nyl": "Nylon", "die-cast metal": "Die-Cast Metal",
    }),
    (lambda x: normalize_attribute("weight", x), {"598g": "598G"}),
])
def test_scalar_cases(spark, expression, cases):
    assert values(spark, expression, list(cases)) == list(cases.values())


@pytest.mark.parametrize("value, two, one, plain", [
    (0.125, "0.12", "0.1", "0.125"), (1.005, "1.00", "1.0", "1.005"), (6.05, "6.05", "6.0", "6.05"),
    (1234567.891, "1234567.89", "1234567.9", "1234567.891"), (12345678.9, "12345678.90", "12345678.9", "12345678.9"),
    (900.0, "900.00", "900.0", "900.0"),
])
def test_number_texts_follow_the_exact_binary_value(spark, value, two, one, plain):
    x = F.lit(value)
    row = spark.range(1).select(
        text.fixed_decimals(x, 2).alias("a"), text.fixed_decimals(x, 1).alias("b"),
        text.plain_number(x).alias("c")).first()
    assert tuple(row) == (two, one, plain) == (f"{value:.2f}", f"{value:.1f}", repr(value))


def test_title_case_is_that_of_python_for_latin_text(spark):
    random.seed(3)
    letters = "abcXYZ éÜ-'0.9_/中日ªß"
    words = ["".join(random.choice(letters) for _ in range(12)) for _ in range(300)]
    # Java writes a capital ß as two letters only at a word's start, as Python does.
    assert values(spark, text.title_case, words) == [w.title() for w in words]
    assert values(spark, text.title_case, ["中abc", "two  Words", None]) == ["中Abc", "Two  Words", None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n\t  \x1c", max_size=30), min_size=40, max_size=40))
def test_counts_and_normalization_against_plain_python(spark, texts):
    assert values(spark, text.word_count, texts) == [len(t.split()) for t in texts]
    assert values(spark, text.sentence_count, texts) == [
        sum(1 for s in re.split("[.!?]", t) if s.strip()) for t in texts]
    assert values(spark, text.normalize_text, texts) == [" ".join(t.split()) for t in texts]


@pytest.mark.parametrize("query, source, url", [
    ("nike shoes", "amazon", "https://www.amazon.com/s?k=nike+shoes"),
    ("samsung tv", "Walmart", "https://www.walmart.com/search?q=samsung+tv"),
    ("iphone case", "flipkart", "https://www.flipkart.com/search?q=iphone+case"),
    ("test product", "unknown", "https://www.amazon.com/s?k=test+product"),
])
def test_search_url(one, query, source, url):
    assert one(search.search_url(F.col("q"), F.col("s")), q=query, s=source) == url


@pytest.mark.parametrize("brand, title, query", [
    ("Sony", "sony WH-1000", "sony WH-1000"), ("Sony", "Headphones", "Sony Headphones"),
    (None, " Lamp ", "Lamp"), ("", "Lamp", "Lamp"), (" B ", "x", "B x"), ("B", "", "B"),
])
def test_search_query(one, brand, title, query):
    assert one(search.search_query(F.col("b"), F.col("t")), b=brand, t=title) == query


@pytest.mark.parametrize("price, currency, ours, expected", [
    (830.0, "INR", "USD", 10.0), (10.0, "USD", "INR", 830.0), (5.0, "EUR", "USD", 5.0),
    (5.0, "USD", "USD", 5.0), (5.0, None, "USD", 5.0),
])
def test_currency(spark, price, currency, ours, expected):
    row = spark.createDataFrame([(price, currency, ours)], "p double, c string, o string").select(
        money.in_our_currency(F.col("p"), F.col("c"), F.col("o")).alias("v")).first()
    assert row["v"] == expected


def score(spark, description):
    frame = spark.createDataFrame([(description,)], "description string")
    return with_content_score(frame).select("content.*").first().asDict()


def words(n):
    """A text of n words in two sentences."""
    return "One. " + " ".join(["word"] * (n - 1)) + "."


@pytest.mark.parametrize("description, expected, label, count", [
    ("Short text here.", 45, "Poor", 3),
    ("Buy now this high quality product. Best quality guaranteed. Click here.", 20, "Poor", 11),
    (words(19), 60, "Fair", 19), (words(20), 80, "Good", 20), (words(49), 80, "Good", 49),
    (words(50), 100, "Good", 50), (words(300), 100, "Good", 300), (words(301), 90, "Good", 301),
    (" ", 45, "Poor", 0),
    ("Lorem ipsum n/a buy now click here high quality best quality description not available", 0, "Critical", 14),
])
def test_content_score(spark, description, expected, label, count):
    found = score(spark, description)
    assert (found["score"], found["label"], found["word_count"]) == (expected, label, count)


def test_content_score_without_description(spark):
    for nothing in ("", None):
        assert score(spark, nothing) == {
            "score": 0, "label": "Missing", "word_count": 0, "sentence_count": None,
            "issues": ["No description"]}


def test_content_score_messages_in_order(spark):
    assert score(spark, "High quality. Buy now")["issues"] == [
        "Very thin content (under 20 words)",
        "Generic/placeholder text detected: 'high quality'",
        "Generic/placeholder text detected: 'buy now'"]


def contradictions(spark, title, description, attributes):
    frame = spark.createDataFrame(
        [(title, description, attributes)],
        "title string, description string, attributes map<string,string>")
    return [tuple(c) for c in with_contradictions(frame).first()["contradictions"]]


def test_contradictions(spark):
    assert contradictions(spark, "Blue Nike Shoes", "These blue shoes are great.", {"color": "Blue"}) == []
    assert contradictions(spark, "Red Nike Shoes", "", {"color": "Blue"}) == [
        ("color", "title", "Blue", "'red' found in title")]
    assert contradictions(spark, "Some Product", "A good product", {}) == []
    assert contradictions(spark, "Some red Product", None, None) == []
    # By substring, first color of the list, one per text.
    assert contradictions(spark, "Stand Mixer", "featured in white and black", {"Colour": "Empire Red"}) == [
        ("Colour", "title", "Empire Red", "'tan' found in title"),
        ("Colour", "description", "Empire Red", "'black' found in description")]
    # The dictionary's spelling is not that of the text.
    assert contradictions(spark, "A gray thing", "", {"color": "Grey"}) == [
        ("color", "title", "Grey", "'gray' found in title")]
    assert contradictions(spark, "Acme lamp", "", {"brand": "Zed", "weight": "red", "color": ""}) == [
        ("brand", "title", "Zed", "Title starts with 'acme' instead of brand")]
    assert contradictions(spark, "Zed lamp", "", {"brand": "Zed"}) == []
    assert contradictions(spark, "ab lamp", "", {"brand": "Zed"}) == []


def test_contradictions_by_whole_words(spark):
    def found(title, description, attributes):
        frame = spark.createDataFrame(
            [(title, description, attributes)], "title string, description string, attributes map<string,string>")
        return [tuple(c) for c in with_contradictions(frame, word_boundary=True).first()["contradictions"]]

    assert found("Stand Mixer", "featured in white, and black", {"Colour": "Empire Red"}) == [
        ("Colour", "description", "Empire Red", "'black' found in description")]
    assert found("Navy-Blue Coat", "a BLUE, warm coat", {"color": "navy blue"}) == [
        ("color", "description", "navy blue", "'blue' found in description")]
    assert found("Redwood (tan) box", None, {"color": "wood"}) == [("color", "title", "wood", "'tan' found in title")]
    assert found("...", "", {"color": "red"}) == []
    assert found("Acme lamp", "", {"brand": "Zed"}) == [("brand", "title", "Zed", "Title starts with 'acme' instead of brand")]


def test_dictionary_of_many_values(spark):
    """Against a plain search word by word, with a dictionary of 100,000 values."""
    chance = random.Random(5)
    words = [f"w{i}" for i in range(60_000)]
    dictionary = {w: i for i, w in enumerate(words)}
    for i in range(40_000):
        dictionary.setdefault(" ".join(chance.sample(words, chance.randrange(2, 4))), 60_000 + i)
    entries, rows = list(dictionary), []
    for number in range(300):
        said = [chance.choice([chance.choice(entries), f"x{number}", chance.choice(words).upper() + ","]) for _ in range(6)]
        rows.append((number, chance.choice([*said, *entries[:50]]), " ".join(said[:3]), chance.choice([None, " - ".join(said[2:])])))
    rows += [(900, None, "w1 w2", "w3"), (901, "", "w1", ""), (902, "nothing", "", None), (903, "Zed", "W5-w6", "...")]

    def plain(text):
        return f" {' '.join(re.findall('[^_\\W]+', (text or '').lower()))} "

    ranks = {}
    for entry, rank in dictionary.items():
        ranks[entry] = min(rank, ranks.get(entry, rank))
    want = []
    for number, value, title, description in rows:
        for source, text in (("title", title), ("description", description)):
            runs = plain(text).split()
            if value and text and plain(value) not in plain(text):
                grams = {" ".join(runs[i:i + n]) for n in (1, 2, 3) for i in range(len(runs) - n + 1)} & set(ranks)
                if grams:
                    best = min(grams, key=lambda g: (ranks[g], g))
                    want.append((number, "finish", source, value, f"'{best}' found in {source}"))
    frame = spark.createDataFrame(rows, "product_id int, value string, title string, description string")
    table = spark.createDataFrame([(w.title(), r) for w, r in dictionary.items()], "word string, rank int")
    found = dictionary_contradictions(frame, table, "finish")
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 200
    assert dictionary_contradictions(frame, table.limit(0), "finish").count() == 0


def test_extra_columns_win_over_standard_attributes(spark):
    frame = spark.createDataFrame([("blk", "raw "), ("blk", "nan"), ("n/a", None)], "a string, b string")
    rows = with_attributes(frame, {"color": F.col("a")}, [("Color", F.col("b"))]).collect()
    assert [r["attributes"] for r in rows] == [{"color": "raw"}, {"color": "Black"}, {}]


def test_fixed_lists_are_what_they_were():
    """The SQL of the queries shares these lists, so they are pinned here by their values."""
    assert set(fixed_values.NA_TOKENS) == {
        "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
        "NULL", "NaN", "None", "n/a", "nan", "null"}
    assert fixed_values.SOURCES == ["amazon", "walmart", "flipkart"]
    assert (fixed_values.INR_PER_USD, fixed_values.UNDERCUT_PERCENT, fixed_values.CHANGE_PERCENT) == (83.0, 5, 10)
    assert {fixed_values.SIZES[k] for k in ("xs", "sm", "med", "lg", "x-large", "2xl", "3xl")} == {
        "XS", "S", "M", "L", "XL", "XXL", "XXXL"}
    assert fixed_values.REQUIRED_ATTRIBUTES == ["color", "size", "material"]
    assert fixed_values.CONTAINERS_PER_PAGE == 5 and fixed_values.DEFAULT_CURRENCY == "USD"
