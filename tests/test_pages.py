"""Listings on marketplace pages."""

import random
import tracemalloc
from html.parser import HTMLParser

import pytest

from shelfloom.fixed_values import LISTING_RULES
from shelfloom.schemas import LISTING
from shelfloom.sources import pages
from shelfloom.sources.pages import best_listings, page_listings, read_listings, selector_steps

SCHEMA = "page_id bigint, product_id bigint, source string, html string"


def listings(spark, source, html):
    rows = read_listings(spark.createDataFrame([(1, 10, source, html)], SCHEMA)).collect()
    return [(r["title"], r["price"], r["url"]) for r in sorted(rows, key=lambda r: r["listing_rank"])]


def amazon(title="T", whole="1,299.", fraction="50", link="/dp/1"):
    return (
        f'<div class="r" data-component-type="s-search-result"><h2><a href="{link}"><span>{title}</span></a></h2>'
        f'<span class="a-price-whole">{whole}</span><span class="a-price-fraction">{fraction}</span></div>')


def test_amazon(spark):
    page = "<body>" + amazon(" A &amp; <b>B</b> ") + amazon("", link="/x") + amazon("C", "12", "") + amazon("D", "", "") \
        + amazon("E") + amazon("sixth") + amazon("seventh")
    assert listings(spark, "amazon", page) == [
        ("A &B", 1299.5, "https://www.amazon.com/dp/1"), ("C", 12.0, "https://www.amazon.com/dp/1"),
        ("D", None, "https://www.amazon.com/dp/1"), ("E", 1299.5, "https://www.amazon.com/dp/1")]


def test_amazon_without_price_or_link(spark):
    page = '<div data-component-type="s-search-result"><h2><a><span>T</span></a></h2></div>' \
           '<div data-component-type="other"><h2><a><span>X</span></a></h2></div>'
    assert listings(spark, "amazon", page) == [("T", None, None)]


def test_walmart_links(spark):
    def item(link):
        return f'<div data-item-id="9"><a link-identifier="9" href="{link}"></a>' \
               '<span data-automation-id="product-title"> W </span>' \
               '<div data-automation-id="product-price"><p><span>current $1,005.50</span></p></div></div>'
    assert listings(spark, "walmart", item("https://w.example/a") + item("/ip/2")) == [
        ("W", 1005.5, "https://w.example/a"), ("W", 1005.5, "https://www.walmart.com/ip/2")]


def test_flipkart_first_and_second_choice(spark):
    first = '<div class="x _1AtVbE"><div class="_4rR01T">F1</div><div class="_30jeq3">₹45,999</div><a class="_1fQZEK" href="/a"></a></div>'
    second = '<div class="tUxRFH"><a class="IRpwTa" href="/b">F2</a><div class="_30jeq3">₹10</div></div>'
    assert listings(spark, "flipkart", second) == [("F2", 10.0, "https://www.flipkart.com/b")]
    # The second kind of container counts only on pages without the first.
    assert listings(spark, "flipkart", first + second) == [("F1", 45999.0, "https://www.flipkart.com/a")]


def test_untidy_html(spark):
    page = "<div><p>open<br></span>" + amazon("T<script>var a='</p>'</script><!-- c -->U") + "<style>h2{}</style"
    assert listings(spark, "amazon", page) == [("TU", 1299.5, "https://www.amazon.com/dp/1")]


def test_pages_without_listings(spark):
    rows = [(1, 1, "amazon", None), (2, 1, "elsewhere", amazon()), (3, 1, "amazon", "")]
    assert read_listings(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_defaults_and_best(spark):
    rows = [(1, 10, "amazon", amazon("first") + amazon("second")), (2, 10, "amazon", amazon("later page")),
            (3, 11, "flipkart", '<div class="tUxRFH"><a class="IRpwTa">F</a></div>')]
    found = read_listings(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == LISTING.fieldNames()
    assert {(r["source"], r["currency"], r["in_stock"]) for r in found.collect()} == {
        ("amazon", "USD", True), ("flipkart", "INR", True)}
    assert sorted((r["product_id"], r["title"]) for r in best_listings(found).collect()) == [(10, "first"), (11, "F")]


def test_rules_can_be_given(spark):
    rules = {"generic": {**LISTING_RULES["walmart"], "containers": ["body"], "title": ["h1"]}}
    assert page_listings("<body><h1>x</h1></body>", rules["generic"]) == [("x", None, None)]


class _Tree(HTMLParser):
    """A plain tree of a page, for listings by whole searches."""

    VOID = {"br", "img", "input", "hr", "meta", "link"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = {"tag": "", "attrs": {}, "up": None, "below": []}
        self.goes_on = False  # a tag of any kind ends a text
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.goes_on = False
        made = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "up": self.at, "below": []}
        self.at["below"].append(made)
        if tag not in self.VOID:
            self.at = made

    def handle_endtag(self, tag):
        self.goes_on = False
        node = self.at
        while node["up"] and node["tag"] != tag:
            node = node["up"]
        if node["up"]:
            self.at = node["up"]

    def handle_data(self, data):
        if self.goes_on:
            self.at["below"][-1] += data
        else:
            self.at["below"].append(data)
        self.goes_on = True


def below(node):
    for child in node["below"]:
        if not isinstance(child, str):
            yield child
            yield from below(child)


def plain_texts(node):
    for child in node["below"]:
        if isinstance(child, str):
            yield child
        elif child["tag"] not in ("script", "style", "template"):
            yield from plain_texts(child)


def plain_fit(node, selector):
    *above, last = selector_steps(selector)

    def one(x, step):
        tag, css, name, value = step
        return x["tag"] == tag and (css is None or css in x["attrs"].get("class", "").split()) and (
            name is None or name in x["attrs"] and value in (None, x["attrs"][name]))

    up = node["up"]
    while above and up:
        if one(up, above[-1]):
            above.pop()
        up = up["up"]
    return not above and one(node, last)


def plain_listings(html, rules):
    root = _Tree(html).root
    kinds = [[x for x in below(root) if plain_fit(x, s)] for s in rules["containers"]]
    out = []
    for container in next((k for k in kinds if k), [])[:5]:
        first = {f: next((x for s in rules[f] for x in below(container) if plain_fit(x, s)), None)
                 for f in ("title", "price", "price_fraction", "link")}
        title = "".join(t.strip() for t in plain_texts(first["title"])) if first["title"] else ""
        if title:
            price = "".join(t.strip() if rules["price_fraction"] else t for t in plain_texts(first["price"])) if first["price"] else None
            if price is not None and first["price_fraction"]:
                price += "".join(t.strip() for t in plain_texts(first["price_fraction"]))
            out.append((title, price, first["link"]["attrs"].get("href") if first["link"] else None))
    return out


def test_one_pass_equals_whole_searches(monkeypatch):
    """Random untidy pages: nested containers, tags without ends, ends without tags, text in scripts."""
    rules = {"containers": ["div.c", "p[data-x]"], "title": ["h2 a b", "i"], "price": ["b.p"], "price_fraction": ["b[q='1']"],
             "link": ["h2 a"], "host": "", "keep_absolute_links": False, "currency": "USD"}
    chance = random.Random(11)
    parts = ['<div class="x c">', '<div class="c">', "<div>", "</div>", "<p data-x>", "</p>", "<h2>", "</h2>", '<a href="/1">', "</a>",
             "<b>", '<b class="p">', '<b q="1">', "</b>", "<i>", "</i>", "<br>", "<b/>", " text ", "1 &amp; 2", "<script>", "</script>",
             "&lt;b&gt;", "</nothing>"]
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(pages, "_FIRST_PIECE", size)
        monkeypatch.setattr(pages, "_LARGEST_PIECE", size)
        for _ in range(300):
            html = "".join(chance.choice(parts) for _ in range(chance.randrange(3, 80)))
            assert [(t, p, u) for t, p, u in page_listings(html, rules)] == [
                (t, p, u or None) for t, p, u in plain_listings(html, rules)], html


def test_a_large_page_takes_little_memory_and_ends_early(monkeypatch):
    filler = "<div><p>" + "word " * 200 + "</p></div>"
    page = "<body>" + filler * 10 + amazon("A") * 3 + filler * 50_000 + amazon("B") * 4
    assert len(page) > 50_000_000
    tracemalloc.start()
    found = page_listings(page, LISTING_RULES["amazon"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [t for t, _, _ in found] == ["A", "A", "A", "B", "B"] and peak < 30_000_000
    read = []
    whole = pages._Listings.feed
    monkeypatch.setattr(pages._Listings, "feed", lambda self, piece: read.append(len(piece)) or whole(self, piece))
    page_listings(amazon("A") * 5 + filler * 5000, LISTING_RULES["amazon"])
    assert sum(read) <= 1 << 16


def test_selectors_are_checked():
    assert selector_steps("div.c a[href='x'] b[y]") == [("div", "c", None, None), ("a", None, "href", "x"), ("b", None, "y", None)]
    for wrong in ("", "div > a", "a:first"):
        with pytest.raises(ValueError):
            selector_steps(wrong)
