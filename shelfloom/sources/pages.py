"""Listings read off stored marketplace pages.

HTML has no Spark function. Pages are read one by one inside mapInArrow, up to the last container
that counts, and only listings leave it, so raw HTML never takes part in a shuffle. Prices are read
from their text afterwards, by Spark.
"""

import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from shelfloom.fixed_values import CONTAINERS_PER_PAGE, LISTING_RULES
from shelfloom.functions.money import extract_price

# The parser travels to the tasks with the job, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
}
_UNSEEN = {"script", "style", "template"}

_RAW_LISTING = pa.schema([
    ("page_id", pa.int64()), ("product_id", pa.int64()), ("source", pa.string()),
    ("listing_rank", pa.int32()), ("title", pa.string()), ("price_text", pa.string()),
    ("currency", pa.string()), ("in_stock", pa.bool_()), ("url", pa.string()),
])


# Characters of a page that the parser is given at a time. Page text that has no end yet is looked
# at again with each piece, so pieces grow.
_FIRST_PIECE, _LARGEST_PIECE = 1 << 16, 1 << 22

_STEP = re.compile(r"(?P<tag>[\w-]+)(?:\.(?P<css>[\w-]+))?(?:\[(?P<name>[\w-]+)(?:='(?P<value>[^']*)')?\])?")


def selector_steps(selector: str) -> list:
    """(tag, class, attribute, value) of each step from ancestor to element; None for what is not asked."""
    found = [_STEP.fullmatch(step) for step in selector.split()]
    if not found or not all(found):
        raise ValueError(f"no selector: {selector!r}")
    return [step.group("tag", "css", "name", "value") for step in found]


def _fits(tag: str, attributes: dict, step: tuple) -> bool:
    wanted, css_class, name, value = step
    return tag == wanted and (
        css_class is None or css_class in attributes.get("class", "").split()) and (
        name is None or name in attributes and value in (None, attributes[name]))


class _Found:
    """An element that a selector has met: its link, and the texts below it while it is open."""

    __slots__ = ("href", "texts", "hidden")

    def __init__(self, href: str, hidden: int):
        self.href, self.texts, self.hidden = href, [], hidden

    def stripped(self) -> str:
        return "".join(text.strip() for text in self.texts)


class _Listings(HTMLParser):
    """The first containers of a page and what they hold, met while the page is read.

    No tree is built. An open element is its tag, how many leading steps of each selector it and its ancestors
    fit, and what ends with it; so memory goes by the depth of the page and the texts of the elements found. An
    end tag closes the nearest open element of its name.
    """

    FIELDS = ("title", "price", "price_fraction", "link")

    def __init__(self, rules: dict, limit: int):
        super().__init__(convert_charrefs=True)
        self.limit = limit
        self.kinds = [selector_steps(s) for s in rules["containers"]]
        self.wanted = [(field, n, selector_steps(s)) for field in self.FIELDS for n, s in enumerate(rules[field])]
        self.selectors = [*self.kinds, *(steps for _, _, steps in self.wanted)]
        # Containers of each kind in page order; a container maps (field, alternative) to its first element.
        self.containers = [[] for _ in self.kinds]
        self.open = [("", [0] * len(self.selectors), [], [])]
        self.around, self.listening, self.pending, self.hidden = [], [], [], 0

    def read(self, html: str) -> list:
        """The containers that count: those of the first kind that the page has."""
        at, size = 0, _FIRST_PIECE
        while at < len(html) and not self.is_done():
            self.feed(html[at:at + size])
            at, size = at + size, min(2 * size, _LARGEST_PIECE)
        if not self.is_done():
            self.close()
            self._flush()
        return next((found for found in self.containers if found), [])

    def is_done(self) -> bool:
        """Whether the first kind has all containers that count, and they are closed."""
        return len(self.containers[0]) >= self.limit and not any(c in self.containers[0] for c in self.around)

    def _flush(self):
        if self.pending:
            text = "".join(self.pending)
            self.pending = []
            for found in self.listening:
                if found.hidden == self.hidden:
                    found.texts.append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        attributes = {name: value or "" for name, value in attrs}
        above = self.open[-1][1]
        fitted, met = [], []
        for steps, count in zip(self.selectors, above, strict=True):
            last = len(steps) - 1
            met.append(count == last and _fits(tag, attributes, steps[last]))
            fitted.append(count + (count < last and _fits(tag, attributes, steps[count])))
        hides = tag in _UNSEEN
        self.hidden += hides
        own = []
        for (field, n, _), hit in zip(self.wanted, met[len(self.kinds):], strict=True):
            if hit:
                for container in self.around:
                    if (field, n) not in container:
                        container[field, n] = found = _Found(attributes.get("href"), self.hidden)
                        own.append(found)
        self.listening += own
        begun = []
        for found, hit in zip(self.containers, met, strict=False):
            if hit and len(found) < self.limit:
                found.append(container := {})
                begun.append(container)
        self.around += begun
        self.open.append((tag, fitted, own, begun))
        if tag in _VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._end()

    def _end(self):
        tag, _, own, begun = self.open.pop()
        self.hidden -= tag in _UNSEEN
        if own:
            self.listening = self.listening[:-len(own)]
        if begun:
            self.around = self.around[:-len(begun)]

    def handle_endtag(self, tag):
        self._flush()
        if any(open_tag == tag for open_tag, *_ in self.open[1:]):
            while self.open[-1][0] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if self.listening:
            self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()


def page_listings(html: str, rules: dict, limit: int = CONTAINERS_PER_PAGE) -> list:
    """(title, price text, url) of the titled listings among a page's first containers."""
    listings = []
    for container in _Listings(rules, limit).read(html):
        def first(field):
            return next((container[field, n] for n in range(len(rules[field])) if (field, n) in container), None)

        title = first("title")
        title = title.stripped() if title else ""
        if not title:
            continue
        price, fraction = first("price"), first("price_fraction")
        text = None
        if price is not None:
            text = price.stripped() + (fraction.stripped() if fraction else "") \
                if rules["price_fraction"] else "".join(price.texts)
        link = first("link")
        url = link.href if link else None
        if url and not (rules["keep_absolute_links"] and url.startswith("http")):
            url = rules["host"] + url
        listings.append((title, text, url or None))
    return listings


def read_listings(pages: DataFrame, rules: dict = None, limit: int = CONTAINERS_PER_PAGE) -> DataFrame:
    """Listings of stored pages (page_id, product_id, source, html), ranked from 0.

    ``rules`` maps a source to how its listings are found; pages of other
    sources and pages without HTML give no listings.
    """
    rules = rules or LISTING_RULES

    def parse(batches):
        for batch in batches:
            rows = []
            for page_id, product_id, source, html in zip(*(c.to_pylist() for c in batch.columns)):
                rule = rules[source]
                for rank, (title, price, url) in enumerate(page_listings(html, rule, limit)):
                    rows.append((page_id, product_id, source, rank, title, price,
                                 rule["currency"], True, url))
            columns = list(zip(*rows)) or [()] * len(_RAW_LISTING)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _RAW_LISTING)], schema=_RAW_LISTING
            )

    wanted = pages.filter(F.col("html").isNotNull() & F.col("source").isin(list(rules))).select(
        "page_id", "product_id", "source", "html"
    )
    raw = wanted.mapInArrow(parse, from_arrow_schema(_RAW_LISTING))
    return raw.select(
        "page_id", "product_id", "source", "listing_rank", "title",
        extract_price(F.col("price_text")).alias("price"), "currency", "in_stock", "url",
    )


def best_listings(listings: DataFrame) -> DataFrame:
    """The first listing of each product and marketplace.

    With several pages for one pair, the page with the lowest id counts. Rows
    are combined before the shuffle.
    """
    first = listings.filter(F.col("listing_rank") == 0)
    fields = ["page_id", "title", "price", "currency", "in_stock", "url"]
    return (
        first.groupBy("product_id", "source")
        .agg(F.min_by(F.struct(*fields), "page_id").alias("_best"))
        .select("product_id", "source", "_best.*")
    )
