"""Captured pages: state, listings, label/value pairs, links. One page is parsed at a time, in partitions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import unique_key
from ..functions.text import normalize, parse_price, parse_ts

#: Rows of pages that are gathered before they go on.
ROWS = 1024

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Elements(HTMLParser):
    """Elements as (tag, attributes, text, depth) in the order of their starts; script and style have no text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.done.append([tag, dict(attrs), [], len(self.open), None])
        if tag not in VOID:
            self.open.append(len(self.done) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.done[self.open[k]][0] == tag:
                for i in self.open[k:]:
                    self.done[i][4] = len(self.done)
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and self.done[self.open[-1]][0] in ("script", "style"):
            return
        for i in self.open:
            self.done[i][2].append(data)


def elements(html: str) -> list[tuple[str, dict, str, int]]:
    """(tag, attributes, text in single blanks, index after its last descendant)."""
    parser = _Elements()
    parser.feed(html)
    parser.close()
    return [(tag, attrs, " ".join("".join(text).split()), end if end is not None else len(parser.done)) for tag, attrs, text, _, end in parser.done]


def _matches(rule: str, tag: str, attrs: dict) -> bool:
    """`tag`, `.class` or `tag.class`."""
    name, _, cls = rule.partition(".")
    return (not name or name == tag) and (not cls or cls in (attrs.get("class") or "").split())


def page_state(html: Column | str, results: Sequence[str], blocked: Sequence[str], login: Sequence[str]) -> Column:
    """results before blocked before login, else unknown: a page of results may speak of a captcha."""
    text = normalize(html)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    return F.when(has(results), "results").when(has(blocked), "blocked").when(has(login), "login").otherwise("unknown")


@dataclass(frozen=True)
class ListingRules:
    """What holds a card, and in it the title (its link is the card's), customer, price, published, deadline."""

    card: str
    title: str = "a"
    customer: str | None = None
    price: str | None = None
    published: str | None = None
    deadline: str | None = None
    number: str = r"№\s*(\d+)"
    source: str = "pages"


def _mapped(pages: DataFrame, columns: str, names: Sequence[str], cut, id_col: str, url_col: str, html_col: str) -> DataFrame:
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("page_url"), F.col(html_col).alias("html"))

    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in f"page_id {kind}, {columns}".split(", "))])

    def made(rows_: list) -> pa.RecordBatch:
        columns_ = list(zip(*rows_, strict=True)) or [[]] * (len(names) + 1)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns_, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        out = []
        for batch in batches:
            # one page at a time is text of Python, and rows go on before many are gathered
            for n in range(batch.num_rows):
                page, url, html = (c[n].as_py() for c in batch.columns)
                for row in cut(url or "", html):
                    out.append((page, *row))
                    if len(out) == ROWS:
                        yield made(out)
                        out = []
        yield made(out)

    return rows.mapInArrow(run, f"page_id {kind}, {columns}")


def extract_listings(pages: DataFrame, rules: ListingRules, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Notices of repeated cards on pages. Cards without title, link or number are dropped; later fields are column expressions."""

    def cut(url: str, html: str):
        all_ = elements(html)
        for i, (tag, attrs, text, end) in enumerate(all_):
            if not _matches(rules.card, tag, attrs):
                continue
            inner = all_[i + 1 : end]
            find = lambda rule, inner=inner: next(((a, t) for g, a, t, _ in inner if rule and _matches(rule, g, a)), ({}, None))
            head, title = find(rules.title)
            link = head.get("href") or next((a.get("href") for g, a, _, _ in inner if g == "a" and a.get("href")), None)
            yield i, title, urljoin(url, link) if link else None, find(rules.customer)[1], find(rules.price)[1], find(rules.published)[1], find(rules.deadline)[1], text

    names = ["pos", "title", "link", "customer", "price_text", "published_text", "deadline_text", "raw_text"]
    rows = _mapped(pages, "pos int, title string, link string, customer string, price_text string, published_text string, deadline_text string, raw_text string", names, cut, id_col, url_col, html_col)
    number = F.nullif(F.regexp_extract("raw_text", rules.number, 1), F.lit(""))
    rows = rows.withColumn("tender_number", number).where("title is not null and title <> '' and (link is not null or tender_number is not null)")
    return rows.select("page_id", "pos", "title", F.coalesce("link", F.lit("")).alias("url"), F.lit(rules.source).alias("source"), "tender_number", "customer", parse_price("price_text").alias("price"), parse_ts("published_text").alias("published_at"), parse_ts("deadline_text").alias("deadline"), "raw_text", unique_key(F.lit(rules.source), "tender_number", "link").alias("unique_key"))


def extract_label_values(pages: DataFrame, labels: Mapping[str, Sequence[str]], placeholders: Sequence[str] = ("информация отсутствует",), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page with a column per field: the value beside the field's first label that has one, in rows of two cells."""

    def cut(url: str, html: str):
        all_ = elements(html)
        for i, (tag, _, _, end) in enumerate(all_):
            if tag in ("tr", "dl"):
                cells = [t for g, _, t, _ in all_[i + 1 : end] if g in ("td", "th", "dt", "dd")]
                for k in range(0, len(cells) - 1, 2):
                    yield i + k, cells[k], cells[k + 1]

    rows = _mapped(pages, "pos int, label string, value string", ["pos", "label", "value"], cut, id_col, url_col, html_col)
    name = F.rtrim(normalize("label"), F.lit(":"))
    wanted = F.coalesce(*[F.when(name == label.lower(), F.struct(F.lit(f).alias("field"), F.lit(k).alias("prio"))) for f, ls in labels.items() for k, label in enumerate(ls)])
    rows = rows.withColumn("_w", wanted).where(F.col("_w").isNotNull() & (F.col("value") != "") & ~normalize("value").isin(*placeholders))
    best = rows.groupBy("page_id", F.col("_w.field").alias("field")).agg(F.min_by("value", F.struct("_w.prio", "pos")).alias("value"))
    return best.groupBy("page_id").pivot("field", list(labels)).agg(F.first("value"))


def extract_links(pages: DataFrame, hosts: Sequence[str] | None = None, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, link, text: absolute links, once per page, whose host is in one of the domains and whose path matches."""

    def cut(url: str, html: str):
        seen = set()
        for tag, attrs, text, _ in elements(html):
            if tag == "a" and attrs.get("href"):
                try:
                    link = urljoin(url, attrs["href"].strip())
                    known = urlsplit(link).scheme in ("http", "https")
                except ValueError:
                    continue
                if known and link not in seen:
                    seen.add(link)
                    yield link, text

    rows = _mapped(pages, "link string, text string", ["link", "text"], cut, id_col, url_col, html_col)
    from ..functions.ids import host, in_domain

    if hosts is not None:
        keep = F.lit(False)
        for h in hosts:
            keep = keep | in_domain("link", h)
        rows = rows.where(keep)
    if path is not None:
        rows = rows.where(F.regexp_extract("link", r"^[a-z]+://[^/]*(/[^?#]*)", 1).rlike(path))
    return rows.withColumn("host", host("link"))


def documents_url(url: Column | str, card: str, documents: str) -> Column:
    """The address of a card's documents, by rewriting its path."""
    u = F.col(url) if isinstance(url, str) else url
    return F.when(F.contains(u, F.lit(card)), F.replace(u, F.lit(card), F.lit(documents)))


def unparsed_pages(pages: DataFrame, parsed: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Pages without any extracted row, once per content: page id (the least) and digest."""
    left = pages.join(parsed.select(id_col).distinct(), id_col, "left_anti")
    return left.groupBy(F.sha1(F.col(html_col).cast("binary")).alias("digest")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def keep_regional(rows: DataFrame, pages: DataFrame, target: Column, region_text: Column | str = "region", id_col: str = "page_id") -> DataFrame:
    """Rows whose target region is known, or that print no region on a page that was filtered by region. pages: id, region_filtered, law."""
    p = pages.select(id_col, "region_filtered", "law")
    text = F.col(region_text) if isinstance(region_text, str) else region_text
    joined = rows.withColumn("_target", target).join(p, id_col, "left")
    keep = F.col("_target").isNotNull() | (F.coalesce("region_filtered", F.lit(False)) & (F.coalesce(text, F.lit("")) == ""))
    return joined.where(keep).withColumn("procurement_law", F.col("law")).drop("_target", "region_filtered", "law")


