"""Notices from XML files and JSON payload tables, by rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from xml.etree.ElementTree import Element, TreeBuilder
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import blank_null, unique_key
from ..functions.text import once, parse_price, parse_ts


@dataclass(frozen=True)
class XmlRules:
    """Names of elements per field, the first that isn't empty counts; the row elements."""

    rows: Sequence[str]
    fields: Mapping[str, Sequence[str]]
    source: str = "xml"


def _tree(xml: str) -> Element:
    """The root element; names keep their prefixes, which needn't be declared."""
    build, parser = TreeBuilder(), expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = build.start, build.end, build.data
    parser.Parse(xml, True)
    return build.close()


def _tags(xml: Column, names: Sequence[str]) -> Column:
    """The whole text of the first element of each local name, empty without one. A text is parsed once for all names."""

    @F.pandas_udf("array<string>")
    def first(texts: pd.Series) -> pd.Series:
        def of(text):
            if text is None:
                return None
            found: dict = {}
            for e in _tree(text).iter():
                found.setdefault(e.tag.rpartition(":")[2], e)
            return ["".join(found[n].itertext()) if n in found else "" for n in names]

        return texts.map(of)

    # else a filter on the values parses once more
    return first.asNondeterministic()(xml)


def _paths(xml: Column, firsts: Sequence[str], every: Sequence[str]) -> Column:
    """Per path below the root: the whole text of the first element, then of `every` path all texts that aren't empty. Parsed once for all paths."""

    @F.pandas_udf("array<array<string>>")
    def values(texts: pd.Series) -> pd.Series:
        def of(text):
            root = _tree(text)
            own = lambda e: [t for t in (e.text, *(c.tail for c in e)) if t]
            return [["".join(e.itertext()) for e in root.findall(p)[:1]] for p in firsts] + [[t for e in root.findall(p) for t in own(e)] for p in every]

        return texts.map(of)

    # else a filter on the values parses once more
    return values.asNondeterministic()(xml)


def read_notice_xml(files: DataFrame, rules: XmlRules, xml_col: str = "xml", file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """Notices and rejects (file, reason) of XML texts. Files that declare a DTD or entities are rejected; a number counts once per file."""
    bad = F.col(xml_col).rlike(r"(?i)<!(DOCTYPE|ENTITY)")
    rejects = files.where(bad).select(file_col, F.lit("doctype").alias("reason"))
    names = "|".join(rules.rows)
    # prefixes and attributes of namespaces go, so that names are matched as they are written
    plain = F.regexp_replace(F.regexp_replace(xml_col, r"<(/?)[A-Za-z_][\w.-]*:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"|\s\w+:\w+=\"[^\"]*\"", "")
    pieces = F.regexp_extract_all(plain, F.lit(rf"(?s)<(?:{names})(?:\s[^>]*)?>.*?</(?:{names})>"), F.lit(0))
    rows = files.where(~bad).select(F.col(file_col).alias("file"), F.posexplode(pieces).alias("_pos", "_xml"))
    tags = sorted({t for ts in rules.fields.values() for t in ts})
    rows = rows.withColumn("_v", _tags(F.col("_xml"), tags)).drop("_xml")
    found = {f: F.coalesce(*[blank_null(F.trim(F.get("_v", F.lit(tags.index(t))))) for t in ts]) for f, ts in rules.fields.items()}
    rows = rows.withColumns({f: found.get(f, F.lit(None).cast("string")) for f in ("title", "tender_number", "customer", "price", "deadline", "time", "published_at", "status", "url", "region")})
    from ..operators.dedup import keep_first

    rows = keep_first(rows.where("title is not null and (tender_number is not null or url is not null)"), ["file", "tender_number", "url"], ["_pos"])
    day = F.to_date(parse_ts("deadline"))
    clock = F.coalesce("time", F.when(~F.col("deadline").rlike(r"\d:\d"), "23:59:59"))
    deadline = F.when(clock.isNotNull(), F.to_timestamp(F.concat(day.cast("string"), F.lit(" "), clock))).otherwise(parse_ts("deadline"))
    out = rows.select("title", F.coalesce("url", F.lit("")).alias("url"), F.lit(rules.source).alias("source"), "tender_number", "customer", "region", F.coalesce(F.col("price").try_cast("double"), parse_price("price", False)).alias("price"), deadline.alias("deadline"), "status", parse_ts("published_at").alias("published_at"), unique_key(F.lit(rules.source), "tender_number", "url").alias("unique_key"))
    return out, rejects


def _inner_text(x: Column) -> Column:
    """Character data of an element as it is written: CDATA opened, entities read, tags gone."""
    plain = F.regexp_replace(x, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return plain


def read_rss(files: DataFrame, labels: Mapping[str, Sequence[str]], source: str = "rss", xml_col: str = "xml", file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """Notices and rejects of RSS feeds: title, link (else guid), pubDate, and labelled lines of the description.

    A label's value runs to the next line of the description, whose tags break lines. Items
    without a title or link are left out; feeds that declare a DTD or entities are rejected.
    """
    bad = F.col(xml_col).rlike(r"(?i)<!(DOCTYPE|ENTITY)")
    items = F.regexp_extract_all(xml_col, F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1))
    tag = lambda item, name: once(F.trim(_inner_text(F.regexp_extract(item, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1))), blank_null)
    plain = lambda item: F.regexp_replace(F.regexp_replace(F.coalesce(tag(item, "description"), F.lit("")), r"(?i)<(?:br|/p|/div|/li)\s*/?>", "\n"), r"(?s)<[^>]*>", "")
    # taken from the item before items become rows, and without a filter that Spark derives for inner rows: else they are taken several times
    parsed = F.transform(items, lambda i: F.struct(tag(i, "title").alias("title"), F.coalesce(tag(i, "link"), tag(i, "guid")).alias("url"), tag(i, "pubDate").alias("_published"), plain(i).alias("_lines")))
    rows = files.where(~bad).select(F.inline_outer(parsed)).where("title is not null and url is not null")

    def value(name: str) -> Column:
        found = [once(F.trim(F.regexp_extract("_lines", rf"(?iU)(?:^|\n)\s*{label}\s*:\s*([^\n]*)", 1)), blank_null) for label in labels.get(name, ())]
        return F.coalesce(*found, F.lit(None).cast("string"))

    rows = rows.select("title", "url", "_lines", *[value(n).alias(n) for n in ("tender_number", "customer", "region", "price", "deadline")], F.try_to_timestamp(F.regexp_replace("_published", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published_at"))
    out = rows.select(
        "title", "url", F.lit(source).alias("source"), "tender_number", "customer", "region", parse_price("price", False).alias("price"), parse_ts("deadline").alias("deadline"), "published_at",
        F.trim(F.regexp_replace(F.concat_ws(" ", "title", "_lines"), r"(?U)\s+", " ")).alias("raw_text"), unique_key(F.lit(source), "tender_number", "url").alias("unique_key"),
    )
    return out, files.where(bad).select(file_col, F.lit("doctype").alias("reason"))


#: Names of the rouble in procedures.
ROUBLES = ("RUB", "RUR", "РУБ", "РУБЛЬ")


def read_procedures(files: DataFrame, source: str = "soap", xml_col: str = "xml", file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """Notices and rejects of SOAP answers with procedures of several lots: the price is the sum of the lots' where the currency is the rouble.

    The number is registryNumber, else eisRegistryNumber, else remoteId; a procedure without
    a title has that of its first lot with a subject; one without number or title is left out.
    """
    bad = F.col(xml_col).rlike(r"(?i)<!(DOCTYPE|ENTITY)")
    plain = F.regexp_replace(F.regexp_replace(xml_col, r"<(/?)[A-Za-z_][\w.-]*:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"|\s\w+:\w+=\"[^\"]*\"", "")
    pieces = F.regexp_extract_all(plain, F.lit(r"(?s)<procedure(?:\s[^>]*)?>.*?</procedure>"), F.lit(0))
    # answers are long rows, of which few bytes make many to parse: they are dealt to all tasks
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.where(~bad).repartition(tasks, F.col(file_col)).select(F.explode(pieces).alias("_xml"))
    firsts = ["title", "registryNumber", "eisRegistryNumber", "remoteId", "url_to_showcase", "organizer/fullName", "currency", "dateEndRegistration", "datePublished"]
    lists = ["lots/lot/subject", "lots/lot/startPrice", "lots/lot/customers/customer/fullName"]
    rows = rows.select(_paths(F.col("_xml"), firsts, lists).alias("_v"))
    every = lambda path: F.get("_v", F.lit([*firsts, *lists].index(path)))
    one = lambda path: blank_null(F.trim(F.get(every(path), F.lit(0))))
    subjects, prices = every("lots/lot/subject"), F.array_compact(F.transform(every("lots/lot/startPrice"), lambda p: F.translate(p, ",", ".").try_cast("double")))
    customers = F.filter(every("lots/lot/customers/customer/fullName"), lambda c: F.trim(c) != "")
    rows = rows.select(
        F.coalesce(one("title"), F.get(F.filter(subjects, lambda s: F.trim(s) != ""), F.lit(0))).alias("title"),
        F.coalesce(one("registryNumber"), one("eisRegistryNumber"), one("remoteId")).alias("tender_number"),
        F.coalesce(one("url_to_showcase"), F.lit("")).alias("url"),
        F.coalesce(F.get(customers, F.lit(0)), one("organizer/fullName")).alias("customer"),
        F.when(F.upper(one("currency")).isin(*ROUBLES) & (F.size(prices) > 0), F.aggregate(prices, F.lit(0.0), lambda a, p: a + p)).alias("price"),
        one("eisRegistryNumber").alias("official_number"),
        parse_ts(one("dateEndRegistration")).alias("deadline"),
        parse_ts(one("datePublished")).alias("published_at"),
        F.size(every("lots/lot/startPrice")).alias("lots"),
    )
    out = rows.where("title is not null and tender_number is not null").withColumns({"source": F.lit(source), "unique_key": unique_key(F.lit(source), "tender_number", "url")})
    return out, files.where(bad).select(file_col, F.lit("doctype").alias("reason"))


@dataclass(frozen=True)
class JsonRules:
    """One platform's payload: the schema, the path of its array, paths per field (the first that is there counts)."""

    schema: str
    rows: str
    fields: Mapping[str, Sequence[str]]
    source: str
    allow: tuple[str, Sequence[str]] | None = None
    region: str | None = None
    raw: Sequence[str] = field(default_factory=tuple)
    #: A field of the row that holds XML, and the tags in it per notice field, tried after the row's own paths.
    xml: str | None = None
    tags: Mapping[str, Sequence[str]] = field(default_factory=dict)


def read_notice_json(payloads: DataFrame, rules: JsonRules, json_col: str = "payload", order: Sequence[str] = ()) -> DataFrame:
    """Flattens payloads to notices; rows outside the allow-list or without title or number and link are left out."""
    parsed = payloads.select(*order, F.from_json(json_col, rules.schema).alias("p")).select(*order, F.posexplode(f"p.{rules.rows}").alias("_pos", "r"))
    if rules.allow:
        parsed = parsed.where(F.col(f"r.{rules.allow[0]}").isin(*rules.allow[1]))
    if rules.xml:
        declared = F.col(f"r.{rules.xml}").rlike(r"(?i)<!(DOCTYPE|ENTITY)")
        tags = sorted({t for ts in rules.tags.values() for t in ts})
        parsed = parsed.withColumn("_xml", F.when(~declared, F.col(f"r.{rules.xml}"))).withColumn("_v", _tags(F.col("_xml"), tags))

    def text(name: str) -> Column:
        own = [blank_null(F.trim(F.col(f"r.{p}").cast("string"))) for p in rules.fields.get(name, ())]
        inner = [blank_null(F.trim(F.get("_v", F.lit(tags.index(t))))) for t in rules.tags.get(name, ())] if rules.xml else []
        return F.coalesce(*own, *inner, F.lit(None).cast("string"))

    rows = parsed.select(
        *order, "_pos", text("title").alias("title"), F.coalesce(text("url"), F.lit("")).alias("url"), F.lit(rules.source).alias("source"), text("tender_number").alias("tender_number"), text("customer").alias("customer"),
        (F.lit(rules.region) if rules.region else text("region")).alias("region"), F.coalesce(text("price").try_cast("double"), parse_price(text("price"), False)).alias("price"), parse_ts(text("deadline")).alias("deadline"),
        text("status").alias("status"), parse_ts(text("published_at")).alias("published_at"), F.concat_ws(" ", *[F.col(f"r.{p}").cast("string") for p in rules.raw]).alias("raw_text"),
    )
    rows = rows.where("title is not null and (tender_number is not null or url <> '')")
    return rows.withColumn("unique_key", unique_key("source", "tender_number", "url"))
