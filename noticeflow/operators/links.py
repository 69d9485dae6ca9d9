"""Official numbers and links of notices: from other records, captured pages and caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import blank_null, host, law_for_number
from ..functions.text import normalize, quoted, search_tokens
from .contain import contained
from .lineage import stored

#: Notices of one title, and documents, whose pairs one task gives together.
SHARE = 2000


def direct_links(df: DataFrame, registries: Sequence[str], platforms: Sequence[str], mixed: Sequence[str], registry_host: str, registry_name: str) -> DataFrame:
    """Fills official fields of registry sources and platform fields of platforms; of mixed sources the link's host decides. What is there stays."""
    number, source = F.trim(F.coalesce("tender_number", F.lit(""))), F.col("source")
    law = law_for_number(number)
    official = law.isNotNull() & (source.isin(*registries) | (source.isin(*mixed) & (host("url") == registry_host)))
    official = F.coalesce(official, F.lit(False))
    platform = ~official & source.isin(*platforms, *mixed)
    either = official | platform
    method = F.when(source.isin(*mixed), F.when(official, "mixed-direct-registry").otherwise("mixed-direct-platform")).otherwise("source-native")
    fill = lambda c, when, value: F.when(when, F.coalesce(blank_null(c), value)).otherwise(F.col(c))
    return df.withColumns(
        {
            "official_number": fill("official_number", official, number),
            "official_url": fill("official_url", official, F.col("url")),
            "official_source": fill("official_source", official, F.lit(registry_name)),
            "platform_number": fill("platform_number", platform, F.col("tender_number")),
            "platform_url": fill("platform_url", platform, F.col("url")),
            "procurement_law": fill("procurement_law", either, law),
            "resolution_method": fill("resolution_method", either, method),
            "resolution_confidence": F.when(either, F.greatest("resolution_confidence", F.lit(1.0))).otherwise(F.col("resolution_confidence")),
        }
    )


def official_matches(wanted: DataFrame, collected: DataFrame, registry: Column, key: str = "unique_key") -> DataFrame:
    """Per aggregator row (key, number): the collected registry record's link and the first platform record's number and link.

    Collected records are found by their official or own number, where it has a valid
    length; registry tells which are of the registry. collected needs seq.
    """
    numbers = F.array_distinct(F.filter(F.array("official_number", "tender_number"), lambda n: law_for_number(n).isNotNull()))
    c = collected.withColumn("_reg", registry).select(F.explode(numbers).alias("number"), "_reg", "url", "official_url", "platform_number", "platform_url", "tender_number", "source", "seq")
    j = wanted.select(F.col(key), F.col("number")).join(c, "number")
    pick = lambda value, when: F.min_by(value, F.when(when, F.col("seq")))
    reg = F.col("_reg")
    return j.groupBy(key, "number").agg(
        pick(F.coalesce(blank_null("official_url"), F.col("url")), reg).alias("official_url"),
        pick(F.col("source"), reg).alias("official_source"),
        pick(F.coalesce(blank_null("platform_number"), F.col("tender_number")), ~reg).alias("platform_number"),
        pick(F.coalesce(blank_null("platform_url"), F.col("url")), ~reg).alias("platform_url"),
    )


def resolve(wanted: DataFrame, matches: DataFrame, cache: DataFrame, now: Column, positive_hours: float = 12, negative_hours: float = 24, key: str = "unique_key") -> DataFrame:
    """Outcome per aggregator row (key, number, conflict): from collected records, else from a fresh cache entry, else to be looked up.

    Returns key, official_number, official_url, platform_number, platform_url, procurement_law, resolution_method,
    resolution_confidence, lookup (boolean). cache: number, status (exact, not_found, error), url, checked_at.
    """
    c = cache.select("number", F.col("status").alias("_st"), F.col("url").alias("_url"), ((F.unix_timestamp(now) - F.unix_timestamp("checked_at")) / 3600.0).alias("_age"))
    m = matches.select(key, "official_url", "platform_number", "platform_url", F.lit(True).alias("_m"))
    rows = wanted.join(m, key, "left").join(c, "number", "left")
    matched = F.coalesce("_m", F.lit(False))
    exact = ~matched & (F.col("_st") == "exact") & (F.col("_age") <= positive_hours)
    absent = ~matched & (F.col("_st") == "not_found") & (F.col("_age") <= negative_hours)
    exact, absent = F.coalesce(exact, F.lit(False)), F.coalesce(absent, F.lit(False))
    known = F.col("number").isNotNull() & ~F.coalesce("conflict", F.lit(False))
    url = F.when(matched, F.col("official_url")).when(exact, F.col("_url"))
    sure = known & url.isNotNull()
    method = F.when(~known, F.when(F.coalesce("conflict", F.lit(False)), "meta-conflict").otherwise("unresolved")).when(exact, "meta+registry-exact").when(matched & (url.isNotNull() | F.col("platform_url").isNotNull()), "meta+collected-exact").otherwise("meta+unverified")
    return rows.select(
        key,
        F.when(sure, F.col("number")).alias("official_number"),
        F.when(sure, url).alias("official_url"),
        F.when(known & ~sure, F.coalesce("platform_number", "number")).otherwise(F.when(known, F.col("platform_number"))).alias("platform_number"),
        F.when(known, F.col("platform_url")).alias("platform_url"),
        F.when(known, law_for_number("number")).alias("procurement_law"),
        method.alias("resolution_method"),
        F.when(~known, 0.0).when(method == "meta+unverified", 0.6).otherwise(1.0).alias("resolution_confidence"),
        (known & ~matched & ~exact & ~absent).alias("lookup"),
    )


def verify_links(df: DataFrame, pages: DataFrame, not_found: Sequence[str], number: str = "official_number", url: str = "official_url") -> DataFrame:
    """Adds link_state: confirmed (the page holds the number as whole digits and isn't a not-found page), invalid, or unchecked. pages: url, text."""
    p = pages.groupBy(F.col("url").alias("_u")).agg(F.min("text").alias("_t"))
    rows = df.join(p, F.col(url) == F.col("_u"), "left")
    missing = F.exists(F.array(*[F.lit(w) for w in not_found]), lambda w: F.contains(normalize("_t"), w))
    there = F.rlike(F.col("_t"), F.concat(F.lit(r"(?<!\d)"), quoted(F.col(number)), F.lit(r"(?!\d)")))
    return rows.withColumn("link_state", F.when(F.col("_u").isNull(), "unchecked").when(~missing & there, "confirmed").otherwise("invalid")).drop("_u", "_t")


def apply_evidence(notices: DataFrame, evidence: DataFrame, key: str = "unique_key") -> DataFrame:
    """Pairs (key, doc_id) of notices whose number is a token of a document, or whose title stands in it.

    Numbers join as tokens, titles as parts of texts (operators.contain). evidence: doc_id, text.
    """
    n = notices.select(key, normalize("tender_number").alias("_num"), normalize("title").alias("_title"))
    d = evidence.select("doc_id", normalize("text").alias("_text"))
    tokens = d.select("doc_id", F.explode(search_tokens("_text")).alias("_num"))
    # small files of many rows, which grow with the tables: not to be sent to every task
    titled = stored(n.select(key, "_title").where("_title <> ''").distinct()).hint("merge")
    found = stored(contained(d, titled, "doc_id", "_text", "_title")).hint("merge")
    # a key's number and titles give a pair once each: pairs by number that a title gives go, and keys of several titles are made distinct
    by_number = n.select(key, "_num").where("_num <> ''").distinct().join(tokens, "_num").select(key, "doc_id").distinct()
    here, there = F.col(key).eqNullSafe(F.col("_key")), titled.withColumnRenamed(key, "_key")
    twice = by_number.join(there, here).join(found, ["doc_id", "_title"]).select("_key", F.col("doc_id").alias("_doc")).distinct()
    by_number = by_number.join(twice, here & (F.col("doc_id") == F.col("_doc")), "left_anti")
    titles = titled.groupBy(key).agg(F.collect_list("_title").alias("_titles"))
    several = titles.where(F.size("_titles") > 1).select(key, F.explode("_titles").alias("_title")).join(found, "_title").select(key, "doc_id").distinct()
    single = titles.where(F.size("_titles") == 1).select(key, F.col("_titles")[0].alias("_title"))
    return _paired(single, found, key).union(several).union(by_number)


def _paired(titles: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, doc_id) of equal titles. A title's notices and documents go in shares; each share of the ones meets each of the others, in as many tasks as the pairs need."""
    many = lambda df, name: df.groupBy("_title").agg(F.count(F.lit(1)).alias(name))
    sizes = stored(many(titles, "_notices").join(many(found, "_docs"), "_title"))
    pairs = sizes.agg(F.sum(F.col("_notices") * F.col("_docs"))).first()[0] or 0
    tasks = max(pairs // SHARE**2, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = lambda n: F.ceil(F.col(n) / SHARE).cast("int")
    large = sizes.where((F.col("_notices") > SHARE) | (F.col("_docs") > SHARE)).select("_title", shares("_notices").alias("_rows"), shares("_docs").alias("_columns"))
    own = lambda by, n: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    block = ["_title", "_row", "_column"]
    rows = titles.join(large, "_title", "left").select(key, "_title", own(key, "_rows").alias("_row"), every("_columns").alias("_column"))
    columns = found.join(large, "_title", "left").select("doc_id", "_title", own("doc_id", "_columns").alias("_column"), every("_rows").alias("_row"))
    return rows.repartition(tasks, *block).hint("merge").join(columns.repartition(tasks, *block), block).select(key, "doc_id")


def enrich(notices: DataFrame, pairs: DataFrame, evidence: DataFrame, key: str = "unique_key") -> DataFrame:
    """Notices with what their documents say: region where there is none, terms in raw_text and document_matches, detail_status and confidence.

    pairs: key, doc_id (of apply_evidence); evidence: doc_id, terms, stop_terms (arrays),
    region. Terms come in the order of their first document. A notice whose documents hold
    no term, stop term or region is `documents_checked`, others are `enriched`, with a
    confidence of 0.9 at least for terms and a region, else 0.7.
    """
    e = pairs.select(key, "doc_id").join(evidence.select("doc_id", "terms", "stop_terms", "region"), "doc_id")
    said = F.concat(
        F.transform("terms", lambda t, n: F.struct(F.lit(0).alias("kind"), t.alias("value"), n.alias("n"))),
        F.when(blank_null("region").isNotNull(), F.array(F.struct(F.lit(1).alias("kind"), F.col("region").alias("value"), F.lit(0).alias("n")))).otherwise(F.array().cast("array<struct<kind:int,value:string,n:int>>")),
        F.transform("stop_terms", lambda t, n: F.struct(F.lit(2).alias("kind"), t.alias("value"), n.alias("n"))),
    )
    # each value once per notice, so that what is gathered is bounded by the dictionary
    each = e.select(key, "doc_id", F.explode(said).alias("s")).groupBy(key, "s.kind", "s.value").agg(F.min(F.struct("doc_id", "s.n")).alias("at"))
    of = lambda kind, name: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "value")))), lambda x: x["value"]).alias(name)
    found = each.groupBy(key).agg(of(0, "_terms"), of(1, "_regions"), of(2, "_stops"))
    rows = notices.join(pairs.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").join(found, key, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("_terms", "_regions", "_stops")})
    some = F.coalesce("_hit", F.lit(False)) & (F.size("_terms") + F.size("_regions") + F.size("_stops") > 0)
    sure = F.when((F.size("_terms") > 0) & (F.size("_regions") > 0), 0.9).otherwise(0.7)
    new = {
        "region": F.when(some, F.coalesce(blank_null("region"), F.get("_regions", F.lit(0)))).otherwise(F.col("region")),
        "raw_text": F.when(some, F.concat_ws(" ", blank_null("raw_text"), F.array_join(F.concat("_terms", "_regions", "_stops"), " "))).otherwise(F.col("raw_text")),
        "document_matches": F.when(some, F.array_distinct(F.concat(F.coalesce("document_matches", none), "_terms", "_regions"))).otherwise(F.col("document_matches")),
        "detail_status": F.when(some, "enriched").when(F.col("_hit"), "documents_checked").otherwise(F.col("detail_status")),
        "source_confidence": F.when(some, F.greatest("source_confidence", sure)).otherwise(F.col("source_confidence")),
    }
    return rows.withColumns(new).drop("_hit", "_terms", "_regions", "_stops")


def detail_candidates(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first n notices worth a detail request: with a category, without price or region."""
    return df.where(blank_null("category").isNotNull() & (F.col("price").isNull() | blank_null("region").isNull())).orderBy(*order).limit(n)


def oem_references(items: DataFrame, references: DataFrame, models: Column, kind: str = "kind", key: str = "line_id") -> DataFrame:
    """References of an item's kind for any model in its text, the first per item. references: kind, model, part_number, n."""
    m = items.select(key, kind, F.explode(models).alias("_m"))
    j = m.join(references.select(F.col("kind").alias("_k"), normalize("model").alias("_rm"), "part_number", "n"), (F.col(kind) == F.col("_k")) & (normalize("_m") == F.col("_rm")))
    return j.groupBy(key).agg(F.min_by("part_number", "n").alias("part_number"))


def append_once(history: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """History with the rows whose keys it hasn't yet; of rows with equal keys the first, in an order that must be total."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    new = rows.join(history.select(*keys), list(keys), "left_anti").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return history.unionByName(new, allowMissingColumns=True)


def pin_baselines(pinned: DataFrame, runs: DataFrame, collection: str = "collection", stamp: str = "stamp") -> DataFrame:
    """(collection, stamp): the baseline of each collection, its earliest run; one that is pinned stays."""
    first = runs.groupBy(collection).agg(F.min(stamp).alias(stamp)).join(pinned.select(collection), collection, "left_anti")
    return pinned.select(collection, stamp).unionByName(first)
