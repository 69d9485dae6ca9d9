"""Regions, subjects and the ladder that sorts notices into hot, review, wide and excluded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import blank_null
from ..functions.text import col, normalize
from .match import best_category, match_terms, stop_term


@dataclass(frozen=True)
class Regions:
    """Rules for places. Orders matter: the first name whose variant starts a word wins."""

    variants: Mapping[str, Sequence[str]]
    look_alikes: Sequence[str] = ()
    guards: Mapping[str, str] = field(default_factory=dict)
    contexts: Sequence[str] = ()
    non_target: Sequence[str] = ()
    buckets: Mapping[str, str] = field(default_factory=dict)
    ranks: Mapping[str, int] = field(default_factory=dict)
    configured: Sequence[str] = ()


def _escape(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in text)


def _any_of(variants: Sequence[str], guards: Mapping[str, str]) -> str:
    parts = [_escape(v) + (f"(?!{guards[v]})" if v in guards else "") for v in variants]
    return rf"(?U)(?<!\w)(?:{'|'.join(parts)})"


def _without_look_alikes(text: Column, rules: Regions) -> Column:
    for pattern in rules.look_alikes:
        text = F.regexp_replace(text, f"(?U){pattern}", " ")
    return text


def detect_region(x: Column | str, rules: Regions) -> Column:
    """The first region, in the rules' order, of which a variant starts a word; then configured names as whole words."""
    text = _without_look_alikes(normalize(x), rules)
    named = [F.when(text.rlike(_any_of(v, rules.guards)), name) for name, v in rules.variants.items()]
    whole = [F.when(text.rlike(_any_of([n.lower()], {}) + r"(?!\w)"), n) for n in rules.configured]
    return F.coalesce(*named, *whole, F.lit(None).cast("string"))


def detect_delivery_region(x: Column | str, rules: Regions) -> Column:
    """The region in the first context of delivery that has one: patterns in order, then places in order."""
    text = normalize(x)
    found = [F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(0)), lambda s: detect_region(s, rules)), lambda r: r.isNotNull()), F.lit(0)) for p in rules.contexts]
    return F.coalesce(*found, F.lit(None).cast("string"))


def detect_non_target(x: Column | str, rules: Regions) -> Column:
    """The first foreign place in the rules' order, unless a target region occurs."""
    text = normalize(x)
    found = [F.when(text.rlike(_any_of([v], {})), v) for v in rules.non_target]
    return F.when(detect_region(x, rules).isNull(), F.coalesce(*found, F.lit(None).cast("string")))


def region_bucket(x: Column | str, rules: Regions) -> Column:
    name = detect_region(x, rules)
    return F.coalesce(*[F.when(name == k, v) for k, v in rules.buckets.items()], F.lit(""))


def region_rank(rules: Regions, *xs: Column | str) -> Column:
    """Rank of the region in the texts; 2 without one, 3 without any text."""
    texts = [F.when(F.trim(F.coalesce(col(x), F.lit(""))) != "", col(x)) for x in xs]
    name = detect_region(F.concat_ws(" ", *texts), rules)
    ranked = F.coalesce(*[F.when(name == k, r) for k, r in rules.ranks.items()], F.lit(2))
    return F.when(F.coalesce(*texts).isNull(), 3).otherwise(ranked)


def subject(title: Column | str, raw: Column | str, customer: Column | str, boilerplate: str | None = None) -> Column:
    """Title and text without the customer's name and legal boilerplate."""
    name = normalize(customer)
    text = normalize(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(raw), F.lit(""))))
    text = F.when(name != "", F.replace(text, name, F.lit(" "))).otherwise(text)
    return F.regexp_replace(text, f"(?U){boilerplate}", " ") if boilerplate else text


def resolve_region(rules: Regions, strict_sources: Sequence[str] = (), title: str = "title", raw: str = "raw_text", customer: str = "customer", region: str = "region", evidence: str = "delivery_region_evidence", source: str = "source") -> tuple[Column, Column]:
    """Target region and reason of exclusion.

    Evidence, title, delivery context and declared region come first; a declared
    region without a target excludes; then customer and text; then foreign places;
    strict sources need a target.
    """
    strong = F.coalesce(detect_region(evidence, rules), detect_region(title, rules), detect_delivery_region(raw, rules), detect_region(region, rules))
    declared = blank_null(region).isNotNull()
    loose = detect_region(F.concat_ws(" ", F.coalesce(F.col(customer), F.lit("")), F.coalesce(F.col(raw), F.lit(""))), rules)
    foreign = detect_non_target(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (title, customer, raw, evidence)]), rules)
    target = F.when(strong.isNotNull(), strong).when(~declared, loose)
    why = (
        F.when(strong.isNotNull(), F.lit(None).cast("string"))
        .when(declared, "регион не целевой")
        .when(loose.isNotNull(), F.lit(None).cast("string"))
        .when(foreign.isNotNull(), F.concat(F.lit("регион не целевой: "), foreign))
        .when(F.col(source).isin(*strict_sources) if strict_sources else F.lit(False), "целевой регион не подтвержден")
    )
    return target, why


def detect_city(x: Column | str, cities: Mapping[str, Sequence[str]]) -> Column:
    """The first city, in the rules' order, of which a variant starts a word; longer names come first in the rules."""
    return detect_region(x, Regions(cities))


def display_place(rules: Regions, *xs: Column | str, labels: Mapping[str, str] | None = None, plain: Column | str | None = None) -> Column:
    """The first region found over several texts, some under a common label, else `plain` (by default the first text that is there)."""
    found = F.coalesce(*[detect_region(x, rules) for x in xs])
    named = F.coalesce(*[F.when(found == k, v) for k, v in labels.items()], found) if labels else found
    return F.coalesce(named, *([blank_null(x) for x in xs] if plain is None else [blank_null(plain)]))


def money_text(x: Column) -> Column:
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


def evaluate(notices: DataFrame, dictionary: DataFrame, stops: DataFrame, rules: Regions, now: Column, least_price: float, wide_sources: Sequence[str] = (), strict_sources: Sequence[str] = (), stop_words: Sequence[str] = (), key: str = "unique_key") -> DataFrame:
    """Sets filter_status, match_confidence, review_priority, category, matched_terms, include_reason and exclude_reason.

    Excluded, in this order: stop term in the subject, deadline over, no category, region,
    price too low. What is left is `matched` if deadline, region and price are known, else
    `review`. Every notice keeps its row; keys must be unique.
    """
    n = notices.drop("filter_status", "match_confidence", "review_priority", "category", "matched_terms", "include_reason", "exclude_reason")
    texts = n.select(key, subject("title", "raw_text", "customer").alias("_subject"), F.col("title").alias("_title"))
    terms = dictionary.select("term").union(stops.select("term"))
    pairs = match_terms(texts, terms, key, "_subject", None, stop_words=stop_words)
    titled = match_terms(texts, dictionary.select("term").where(~F.contains(normalize("term"), F.lit(" "))), key, "_title", None, stop_words=stop_words)
    of_phrases = pairs.where(F.contains("term", F.lit(" ")))
    categories = best_category(of_phrases.union(titled), dictionary, key)
    stopped = stop_term(pairs, stops, key)
    region, why = resolve_region(rules, strict_sources)
    rows = n.join(categories, key, "left").join(stopped, key, "left").withColumn("_region", region).withColumn("_why", why)
    exclusion = F.coalesce(
        F.when(F.col("stop_term").isNotNull(), F.concat(F.lit("стоп-тема: "), F.col("stop_term"))),
        F.when(F.col("deadline") <= now, "срок подачи истек"),
        F.when(F.col("category").isNull(), "категория интереса не найдена"),
        F.col("_why"),
        F.when(F.col("price") < least_price, f"сумма меньше {least_price:g}"),
    )
    missing = F.array_compact(F.array(F.when(F.col("deadline").isNull(), "срок подачи не указан"), F.when(F.col("_region").isNull(), "регион не найден"), F.when(F.col("price").isNull(), "сумма не указана")))
    rows = rows.withColumn("_out", exclusion).withColumn("_missing", missing)
    out, lacks = F.col("_out").isNotNull(), F.size("_missing") > 0
    no_region, no_price = F.array_contains("_missing", "регион не найден"), F.array_contains("_missing", "сумма не указана")
    wide = (no_region & no_price) | (F.col("source").isin(*wide_sources) & (no_region | no_price) if wide_sources else F.lit(False))
    likely = (F.size("_missing") == 1) & ~no_region
    reason = F.concat_ws(
        "; ",
        F.when(F.col("_region").isNotNull(), F.concat(F.lit("регион: "), F.col("_region"))),
        F.concat(F.lit("категория: "), F.col("category")),
        F.concat(F.lit("ключевые слова: "), F.array_join("terms", ", ")),
        F.when(F.col("price").isNotNull(), F.concat(F.lit("сумма: "), money_text(F.col("price")))).otherwise("сумма: не указана"),
        F.when(F.col("deadline").isNotNull(), "срок подачи: активен").otherwise("срок подачи: не указан"),
    )
    done = {
        "filter_status": F.when(out, "excluded").when(lacks, "review").otherwise("matched"),
        "match_confidence": F.when(out, F.lit(None).cast("string")).when(likely, "вероятное").when(lacks, "ручная проверка").otherwise("точное"),
        "review_priority": F.when(out, "excluded").when(lacks & wide, "wide").when(lacks, "review").otherwise("hot"),
        "include_reason": F.when(out, "").otherwise(reason),
        "exclude_reason": F.when(out, F.col("_out")).when(lacks, F.concat(F.lit("требуется проверка: "), F.array_join("_missing", "; "))).otherwise(""),
        "matched_terms": F.when(out, F.array().cast("array<string>")).otherwise(F.col("terms")),
    }
    rows = rows.withColumns(done).withColumn("category", F.when(~out, F.col("category")))
    return rows.drop("_region", "_why", "_out", "_missing", "terms", "stop_term")
