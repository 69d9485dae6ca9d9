"""Customer registry, contacts and the outreach queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import blank_null, candidate_id, clean_org, is_system_email, normalize_email
from ..functions.text import col, normalize, org_key

#: Names that stand for no organization.
PLACEHOLDERS = ("заказчик", "организатор", "не указано", "не указан", "информация отсутствует", "нет данных", "-", "подробнее", "организация")


def org_type(name: Column | str, rules: Mapping[str, tuple[Sequence[str], Sequence[str]]], default: str = "прочее") -> Column:
    """The first class one of whose tokens is a word of the name, or one of whose parts occurs in it."""
    text = normalize(name)
    words = F.split(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]+", " "), " ")
    found = []
    for kind, (tokens, parts) in rules.items():
        hit = F.lit(False)
        if tokens:
            hit = hit | F.arrays_overlap(words, F.array(*[F.lit(t) for t in tokens]))
        for p in parts:
            hit = hit | F.contains(text, F.lit(p))
        found.append(F.when(hit, kind))
    return F.coalesce(*found, F.lit(default))


def has_marker(name: Column | str, markers: Sequence[str]) -> Column:
    text = F.concat(normalize(name), F.lit(" "))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(text, F.lit(m))
    return hit


def is_public(name: Column | str, public: Sequence[str], private: Sequence[str]) -> Column:
    return (normalize(name) != "") & ~has_marker(name, private) & has_marker(name, public)


def is_potential(name: Column | str, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """A name that is no placeholder and has three letters or more."""
    text = normalize(name)
    return (text != "") & ~text.isin(*placeholders) & (F.length(F.regexp_replace(text, r"(?U)[^\p{L}]", "")) >= 3)


def target_regions(text: Column | str, labels: Mapping[str, Sequence[str]], most: int = 120) -> Column:
    """All labels of which an alias occurs, joined; without one the text, cut."""
    t = normalize(text)
    found = F.array_compact(F.array(*[F.when(has_marker(t, aliases), label) for label, aliases in labels.items()]))
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(F.substring(F.trim(F.coalesce(col(text), F.lit(""))), 1, most))


def customer_registry(notices: DataFrame, registry: DataFrame, region: Column, completeness: Column, contact: Mapping[str, Column], key: str = "org_key") -> DataFrame:
    """Registry rows by organization: the most complete, then latest, notice of each potential customer with a region gives name, region and link.

    Rows of the registry stay; contact fields fill only what is empty there. registry has
    key, name, region, url, status and the contact fields.
    """
    n = notices.where(is_potential("customer")).withColumns({"_region": region, "_name": clean_org("customer"), **{f"_c_{c}": x for c, x in contact.items()}})
    n = n.where(F.col("_region").isNotNull()).withColumns({"_key": org_key("_name"), "_full": completeness})
    best = n.groupBy("_key").agg(F.max_by(F.struct("_name", "_region", F.col("url").alias("_url"), *[f"_c_{c}" for c in contact]), F.struct("_full", "discovered_at", "seq")).alias("_b")).select("_key", "_b.*")
    both = registry.join(best, registry[key] == best["_key"], "full_outer")
    here = F.col("_key").isNotNull()
    fields = {c: F.coalesce(blank_null(c), blank_null(f"_c_{c}")) for c in contact}
    out = both.select(
        F.coalesce(key, "_key").alias(key),
        F.when(here, F.col("_name")).otherwise(F.col("name")).alias("name"),
        F.when(here, F.col("_region")).otherwise(F.col("region")).alias("region"),
        F.when(here, F.col("_url")).otherwise(F.col("url")).alias("url"),
        blank_null("status").alias("status"),
        *[x.alias(c) for c, x in fields.items()],
    )
    return out.withColumn("status", F.coalesce("status", F.when(F.coalesce(*[F.col(c) for c in contact]).isNotNull(), "Новый").otherwise("Не проверен")))


def fill_contacts(registry: DataFrame, cache: DataFrame, fields: Sequence[str], generated: str = "generated", key: str = "org_key") -> DataFrame:
    """Contacts from the cache: what a person entered stays, what was generated before is renewed. Adds filled and cached (booleans)."""
    c = cache.select(F.col(key).alias("_k"), F.col("status").alias("_st"), *[F.col(f).alias(f"_c_{f}") for f in fields])
    rows = registry.join(c, F.col(key) == F.col("_k"), "left")
    ok = F.col("_st") == "ok"
    manual = lambda f: blank_null(f).isNotNull() & ~F.coalesce(F.array_contains(generated, f), F.lit(False))
    new = {f: F.when(manual(f) | ~F.coalesce(ok, F.lit(False)), F.col(f)).otherwise(F.coalesce(blank_null(f"_c_{f}"), F.col(f))) for f in fields}
    some = F.lit(False)
    for f in fields:
        some = some | (~manual(f) & F.coalesce(ok, F.lit(False)) & blank_null(f"_c_{f}").isNotNull())
    return rows.withColumns(new | {"filled": some, "cached": F.col("_k").isNotNull()}).drop("_k", "_st", *[f"_c_{f}" for f in fields])


def suppressed(rows: DataFrame, stops: DataFrame, email: str = "email") -> DataFrame:
    """Adds stopped: whether the address is on the stop list."""
    s = stops.select(normalize_email("email").alias("_stop")).where("_stop is not null").distinct()
    return rows.join(s, normalize_email(email) == F.col("_stop"), "left").withColumn("stopped", F.col("_stop").isNotNull()).drop("_stop")


def queue_plan(source: DataFrame, queue: DataFrame, stops: DataFrame, priority: Column, version: str = "outreach-v1") -> DataFrame:
    """What a sync does to the queue: org_key, action (update, append), candidate_id, email, decision, reason.

    source: org_key (unique), email, contact_source, evidence (link), seq; queue: org_key, email, sent
    (unique org_key). Organizations are taken by region priority, then seq. A queued row that wasn't sent is updated
    if its address changed, which frees the old address; new organizations are appended.
    An address is claimed by the queue, and by every row before that took it and wasn't freed
    since: the last event on an address before a row decides.
    """
    s = source.select("org_key", normalize_email("email").alias("email"), "contact_source", "evidence", F.struct(priority.alias("p"), F.col("seq").alias("s")).alias("at"))
    q = queue.select("org_key", normalize_email("email").alias("old"), "sent")
    rows = s.join(q.withColumn("_queued", F.lit(True)), "org_key", "left")
    changed = F.col("email").isNotNull() & ~F.col("email").eqNullSafe(F.col("old")) & ~F.coalesce("sent", F.lit(False))
    rows = rows.withColumn("action", F.when(F.col("_queued").isNull(), "append").when(changed, "update")).where("action is not null")
    begin = F.struct(F.lit(-1).alias("p"), F.lit(-1).cast("long").alias("s"))
    event = lambda df, at, kind, address, claim: df.select(at.alias("at"), F.lit(kind).alias("kind"), F.col(address).alias("email"), F.lit(claim).alias("claim")).where("email is not null")
    cast = F.col("at").cast("struct<p:int,s:bigint>")
    events = event(q, begin.cast("struct<p:int,s:bigint>"), 0, "old", True)
    # a row frees its old address before it asks for the new one
    events = events.union(event(rows.where("action = 'update'"), cast, 1, "old", False)).union(event(rows, cast, 2, "email", True))
    before = Window.partitionBy("email").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    claims = events.withColumn("taken", F.coalesce(F.last("claim").over(before), F.lit(False))).where("kind = 2").select(F.col("at").alias("_at"), F.col("email").alias("_e"), "taken")
    rows = rows.join(claims, (cast == F.col("_at")) & (F.col("email") == F.col("_e")), "left")
    rows = suppressed(rows, stops)
    ladder = [
        (F.col("email").isNull(), "excluded", "missing_or_invalid_email"),
        (is_system_email("email"), "excluded", "system_email"),
        (F.col("stopped"), "suppressed", "stoplist"),
        (F.coalesce("taken", F.lit(False)), "excluded", "duplicate_email"),
        (blank_null("contact_source").isNull() | ~F.lower(F.coalesce("evidence", F.lit(""))).rlike("^https?://"), "excluded", "no_evidence"),
    ]
    what, why = F.lit("needs_review"), F.lit("new_contact")
    for condition, decision, reason in reversed(ladder):
        what, why = F.when(condition, decision).otherwise(what), F.when(condition, reason).otherwise(why)
    return rows.select("org_key", "action", candidate_id(F.lit(version), "org_key", F.coalesce("email", F.lit(""))).alias("candidate_id"), "email", what.alias("decision"), why.alias("reason"))


def queue_counts(queue: DataFrame) -> DataFrame:
    """One row: eligible, prepared, errors, needs_review, suppressed, excluded, consented. queue: decision, stage, approved, consent, error."""
    d = F.col("decision")
    return queue.agg(
        F.count_if((d == "approved") & F.col("approved")).alias("eligible"),
        F.count_if(F.col("stage") == "prepared").alias("prepared"),
        F.count_if(blank_null("error").isNotNull()).alias("errors"),
        F.count_if(d == "needs_review").alias("needs_review"),
        F.count_if(d == "suppressed").alias("suppressed"),
        F.count_if(d == "excluded").alias("excluded"),
        F.count_if(F.col("consent") == "yes").alias("consented"),
    )


def assign_supplier(assignments: DataFrame, requests: DataFrame, key: str = "line_id") -> DataFrame:
    """Requests after suppliers were assigned to lines (one supplier per line and batch): the row that has the supplier, else the line's first without one, else a new row from its first.

    assignments: line_id, supplier, status; requests: line_id, n, supplier, status.
    """
    a = assignments.select(F.col(key).alias("_k"), F.col("supplier").alias("_s"), F.col("status").alias("_st"))
    rows = requests.join(a, F.col(key) == F.col("_k"), "left")
    fit = F.when(F.col("supplier") == F.col("_s"), 0).when(blank_null("supplier").isNull(), 1)
    # one order for both windows, and one pass for rows that stay and rows that are added: rows are sorted once
    first = Window.partitionBy(key).orderBy(F.coalesce(fit, F.lit(2)), "n")
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_fit": fit, "_nth": F.row_number().over(first), "_last": F.max("n").over(whole)})
    hit = F.col("_s").isNotNull() & (F.col("_nth") == 1)
    taken = hit & F.col("_fit").isNotNull()
    one = lambda n, supplier, status: F.struct(n.alias("n"), supplier.alias("supplier"), status.alias("status"))
    kept = one(F.col("n"), F.when(taken, F.col("_s")).otherwise(F.col("supplier")), F.when(taken, F.col("_st")).otherwise(F.col("status")))
    added = F.when(hit & F.col("_fit").isNull(), one(F.col("_last") + 1, F.col("_s"), F.col("_st")))
    return rows.select(key, F.inline_outer(F.array_compact(F.array(kept, added))))


def with_suffixes(rows: DataFrame, known: DataFrame, base: str = "supplier_id", order: str = "seq") -> DataFrame:
    """New ids for rows: the base, or base-2, base-3 … after those known or given before. known: base, n (ids in use)."""
    k = known.select(F.col(base).alias("_b"), F.col("n").alias("_n"))
    nth = F.row_number().over(Window.partitionBy(base).orderBy(order))
    out = rows.join(k, F.col(base) == F.col("_b"), "left").withColumn("_at", F.coalesce("_n", F.lit(0)) + nth)
    return out.withColumn("new_id", F.when(F.col("_at") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("_at").cast("string")))).drop("_b", "_n", "_at")
