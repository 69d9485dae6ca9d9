"""The register of all notices ever seen: keyed upserts with a rule per column, what is new, filling from history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import blank_null

ACTIONABLE = ("hot", "review", "wide")
#: Ways a number was found that say that it isn't confirmed.
UNVERIFIED = ("meta+unverified", "meta-unverified")

#: Rules of the notice register; columns without one are overwritten.
REGISTER_RULES: Mapping[str, str] = {
    **dict.fromkeys(("customer", "region", "price", "deadline", "status", "published_at", "raw_text", "delivery_region_evidence", "platform_number", "platform_url", "procurement_law", "resolution_method"), "filled"),
    "detail_status": "checked",
    "document_matches": "nonempty",
    "source_confidence": "largest",
    "official_number": "official",
    "official_url": "official",
    "official_source": "official",
    "resolution_confidence": "official_largest",
    "discovered_at": "kept",
}


def _value(kind: str, x: Column) -> Column:
    return blank_null(x) if kind == "string" else x


def ruled(rule: str, kind: str, new: Column, old: Column, unverified: Column) -> Column:
    """What a column holds after a new value, by its rule."""
    if rule == "filled":
        return F.coalesce(_value(kind, new), old)
    if rule == "kept":
        return F.coalesce(old, new)
    if rule == "checked":
        return F.when(new == "not_checked", F.coalesce(old, new)).otherwise(new)
    if rule == "nonempty":
        return F.when(F.coalesce(F.size(new), F.lit(0)) > 0, new).otherwise(F.coalesce(old, new))
    if rule == "largest":
        return F.greatest(new, old)
    if rule == "official":
        return F.when(unverified, new).otherwise(F.coalesce(_value(kind, new), old))
    if rule == "official_largest":
        return F.when(unverified, F.coalesce(new, F.lit(0.0))).otherwise(F.greatest(F.coalesce(new, F.lit(0.0)), F.coalesce(old, F.lit(0.0))))
    raise ValueError(f"no rule {rule!r}")


def upsert(register: DataFrame, batch: DataFrame, rules: Mapping[str, str], key: str = "unique_key", seen: Column | None = None, seen_col: str = "last_seen_at", unverified: Sequence[str] = UNVERIFIED) -> DataFrame:
    """The register after a batch, whose keys must be unique: one full outer join, a rule per column.

    Rules: filled (old where new is null or empty), kept (old), checked (old where new is
    `not_checked`), nonempty (old where the new array is empty), largest, official and
    official_largest (new where the method says unverified, else filled or largest); other
    columns are overwritten. Columns that only the batch has are added.
    """
    old, new = register.alias("o"), batch.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    kinds = dict(register.dtypes) | dict(batch.dtypes)
    there = F.col(f"n.{key}").isNotNull()
    doubt = F.coalesce(F.col("n.resolution_method").isin(*unverified), F.lit(False)) if "resolution_method" in batch.columns else F.lit(False)
    out = []
    for c in dict.fromkeys([*register.columns, *batch.columns]):
        if c == key:
            out.append(F.coalesce(f"n.{key}", f"o.{key}").alias(key))
        elif c == seen_col and seen is not None:
            out.append((F.when(there, seen).otherwise(F.col(f"o.{c}")) if c in register.columns else F.when(there, seen)).alias(c))
        elif c not in batch.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c not in register.columns:
            out.append(F.col(f"n.{c}").alias(c))
        else:
            merged = ruled(rules.get(c, "overwrite"), kinds[c], F.col(f"n.{c}"), F.col(f"o.{c}"), doubt) if c in rules else F.col(f"n.{c}")
            out.append(F.when(there, merged).otherwise(F.col(f"o.{c}")).alias(c))
    if seen is not None and seen_col not in register.columns and seen_col not in batch.columns:
        out.append(F.when(there, seen).alias(seen_col))
    return joined.select(*out)


def upsert_counts(before: DataFrame, batch: DataFrame, key: str = "unique_key") -> DataFrame:
    """One row: added (keys not there before) and total after the batch."""
    both = before.select(key, F.lit(1).alias("_old")).union(batch.select(key, F.lit(0)))
    per = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("_old").alias("_old"))
    return per.agg(F.count_if(F.col("_old") == 0).alias("added"), F.count(F.lit(1)).alias("total"))


def new_rows(register: DataFrame, batch: DataFrame, key: str = "unique_key", priority: str = "review_priority") -> DataFrame:
    """Rows of the batch whose key is unknown, or that become actionable for the first time."""
    known = register.select(F.col(key).alias("_k"), F.col(priority).alias("_p"))
    joined = batch.join(known, batch[key] == known["_k"], "left")
    promoted = ~F.coalesce(F.col("_p").isin(*ACTIONABLE), F.lit(False)) & F.col(priority).isin(*ACTIONABLE)
    return joined.where(F.col("_k").isNull() | promoted).select(*[batch[c] for c in batch.columns])


def fill_from_history(batch: DataFrame, register: DataFrame, filled: Sequence[str], largest: Sequence[str] = (), checked: Sequence[str] = (), key: str = "unique_key") -> DataFrame:
    """Current rows with gaps filled from the register; current values that are there always win."""
    kinds = dict(batch.dtypes)
    names = [*filled, *largest, *checked]
    old = register.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in names])
    joined = batch.join(old, batch[key] == old["_k"], "left")
    new = {c: F.coalesce(_value(kinds[c], F.col(c)), F.when(F.size(F.col(c)) > 0, F.col(c)) if kinds[c].startswith("array") else F.lit(None), F.col(f"_o_{c}")) for c in filled if not kinds[c].startswith("array")}
    new |= {c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.coalesce(f"_o_{c}", c)) for c in filled if kinds[c].startswith("array")}
    new |= {c: F.greatest(c, f"_o_{c}") for c in largest}
    new |= {c: F.when((F.col(c) == "not_checked") & (F.col(f"_o_{c}") != "not_checked"), F.col(f"_o_{c}")).otherwise(F.col(c)) for c in checked}
    return joined.withColumns(new).select(*batch.columns)


def enqueue(outbox: DataFrame, candidates: DataFrame, now: Column, key: str = "unique_key") -> DataFrame:
    """The outbox with the candidates that are not in it yet."""
    new = candidates.select(key).distinct().join(outbox.select(key), key, "left_anti")
    return outbox.unionByName(new.select(key, now.alias("created_at")), allowMissingColumns=True)


def mark_sent(outbox: DataFrame, sent: DataFrame, now: Column, key: str = "unique_key") -> DataFrame:
    """Sets sent_at and counts the attempt for keys not sent before."""
    hit = outbox.join(sent.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").withColumn("_now", F.col("_k").isNotNull() & F.col("sent_at").isNull())
    new = {"sent_at": F.when(F.col("_now"), now).otherwise(F.col("sent_at")), "attempts": F.coalesce("attempts", F.lit(0)) + F.col("_now").cast("int"), "last_error": F.when(F.col("_now"), F.lit(None)).otherwise(F.col("last_error"))}
    return hit.withColumns(new).select(*outbox.columns)


def mark_error(outbox: DataFrame, failed: DataFrame, key: str = "unique_key", error: str = "error") -> DataFrame:
    """Counts the attempt and keeps the error's first 500 characters for keys not sent before."""
    bad = failed.groupBy(F.col(key).alias("_k")).agg(F.max(error).alias("_e"))
    hit = outbox.join(bad, F.col(key) == F.col("_k"), "left").withColumn("_now", F.col("_k").isNotNull() & F.col("sent_at").isNull())
    new = {"attempts": F.coalesce("attempts", F.lit(0)) + F.col("_now").cast("int"), "last_error": F.when(F.col("_now"), F.substring("_e", 1, 500)).otherwise(F.col("last_error"))}
    return hit.withColumns(new).select(*outbox.columns)


def pending(outbox: DataFrame, register: DataFrame, limit: int = 50, key: str = "unique_key") -> DataFrame:
    """Registered rows that wait to be sent, the oldest first."""
    waiting = outbox.where("sent_at is null").select(key, "created_at")
    return waiting.join(register, key).orderBy("created_at", key).limit(max(1, limit))


def carry_over(current: DataFrame, history: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Manual entries of earlier reports: per key and column the first that is there, in the given order."""
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    firsts = history.groupBy(*keys).agg(*[F.min_by(c, F.when(blank_null(c).isNotNull(), packed)).alias(f"_h_{c}") for c in columns])
    joined = current.join(firsts, list(keys), "left")
    return joined.withColumns({c: F.coalesce(blank_null(c), blank_null(f"_h_{c}")) if c in current.columns else blank_null(f"_h_{c}") for c in columns}).drop(*[f"_h_{c}" for c in columns])


def migrate(df: DataFrame, aliases: Mapping[str, Sequence[str]], schema: Mapping[str, str]) -> DataFrame:
    """A table under the current names: the first alias present, missing columns as null, in the schema's order and types."""
    there = {c.strip().lower(): c for c in df.columns}
    names = lambda c: [c, *aliases.get(c, ())]
    found = {c: next((there[n.lower()] for n in names(c) if n.lower() in there), None) for c in schema}
    return df.select(*[(F.col(f"`{found[c]}`").cast(kind) if found[c] else F.lit(None).cast(kind)).alias(c) for c, kind in schema.items()])
