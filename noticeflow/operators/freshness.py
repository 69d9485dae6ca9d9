"""Last good rows per source: what a failed or partial pass may replace, and how old rows may be served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_last_good(previous: DataFrame, current: DataFrame, health: DataFrame, key: str = "unique_key", source: str = "source", status: str = "status") -> DataFrame:
    """Previous and current rows by their source's status.

    ok replaces the old rows unless it brings none; empty keeps them; partial adds to
    them, new rows first; anything else keeps them. Health has one row per source. The
    result has one row per key (a current one first); preserved tells old rows.
    """
    h = health.select(F.col(source).alias("_s"), F.col(status).alias("_st"))
    counts = current.groupBy(F.col(source).alias("_s")).agg(F.lit(True).alias("_new"))
    state = h.join(counts, "_s", "full_outer").select(F.col("_s"), F.coalesce("_st", F.lit("error")).alias("_st"), F.coalesce("_new", F.lit(False)).alias("_new"))
    both = previous.withColumn("preserved", F.lit(True)).unionByName(current.withColumn("preserved", F.lit(False)), allowMissingColumns=True)
    joined = both.join(state, F.col(source) == F.col("_s"), "left").withColumn("_st", F.coalesce("_st", F.lit("error")))
    keep = F.when(F.col("preserved"), F.when(F.col("_st") == "ok", ~F.coalesce("_new", F.lit(False))).otherwise(True)).otherwise(F.col("_st").isin("ok", "partial"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col("preserved").cast("int"), source))
    return joined.where(keep).withColumn("_nth", first).where("_nth = 1").drop("_nth", "_s", "_st", "_new")


def suspicious(previous: DataFrame, current: DataFrame, health: DataFrame, source: str = "source", status: str = "status") -> DataFrame:
    """Sources that report ok or empty without rows though they had rows before: source, previous."""
    before = previous.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("previous"))
    now = current.select(F.col(source).alias("source")).distinct()
    calm = health.where(F.col(status).isin("ok", "empty")).select(F.col(source).alias("source"))
    return before.join(calm, "source", "left_semi").join(now, "source", "left_anti")


def updated_times(times: DataFrame, previous: DataFrame, current: DataFrame, health: DataFrame, attempted: Column, source: str = "source", status: str = "status") -> DataFrame:
    """source, generated_at: it advances only where a source's rows were wholly renewed."""
    old = previous.select(F.col(source).alias("source")).distinct().withColumn("_old", F.lit(True))
    new = current.select(F.col(source).alias("source")).distinct().withColumn("_new", F.lit(True))
    h = health.select(F.col(source).alias("source"), F.col(status).alias("_st"))
    rows = times.select("source", "generated_at").join(h, "source", "full_outer").join(old, "source", "left").join(new, "source", "left")
    had, has = F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False))
    fresh = ((F.col("_st") == "ok") & (has | ~had)) | ((F.col("_st") == "empty") & ~had) | ((F.col("_st") == "partial") & has & ~had)
    return rows.select("source", F.when(fresh, attempted).otherwise(F.col("generated_at")).alias("generated_at"))


def served(rows: DataFrame, times: DataFrame, now: Column, hours: float = 168, source: str = "source") -> DataFrame:
    """Rows of sources that were renewed within so many hours."""
    good = times.where(F.unix_timestamp(now) - F.unix_timestamp("generated_at") <= hours * 3600).select(F.col("source").alias(source))
    return rows.join(good, source, "left_semi")


def section_snapshot(previous: DataFrame, current: DataFrame, complete: DataFrame, observed: Column, key: str = "unique_key", section: str = "section") -> DataFrame:
    """A complete pass over a section replaces its rows; a partial one keeps rows it didn't see, with their old observed_at.

    complete has section and complete (boolean).
    """
    new = current.withColumn("observed_at", observed)
    done = complete.where("complete").select(F.col("section").alias(section))
    kept = previous.join(done, section, "left_anti").join(current.select(key), key, "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def within_age(rows: DataFrame, now: Column, most_hours: float = 30, observed: str = "observed_at") -> DataFrame:
    """Rows observed not later than now and not longer ago than allowed."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(observed)) / 3600.0
    return rows.where((age >= 0) & (age <= most_hours))


def retained(rows: DataFrame, now: Column, cutoff: Column, most: int, days: int = 7, deadline: str = "deadline", published: str = "published_at", tie: str = "unique_key") -> DataFrame:
    """Rows still of use: deadline not long over, or published after the cutoff, or neither known; the newest `most`."""
    live = F.col(deadline) >= now - F.expr(f"interval {days} days")
    keep = F.coalesce(live, F.lit(False)) | F.coalesce(F.col(published) >= cutoff, F.lit(False)) | (F.col(deadline).isNull() & F.col(published).isNull())
    return rows.where(keep).orderBy(F.desc_nulls_last(published), tie).limit(most)


def archive_transition(active: DataFrame, archive: DataFrame, current: DataFrame, health: DataFrame, key: str = "unique_key", source: str = "source", kept: tuple[str, ...] = ()) -> DataFrame:
    """All rows with their state: active, active_warning (missing, but its source is not healthy) or archive.

    Rows seen again leave the archive; `kept` columns (first seen, manual entries) survive
    from the old row. health has source and healthy (boolean).
    """
    old = active.withColumn("_was", F.lit("active")).unionByName(archive.withColumn("_was", F.lit("archive")), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_was"))
    old = old.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    sick = health.where("not healthy").select(F.col("source").alias("_sick"))
    names = [c for c in old.columns if c not in (key, "_was")]
    joined = old.select(F.col(key).alias("_k"), "_was", *[F.col(c).alias(f"_o_{c}") for c in names]).join(current, F.col("_k") == F.col(key), "full_outer")
    here = F.col(key).isNotNull()
    picked = [F.when(here, F.coalesce(f"_o_{c}", c) if c in kept else F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) if c in current.columns else F.col(f"_o_{c}").alias(c) for c in names]
    rows = joined.select(F.coalesce(key, "_k").alias(key), *picked, here.alias("_here"), "_was")
    rows = rows.join(sick, F.col(source) == F.col("_sick"), "left")
    state = F.when(F.col("_here"), "active").when((F.col("_was") == "active") & F.col("_sick").isNotNull(), "active_warning").otherwise("archive")
    return rows.withColumn("state", state).drop("_here", "_was", "_sick")


def due(rows: DataFrame, cache: DataFrame, now: Column, budget: int, key: str = "key", url: str = "url", ok_hours: float = 168, other_hours: float = 24, version: int = 1) -> DataFrame:
    """Keys to refresh: not cached, another url or parser version, or too old for their status; new before error before empty before ok, `budget` of them."""
    c = cache.select(F.col(key).alias("_k"), F.col(url).alias("_url"), "status", "checked_at", "version")
    joined = rows.join(c, rows[key] == c["_k"], "left")
    hours = (F.unix_timestamp(now) - F.unix_timestamp("checked_at")) / 3600.0
    changed = (F.col("_url") != F.col(url)) | (F.col("version") != version)
    old = hours >= F.when(F.col("status") == "ok", ok_hours).otherwise(other_hours)
    order = F.when(F.col("_k").isNull() | changed, 0).when(F.col("status") == "error", 1).when(F.col("status") == "empty", 2).otherwise(3)
    return joined.where(F.col("_k").isNull() | changed | old).withColumn("reason", order).orderBy("reason", key).limit(budget).select(*[rows[x] for x in rows.columns], "reason")
