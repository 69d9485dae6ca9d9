"""Counts, rollups, health and orders of reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import blank_null
from ..functions.text import col, normalize
from .lineage import cut_lineage


def count_by(df: DataFrame, key: Column | str, unknown: str = "не указано") -> DataFrame:
    """Rows per key, the most first; empty keys under one name."""
    name = F.coalesce(blank_null(col(key).cast("string")), F.lit(unknown)).alias("key")
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def kpi(df: DataFrame, new: DataFrame | None = None, priority: str = "review_priority") -> DataFrame:
    """One row: hot, review, wide, excluded, total, new."""
    out = df.agg(*[F.count_if(F.col(priority) == p).alias(p) for p in ("hot", "review", "wide", "excluded")], F.count(F.lit(1)).alias("total"))
    return out.crossJoin(new.agg(F.count(F.lit(1)).alias("new"))) if new is not None else out


#: Which report tables a notice stands in: name and condition.
def sheets(conditions: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, name) for name, c in conditions.items()]))


def report_tables(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """A row per notice and table it stands in, with the table's name in `sheet`."""
    return df.withColumn("sheet", F.explode(sheets(conditions)))


def source_health(rows: DataFrame, errors: DataFrame, attempted: DataFrame, source: str = "source") -> DataFrame:
    """source, status, found, errors, detail: ok, empty, partial (rows and errors), error, skipped.

    errors has source and error; attempted has source and skipped (boolean).
    """
    found = rows.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("found"))
    bad = errors.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("errors"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("detail"))
    out = attempted.select(F.col(source).alias("source"), "skipped").join(found, "source", "full_outer").join(bad, "source", "full_outer")
    n, e = F.coalesce("found", F.lit(0)), F.coalesce("errors", F.lit(0))
    status = F.when(F.coalesce("skipped", F.lit(False)), "skipped").when((n > 0) & (e > 0), "partial").when(n > 0, "ok").when(e > 0, "error").otherwise("empty")
    return out.select("source", status.alias("status"), n.alias("found"), e.alias("errors"), F.coalesce("detail", F.lit("")).alias("detail"))


def flag_suspect_empty(health: DataFrame, previous: DataFrame, aliases: Mapping[str, str] | None = None, note: str = "подозрение на дрейф верстки: прошлый запуск дал %d карточек") -> DataFrame:
    """Sources that report ok or empty without rows, after rows in the previous run of the same profile, become suspect_empty."""
    name = canonical("source", aliases or {})
    before = previous.groupBy(name.alias("_s")).agg(F.max("found").alias("_before"))
    joined = health.join(before, name == F.col("_s"), "left")
    flag = F.col("status").isin("ok", "empty") & (F.col("found") == 0) & (F.coalesce("_before", F.lit(0)) > 0)
    detail = F.concat_ws("; ", blank_null("detail"), F.format_string(note, F.col("_before")))
    return joined.withColumns({"status": F.when(flag, "suspect_empty").otherwise(F.col("status")), "detail": F.when(flag, detail).otherwise(F.col("detail"))}).drop("_s", "_before")


def canonical(source: Column | str, aliases: Mapping[str, str]) -> Column:
    """A source's name with aliases folded."""
    return F.coalesce(*[F.when(col(source) == a, b) for a, b in aliases.items()], col(source))


def run_rollup(health: DataFrame, good: Sequence[str] = ("ok",), quiet: Sequence[str] = ("skipped",), part: Sequence[str] = ("partial", "empty")) -> DataFrame:
    """One row: good, partial and bad source counts, the run's status, and the details of bad ones."""
    s = F.col("status")
    is_good, is_part = s.isin(*good), s.isin(*part)
    bad = ~(is_good | is_part | s.isin(*quiet))
    text = F.concat(F.col("source"), F.lit(": "), s)
    out = health.agg(F.count_if(is_good).alias("good"), F.count_if(is_part).alias("partial"), F.count_if(bad).alias("bad"), F.array_join(F.array_sort(F.collect_set(F.when(bad, text))), "; ").alias("detail"))
    return out.withColumn("status", F.when(F.col("bad") > 0, F.when(F.col("good") > 0, "partial").otherwise("error")).when(F.col("partial") > 0, "partial").otherwise("ok"))


def run_totals(raw: DataFrame, unique: DataFrame, new: DataFrame, key: str = "unique_key") -> DataFrame:
    """One row: raw rows, different keys, new rows."""
    one = lambda df, x, name: df.agg(x.alias(name))
    return one(raw, F.count(F.lit(1)), "raw_count").crossJoin(one(unique, F.countDistinct(key), "unique_count")).crossJoin(one(new, F.count(F.lit(1)), "new_count"))


def delivery_rates(events: DataFrame, sent: str, bounced: str, days: int = 3, least: int = 10, rate: float = 0.15, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Per calendar day: attempts and bounces over the trailing days, their rate, and whether it alarms."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    per = events.groupBy(F.to_date(ts).alias("day"), day.alias("_n")).agg(F.count_if(F.col(kind) == sent).alias("a"), F.count_if(F.col(kind) == bounced).alias("b"))
    trail = Window.orderBy("_n").rangeBetween(-(days - 1), 0)
    out = per.select("day", F.sum("a").over(trail).alias("attempts"), F.sum("b").over(trail).alias("bounces"))
    share = F.when(F.col("attempts") > 0, F.col("bounces") / F.col("attempts")).otherwise(0.0)
    return out.withColumn("rate", share).withColumn("alert", (F.col("attempts") >= least) & (F.col("rate") >= rate))


def latest_ages(events: DataFrame, now: Column, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Hours since the last event of each kind, not below 0."""
    return events.groupBy(kind).agg(F.max(ts).alias("last")).withColumn("age_hours", F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("last")) / 3600.0))


def health_verdict(ages: DataFrame, limits: Mapping[str, float], kind: str = "event_type") -> DataFrame:
    """One row: problems, the names of kinds that are missing or older than their limit in hours, and healthy."""
    late = [F.when(F.coalesce(F.max(F.when(F.col(kind) == k, F.col("age_hours"))), F.lit(float("inf"))) > hours, k) for k, hours in limits.items()]
    return ages.agg(F.array_compact(F.array(*late)).alias("problems")).withColumn("healthy", F.size("problems") == 0)


def coverage(rows: DataFrame, contact: str = "email", status: str = "status") -> DataFrame:
    """One row: total, with_contact, enriched, errors."""
    there = blank_null(contact).isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(there).alias("with_contact"), F.count_if(there & (F.col(status) == "ok")).alias("enriched"), F.count_if(F.col(status) == "error").alias("errors"))


def lot_sum(lots: DataFrame, keys: Sequence[str], price: str = "price", currency: str = "currency", roubles: Sequence[str] = ("RUB", "RUR", "643")) -> DataFrame:
    """Price of a notice as the sum of its lots; null unless all priced lots are in roubles, or if none is priced."""
    foreign = F.bool_or(F.col(price).isNotNull() & ~F.coalesce(F.col(currency), F.lit(roubles[0])).isin(*roubles))
    return lots.groupBy(*keys).agg(F.when(~F.coalesce(foreign, F.lit(False)), F.sum(price)).alias("price"))


def review_order(now: Column, rank: Column | str, deadline: str = "deadline", priority: str = "review_priority", price: str = "price", discovered: str = "discovered_at", title: str = "title") -> list[Column]:
    """Live deadlines from the nearest, then none, then those over from the latest; priority; region; price; newest; title."""
    d = F.col(deadline)
    stamp = F.unix_timestamp(d)
    order = F.coalesce(*[F.when(F.col(priority) == p, k) for k, p in enumerate(("hot", "review", "wide", "excluded"))], F.lit(4))
    return [
        F.when(d.isNull(), 1).when(d >= now, 0).otherwise(2),
        F.when(d.isNull(), 0).when(d >= now, stamp).otherwise(-stamp),
        order,
        col(rank),
        F.col(price).isNull(),
        F.desc_nulls_last(price),
        F.desc_nulls_last(discovered),
        F.col(title),
    ]


def deadline_order(df: DataFrame, most: int, deadline: str = "deadline", title: str = "title", tie: str = "seq") -> DataFrame:
    """The first rows of the register by deadline, those without one last, then by folded title."""
    return df.orderBy(F.asc_nulls_last(deadline), normalize(title), tie).limit(most)


def seen_order(df: DataFrame, most: int, seen: str = "last_seen_at", discovered: str = "discovered_at", tie: str = "unique_key") -> DataFrame:
    """The first rows of the register by when they were seen last, then discovered, both from the latest."""
    return df.orderBy(F.desc_nulls_last(seen), F.desc_nulls_last(discovered), tie).limit(most)


def places(df: DataFrame, rows: DataFrame, order: Sequence[Column], name: str, key: str = "seq") -> DataFrame:
    """key and the place of some rows in the whole table's order, which must be total: a range partitioning, then counts before each part."""
    ordered = df.select(key, F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]).alias("_o"))
    parted = ordered.repartitionByRange("_o").withColumn("_part", F.spark_partition_id())
    parted = cut_lineage(parted)
    counts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_o"))
    out = parted.withColumn("_nth", nth).join(before, "_part").select(key, (F.col("_before") + F.col("_nth")).alias(name))
    return out.join(rows.select(key), key, "left_semi")


def closing_soon(df: DataFrame, now: Column, days: int = 3, most: int = 10, deadline: str = "deadline", tie: str = "unique_key") -> DataFrame:
    """Rows with 0 to `days` days left, the nearest first."""
    left = F.datediff(F.col(deadline), now)
    return df.withColumn("days_left", left).where(F.col("days_left").between(0, days)).orderBy(deadline, tie).limit(most)


def latest_batch(register: DataFrame, seen: str = "last_seen_at") -> DataFrame:
    """Rows seen last: one aggregate that is broadcast back."""
    last = register.agg(F.max(seen).alias("_last"))
    return register.join(F.broadcast(last), F.col(seen) == F.col("_last")).drop("_last")


def digest(df: DataFrame, order: Sequence[Column | str], line: Column, head: str, most: int = 10, limit: int = 3900) -> DataFrame:
    """One row: text with the first lines, the total, and how many remain; cut at `limit` characters."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top = df.orderBy(*order).limit(most).select(F.row_number().over(Window.orderBy(*order)).alias("n"), line.alias("line"))
    lines = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["line"])).alias("lines"))
    rest = F.greatest(F.col("total") - most, F.lit(0))
    text = F.concat_ws("\n", F.concat(F.lit(head), F.col("total").cast("string")), F.array_join("lines", "\n"), F.when(rest > 0, F.concat(F.lit("+"), rest.cast("string"))))
    return lines.crossJoin(total).select(F.substring(text, 1, limit).alias("text"), "total", rest.alias("remaining"))
