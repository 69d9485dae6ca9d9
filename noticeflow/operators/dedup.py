"""Duplicates across sources: first and last per key, clusters, and merging of clusters into one row."""

from __future__ import annotations

import math
from bisect import insort
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ids import blank_null
from ..functions.text import normalize, number_key, title_key
from .lineage import cut_lineage


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _pairs(pairs: Iterator[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    while part := list(islice(pairs, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*part, strict=True)], names=["seq", "cluster"])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. Order must be total."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key, by aggregation: no sort, and a hot key is reduced before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.col(seq)).alias("_row")).select("_row.*")


def official_clusters(df: DataFrame, source: str = "source", number: str = "tender_number", official: str = "official_number", seq: str = "seq") -> DataFrame:
    """Adds cluster: rows of different sources that share an official number, or of which one's is another's own.

    Each cluster lives in one number's bucket. A bucket in which no source repeats is one
    cluster; the rare others are replayed in the order of seq, so that no cluster holds two
    rows of a source. Other rows are clusters of their own. A cluster is named by its least seq.
    """
    rows = df.withColumns({"_own": number_key(number), "_off": number_key(official)})
    known = rows.where("_off is not null").select(F.col("_off").alias("_k")).distinct()
    rows = rows.join(known, rows["_own"] == known["_k"], "left").withColumn("bucket", F.coalesce("_off", "_k")).drop("_k")
    # a bucket is summed up before it is shuffled: its rows, its sources and the least seq
    sums = rows.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(normalize(source)).alias("_s"), F.min(seq).alias("_least"))
    rows = rows.join(sums.withColumnRenamed("bucket", "_b"), F.col("bucket") == F.col("_b"), "left").drop("_b")
    small = rows.where("bucket is not null and _n <> _s").select(F.col(seq).alias("seq"), "bucket", normalize(source).alias("source"), "_own", "_off")

    kind = df.schema[seq].dataType.simpleString()

    def replay(batches):
        def settled(group):
            # a bucket has one official number, so a cluster is its sources and whether a member brings the number
            seqs, parent, waiting, place = [], [], {}, 0
            for r in group:
                seqs.append(r["seq"])
                parent.append(len(parent))
                node, sources, official = len(parent) - 1, frozenset([r["source"]]), r["_off"] is not None
                while True:
                    fit = [q[0] + (k,) for k, q in waiting.items() if (k[1] or official) and not k[0] & sources]
                    if not fit:
                        break
                    _, other, k = min(fit, key=lambda f: f[0])
                    waiting[k].popleft()
                    if not waiting[k]:
                        del waiting[k]
                    # the lesser place is that of the lesser seq
                    node, other = min(node, other), max(node, other)
                    parent[other] = node
                    sources, official = k[0] | sources, k[1] or official
                waiting.setdefault((sources, official), deque()).append((place, node))
                place += 1
            for n, up in enumerate(parent):
                parent[n] = parent[up]
                yield seqs[n], seqs[parent[n]]

        yield from _pairs((p for _, g in groupby(_rows(batches), key=lambda r: r["bucket"]) for p in settled(g)), key)

    key = to_arrow_type(df.schema[seq].dataType)
    replayed = small.repartition("bucket").sortWithinPartitions("bucket", "seq").mapInArrow(replay, f"seq {kind}, cluster {kind}").select(F.col("seq").alias("_seq"), F.col("cluster").alias("_replayed"))
    rows = rows.join(replayed, F.col(seq) == F.col("_seq"), "left")
    cluster = F.when(F.col("bucket").isNull(), F.col(seq)).otherwise(F.coalesce("_replayed", "_least"))
    return rows.withColumn("cluster", cluster).select(*df.columns, "cluster")


def card_member(price: str = "price", bucket: str = "region_bucket", source: str = "source", number: str = "tender_number", official: str = "official_number") -> Column:
    """What the card rules need to know of a row; merged rows carry those of all their members."""
    return F.struct(F.col(price).alias("price"), F.coalesce(bucket, F.lit("")).alias("bucket"), normalize(source).alias("source"), normalize(number).alias("number"), F.coalesce(number_key(official), F.lit("")).alias("official"))


def _first_fit(band) -> Iterator[tuple]:
    """Pairs (seq, cluster) of a band's rows, which come in the order of seq.

    Clusters only get stricter, so a row equal to one before goes where that went; one
    whose own members don't fit together is alone. Clusters are kept by price cell, sources,
    regions and official number: those that have a source of the row are looked up by its number.
    """
    clusters: list[dict] = []
    cells: dict[int, dict[tuple, list[int]]] = {}
    by_number: dict[tuple, set[int]] = {}
    before: dict[tuple, object] = {}
    for r in band:
        members = r["members"]
        prices = [m["price"] for m in members if m["price"] is not None]
        regions, official = frozenset(m["bucket"] for m in members) - {""}, frozenset(m["official"] for m in members) - {""}
        numbers = frozenset((m["source"], m["number"]) for m in members if m["number"])
        sources = frozenset(s for s, _ in numbers)
        if not prices or not max(prices) - min(prices) < 1.0 or len(official) > 1 or len(sources) < len(numbers):
            yield r["seq"], r["seq"]
            continue
        low, high = min(prices), max(prices)
        same = (low, high, regions, official, numbers)
        if same in before:
            yield r["seq"], before[same]
            continue
        near = lambda n: max(high, clusters[n]["high"]) - min(low, clusters[n]["low"]) < 1.0  # noqa: B023, E731
        best = None
        for cell in range(math.floor(high) - 1, math.floor(low) + 2):
            for (has, where, what), there in cells.get(cell, {}).items():
                if (where and regions and where != regions) or len(what | official) > 1:
                    continue
                shared = has & sources
                if shared:
                    some = min((by_number.get(x, set()) for x in numbers if x[0] in shared), key=len)
                    found = [n for n in some if clusters[n]["at"] == (cell, (has, where, what)) and all(x in clusters[n]["numbers"] for x in numbers if x[0] in shared) and near(n)]
                    first = min(found, default=None)
                else:
                    first = next((n for n in there if near(n)), None)
                if first is not None and (best is None or first < best):
                    best = first
        if best is None:
            best = len(clusters)
            clusters.append({"seq": r["seq"], "low": low, "high": high, "numbers": frozenset(), "regions": frozenset(), "official": frozenset(), "at": None})
        c = clusters[best]
        for x in numbers - c["numbers"]:
            by_number.setdefault(x, set()).add(best)
        c.update(low=min(low, c["low"]), high=max(high, c["high"]), numbers=c["numbers"] | numbers, regions=c["regions"] | regions, official=c["official"] | official)
        at = (math.floor(c["low"]), (frozenset(s for s, _ in c["numbers"]), c["regions"], c["official"]))
        if at != c["at"]:
            if c["at"]:
                cells[c["at"][0]][c["at"][1]].remove(best)
            insort(cells.setdefault(at[0], {}).setdefault(at[1], []), best)
            c["at"] = at
        before[same] = c["seq"]
        yield r["seq"], c["seq"]


def card_clusters(df: DataFrame, title: str = "title", deadline: str = "deadline", price: str = "price", bucket: str = "region_bucket", source: str = "source", number: str = "tender_number", official: str = "official_number", seq: str = "seq") -> DataFrame:
    """Adds cluster: rows with the same title and deadline date and prices within one unit, first fit in the order of seq.

    Regions must be equal or unknown on one side, a source may bring one number, and
    official numbers may not differ. A merged row stands for its members where the column
    `members` (card_member) lists them. Rows are split into price bands at gaps of one or
    more, which no cluster crosses; a band is one stream of rows, of which a task holds
    what is known of clusters. Rows without title, price or deadline are alone.
    """
    rows = df.withColumns({"_title": title_key(title), "_day": F.to_date(deadline)})
    able = (F.col("_title") != "") & F.col("_day").isNotNull() & F.col(price).isNotNull()
    rows = rows.withColumn("_card", F.when(able, F.concat_ws("|", "_day", "_title")))
    # bands depend on the different prices of a card alone, which are few where its rows are many
    prices = rows.where("_card is not null").groupBy("_card", F.col(price).alias("_price")).agg(F.count(F.lit(1)).alias("_n"))
    by_price = Window.partitionBy("_card").orderBy("_price")
    prices = prices.withColumn("_gap", (F.col("_price") - F.lag("_price").over(by_price) >= 1.0).cast("int")).withColumn("_band", F.sum(F.coalesce("_gap", F.lit(0))).over(by_price.rowsBetween(Window.unboundedPreceding, 0)))
    bands = prices.withColumn("_size", F.sum("_n").over(Window.partitionBy("_card", "_band"))).where("_size > 1").select(F.col("_card").alias("_c"), "_price", "_band")
    several = rows.join(bands, (F.col("_card") == F.col("_c")) & (F.col(price) == F.col("_price")))
    small = several.select(F.col(seq).alias("seq"), "_card", "_band", F.col("members") if "members" in df.columns else F.array(card_member(price, bucket, source, number, official)).alias("members"))

    def fit(batches):
        for _, band in groupby(_rows(batches), key=lambda r: (r["_card"], r["_band"])):
            yield from _first_fit(band)

    kind = df.schema[seq].dataType.simpleString()
    key = to_arrow_type(df.schema[seq].dataType)
    streamed = small.repartition("_card", "_band").sortWithinPartitions("_card", "_band", "seq").mapInArrow(lambda batches: _pairs(fit(batches), key), f"seq {kind}, cluster {kind}")
    fitted = streamed.select(F.col("seq").alias("_seq"), F.col("cluster").alias("_fitted"))
    rows = rows.join(fitted, F.col(seq) == F.col("_seq"), "left")
    return rows.withColumn("cluster", F.coalesce("_fitted", seq)).select(*df.columns, "cluster")


def card_links(df: DataFrame, title: str = "title", deadline: str = "deadline", price: str = "price", region: str = "region", source: str = "source", seq: str = "seq") -> DataFrame:
    """Adds cluster: the least seq of a row and of all rows of other sources with its title, deadline date and region and a price within one unit.

    Each row is compared with the others themselves, so that links don't carry over: unlike
    card_clusters, two rows with one link in common need not have one cluster. Rows of one
    card, source and price count as one, and meet those of their own and the next price cells.
    """
    card = ["_title", "_day", "_region", "_source", "_price"]
    rows = df.withColumns({"_title": F.nullif(title_key(title), F.lit("")), "_day": F.to_date(deadline), "_region": F.col(region), "_source": normalize(source), "_price": F.col(price)})
    points = rows.where(" and ".join(f"{c} is not null" for c in card)).groupBy(*card).agg(F.min(seq).alias("_seq"))
    points = points.withColumn("_cell", F.floor("_price"))
    near = points.select("_title", "_day", "_region", F.col("_source").alias("_s"), F.col("_price").alias("_p"), F.col("_seq").alias("_other"), F.explode(F.array(*[F.col("_cell") + k for k in (-1, 0, 1)])).alias("_cell"))
    linked = points.join(near, ["_title", "_day", "_region", "_cell"]).where((F.col("_source") != F.col("_s")) & (F.abs(F.col("_price") - F.col("_p")) < 1.0))
    least = linked.groupBy(*card).agg(F.min("_other").alias("_least"))
    return rows.join(least, card, "left").withColumn("cluster", F.least(seq, "_least")).select(*df.columns, "cluster")


def merge_clusters(df: DataFrame, cluster: str, rank: str, filled: Sequence[str], largest: Sequence[str] = (), joined: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """One row per cluster: that of the highest rank (ties: the earliest).

    `filled` columns take the first value that is there in that order, `largest` the
    maximum, `joined` the different texts not contained in one before, a line each.
    Aggregations only, so a large cluster is reduced before it is shuffled.
    """
    place = F.struct((-F.col(rank)).alias("r"), F.col(seq).alias("s"))
    kinds = dict(df.dtypes)
    value = lambda c: blank_null(c) if kinds[c] == "string" else F.col(c)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = [F.min_by(value(c), F.when(value(c).isNotNull(), place)).alias(f"_f_{c}") for c in filled] + [F.max(c).alias(f"_f_{c}") for c in largest]
    out = df.groupBy(F.col(cluster).alias("_k")).agg(F.min_by(row, place).alias("_row"), *found)
    for c in joined:
        # a text that repeats is gathered once, at its first place
        each = df.where(value(c).isNotNull()).groupBy(F.col(cluster).alias("_k"), F.col(c).alias("_t")).agg(F.min(place).alias("_p"))
        texts = each.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias(f"_f_{c}"))
        out = out.join(texts, "_k", "left")
    lines = lambda c: F.aggregate(F.transform(F.coalesce(f"_f_{c}", F.array().cast(dict(out.dtypes)[f"_f_{c}"])), lambda x: x["_t"]), F.lit(""), lambda acc, t: F.when(acc == "", t).when(F.contains(acc, t), acc).when(F.contains(t, acc), t).otherwise(F.concat(acc, F.lit("\n"), t)))
    new = {c: F.col(f"_f_{c}") for c in [*filled, *largest]} | {c: lines(c) for c in joined}
    return out.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in df.columns])


def latest_versions(df: DataFrame, key: str = "tender_number", published: str = "published_at", seq: str = "seq", filled: Sequence[str] = (), largest: Sequence[str] = (), title: str = "title", placeholder: str = "") -> DataFrame:
    """The newest version per number (ties: the later), with gaps filled from older ones and a placeholder title replaced by a real one."""
    # of structs the one with a date is greater than that without
    place = F.struct(F.col(published).alias("p"), F.col(seq).alias("s"))
    kinds = dict(df.dtypes)
    value = lambda c: blank_null(c) if kinds[c] == "string" else F.col(c)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = [F.max_by(value(c), F.when(value(c).isNotNull(), place)).alias(f"_f_{c}") for c in filled] + [F.max(c).alias(f"_f_{c}") for c in largest]
    out = df.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, place).alias("_row"), F.max_by(title, F.when(F.col(title) != placeholder, place)).alias("_real"), *found)
    new = {c: F.col(f"_f_{c}") for c in [*filled, *largest]}
    new.setdefault(title, F.coalesce("_real", F.col("_row")[title]))
    return out.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in df.columns])


def deduplicate(df: DataFrame, rank: Column, region_bucket: Column, filled: Sequence[str], largest: Sequence[str] = (), joined: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Clusters by official number, then by exact card among their merged rows, merged to one row each."""
    ranked = cut_lineage(df.drop("cluster").withColumn("_rank", rank).withColumn("region_bucket", region_bucket))
    clustered = cut_lineage(official_clusters(ranked, seq=seq))
    # a cluster by official number holds a row per source at most
    members = clustered.groupBy("cluster").agg(F.collect_list(card_member()).alias("members"))
    first = cut_lineage(merge_clusters(clustered, "cluster", "_rank", filled, largest, joined, seq).join(members, "cluster").drop("cluster"))
    out = merge_clusters(card_clusters(first, seq=seq), "cluster", "_rank", filled, largest, joined, seq)
    return out.drop("cluster", "_rank", "region_bucket", "members")


def review_list(df: DataFrame, deadline: str = "deadline", title: str = "title") -> DataFrame:
    """Sorted by deadline, those without one last, then by normalized title."""
    return df.orderBy(F.asc_nulls_last(deadline), normalize(title))
