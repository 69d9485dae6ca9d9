"""Notices and queries against supplier products: scored matching over stems, tasks and routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import blank_null
from ..functions.text import normalize, search_tokens, stem, stems
from .contain import contained
from .lineage import cut_lineage


def product_keys(products: DataFrame) -> DataFrame:
    """Products with normalized name and article, their tokens and the stems of them and of the category."""
    p = products.withColumns({"_name": normalize("name"), "_article": normalize("article")})
    p = p.withColumn("_tokens", search_tokens(F.concat_ws(" ", "_name", "_article")))
    return p.withColumns({"_stems": stems(F.col("_tokens")), "_cat": stems(search_tokens("category"))})


def _items(stems_: Column, tokens: Column) -> Column:
    """What queries and products may share: stems, and tokens with a digit."""
    return F.concat(F.transform(stems_, lambda x: F.concat(F.lit("s:"), x)), F.transform(_models(tokens), lambda x: F.concat(F.lit("m:"), x)))


def _models(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"\d"))


def _first_order(*more: Column) -> list[Column]:
    """The products' order among equal scores."""
    return [F.col("priority"), F.col("price").isNull(), F.coalesce("price", F.lit(0.0)), F.lower("name"), *more, F.col("product_id")]


def candidate_pairs(q: DataFrame, p: DataFrame, k: int, light: int, allow: bool = False) -> DataFrame:
    """Pairs (query_id, product_id) among which are the k best products of each query.

    An item of more than `light` products is heavy; there are few of them. Pairs with a light item in
    common, or a light article that the query says, are all sent. Products that share
    nothing but heavy items with a query differ for it only by their signature (heavy items,
    the first word's stem, category, article and allowed categories where these count) and by
    whether its whole text stands in their name. So the k best signatures of a
    query are enough, with the k first products of each; and of the names that hold the text
    of a query whose inner words are all heavy, the k best products.
    """
    items = p.select("product_id", F.explode(_items(F.col("_stems"), F.col("_tokens"))).alias("item"))
    heavy = cut_lineage(items.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > light).select("item"))
    # at most all items / light
    known = F.array(*[F.lit(r["item"]) for r in heavy.orderBy("item").collect()]).cast("array<string>")
    with_heavy = lambda df: df.withColumn("_heavy", known)
    articles = p.where("_article <> ''").groupBy("_article").agg((F.count(F.lit(1)) > light).alias("_often"))
    q_items = q.select("query_id", F.explode(_items(F.col("_qs"), F.col("_qt"))).alias("item"))
    by_item = q_items.join(items.join(heavy, "item", "left_anti"), "item").select("query_id", "product_id")
    said = q.select("query_id", F.explode(F.array_distinct(F.concat("_qt", F.array("_q")))).alias("_article"))
    by_article = said.join(p.where("_article <> ''").select("product_id", "_article").join(articles.where(~F.col("_often")), "_article"), "_article").select("query_id", "product_id")

    signed = with_heavy(p).join(articles.where("_often"), "_article", "left")
    signed = signed.withColumns({
        "_hs": F.array_intersect(F.sort_array(_items(F.col("_stems"), F.col("_tokens"))), F.col("_heavy")),
        "_lead": F.when(F.size("_tokens") > 0, stem(F.get("_tokens", F.lit(0)))),
        "_art": F.when(F.col("_often"), F.col("_article")),
        "_for": F.sort_array("allowed") if allow else F.lit(None).cast("array<string>"),
    }).where(F.size("_hs") > 0)
    signed = signed.withColumn("_lead", F.when(F.array_contains("_hs", F.concat(F.lit("s:"), "_lead")), F.col("_lead")))
    signed = signed.withColumn("_sig", F.xxhash64("_hs", "_lead", F.sort_array("_cat"), "_art", "_for"))
    top = lambda df, by, order: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= k)
    columns = ["_sig", "_hs", "_lead", "_cat", "_art", "_for", "priority", "price", "name", "product_id"]
    members = cut_lineage(top(signed.select(*columns), ["_sig"], _first_order()))
    heads = members.where("_nth = 1").drop("_nth")
    wanted = q_items.join(heavy, "item").select("query_id", "item")
    met = wanted.join(heads.select("_sig", F.explode("_hs").alias("item")), "item").select("query_id", "_sig").distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        """Pairs with what the signature gives of the score; those that a gate bars are gone."""
        hit = lambda kind, of: F.size(F.array_intersect("_hs", F.transform(of, lambda x: F.concat(F.lit(kind), x))))
        out = pairs.withColumn("_score", F.round(_score(hit("s:", F.col("_qs")), hit("m:", _models(F.col("_qt"))), F.col("_art"), F.col("_lead"), F.lit(False)), 2))
        out = out.where((F.size(_models(F.col("_qt"))) == 0) | (hit("m:", _models(F.col("_qt"))) > 0))
        return out.where(F.col("_qc").isNull() | F.col("_for").isNull() | (F.size("_for") == 0) | F.array_contains("_for", F.col("_qc"))) if allow else out

    best = top(scored(met.join(heads, "_sig").join(q, "query_id")), ["query_id"], [F.desc("_score"), *_first_order()]).select("query_id", "_sig")
    by_signature = best.join(members.select("_sig", "product_id"), "_sig").select("query_id", "product_id")

    # names that hold a query's text; one whose inner words are not all heavy has met them above
    inner = F.split("_q", " ")
    inner = stems(search_tokens(F.array_join(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), " ")))
    texts = with_heavy(q.where(F.length("_q") >= 4)).where(F.forall(inner, lambda s: F.array_contains("_heavy", F.concat(F.lit("s:"), s))))
    texts = texts.select("_q", "_qs", "_qt", *(["_qc"] if allow else [])).distinct()
    names = contained(signed.select(F.col("_name").alias("text_id"), F.col("_name").alias("text")).distinct(), texts, pattern="_q")
    holding = scored(names.join(texts, "_q").join(signed.select(*columns, F.col("_name").alias("text_id")), "text_id"))
    by = ["_q", *(["_qc"] if allow else [])]
    same = (F.col("_t") == F.col("_q")) & (F.col("_c").eqNullSafe(F.col("_qc")) if allow else F.lit(True))
    holding = top(holding, by, [F.desc("_score"), *_first_order()]).select(F.col("_q").alias("_t"), *([F.col("_qc").alias("_c")] if allow else []), "product_id")
    by_text = q.join(holding, same).select("query_id", "product_id")
    return by_item.union(by_article).union(by_signature).union(by_text).distinct()


def _score(hits: Column, models: Column, article: Column, lead: Column, inside: Column) -> Column:
    return (
        hits / F.size("_qs") * 70
        + hits * 2
        + F.when((F.length("_q") >= 4) & inside, 35).otherwise(0)
        + F.when((article != "") & ((F.col("_q") == article) | F.array_contains("_qt", article)), 120).otherwise(0)
        + models * 25
        + F.when(F.array_contains("_qs", lead), 20).otherwise(0)
        + F.when(F.arrays_overlap("_qs", "_cat"), 8).otherwise(0)
    )


def match_products(queries: DataFrame, products: DataFrame, k: int = 10, least: float = 25.0, stop_words: Sequence[str] = (), query_id: str = "query_id", query: str = "query", category: str | None = None, light: int | None = None) -> DataFrame:
    """The k best products of each query: query_id, product columns, score, matched_tokens, rank.

    Queries and products need a common stem (without one the score is 0); a query with
    model tokens (holding a digit) needs one of them in the product. The score counts
    covered stems, the query within the name, the article, models, the product's first
    word and its category. With `category`, a supplier with allowed categories needs it.
    Products have product_id (unique), supplier_id, name, article, category, price, priority and
    allowed (array, null: all). Pairs come from candidate_pairs, where an item is heavy in
    more than `light` products: by default 20 k, or one of 64 products where that is more.
    """
    q = queries.select(F.col(query_id).alias("query_id"), normalize(query).alias("_q"), *([F.col(category).alias("_qc")] if category else []))
    q = q.withColumn("_qt", search_tokens("_q", stop_words)).where(F.size("_qt") > 0).withColumn("_qs", stems(F.col("_qt")))
    # both are read many times
    q = cut_lineage(q)
    p = cut_lineage(product_keys(products))
    light = max(20 * k, products.count() // 64) if light is None else light
    both = candidate_pairs(q, p, k, light, category is not None).join(q, "query_id").join(p, "product_id")
    if category:
        both = both.where(F.col("_qc").isNull() | F.col("allowed").isNull() | (F.size("allowed") == 0) | F.array_contains("allowed", F.col("_qc")))
    both = both.withColumns({"_hit": F.array_intersect("_qs", "_stems"), "_models": F.array_intersect(_models(F.col("_qt")), F.col("_tokens"))})
    both = both.where((F.size("_hit") > 0) & ((F.size(_models(F.col("_qt"))) == 0) | (F.size("_models") > 0)))
    score = _score(F.size("_hit"), F.size("_models"), F.col("_article"), stem(F.get("_tokens", F.lit(0))), F.contains("_name", F.col("_q")))
    scored = both.withColumn("score", F.round(score, 2)).where(F.col("score") >= least)
    scored = scored.withColumn("matched_tokens", F.filter("_qt", lambda t: F.array_contains("_hit", stem(t))))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *_first_order()))
    names = [c for c in products.columns if c != "product_id"]
    return scored.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "product_id", *names, "score", "matched_tokens", "rank")


def alternative_tasks(lines: DataFrame, candidates: DataFrame, line: str = "line_id") -> DataFrame:
    """Status per line: backup (a compliant product in stock), verify (some not rejected), required (none); lines without products included."""
    tally = candidates.groupBy(line).agg(F.count_if((F.col("status") == "compliant") & F.col("in_stock")).alias("ready"), F.count_if(F.col("status") != "rejected").alias("viable"), F.count(F.lit(1)).alias("found"))
    out = lines.select(line).join(tally, line, "left").na.fill(0, ["ready", "viable", "found"])
    return out.withColumn("task", F.when(F.col("ready") > 0, "backup").when(F.col("viable") > 0, "verify").otherwise("required"))


def ranked_route(candidates: DataFrame, stages: DataFrame, item: str = "line_id", enough: int = 5) -> DataFrame:
    """Per item and source, in the sources' order until one has a viable product: status of the stage, whether it is used, and whether to widen.

    candidates: item, source, viable; stages: item, source, priority, available.
    """
    tally = candidates.groupBy(item, "source").agg(F.count_if("viable").alias("viable"), F.count(F.lit(1)).alias("found"))
    rows = stages.join(tally, [item, "source"], "left").na.fill(0, ["viable", "found"])
    first = F.min(F.when(F.col("viable") > 0, F.col("priority"))).over(Window.partitionBy(item))
    status = F.when(~F.col("available"), "unavailable").when(F.col("found") == 0, "empty").when(F.col("viable") == 0, "rejected").otherwise("matched")
    rows = rows.withColumns({"status": status, "_first": first})
    rows = rows.where(F.col("_first").isNull() | (F.col("priority") <= F.col("_first")))
    return rows.withColumn("used", F.col("priority") == F.coalesce("_first", F.lit(-1))).withColumn("widen", F.col("viable") < enough).drop("_first")


def merge_products(df: DataFrame, keys: Sequence[str], filled: Sequence[str], seq: str = "seq", dealer: str = "dealer_price", summary: str | None = None) -> DataFrame:
    """One row per product: rows with a dealer price first, summary sheets last, gaps filled in that order."""
    order = Window.partitionBy(*keys).orderBy(F.col(dealer).isNull(), *([F.col(summary)] if summary else []), seq)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = dict(df.dtypes)
    value = lambda c: blank_null(c) if kinds[c] == "string" else F.col(c)
    new = {f"_f_{c}": F.first(value(c), ignorenulls=True).over(whole) for c in filled}
    out = df.withColumns(new).withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return out.withColumns({c: F.col(f"_f_{c}") for c in filled}).select(*df.columns)
