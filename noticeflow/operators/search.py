"""Search of documents and notices by tables of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_of, normalize, search_tokens, snippet
from .contain import contained, occurrences
from .lineage import stored

#: What an occurrence of the whole phrase counts.
PHRASE = 100
#: Cells of lists that share a least value.
CELLS = 1 << 16


def document_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Postings word, id, n of the texts' words between blanks. Written once, they serve any number of searches."""
    return _counted(_words(docs, id_col, text_col, path_col))


def _words(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    words = F.split(_searched(text_col, path_col), " ")
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).where("word <> ''")


def _counted(words: DataFrame) -> DataFrame:
    return words.groupBy("word", "id").agg(F.count(F.lit(1)).alias("n"))


def _searched(text_col: str, path_col: str | None) -> Column:
    return normalize(F.concat_ws(" ", *([F.col(path_col)] if path_col else []), F.col(text_col)))


def _postings(index: DataFrame | None, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Postings list, id, value: `t:` lists count a token's occurrences, `p:` lists PHRASE for each of a phrase.

    Without an index, what is asked for is counted where the texts lie. A token and a phrase
    of one word may be the same string, which is counted once.
    """
    tokens = queries.select(F.explode("_qt").alias("s"))
    phrases = queries.select(F.col("_q").alias("phrase")).distinct()
    # one row for each different string that a query asks for
    single = stored(tokens.withColumn("kind", F.lit("t:")).union(phrases.where(~F.contains("phrase", F.lit(" "))).select("phrase", F.lit("p:"))).distinct())
    named = lambda rows: rows.select(F.concat("kind", "s").alias("list"), "id", (F.col("value") * F.when(F.col("kind") == "p:", PHRASE).otherwise(1)).alias("value"))
    if index is not None:
        counts, found = _from_index(index, single, phrases, texts)
    else:
        t = texts.select(F.col("id").alias("text_id"), F.col("_all").alias("text"))
        index = stored(occurrences(t, single.select(F.col("s").alias("pattern")).distinct()).select(F.col("pattern").alias("word"), F.col("text_id").alias("id"), "n"))
        counts = index.select(F.col("word").alias("s"), "id", F.col("n").alias("value"))
        longer = stored(phrases.where(F.contains("phrase", F.lit(" "))))
        found = occurrences(t, longer.select(F.col("phrase").alias("pattern"))).select(F.col("pattern").alias("s"), F.col("text_id").alias("id"), F.col("n").alias("value"))
    return named(counts.join(single, "s")).union(named(found.withColumn("kind", F.lit("p:"))))


def _from_index(index: DataFrame, single: DataFrame, phrases: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, id, value) of strings without a blank, and of phrases of several words.

    What has no blank stands within words, so that the index's words tell its occurrences.
    A phrase of several words is looked for in the texts that have its rarest word; the
    first of its words ends a word of the text, and the last begins one.
    """
    parts = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("nth", "s"), (F.size(F.split("phrase", " ")) - 1).alias("last"))
    # read several times
    vocabulary = stored(index.select("word").distinct())
    inside = stored(contained(vocabulary, single.select("s").union(parts.select("s")), "word", "word", "s"))
    times = count_of(F.col("word"), F.col("s"))
    counts = index.join(inside.join(single.select("s").distinct(), "s").withColumn("times", times), "word").groupBy("s", "id").agg(F.sum(F.col("n") * F.col("times")).alias("value"))

    fits = F.when(F.col("nth") == 0, F.endswith("word", F.col("s"))).when(F.col("nth") == F.col("last"), F.startswith("word", F.col("s"))).otherwise(F.col("word") == F.col("s"))
    usable = parts.where("last > 0").join(inside, "s").where(fits)
    holding = index.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    rarest = usable.join(holding, "word").groupBy("phrase", "nth").agg(F.sum("texts").alias("texts")).groupBy("phrase").agg(F.min_by("nth", F.struct("texts", "nth")).alias("nth"))
    held = usable.join(rarest, ["phrase", "nth"]).join(index, "word").select("phrase", "id").distinct()
    found = held.join(texts, "id").select(F.col("phrase").alias("s"), "id", count_of(F.col("_all"), F.col("phrase")).alias("value")).where("value > 0")
    return counts, found


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """query_id, id_col, score, rank, snippet: 100 per occurrence of the phrase and one per occurrence of a token; equal scores by path, else by id.

    A query's score is a sum over lists of postings, one for each token and one for the
    phrase. The k best are found in three steps: the sum over the lists' own k best gives
    a score that the k-th best reaches; a text that reaches it has at least an equal share
    of it in some list; and only such texts are scored in full. Equal queries are searched
    once. The ids of docs are unique.
    """
    asked = queries.select("query_id", normalize("query").alias("_q"))
    # one number for equal queries until the end
    q = stored(asked.select("_q").distinct().withColumn("_qt", search_tokens("_q")).where(F.size("_qt") > 0).withColumn("query_id", F.monotonically_increasing_id()))
    tie = F.col(path_col or id_col).alias("_tie")
    texts = docs.select(F.col(id_col).alias("id"), _searched(text_col, path_col).alias("_all"))
    posts = stored(_postings(index, q, texts))
    lists = q.select("query_id", F.explode(F.concat(F.transform("_qt", lambda t: F.concat(F.lit("t:"), t)), F.array(F.concat(F.lit("p:"), "_q")))).alias("list"), (F.size("_qt") + 1).alias("_m"))

    nth = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    best = posts.withColumn("_nth", nth("list", F.desc("value"), "id")).where(F.col("_nth") <= k).select("list", "id", "value")
    sums = lists.join(best, "list").groupBy("query_id", "id").agg(F.sum("value").alias("_sum"))
    floor = sums.withColumn("_nth", nth("query_id", F.desc("_sum"), "id")).where(F.col("_nth") == k).select("query_id", F.col("_sum").alias("_floor"))
    bound = stored(lists.join(floor, "query_id", "left").withColumn("_least", F.coalesce(F.ceil(F.col("_floor") / F.col("_m")), F.lit(0))))
    # what no query of a cell of lists can use is left out where it lies
    cell = F.pmod(F.xxhash64("list"), F.lit(CELLS)).alias("_cell")
    able = posts.join(F.broadcast(bound.groupBy(cell).agg(F.min("_least").alias("_any"))), cell == F.col("_cell")).where("value >= _any").select("list", "id", "value")
    wanted = bound.join(able.select("list", "value").distinct(), "list").where("value >= _least").select("query_id", "list", "value")
    some = wanted.join(able, ["list", "value"]).select("query_id", "id").distinct()
    scored = some.join(lists, "query_id").join(posts, ["list", "id"]).groupBy("query_id", "id").agg(F.sum("value").alias("score"))
    scored = scored if path_col is None else scored.join(docs.select(F.col(id_col).alias("id"), tie), "id")
    ranked = scored.withColumn("rank", nth("query_id", F.desc("score"), "_tie" if path_col else "id")).where(F.col("rank") <= k)
    shown = ranked.join(q, "query_id").join(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "id")
    out = shown.select("_q", "id", "score", "rank", snippet("_text", F.col("_qt")).alias("snippet")).join(asked, "_q")
    return out.select("query_id", F.col("id").alias(id_col), "score", "rank", "snippet")


def search_notices(register: DataFrame, queries: DataFrame, fields: Sequence[str], k: int = 20, recent: int = 5000, key: str = "unique_key", title: str = "title", seen: str = "last_seen_at", deadline: str = "deadline") -> DataFrame:
    """query_id, key, score, rank among the most recently seen rows: 3 per token in the title, 1 per token elsewhere; then the nearest deadline."""
    rows = register.orderBy(F.desc(seen), key).limit(recent)
    rows = rows.select(key, deadline, normalize(title).alias("_t"), normalize(F.concat_ws(" ", *fields)).alias("_a"))
    q = queries.select("query_id", F.explode(search_tokens("query")).alias("_tok"))
    # the rows searched are at most `recent`
    pairs = q.join(F.broadcast(rows), F.contains("_t", F.col("_tok")) | F.contains("_a", F.col("_tok")))
    scored = pairs.groupBy("query_id", key, deadline).agg(F.sum(F.when(F.contains("_t", F.col("_tok")), 3).otherwise(1)).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last(deadline), key))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def fetch_documents(docs: DataFrame, ids: DataFrame, most_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the wanted ids: id, the text's first characters, its length, and whether it was cut; ids without a document have null texts."""
    wanted = ids.select(id_col).distinct().join(docs.select(id_col, F.col(text_col).alias("_t")), id_col, "left")
    return wanted.select(id_col, F.substring("_t", 1, most_chars).alias("text"), F.length("_t").cast("long").alias("chars"), (F.length("_t") > most_chars).alias("truncated"))


def section_counts(docs: DataFrame, section_col: str = "section") -> DataFrame:
    """Documents per section; those without one are in `root`."""
    return docs.groupBy(F.coalesce(F.nullif(section_col, F.lit("")), F.lit("root")).alias(section_col)).agg(F.count(F.lit(1)).alias("documents"))


def list_documents(docs: DataFrame, most_chars: int = 2000, id_col: str = "doc_id", text_col: str = "text", section_col: str = "section") -> DataFrame:
    """id, section, the text's first characters, and whether it was cut."""
    return docs.select(id_col, section_col, F.substring(text_col, 1, most_chars).alias("text"), (F.length(text_col) > most_chars).alias("truncated"))
