"""Terms of a dictionary in texts, by keys.

Every word start of a text gives a key of up to four characters; a term is looked
up by the key of the place that must be a word start, and each candidate pair is
verified. No term is compared with every text, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, quoted, stem

#: Letters after which a word's ending may change.
VOWELS = "аеиоуыэюяь"
#: Characters that may stand between the end of one stem and the next word's start.
GAP = 20
KEY = 4


def word_keys(text: Column) -> Column:
    """Different keys of 1 to KEY characters at the word starts of a normalized text."""
    starts = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)(?<![\w-])(?=(.{{1,{KEY}}}))"), F.lit(1)))
    cut = lambda k: lambda s: F.substring(s, 1, k)
    return F.array_distinct(F.flatten(F.array(*[F.transform(starts, cut(k)) for k in range(1, KEY + 1)])))


def _phrase_parts(term: Column, stop_words: Sequence[str]) -> Column:
    """Stems of a phrase's words with whether the word must match whole."""
    words = F.filter(F.split(term, " "), lambda w: ~w.isin(*stop_words) if stop_words else F.lit(True))
    short = lambda w: F.length(stem(w)) < 4
    return F.transform(words, lambda w: F.struct(F.when(short(w), w).otherwise(stem(w)).alias("part"), short(w).alias("whole")))


def dictionary_terms(terms: DataFrame, term_col: str = "term", blocked_col: str | None = None, stop_words: Sequence[str] = ()) -> DataFrame:
    """Different normalized terms with their lookup keys: term, phrase, blocked, parts, keys."""
    t = terms.select(normalize(term_col).alias("term"), (F.col(blocked_col) if blocked_col else F.lit(None).cast("string")).alias("blocked")).where("term <> ''").dropDuplicates(["term"])
    t = t.withColumn("phrase", F.contains("term", F.lit(" "))).withColumn("parts", F.when(F.col("phrase"), _phrase_parts(F.col("term"), stop_words)))
    bare = F.when((F.length("term") >= 5) & F.substring("term", -1, 1).isin(*VOWELS), F.expr("substring(term, 1, length(term) - 1)")).otherwise(F.col("term"))
    first = F.when(F.size("parts") > 0, F.col("parts")[0]["part"])
    keys = F.when(F.col("phrase"), F.array_compact(F.array(F.split("term", " ")[1], first))).otherwise(F.array(bare))
    return t.withColumn("bare", bare).withColumn("keys", F.array_distinct(F.transform(keys, lambda k: F.substring(k, 1, KEY))))


def _word_hit(text: Column, term: Column, bare: Column, blocked: Column) -> Column:
    guard = F.when(blocked.isNotNull(), F.concat(F.lit("(?!"), blocked, F.lit(")"))).otherwise("")
    pattern = lambda t: F.concat(F.lit(r"(?U)(?<![\w-])"), quoted(t), guard)
    return F.rlike(text, pattern(term)) | ((bare != term) & F.rlike(text, pattern(bare)))


def _phrase_hit(text: Column, parts: Column) -> Column:
    """Each part's first place at or after the end of the part before; places too far off end the search."""
    padded = F.concat(F.lit(" "), text)

    def step(acc, p):
        # from one character before, which the look-behind must see
        rest = F.substring(padded, acc["at"] - 1, F.length(padded))
        pattern = F.concat(F.lit(r"(?Us)(?<=.)(?<![\w-])"), quoted(p["part"]), F.when(p["whole"], r"(?![\w-])").otherwise(""))
        place = F.when(acc["ok"], F.regexp_instr(rest, pattern)).otherwise(0)
        begin = acc["at"] + place - 2
        near = acc["ok"] & (place > 0) & (acc["first"] | (begin - acc["at"] <= GAP))
        return F.struct(F.when(near, begin + F.length(p["part"])).otherwise(acc["at"]).alias("at"), near.alias("ok"), F.lit(False).alias("first"))

    begin = F.struct(F.lit(2).alias("at"), F.lit(True).alias("ok"), F.lit(True).alias("first"))
    return (F.size(parts) > 0) & F.aggregate(parts, begin, step, lambda acc: acc["ok"])


def match_terms(texts: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", title_col: str | None = None, term_col: str = "term", blocked_col: str | None = None, stop_words: Sequence[str] = ()) -> DataFrame:
    """Pairs (id_col, term) of texts and the terms in them.

    A word matches where a word starts with it (not after a dash) and its blocked
    ending doesn't follow; one that ends in a vowel also without that. A phrase
    matches literally, or by the stems of its words in order. With title_col single
    words are looked for in the title only. The terms are a rule table.
    """
    t = texts.select(F.col(id_col).alias("_id"), normalize(text_col).alias("_text"), normalize(title_col or text_col).alias("_title"))
    rules = dictionary_terms(terms, term_col, blocked_col, stop_words)
    # a text looks its keys up in the whole rule table, which goes to every task as one row
    keys = word_keys(F.col("_text")) if title_col is None else F.array_distinct(F.concat(word_keys(F.col("_text")), word_keys(F.col("_title"))))
    by_key = rules.select(F.explode("keys").alias("key"), F.struct("term", "phrase", "blocked", "bare", "parts").alias("rule")).groupBy("key").agg(F.collect_list("rule").alias("rules"))
    table = by_key.agg(F.map_from_entries(F.collect_list(F.struct("key", "rules"))).alias("_rules"))
    found = F.array_distinct(F.flatten(F.transform(F.array_intersect(keys, F.map_keys("_rules")), lambda k: F.try_element_at("_rules", k))))
    both = t.where("_id is not null").crossJoin(F.broadcast(table)).select("_id", "_text", "_title", found.alias("_found"))

    def verified(c):
        word = _word_hit(F.col("_title"), c["term"], c["bare"], c["blocked"])
        phrase = F.contains(F.col("_text"), c["term"]) | _phrase_hit(F.col("_text"), c["parts"])
        return F.when(c["phrase"], phrase).otherwise(word)

    return both.select(F.col("_id").alias(id_col), F.explode(F.transform(F.filter("_found", verified), lambda c: c["term"])).alias("term")).distinct()


def best_category(matches: DataFrame, dictionary: DataFrame, id_col: str = "id") -> DataFrame:
    """The best category of each text: most words over its different terms, then the longest term, then the earlier category.

    dictionary has category, cat_ord, term and term_ord. Returns id_col, category, terms (in the dictionary's order).
    """
    d = dictionary.select("category", "cat_ord", normalize("term").alias("term"), "term_ord").groupBy("category", "cat_ord", "term").agg(F.min("term_ord").alias("term_ord"))
    words = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) + 1
    scored = matches.join(d, "term").groupBy(id_col, "category", "cat_ord").agg(
        F.sum(words).alias("words"), F.max(F.length("term")).alias("longest"), F.transform(F.array_sort(F.collect_set(F.struct("term_ord", "term"))), lambda x: x["term"]).alias("terms")
    )
    return scored.groupBy(id_col).agg(F.max_by(F.struct("category", "terms"), F.struct("words", "longest", -F.col("cat_ord"))).alias("best")).select(id_col, "best.category", "best.terms")


def stop_term(matches: DataFrame, stops: DataFrame, id_col: str = "id") -> DataFrame:
    """The first stop term of each text in the list's order: stops has term and ord."""
    s = stops.select(normalize("term").alias("term"), "ord").groupBy("term").agg(F.min("ord").alias("ord"))
    return matches.join(s, "term").groupBy(id_col).agg(F.min_by("term", "ord").alias("stop_term"))
