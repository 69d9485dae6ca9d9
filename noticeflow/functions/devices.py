"""Models, kinds and search queries of technical items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, normalize


def device_models(x: Column | str) -> Column:
    """Different words that join letters and digits, such as `hp-2035n`, in order."""
    words = F.regexp_extract_all(normalize(x), F.lit(r"(?U)(?<![\w-])[a-zа-я0-9]+(?:[-/][a-zа-я0-9]+)*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"\d") & w.rlike("[a-zа-я]") & (F.length(w) >= 3)))


def item_kind(x: Column | str, kinds: Mapping[str, Sequence[str]]) -> Column:
    """The first kind, in order, one of whose words starts a word of the text."""
    text = normalize(x)
    return F.coalesce(*[F.when(text.rlike(r"(?U)(?<!\w)(?:" + "|".join(words) + ")"), kind) for kind, words in kinds.items()], F.lit(None).cast("string"))


def same_kind(item: Column | str, product: Column | str, kinds: Mapping[str, Sequence[str]]) -> Column:
    """Verdict on identity: unknown where the item has no kind, else whether the product is of it."""
    a, b = item_kind(item, kinds), item_kind(product, kinds)
    return F.when(a.isNull(), "unknown").when(b.eqNullSafe(a), "pass").otherwise("fail")


def search_queries(kind: Column | str, models: Column, part_numbers: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Part numbers, then each synonym of the kind with the first model; different ones in order."""
    k = col(kind)
    names = F.coalesce(*[F.when(k == name, F.array(*[F.lit(s) for s in (name, *others)])) for name, others in synonyms.items()], F.when(k.isNotNull(), F.array(k)), F.array().cast("array<string>"))
    first = F.get(models, F.lit(0))
    phrases = F.transform(names, lambda n: F.concat_ws(" ", n, first))
    return F.array_distinct(F.filter(F.concat(F.coalesce(part_numbers, F.array().cast("array<string>")), phrases), lambda q: q != ""))


def is_any_of(patterns: Sequence[str], *xs: Column | str) -> Column:
    """Whether one of the patterns occurs in the texts."""
    return normalize(F.concat_ws(" ", *[col(x) for x in xs])).rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))
