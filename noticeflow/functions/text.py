"""Text, price and date expressions. Patterns are Unicode-aware: they begin with (?U)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that count as a plain one.
BLANKS = "   "


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalize(x: Column | str) -> Column:
    """Lower case, single blanks, `ё` as `е`; null gives an empty string."""
    plain = F.translate(F.coalesce(col(x), F.lit("")), BLANKS + "ёЁ", " " * len(BLANKS) + "еЕ")
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def stem(word: Column | str) -> Column:
    """A word without its last two letters, at least four and at most ten of them."""
    w = col(word)
    return F.substring(w, F.lit(1), F.greatest(F.lit(4), F.least(F.lit(10), F.length(w) - 2)))


def search_tokens(x: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Different words and numbers of two characters or more, in order; parts joined by - / . stay together."""
    tokens = F.regexp_extract_all(normalize(x), F.lit(r"[a-zа-я0-9]+(?:[-/.][a-zа-я0-9]+)*"), F.lit(0))
    kept = F.filter(tokens, lambda t: (F.length(t) >= 2) & (~t.isin(*stop_words) if stop_words else F.lit(True)))
    return F.array_distinct(kept)


def stems(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, stem))


def parse_price(x: Column | str, require_currency: bool = True) -> Column:
    """Roubles as a number: comma is the decimal point where there is one; millions and thousands are multiplied out."""
    # runs of digits, blanks and separators, from a digit to a digit; a single digit is no price
    runs = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"[0-9][0-9\s.,]*"), F.lit(0)), lambda r: F.rtrim(r, F.lit(" .,")))
    first = lambda t: F.coalesce(F.get(F.filter(runs(t), lambda r: F.length(r) > 1), F.lit(0)), F.lit(""))

    def value(t: Column, found: Column) -> Column:
        parts = F.split(F.translate(found, " ", ""), ",")
        number = F.when(F.size(parts) > 1, F.array_join(F.transform(parts, lambda p: F.translate(p, ".", "")), ".")).otherwise(parts[0])
        tail = F.substring(t, F.instr(t, found) + F.length(found), F.length(t))
        times = F.when(tail.rlike(r"^\s*млн"), 1_000_000.0).when(tail.rlike(r"^\s*тыс"), 1_000.0).otherwise(1.0)
        foreign = F.contains(t, F.lit("$")) | F.contains(t, F.lit("usd")) | F.contains(t, F.lit("без указания цены"))
        rouble = F.contains(t, F.lit("₽")) | F.contains(t, F.lit("руб"))
        return F.when((found != "") & ~foreign & (rouble if require_currency else F.lit(True)), number.try_cast("double") * times)

    return once(normalize(x), lambda t: once(first(t), lambda found: value(t, found)))


def shape(form: str) -> str | None:
    """What every text of a format of plain numbers begins with; none for formats with names or optional parts."""
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]", form)
    if any(p[0] not in "yMdHms" or p[0] == "M" and len(p) > 2 for p in parts if p.isalpha()) or re.search(r"['\[\]{}#]", form):
        return None
    return "^" + "".join(r"[+-]?\d+" if p.isalpha() else re.escape(p) for p in parts)


def parse_ts(x: Column | str, formats: Sequence[str] = ("dd.MM.yyyy HH:mm", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """The first of the formats that fits, else an ISO time whose zone is cut off.

    Only formats whose shape the text has are tried: a try that fails costs many times one that doesn't.
    """

    def value(t: Column) -> Column:
        iso = F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", "")
        tried = [F.when(t.rlike(shape(f)), F.try_to_timestamp(t, F.lit(f))) if shape(f) else F.try_to_timestamp(t, F.lit(f)) for f in formats]
        return F.coalesce(*tried, F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), iso.try_cast("timestamp")))

    return once(F.trim(F.coalesce(col(x), F.lit(""))), value)


#: Names of months in the genitive.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def parse_month_name(x: Column | str, now: Column | str, months: Sequence[str] = MONTHS) -> Column:
    """`5 июня 2026, 10:00`; without a year the current one, or the next where a December looks at a January."""
    t, now = normalize(x), col(now)
    form = r"(\d{1,2})\s+([а-яa-z]+)(?:\s+(\d{4}))?(?:\s*,?\s*(\d{1,2}):(\d{2}))?"
    part = lambda k: F.regexp_extract(t, form, k)
    month = F.array_position(F.array(*[F.lit(m) for m in months]), part(2)).cast("int")
    year = F.when(part(3) != "", part(3).cast("int")).otherwise(F.year(now) + F.when((F.month(now) == 12) & (month == 1), 1).when((F.month(now) == 1) & (month == 12), -1).otherwise(0))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:00", year, month, part(1).cast("int"), F.coalesce(part(4).try_cast("int"), F.lit(0)), F.coalesce(part(5).try_cast("int"), F.lit(0)))
    return F.when(month > 0, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def title_key(x: Column | str) -> Column:
    return F.regexp_replace(normalize(x), r"(?U)[^\w]+", "")


def number_key(x: Column | str) -> Column:
    """A number without blanks, folded; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", "")), F.lit(""))


def org_key(x: Column | str) -> Column:
    return F.substring(F.regexp_replace(normalize(x), r"(?U)[^\p{L}\p{N}]+", ""), 1, 180)


def snippet(text: Column | str, tokens: Column, radius: int = 240) -> Column:
    """A text's characters on both sides of the first token in its normalized form, as many as the radius each; without one its first 2 x radius in single blanks."""
    raw = F.coalesce(col(text), F.lit(""))
    found = normalize(raw)
    at = F.array_min(F.filter(F.transform(tokens, lambda k: F.instr(found, k)), lambda p: p > 0)) - 1
    start = F.greatest(F.lit(0), at - radius)
    single = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(at.isNull(), F.substring(single(raw), 1, 2 * radius)).otherwise(single(F.substring(raw, start + 1, at + radius - start)))


def excerpt(text: Column | str, start: Column, end: Column, around: int = 100) -> Column:
    """Characters start..end (from 0) and some on both sides, in single blanks."""
    low = F.greatest(F.lit(0), start - around)
    return F.trim(F.regexp_replace(F.substring(col(text), low + 1, end + around - low), r"(?U)\s+", " "))


def quoted(x: Column) -> Column:
    """The pattern that matches a string itself."""
    return F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|&~#-])", r"\\$1")


def count_of(text: Column, token: Column) -> Column:
    """Occurrences that don't overlap; none of an empty token."""
    return F.when(F.length(token) > 0, ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("long")).otherwise(0)
