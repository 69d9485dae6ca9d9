"""Keys, numbers, links and other identities as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, normalize


def blank_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_null(x) for x in xs])


def unique_key(source: Column | str, number: Column | str, url: Column | str) -> Column:
    """source:number, else source:url without fragment and closing slashes."""
    link = F.rtrim(F.split_part(F.coalesce(col(url), F.lit("")), F.lit("#"), F.lit(1)), F.lit("/"))
    return F.concat(F.coalesce(col(source), F.lit("")), F.lit(":"), F.coalesce(blank_null(number), link))


def law_for_number(number: Column | str) -> Column:
    """11 digits: 223-ФЗ; 19 or 20 digits: 44-ФЗ."""
    n = col(number)
    return F.when(n.rlike(r"^\d{11}$"), "223-ФЗ").when(n.rlike(r"^\d{19,20}$"), "44-ФЗ")


def law_by_label(number: Column | str, text: Column | str) -> Column:
    """The law that a text names, 44-ФЗ first, else that of the number's digits: 19, or 11 that begin with 3."""
    n, t = F.regexp_replace(F.coalesce(col(number), F.lit("")), r"\D", ""), F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(F.contains(t, F.lit("44-фз")) | (F.length(n) == 19), "44-ФЗ").when(F.contains(t, F.lit("223-фз")) | n.rlike(r"^3\d{10}$"), "223-ФЗ")


#: Fixed value: the label, with its colon, before an official number of 19 or 20 digits or of 11 that begin with 3.
OFFICIAL_NUMBER = r"(?U)(?<!\w)закупка\s*:\s*(?:№\s*)?(\d{19,20}|3\d{10})(?!\d)"


def official_numbers(x: Column | str) -> Column:
    """Different numbers that follow the label `закупка:`."""
    return F.array_distinct(F.regexp_extract_all(normalize(x), F.lit(OFFICIAL_NUMBER), F.lit(1)))


def one_official(x: Column | str) -> tuple[Column, Column]:
    """The only number, and whether there are several."""
    numbers = official_numbers(x)
    return F.when(F.size(numbers) == 1, numbers[0]), F.size(numbers) > 1


#: Words of names that mark-up splits before their ending, and those endings.
SPLIT_WORDS = ("РЕСПУБЛИК", "ОБЛАСТ", "СЕВАСТОПОЛ", "ЗАПОРОЖСК", "КРЫМСК")
SPLIT_ENDINGS = ("И", "Я", "ОЙ", "ИЙ")


def clean_org(x: Column | str) -> Column:
    """Single blanks; endings that mark-up cut off rejoin their word."""
    single = F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))
    return F.regexp_replace(single, rf"(?iU)\b({'|'.join(SPLIT_WORDS)}) ({'|'.join(SPLIT_ENDINGS)})\b", "$1$2")


#: Letters of the Cyrillic alphabet and what they become.
PLAIN_FROM, PLAIN_TO = "абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye"
LONG = (("ё", "e"), ("ж", "zh"), ("х", "h"), ("ц", "c"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ъ", ""), ("ь", ""), ("ю", "yu"), ("я", "ya"))


def source_slug(x: Column | str) -> Column:
    """Latin letters, digits and single dashes."""
    out = F.translate(F.lower(F.trim(col(x))), PLAIN_FROM, PLAIN_TO)
    for a, b in LONG:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def fingerprint(source: Column | str, number: Column | str, title: Column | str, url: Column | str) -> Column:
    """SHA-256 of the identity as JSON with sorted keys."""
    return F.sha2(
        F.to_json(F.struct(F.coalesce(col(number), F.lit("")).alias("number"), F.coalesce(col(source), F.lit("")).alias("source"), F.coalesce(col(title), F.lit("")).alias("title"), F.split_part(F.coalesce(col(url), F.lit("")), F.lit("#"), F.lit(1)).alias("url"))),
        256,
    )


def candidate_id(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256), 1, 24)


def normalize_email(x: Column | str) -> Column:
    """The first address in the text, in lower case; null without one."""
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(col(x), F.lit(""))), r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", 0), F.lit(""))


#: Names and domains of addresses that no person reads.
SYSTEM_NAMES = ("noreply", "no-reply", "donotreply", "donot-reply", "do-notreply", "do-not-reply", "mailer-daemon", "postmaster", "root")
SYSTEM_DOMAINS = ("example.com", "example.net", "example.org", "invalid", "localhost")


def is_system_email(x: Column | str, names: tuple[str, ...] = SYSTEM_NAMES, domains: tuple[str, ...] = SYSTEM_DOMAINS) -> Column:
    parts = F.split(F.lower(F.coalesce(col(x), F.lit(""))), "@")
    return (F.size(parts) > 1) & (parts[0].isin(*names) | F.element_at(parts, -1).isin(*domains))


def digits(x: Column | str, lengths: tuple[int, ...]) -> Column:
    """Only the digits, where their number is one of the lengths."""
    d = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\D", "")
    return F.when(F.length(d).isin(*lengths), d)


def marker_fields(x: Column | str) -> Column:
    """Lines KEY=value as a map; the first of a key counts."""
    lines = F.filter(F.split(F.coalesce(col(x), F.lit("")), r"\r?\n"), lambda line: line.rlike(r"^[A-Z][A-Z0-9_]*=.+$"))
    keys = F.transform(lines, lambda line: F.regexp_extract(line, r"^([A-Z][A-Z0-9_]*)=", 1))
    values = F.transform(lines, lambda line: F.trim(F.regexp_extract(line, r"^[A-Z][A-Z0-9_]*=(.+)$", 1)))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))).alias("n")), lambda e: e["k"].isNotNull() & (F.array_position(keys, e["k"]) == e["n"]))
    return F.map_from_arrays(F.transform(first, lambda e: e["k"]), F.transform(first, lambda e: e["v"]))


def host(url: Column | str) -> Column:
    """Host of a link in lower case, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def in_domain(url: Column | str, domain: str) -> Column:
    h = F.coalesce(host(url), F.lit(""))
    return (h == domain) | F.endswith(h, F.lit("." + domain))


def host_label(urls: list[Column | str], labels: dict[str, str], source: Column | str, sources: dict[str, str], default: str) -> Column:
    """Label of the first link in a known domain, else of the source, else the default; domains in their order."""
    by_url = [F.when(in_domain(u, d), name) for u in urls for d, name in labels.items()]
    by_source = [F.when(col(source) == s, name) for s, name in sources.items()]
    return F.coalesce(*by_url, *by_source, F.lit(default))


def days_left(deadline: Column | str, now: Column | str) -> Column:
    return F.datediff(col(deadline), col(now))


def age_hours(then: Column | str, now: Column | str) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_timestamp(col(now)) - F.unix_timestamp(col(then))) / 3600.0)


def formula_safe(x: Column | str) -> Column:
    """Text that a spreadsheet would read as a formula gets a leading quote; control characters go."""
    plain = F.regexp_replace(col(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(plain.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), plain)).otherwise(plain)
