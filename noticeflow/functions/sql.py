"""The text, price and date functions for SQL text: temporary functions that Catalyst inlines, without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import BLANKS, shape

#: name, parameters, result and body; later bodies use earlier functions.
FUNCTIONS = (
    ("nf_normalize", "x STRING", "STRING", rf"lower(trim(regexp_replace(translate(coalesce(x, ''), '{BLANKS}ёЁ', '{' ' * len(BLANKS)}еЕ'), r'(?U)\s+', ' ')))"),
    ("nf_stem", "word STRING", "STRING", "substring(word, 1, greatest(4, least(10, length(word) - 2)))"),
    ("nf_tokens", "x STRING", "ARRAY<STRING>", "array_distinct(filter(regexp_extract_all(nf_normalize(x), '[a-zа-я0-9]+(?:[-/.][a-zа-я0-9]+)*', 0), t -> length(t) >= 2))"),
    # the first run of digits, blanks and separators of more than one character, in a normalized text
    ("nf_digits", "t STRING", "STRING", r"coalesce(get(filter(transform(regexp_extract_all(t, r'[0-9][0-9\s.,]*', 0), r -> rtrim(' .,', r)), r -> length(r) > 1), 0), '')"),
    # its number: a comma is the decimal point where there is one
    ("nf_number", "run STRING", "DOUBLE", "try_cast(CASE WHEN contains(run, ',') THEN array_join(transform(split(translate(run, ' ', ''), ','), p -> translate(p, '.', '')), '.') ELSE translate(run, ' ', '') END AS DOUBLE)"),
    (
        "nf_scale", "t STRING, run STRING", "DOUBLE",
        r"CASE WHEN substring(t, instr(t, run) + length(run)) RLIKE r'^\s*млн' THEN 1000000D WHEN substring(t, instr(t, run) + length(run)) RLIKE r'^\s*тыс' THEN 1000D ELSE 1D END",
    ),
    ("nf_foreign", "t STRING", "BOOLEAN", "contains(t, '$') OR contains(t, 'usd') OR contains(t, 'без указания цены')"),
    (
        "nf_price", "x STRING, require_currency BOOLEAN", "DOUBLE",
        "CASE WHEN nf_digits(nf_normalize(x)) <> '' AND NOT nf_foreign(nf_normalize(x)) AND (NOT require_currency OR contains(nf_normalize(x), '₽') OR contains(nf_normalize(x), 'руб'))"
        " THEN nf_number(nf_digits(nf_normalize(x))) * nf_scale(nf_normalize(x), nf_digits(nf_normalize(x))) END",
    ),
    (
        "nf_time", "x STRING", "TIMESTAMP",
        "coalesce(" + ", ".join(f"CASE WHEN trim(coalesce(x, '')) RLIKE r'{shape(f)}' THEN try_to_timestamp(trim(coalesce(x, '')), '{f}') END" for f in ("dd.MM.yyyy HH:mm", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"))
        + r", CASE WHEN trim(coalesce(x, '')) RLIKE r'^\d{4}-\d{2}-\d{2}T' THEN try_cast(regexp_replace(trim(coalesce(x, '')), r'(Z|[+-]\d{2}:?\d{2})$', '') AS TIMESTAMP) END)",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; returns their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
