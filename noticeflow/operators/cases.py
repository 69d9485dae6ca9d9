"""Documents of cases: types, values, findings, items."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.text import normalize
from .lineage import stored
from .match import match_terms


def build_dictionary(profile: DataFrame, defaults: DataFrame, required: DataFrame) -> DataFrame:
    """The profile's terms, or the defaults where it has none, and required terms that are missing, compared case-folded. All: category, cat_ord, term, term_ord."""
    has = F.broadcast(profile.agg(F.count(F.lit(1)).alias("_n")))
    base = profile.withColumn("_p", F.lit(True)).unionByName(defaults.withColumn("_p", F.lit(False))).crossJoin(has).where(F.col("_p") == (F.col("_n") > 0)).drop("_p", "_n")
    fold = lambda df: df.withColumns({"_c": normalize("category"), "_t": normalize("term")})
    more = fold(required).join(fold(base).select("_c", "_t"), ["_c", "_t"], "left_anti").drop("_c", "_t")
    return base.unionByName(more)


def regional_queries(terms: DataFrame, regions: DataFrame) -> DataFrame:
    """Every term with every region; both are small rule tables."""
    return terms.select("term").distinct().crossJoin(regions.select("region").distinct()).select(F.concat_ws(" ", "term", "region").alias("query"))


def active_rows(df: DataFrame, keys: Sequence[str], flag: str = "active", order: str = "seq") -> DataFrame:
    """Trimmed rows that are switched on and complete; of equal ones, folded, the first."""
    on = F.lower(F.trim(F.coalesce(flag, F.lit("")))).isin("да", "yes", "true", "1", "on")
    rows = df.where(on).withColumns({k: F.trim(k) for k in keys})
    for k in keys:
        rows = rows.where(F.coalesce(k, F.lit("")) != "")
    nth = F.row_number().over(Window.partitionBy(*[normalize(k) for k in keys]).orderBy(order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def document_evidence(docs: DataFrame, dictionary: DataFrame, stops: DataFrame, region: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: terms (in the dictionary's order), stop terms and region that it holds."""
    t = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    # read for the dictionary and for the stop terms
    pairs = stored(match_terms(t, dictionary.select("term").union(stops.select("term")).distinct(), id_col, "_text"))
    ranked = lambda table, o, name: pairs.join(table.select(normalize("term").alias("term"), F.col(o).alias("_o")).groupBy("term").agg(F.min("_o").alias("_o")), "term").groupBy(id_col).agg(F.transform(F.array_sort(F.collect_set(F.struct("_o", "term"))), lambda x: x["term"]).alias(name))
    out = docs.withColumn("region", region).select(id_col, "region").join(ranked(dictionary, "term_ord", "terms"), id_col, "left").join(ranked(stops, "ord", "stop_terms"), id_col, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("terms", "stop_terms")})


def classify_documents(docs: DataFrame, types: Mapping[str, Sequence[str]], name: str = "name", text: str = "text", most: int = 30_000) -> DataFrame:
    """Adds doc_type: the type with most markers in the name, else in name and text; the earlier type on ties, `other` without any."""
    def best(x: Column) -> Column:
        counts = [F.struct(sum((F.contains(x, F.lit(m)).cast("int") for m in markers), F.lit(0)).alias("n"), F.lit(-k).alias("o"), F.lit(kind).alias("kind")) for k, (kind, markers) in enumerate(types.items())]
        top = F.array_max(F.array(*counts))
        return F.when(top["n"] > 0, top["kind"])

    fold = lambda x: F.translate(F.lower(x), "ё", "е")
    both = fold(F.concat_ws(" ", F.col(name), F.substring(text, 1, most)))
    return docs.withColumn("doc_type", F.coalesce(best(fold(F.coalesce(name, F.lit("")))), best(both), F.lit("other")))


def extract_metadata(segments: DataFrame, patterns: Mapping[str, Sequence[str]], keys: Sequence[str] = ("case_id",), text: str = "text") -> DataFrame:
    """Different values per pattern's first group: keys, field, value, source, locator."""
    found = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(1)).alias("values")) for f, ps in patterns.items() for p in ps])
    rows = segments.select(*keys, "source", "locator", F.explode(found).alias("f")).select(*keys, "source", "locator", "f.field", F.explode("f.values").alias("value"))
    return rows.withColumn("value", F.trim(F.regexp_replace("value", r"(?U)\s+", " "))).distinct()


def content_findings(segments: DataFrame, checks: Sequence[tuple[str, str, Sequence[str]]], topics: Mapping[str, Sequence[str]], keys: Sequence[str] = ("case_id",), text: str = "text") -> DataFrame:
    """Findings of segments that hold all tokens of a check (code, severity, tokens), and of cases in which a topic's marker occurs: keys, code, severity, source, locator; once per code and source."""
    low = F.translate(F.lower(text), "ё", "е")
    holds = lambda tokens: F.forall(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(low, t))
    hits = F.array_compact(F.array(*[F.when(holds(tokens), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, tokens in checks]))
    rows = segments.select(*keys, "source", "locator", F.explode(hits).alias("h")).select(*keys, "h.code", "h.severity", "source", "locator")
    rows = rows.groupBy(*keys, "code", "source").agg(F.min_by("severity", "locator").alias("severity"), F.min("locator").alias("locator"))
    some = {k: F.bool_or(F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m))) for k, markers in topics.items()}
    by_topic = segments.groupBy(*keys).agg(F.array_compact(F.array(*[F.when(x, F.lit(f"scope_{k}")) for k, x in some.items()])).alias("codes")).select(*keys, F.explode("codes").alias("code"))
    nothing = F.lit(None).cast("string")
    return rows.select(*keys, "code", "severity", "source", "locator").unionByName(by_topic.select(*keys, "code", F.lit("risk").alias("severity"), nothing.alias("source"), nothing.alias("locator")))


def completeness(cases: DataFrame, docs: DataFrame, required: Sequence[str], key: str = "case_id") -> DataFrame:
    """Findings per case: missing_<type> for each required type it lacks; check_223_rules for a 223-ФЗ case without requirements."""
    have = docs.select(key, F.col("doc_type").alias("need")).distinct()
    wanted = cases.select(key, F.explode(F.array(*[F.lit(r) for r in required])).alias("need"))
    missing = wanted.join(have, [key, "need"], "left_anti").select(key, F.lit("blocker").alias("severity"), F.concat(F.lit("missing_"), "need").alias("code"))
    law = cases.where(F.lower("law").startswith("223")).select(key).join(have.where("need = 'application_requirements'"), key, "left_anti")
    return missing.union(law.select(key, F.lit("action"), F.lit("check_223_rules")))


def questions(findings: DataFrame, metadata: DataFrame, by_code: Mapping[str, str], unless: Mapping[str, str], cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Questions of each case, different ones: one per finding whose code is in by_code (or begins with a key that ends in *), and one per metadata field that the case lacks.

    In a question {subject} stands for what follows the key in the code.
    """
    hit = []
    for code, question in by_code.items():
        stem = code.removesuffix("*")
        named = F.col("code").startswith(stem) if code.endswith("*") else F.col("code") == stem
        hit.append(F.when(named, F.replace(F.lit(question), F.lit("{subject}"), F.substring("code", len(stem) + 1, 200))))
    asked = findings.select(key, F.coalesce(*hit).alias("question")).where("question is not null")
    wanted = cases.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(q).alias("question")) for f, q in unless.items()])).alias("u")).select(key, "u.field", "u.question")
    lacking = wanted.join(metadata.select(key, "field").distinct(), [key, "field"], "left_anti").select(key, "question")
    return asked.union(lacking).distinct()


#: Units of an item line.
UNITS = ("шт", "компл", "комплект", "ед", "м", "кг", "л", "уп")


def text_items(segments: DataFrame, keys: Sequence[str] = ("case_id",), units: Sequence[str] = UNITS, text: str = "text") -> DataFrame:
    """Item lines `1. name 5 шт.` of texts: keys, source, locator, line_id, name, quantity, unit."""
    single = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    rows = segments.select(*keys, "source", "locator", F.explode(single).alias("_l"))
    # the number stands first, quantity and unit last, the name is what is left between
    known = "|".join(sorted(units, key=len, reverse=True))
    end = rf"(?iU) (\d+(?:[.,]\d+)?) ?({known})\.?$"
    rows = rows.withColumns({"_n": F.regexp_extract("_l", r"^(\d{1,4})[.)] ", 1), "_q": F.regexp_extract("_l", end, 1), "_u": F.regexp_extract("_l", end, 2)})
    rows = rows.withColumn("_name", F.trim(F.regexp_replace(F.regexp_replace("_l", r"^\d{1,4}[.)] ", ""), end, "")))
    rows = rows.where((F.col("_n") != "") & (F.col("_q") != "") & F.length("_name").between(3, 180))
    return rows.select(*keys, "source", "locator", F.col("_n").alias("line_id"), F.col("_name").alias("name"), F.translate("_q", ",", ".").alias("quantity"), F.col("_u").alias("unit"))


def table_items(rows: DataFrame, keys: Sequence[str] = ("case_id", "table"), order: str = "row") -> DataFrame:
    """Items of table rows, continuation rows joined to the item above: keys, line_id, name, quantity, unit, required_specs.

    rows: keys, order, cells (array). A row starts an item if its first cell is a number,
    its second a name and its last a quantity; cells 4 and 5 are a characteristic and its value.
    """
    c = lambda k: F.trim(F.coalesce(F.try_element_at("cells", F.lit(k)), F.lit("")))
    start = c(1).rlike(r"^\d{1,4}\.?$") & (c(2) != "") & ~c(2).rlike(r"^\d+([.,]\d+)?$") & c(-1).rlike(r"^\d+([.,]\d+)?$")
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = rows.where(F.size("cells") >= 5).withColumn("_start", start).withColumn("_item", F.sum(F.col("_start").cast("int")).over(upto)).where("_item > 0")
    spec = F.when(c(4) != "", F.concat_ws(": ", c(4), F.when(c(5) != "", c(5))))
    first = lambda x, name: F.max(F.when(F.col("_start"), x)).alias(name)
    out = t.groupBy(*keys, "_item").agg(first(F.regexp_replace(c(1), r"\.$", ""), "line_id"), first(c(2), "name"), first(F.replace(c(-1), F.lit(","), F.lit(".")), "quantity"), first(c(-2), "unit"), F.array_sort(F.collect_list(F.when(spec.isNotNull(), F.struct(F.col(order).alias("o"), spec.alias("s"))))).alias("_s"))
    return out.withColumn("required_specs", F.array_join(F.transform("_s", lambda x: x["s"]), "; ")).drop("_s", "_item")


def names_differ(a: str, b: str, least: float = 0.8) -> bool:
    """Whether the ratio of matching characters falls below the least; bounds of the ratio decide first."""
    if a == b:
        return False
    short, both = min(len(a), len(b)), len(a) + len(b)
    if 2 * short / both < least or 2 * (Counter(a) & Counter(b)).total() / both < least:
        return True
    return SequenceMatcher(None, a, b).ratio() < least


def _values(column: pa.Array) -> list:
    """A column's values; each different string is decoded once."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        found = column.dictionary_encode()
        known = [*found.dictionary.to_pylist(), None]
        return [known[k] for k in found.indices.fill_null(-1).to_numpy().tolist()]
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    return column.to_pylist()


def reconcile_items(items: DataFrame, keys: Sequence[str] = ("case_id",), seq: str = "seq", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Items of several documents with one line and quantity as one, and the groups whose names or codes differ.

    In order of seq, an item opens the group of its line and quantity, unless an item that
    stands repeats its name, quantity and source: then it goes, and the group stays closed. A
    later item of an open group is compared with the one that stands for it, and takes its
    place if only it has specs. Only items of one quantity meet, so that each case and
    quantity is replayed by itself, row by row; what it keeps are the items that stand.
    items: keys, line_id, quantity, name, source, required_specs, seq (different numbers in a case).
    Each of the two tables replays the items when it is read.
    """
    group, columns = [*keys, "line_id", "quantity"], items.columns
    code = r"\b\d{2}(?:\.\d{2}){2}\.\d{3}\b"
    folded = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("name", F.lit("")), F.lit(code), F.lit(0))))
    rows = items.repartition(*keys, "quantity").sortWithinPartitions(*keys, "quantity", seq)
    rows = rows.select("*", folded(F.col("name")).alias("_fold"), folded(F.regexp_replace("name", code, " ")).alias("_base"), F.array_join(codes, " ").alias("_codes"), (F.coalesce("required_specs", F.lit("")) != "").alias("_specs"))

    def replay(batches):
        differ_ = lru_cache(1 << 16)(partial(names_differ, least=least))
        current, standing, names = None, {}, Counter()

        def shown(table, at, differ):
            return pa.RecordBatch.from_arrays([*table.take(pa.array(at, pa.int64())).columns[: len(columns)], pa.array(differ, pa.bool_())], names=[*columns, "_differ"])

        for batch in batches:
            c = {n: _values(batch.column(n)) for n in {*group, "source", "_fold", "_base", "_codes", "_specs"}}
            at, differ = [], []
            # an item that stands: its table and row there, what is compared, and whether the group differs
            for i, (key, line, name, codes, base, specs) in enumerate(zip(zip(*[c[k] for k in [*keys, "quantity"]], strict=True), c["line_id"], zip(c["_fold"], c["source"], strict=True), c["_codes"], c["_base"], c["_specs"], strict=True)):
                if key != current:
                    for x in standing.values():
                        if x[0] is batch:
                            at.append(x[1])
                            differ.append(x[6])
                        else:
                            yield shown(x[0], [x[1]], [x[6]])
                    current, standing, names = key, {}, Counter()
                old = standing.get(line)
                if old is None:
                    if not names[name]:
                        standing[line] = [batch, i, name, codes, base, specs, False]
                        names[name] += 1
                    continue
                old[6] = bool(old[6] or (codes and old[3] and codes != old[3]) or differ_(old[4], base))
                if specs and not old[5]:
                    names[old[2]] -= 1
                    names[name] += 1
                    old[:6] = [batch, i, name, codes, base, specs]
            if at:
                yield shown(batch, at, differ)
            # of a group that goes on, only its rows are kept
            last = [x for x in standing.values() if x[0] is batch]
            held = batch.take(pa.array([x[1] for x in last], pa.int64()))
            for k, x in enumerate(last):
                x[:2] = [held, k]
        for x in standing.values():
            yield shown(x[0], [x[1]], [x[6]])

    found = rows.mapInArrow(replay, StructType([*items.schema.fields, StructField("_differ", BooleanType())]))
    return found.drop("_differ"), found.where("_differ").select(*group)


def promote_items(cases: DataFrame, items: DataFrame, candidates: DataFrame, prices: DataFrame, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """Items from candidates for cases without any, and cases with the first start price found where they have none. prices: key, value, seq.

    A case without a number whose title is nothing but 10 to 25 digits takes these as its number, where cases have both columns.
    """
    new = candidates.join(items.select(key).distinct(), key, "left_anti")
    first = prices.groupBy(key).agg(F.min_by("value", "seq").alias("_price"))
    out = cases.join(first, key, "left").withColumn("start_price", F.coalesce("start_price", F.col("_price").cast(cases.schema["start_price"].dataType))).drop("_price")
    if {"title", "tender_number"} <= set(cases.columns):
        digits = F.regexp_extract(F.trim(F.coalesce("title", F.lit(""))), r"^(\d{10,25})$", 1)
        out = out.withColumn("tender_number", F.coalesce(F.nullif(F.trim("tender_number"), F.lit("")), F.nullif(digits, F.lit(""))))
    return items.unionByName(new, allowMissingColumns=True), out


def keyed_update(table: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], closed: Mapping[str, Sequence[str]] | None = None, positive: Sequence[str] = (), once: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows changed by key (null: keep) or appended, and rejected changes (values outside a closed list, negative numbers). `once` columns keep their first value."""
    bad = F.lit(False)
    for c, values in (closed or {}).items():
        bad = bad | (F.col(c).isNotNull() & ~F.col(c).isin(*values))
    for c in positive:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    rejects, good = changes.where(bad), changes.where(~bad)
    g = good.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = table.join(g, list(keys), "full_outer")
    return both.withColumns({c: F.coalesce(c, f"_n_{c}") if c in once else F.coalesce(f"_n_{c}", c) for c in columns}).select(*table.columns), rejects
