"""Queries of functions and jobs over rows that are derived from the given tables by the same text on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import devices, ids, text
from ..operators import cases, classify, customers, economics, freshness, links, match, register, report, search
from ..operators.lineage import dealt
from ..sources import files, pages, payloads, sinks
from ..streaming import archives
from .landed import shared_folder
from .queries import _CASES, _PICK, _TOTALS, BATCHES, NOTICES, _case_tables, query, ts
from .tables import batches, load, notices

# --- functions -------------------------------------------------------------

_NUMBERS = "t AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS STRING), 19, '0') AS n, '3' || lpad(CAST(c_custkey AS STRING), 10, '0') AS m FROM customer), x AS (SELECT k, n, m, CASE k % 5 WHEN 0 THEN 'Закупка: ' || n || '; закупка : № ' || n WHEN 1 THEN 'закупка: ' || n || ', закупка: ' || m WHEN 2 THEN 'Закупка № ' || n || ' перезакупка: ' || m WHEN 3 THEN 'закупка: 8' || substr(m, 2) ELSE 'закупка:' || m END AS meta, CASE k % 4 WHEN 0 THEN 'по 44-ФЗ' WHEN 1 THEN '223-фз' ELSE '' END AS law FROM t)"


@query(
    f"""WITH {_NUMBERS} SELECT k, CASE k % 5 WHEN 0 THEN n WHEN 1 THEN n || ',' || m WHEN 4 THEN m ELSE '' END AS numbers, CASE k % 5 WHEN 0 THEN n WHEN 4 THEN m END AS one, k % 5 = 1 AS conflict,
 CASE WHEN k % 4 = 0 OR k % 5 = 0 THEN '44-ФЗ' WHEN k % 4 = 1 OR k % 5 = 4 THEN '223-ФЗ' END AS law FROM x"""
)
def fn_official(spark, sf):
    """FN-07, FN-08: official numbers behind their label, and the law by label or number."""
    load(spark, sf, "customer")
    x = spark.sql(f"WITH {_NUMBERS} SELECT * FROM x")
    one, conflict = ids.one_official("meta")
    number = F.when(F.col("k") % 5 == 0, F.col("n")).when(F.col("k") % 5 == 4, F.col("m"))
    return x.select("k", F.array_join(ids.official_numbers("meta"), ",").alias("numbers"), one.alias("one"), conflict.alias("conflict"), ids.law_by_label(number, "law").alias("law"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Совет РЕСПУБЛИКИ КРЫМ ' || c_custkey WHEN 1 THEN 'Отдел и Ко ' || c_custkey ELSE 'Запорожской области ' || c_custkey END AS org,
 CASE c_custkey % 2 WHEN 0 THEN 'ceh-schuka-' || c_custkey ELSE 'ezh-obekt-' || c_custkey END AS slug,
 c_custkey % 7 < 4 AS system FROM customer"""
)
def fn_names(spark, sf):
    """FN-10, FN-11, FN-14: names mended, slugs of Cyrillic names, addresses no person reads."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    org = F.when(k % 3 == 0, F.concat(F.lit("Совет  РЕСПУБЛИК И КРЫМ "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit(" Отдел и  Ко "), k.cast("string"))).otherwise(F.concat(F.lit("Запорожск ой области "), k.cast("string")))
    name = F.when(k % 2 == 0, F.concat(F.lit("Цех «Щука» №"), k.cast("string"))).otherwise(F.concat(F.lit("Ёж — объект "), k.cast("string")))
    mails = ["root@x.ru", "Do-Not-Reply@x.ru", "a@example.org", "b@localhost", "roots@x.ru", "a@my.example.org", "info@x.ru"]
    mail = F.get(F.array(*[F.lit(m) for m in mails]), (k % 7).cast("int"))
    return spark.table("customer").select(k.alias("k"), ids.clean_org(org).alias("org"), ids.source_slug(name).alias("slug"), ids.is_system_email(mail).alias("system"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:05' WHEN o_orderkey % 3 = 1 THEN CASE WHEN month(o_orderdate) = 1 THEN '1999' ELSE '1998' END || strftime(o_orderdate, '-%m-%d') || ' 00:00' END AS at FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)"""
)
def fn_months(spark, sf):
    """FN-06: dates with names of months, some without a year, seen from a December."""
    load(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.get(F.array(*[F.lit(m) for m in text.MONTHS]), F.month(d) - 1)
    day = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.upper(name))
    said = F.when(k % 3 == 0, F.concat(F.lit("до "), day, F.lit(" "), F.year(d).cast("string"), F.lit(", 10:05"))).when(k % 3 == 1, day).otherwise("скоро")
    rows = spark.table("orders").where(~((F.month(d) == 2) & (F.dayofmonth(d) == 29)))
    return rows.select(k.alias("k"), F.date_format(text.parse_month_name(said, ts("1998-12-20 00:00:00")), "yyyy-MM-dd HH:mm").alias("at"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) END AS inn, CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey || '@x.ru' END AS email, (c_custkey % 2 = 0)::BIGINT + (c_custkey % 3 = 0)::BIGINT AS n FROM customer")
def fn_markers(spark, sf):
    """FN-15: KEY=value lines of texts, the first of a key."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    body = F.concat_ws("\n", F.lit("text INN=0"), F.when(k % 2 == 0, F.concat(F.lit("INN="), k.cast("string"))), F.when(k % 3 == 0, F.concat(F.lit("EMAIL= m"), k.cast("string"), F.lit("@x.ru "))), F.when(k % 2 == 0, F.lit("INN=9")), F.lit("low=1"))
    m = ids.marker_fields(body)
    return spark.table("customer").select(k.alias("k"), F.try_element_at(m, F.lit("INN")).alias("inn"), F.try_element_at(m, F.lit("EMAIL")).alias("email"), F.size(m).cast("long").alias("n"))


@query(
    f"""WITH {NOTICES} SELECT seq, sha256('{{"number":"' || tender_number || '","source":"' || source || '","title":"' || title || '","url":"http://x/' || seq || '"}}') AS fingerprint,
 substr(sha256(source || '|' || tender_number), 1, 24) AS candidate FROM n"""
)
def fn_fingerprint(spark, sf):
    """FN-13: identities of notices as hashes."""
    n = notices(spark, sf).withColumn("url", F.concat(F.lit("http://x/"), F.col("seq").cast("string"), F.lit("#part")))
    return n.select("seq", ids.fingerprint("source", "tender_number", "title", "url").alias("fingerprint"), ids.candidate_id("source", "tender_number").alias("candidate"))


_KINDS = {"картридж": ["картридж", "тонер"], "лоток": ["лоток"]}


@query(
    """SELECT p_partkey AS k, 'hp-' || p_partkey || 'n' AS models, CASE p_partkey % 3 WHEN 0 THEN 'картридж' WHEN 1 THEN 'лоток' END AS kind, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'pass' ELSE 'fail' END WHEN 1 THEN 'fail' ELSE 'unknown' END AS same,
 CASE p_partkey % 3 WHEN 0 THEN 'CE' || p_partkey || '; картридж hp-' || p_partkey || 'n; тонер hp-' || p_partkey || 'n' WHEN 1 THEN 'CE' || p_partkey || '; лоток hp-' || p_partkey || 'n' ELSE 'CE' || p_partkey END AS queries, p_partkey % 3 = 2 AS other FROM part"""
)
def fn_devices(spark, sf):
    """FN-18, CL-21, JN-07: models, kinds and search queries of technical items, and whether a product is of the item's kind."""
    load(spark, sf, "part")
    k = F.col("p_partkey")
    item = F.concat(F.when(k % 3 == 0, "Тонер для HP-").when(k % 3 == 1, "Лоток к HP-").otherwise("Стол HP-"), k.cast("string"), F.lit("N, 12 шт"))
    product = F.when(k % 2 == 0, "Картридж черный").otherwise("Бумага")
    models, kind = devices.device_models(item), devices.item_kind(item, _KINDS)
    made = devices.search_queries(kind, models, F.array(F.concat(F.lit("CE"), k.cast("string"))), {"картридж": ["тонер"]})
    return spark.table("part").select(k.alias("k"), F.array_join(models, ",").alias("models"), kind.alias("kind"), devices.same_kind(item, product, _KINDS).alias("same"), F.array_join(made, "; ").alias("queries"), devices.is_any_of(["^стол", "^шкаф"], item).alias("other"))


@query(
    r"""WITH d AS (SELECT doc_id, text, least(coalesce(nullif(instr(n, 'with'), 0), 1000000000), coalesce(nullif(instr(n, 'une'), 0), 1000000000)) - 1 AS hit
  FROM (SELECT doc_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents))
SELECT doc_id, CASE WHEN hit > 900000000 THEN substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 480) ELSE trim(regexp_replace(substr(text, greatest(0, hit - 240) + 1, hit + 240 - greatest(0, hit - 240)), '\s+', ' ', 'g')) END AS snippet FROM d"""
)
def fn_snippet(spark, sf):
    """FN-19: the part of each document on both sides of the first of two words."""
    load(spark, sf, "documents")
    return spark.table("documents").select("doc_id", text.snippet("text", F.array(F.lit("with"), F.lit("une"))).alias("snippet"))


_TYPES = {"школа": (["школа", "сош"], ["лицей"]), "больница": (["больница"], ["поликлиник"])}


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'школа' WHEN 1 THEN 'больница' ELSE 'прочее' END AS kind, c_custkey % 4 IN (0, 1) AS public, c_custkey % 4 <> 2 AS potential,
 CASE c_custkey % 3 WHEN 0 THEN 'Крым; Север' WHEN 1 THEN 'Север' ELSE 'Город ' || c_custkey END AS regions, CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_custkey ELSE 'a=' || c_custkey END AS safe FROM customer"""
)
def fn_customers(spark, sf):
    """FN-21 to FN-24: kind of an organization, public or not, placeholder or not, target regions, and texts made safe for sheets."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 4 == 0, "МБОУ СОШ № ").when(k % 4 == 1, "Детская Поликлиника ").when(k % 4 == 2, "Не указано").otherwise("ООО Школьник "), F.when(k % 4 == 2, "").otherwise(k.cast("string")))
    where = F.when(k % 3 == 0, "север и крым").when(k % 3 == 1, "на Севере").otherwise(F.concat(F.lit("Город "), k.cast("string")))
    formula = F.concat(F.when(k % 2 == 0, "=").otherwise("a="), k.cast("string"))
    return spark.table("customer").select(
        k.alias("k"), customers.org_type(name, _TYPES).alias("kind"), customers.is_public(name, ["сош", "поликлиник"], ["ооо"]).alias("public"), customers.is_potential(name).alias("potential"),
        customers.target_regions(where, {"Крым": ["крым"], "Север": ["север"]}).alias("regions"), ids.formula_safe(formula).alias("safe"),
    )


@query("SELECT p_partkey AS k, 'small' IN (split_part(p_name, ' ', 1), p_type) AS small, CASE WHEN split_part(p_name, ' ', 1) = p_brand THEN p_brand ELSE split_part(p_name, ' ', 1) || ',' || p_brand END AS all_, split_part(p_name, ' ', 1) AS first, CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN 'ring' ELSE 'small' END AS other FROM part".replace("'small' IN (split_part(p_name, ' ', 1), p_type) AS small, ", "").replace(", split_part(p_name, ' ', 1) AS first, CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN 'ring' ELSE 'small' END AS other", ", CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN 'small' ELSE '' END AS both, CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN split_part(p_name, ' ', 2) ELSE p_name END AS rest"))
def st_sets(spark, sf):
    """ST-04, ST-05: ordered union, intersection and difference of lists."""
    load(spark, sf, "part")
    words, more = F.split("p_name", " "), F.array(F.lit("small"))
    first = F.array(words[0])
    return spark.table("part").select(
        F.col("p_partkey").alias("k"), F.replace(F.array_join(F.array_distinct(F.concat(first, F.array("p_brand"), first)), ","), F.lit(",,"), F.lit(",")).alias("all_"),
        F.array_join(F.array_intersect(words, more), " ").alias("both"), F.array_join(F.array_except(words, more), " ").alias("rest"),
    )


# --- classification and evidence -------------------------------------------

_CITIES = {"Большой Порт": ["большой порт"], "Порт": ["порт"], "Озерск": ["озерск"]}


@query(
    f"""WITH {NOTICES} SELECT seq, CASE seq % 4 WHEN 0 THEN 'Большой Порт' WHEN 1 THEN 'Порт' WHEN 2 THEN 'Озерск' END AS city,
 CASE WHEN region = 'ASIA' THEN 'Восток' WHEN region = 'EUROPE' THEN 'Europe' WHEN region = 'AMERICA' THEN 'America' ELSE region END AS place FROM n"""
)
def cl_city(spark, sf):
    """CL-07, CL-24: cities, and the place to show with regions under one label."""
    n = notices(spark, sf)
    said = F.when(F.col("seq") % 4 == 0, "г. Большой  Порт").when(F.col("seq") % 4 == 1, "в порту").when(F.col("seq") % 4 == 2, "Озёрский район, не аэропорт").otherwise("аэропорт")
    rules = classify.Regions({"Asia": ("asia",), "Europe": ("europe",), "America": ("america",)})
    return n.select("seq", classify.detect_city(said, _CITIES).alias("city"), classify.display_place(rules, F.lit(""), "region", labels={"Asia": "Восток"}, plain="region").alias("place"))


@query(
    """WITH p AS (SELECT 'p' || (p_partkey % 7) AS category, lower(p_name) AS term FROM part WHERE p_partkey % 2 = 0), r AS (SELECT 'P' || (p_partkey % 7) AS category, upper(p_name) AS term FROM part)
SELECT DISTINCT category, term FROM p UNION SELECT DISTINCT category, term FROM r WHERE (lower(category), lower(term)) NOT IN (SELECT category, term FROM p)"""
)
def cl_dictionary(spark, sf):
    """CL-13: a profile's dictionary with the required terms that it lacks."""
    load(spark, sf, "part")
    p = spark.table("part")
    zero = F.lit(0)
    d = lambda category, term, rows: rows.select(category.alias("category"), zero.alias("cat_ord"), term.alias("term"), zero.alias("term_ord")).distinct()
    k = (F.col("p_partkey") % 7).cast("string")
    profile = d(F.concat(F.lit("p"), k), F.lower("p_name"), p.where("p_partkey % 2 = 0"))
    required = d(F.concat(F.lit("P"), k), F.upper("p_name"), p)
    return cases.build_dictionary(profile, profile.limit(0), required).select("category", "term")


_EVIDENCE = r"""d AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents),
e AS (SELECT doc_id, [x for x in [CASE WHEN regexp_matches(t, '[^\p{L}\p{N}_-]und') THEN 'und' END, CASE WHEN regexp_matches(t, '[^\p{L}\p{N}_-]the') THEN 'the' END] if x IS NOT NULL] AS terms,
 [x for x in [CASE WHEN regexp_matches(t, '[^\p{L}\p{N}_-]que') THEN 'que' END] if x IS NOT NULL] AS stops, CASE WHEN doc_id % 2 = 0 THEN 'East' END AS region FROM d)"""


def _evidence(spark):
    terms = spark.createDataFrame([("und", 0), ("the", 1)], "term string, term_ord int")
    stops = spark.createDataFrame([("que", 0)], "term string, ord int")
    return cases.document_evidence(spark.table("documents"), terms, stops, F.when(F.col("doc_id") % 2 == 0, "East"))


@query(f"WITH {_EVIDENCE} SELECT doc_id, array_to_string(terms, ',') AS terms, array_to_string(stops, ',') AS stop_terms, region FROM e")
def cl_evidence(spark, sf):
    """CL-15: terms, stop terms and region that each document holds."""
    load(spark, sf, "documents")
    return _evidence(spark).select("doc_id", F.array_join("terms", ",").alias("terms"), F.array_join("stop_terms", ",").alias("stop_terms"), "region")


@query(
    f"""WITH {_EVIDENCE}, p AS (SELECT doc_id // 2 AS k, doc_id, terms, stops, region FROM e),
g AS (SELECT k, list_distinct(flatten(list(terms ORDER BY doc_id))) AS terms, list_distinct(flatten(list(stops ORDER BY doc_id))) AS stops, bool_or(region IS NOT NULL) AS has FROM p GROUP BY 1),
s AS (SELECT k, CASE WHEN list_contains(terms, 'und') THEN 1 ELSE 0 END + CASE WHEN list_contains(terms, 'the') THEN 1 ELSE 0 END AS n, len(stops) AS m, has FROM g)
SELECT CAST(k AS STRING) AS k, CASE WHEN k % 3 = 0 THEN 'own' WHEN has THEN 'East' ELSE '' END AS region, CASE WHEN n + m + has::INT > 0 THEN 'enriched' ELSE 'documents_checked' END AS status, CAST(n + has::INT AS BIGINT) AS matches,
 CASE WHEN n > 0 AND has THEN 0.9 WHEN n + m + has::INT > 0 THEN 0.7 ELSE 0.1 END AS confidence FROM s"""
)
def jn_enrich(spark, sf):
    """JN-05: notices enriched by what their documents hold."""
    load(spark, sf, "documents")
    e = _evidence(spark)
    pairs = e.select(F.floor(F.col("doc_id") / 2).cast("string").alias("unique_key"), "doc_id")
    k = F.col("unique_key").cast("long")
    n = pairs.select("unique_key").distinct().select("unique_key", F.when(k % 3 == 0, "own").otherwise("").alias("region"), F.lit("t").alias("raw_text"), F.array().cast("array<string>").alias("document_matches"), F.lit("not_checked").alias("detail_status"), F.lit(0.1).alias("source_confidence"))
    out = links.enrich(n, pairs, e)
    return out.select(F.col("unique_key").alias("k"), F.coalesce("region", F.lit("")).alias("region"), F.col("detail_status").alias("status"), F.size("document_matches").cast("long").alias("matches"), F.col("source_confidence").alias("confidence"))


@query(f"WITH {NOTICES} SELECT seq, CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'known' ELSE 'filtered' END AS why, CASE WHEN seq % 3 = 0 THEN '44-ФЗ' WHEN seq % 3 = 1 THEN '223-ФЗ' END AS law FROM n WHERE region IN ('ASIA', 'EUROPE') OR (seq % 3 = 0 AND seq % 2 = 0)")
def cl_regional(spark, sf):
    """CL-25: rows of a target region, or without a region on pages that were filtered by region."""
    n = notices(spark, sf).withColumns({"page_id": F.col("seq") % 3, "printed": F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("region"))})
    p = spark.createDataFrame([(0, True, "44-ФЗ"), (1, False, "223-ФЗ")], "page_id long, region_filtered boolean, law string")
    target = F.when(F.col("region").isin("ASIA", "EUROPE"), F.col("region"))
    out = pages.keep_regional(n, p, target, "printed")
    return out.select("seq", F.when(F.col("region").isin("ASIA", "EUROPE"), "known").otherwise("filtered").alias("why"), F.col("procurement_law").alias("law"))


@query("SELECT DISTINCT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS line_id, 'n' || (l_partkey % 50) AS part_number FROM lineitem WHERE l_partkey % 50 < 40 AND l_linenumber % 2 = 0")
def cl_oem(spark, sf):
    """CL-23: reference numbers of an item's model and kind."""
    load(spark, sf, "lineitem")
    items = spark.table("lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("line_id"), F.when(F.col("l_linenumber") % 2 == 0, "тонер").otherwise("лоток").alias("kind"), F.concat(F.lit("Тонер MX-"), (F.col("l_partkey") % 50).cast("string"), F.lit("A")).alias("name"))
    refs = spark.range(40).selectExpr("'тонер' as kind", "concat('MX-', id, 'a') as model", "concat('n', id) as part_number", "0 as n")
    refs = refs.union(refs.selectExpr("kind", "model", "'later'", "1"))
    return links.oem_references(items, refs, devices.device_models("name"))


# --- joins, reports, register ----------------------------------------------


@query(f"WITH {NOTICES} SELECT seq FROM n WHERE source <> 'copy' AND (seq % 3 = 0 OR seq % 5 = 0) ORDER BY price DESC, seq LIMIT 100")
def jn_detail(spark, sf):
    """JN-08: the notices worth a detail request, a hundred at most."""
    n = notices(spark, sf).withColumns({"category": F.when(F.col("source") != "copy", "x").otherwise(""), "worth": F.col("price"), "price": F.when(F.col("seq") % 3 != 0, F.col("price")), "region": F.when(F.col("seq") % 5 != 0, F.col("region")).otherwise("")})
    return links.detail_candidates(n, 100, [F.desc("worth"), F.col("seq")]).select("seq")


@query(f"WITH {BATCHES}, r AS (SELECT unique_key, max(seq) AS seq, min(seq) AS first FROM e GROUP BY 1) SELECT unique_key, seq FROM r WHERE CAST(unique_key AS BIGINT) % 3 <> 0 ORDER BY first, unique_key LIMIT 50")
def jn_pending(spark, sf):
    """JN-10: registered rows that wait to be sent, the oldest fifty."""
    e = batches(spark, sf).groupBy("unique_key").agg(F.max("seq").alias("seq"), F.min("seq").alias("first"))
    box = e.select("unique_key", F.col("first").alias("created_at"), F.when(F.col("unique_key").cast("long") % 3 == 0, "now").alias("sent_at"))
    return register.pending(box, e.select("unique_key", "seq")).select("unique_key", "seq")


@query(
    """WITH r AS (SELECT l_orderkey AS line_id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS supplier FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
k AS (SELECT line_id, max(n) AS last, min(CASE WHEN supplier = 'A' THEN n END) AS a, min(CASE WHEN supplier = '' THEN n END) AS e FROM r GROUP BY 1),
h AS (SELECT *, coalesce(a, e) AS hit FROM k WHERE line_id % 2 = 0)
SELECT r.line_id, r.n, CASE WHEN r.n = h.hit THEN 'A' ELSE r.supplier END AS supplier, CASE WHEN r.n = h.hit THEN 'sent' ELSE 'new' END AS status FROM r LEFT JOIN h ON h.line_id = r.line_id
UNION ALL SELECT line_id, last + 1, 'A', 'sent' FROM h WHERE hit IS NULL"""
)
def jn_assign(spark, sf):
    """JN-13: suppliers assigned to lines of requests."""
    load(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    req = dealt(spark.table("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").distinct().select(F.col("l_orderkey").alias("line_id"), n.alias("n"), F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("").alias("supplier"), F.lit("new").alias("status"))
    a = req.where("line_id % 2 = 0").select("line_id", F.lit("A").alias("supplier"), F.lit("sent").alias("status")).distinct()
    return customers.assign_supplier(a, req)


@query(
    """SELECT count(*) FILTER (WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0) AS eligible, count(*) FILTER (WHERE c_custkey % 3 = 0) AS prepared, count(*) FILTER (WHERE c_custkey % 7 = 0) AS errors, count(*) FILTER (WHERE c_custkey % 5 = 1) AS needs_review,
 count(*) FILTER (WHERE c_custkey % 5 = 2) AS suppressed, count(*) FILTER (WHERE c_custkey % 5 > 2) AS excluded, count(*) FILTER (WHERE c_custkey % 11 = 0) AS consented FROM customer"""
)
def ag_queue(spark, sf):
    """AG-05: counts of the queue."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    d = F.when(k % 5 == 0, "approved").when(k % 5 == 1, "needs_review").when(k % 5 == 2, "suppressed").otherwise("excluded")
    q = spark.table("customer").select(d.alias("decision"), F.when(k % 3 == 0, "prepared").otherwise("new").alias("stage"), (k % 2 == 0).alias("approved"), F.when(k % 11 == 0, "yes").otherwise("").alias("consent"), F.when(k % 7 == 0, "x").otherwise("").alias("error"))
    return customers.queue_counts(q)


@query("WITH a AS (SELECT event_type AS e, epoch(TIMESTAMP '2024-02-01 00:00:00' - date_trunc('second', max(ts))) / 3600.0 AS h FROM events WHERE event_type <> 'purchase' GROUP BY 1), p AS (SELECT e, CASE WHEN e = 'view' THEN 24 WHEN e = 'click' THEN 1000 ELSE NULL END AS m FROM a) SELECT array_to_string(list_concat(CASE WHEN (SELECT max(h) FROM a WHERE e = 'view') > 24 THEN ['view'] ELSE [] END, ['purchase']), ',') AS problems, false AS healthy")
def ag_health(spark, sf):
    """AG-08: kinds of events that are missing or late."""
    load(spark, sf, "events")
    ages = report.latest_ages(spark.table("events").where("event_type <> 'purchase'"), ts("2024-02-01 00:00:00"))
    return report.health_verdict(ages, {"view": 24.0, "click": 1000.0, "purchase": 1000.0}).select(F.array_join("problems", ",").alias("problems"), "healthy")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS with_contact, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 0) AS enriched, count(*) FILTER (WHERE c_custkey % 4 = 1) AS errors FROM customer")
def ag_coverage(spark, sf):
    """AG-09: how many organizations have a contact."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    rows = spark.table("customer").select(F.when(k % 3 != 0, "a@x.ru").otherwise(" ".strip()).alias("email"), F.when(k % 4 == 0, "ok").when(k % 4 == 1, "error").otherwise("empty").alias("status"))
    return report.coverage(rows)


@query(
    f"""WITH {NOTICES}, o AS (SELECT seq, row_number() OVER (ORDER BY CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END, CASE WHEN seq % 7 = 0 THEN NULL ELSE deadline END, lower(title), seq) AS by_deadline, row_number() OVER (ORDER BY discovered_at DESC, price DESC, seq) AS by_seen FROM n)
SELECT seq, by_deadline, by_seen FROM o WHERE by_deadline <= 500 OR by_seen <= 500"""
)
def wn_register_order(spark, sf):
    """WN-10: the register in the order of deadlines, and of what was seen last; the first 500 of each."""
    from pyspark.sql import Window

    n = notices(spark, sf).withColumn("deadline", F.when(F.col("seq") % 7 != 0, F.col("deadline")))
    first = report.deadline_order(n, 500).select("seq")
    seen = report.seen_order(n, 500, seen="discovered_at", discovered="price", tie="seq").select("seq")
    # both orders are of bounded length; places of what stands in either come from counting over the whole
    both = first.union(seen).distinct().join(n, "seq")
    cut = report.places(n, both, [F.col("deadline").isNull().cast("int"), F.col("deadline"), text.normalize("title"), F.col("seq")], "by_deadline")
    return cut.join(report.places(n, both, [-F.unix_timestamp("discovered_at"), -F.col("price"), F.col("seq")], "by_seen"), "seq")


@query(
    """WITH r AS (SELECT c_custkey AS key, 'u' || c_custkey AS url FROM customer), c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN 'old' ELSE 'u' || c_custkey END AS url, CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'empty' END AS st, CASE WHEN c_custkey % 5 = 0 THEN 200 ELSE 30 END AS hours FROM customer WHERE c_custkey % 4 <> 0),
j AS (SELECT r.key, CASE WHEN c.key IS NULL OR c.url <> r.url THEN 0 WHEN st = 'error' THEN 1 WHEN st = 'empty' THEN 2 ELSE 3 END AS reason, c.key IS NULL OR c.url <> r.url OR hours >= CASE WHEN st = 'ok' THEN 168 ELSE 24 END AS due FROM r LEFT JOIN c ON r.key = c.key)
SELECT key, CAST(reason AS BIGINT) AS reason FROM j WHERE due ORDER BY reason, key LIMIT 400"""
)
def up_due(spark, sf):
    """UP-09: keys to refresh within a budget of 400."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    rows = spark.table("customer").select(k.alias("key"), F.concat(F.lit("u"), k.cast("string")).alias("url"))
    now = ts("2026-01-31 00:00:00")
    cache = rows.where("key % 4 <> 0").select("key", F.when(F.col("key") % 7 == 0, "old").otherwise(F.col("url")).alias("url"), F.when(F.col("key") % 3 == 0, "ok").when(F.col("key") % 3 == 1, "error").otherwise("empty").alias("status"), F.when(F.col("key") % 5 == 0, now - F.expr("interval 200 hours")).otherwise(now - F.expr("interval 30 hours")).alias("checked_at"), F.lit(1).alias("version"))
    return freshness.due(rows, cache, now, 400).select("key", F.col("reason").cast("long").alias("reason"))


@query(
    f"""WITH {BATCHES}, h AS (SELECT source || '/' || d AS stamp, max(seq) AS n FROM e WHERE d < 10 GROUP BY 1), r AS (SELECT source || '/' || d AS stamp, min(seq) AS n FROM e WHERE d >= 8 GROUP BY 1)
SELECT 'run' AS kind, stamp, n FROM h UNION ALL SELECT 'run', stamp, n FROM r WHERE stamp NOT IN (SELECT stamp FROM h) UNION ALL SELECT 'baseline', source, CAST(CASE WHEN source = 'view' THEN 3 ELSE min(d) END AS BIGINT) FROM e GROUP BY source"""
)
def up_runs(spark, sf):
    """UP-11: runs appended once per stamp, and the pinned baseline of each collection."""
    e = batches(spark, sf).withColumn("stamp", F.concat_ws("/", "source", F.col("d").cast("string")))
    history = e.where("d < 10").groupBy("stamp").agg(F.max("seq").alias("n"))
    runs = links.append_once(history, e.where("d >= 8").select("stamp", F.col("seq").alias("n")), ["stamp"], ["n"])
    pinned = spark.createDataFrame([("view", 3)], "collection string, stamp int")
    base = links.pin_baselines(pinned, e.select(F.col("source").alias("collection"), F.col("d").alias("stamp")))
    return runs.select(F.lit("run").alias("kind"), "stamp", "n").union(base.select(F.lit("baseline"), "collection", F.col("stamp").cast("long")))


@query("SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS place, CAST(NULL AS STRING) AS note FROM customer")
def up_migrate(spark, sf):
    """UP-12: a table of old names under the current ones."""
    load(spark, sf, "customer")
    old = spark.table("customer").select(F.col("c_custkey").cast("string").alias("Код"), F.col("c_name").alias(" Имя "), F.col("c_nationkey").cast("string").alias("Регион"), F.lit(1).alias("лишнее"))
    old = old.withColumnRenamed(" Имя ", "Имя")
    return register.migrate(old, {"id": ["код"], "name": ["имя", "название"], "place": ["регион"]}, {"id": "long", "name": "string", "place": "long", "note": "string"})


# --- cases -----------------------------------------------------------------


@query(
    f"""WITH {_CASES}, {_PICK} SELECT i.case_id, i.line_id, CASE WHEN p.unit_cost_gross IS NULL THEN 'НЕ НАЙДЕН' END AS product_name, coalesce(p.compliance_status, 'not_found') AS compliance_status, CAST(p.unit_cost_gross AS DOUBLE) AS unit_cost_gross,
 CAST(round(i.quantity * p.unit_cost_gross, 2) AS DOUBLE) AS total_cost_gross, CASE WHEN p.unit_cost_gross IS NULL THEN 'Требуется поиск товара' END AS notes FROM items i LEFT JOIN pick p ON p.case_id = i.case_id AND p.line_id = i.line_id"""
)
def ec_positions(spark, sf):
    """EC-06: the positions of every case with their offer."""
    _, lines, _ = _case_tables(spark, sf)
    p = economics.summary_positions(lines)
    return p.select("case_id", "line_id", "product_name", "compliance_status", *[F.col(c).cast("double").alias(c) for c in ("unit_cost_gross", "total_cost_gross")], "notes")


@query(f"WITH {_CASES}, {_PICK} SELECT o.case_id, o.line_id, o.seq, row_number() OVER (PARTITION BY o.case_id, o.line_id ORDER BY o.unit_cost_gross, o.seq) AS rank, coalesce(o.seq = p.seq, false) AS chosen FROM off o LEFT JOIN pick p ON p.case_id = o.case_id AND p.line_id = o.line_id")
def ec_all_offers(spark, sf):
    """EC-06: all offers of every case in the order of a report."""
    load(spark, sf, "lineitem", "part", "orders")
    return economics.summary_offers(spark.sql(f"WITH {_CASES} SELECT * FROM off")).select("case_id", "line_id", "seq", F.col("rank").cast("long").alias("rank"), "chosen")


@query(
    f"""WITH {_CASES}, {_PICK}, {_TOTALS}, l AS (SELECT case_id, start_price, 0 AS place, target AS threshold FROM price UNION ALL SELECT case_id, start_price, 1, viable FROM price UNION ALL SELECT case_id, start_price, 2, floor_ FROM price)
SELECT case_id, place, CASE place WHEN 0 THEN 'Цель 30%' WHEN 1 THEN 'Рабочий порог 15%' ELSE 'Жесткий порог 12%' END AS level, CAST(threshold AS DOUBLE) AS threshold, CAST(start_price - threshold AS DOUBLE) AS reduction FROM l"""
)
def ec_levels(spark, sf):
    """EC-06: the price levels of every case."""
    c, lines, expenses = _case_tables(spark, sf)
    t = economics.case_totals(c.join(lines.select("case_id").distinct(), "case_id", "left_semi"), lines, expenses)
    return economics.summary_thresholds(t).select("case_id", "place", "level", F.col("threshold").cast("double").alias("threshold"), F.col("reduction").cast("double").alias("reduction"))


@query(
    """WITH c AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(18, 2)) END AS p, o_orderkey % 3 = 0 AS has, CASE WHEN o_orderkey % 5 = 0 THEN lpad(CAST(o_orderkey AS STRING), 11, '1') END AS num FROM orders),
i AS (SELECT case_id, count(*) AS n, sum(q) AS q FROM (SELECT o_orderkey AS case_id, -1 AS q FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 <> 0) GROUP BY 1)
SELECT c.case_id, CAST(coalesce(p, CASE WHEN c.case_id % 7 <> 0 THEN 100.5 END) AS DOUBLE) AS start_price, num AS tender_number, coalesce(n, 0) AS items, CAST(coalesce(q, 0) AS BIGINT) AS q FROM c LEFT JOIN i ON i.case_id = c.case_id"""
)
def ec_promote(spark, sf):
    """EC-07: items from candidates for cases without any, start prices and numbers found."""
    load(spark, sf, "orders", "lineitem")
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, F.lpad(k.cast("string"), 11, "1")).otherwise(F.concat(F.lit("Case "), k.cast("string")))
    c = spark.table("orders").select(k.alias("case_id"), F.when(k % 2 == 0, F.col("o_totalprice")).cast("decimal(18,2)").alias("start_price"), title.alias("title"), F.lit("").alias("tender_number"))
    have = c.where("case_id % 3 = 0").select("case_id", F.lit(-1).cast("long").alias("q"))
    found = spark.table("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("q"))
    prices = c.where("case_id % 7 <> 0").select("case_id", F.explode(F.array(F.struct(F.lit("100.5").alias("value"), F.lit(1).alias("seq")), F.struct(F.lit("7").alias("value"), F.lit(2).alias("seq")))).alias("p")).select("case_id", "p.*")
    items, out = cases.promote_items(c, have, found, prices)
    n = items.groupBy("case_id").agg(F.count(F.lit(1)).alias("items"), F.sum("q").alias("q"))
    return out.join(n, "case_id", "left").select("case_id", F.col("start_price").cast("double").alias("start_price"), "tender_number", F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.coalesce("q", F.lit(0)).cast("long").alias("q"))


@query(
    """SELECT doc_id AS case_id, 'get contract' AS question FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'which installation' FROM documents WHERE contains(lower(text), 'with') AND contains(lower(text), 'the')
UNION ALL SELECT doc_id, 'when paid' FROM documents WHERE NOT regexp_matches(text, '[0-9]{3}') UNION ALL SELECT doc_id, 'when delivered' FROM documents"""
)
def cl_questions(spark, sf):
    """CL-19: questions from findings and from what a case's documents don't say."""
    load(spark, sf, "documents")
    d = spark.table("documents")
    s = d.select(F.col("doc_id").alias("case_id"), F.lit("s").alias("source"), F.lit("l").alias("locator"), "text")
    c = d.select(F.col("doc_id").alias("case_id"), F.lit("44-ФЗ").alias("law"))
    have = c.where("case_id % 3 = 0").select("case_id", F.lit("contract").alias("doc_type"))
    found = cases.completeness(c, have, ["contract"]).select("case_id", "code").union(cases.content_findings(s, [("installation", "risk", ["the", "with"])], {"none": ["\x00"]}).select("case_id", "code"))
    said = cases.extract_metadata(s, {"payment": ["([0-9]{3})"]}).select("case_id", "field")
    return cases.questions(found, said, {"missing_*": "get {subject}", "installation": "which installation"}, {"payment": "when paid", "delivery": "when delivered"}, c)


#: Items as several documents give them, few lines and quantities a case; a third of the names hold a code, a fifth of the items specs.
_STATED = """stated AS (SELECT l_orderkey AS case_id, l_partkey % 3 AS line_id, 'q' || (l_linenumber % 2) AS quantity, p_name AS base, CASE WHEN l_partkey % 4 = 0 THEN '28.13.11.1' || (10 + l_suppkey % 2) END AS code, l_suppkey % 2 AS source,
 CASE WHEN l_quantity > 40 THEN 'x' ELSE '' END AS specs, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS seq FROM lineitem JOIN part ON p_partkey = l_partkey)"""

#: The longest block of two names that is equal in both, the first in both of equal ones, then those before and after it; twice their sum over both lengths is the ratio.
#: Then items are replayed one by one, `kept` holding those that stand.
_REPLAYED = f"""WITH RECURSIVE {_STATED},
i AS (SELECT *, row_number() OVER (PARTITION BY case_id, quantity ORDER BY seq) AS rn FROM (SELECT DISTINCT * FROM stated)),
p AS (SELECT DISTINCT x.base AS a, y.base AS b FROM i x JOIN i y ON x.case_id = y.case_id AND x.quantity = y.quantity AND x.line_id = y.line_id AND x.seq < y.seq),
seg AS (SELECT a, b, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi, 0 AS m FROM p
 UNION ALL
 SELECT a, b, CASE side WHEN 0 THEN alo ELSE best.k - best.i END, CASE side WHEN 0 THEN -best.i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE best.k - best.j END, CASE side WHEN 0 THEN -best.j ELSE bhi END, CASE side WHEN 0 THEN best.k ELSE 0 END
 FROM (SELECT *, list_reverse_sort(flatten(list_transform(range(alo, ahi), lambda i: flatten(list_transform(range(blo, bhi), lambda j: list_transform(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k)), lambda k: {{'k': k, 'i': -i, 'j': -j}}))))))[1] AS best
  FROM seg WHERE alo < ahi AND blo < bhi), (VALUES (0), (1)) s(side) WHERE best IS NOT NULL),
ratio AS (SELECT a, b, 2.0 * sum(m) / (length(a) + length(b)) AS r FROM seg GROUP BY a, b),
st AS (
 SELECT case_id, quantity, rn, [{{'line': line_id, 'base': base, 'code': code, 'source': source, 'specs': specs, 'seq': seq, 'differ': false}}] AS kept FROM i WHERE rn = 1
 UNION ALL
 SELECT case_id, quantity, rn, CASE
   WHEN old IS NULL AND len(list_filter(kept, lambda x: x.base = n.base AND x.code IS NOT DISTINCT FROM n.code AND x.source = n.source)) > 0 THEN kept
   WHEN old IS NULL THEN list_append(kept, n)
   ELSE list_transform(kept, lambda x: CASE WHEN x.line <> n.line THEN x ELSE {{'line': x.line, 'base': CASE WHEN swap THEN n.base ELSE x.base END, 'code': CASE WHEN swap THEN n.code ELSE x.code END, 'source': CASE WHEN swap THEN n.source ELSE x.source END,
     'specs': CASE WHEN swap THEN n.specs ELSE x.specs END, 'seq': CASE WHEN swap THEN n.seq ELSE x.seq END, 'differ': x.differ OR coalesce(old.code <> n.code, false) OR r < 0.8}} END) END
 FROM (SELECT z.*, r, n.specs <> '' AND old.specs = '' AS swap FROM (
   SELECT st.case_id, st.quantity, i.rn, st.kept, {{'line': line_id, 'base': base, 'code': code, 'source': source, 'specs': specs, 'seq': seq, 'differ': false}} AS n, list_filter(st.kept, lambda x: x.line = i.line_id)[1] AS old
   FROM st JOIN i ON i.case_id = st.case_id AND i.quantity = st.quantity AND i.rn = st.rn + 1) z LEFT JOIN ratio ON a = old.base AND b = n.base)),
done AS (SELECT case_id, quantity, unnest(arg_max(kept, rn)) AS x FROM st GROUP BY 1, 2)"""


def _stated_items(spark, sf):
    load(spark, sf, "lineitem", "part")
    i = spark.sql(f"WITH {_STATED} SELECT DISTINCT * FROM stated")
    return i.select("case_id", "line_id", "quantity", F.concat_ws(" ", "base", "code").alias("name"), "source", F.col("specs").alias("required_specs"), "seq")


@query(f"{_REPLAYED} SELECT case_id, quantity, x.line AS line_id, concat_ws(' ', x.base, x.code) AS name, x.source AS source, x.seq AS seq FROM done")
def dd_items_merged(spark, sf):
    """DD-09: items of several documents as one, without those that repeat a name, quantity and source."""
    return cases.reconcile_items(_stated_items(spark, sf))[0].select("case_id", "quantity", "line_id", "name", "source", "seq")


@query(f"{_REPLAYED} SELECT case_id, quantity, x.line AS line_id FROM done WHERE x.differ")
def dd_items(spark, sf):
    """DD-09: lines whose names or codes differ across documents."""
    return cases.reconcile_items(_stated_items(spark, sf))[1].select("case_id", "quantity", "line_id")


@query("SELECT DISTINCT o.l_orderkey AS case_id, CAST(o.l_linenumber AS STRING) AS line_id, p_name AS name, CAST(CAST(o.l_quantity AS INT) AS STRING) AS quantity, 'Размер: ' || p_size || '; Цвет: белый' AS required_specs FROM lineitem o JOIN part ON p_partkey = o.l_partkey")
def cl_table(spark, sf):
    """CL-20, WN-04: items of table rows, whose second row carries on the first one's characteristics."""
    load(spark, sf, "lineitem", "part")
    i = spark.table("lineitem").join(spark.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    s = lambda c: F.col(c).cast("string")
    # parts of one name and size give equal items, of which the SQL has one
    i = i.withColumn("l_quantity", F.col("l_quantity").cast("int")).groupBy("l_orderkey", "l_linenumber", "p_name", "p_size", "l_quantity").agg(F.min("l_partkey").alias("l_partkey"))
    head = F.array(F.concat(s("l_linenumber"), F.lit(".")), F.col("p_name"), F.lit("x"), F.lit("Размер"), s("p_size"), F.lit("шт"), s("l_quantity"))
    more = F.array(F.lit(""), F.lit(""), F.lit(""), F.lit("Цвет"), F.lit("белый"), F.lit(""), F.lit(""))
    rows = i.select(F.col("l_orderkey").alias("case_id"), F.lit("t").alias("table"), F.posexplode(F.array(head, more)).alias("k", "cells"), "l_linenumber", "l_partkey", "l_quantity").select("case_id", "table", F.struct("l_linenumber", "l_partkey", "l_quantity", "k").alias("row"), "cells")
    return cases.table_items(rows).select("case_id", "line_id", "name", "quantity", "required_specs")


# --- sources and sinks -----------------------------------------------------

_BODY = "c AS (SELECT o_orderkey AS k, o_orderkey % 40 AS page, c_name AS who, o_totalprice AS price FROM orders JOIN customer ON c_custkey = o_custkey)"


def _cards(spark, sf):
    """Forty pages and more, each with a card per order; every fifth card has no link, every seventh no number."""
    load(spark, sf, "orders", "customer")
    c = spark.sql(f"WITH {_BODY} SELECT * FROM c")
    title = F.concat(F.lit("Поставка"), F.when(F.col("k") % 7 != 0, F.concat(F.lit(" № "), F.col("k").cast("string"))).otherwise(""))
    head = F.when(F.col("k") % 5 != 0, F.concat(F.lit("<a href='/t/"), F.col("k").cast("string"), F.lit("?x=1#y'>"), title, F.lit("</a>"))).otherwise(F.concat(F.lit("<a>"), title, F.lit("</a>")))
    card = F.concat(F.lit("<div class='card x'>"), head, F.lit("<b class='who'>"), F.col("who"), F.lit("</b><i class='sum'>"), F.format_string("%.2f", "price"), F.lit(" руб.</i></div>"))
    return c.groupBy("page", F.floor(F.col("k") / 2000).alias("part")).agg(F.concat(F.lit("<html><script>var a='<a href=/no>';</script>"), F.array_join(F.array_sort(F.collect_list(card)), ""), F.lit("<a href='http://other.org/q'>q</a><a href='mailto:x'>m</a></html>")).alias("html")).select((F.col("page") + F.col("part") * 40).alias("page_id"), F.concat(F.lit("http://h"), "page", F.lit(".example.com/list")).alias("url"), "html")


@query(
    f"""WITH {_BODY} SELECT 'Поставка' || CASE WHEN k % 7 <> 0 THEN ' № ' || k ELSE '' END AS title, CASE WHEN k % 5 <> 0 THEN 'http://h' || page || '.example.com/t/' || k || '?x=1#y' ELSE '' END AS url, CASE WHEN k % 7 <> 0 THEN CAST(k AS STRING) END AS tender_number, who AS customer, round(price, 2) AS price
FROM c WHERE k % 5 <> 0 OR k % 7 <> 0"""
)
def src_cards(spark, sf):
    """SRC-04: cards of pages that were made from all orders, read back."""
    rows = pages.extract_listings(_cards(spark, sf), pages.ListingRules(".card", "a", ".who", ".sum"))
    return rows.select("title", "url", "tender_number", "customer", F.round("price", 2).alias("price"))


@query(
    f"""WITH {_BODY}, p AS (SELECT DISTINCT page + (k // 2000) * 40 AS page_id FROM c)
SELECT page + (k // 2000) * 40 AS page_id, 'http://h' || page || '.example.com/t/' || k || '?x=1#y' AS link, 'http://h' || page || '.example.com/documents/' || k || '?x=1#y' AS documents FROM c WHERE k % 5 <> 0"""
)
def src_anchors(spark, sf):
    """SRC-14: links of these pages within a domain and path, and the addresses of their documents."""
    rows = pages.extract_links(_cards(spark, sf), hosts=["example.com"], path="^/t/")
    return rows.select("page_id", "link", pages.documents_url("link", "/t/", "/documents/").alias("documents"))


@query("SELECT c_custkey AS page_id, c_name AS customer, CASE WHEN c_custkey % 3 = 0 THEN 'second ' || c_custkey ELSE 'first ' || c_custkey END AS place, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS STRING) END AS phone FROM customer")
def src_labels(spark, sf):
    """SRC-06: values beside their labels on pages."""
    load(spark, sf, "customer")
    k, s = F.col("c_custkey"), lambda c: F.col(c).cast("string")
    row = lambda a, b: F.concat(F.lit("<tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr>"))
    html = F.concat(F.lit("<table>"), row(F.lit("Заказчик:"), F.col("c_name")), row(F.lit("Место"), F.when(k % 3 == 0, "информация отсутствует").otherwise(F.concat(F.lit("first "), s("c_custkey")))), row(F.lit("Адрес"), F.concat(F.lit("second "), s("c_custkey"))), F.lit("</table><dl><dt>Телефон</dt><dd>"), F.when(k % 4 != 0, s("c_nationkey")).otherwise(""), F.lit("</dd></dl>"))
    # a file of few bytes makes many pages: its rows are dealt to all tasks before pages are made of them
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = spark.table("customer").select("c_custkey", "c_name", "c_nationkey").repartition(tasks, "c_custkey").select(k.alias("page_id"), F.lit("http://x").alias("url"), html.alias("html"))
    return pages.extract_label_values(p, {"customer": ["Заказчик"], "place": ["Место", "Адрес"], "phone": ["Телефон"]}).select("page_id", "customer", "place", "phone")


@query(
    f"""WITH {NOTICES} SELECT 'rss:' || tender_number AS unique_key, title, 'http://x/' || seq || '?a=1&b=2' AS url, customer, region, round(price, 2) AS price, strftime(deadline, '%Y-%m-%d') AS deadline, strftime(discovered_at, '%Y-%m-%d %H:%M') AS published_at FROM n WHERE source <> 'copy'"""
)
def src_rss(spark, sf):
    """SRC-02: items of RSS feeds with labelled descriptions."""
    n = notices(spark, sf).where("source <> 'copy'")
    said = F.concat(F.lit("<p>Номер: "), "tender_number", F.lit("</p><br/>Организатор: "), "customer", F.lit("<br>Регион: "), "region", F.lit("<br>Цена: "), F.format_string("%.2f", "price"), F.lit(" руб.<br>Окончание: "), F.date_format("deadline", "dd.MM.yyyy"))
    link = F.concat(F.lit("http://x/"), F.col("seq").cast("string"), F.lit("?a=1&amp;b=2"))
    item = F.concat(F.lit("<item><title><![CDATA["), "title", F.lit("]]></title>"), F.when(F.col("seq") % 4 == 0, F.concat(F.lit("<guid>"), link, F.lit("</guid>"))).otherwise(F.concat(F.lit("<link>"), link, F.lit("</link>"))), F.lit("<description>"), F.replace(F.replace(said, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</description><pubDate>Mon, "), F.date_format("discovered_at", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    # the number of feeds grows with the notices, not their length
    feeds = n.groupBy("region", F.col("seq") % 30, F.expr("seq div 80000")).agg(F.concat(F.lit("<rss><channel><title>all</title>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml")).select(F.lit("f").alias("file"), "xml")
    labels = {"tender_number": ["Номер"], "customer": ["Организатор", "Заказчик"], "region": ["Регион поставки", "Регион"], "price": ["Цена"], "deadline": ["Окончание"]}
    out, _ = payloads.read_rss(feeds, labels)
    return out.select("unique_key", "title", "url", F.coalesce("customer", F.lit("")).alias("customer"), "region", F.round("price", 2).alias("price"), F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"))


@query(
    """SELECT 'soap:' || o_orderkey AS unique_key, CASE WHEN o_orderkey % 3 = 0 THEN 'lot ' || o_orderkey ELSE 'all ' || o_orderkey END AS title, CASE WHEN o_orderkey % 2 = 0 THEN round(sum(l_extendedprice), 2) END AS price, count(*) AS lots, c_name AS customer
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey, c_name"""
)
def src_procedures(spark, sf):
    """SRC-02: procedures of SOAP answers, their lots summed where the currency is the rouble."""
    load(spark, sf, "orders", "lineitem", "customer")
    k = F.col("o_orderkey")
    lots = spark.table("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("<s:lot><s:subject>lot "), F.col("l_orderkey").cast("string"), F.lit("</s:subject><s:startPrice>"), F.format_string("%.2f", "l_extendedprice"), F.lit("</s:startPrice></s:lot>"))), "").alias("lots"))
    o = spark.table("orders").join(lots, k == F.col("l_orderkey")).join(spark.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    number = F.concat(F.when(k % 4 == 0, "<s:remoteId>").otherwise("<s:registryNumber>"), k.cast("string"), F.when(k % 4 == 0, "</s:remoteId>").otherwise("</s:registryNumber>"))
    one = F.concat(F.lit("<s:procedure>"), F.when(k % 3 != 0, F.concat(F.lit("<s:title>all "), k.cast("string"), F.lit("</s:title>"))).otherwise(""), number, F.lit("<s:currency>"), F.when(k % 2 == 0, "RUB").otherwise("USD"), F.lit("</s:currency><s:organizer><s:fullName>"), F.col("c_name"), F.lit("</s:fullName></s:organizer><s:lots>"), "lots", F.lit("</s:lots></s:procedure>"))
    # the number of answers grows with the orders, not their length
    answers = o.groupBy(F.concat_ws("/", F.pmod(k, F.lit(64)), F.expr("o_orderkey div 20000")).alias("file")).agg(F.concat(F.lit('<e:Envelope xmlns:e="u" xmlns:s="v"><e:Body>'), F.array_join(F.collect_list(one), ""), F.lit("</e:Body></e:Envelope>")).alias("xml"))
    out, _ = payloads.read_procedures(answers)
    return out.select("unique_key", "title", F.round("price", 2).alias("price"), F.col("lots").cast("long").alias("lots"), "customer")


@query(f"WITH {NOTICES} SELECT 'json:' || seq AS unique_key, title, CASE WHEN seq % 5 = 0 THEN NULL ELSE nullif(customer, '') END AS customer, CASE WHEN seq % 5 = 0 THEN NULL ELSE round(price, 2) END AS price FROM n")
def src_json_xml(spark, sf):
    """SRC-03: notices of JSON payloads whose rows carry XML; XML that declares entities is not read."""
    n = notices(spark, sf)
    xml = F.concat(F.when(F.col("seq") % 5 == 0, "<!DOCTYPE x>").otherwise(""), F.lit("<d><who>"), "customer", F.lit("</who><sum>"), F.format_string("%.2f", "price"), F.lit("</sum></d>"))
    item = F.struct(F.col("seq").alias("id"), F.col("title").alias("name"), xml.alias("body"))
    body = n.groupBy("source", "region", F.col("seq") % 50).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))
    rules = payloads.JsonRules("items array<struct<id: long, name: string, body: string>>", "items", {"title": ["name"], "tender_number": ["id"]}, "json", xml="body", tags={"customer": ["who"], "price": ["sum"]})
    return payloads.read_notice_json(body.select("payload"), rules).select("unique_key", "title", "customer", F.round("price", 2).alias("price"))


_XML = "'<n><num>' || doc_id || '</num><t>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</t></n>'"


@query(
    f"""WITH m AS (SELECT doc_id, doc_id // 50 AS g, {_XML} AS xml FROM documents)
SELECT doc_id::VARCHAR || '.xml' AS member, md5(xml) AS digest, NULL AS error, CASE g WHEN 2 THEN 'retried' ELSE 'landed' END AS how FROM m WHERE g <> 1 UNION ALL
SELECT 'a1.zip', NULL, 'too_large', 'rejected'"""
)
def src_zips(spark, sf):
    """SRC-07: documents as members of zip files, fifty to a file, that land in eight folders in two passes, a few newest files of a folder at a time.

    One file has more members than allowed, and one lands broken and is read again when it is mended.
    """
    load(spark, sf, "documents")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<n><num>"), F.col("doc_id").cast("string"), F.lit("</num><t>"), escaped, F.lit("</t></n>"))
    rows = spark.table("documents").select(F.expr("doc_id div 50").alias("g"), F.concat(F.col("doc_id").cast("string"), F.lit(".xml")).alias("member"), xml.alias("content"))
    more = spark.range(100).select(F.lit(1).cast("long").alias("g"), F.concat(F.lit("more"), F.col("id").cast("string"), F.lit(".xml")).alias("member"), F.lit("<n/>").alias("content"))
    rows = rows.union(more).withColumn("archive", F.concat(F.lit("a"), F.col("g").cast("string")))
    folders = [str(k) for k in range(8)]
    dealt = rows.withColumn("archive", F.concat_ws("/", F.pmod(F.expr("g div 2"), F.lit(8)).cast("string"), "archive"))
    landing, late, out, rejects, marks = (shared_folder(spark, name) for name in ("landing", "mended", "members", "rejects", "marks"))
    for k in (0, 1):
        sinks.write_archives(dealt.where((F.col("g") % 2 == k) & (F.col("g") != 2)), landing).count()
        if k:
            spark.range(1).select(F.lit("not a zip").alias("value")).coalesce(1).write.text(f"{landing}/0/broken")
        archives.ingest_folders(spark, landing, folders, out, rejects, marks, files_per_batch=50, members=60)
    failed = spark.read.parquet(rejects)
    sinks.write_archives(rows.where("g = 2"), late).count()
    mended = failed.where("error = 'not_an_archive'").select(F.lit(f"{late}/a2.zip").alias("path")).distinct()
    again = next(archives.retry(spark, mended, members=60))
    shown = lambda df, how: df.select("member", F.md5("xml").alias("digest"), F.lit(None).cast("string").alias("error"), F.lit(how).alias("how"))
    large = failed.where("error = 'too_large'").select(F.element_at(F.split("path", "/"), -1).alias("member"), F.lit(None).cast("string").alias("digest"), "error", F.lit("rejected").alias("how"))
    return shown(spark.read.parquet(out), "landed").union(shown(again, "retried")).union(large)


@query("SELECT doc_id % 50 AS doc, count(*) AS lines, sum(length(t)) AS chars, 'docs' AS section FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) GROUP BY 1".replace("\\\\", "\\").replace("count(*) AS lines, sum(length(t)) AS chars", "count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars"))
def src_documents(spark, sf):
    """SRC-09: documents written as text files in folders and loaded."""
    load(spark, sf, "documents")
    root = shared_folder(spark, "knowledge")
    plain = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    out = spark.table("documents").select((F.col("doc_id") % 50).cast("string").alias("d"), plain.alias("value"))
    out.repartition("d").write.partitionBy("d").text(f"{root}/docs")
    got = files.read_documents(spark, root).where("error is null")
    lines = got.select(F.regexp_extract("path", r"d=(\d+)", 1).cast("long").alias("doc"), "section", F.explode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("t"))
    return lines.groupBy("doc", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("t")).alias("chars"))


@query(f"WITH {NOTICES} SELECT seq, '<n><num>' || seq || '</num></n>' AS xml FROM n WHERE seq % 9 <> 0")
def src_archives(spark, sf):
    """SRC-07: files of XML that land in two passes, each read once by a stream; what is no XML is kept apart."""
    n = notices(spark, sf).select("seq", F.when(F.col("seq") % 9 == 0, "broken").otherwise(F.concat(F.lit("<n><num>"), F.col("seq").cast("string"), F.lit("</num></n>"))).alias("value"))
    landing, out, rejects, marks = (shared_folder(spark, name) for name in ("landing", "members", "rejects", "marks"))
    for k in (0, 1):
        # a file per group of notices: its members are elements of one text
        part = n.where(F.col("seq") % 2 == k)
        good = part.where("value <> 'broken'").groupBy((F.col("seq") % 32).alias("g")).agg(F.concat(F.lit("<all>"), F.array_join(F.collect_list("value"), ""), F.lit("</all>")).alias("value"))
        bad = part.where("value = 'broken'").groupBy((F.col("seq") % 32).alias("g")).agg(F.max("value").alias("value"))
        for rows in (good, bad):
            rows.select(F.col("g").cast("string").alias("g"), "value").write.mode("append").partitionBy("g").text(landing)
        archives.ingest(spark, landing, out, rejects, marks)
    archives.ingest(spark, landing, out, rejects, marks)
    xml = spark.read.parquet(out).select(F.explode(F.regexp_extract_all("xml", F.lit(r"<n>.*?</n>"), F.lit(0))).alias("xml"))
    return xml.select(F.regexp_extract("xml", r"<num>(\d+)", 1).cast("long").alias("seq"), "xml")


@query(f"WITH {NOTICES} SELECT seq, price + 1 AS price FROM n")
def snk_publish(spark, sf):
    """SNK-06: two versions of a table, of which readers see the last."""
    n = notices(spark, sf).select("seq", "price")
    path = shared_folder(spark, "published")
    sinks.publish(n, path)
    sinks.publish(n.withColumn("price", F.col("price") + 1), path)
    return sinks.current(spark, path)


@query(f"WITH {NOTICES}, h AS (SELECT source, count(*) AS found FROM n GROUP BY 1) SELECT 'daily' AS profile, (SELECT count(*) FROM n) AS raw_count, (SELECT count(DISTINCT title) FROM n) AS unique_count, string_agg(source || '=' || found, ',' ORDER BY source) AS sources FROM h")
def snk_report(spark, sf):
    """SNK-02: the report of a run as one nested row."""
    n = notices(spark, sf)
    health = n.groupBy("source").agg(F.count(F.lit(1)).alias("found")).withColumns({"status": F.lit("ok"), "detail": F.lit("")})
    r = sinks.run_report("daily", report.run_totals(n, n, n.where("source = 'copy'"), "title"), health)
    return r.select("profile", "summary.raw_count", "summary.unique_count", F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit("="), s["found"].cast("string"))), ",").alias("sources"))


@query("SELECT doc_id, left(text, 20000) AS text, length(text) AS chars, length(text) > 20000 AS truncated FROM documents WHERE doc_id % 100 = 0")
def se_fetch(spark, sf):
    """SE-04: the documents whose id is divisible by 100, fetched by id."""
    load(spark, sf, "documents")
    d = spark.table("documents")
    return search.fetch_documents(d, d.where("doc_id % 100 = 0").select("doc_id"))


@query("SELECT CASE WHEN lang = 'en' THEN 'root' ELSE lang END AS section, count(*) AS documents FROM documents GROUP BY 1")
def se_sections(spark, sf):
    """SE-04: how many documents each section holds."""
    load(spark, sf, "documents")
    return search.section_counts(spark.table("documents").withColumn("section", F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))))
