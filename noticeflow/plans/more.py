"""Queries of customers, queues, links, cases and the rest of the register."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, customers, dedup, economics, freshness, links, products, register, report, requirements
from ..sources import sinks
from .queries import _CASES, _PICK, BATCHES, NOTICES, _case_tables, _old_new, query, ts
from .tables import batches, load, notices

_CUST = "c AS (SELECT c_custkey AS k, 'org' || CAST(c_custkey AS STRING) AS org_key, c_nationkey % 3 AS p FROM customer)"


@query(
    f"""WITH {_CUST}, s AS (SELECT k AS seq, org_key, p, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 13 = 0 THEN 'noreply@x.org' ELSE 'm' || CAST(k % 400 AS STRING) || '@x.org' END AS email FROM c),
q AS (SELECT org_key, 'm' || CAST(k * 3 % 400 AS STRING) || '@x.org' AS old, k % 2 = 0 AS sent FROM c WHERE k % 5 < 2),
r AS (SELECT s.*, q.old, CASE WHEN q.org_key IS NULL THEN 'append' WHEN email IS NOT NULL AND email <> old AND NOT sent THEN 'update' END AS action FROM s LEFT JOIN q ON s.org_key = q.org_key),
a AS (SELECT * FROM r WHERE action IS NOT NULL),
ev AS (SELECT -1 AS p, -1 AS seq, 0 AS kind, old AS email, 1 AS claim FROM q UNION ALL SELECT p, seq, 1, old, 0 FROM a WHERE action = 'update' UNION ALL SELECT p, seq, 2, email, 1 FROM a WHERE email IS NOT NULL),
t AS (SELECT *, last_value(claim) OVER (PARTITION BY email ORDER BY p, seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM ev)
SELECT a.org_key, a.action, a.email, CASE WHEN a.email IS NULL THEN 'missing_or_invalid_email' WHEN a.email LIKE 'noreply@%' THEN 'system_email' WHEN a.email = 'm5@x.org' THEN 'stoplist' WHEN coalesce(t.taken, 0) = 1 THEN 'duplicate_email'
 WHEN a.seq % 17 = 0 THEN 'no_evidence' ELSE 'new_contact' END AS reason FROM a LEFT JOIN t ON t.kind = 2 AND t.seq = a.seq"""
)
def up_queue(spark, sf):
    """UP-13, JN-14, WN-05: plan of a queue sync, two fifths of all organizations being queued."""
    load(spark, sf, "customer")
    c = spark.sql(f"WITH {_CUST} SELECT * FROM c")
    k = F.col("k")
    address = F.when(k % 9 == 0, "none").when(k % 13 == 0, "NoReply@x.org").otherwise(F.concat(F.lit("M"), (k % 400).cast("string"), F.lit("@x.org")))
    source = c.select("org_key", address.alias("email"), F.lit("page").alias("contact_source"), F.when(k % 17 == 0, "").otherwise("https://x.org/1").alias("evidence"), k.alias("seq"), "p")
    queue = c.where("k % 5 < 2").select("org_key", F.concat(F.lit("m"), (k * 3 % 400).cast("string"), F.lit("@x.org")).alias("email"), (k % 2 == 0).alias("sent"))
    stops = spark.createDataFrame([("M5@x.org",)], "email string")
    return customers.queue_plan(source, queue, stops, F.col("p")).select("org_key", "action", "email", "reason")


@query(
    """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'hand@x.org' WHEN c_custkey % 5 = 1 THEN 'old@x.org' ELSE '' END AS email FROM customer)
SELECT k, CASE WHEN k % 5 = 0 OR k % 3 = 1 OR k % 4 <> 0 THEN nullif(email, '') ELSE 'new' || k || '@x.org' END AS email, k % 5 <> 0 AND k % 3 <> 1 AND k % 4 = 0 AS filled FROM r"""
)
def jn_contacts(spark, sf):
    """JN-11: contacts filled from the cache."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    registry = spark.table("customer").select(k.alias("org_key"), F.when(k % 5 == 0, "hand@x.org").when(k % 5 == 1, "old@x.org").otherwise("").alias("email"), F.when(k % 5 == 1, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("generated"))
    cache = spark.table("customer").where(k % 4 == 0).select(k.alias("org_key"), F.when(k % 3 == 1, "error").otherwise("ok").alias("status"), F.concat(F.lit("new"), k.cast("string"), F.lit("@x.org")).alias("email"))
    return customers.fill_contacts(registry, cache, ["email"]).select(F.col("org_key").alias("k"), F.nullif("email", F.lit("")).alias("email"), "filled")


@query(
    f"""WITH {NOTICES}, x AS (SELECT lower(replace(customer, '#', '')) AS org_key, arg_max(region, price * 1e9 + seq) AS region, arg_max('u' || CAST(seq AS STRING), price * 1e9 + seq) AS url FROM n WHERE customer <> '' GROUP BY 1)
SELECT org_key, region, url FROM x UNION ALL SELECT 'old', 'EAST', 'u' """.replace("price * 1e9 + seq", "struct_pack(a := price, b := seq)")
)
def dd_customers(spark, sf):
    """DD-11: the customer registry from the most telling notice of each organization."""
    n = notices(spark, sf).withColumn("url", F.concat(F.lit("u"), F.col("seq").cast("string")))
    old = spark.createDataFrame([("old", "Old", "EAST", "u", "s", "")], "org_key string, name string, region string, url string, status string, phone string")
    n = n.withColumn("discovered_at", F.lit(0))
    return customers.customer_registry(n, old, F.col("region"), F.col("price"), {"phone": F.lit("")}).select("org_key", "region", "url")


@query(
    f"""WITH {NOTICES} SELECT seq, CASE WHEN source = 'src1' THEN tender_number END AS official_number, CASE WHEN source IN ('src2', 'src3') THEN tender_number END AS platform_number,
 CASE WHEN source IN ('src1', 'src2', 'src3') THEN CASE WHEN length(tender_number) = 11 THEN '223-ФЗ' ELSE NULL END END AS procurement_law FROM n WHERE source <> 'src1'
UNION ALL SELECT seq, lpad(tender_number, 11, '0'), NULL, '223-ФЗ' FROM n WHERE source = 'src1'"""
)
def cl_links(spark, sf):
    """CL-22: direct links by class of source."""
    n = notices(spark, sf).withColumns({"tender_number": F.when(F.col("source") == "src1", F.lpad("tender_number", 11, "0")).otherwise(F.col("tender_number")), "url": F.lit("http://x.org/1"), "official_number": F.lit(None).cast("string")})
    n = n.withColumns({c: F.lit(None).cast("string") for c in ("official_url", "official_source", "platform_number", "platform_url", "procurement_law", "resolution_method")} | {"resolution_confidence": F.lit(0.0)})
    return links.direct_links(n, ["src1"], ["src2", "src3"], [], "registry.org", "registry").select("seq", "official_number", "platform_number", "procurement_law")


@query(
    f"""WITH {NOTICES} SELECT seq, lpad(CAST(seq // 2 AS STRING), 19, '0') AS number, 'r' || CAST(seq // 2 AS STRING) AS official_url, 'p' || CAST(seq // 2 AS STRING) AS platform_url FROM n WHERE source = 'copy'"""
)
def jn_official(spark, sf):
    """JN-03: collected records of an official number."""
    n = notices(spark, sf).withColumn("k", F.floor(F.col("seq") / 2).cast("string"))
    number = F.lpad("k", 19, "0")
    wanted = n.where("source = 'copy'").select(F.col("seq").alias("unique_key"), number.alias("number"))
    own = n.where("source <> 'copy'")
    reg = own.select(F.lit(None).cast("string").alias("official_number"), number.alias("tender_number"), F.concat(F.lit("r"), "k").alias("url"), F.lit("registry").alias("source"), "seq")
    plat = own.select(number.alias("official_number"), F.lit("x").alias("tender_number"), F.concat(F.lit("p"), "k").alias("url"), F.lit("platform").alias("source"), (F.col("seq") + 1).alias("seq"))
    none = F.lit(None).cast("string")
    found = reg.union(plat).withColumns({"official_url": none, "platform_number": none, "platform_url": none})
    return links.official_matches(wanted, found, F.col("source") == "registry").select(F.col("unique_key").alias("seq"), "number", "official_url", "platform_url")


@query(
    f"""WITH {NOTICES} SELECT seq, CASE WHEN seq % 4 = 0 THEN 'unchecked' WHEN seq % 4 = 1 THEN 'invalid' WHEN seq % 4 = 2 THEN 'invalid' ELSE 'confirmed' END AS link_state FROM n"""
)
def jn_verify(spark, sf):
    """JN-12: links verified against captured pages."""
    n = notices(spark, sf).select("seq", F.concat(F.lit("7"), F.col("seq").cast("string")).alias("official_number"), F.concat(F.lit("http://x/"), F.col("seq").cast("string")).alias("official_url"))
    body = F.when(F.col("seq") % 4 == 1, F.concat("official_number", F.lit(" Страница не найдена"))).when(F.col("seq") % 4 == 2, F.concat("official_number", F.lit("0"))).otherwise(F.concat(F.lit("№ "), "official_number", F.lit(", дата")))
    pages = n.where("seq % 4 <> 0").select(F.col("official_url").alias("url"), body.alias("text"))
    return links.verify_links(n, pages, ["не найдена"]).select("seq", "link_state")


@query(
    """WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(substr(text, 1, 24), '\\s+', ' ', 'g'))) AS title FROM documents)
SELECT n.doc_id AS k, d.doc_id FROM d AS n, d WHERE n.title <> '' AND contains(d.t, n.title)""".replace("\\\\", "\\")
)
def jn_evidence(spark, sf):
    """JN-05: notices of all documents whose title stands in a document."""
    load(spark, sf, "documents")
    d = spark.table("documents")
    n = d.select(F.col("doc_id").alias("unique_key"), F.lit("").alias("tender_number"), F.substring("text", 1, 24).alias("title"))
    return links.apply_evidence(n, d).select(F.col("unique_key").alias("k"), "doc_id")


#: Kinds of requirement lines: what is asked, and its verdict in SQL over a part (size in cm, price, brand, name, thousands of pages).
_ASKED = (
    ("Размер не менее 100 мм", "p_size * 10 >= 100"),
    ("Размер корпуса: не более 25 см", "p_size <= 25"),
    ("размер более 20 см", "p_size > 20"),
    ("Размер, измеренный на 3 опорах, менее 0,3 м", "NULL"),
    ("Размер ≥ 150 мм", "p_size * 10 >= 150"),
    ("Размер ≤ 4", "p_size <= 4"),
    ("Размер = 12 см", "p_size = 12"),
    ("Цена не более 1 500 руб", "p_retailprice <= 1500"),
    ("Ресурс не менее 3 000 стр", "CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE p_partkey % 9 END >= 3"),
    ("Ресурс от 3 до 5 тысяч", "CASE WHEN p_partkey % 5 = 0 THEN true END"),
    ("Марка: {brand}", "contains(lower(p_brand), '#4') OR contains('brand#4', lower(p_brand))"),
    ("Совместимость с HP-2035N и LX-1: да", "p_partkey % 3 = 0"),
    ("Совместим с XQ-77, Азия: есть", "CASE WHEN p_partkey % 4 <> 0 THEN false WHEN p_partkey % 8 = 0 THEN true END"),
    ("{name} в наборе", "CASE WHEN p_partkey % 2 = 0 THEN true END"),
)


def _requirement_sql() -> str:
    kinds = " ".join(f"WHEN {k} THEN {test}" for k, (_, test) in enumerate(_ASKED))
    return f"""WITH c AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS line_id, l_partkey, (l_orderkey + l_linenumber) % {len(_ASKED) + 1} AS kind FROM lineitem),
v AS (SELECT line_id, p_partkey AS product_id, kind, CASE kind {kinds} END AS ok FROM c JOIN part ON p_partkey = l_partkey)
SELECT line_id, product_id, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok IS NULL) AS unknown,
 CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'rejected' WHEN count(*) FILTER (WHERE ok IS NULL) = 0 THEN 'compliant' ELSE 'conditional' END AS status FROM v GROUP BY 1, 2"""


@query(_requirement_sql())
def jn_requirements(spark, sf):
    """JN-06, FN-17, AG-10: a requirement of one of fourteen kinds, or none, for every line, checked against its product's attributes and text."""
    load(spark, sf, "lineitem", "part")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % (len(_ASKED) + 1)
    lines = spark.table("lineitem").join(spark.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    asked = F.coalesce(*[F.when(kind == k, F.replace(F.replace(F.lit(said), F.lit("{name}"), F.col("p_name")), F.lit("{brand}"), F.lit("Brand#4"))) for k, (said, _) in enumerate(_ASKED)], F.lit(" ; "))
    # with part keys of seven digits lines of different products share a line_id: their requirements stay apart
    lines = lines.select(F.struct(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("line_id"), F.col("l_partkey").alias("product_id")).alias("line"), F.col("l_partkey").alias("product_id"), asked.alias("required_specs"))
    # dealt by lines once, for all that goes by them
    lines = lines.repartition("line").distinct()
    part = spark.table("part").withColumn("product_id", F.col("p_partkey"))
    text = F.concat_ws(
        ". ", F.concat(F.lit("Ресурс печати "), F.col("p_partkey") % 9, F.lit(" тыс. страниц")), F.when(F.col("p_partkey") % 3 == 0, "подходит к HP 2035n, lx 1"), F.when(F.col("p_partkey") % 4 == 0, "XQ77"),
        F.when(F.col("p_partkey") % 8 == 0, "азия"), F.when(F.col("p_partkey") % 5 == 0, "Ресурс от 3 до 5 тысяч"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" в наборе"))),
    )
    rows = lambda seq, name, value, number, unit: part.select("product_id", F.lit(seq).alias("seq"), F.lit(name).alias("name"), value.alias("value"), number.alias("number"), F.lit(unit).alias("unit"))
    none = F.lit(None).cast("double")
    size = F.concat(F.col("p_size").cast("string"), F.lit(" см"))
    attributes = rows(0, "Размер корпуса", size, none, None).union(rows(1, "Цена", F.col("p_retailprice").cast("string"), F.col("p_retailprice"), "руб")).union(rows(2, "Марка", F.col("p_brand"), none, None))
    req = requirements.parse_requirements(lines, ["line"])
    out = requirements.compliance(requirements.check_requirements(req, attributes, lines, "line", texts=part.select("product_id", F.lit("").alias("title"), text.alias("text"))), "line")
    return out.select("line.line_id", "product_id", "passed", "failed", "unknown", "status")


@query(
    """WITH c AS (SELECT l_orderkey AS line_id, l_linenumber * 1000000 + l_partkey AS product_id, CASE l_partkey % 4 WHEN 0 THEN 'compliant' WHEN 1 THEN 'conditional' WHEN 2 THEN 'rejected' ELSE 'exact' END AS status,
 l_linenumber % 3 = 0 AS ready, CASE l_suppkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'none' END AS stock, CASE WHEN l_partkey % 5 > 0 THEN p_retailprice END AS price, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT line_id, product_id, row_number() OVER (PARTITION BY line_id ORDER BY CASE status WHEN 'conditional' THEN 1 WHEN 'rejected' THEN 2 ELSE 0 END, ready OR coalesce(stock = 'low', false) DESC, price NULLS LAST, name, product_id) AS rank FROM c"""
)
def wn_candidates(spark, sf):
    """WN-09: candidates of every line by compliance, stock, price and name."""
    load(spark, sf, "lineitem", "part")
    c = spark.table("lineitem").join(spark.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    state = F.when(F.col("l_suppkey") % 3 == 0, "low").when(F.col("l_suppkey") % 3 == 1, "none")
    grade = F.element_at(F.array(*map(F.lit, ("compliant", "conditional", "rejected", "exact"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    c = c.select(F.col("l_orderkey").alias("line_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("product_id"), grade.alias("status"), (F.col("l_linenumber") % 3 == 0).alias("is_available"), state.alias("stock_status"), F.when(F.col("l_partkey") % 5 > 0, F.col("p_retailprice")).alias("price"), F.col("p_name").alias("name"))
    return requirements.order_candidates(c).select("line_id", "product_id", F.col("rank").cast("long").alias("rank"))


_ROUTE = "r AS (SELECT l_orderkey AS line_id, 's' || CAST(l_linenumber % 3 AS STRING) AS source, l_quantity > 25 AS viable FROM lineitem)"


@query(
    f"""WITH {_ROUTE}, i AS (SELECT DISTINCT line_id FROM r), st AS (SELECT line_id, source, priority FROM i, (VALUES ('s0', 0), ('s1', 1), ('s2', 2)) v(source, priority)),
t AS (SELECT st.*, count(*) FILTER (WHERE viable) AS viable, count(r.source) AS found FROM st LEFT JOIN r ON r.line_id = st.line_id AND r.source = st.source GROUP BY ALL),
f AS (SELECT *, min(CASE WHEN viable > 0 THEN priority END) OVER (PARTITION BY line_id) AS first FROM t)
SELECT line_id, source, CASE WHEN found = 0 THEN 'empty' WHEN viable = 0 THEN 'rejected' ELSE 'matched' END AS status, coalesce(priority = first, false) AS used FROM f WHERE first IS NULL OR priority <= first"""
)
def jn_route(spark, sf):
    """JN-16: sources in order until one has a viable product."""
    load(spark, sf, "lineitem")
    r = spark.sql(f"WITH {_ROUTE} SELECT * FROM r")
    order = spark.createDataFrame([("s0", 0, True), ("s1", 1, True), ("s2", 2, True)], "source string, priority int, available boolean")
    return products.ranked_route(r, r.select("line_id").distinct().crossJoin(F.broadcast(order))).select("line_id", "source", "status", "used")


@query(
    """WITH l AS (SELECT o_orderkey AS line_id FROM orders), c AS (SELECT l_orderkey AS line_id, l_returnflag AS f, l_linestatus = 'O' AS s FROM lineitem)
SELECT l.line_id, CASE WHEN count(*) FILTER (WHERE f = 'A' AND s) > 0 THEN 'backup' WHEN count(*) FILTER (WHERE f <> 'R') > 0 THEN 'verify' ELSE 'required' END AS task FROM l LEFT JOIN c ON l.line_id = c.line_id GROUP BY 1""".replace("count(*) FILTER (WHERE f <> 'R')", "count(*) FILTER (WHERE f IS NOT NULL AND f <> 'R')")
)
def jn_tasks(spark, sf):
    """JN-15: whether a line needs an alternative."""
    load(spark, sf, "lineitem", "orders")
    status = F.when(F.col("l_returnflag") == "A", "compliant").when(F.col("l_returnflag") == "R", "rejected").otherwise("conditional")
    c = spark.table("lineitem").select(F.col("l_orderkey").alias("line_id"), status.alias("status"), (F.col("l_linestatus") == "O").alias("in_stock"))
    return products.alternative_tasks(spark.table("orders").select(F.col("o_orderkey").alias("line_id")), c).select("line_id", "task")


@query(
    f"""WITH {BATCHES}, old AS (SELECT unique_key, arg_max(source, seq) AS section, 1 AS o FROM e WHERE d < 15 GROUP BY 1), cur AS (SELECT unique_key, arg_max(source, seq) AS section FROM e WHERE d = 15 GROUP BY 1)
SELECT unique_key, section, 2 AS observed FROM cur UNION ALL SELECT unique_key, section, 1 FROM old WHERE section <> 'view' AND unique_key NOT IN (SELECT unique_key FROM cur)"""
)
def up_section(spark, sf):
    """UP-06: a complete pass replaces a section, a partial one keeps what it didn't see."""
    old, new = _old_new(spark, sf)
    shape = lambda df: df.select("unique_key", F.col("source").alias("section"))
    done = spark.createDataFrame([("view", True), ("click", False)], "section string, complete boolean")
    out = freshness.section_snapshot(shape(old).withColumn("observed_at", F.lit(1)), shape(new), done, F.lit(2))
    return out.select("unique_key", "section", F.col("observed_at").alias("observed"))


@query(
    f"""WITH {NOTICES} SELECT seq FROM n WHERE deadline >= TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 7 DAY OR discovered_at >= TIMESTAMP '2001-06-01 00:00:00' ORDER BY discovered_at DESC, seq LIMIT 300"""
)
def up_retained(spark, sf):
    """UP-07: retention, the newest 300."""
    n = notices(spark, sf)
    return freshness.retained(n, ts("2001-01-01 00:00:00"), ts("2001-06-01 00:00:00"), 300, published="discovered_at", tie="seq").select("seq")


@query(
    """WITH h AS (SELECT * FROM (VALUES ('view', 'ok'), ('click', 'empty'), ('signup', 'partial'), ('error', 'failed'), ('purchase', 'ok'), ('other', 'empty')) v(source, st)),
o AS (SELECT DISTINCT event_type AS source FROM events WHERE day(ts) < 15), n AS (SELECT DISTINCT event_type AS source FROM events WHERE day(ts) = 15 AND event_type <> 'purchase')
SELECT h.source, CASE WHEN (st = 'ok' AND (h.source IN (SELECT source FROM n) OR h.source NOT IN (SELECT source FROM o))) OR (st = 'empty' AND h.source NOT IN (SELECT source FROM o)) THEN 2 ELSE 1 END AS generated_at FROM h"""
)
def up_times(spark, sf):
    """UP-04: freshness of sources advances only where they were renewed."""
    load(spark, sf, "events")
    e = spark.table("events").withColumnRenamed("event_type", "source")
    health = spark.createDataFrame([("view", "ok"), ("click", "empty"), ("signup", "partial"), ("error", "failed"), ("purchase", "ok"), ("other", "empty")], "source string, status string")
    times = health.select("source", F.lit(1).alias("generated_at"))
    return freshness.updated_times(times, e.where(F.dayofmonth("ts") < 15), e.where((F.dayofmonth("ts") == 15) & (F.col("source") != "purchase")), health, F.lit(2))


@query(
    """WITH c AS (SELECT event_type, count(*) FILTER (WHERE day(ts) = 3 AND value < 20) AS n FROM events GROUP BY 1)
SELECT count(*) FILTER (WHERE n > 13) AS good, count(*) FILTER (WHERE n BETWEEN 1 AND 13) AS partial, count(*) FILTER (WHERE n = 0) AS bad FROM c"""
)
def ag_rollup(spark, sf):
    """AG-03: rollup of a run."""
    load(spark, sf, "events")
    n = spark.table("events").groupBy(F.col("event_type").alias("source")).agg(F.count_if((F.dayofmonth("ts") == 3) & (F.col("value") < 20)).alias("n"))
    return report.run_rollup(n.withColumn("status", F.when(F.col("n") > 13, "ok").when(F.col("n") > 0, "partial").otherwise("error"))).select("good", "partial", "bad")


@query(f"WITH {NOTICES} SELECT count(*) AS raw_count, count(DISTINCT title) AS unique_count, count(*) FILTER (WHERE source = 'copy') AS new_count FROM n")
def ag_totals(spark, sf):
    """AG-12: raw, unique and new rows."""
    n = notices(spark, sf)
    return report.run_totals(n, n, n.where("source = 'copy'"), "title")


@query(
    f"""WITH {NOTICES}, t AS (SELECT seq, title, row_number() OVER (ORDER BY price DESC, seq) AS k FROM n QUALIFY k <= 5)
SELECT (SELECT 'Всего: ' || count(*) FROM n) || chr(10) || string_agg(k || '. ' || title, chr(10) ORDER BY k) || chr(10) || '+' || ((SELECT count(*) FROM n) - 5) AS text, (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM n) - 5 AS remaining FROM t"""
)
def snk_digest(spark, sf):
    """SNK-05: text of a digest."""
    n = notices(spark, sf)
    return report.digest(n, [F.desc("price"), F.col("seq")], F.col("title"), "Всего: ", 5).withColumns({"remaining": F.col("remaining").cast("long")})


@query(f"""WITH {NOTICES} SELECT '{{"seq":' || seq || ',"title":"' || title || '","price":' || CASE WHEN seq % 5 = 0 THEN 'null' ELSE '1.5' END || '}}' AS value FROM n""")
def snk_json(spark, sf):
    """SNK-01: notices as JSON, prices that are no number as null."""
    n = notices(spark, sf).select("seq", "title", F.when(F.col("seq") % 5 == 0, float("nan")).otherwise(1.5).alias("price"))
    return sinks.notices_json(n)


@query(
    f"""WITH {_CASES}, {_PICK}, j AS (SELECT i.case_id, i.line_id, i.mandatory, p.unit_cost_gross AS cost, p.compliance_status AS st, p.evidence AS ev, p.lead_days AS ld FROM items i LEFT JOIN pick p ON p.case_id = i.case_id AND p.line_id = i.line_id),
x AS (SELECT case_id, 'question' AS kind, 'product:' || line_id AS text FROM j WHERE cost IS NULL AND mandatory UNION SELECT case_id, 'risk', 'conditional:' || line_id FROM j WHERE st = 'conditional' UNION SELECT case_id, 'risk', 'no_evidence:' || line_id FROM j WHERE cost IS NOT NULL AND ev = ''
 UNION SELECT case_id, 'risk', 'lead_days:' || line_id FROM j WHERE ld > 15 UNION SELECT l_orderkey, 'risk', 'unconfirmed:other' FROM lineitem WHERE CAST(l_tax * 1000 AS DECIMAL(18, 2)) > 0 AND l_returnflag <> 'R' UNION SELECT o_orderkey, 'risk', 'payment_days:60' FROM orders WHERE o_orderkey % 5 = 0)
SELECT * FROM x"""
)
def ec_risks(spark, sf):
    """EC-04: risks and questions of every case."""
    c, lines, expenses = _case_tables(spark, sf)
    no = F.lit(False)
    c = c.withColumns({"own_delivery": no, "requires_installation": no, "payment_days": F.when(F.col("case_id") % 5 == 0, 60).otherwise(10), "delivery_days": F.lit(15)})
    return economics.case_risks(c, lines, expenses).select("case_id", "kind", "text")


@query(
    """WITH s AS (SELECT l_suppkey AS supplier_id, l_partkey AS article, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS dealer, CASE WHEN l_linestatus = 'O' THEN l_discount END AS retail, l_orderkey * 10 + l_linenumber AS seq0 FROM lineitem),
u AS (SELECT supplier_id, article, seq0 AS seq, max(dealer) AS dealer, max(retail) AS retail FROM s GROUP BY ALL)
SELECT supplier_id, article, first(dealer ORDER BY dealer IS NULL, seq) AS dealer_price, first(retail ORDER BY retail IS NULL, dealer IS NULL, seq) AS retail_price FROM u GROUP BY 1, 2"""
)
def dd_products(spark, sf):
    """DD-10: products of a supplier merged, rows with a dealer price first."""
    load(spark, sf, "lineitem")
    s = spark.sql("SELECT l_suppkey AS supplier_id, l_partkey AS article, l_orderkey * 10 + l_linenumber AS seq, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS dealer_price, max(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS retail_price FROM lineitem GROUP BY l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber")
    return products.merge_products(s, ["supplier_id", "article"], ["dealer_price", "retail_price"]).select("supplier_id", "article", "dealer_price", "retail_price")


_MARKS = (("english", ("the", "with")), ("french", ("les", "dans")), ("german", ("der", "und")))
_HITS = ", ".join(" + ".join(f"contains(lower(text[:30000]), '{m}')::INT" for m in ms) + f" AS {k}" for k, ms in _MARKS)


@query(f"WITH c AS (SELECT doc_id, {_HITS} FROM documents) SELECT doc_id, CASE WHEN greatest(english, french, german) = 0 THEN 'other' WHEN english >= french AND english >= german THEN 'english' WHEN french >= german THEN 'french' ELSE 'german' END AS doc_type FROM c")
def cl_doc_types(spark, sf):
    """CL-16: type of documents by counts of markers."""
    load(spark, sf, "documents")
    d = spark.table("documents").select("doc_id", F.lit("").alias("name"), "text")
    return cases.classify_documents(d, dict(_MARKS)).select("doc_id", "doc_type")


@query("SELECT DISTINCT doc_id, field, value FROM (SELECT doc_id, 'after_the' AS field, unnest(regexp_extract_all(text, '(?i)the ([a-z]{4}) ', 1)) AS value FROM documents UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '([0-9]{3})', 1)) FROM documents)")
def cl_metadata(spark, sf):
    """CL-17: values by pattern."""
    load(spark, sf, "documents")
    s = spark.table("documents").select("doc_id", F.lit("s").alias("source"), F.lit("l").alias("locator"), "text")
    return cases.extract_metadata(s, {"after_the": ["the ([a-z]{4}) "], "number": ["([0-9]{3})"]}, ["doc_id"]).select("doc_id", "field", "value")


@query(
    """SELECT doc_id, 'both' AS code FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'with') UNION ALL SELECT doc_id, 'scope_german' FROM documents WHERE contains(lower(text), ' und ') OR contains(lower(text), ' der ')
UNION ALL SELECT doc_id, 'missing_contract' FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'check_223_rules' FROM documents WHERE doc_id % 2 = 0"""
)
def cl_findings(spark, sf):
    """CL-18, CL-19, DD-08: findings in contents, and what a case lacks."""
    load(spark, sf, "documents")
    d = spark.table("documents")
    s = d.select("doc_id", F.lit("s").alias("source"), F.lit("l").alias("locator"), "text")
    found = cases.content_findings(s, [("both", "risk", ["the", "with"])], {"german": [" und ", " der "]}, ["doc_id"]).select("doc_id", "code")
    c = d.select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 2 == 0, "223-ФЗ").otherwise("44-ФЗ").alias("law"))
    have = c.where("case_id % 3 = 0").select("case_id", F.lit("contract").alias("doc_type"))
    return found.union(cases.completeness(c, have, ["contract"]).select(F.col("case_id").alias("doc_id"), "code"))


@query("SELECT l_orderkey AS case_id, CAST(l_linenumber AS STRING) AS line_id, p_name AS name, CAST(CAST(l_quantity AS INT) AS STRING) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey")
def cl_items(spark, sf):
    """CL-20: items read back from the texts that a case's lines were written to."""
    load(spark, sf, "lineitem", "part")
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), "p_name", F.lit("  "), F.col("l_quantity").cast("int").cast("string"), F.lit(" шт."))
    t = spark.table("lineitem").join(spark.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    t = t.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_join(F.collect_list(line), "\n").alias("text")).withColumns({"source": F.lit("s"), "locator": F.lit("l")})
    return cases.text_items(t).select("case_id", "line_id", "name", "quantity")


@query(
    f"""WITH {BATCHES}, old AS (SELECT unique_key, max(seq) AS seq FROM e WHERE d < 15 GROUP BY 1), cur AS (SELECT unique_key, max(seq) AS seq FROM e WHERE d = 15 GROUP BY 1)
SELECT unique_key, max(seq) AS seq FROM (SELECT * FROM old UNION ALL SELECT * FROM cur) GROUP BY 1"""
)
def st_history(spark, sf):
    """ST-02: history and current rows, the current ones win."""
    e = batches(spark, sf).select("unique_key", "seq", "d")
    last = lambda df: dedup.keep_last(df.select("unique_key", "seq"), ["unique_key"], "seq")
    return dedup.keep_last(last(e.where("d < 15")).unionByName(last(e.where("d = 15")), allowMissingColumns=True), ["unique_key"], "seq")


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 7 <> 0 THEN 'sent' ELSE 'new' END AS status, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 THEN 'today' WHEN c_custkey % 3 = 0 THEN 'before' END AS sent_at FROM customer"""
)
def up_changes(spark, sf):
    """UP-16, UP-17: a batch of changes by key, with a closed list and a time set once."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    table = spark.table("customer").select(k.alias("k"), F.lit("new").alias("status"), F.when(k % 3 == 0, "before").alias("sent_at"))
    changes = spark.table("customer").where(k % 4 == 0).select(k.alias("k"), F.when(k % 7 == 0, "nonsense").otherwise("sent").alias("status"), F.lit("today").alias("sent_at"))
    return cases.keyed_update(table, changes, ["k"], ["status", "sent_at"], closed={"status": ["new", "sent"]}, once=["sent_at"])[0]


@query(
    """WITH o AS (SELECT c_custkey AS k FROM customer), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'a' || c_custkey END AS a, 'b' || c_custkey AS b FROM customer WHERE c_custkey % 2 = 0)
SELECT o.k, coalesce(nullif(a, ''), CASE WHEN n.k IS NOT NULL THEN 'older' END) AS choice, b AS note FROM o LEFT JOIN n ON o.k = n.k"""
)
def jn_manual(spark, sf):
    """JN-09: manual entries carried over, the newest that is there."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    now = spark.table("customer").select(k.alias("k"), F.lit("").alias("choice"), F.lit(None).cast("string").alias("note"))
    new = spark.table("customer").where(k % 2 == 0).select(k.alias("k"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("a"), k.cast("string"))).alias("choice"), F.concat(F.lit("b"), k.cast("string")).alias("note"), F.lit(2).alias("file"))
    old = new.withColumns({"choice": F.lit("older"), "note": F.lit("old"), "file": F.lit(1)})
    return register.carry_over(now, new.union(old), ["choice", "note"], ["k"], [-F.col("file")])


@query(
    """WITH p AS (SELECT c_custkey AS k, c_custkey % 4 AS m FROM customer)
SELECT k, CASE WHEN m = 0 THEN 'exact' WHEN m = 1 THEN 'meta+unverified' WHEN m = 2 THEN 'lookup' ELSE 'none' END AS outcome FROM p"""
)
def up_resolve(spark, sf):
    """UP-10: official numbers from collected records, a fresh cache, or a lookup still to do."""
    load(spark, sf, "customer")
    k = F.col("c_custkey")
    base = spark.table("customer").select(k.cast("string").alias("unique_key"), F.when(k % 4 != 3, F.lpad(k.cast("string"), 19, "0")).alias("number"), F.lit(False).alias("conflict"), (k % 4).alias("m"), k.alias("k"))
    status = F.when(F.col("m") == 0, "exact").when(F.col("m") == 1, "not_found").otherwise("exact")
    checked = F.when(F.col("m") == 2, ts("2026-01-01 00:00:00")).otherwise(ts("2026-01-02 06:00:00"))
    cache = base.where("number is not null").select("number", status.alias("status"), F.lit("u").alias("url"), checked.alias("checked_at"))
    none = F.lit(None).cast("string")
    nothing = base.limit(0).select("unique_key", none.alias("official_url"), none.alias("platform_number"), none.alias("platform_url"))
    out = links.resolve(base.select("unique_key", "number", "conflict"), nothing, cache, ts("2026-01-02 12:00:00"))
    outcome = F.when(F.col("lookup"), "lookup").when(F.col("resolution_method") == "meta+registry-exact", "exact").when(F.col("resolution_method") == "unresolved", "none").otherwise(F.col("resolution_method"))
    return out.select(F.col("unique_key").cast("long").alias("k"), outcome.alias("outcome"))


@query("SELECT doc_id, 'kb' AS section, left(text, 2000) AS text, length(text) > 2000 AS truncated FROM documents")
def se_list(spark, sf):
    """SE-04: documents with their first characters."""
    from ..operators.search import list_documents

    load(spark, sf, "documents")
    return list_documents(spark.table("documents").withColumn("section", F.lit("kb")))


@query("SELECT doc_id, lower(left(text, 40)) AS key, count(*) OVER (PARTITION BY lower(left(text, 40))) AS n FROM documents WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY doc_id) = 1".replace("\\\\", "\\").replace(", lower(left(text, 40)) AS key, count(*) OVER (PARTITION BY lower(left(text, 40))) AS n", ""))
def cl_active(spark, sf):
    """CL-14: active rows, the first of equal ones."""
    load(spark, sf, "documents")
    d = spark.table("documents").select("doc_id", F.col("text").alias("name"), F.when(F.col("doc_id") % 2 == 0, " Да ").otherwise("нет").alias("active"))
    return cases.active_rows(d, ["name"], order="doc_id").select("doc_id")


