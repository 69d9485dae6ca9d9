"""Rules of operators on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import dedup, economics, freshness, match, products, register, report, requirements


@pytest.mark.parametrize(
    ("text", "term", "hit"),
    [
        ("ремонт насоса", "насос", True),
        ("шприц-ручка", "ручка", False),
        ("закупка бумаги", "бумага", True),
        ("поставка насосного оборудования", "насосное оборудование", True),
        ("насосная станция и совсем другое длинное описание оборудования", "насосное оборудование", False),
        ("ибп для школы", "ибп школа", True),
        ("ибпх для школы", "ибп школа", False),
        ("обыкновенный текст", "кнов", False),
    ],
)
def test_terms(spark, text, term, hit):
    got = match.match_terms(spark.createDataFrame([(1, text)], "id int, text string"), spark.createDataFrame([(term,)], "term string"), stop_words=("для", "и"))
    assert got.count() == int(hit)


def test_blocked_ending(spark):
    t = spark.createDataFrame([(1, "мониторинг"), (2, "мониторы")], "id int, text string")
    got = match.match_terms(t, spark.createDataFrame([("монитор", "инг")], "term string, blocked string"), blocked_col="blocked")
    assert [r["id"] for r in got.collect()] == [2]


NOTICE = "seq long, source string, tender_number string, official_number string"


def clusters(spark, rows):
    got = dedup.official_clusters(spark.createDataFrame(rows, NOTICE)).select("seq", "cluster").collect()
    return {r["seq"]: r["cluster"] for r in got}


def test_official_order_decides(spark):
    assert clusters(spark, [(1, "b", "k", None), (2, "a", "k", None), (3, "a", "x", "k")]) == {1: 1, 3: 1, 2: 2}


def test_official_any_partitioning(spark):
    rows = [(i, random.Random(i).choice("abc"), str(i % 5), str((i * 7) % 5) if i % 3 else None) for i in range(40)]
    want = clusters(spark, rows)
    for seed in range(3):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        assert clusters(spark, mixed) == want


def test_card_prices_are_not_transitive(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [(1, "T", day, 10.0, "a", None), (2, "t", day, 10.7, "b", None), (3, "T!", day, 11.4, "c", None), (4, "T", day, None, "d", None)]
    df = spark.createDataFrame(rows, "seq long, title string, deadline timestamp, price double, source string, official_number string").withColumns({"tender_number": F.col("seq").cast("string"), "region_bucket": F.lit("")})
    got = {r["seq"]: r["cluster"] for r in dedup.card_clusters(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_cards_see_members_of_merged_rows(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [(1, "a", "1", "N", 10.0, "t"), (2, "b", "2", "N", 10.9, "t"), (3, "c", "3", None, 9.5, "t"), (4, "d", "4", None, 10.2, "t")]
    df = spark.createDataFrame(rows, "seq long, source string, tender_number string, official_number string, price double, title string").withColumn("deadline", F.lit(day))
    got = dedup.deduplicate(df, F.when(F.col("source") == "a", 50).otherwise(40), F.lit(""), ["price"])
    # 3 fits the merged row's own price but not that of its second member; 4 fits both
    assert sorted(r["seq"] for r in got.collect()) == [1, 3]


def test_upsert_rules(spark):
    schema = "unique_key string, title string, price double, detail_status string, source_confidence double, official_number string, resolution_method string"
    old = spark.createDataFrame([("a", "old", 5.0, "done", 0.9, "N", "x"), ("b", "only", 1.0, "done", 0.1, None, None)], schema)
    new = spark.createDataFrame([("a", "new", None, "not_checked", 0.5, "", "meta+unverified"), ("c", "c", 2.0, "not_checked", 0.2, None, None)], schema)
    got = {r["unique_key"]: r.asDict() for r in register.upsert(old, new, register.REGISTER_RULES).collect()}
    assert got["a"]["title"] == "new" and got["a"]["price"] == 5.0 and got["a"]["detail_status"] == "done" and got["a"]["source_confidence"] == 0.9
    assert got["a"]["official_number"] == "" and set(got) == {"a", "b", "c"}
    again = register.upsert(register.upsert(old, new, register.REGISTER_RULES), new, register.REGISTER_RULES)
    assert {r["unique_key"]: r.asDict() for r in again.collect()} == got


def test_section_snapshot(spark):
    at = F.lit("2026-01-02 00:00:00").cast("timestamp")
    old = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t"), ("d", "t")], "unique_key string, section string").withColumn("observed_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    new = spark.createDataFrame([("a", "s"), ("c", "t")], "unique_key string, section string")
    done = spark.createDataFrame([("s", True), ("t", False)], "section string, complete boolean")
    got = {r["unique_key"]: r["observed_at"].day for r in freshness.section_snapshot(old, new, done, at).collect()}
    assert got == {"a": 2, "c": 2, "d": 1}


def test_due(spark):
    rows = spark.createDataFrame([(k, "u") for k in "abcdef"], "key string, url string")
    now = dt.datetime(2026, 1, 10)
    ago = lambda h: now - dt.timedelta(hours=h)
    cache = spark.createDataFrame([("a", "u", "ok", ago(10), 1), ("b", "u", "error", ago(30), 1), ("c", "v", "ok", ago(1), 1), ("d", "u", "empty", ago(30), 1), ("e", "u", "ok", ago(200), 1)], "key string, url string, status string, checked_at timestamp, version int")
    got = [r["key"] for r in freshness.due(rows, cache, F.lit(now), 10).collect()]
    assert got == ["c", "f", "b", "d", "e"]


def test_requirement_lines(spark):
    """The number right after the operator counts; bare words `от` and `до` compare nothing."""
    lines = ["Кабель 3 жилы не менее 10 м", "Объём ≥ 500 мл", "Длина от стены 5 м", "Вес до 10 кг", "Ресурс: не  более 10 000 стр.", "Цвет: белый", "Класс = 1,5", "мощность БОЛЕЕ 2 кВт", "без названия"]
    items = spark.createDataFrame([(1, ";".join(lines) + "\n ; ."), (2, None)], "line_id int, required_specs string")
    got = [tuple(r) for r in requirements.parse_requirements(items, ["line_id"]).orderBy("n").select("name", "op", "number", "unit", "value").collect()]
    assert got == [
        ("Кабель 3 жилы", ">=", 10.0, "m", None), ("Объём", ">=", 500.0, None, None), ("", None, None, None, None), ("", None, None, None, None), ("Ресурс", "<=", 10000.0, "pages", None),
        ("Цвет", None, None, None, "белый"), ("Класс", "=", 1.5, None, None), ("мощность", ">", 2.0, "kw", None), ("", None, None, None, None),
    ]


def test_requirements(spark):
    items = spark.createDataFrame([(1, "Мощность не менее 2 кВт; Цвет: белый; Вес до 10 кг"), (2, "")], "line_id int, required_specs string")
    req = requirements.parse_requirements(items, ["line_id"])
    attributes = spark.createDataFrame([("p", 0, "Мощность", "2500 кВт", 2.5, None), ("p", 1, "Цвет", "белый", None, None), ("q", 0, "Мощность", "1 kg", None, None), ("q", 1, "Мощность", "9 кВт", None, None)], "product_id string, seq int, name string, value string, number double, unit string")
    candidates = spark.createDataFrame([(1, "p"), (1, "q"), (1, "none"), (2, "p")], "line_id int, product_id string")
    checks = requirements.check_requirements(req, attributes, candidates)
    got = {(r["line_id"], r["product_id"], r["n"]): r["verdict"] for r in checks.collect()}
    # of equal attributes the first decides, whose unit can't be compared
    assert got == {(1, "p", 0): "pass", (1, "p", 1): "pass", (1, "p", 2): "unknown", (1, "q", 0): "unknown", (1, "q", 1): "unknown", (1, "q", 2): "unknown", (1, "none", 0): "unknown", (1, "none", 1): "unknown", (1, "none", 2): "unknown", (2, "p", -1): "unknown"}
    assert {(r["line_id"], r["product_id"]): r["status"] for r in requirements.compliance(checks).collect()} == {(1, "p"): "conditional", (1, "q"): "conditional", (1, "none"): "conditional", (2, "p"): "conditional"}


def test_requirements_by_text(spark):
    items = spark.createDataFrame([(1, "Ресурс не менее 10 000 стр; Цвет: черный; совместим с HP; Объем: 2 ГБ; Совместим с HP-2035N, Европа: да")], "line_id int, required_specs string")
    req = requirements.parse_requirements(items, ["line_id"])
    attributes = spark.createDataFrame([("p", 0, "Цвет", "Черный матовый", None, None), ("q", 0, "Цвет", "белый", None, None)], "product_id string, seq int, name string, value string, number double, unit string")
    texts = spark.createDataFrame([("p", "Картридж 5 шт", "Картридж 12 тыс., совместим с HP 2035N"), ("q", "Картридж 9,5k", "нет")], "product_id string, title string, text string")
    candidates = spark.createDataFrame([(1, "p"), (1, "q")], "line_id int, product_id string")
    got = {(r["product_id"], r["n"]): r["verdict"] for r in requirements.check_requirements(req, attributes, candidates, texts=texts).collect()}
    assert got == {("p", 0): "pass", ("p", 1): "pass", ("p", 2): "pass", ("p", 3): "unknown", ("p", 4): "unknown", ("q", 0): "fail", ("q", 1): "fail", ("q", 2): "unknown", ("q", 3): "unknown", ("q", 4): "fail"}


def test_reconciled_names(spark):
    """Brute force over one case at a time: names that differ by their ratio, codes that differ, repeated names of a source."""
    from difflib import SequenceMatcher

    from noticeflow.operators import cases

    names = ["Насос центробежный 28.13.11.110", "насос  центробежный", "Насос центробежный 28.13.11.120", "Труба стальная", "Насос погружной"]
    rows = [(1, 1, "2", names[0], "a", "", 1), (1, 1, "2", names[1], "b", "мощность", 2), (1, 1, "2", names[2], "c", "", 3), (1, 2, "1", names[3], "a", "", 4), (1, 2, "1", names[4], "b", "", 5), (1, 3, "1", names[3], "a", "", 6), (2, 1, "1", names[3], "a", "", 7), (2, 1, "1", names[3], "b", "", 8)]
    merged, conflicts = cases.reconcile_items(spark.createDataFrame(rows, "case_id int, line_id int, quantity string, name string, source string, required_specs string, seq int"))
    assert sorted((r["case_id"], r["line_id"], r["seq"]) for r in merged.collect()) == [(1, 1, 2), (1, 2, 4), (2, 1, 7)]
    # the third name of line 1 is compared with the second one's, which took its place and has no code
    assert sorted((r["case_id"], r["line_id"]) for r in conflicts.collect()) == [(1, 2)]
    rows = [(1, 1, "1", "насос", "a", "", 1), (1, 2, "1", "Насос", "a", "", 2), (1, 2, "1", "фильтр", "a", "", 3), (1, None, None, None, None, None, 4), (1, None, None, "x", "a", None, 5)]
    merged, conflicts = cases.reconcile_items(spark.createDataFrame(rows, "case_id int, line_id int, quantity string, name string, source string, required_specs string, seq int"))
    assert sorted(r["seq"] for r in merged.collect()) == [1, 3, 4]
    assert [r["line_id"] for r in conflicts.collect()] == [None]
    assert SequenceMatcher(None, "труба стальная", "насос погружной").ratio() < 0.8


def test_items_are_replayed_across_batches(spark):
    """An item stands once, also where a number repeats; its row comes from the replay, not by a join."""
    from noticeflow.operators import cases

    rows = [(c, k % 7, "1", ["насос", "труба", "кран", None][k * k % 4], "ab"[k // 2 % 2], "x" if k % 5 == 4 else "", k) for c in (1, 2, 3) for k in range(40)]
    rows += [(4, 1, "1", "насос", "a", "", 1), (4, 1, "1", "насос", "a", "x", 1)]
    items = spark.createDataFrame(rows, "case_id int, line_id int, quantity string, name string, source string, required_specs string, seq int")
    shown = lambda tables: [sorted(map(str, t.collect())) for t in tables]
    merged, conflicts = cases.reconcile_items(items)
    whole = shown((merged, conflicts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert shown(cases.reconcile_items(items)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in merged.where("case_id = 4").collect()] == [(4, 1, "1", "насос", "a", "x", 1)]
    assert merged.where("case_id < 4").count() == 3 * merged.where("case_id = 1").count() > 0
    assert "Join" not in merged._jdf.queryExecution().executedPlan().toString()


def test_bounds_of_the_ratio():
    from difflib import SequenceMatcher

    from noticeflow.operators.cases import names_differ

    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 14)))
        b = "".join(c for c in a if rng.random() < 0.9) + "".join(rng.choice("abx") for _ in range(rng.randrange(0, 3)))
        assert names_differ(a, b) == (SequenceMatcher(None, a, b).ratio() < 0.8)


def test_risks_and_decision(spark):
    D = "decimal(18,2)"
    cases = spark.createDataFrame([(1, True, True, 60, 5)], "case_id int, own_delivery boolean, requires_installation boolean, payment_days int, delivery_days int")
    cases = cases.withColumns({"start_price": F.lit(200).cast(D), "planned_bid": F.lit(None).cast(D)})
    items = spark.createDataFrame([(1, 1, True), (1, 2, True)], "case_id int, line_id int, mandatory boolean").withColumn("quantity", F.lit(1).cast(D))
    offers = spark.createDataFrame([(1, 1, 0, False, "exact", 9, "")], "case_id int, line_id int, seq int, selected boolean, compliance_status string, lead_days int, evidence string").withColumns({"unit_cost_gross": F.lit(100).cast(D), "vat_rate": F.lit(0).cast("decimal(5,2)")})
    expenses = spark.createDataFrame([(1, "other", False)], "case_id int, category string, confirmed boolean").withColumn("amount_gross", F.lit(10).cast(D))
    lines = economics.case_lines(items, offers)
    risks = economics.case_risks(cases, lines, expenses, 30)
    assert {r["text"] for r in risks.collect()} == {"delivery_cost", "delivery_quote", "installation_cost", "installation_quote", "payment_days:60", "product:2", "no_evidence:1", "lead_days:1", "unconfirmed:other"}
    t = economics.decide(economics.case_totals(cases, lines, expenses), risks).first()
    assert (t["decision"], t["reason"], float(t["target_price"]), float(t["floor_price"])) == ("blocked", "missing_products", 140.0, 122.0)


def test_rollup_and_verdict(spark):
    health = spark.createDataFrame([("a", "ok"), ("b", "error"), ("c", "skipped"), ("d", "partial")], "source string, status string")
    r = report.run_rollup(health).first()
    assert (r["good"], r["partial"], r["bad"], r["detail"], r["status"]) == (1, 1, 1, "b: error", "partial")
    ages = spark.createDataFrame([("run", 30.0), ("mail", 1.0)], "event_type string, age_hours double")
    v = report.health_verdict(ages, {"run": 26, "mail": 30, "sync": 8}).first()
    assert v["problems"] == ["run", "sync"] and not v["healthy"]


def test_no_quadratic_join(spark):
    """Plans over two data-sized tables hold neither a Cartesian product nor a nested loop."""
    q = spark.range(10).selectExpr("id as query_id", "'насос' as query")
    p = spark.range(10).selectExpr("id as product_id", "'s' as supplier_id", "'насос' as name", "'' as article", "'' as category", "1.0D as price", "0 as priority")
    plan = products.match_products(q, p)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_migrate_and_append_once(spark):
    from noticeflow.operators import links

    old = spark.createDataFrame([(" 5 ", "x")], "`Цена` string, `Имя` string")
    got = register.migrate(old, {"price": ["цена"], "name": ["имя"]}, {"name": "string", "price": "int", "new": "date"})
    assert [tuple(r) for r in got.collect()] == [("x", 5, None)] and got.columns == ["name", "price", "new"]
    runs = spark.createDataFrame([("r1", 1)], "stamp string, n int")
    more = spark.createDataFrame([("r1", 2), ("r2", 3), ("r2", 4)], "stamp string, n int")
    assert sorted(tuple(r) for r in links.append_once(runs, more, ["stamp"], [F.desc("n")]).collect()) == [("r1", 1), ("r2", 4)]


def test_suppliers_of_requests(spark):
    from noticeflow.operators import customers

    requests = spark.createDataFrame([(1, 1, "A", "new"), (1, 2, "", "new"), (2, 1, "B", "new"), (3, 1, "C", "new")], "line_id int, n int, supplier string, status string")
    change = spark.createDataFrame([(1, "Z", "sent"), (2, "Y", "sent"), (3, "C", "sent")], "line_id int, supplier string, status string")
    got = sorted(tuple(r) for r in customers.assign_supplier(change, requests).collect())
    assert got == [(1, 1, "A", "new"), (1, 2, "Z", "sent"), (2, 1, "B", "new"), (2, 2, "Y", "sent"), (3, 1, "C", "sent")]
    ids = customers.with_suffixes(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "supplier_id string, seq int"), spark.createDataFrame([("a", 1)], "supplier_id string, n int"))
    assert sorted(r["new_id"] for r in ids.collect()) == ["a-2", "a-3", "b"]


def test_table_items(spark):
    from noticeflow.operators import cases

    rows = [(1, "t", 1, ["№", "Наименование", "ОКПД", "Характеристика", "Значение", "Ед", "Кол-во"]), (1, "t", 2, ["1.", "Насос", "x", "Мощность", "2 кВт", "шт", "3"]), (1, "t", 3, ["", "", "", "Цвет", "белый", "", ""]), (1, "t", 4, ["2", "Труба", "x", "", "", "м", "4,5"])]
    got = cases.table_items(spark.createDataFrame(rows, "case_id int, `table` string, `row` int, cells array<string>")).collect()
    assert sorted((r["line_id"], r["name"], r["quantity"], r["unit"], r["required_specs"]) for r in got) == [("1", "Насос", "3", "шт", "Мощность: 2 кВт; Цвет: белый"), ("2", "Труба", "4.5", "м", "")]


def test_carry_and_history(spark):
    from noticeflow.operators import cases

    profile = spark.createDataFrame([("A", 0, "насос", 0)], "category string, cat_ord int, term string, term_ord int")
    defaults = spark.createDataFrame([("B", 0, "труба", 0)], profile.schema)
    required = spark.createDataFrame([("a", 9, "НАСОС", 0), ("C", 9, "котел", 0)], profile.schema)
    assert sorted(r["term"] for r in cases.build_dictionary(profile, defaults, required).collect()) == ["котел", "насос"]
    assert sorted(r["term"] for r in cases.build_dictionary(profile.limit(0), defaults, required).collect()) == ["НАСОС", "котел", "труба"]


def test_search_counts_only_asked_words(spark):
    """words that nothing asks for are not indexed, and equal queries are searched once."""
    from noticeflow.operators import search

    docs = spark.createDataFrame([(k, f"насос w{k} труба труба" if k % 2 else f"w{k} кран") for k in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Труба"), (2, "труба "), (3, "w7 труба"), (4, "нет"), (5, None)], "query_id long, query string")
    made = []
    real = search.stored
    search.stored = lambda df: made.append(real(df)) or made[-1]
    try:
        got = search.search_documents(docs, q, k=3)
    finally:
        search.stored = real
    index = next(t for t in made if t.columns == ["word", "id", "n"])
    assert {r["word"] for r in index.select("word").distinct().collect()} == {"труба", "w7"}
    posts = next(t for t in made if t.columns == ["list", "id", "value"])
    assert {r["list"]: r["count"] for r in posts.groupBy("list").count().collect()} == {"t:труба": 30, "p:труба": 30, "t:w7": 1, "p:w7 труба": 1}
    rows = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"], r["snippet"]) for r in got.collect())
    best = lambda k: [(k, n + 1, 2 * n + 1, 202, f"насос w{2 * n + 1} труба труба") for n in range(3)]
    assert rows == [*best(1), *best(2), (3, 1, 7, 103, "насос w7 труба труба"), (3, 2, 1, 2, "насос w1 труба труба"), (3, 3, 3, 2, "насос w3 труба труба")]


def test_evidence_pairs_come_once(spark, monkeypatch):
    """pairs by number and title, of keys with several titles and of titles with many notices, without a distinct over all pairs."""
    from noticeflow.operators import links

    monkeypatch.setattr(links, "SHARE", 3)
    n = [(k, "", "насос") for k in range(10)] + [(20, "abc-1", "труба"), (20, "abc-1", "Насос"), (21, "abc-1", ""), (22, None, None), (None, "abc-1", "насос"), (None, "", "кран"), (23, "abc-1", "насос")]
    d = [(1, "Насос abc-1"), (2, "насос, труба"), (3, "abc-1 кран"), (3, "насос"), (4, None), (5, "abc-1")]
    got = links.apply_evidence(spark.createDataFrame(n, "unique_key int, tender_number string, title string"), spark.createDataFrame(d, "doc_id int, text string"))
    fold = lambda x: (x or "").lower()
    want = {(k, i) for k, number, title in n for i, t in d if (title and fold(title) in fold(t)) or (number and number in fold(t).replace(",", "").split())}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # the join of a title's notices and documents is the last step of most pairs
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_terms_without_a_shuffle_of_texts(spark):
    """a text meets its terms where it lies, and is matched once for the dictionary and the stop terms."""
    from noticeflow.operators import cases, match

    docs = spark.createDataFrame([(1, "Насосы и трубы"), (1, "кран шаровой"), (2, None), (3, ""), (None, "насос")], "doc_id int, text string")
    terms = spark.createDataFrame([("насос",), ("кран шаровой",), ("шар",), ("нет",)], "term string")
    pairs = match.match_terms(docs, terms, "doc_id", "text")
    assert sorted(map(tuple, pairs.collect())) == [(1, "кран шаровой"), (1, "насос"), (1, "шар")]
    assert match.match_terms(docs, terms.limit(0), "doc_id", "text").count() == 0
    # the only join is that with the table's single row
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "rightHint=(strategy=broadcast)" in plan
    ranked = terms.selectExpr("term", "length(term) as term_ord")
    out = cases.document_evidence(docs.where("doc_id > 0"), ranked, ranked.withColumnRenamed("term_ord", "ord").where("term = 'шар'"), match.F.lit("x"))
    assert sorted(tuple(r) for r in out.select("doc_id", "terms", "stop_terms").collect())[0] == (1, ["шар", "насос", "кран шаровой"], ["шар"])
    assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()
