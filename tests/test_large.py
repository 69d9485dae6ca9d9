"""Queries against their SQL on small tables with what only larger ones hold by chance."""

import datetime as dt

import duckdb
import pytest

from noticeflow import plans
from noticeflow.operators import customers, economics, lineage
from noticeflow.sources import payloads

DAY = dt.datetime(1998, 1, 2)
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
PLACES = {"region": [(0, "ASIA"), (1, "EUROPE")], "nation": [(0, "a", 0), (1, "b", 1)], "customer": [(0, "Customer#0", 0, 1.0, "x"), (1, "Customer#1", 1, 1.0, "x")]}


def part(key, name="small ring", size=7):
    return key, name, "Brand#4", "x", size, 900.0 + key % 1000


def order(key, price, customer=0):
    return key, customer, "O", price, DAY, f"{key % 5}-P"


def line(key, number, part_key, quantity=5.0, price=10.0):
    return key, part_key, 1, number, quantity, price, 0.0, 0.0, "N", "O", DAY


@pytest.fixture
def compare(spark, tmp_path):
    def run(name, **tables):
        con = duckdb.connect()
        for t, rows in tables.items():
            spark.createDataFrame(rows, SCHEMAS[t]).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        shown = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
        con.execute(plans.ORACLE_SQL[name])
        names = [c[0] for c in con.description]
        want = shown(con.fetchall())
        got = shown(plans.QUERIES[name](spark, str(tmp_path)).select(*names).collect())
        assert got == want
        return got

    return run


def test_table_items_of_parts_with_one_name(compare):
    """two parts of one name and size give one item."""
    got = compare("cl_table", part=[part(1), part(2), part(3, size=8)], lineitem=[line(1, 1, 1), line(1, 1, 2), line(1, 1, 3), line(1, 2, 1), line(1, 1, 10_000_001)])
    assert len(got) == 3


def test_cards_link_by_pairs(compare):
    """each notice goes by its own links, also where first fit would part or carry over."""
    prices = [100.0, 100.0, 100.6, 101.4, 100.0, 100.9, 101.6, 100.0, 101.0, 99.5, 100.0]
    orders = [order(k, p, k % 2 if k > 8 else 0) for k, p in enumerate(prices, 8)] + [order(k + 7, p) for k, p in enumerate(prices, 20)]
    compare("dd_cards", **PLACES, part=[part(1)], orders=orders, lineitem=[line(o[0], 1, 1) for o in orders])


def test_merged_orders_of_one_card(compare):
    """an order merges with its copy, not with another order of the same card."""
    orders = [order(k, 100.0) for k in (10, 11, 12, 20, 30)]
    assert len(compare("dd_merge", **PLACES, part=[part(1)], orders=orders, lineitem=[line(o[0], 1, 1) for o in orders])) == 5


def test_requirements_of_shared_line_ids(compare):
    """a part key of seven digits gives one line_id to lines of different products."""
    got = compare("jn_requirements", part=[part(5), part(1_000_005)], lineitem=[line(1, 1, 1_000_005), line(1, 2, 5), line(2, 1, 5)])
    assert len({r[0] for r in got}) == 2 and len(got) == 3


def test_procedures_are_parsed_once(spark):
    """one parse per procedure, whatever the number of fields, in as many tasks as there are; text nodes as XPath has them."""
    lots = "<s:lot a:b-c='1'><s:subject> </s:subject><s:startPrice>1,5</s:startPrice></s:lot><s:lot><s:subject>a &amp; <b>b</b> c</s:subject><s:startPrice><![CDATA[2]]></s:startPrice></s:lot><s:lot><s:startPrice/></s:lot>"
    xml = f"<x:a><s:procedure><s:registryNumber> 7 </s:registryNumber><s:currency>rub</s:currency><s:organizer><s:fullName>o<i>p</i></s:fullName></s:organizer><s:lots>{lots}</s:lots></s:procedure></x:a>"
    out, _ = payloads.read_procedures(spark.createDataFrame([("f", xml)], "file string, xml string"))
    r = out.first()
    assert (r["title"], r["tender_number"], r["customer"], r["price"], r["lots"]) == ("a & ", "7", "op", 3.5, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and plan.count("EvalPython") == 1


def test_notice_xml_is_parsed_once(spark):
    """one parse per notice, whatever the number of tags."""
    rules = payloads.XmlRules(["notice"], {"title": ["empty", "name"], "tender_number": ["num"], "customer": ["who"]})
    xml = "<n:doc xmlns:n='u'><n:notice><n:num>1</n:num><n:empty/><n:in><n:name>a<b>b</b></n:name></n:in><n:name>c</n:name></n:notice></n:doc>"
    out, _ = payloads.read_notice_xml(spark.createDataFrame([("f", xml)], "file string, xml string"), rules)
    r = out.first()
    assert (r["title"], r["tender_number"], r["customer"]) == ("ab", "1", None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and plan.count("EvalPython") == 1


def test_items_that_share_a_number(compare):
    """F8: two lines of one part, number and supplier, one of them with specs, are one item."""
    got = compare("dd_items_merged", part=[part(1), part(2, name="hot bolt")], lineitem=[line(1, 1, 1), line(1, 1, 1, quantity=45.0), line(1, 3, 2), line(1, 1, 2)])
    assert len(got) == 2


def test_rss_items_are_taken_apart_once(spark):
    """an element is sought once per item, also where a filter needs it."""
    item = "<item><title>a &amp; b</title><guid>http://x/1</guid><description>&lt;p&gt;No: 7&lt;/p&gt;Price: 1,5&lt;br&gt;End: 05.06.2026</description></item>"
    feeds = spark.createDataFrame([("f", f"<rss><item><title/></item>{item}<item><title>t</title></item></rss>")], "file string, xml string").coalesce(1)
    out, _ = payloads.read_rss(feeds.repartition(2), {"tender_number": ["No"], "price": ["Price"], "deadline": ["End"]})
    r = out.collect()
    assert [(x["title"], x["tender_number"], x["price"], str(x["deadline"]), x["unique_key"]) for x in r] == [("a & b", "7", 1.5, "2026-06-05 00:00:00", "rss:7")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</title>") == 1 and plan.count("\\s*Price\\s*") == 1


def test_pages_of_a_small_file_go_to_all_tasks(spark, sf_dir):
    """pages are parsed in as many tasks as there are, though the file that they're made of has one part."""
    plan = plans.QUERIES["src_labels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1


def test_assigned_suppliers_in_one_pass(spark):
    """lines are sorted for one window and not read again for the rows that are added; large tables get more tasks."""
    req = spark.createDataFrame([(1, 1, "B", "new"), (1, 2, "", "new"), (2, 1, "B", "new"), (2, 4, "C", "old"), (3, 1, "A", "new")], "line_id long, n int, supplier string, status string")
    a = spark.createDataFrame([(1, "A", "sent"), (2, "A", "sent")], "line_id long, supplier string, status string")
    out = customers.assign_supplier(a, req)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "B", "new"), (1, 2, "A", "sent"), (2, 1, "B", "new"), (2, 4, "C", "old"), (2, 5, "A", "sent"), (3, 1, "A", "new")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Union" not in plan
    assert lineage.dealt(spark.range(100), "id", rows=10).rdd.getNumPartitions() == 10 and lineage.dealt(spark.range(100, numPartitions=2), "id").rdd.getNumPartitions() == 2


def test_risks_read_the_lines_once(spark):
    """F16: lines are read once for all their rules, and what they give is made different without a sort."""
    cases = spark.createDataFrame([(1, False, False, 60, 15), (2, False, False, 10, None)], "case_id long, own_delivery boolean, requires_installation boolean, payment_days int, delivery_days int")
    lines = spark.createDataFrame([(1, 1, True, None, None, None, None), (1, 2, True, 1.0, "conditional", "", 20), (1, 2, True, 1.0, "conditional", "", 20), (2, 1, True, 1.0, "exact", "x", 20)], "case_id long, line_id int, mandatory boolean, offer_unit_cost_gross double, offer_compliance_status string, offer_evidence string, offer_lead_days int")
    spent = spark.createDataFrame([(1, "other", 5.0, False)], "case_id long, category string, amount_gross double, confirmed boolean")
    out = economics.case_risks(cases, lines, spent)
    got = sorted((r["case_id"], *r["n"], r["kind"], r["text"]) for r in out.collect())
    assert got == [(1, 3, 0, "risk", "payment_days:60"), (1, 4, 1, "question", "product:1"), (1, 5, 2, "risk", "conditional:2"), (1, 6, 2, "risk", "no_evidence:2"), (1, 7, 2, "risk", "lead_days:2"), (1, 8, 0, "risk", "unconfirmed:other")]
    plan = out._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("offer_compliance_status") > 0 and plan.optimizedPlan().toString().count("Generate inline") == 1 and "SortAggregate" not in plan.executedPlan().toString().split("Initial Plan")[-1].split("Union")[0]


def test_pairs_of_a_common_title_go_to_many_tasks(spark, monkeypatch):
    """a title of many notices and documents is paired in shares of both, in tasks as many as the pairs need; nothing is broadcast by the size of its file."""
    from noticeflow.operators import links

    monkeypatch.setattr(links, "SHARE", 20)
    n = spark.range(200).selectExpr("id as unique_key", "'' as tender_number", "if(id < 190, 'red ring', concat('ring ', id)) as title")
    out = links.apply_evidence(n, spark.range(300).selectExpr("id as doc_id", "concat('a red ring ', id) as text"))
    sizes = [len(list(p)) for p in out.rdd.glom().collect()]
    assert sum(sizes) == 190 * 300 + 10 and max(sizes) < 190 * 300 / 20 and len(sizes) > 100
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_row") and "strategy=merge" in plan


def test_words_that_hold_a_token_are_not_kept(spark, monkeypatch):
    """what is kept of a text are the counts of what queries ask for, whatever words it stands in; also of what lists no query can use."""
    from noticeflow.operators import search

    made = []
    real = search.stored
    monkeypatch.setattr(search, "stored", lambda df: made.append(real(df)) or made[-1])
    docs = spark.range(60).selectExpr("id as doc_id", "concat('red', id, ' red', id + 1, ' xred ring', repeat(' red ring', int(id % 7))) as text")
    q = spark.createDataFrame([(1, "red"), (2, "red ring")], "query_id long, query string")
    got = search.search_documents(docs, q, k=4)
    index = next(t for t in made if t.columns == ["word", "id", "n"])
    assert {r["word"] for r in index.collect()} == {"red", "ring"} and index.count() == 120
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    score = {1: lambda t: 101 * t.count("red"), 2: lambda t: 100 * t.count("red ring") + t.count("red") + t.count("ring")}
    want = {(k, d, f(text[d]), n + 1) for k, f in score.items() for n, d in enumerate(sorted(text, key=lambda d: (-f(text[d]), d))[:4])}
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in got.collect()} == want
    # with an index of words
    again = search.search_documents(docs, q, k=4, index=search.document_index(docs))
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in again.collect()} == want


def test_requirements_are_read_once(spark, sf_dir, monkeypatch):
    """equal specifications are parsed once, lines are read for candidates and requirements only, and a product's attributes meet them as one row."""
    from noticeflow.operators import requirements

    made = []
    real = requirements.stored
    monkeypatch.setattr(requirements, "stored", lambda df: made.append(real(df)) or made[-1])
    items = spark.range(50).selectExpr("id as line_id", "if(id % 2 = 0, 'Длина ≥ 50 см; Цвет: красный', null) as required_specs")
    req = requirements.parse_requirements(items, ["line_id"])
    assert req.count() == 50 and made[0].count() == 2
    attributes = spark.createDataFrame([(1, 0, "Длина", "7 м", None, None), (1, 1, "Длина", "1 м", None, None), (2, 0, "Цвет", "Красный мак", None, None)], "product_id long, seq int, name string, value string, number double, unit string")
    both = items.crossJoin(spark.createDataFrame([(1,), (2,), (3,)], "product_id long"))
    got = requirements.check_requirements(req, attributes, both.union(both))
    rows = {(r["line_id"] % 2, r["product_id"], r["n"], r["verdict"], r["reason"]) for r in got.collect()}
    none = "нет характеристики"
    want = {(0, 1, 0, "pass", "Длина: 7 м"), (0, 1, 1, "unknown", none), (0, 2, 0, "unknown", none), (0, 2, 1, "pass", "Цвет: Красный мак"), (0, 3, 0, "unknown", none), (0, 3, 1, "unknown", none)}
    assert rows == want | {(1, p, -1, "unknown", "нет требований") for p in (1, 2, 3)} and got.count() == 25 * 3 * 3
    plan = plans.QUERIES["jn_requirements"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2 and "max_by" not in plan and plan.count("RLIKE") == 1  # that of the pages a product tells
