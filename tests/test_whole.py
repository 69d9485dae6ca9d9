"""Queries and jobs that do the whole of their task, on small tables against brute force."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from noticeflow import plans
from noticeflow.operators import dedup
from noticeflow.streaming import archives


@pytest.fixture
def table(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def first_match(text, term):
    """A phrase of short words: literally, or each word's first place after the one before, at most 20 characters off."""
    if term in text:
        return True
    at = 0
    for n, word in enumerate(term.split()):
        m = re.compile(rf"(?<![\w-]){word}(?![\w-])").search(text, at)
        if m is None or n and m.start() - at > 20:
            return False
        at = m.end()
    return True


def test_terms_with_a_gap(spark, table):
    texts = ["of all the", "of the", "of " + "x" * 18 + " the", "of " + "x" * 19 + " the", "of one of the", "the of", "off the", "en casa la", "of-the", "of, (the)", ""]
    got = plans.QUERIES["cl_terms"](spark, table("documents", list(enumerate(texts)), "doc_id long, text string"))
    found = {(r["doc_id"], r["term"]) for r in got.collect() if " " in r["term"]}
    assert found == {(i, t) for i, x in enumerate(texts) for t in ("of the", "en la") if first_match(x, t)}
    assert {(0, "of the"), (2, "of the"), (7, "en la")} <= found and (3, "of the") not in found


def test_tokens_after_the_first_thousands(spark, table):
    text = "aa " * 1500 + "late"
    r = plans.QUERIES["fn_tokens"](spark, table("documents", [(1, text)], "doc_id long, text string")).first()
    assert r["n_tokens"] == 2 and r["title_key"].endswith("late") and len(r["title_key"]) == 3004


def test_evidence_of_short_and_spaced_texts(spark, table):
    texts = ["red ring", "a  red  ring for sale", "ring", "bored ring", ""]
    got = plans.QUERIES["jn_evidence"](spark, table("documents", list(enumerate(texts)), "doc_id long, text string"))
    norm = [" ".join(t.split()) for t in texts]
    title = [" ".join(t[:24].split()) for t in texts]
    want = {(i, j) for i, t in enumerate(title) for j, x in enumerate(norm) if t and t in x}
    assert {(r["k"], r["doc_id"]) for r in got.collect()} == want and {(0, 1), (2, 3), (1, 1)} <= want


def test_every_line_and_organization(spark, sf_dir):
    lines = plans.QUERIES["jn_requirements"](spark, sf_dir)
    assert lines.select("line_id").distinct().count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    actions = {r["action"]: r["count"] for r in plans.QUERIES["up_queue"](spark, sf_dir).groupBy("action").count().collect()}
    assert actions["update"] > 20 and actions["append"] > 20


def test_all_tax_scenarios(spark, sf_dir):
    got = plans.QUERIES["ec_taxes"](spark, sf_dir)
    assert {r["count"] for r in got.groupBy("case_id").count().collect()} == {3}
    vat = got.where("scenario = 'vat'")
    assert vat.where("tax is not null").count() == 0 < vat.count()
    # prices carry 22 % of VAT
    gross = got.where("scenario = 'simplified_10'").select("case_id", F.col("revenue_net").alias("gross"))
    assert vat.join(gross, "case_id").where("abs(revenue_net * 1.22 - gross) > 0.01").count() == 0


def test_merge_equals_sorted_lists(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(40), rng.choice([10, 20, 20]), rng.choice(["", None, f"c{rng.randrange(5)}"]), rng.choice([None, float(rng.randrange(9))]), rng.choice([None, "", "a", "ab", "b", "xay"])) for i in range(600)]
    df = spark.createDataFrame(rows, "seq long, cluster long, rank int, customer string, price double, raw_text string")
    got = {r["cluster"]: r for r in dedup.merge_clusters(df, "cluster", "rank", ["customer"], ["price"], ["raw_text"]).collect()}
    for k in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0]))
        lines = ""
        for t in (r[5] for r in group if r[5]):
            lines = t if lines == "" or lines in t else lines if t in lines else f"{lines}\n{t}"
        want = (group[0][0], next((r[3] for r in group if r[3]), None), max((r[4] for r in group if r[4] is not None), default=None), lines)
        assert (got[k]["seq"], got[k]["customer"], got[k]["price"], got[k]["raw_text"]) == want
    assert len(got) == len({r[1] for r in rows})


def test_versions_equal_sorted_lists(spark):
    rng = random.Random(12)
    day = dt.datetime(2026, 1, 1)
    rows = [(i, f"n{rng.randrange(30)}", rng.choice([None, day + dt.timedelta(days=rng.randrange(5))]), rng.choice(["?", "real", "other"]), rng.choice([None, "", f"c{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, tender_number string, published_at timestamp, title string, customer string")
    for r in dedup.latest_versions(df, filled=["customer"], placeholder="?").collect():
        group = sorted((x for x in rows if x[1] == r["tender_number"]), key=lambda x: (x[2] is not None, x[2] or day, x[0]), reverse=True)
        assert (r["seq"], r["title"], r["customer"]) == (group[0][0], next((x[3] for x in group if x[3] != "?"), "?"), next((x[4] for x in group if x[4]), None))


CARD = "seq long, title string, deadline timestamp, price double, region_bucket string, source string, tender_number string, official_number string"


def naive_cards(rows):
    """First fit over all clusters in order; rows: seq, price, region, source, number, official."""
    clusters, out = [], {}
    for r in sorted(rows):
        for c in clusters:
            prices, numbers = [x[1] for x in [*c, r]], {(x[3], x[4]) for x in [*c, r]}
            if max(prices) - min(prices) < 1.0 and len({x[2] for x in [*c, r]} - {""}) < 2 and len({s for s, _ in numbers}) == len(numbers) and len({x[5] for x in [*c, r]} - {""}) < 2:
                break
        else:
            clusters.append(c := [])
        c.append(r)
        out[r[0]] = c[0][0]
    return out


def cards(spark, rows):
    day = dt.datetime(2026, 1, 1)
    full = [(s, "t", day, p, g, src, n, o or None) for s, p, g, src, n, o in rows]
    return {r["seq"]: r["cluster"] for r in dedup.card_clusters(spark.createDataFrame(full, CARD)).select("seq", "cluster").collect()}


def test_cards_equal_first_fit(spark):
    rng = random.Random(5)
    rows = [(i, 10 + rng.randrange(40) / 10, rng.choice(["", "", "e", "w"]), rng.choice("abc"), str(rng.randrange(6)), rng.choice(["", "", "N", "M"])) for i in range(700)]
    rng.shuffle(rows)
    assert cards(spark, rows) == naive_cards(rows)


def test_a_hot_band_has_no_cap(spark):
    rows = [(i, 10.0, "", "a", str(i % 9000), "") for i in range(21_000)]
    assert cards(spark, rows) == {i: i % 9000 for i in range(21_000)}


def naive_official(rows):
    clusters = []
    for seq, source, own, off in sorted(rows):
        cur = [[seq], {source}, {off} - {None}, {own}]
        while found := next((c for c in clusters if (c[2] & (cur[2] | cur[3]) or cur[2] & c[3]) and not c[1] & cur[1] and len(c[2] | cur[2]) < 2), None):
            clusters.remove(found)
            cur = [found[0] + cur[0]] + [a | b for a, b in zip(found[1:], cur[1:], strict=True)]
        clusters.append(cur)
    return {s: min(c[0]) for c in clusters for s in c[0]}


def test_official_equals_replay(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("abcd"), rng.choice(["k", f"z{i}"]), rng.choice([None, "k"])) for i in range(400)]
    got = dedup.official_clusters(spark.createDataFrame(rows, "seq long, source string, tender_number string, official_number string"))
    assert {r["seq"]: r["cluster"] for r in got.collect()} == naive_official(rows)


def test_official_bucket_of_fifty_thousand(spark):
    rows = spark.range(50_000).selectExpr("id as seq", "concat('s', id % 3) as source", "concat('z', id) as tender_number", "'k' as official_number")
    got = dedup.official_clusters(rows).groupBy("cluster").count()
    assert got.count() == 16_667 and got.agg(F.max("count")).first()[0] == 3


def test_retry_asks_for_every_failed_file(spark):
    asked = []

    class Reader:
        read = property(lambda self: self)
        format = lambda self, kind: self

        def load(self, paths):
            asked.extend(paths)
            return spark.createDataFrame([], "path string, content binary")

    rejects = spark.range(10_050).select(F.concat(F.lit("/x/"), "id").alias("path"))
    blocks = list(archives.retry(Reader(), rejects.union(rejects)))
    assert len(blocks) == 11 and sorted(asked) == sorted(f"/x/{i}" for i in range(10_050))
