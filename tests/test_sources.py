"""Files, payloads, pages, sinks and streams on inputs that the tests write."""

import json
import zipfile

from pyspark.sql import functions as F

from noticeflow.operators.register import REGISTER_RULES
from noticeflow.sources import files, pages, payloads, sinks
from noticeflow.streaming import alerts, archives
from noticeflow.streaming import register as live


def test_delimited(spark, tmp_path):
    (tmp_path / "My File.csv").write_text('﻿Название;Ссылка;Номер;Сумма;Срок подачи\n"Насос; большой";;7;1 000,5;05.06.2026\nБез номера;;;1;\n;http://x/1;8;1;\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("title,number,source\nA,1,Портал\n", encoding="utf-8")
    notices, rejects = files.read_delimited(spark, str(tmp_path))
    got = {r["unique_key"]: r.asDict() for r in notices.collect()}
    assert got["import-my-file:7"]["title"] == "Насос; большой" and got["import-my-file:7"]["price"] == 1000.5 and got["import-my-file:7"]["url"].startswith("import://")
    assert got["import-portal:1"]["status"] == "Актуально" and len(got) == 2
    assert sorted(r["reason"] for r in rejects.collect()) == ["no_number_or_url", "no_title"]


def test_delimited_over_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Название;Номер;Описание\r\n"Насос; ""x""\nвторой";1;"первая\n\nвторая; часть"\r\n\r\nТруба;2\r\nЛишнее;3;x;y;z\r\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('title,number,"raw text"\n"A\nB",4,"c;d"\n', encoding="utf-8")
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    notices, rejects = files.read_delimited(spark, str(tmp_path))
    got = {r["tender_number"]: (r["title"], r["raw_text"]) for r in notices.collect()}
    assert got == {"1": ('Насос; "x"\nвторой', "первая\n\nвторая; часть"), "2": ("Труба", "Труба 2"), "3": ("Лишнее", "x"), "4": ("A\nB", "c;d")}
    assert rejects.count() == 0


def test_grid(spark):
    cells = [("f", "s", 1, 1, "отчет"), ("f", "s", 3, 1, "Артикул"), ("f", "s", 3, 2, "Наименование"), ("f", "s", 3, 3, "Цена"), ("f", "s", 4, 1, "A1"), ("f", "s", 4, 2, "Насос"), ("f", "s", 4, 3, "10")]
    grid = spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string")
    r = files.read_cell_grid(grid, {"article": ["артикул"], "name": ["наименование"], "price": ["цена"]}, ["article", "name"]).collect()
    assert [(x["article"], x["name"], x["price"]) for x in r] == [("A1", "Насос", "10")]


def test_grid_cells_stay_apart(spark):
    """cells aren't shuffled by the few sheets and columns, and a row is put together by one aggregation."""
    grid = spark.range(6).selectExpr("'f' AS file", "'s' AS sheet", "CAST(1 + id div 2 AS INT) AS row", "CAST(id % 2 AS INT) AS col", "CASE id WHEN 0 THEN 'name' WHEN 1 THEN 'price' WHEN 5 THEN NULL ELSE 'v' || id END AS value")
    out = files.read_cell_grid(grid, {"name": ["name"], "price": ["price"]}, ["name"])
    assert sorted((r["row"], r["name"], r["price"]) for r in out.collect()) == [(2, "v2", "v3"), (3, "v4", None)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].lower()
    cells = plan[: plan.index("broadcasthashjoin")]
    assert "pivotfirst" not in plan and cells.count("hashpartitioning") == 1


def test_delimited_records_stay_in_their_tasks(spark, tmp_path):
    """files of several lines are small, and their records aren't gathered for the join with the headers."""
    rows = spark.range(250).selectExpr("id AS number", "'a' || chr(10) || id AS title").coalesce(1)
    sinks.write_case_csv(rows, str(tmp_path / "out"), F.lit(True), most_rows=100)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 3
    notices, _ = files.read_delimited(spark, str(tmp_path / "out"))
    assert notices.count() == 250
    plan = notices._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("BroadcastHashJoin") :]
    assert "BuildRight" in right and "Scan csv" not in right[right.index("BroadcastExchange") :]


def test_documents(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.txt").write_bytes("Привет".encode("cp1251"))
    (root / "y.html").write_text("<style>p{}</style><p>Тест &lt;</p>", encoding="utf-8")
    (root / "z.json").write_text('{"a": "x \\"y\\": \\u0444", "b": [1, -2.5, null, true, {"c": ""}], "d:": "e:"}', encoding="utf-8")
    (root / "bad.json").write_text('{"a": ', encoding="utf-8")
    (root / "t.csv").write_text('a;"b;c";;d\n"e ""f""";;;1,5\n', encoding="utf-8")
    got = {r["path"]: r for r in files.read_documents(spark, str(root)).collect()}
    assert got["z.json"]["text"] == 'x "y": ф 1 -2.5 true  e:' and got["bad.json"]["error"] == "bad_json" and got["bad.json"]["text"] is None
    assert got["t.csv"]["text"] == 'a b;c d e "f" 1,5'
    assert got["a/x.txt"]["text"] == "Привет" and got["a/x.txt"]["section"] == "a" and got["y.html"]["text"].startswith("Тест")
    assert all(r["doc_id"].startswith("kb-") and len(r["doc_id"]) == 19 for r in got.values())


def test_intake(spark):
    f = spark.createDataFrame([(1, "a.xlsx", 10, "h1", "S@x.ru"), (2, "b.xlsx", 10, "h1", "s@x.ru"), (3, "c.exe", 10, "h2", "s@x.ru"), (4, "d.csv", 10, "h3", "no@x.ru"), (5, "e.pdf", 10, "h4", "s@x.ru"), (6, "f.csv", 10**9, "h5", "s@x.ru"), (7, "g.csv", 1, "old", "s@x.ru")], "file_id int, name string, size long, sha256 string, sender string")
    got = files.accept_files(f, spark.createDataFrame([("sup", "s@x.ru")], "supplier_id string, sender string"), spark.createDataFrame([("old", "sup")], "sha256 string, supplier_id string"))
    assert {r["file_id"]: r["decision"] for r in got.collect()} == {1: "indexed", 2: "duplicate", 3: "bad_suffix", 4: "quarantine", 5: "stored", 6: "too_large", 7: "duplicate"}


def test_xml(spark):
    good = '<ns:doc xmlns:ns="u"><ns:notice><ns:num>5</ns:num><ns:name>Насос</ns:name><ns:sum>10.5</ns:sum><ns:date>2026-06-05</ns:date></ns:notice><ns:notice><ns:num>5</ns:num><ns:name>Еще</ns:name></ns:notice></ns:doc>'
    df = spark.createDataFrame([("a", good), ("b", "<!DOCTYPE x><notice/>")], "file string, xml string")
    rules = payloads.XmlRules(["notice"], {"title": ["title", "name"], "tender_number": ["num"], "price": ["sum"], "deadline": ["date"]})
    notices, rejects = payloads.read_notice_xml(df, rules)
    r = notices.collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["price"], str(r[0]["deadline"])) == ("Насос", 10.5, "2026-06-05 23:59:59") and rejects.count() == 1


def test_json(spark):
    body = json.dumps({"data": {"items": [{"id": 1, "name": "A", "sum": "10,5 руб", "kind": "x"}, {"id": 2, "name": "", "kind": "x"}, {"id": 3, "name": "B", "kind": "y"}]}})
    rules = payloads.JsonRules("data struct<items: array<struct<id: int, name: string, sum: string, kind: string>>>", "data.items", {"title": ["name"], "tender_number": ["id"], "price": ["sum"]}, "j", allow=("kind", ["x"]), raw=["name", "kind"])
    r = payloads.read_notice_json(spark.createDataFrame([(body,)], "payload string"), rules).collect()
    assert [(x["unique_key"], x["price"], x["raw_text"]) for x in r] == [("j:1", 10.5, "A x")]


HTML = '<div class="card big"><a href="/t/1#x">Насос № 17</a><b class="who">Завод</b><i class="sum">5 000 руб.</i></div><div class="card"><p>пусто</p></div><table><tr><td>Заказчик:</td><td>Завод</td></tr><tr><td>Место</td><td>информация отсутствует</td></tr><tr><td>Адрес</td><td>Город</td></tr></table><a href="http://other.org/q">q</a><a href="mailto:x">m</a>'


def test_pages(spark):
    p = spark.createDataFrame([(1, "http://www.x.ru/list", HTML), (2, "http://x.ru", None), (3, None, "<a href='/z'>"), (4, "http://x.ru", HTML)], "page_id long, url string, html string")
    r = [x for x in pages.extract_listings(p, pages.ListingRules(".card", "a", ".who", ".sum")).collect() if x["page_id"] == 1]
    assert [(x["title"], x["url"], x["tender_number"], x["customer"], x["price"]) for x in r] == [("Насос № 17", "http://www.x.ru/t/1#x", "17", "Завод", 5000.0)]
    v = {x["page_id"]: x for x in pages.extract_label_values(p, {"customer": ["Заказчик"], "place": ["Место", "Адрес"]}).collect()}
    assert (v[1]["customer"], v[1]["place"]) == ("Завод", "Город")
    links = pages.extract_links(p, hosts=["x.ru"]).where("page_id = 1").collect()
    assert [x["link"] for x in links] == ["http://www.x.ru/t/1#x"]
    assert {(x["page_id"], x["copies"]) for x in pages.unparsed_pages(p, p.where("page_id = 3")).collect()} == {(1, 2), (2, 1)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.5)], "title string, price double")
    assert [json.loads(r["value"]) for r in sinks.notices_json(df).collect()] == [{"title": "a", "price": None}, {"title": "b", "price": 1.5}]
    t = str(tmp_path / "t")
    sinks.publish(df, t)
    sinks.publish(df.where("title = 'b'"), t)
    assert [r["title"] for r in sinks.current(spark, t).collect()] == ["b"]


def test_archives(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    with zipfile.ZipFile(src / "a.zip", "w") as z:
        z.writestr("1.xml", "<x>1</x>")
        z.writestr("2.xml", "<x>2</x>")
        z.writestr("skip.txt", "no")
    (src / "bad.zip").write_bytes(b"nothing")
    go = lambda: archives.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "rej"), str(tmp_path / "ck"))
    go()
    go()  # files are seen once
    assert sorted(r["xml"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["<x>1</x>", "<x>2</x>"]
    rejects = spark.read.parquet(str(tmp_path / "rej"))
    assert [r["error"] for r in rejects.collect()] == ["not_an_archive"]
    with zipfile.ZipFile(src / "bad.zip", "w") as z:
        z.writestr("3.xml", "<x>3</x>")
    assert [r["xml"] for part in archives.retry(spark, rejects) for r in part.collect()] == ["<x>3</x>"]


def test_a_batch_of_archives_is_opened_once(spark, tmp_path, monkeypatch):
    """Forty files, one of them broken, in a batch: each is opened once."""
    src, opened = tmp_path / "in", tmp_path / "opened"
    src.mkdir()
    opened.mkdir()
    for k in range(39):
        with zipfile.ZipFile(src / f"{k}.zip", "w") as z:
            z.writestr(f"{k}.xml", f"<x>{k}</x>")
    (src / "bad.zip").write_bytes(b"nothing")

    def noted(content):
        import uuid

        (opened / uuid.uuid4().hex).write_bytes(content)
        return content.decode()

    monkeypatch.setattr(archives, "xml_text", noted)
    archives.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "rej"), str(tmp_path / "ck"))
    want = sorted(f"<x>{k}</x>" for k in range(39))
    assert sorted(r["xml"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    assert [r["error"] for r in spark.read.parquet(str(tmp_path / "rej")).collect()] == ["not_an_archive"]
    assert sorted(f.read_text() for f in opened.iterdir()) == want


def test_archives_of_folders(spark, tmp_path):
    """Each folder's newest files first, so many a batch; a folder that comes later is read then; failures of all are in one table."""
    import os

    def land(folder, k):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path := tmp_path / "in" / folder / f"{k}.zip", "w") as z:
            z.writestr(f"{folder}{k}.xml", f"<x>{k}</x>")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))

    def go():
        archives.ingest_folders(spark, str(tmp_path / "in"), ["a", "b", "c"], str(tmp_path / "out"), str(tmp_path / "rej"), str(tmp_path / "ck"), files_per_batch=2)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return {(r["folder"], r["batch"]): sorted(x["member"] for x in rows if (x["folder"], x["batch"]) == (r["folder"], r["batch"])) for r in rows}, len(rows)

    for k in range(3):
        land("a", k)
    land("b", 0)
    first = {("a", 0): ["a1.xml", "a2.xml"], ("a", 1): ["a0.xml"], ("b", 0): ["b0.xml"]}
    assert go() == (first, 4)
    assert spark.read.parquet(str(tmp_path / "rej")).count() == 0
    land("c", 0)
    land("b", 9)
    (tmp_path / "in" / "a" / "bad.zip").write_bytes(b"nothing")
    assert go() == go() == (first | {("b", 1): ["b9.xml"], ("c", 0): ["c0.xml"]}, 6)
    assert [(r["path"].rpartition("/")[2], r["folder"]) for r in spark.read.parquet(str(tmp_path / "rej")).collect()] == [("bad.zip", "a")]


def test_streams_of_folders_share_the_cores(spark, tmp_path, monkeypatch):
    """Of four streams on four cores, each reads a batch of forty small files in two tasks or less; the session's settings are as before."""
    for k in range(44):
        (tmp_path / "in" / (folder := "abcd"[k % 4 if k < 4 else 0])).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / f"{k}.xml").write_text(f"<x>{k}</x>")
    tasks, read = [], archives.unpacked
    monkeypatch.setattr(archives, "unpacked", lambda files, *limits: tasks.append(files.rdd.getNumPartitions()) or read(files, *limits))
    was = [spark.conf.get(k, None) for k in (archives.LOOKUPS, archives.READS)]
    archives.ingest_folders(spark, str(tmp_path / "in"), "abcd", str(tmp_path / "out"), str(tmp_path / "rej"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 44
    assert len(tasks) == 4 and max(tasks) <= 2
    assert [spark.conf.get(k, None) for k in (archives.LOOKUPS, archives.READS)] == was


def test_a_batch_of_archives_that_runs_again(spark, tmp_path):
    """A batch that was not committed leaves no failures that it no longer has."""
    (tmp_path / "in").mkdir()
    go = lambda: archives.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "rej"), str(tmp_path / "ck"))
    (tmp_path / "in" / "a.xml").write_text("<x>a</x>")
    go()
    (tmp_path / "in" / "b.xml").write_text("nothing")
    go()
    assert spark.read.parquet(str(tmp_path / "rej")).count() == 1
    for f in (tmp_path / "ck" / "commits").iterdir():
        if f.name.strip(".").split(".")[0] == "1":
            f.unlink()
    (tmp_path / "in" / "b.xml").write_text("<x>b</x>")
    go()
    assert sorted(r["xml"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["<x>a</x>", "<x>b</x>"]
    assert spark.read.parquet(str(tmp_path / "rej")).count() == 0


def test_encodings_of_archives():
    text = "<x>Насос</x>"
    declared = '<?xml version="1.0" encoding="koi8-r"?>' + text
    assert [archives.xml_text(b) for b in (text.encode(), text.encode("utf-8-sig"), text.encode("cp1251"), declared.encode("koi8-r"))] == [text, text, text, declared]
    assert archives.xml_text(b'<?xml encoding="none-such"?>\xcd') == '<?xml encoding="none-such"?>Н'


ROWS = [("a", 1, "excluded"), ("b", 2, "hot"), ("a", 3, "review"), ("a", 4, "hot"), ("b", 5, "excluded"), ("c", 6, None)]


def test_streams_equal_batches(spark, tmp_path):
    schema = "unique_key string, seq long, review_priority string"
    for k in range(3):
        spark.createDataFrame(ROWS[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = alerts.new_items(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start()
    q.awaitTermination()
    table = spark.createDataFrame(ROWS, schema)
    key = lambda df: sorted((r["key"], r["seq"], r["why"]) for r in df.collect())
    assert key(spark.table("alerts")) == key(alerts.new_items_batch(table)) == [("a", 1, "first"), ("a", 3, "promoted"), ("b", 2, "first"), ("c", 6, "first")]
    path = str(tmp_path / "register")
    live.stream_register(stream, path, str(tmp_path / "ck2"), REGISTER_RULES).awaitTermination()
    number, reg = live.register_version(spark, path, REGISTER_RULES)
    assert {r["unique_key"]: r["seq"] for r in reg.collect()} == {"a": 4, "b": 5, "c": 6}
    live.apply_batch(path, REGISTER_RULES, table.where("seq = 1"), number)  # a replay changes nothing
    assert live.register_version(spark, path, REGISTER_RULES)[0] == number
    assert reg.where(F.col("seq") == 4).count() == 1


def test_register_deltas_and_bases(spark, tmp_path, monkeypatch):
    """Folding deltas into bases gives what upserting batch by batch gives, whatever the number of batches between bases."""
    import random

    from noticeflow.operators.register import upsert

    rng = random.Random(1)
    rules = {"customer": "filled", "discovered_at": "kept", "confidence": "largest", "official_number": "official", "detail_status": "checked"}
    schema = "unique_key string, seq long, customer string, discovered_at string, confidence double, official_number string, detail_status string, resolution_method string, note string"
    pick = lambda *xs: rng.choice(xs)
    batches = [[(f"k{k}", 10 * b + k, pick(None, "", f"c{b}"), pick(None, f"d{b}"), pick(None, float(b), 1.0), pick(None, f"o{b}"), pick("not_checked", f"s{b}"), pick(None, "meta+unverified"), pick(None, f"n{b}")) for k in rng.sample(range(6), 4)] for b in range(5)]
    want = None
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        want = spark.createDataFrame(upsert(want if want is not None else df.limit(0), df, rules).collect(), schema)
    for compact in (2, 16):
        monkeypatch.setattr(live, "COMPACT", compact)
        path = str(tmp_path / f"register{compact}")
        for n, rows in enumerate(batches):
            live.apply_batch(path, rules, spark.createDataFrame(rows, schema), n)
        last, got = live.register_version(spark, path, rules)
        assert last == 4 and sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_broken_log_is_no_empty_register(spark, tmp_path):
    import pytest

    assert live.register_version(spark, str(tmp_path / "none"), {}) == (-1, None)
    (tmp_path / "r" / "done").mkdir(parents=True)
    (tmp_path / "r" / "done" / "part.json").write_text('{"batch": 0, "base": -1}')
    with pytest.raises(Exception, match="delta-0"):  # the delta is gone: an error, not a new register
        live.register_version(spark, str(tmp_path / "r"), {})


def test_rows_of_pages_are_not_gathered(spark, monkeypatch):
    """what a page gives goes on in small batches, all of it and in order."""
    monkeypatch.setattr(pages, "ROWS", 7)
    docs = spark.createDataFrame([(k, None, "".join(f"<a href='http://h/{k}/{n}'>{n}</a>" for n in range(k))) for k in range(40)] + [(99, "x", None)], "page_id int, url string, html string").coalesce(1)
    rows = [(r["page_id"], r["link"]) for r in pages.extract_links(docs).collect()]
    assert rows == [(k, f"http://h/{k}/{n}") for k in range(40) for n in range(k)]
