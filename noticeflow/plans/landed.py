"""Queries of sources and streams over payloads, grids and files that Spark derives from the given tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.register import REGISTER_RULES
from ..sources import files, payloads, sinks
from ..streaming.register import apply_batch, register_version, stream_register
from .queries import BATCHES, NOTICES, query
from .tables import batches, load, notices


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where that is unset, a local one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/noticeflow-work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {NOTICES} SELECT CAST(seq AS STRING) AS tender_number, title, customer, round(price, 2) AS price, substr(CAST(deadline AS STRING), 1, 10) || ' 23:59:59' AS deadline FROM n WHERE source <> 'copy'")
def src_xml(spark, sf):
    """SRC-02: notices read from XML texts, one per order."""
    n = notices(spark, sf).where("source <> 'copy'")
    tag = lambda t, c: F.concat(F.lit(f"<n:{t}>"), c, F.lit(f"</n:{t}>"))
    xml = F.concat(F.lit('<n:doc xmlns:n="u"><n:notice>'), tag("num", F.col("seq").cast("string")), tag("empty", F.lit("")), tag("name", "title"), tag("who", "customer"), tag("sum", F.format_string("%.2f", "price")), tag("end", F.date_format("deadline", "yyyy-MM-dd")), F.lit("</n:notice></n:doc>"))
    rules = payloads.XmlRules(["notice"], {"title": ["empty", "name"], "tender_number": ["num"], "customer": ["who"], "price": ["sum"], "deadline": ["end"]})
    out, _ = payloads.read_notice_xml(n.select(F.col("seq").cast("string").alias("file"), xml.alias("xml")), rules)
    return out.select("tender_number", "title", "customer", "price", F.date_format("deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"))


@query(f"WITH {NOTICES} SELECT 'json:' || CAST(seq AS STRING) AS unique_key, title, 'here' AS region, round(price, 2) AS price FROM n WHERE region <> 'ASIA'")
def src_json(spark, sf):
    """SRC-03: notices flattened from JSON payloads, one per region and source."""
    n = notices(spark, sf)
    item = F.struct(F.col("seq").alias("id"), F.col("title").alias("name"), F.format_string("%.2f", "price").alias("sum"), F.col("region").alias("kind"))
    body = n.groupBy("source", "region", F.col("seq") % 50).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("data"))).alias("payload"))
    rules = payloads.JsonRules("data struct<items: array<struct<id: long, name: string, sum: string, kind: string>>>", "data.items", {"title": ["name"], "tender_number": ["id"], "price": ["sum"]}, "json", allow=("kind", ["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"]), region="here")
    return payloads.read_notice_json(body.select("payload"), rules).select("unique_key", "title", "region", "price")


@query("SELECT 'f' || CAST(p_partkey % 5 AS STRING) AS file, p_name AS name, CAST(p_partkey AS STRING) AS article, CAST(p_size AS STRING) AS price FROM part")
def src_grid(spark, sf):
    """SRC-08: price lists read from cell grids whose header stands in the third row."""
    load(spark, sf, "part")
    p = spark.table("part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 5).cast("string")).alias("file"), F.lit("s").alias("sheet"), (F.col("p_partkey") + 4).cast("int").alias("row"), "p_name", "p_partkey", "p_size")
    cell = lambda k, v: F.struct(F.lit(k).alias("col"), v.cast("string").alias("value"))
    body = p.select("file", "sheet", "row", F.explode(F.array(cell(2, F.col("p_name")), cell(4, F.col("p_partkey")), cell(5, F.col("p_size")))).alias("c")).select("file", "sheet", "row", "c.*")
    head = p.select("file", "sheet").distinct().select("file", "sheet", F.lit(3).alias("row"), F.explode(F.array(cell(2, F.lit("Наименование")), cell(4, F.lit("Артикул")), cell(5, F.lit("Цена, руб")))).alias("c")).select("file", "sheet", "row", "c.*")
    roles = {"name": ["наименование"], "article": ["артикул"], "price": ["цена"]}
    return files.read_cell_grid(head.union(body), roles, ["name", "article"]).select("file", "name", "article", "price")


@query(
    """SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'too_large' WHEN doc_id % 7 = 0 THEN 'bad_suffix' WHEN doc_id % 5 = 0 THEN 'quarantine'
 WHEN doc_id <> min(doc_id) OVER (PARTITION BY text, doc_id % 5) THEN 'duplicate' WHEN doc_id % 2 = 0 THEN 'indexed' ELSE 'stored' END AS decision FROM documents"""
)
def src_intake(spark, sf):
    """SRC-13: decisions over incoming files."""
    load(spark, sf, "documents")
    d = spark.table("documents")
    i = F.col("doc_id")
    suffix = F.when(i % 7 == 0, "exe").when(i % 2 == 0, "csv").otherwise("pdf")
    f = d.select(i.alias("file_id"), F.concat(F.lit("a."), suffix).alias("name"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"), F.when(i % 5 == 0, "x@no.org").otherwise(F.concat(F.lit("S"), (i % 5).cast("string"), F.lit("@x.org"))).alias("sender"))
    suppliers = spark.createDataFrame([(f"sup{k}", f"s{k}@x.org") for k in range(1, 5)], "supplier_id string, sender string")
    ledger = spark.createDataFrame([("none", "sup1")], "sha256 string, supplier_id string")
    return files.accept_files(f, suppliers, ledger, most_bytes=5000).select(F.col("file_id").alias("doc_id"), "decision")


@query(
    f"""WITH {NOTICES}, t AS (SELECT *, replace(printf('%.2f', price), '.', ',') AS sum, strftime(deadline, '%d.%m.%Y %H:%M') AS until FROM n WHERE tender_number NOT LIKE 'c%')
SELECT 'import-zakazy-ceha:' || tender_number AS unique_key, title, 'import-zakazy-ceha' AS source, CASE WHEN seq % 3 = 0 THEN 'a "' || title || '";' || chr(10) || chr(10) || 'b; ' || region ELSE concat_ws(' ', title, tender_number, nullif(customer, ''), sum, until, 'Заказы цеха') END AS raw_text,
 nullif(customer, '') AS customer, round(price, 2) AS price, strftime(deadline, '%Y-%m-%d %H:%M') AS deadline FROM t"""
)
def src_delimited(spark, sf):
    """SRC-01, SNK-04: notices written as delimited files and imported; every third has a description of several lines with quotes and delimiters."""
    n = notices(spark, sf)
    said = F.when(F.col("seq") % 3 == 0, F.concat(F.lit('a "'), "title", F.lit('";\n\nb; '), "region"))
    rows = n.select(F.col("title").alias("Название"), F.lit("").alias("Ссылка"), F.col("tender_number").alias("Номер"), F.col("customer").alias("Организатор"), F.replace(F.format_string("%.2f", "price"), F.lit("."), F.lit(",")).alias("Начальная_цена"), F.date_format("deadline", "dd.MM.yyyy HH:mm").alias("Дата окончания"), said.alias("Описание"), F.lit("Заказы цеха").alias("Площадка"))
    path = shared_folder(spark, "import")
    sinks.write_case_csv(rows, path, ~F.startswith("Номер", F.lit("c")))
    out, _ = files.read_delimited(spark, path)
    return out.select("unique_key", "title", "source", "raw_text", "customer", F.round("price", 2).alias("price"), F.date_format("deadline", "yyyy-MM-dd HH:mm").alias("deadline"))


@query(
    f"""WITH {BATCHES}, x AS (SELECT unique_key, b, max(seq) AS seq, arg_max(source, seq) AS source, arg_max(CASE WHEN price > 50 THEN price ELSE -1 END, seq) AS p FROM (SELECT *, d // 8 AS b FROM e) GROUP BY 1, 2)
SELECT unique_key, max(seq) AS seq, arg_max(source, b) AS source, arg_max(p, b) FILTER (WHERE p > 0) AS price FROM x GROUP BY 1"""
)
def up_stream(spark, sf):
    """UP-14: the register fed by a file stream that is started for each landing of files, and once more without any; then a batch is replayed."""
    e = batches(spark, sf).withColumns({"price": F.when(F.col("price") > 50, F.col("price")), "batch": F.floor(F.col("d") / 8).cast("int")}).select("unique_key", "seq", "source", "price", "batch")
    path, landing, marks = (shared_folder(spark, name) for name in ("register", "landing", "marks"))
    rows = e.drop("batch")
    for number in (0, 1, 2, 3, None):
        if number is not None:
            e.where(F.col("batch") == number).drop("batch").write.mode("append").parquet(landing)
        stream_register(spark.readStream.schema(rows.schema).parquet(landing), path, marks, REGISTER_RULES).awaitTermination()
    apply_batch(path, REGISTER_RULES, e.where("batch = 1").drop("batch"), 1)
    return register_version(spark, path, REGISTER_RULES)[1].select("unique_key", "seq", "source", "price")
