"""Given tables as notices, batches, products and cases. The same text runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "embeddings", "benchmark", "conversations")

#: A notice per order; a second source's copy for keys divisible by 10, with an official number for those divisible by 15.
NOTICES = """
base AS (
  SELECT o_orderkey AS k, 'src' || CAST(o_orderkey % 7 AS STRING) AS source, CAST(o_orderkey AS STRING) AS tender_number,
         c_name AS customer, r_name AS region, o_totalprice AS price, o_orderdate AS deadline, p_name AS title,
         l_shipdate AS discovered_at, o_orderpriority AS raw_text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey, min(l_shipdate) AS l_shipdate FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) AS l ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey),
n AS (
  SELECT k * 2 AS seq, source, tender_number, customer, region, price, deadline, title, discovered_at, raw_text,
         CAST(NULL AS STRING) AS official_number FROM base
  UNION ALL
  SELECT k * 2 + 1, 'copy', 'c' || tender_number, CASE WHEN k % 20 = 0 THEN '' ELSE customer END, region, price + 0.5, deadline, title,
         discovered_at, 'copy of ' || raw_text, CASE WHEN k % 15 = 0 THEN tender_number END FROM base WHERE k % 10 = 0)
"""

#: Days as batches: the key is the user, the source the kind of event, the price the value.
BATCHES = """
e AS (
  SELECT event_id AS seq, CAST(user_id AS STRING) AS unique_key, event_type AS source, value AS price,
         CAST(date_format_day AS STRING) AS day, CAST(substr(date_format_day, 9, 2) AS INT) AS d,
         CASE WHEN event_type = 'purchase' THEN 'hot' WHEN event_type = 'click' THEN 'review' ELSE 'excluded' END AS review_priority
  FROM (SELECT *, substr(CAST(ts AS STRING), 1, 10) AS date_format_day FROM events) AS x)
"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers the tables as temporary views."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "orders", "customer", "nation", "region", "lineitem", "part")
    return spark.sql(f"WITH {NOTICES} SELECT * FROM n")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "events")
    return spark.sql(f"WITH {BATCHES} SELECT * FROM e")
