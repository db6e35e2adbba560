"""Code-shaped relations from the provided star schema, and the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.registry import table
from codeloom.plans.shared import spread

OCC = """occ AS (
  SELECT p_partkey AS occ_id, p_type || '|' || CAST(p_size AS VARCHAR(9)) AS body_hash, p_brand AS package, p_name AS name, p_type AS kind,
         CAST(p_size AS BIGINT) AS size, 'packages/' || replace(lower(p_brand), '#', '-') || '/src/f' || CAST(p_partkey % 50 AS VARCHAR(9)) || '.ts' AS file_path,
         p_partkey % 400 + 1 AS line, p_partkey % 400 + 1 + p_size * 12 AS end_line,
         p_partkey % 7 = 0 AS in_test, p_partkey % 11 = 0 AS generated, p_partkey % 3 = 0 AS exported
  FROM part)"""
EDGE = """call_edge AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity <= 3)"""
SIGNAL = """signal AS (
  SELECT l_returnflag AS rule_id, 'src/p' || CAST(l_partkey AS VARCHAR(19)) || '.ts' AS file_path, CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS col, l_orderkey AS ordinal, l_shipdate AS at_ts,
         CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 35 THEN 'high' WHEN l_quantity > 15 THEN 'medium' ELSE 'low' END AS severity,
         CASE WHEN l_linestatus = 'O' THEN 'architecture' ELSE 'security' END AS category, 's' || CAST(l_suppkey % 5 AS VARCHAR(9)) AS source
  FROM lineitem)"""
SESSION = """session AS (
  SELECT event_id AS id, event_type AS tool, ts, user_id, value AS duration, event_type <> 'error' AS passed,
         '/work/u' || CAST(user_id % 20 AS VARCHAR(9)) || '/p' || CAST(user_id % 3 AS VARCHAR(9)) AS cwd, event_id % 97 AS suite
  FROM events)"""


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    key, text = F.col("p_partkey"), lambda c: c.cast("string")
    line = key % 400 + 1
    return table(spark, d, "part").select(
        key.alias("occ_id"), F.concat("p_type", F.lit("|"), text(F.col("p_size"))).alias("body_hash"), F.col("p_brand").alias("package"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"),
        F.col("p_size").cast("long").alias("size"), F.concat(F.lit("packages/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/src/f"), text(key % 50), F.lit(".ts")).alias("file_path"),
        line.alias("line"), (line + F.col("p_size") * 12).alias("end_line"), (key % 7 == 0).alias("in_test"), (key % 11 == 0).alias("generated"), (key % 3 == 0).alias("exported"),
    )


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a = rows.filter("l_quantity <= 3").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = rows.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(spread(b), ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def signals(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    severity = F.when(q > 45, "critical").when(q > 35, "high").when(q > 15, "medium").otherwise("low")
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("rule_id"), F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("file_path"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("col"), F.col("l_orderkey").alias("ordinal"),
        F.col("l_shipdate").alias("at_ts"), severity.alias("severity"), F.when(F.col("l_linestatus") == "O", "architecture").otherwise("security").alias("category"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"),
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id")
    cwd = F.concat(F.lit("/work/u"), (user % 20).cast("string"), F.lit("/p"), (user % 3).cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), "ts", "user_id", F.col("value").alias("duration"), (F.col("event_type") != "error").alias("passed"), cwd.alias("cwd"), (F.col("event_id") % 97).alias("suite"))
