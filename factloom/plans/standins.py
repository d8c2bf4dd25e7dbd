"""Stand-ins for the graph's tables, from the star schema: in Spark, and as SQL for the oracle.

Orders are documents, brands materials, suppliers processes, parts parameters
and experiments, and line items are numeric facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, year, geography, doc_type, access_level."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    access = F.when(F.col("o_orderpriority") == "1-URGENT", "internal").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None)).otherwise("public")
    return t("orders").join(places, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").cast("long").alias("year"), F.when(F.col("r_name") == "EUROPE", "RU").otherwise("foreign").alias("geography"), F.col("o_orderstatus").alias("doc_type"), access.alias("access_level"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the brand of their part."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))


def mention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, doc_id of every line's material and process: mentions may repeat."""
    both = F.explode(F.array(key("mat", "p_brand"), key("proc", "l_suppkey")))
    return lines(spark, sf_dir).select(both.alias("entity_id"), F.col("l_orderkey").alias("doc_id"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, doc_id: which materials and processes each document mentions."""
    return mention_rows(spark, sf_dir).distinct()


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, parameter, doc_id, value_min, value_max (open in some lines), value_text, needs_review, deleted."""
    return table(spark, sf_dir, "lineitem").select(
        key("proc", "l_suppkey").alias("source"), key("par", "l_partkey").alias("parameter"), F.col("l_orderkey").alias("doc_id"),
        F.when(F.col("l_linenumber") != 1, F.col("l_quantity") * 0.9).alias("value_min"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity") * 1.1).alias("value_max"),
        F.concat(F.lit("flag "), "l_returnflag").alias("value_text"), (F.col("l_returnflag") == "R").alias("needs_review"), ((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0)).alias("deleted"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_key, dst_key, rel_type, source_doc_id, deleted of the graph of customers, orders, parts and nations."""
    t = lambda n: table(spark, sf_dir, n)
    wrote = t("orders").select(key("c", "o_custkey").alias("src_key"), key("o", "o_orderkey").alias("dst_key"), F.lit("AUTHORED").alias("rel_type"), F.col("o_orderkey").alias("source_doc_id"), F.lit(False).alias("deleted"))
    held = t("lineitem").select(key("o", "l_orderkey"), key("p", "l_partkey"), F.lit("USES_MATERIAL"), "l_orderkey", (F.col("l_linestatus") == "F") & (F.col("l_tax") == 0))
    lives = t("customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), F.lit("WORKS_AT"), F.lit(None).cast("long"), F.lit(False))
    return wrote.union(held).union(lives)


DOCS = """docs AS (
  SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN r_name = 'EUROPE' THEN 'RU' ELSE 'foreign' END AS geography, o_orderstatus AS doc_type,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'internal' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE 'public' END AS access_level
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MENTIONS = """mentions AS (
  SELECT DISTINCT 'mat:' || p_brand AS entity_id, l_orderkey AS doc_id FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT DISTINCT 'proc:' || l_suppkey, l_orderkey FROM lineitem)"""
FACTS = """facts AS (
  SELECT 'proc:' || l_suppkey AS source, 'par:' || l_partkey AS parameter, l_orderkey AS doc_id, CASE WHEN l_linenumber <> 1 THEN l_quantity * 0.9::DOUBLE END AS value_min,
         CASE WHEN l_linenumber <> 2 THEN l_quantity * 1.1::DOUBLE END AS value_max, 'flag ' || l_returnflag AS value_text, l_returnflag = 'R' AS needs_review,
         l_linestatus = 'F' AND l_tax = 0 AS deleted FROM lineitem)"""
EDGES = """edges AS (
  SELECT 'c:' || o_custkey AS src_key, 'o:' || o_orderkey AS dst_key, 'AUTHORED' AS rel_type, o_orderkey AS source_doc_id, false AS deleted FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'USES_MATERIAL', l_orderkey, l_linestatus = 'F' AND l_tax = 0 FROM lineitem
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'WORKS_AT', NULL, false FROM customer)"""
