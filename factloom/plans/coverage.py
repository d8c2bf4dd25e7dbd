"""Queries on coverage, gaps, quality and contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import analytics
from factloom.plans import standins as st
from factloom.plans.registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.add


def _evidence(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = st.lines(spark, sf_dir) if rows is None else rows
    public = st.table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.join(public, "l_orderkey", "left_semi").select(F.col("p_brand").alias("material"), F.col("l_suppkey").alias("process"), F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("experiment_id"))


def _axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return st.table(spark, sf_dir, "part").select(F.col("p_brand").alias("material")).distinct(), st.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("process"))


_GAPS = """WITH evidence AS (
  SELECT p_brand AS material, l_suppkey AS process, l_orderkey AS doc_id, l_partkey AS experiment_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE {where} AND o_orderpriority <> '1-URGENT'),
pairs AS (SELECT material, process FROM (SELECT DISTINCT p_brand AS material FROM part) CROSS JOIN (SELECT s_suppkey AS process FROM supplier))
SELECT p.material, p.process, count(DISTINCT doc_id) AS n_documents, count(DISTINCT experiment_id) AS n_experiments
FROM pairs p LEFT JOIN evidence e ON p.material = e.material AND p.process = e.process GROUP BY p.material, p.process"""


@query(_GAPS.format(where="true") + " ORDER BY n_documents, n_experiments, material, process LIMIT 50")
def find_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest gaps between all materials and all processes."""
    return analytics.top_gaps(analytics.find_gaps(*_axes(spark, sf_dir), _evidence(spark, sf_dir)))


@query(_GAPS.format(where="true"))
def find_gaps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.find_gaps(*_axes(spark, sf_dir), _evidence(spark, sf_dir))


@query(_GAPS.format(where="l_returnflag = 'A'"))
def find_gaps_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps under a condition of the environment: the line's flag."""
    flagged = st.lines(spark, sf_dir).where("l_returnflag = 'A'")
    return analytics.find_gaps(*_axes(spark, sf_dir), _evidence(spark, sf_dir, flagged))


@query(f"""WITH {st.MENTIONS}, counted AS (SELECT entity_id, count(*) AS n FROM mentions GROUP BY entity_id)
SELECT 'proc:' || s_suppkey AS entity_id, coalesce(n, 1) AS n_mentions FROM supplier LEFT JOIN counted ON entity_id = 'proc:' || s_suppkey
ORDER BY n_mentions DESC, entity_id LIMIT 40""")
def open_axis_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most mentioned processes; unmentioned ones count 1."""
    every = st.table(spark, sf_dir, "supplier").select(st.key("proc", "s_suppkey").alias("entity_id"))
    return analytics.open_axis(every, st.mentions(spark, sf_dir))


@query("""SELECT p_type AS domain, CAST(year(o_orderdate) AS BIGINT) AS year, count(DISTINCT o_orderkey) AS n_documents
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").cast("long").alias("year"))
    return analytics.coverage(st.lines(spark, sf_dir).select(F.col("p_type").alias("domain"), F.col("l_orderkey").alias("doc_id")).join(years, "doc_id"), "domain", "year")


@query(f"""WITH {st.DOCS}, {st.MENTIONS} SELECT geography, count(DISTINCT doc_id) AS n_documents FROM mentions JOIN docs USING (doc_id) WHERE entity_id = 'proc:1' GROUP BY geography""")
def process_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = st.mentions(spark, sf_dir).where("entity_id = 'proc:1'")
    return analytics.coverage(about.join(st.documents(spark, sf_dir), "doc_id"), "geography")


@query("""WITH hashes AS (SELECT doc_id, source, sha256(text) AS h FROM documents),
support AS (SELECT a.doc_id, count(*) AS n_support FROM hashes a JOIN hashes b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id),
marks AS (SELECT doc_id, source, quality FROM labels JOIN documents USING (doc_id)),
bad AS (SELECT source, count_if(quality = 0) AS n_bad FROM marks GROUP BY source),
stats AS (SELECT d.doc_id AS claim_id, coalesce(n_support, 0) AS n_support, CASE WHEN m.quality = 1 THEN n_bad ELSE 0 END AS n_contradictions
  FROM documents d LEFT JOIN support USING (doc_id) LEFT JOIN marks m USING (doc_id) LEFT JOIN bad ON bad.source = d.source)
SELECT claim_id, n_support, coalesce(n_contradictions, 0) AS n_contradictions FROM stats WHERE n_support <= 1 OR n_contradictions > 0 ORDER BY n_contradictions DESC, n_support, claim_id LIMIT 20""")
def risk_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims: equal texts support, bad labels within the source contradict good ones."""
    docs = st.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    same = docs.groupBy("h").agg((F.count("*") - 1).alias("n_support"))
    marks = st.table(spark, sf_dir, "labels").select("doc_id", "quality")
    bad = marks.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("n_bad"))
    joined = docs.join(same, "h").join(marks, "doc_id", "left").join(bad, "source", "left")
    stats = joined.select(F.col("doc_id").alias("claim_id"), "n_support", F.when(F.col("quality") == 1, F.coalesce("n_bad", F.lit(0))).otherwise(F.lit(0)).alias("n_contradictions"))
    return analytics.risk_zones(stats)


@query(f"""WITH {st.FACTS}, counted AS (SELECT 'needs_review' AS measure, count(*) AS n_all, count_if(needs_review) AS n_hit FROM facts
UNION ALL SELECT 'deleted', count(*), count_if(deleted) FROM facts UNION ALL SELECT 'half_open', count(*), count_if(value_min IS NULL OR value_max IS NULL) FROM facts)
SELECT measure, n_all, n_hit, coalesce(round(100.0::DOUBLE * n_hit / n_all, 1), 0) AS percent FROM counted""")
def quality_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.facts(spark, sf_dir)
    one = rows.agg(F.count("*").alias("n"), F.count_if("needs_review").alias("needs_review"), F.count_if("deleted").alias("deleted"), F.count_if(F.col("value_min").isNull() | F.col("value_max").isNull()).alias("half_open"))
    from factloom.functions.numbers import percent

    return one.select(F.stack(F.lit(3), F.lit("needs_review"), "n", "needs_review", F.lit("deleted"), "n", "deleted", F.lit("half_open"), "n", "half_open").alias("measure", "n_all", "n_hit")).withColumn("percent", percent("n_hit", "n_all"))


@query(f"""WITH {st.MENTIONS} SELECT 'c:' || o_custkey AS expert_id, entity_id, count(DISTINCT doc_id) AS n_publications
FROM orders JOIN mentions ON doc_id = o_orderkey WHERE entity_id LIKE 'mat:%' GROUP BY 1, 2""")
def n_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    authored = st.table(spark, sf_dir, "orders").select(st.key("c", "o_custkey").alias("expert_id"), F.col("o_orderkey").alias("doc_id"))
    return analytics.publications(authored, st.mention_rows(spark, sf_dir).where(F.col("entity_id").startswith("mat:")))


@query("""SELECT event_id AS doc_id, user_id AS source_path, ts AS imported_at FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS latest FROM events) WHERE ts < latest""")
def stale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as imports of their user's path: all but the latest are stale."""
    return analytics.stale_versions(st.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").alias("source_path"), F.col("ts").alias("imported_at")))


@query("""SELECT 'c:' || c_custkey AS entity_id FROM customer WHERE c_acctbal < 5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')""")
def orphan_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of low priority as orphans; a low balance marks them as unresolved."""
    entities = st.table(spark, sf_dir, "customer").select(st.key("c", "c_custkey").alias("entity_id"), (F.col("c_acctbal") < 5000).alias("unresolved"))
    edges = st.table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(st.key("c", "o_custkey").alias("src_key"), st.key("o", "o_orderkey").alias("dst_key"))
    return analytics.orphans(entities, edges).select("entity_id")


@query("""WITH about AS (SELECT doc_id AS claim_id, source AS entity_id, doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS polarity FROM labels JOIN documents USING (doc_id) WHERE toxic = 1),
existing AS (SELECT a.claim_id AS claim_a, b.claim_id AS claim_b FROM about a JOIN about b ON a.entity_id = b.entity_id AND a.claim_id < b.claim_id WHERE (a.claim_id + b.claim_id) % 3 = 0)
SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, a.polarity <> b.polarity AS opposite FROM about a JOIN about b ON a.entity_id = b.entity_id AND a.claim_id < b.claim_id
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.claim_a = a.claim_id AND e.claim_b = b.claim_id)""")
def opposing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents as claims about their source; pairs whose ids add up to a multiple of 3 already contradict."""
    marks = st.table(spark, sf_dir, "labels").where("toxic = 1").join(st.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    about = marks.select(F.col("doc_id").alias("claim_id"), F.col("source").alias("entity_id"), "doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("polarity"))
    met, _ = analytics.claims_met(about.select("claim_id", "entity_id"))
    existing = met.select(F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b")).where("(claim_a + claim_b) % 3 = 0")
    return analytics.opposing_claims(about, existing)


_MEASURED = """measured AS (
  SELECT min(l_orderkey * 8 + l_linenumber) AS fact_id, l_suppkey AS source, l_partkey AS parameter, l_orderkey AS doc_id, l_returnflag AS unit, l_quantity * 0.95::DOUBLE AS value_min, l_quantity * 1.05::DOUBLE AS value_max
  FROM lineitem GROUP BY l_suppkey, l_partkey, l_orderkey, l_returnflag, l_quantity),
pairs AS (
  SELECT a.source, a.parameter, least(a.fact_id, b.fact_id) AS fact_a, greatest(a.fact_id, b.fact_id) AS fact_b FROM measured a JOIN measured b
  ON a.source = b.source AND a.parameter = b.parameter AND a.unit = b.unit AND a.doc_id <> b.doc_id AND a.value_max < b.value_min
  WHERE (b.value_min - a.value_max) / least(a.value_max, b.value_min) > 0.2)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("parameter"), F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("unit"), F.col("l_quantity")]
    facts = rows.groupBy(*keys).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact_id"))
    return facts.withColumns({"value_min": F.col("l_quantity") * 0.95, "value_max": F.col("l_quantity") * 1.05})


@query(f"WITH {_MEASURED} SELECT * FROM pairs")
def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.contradiction_pairs(_measured(spark, sf_dir))


@query(f"""WITH {_MEASURED} SELECT DISTINCT least(a.claim, b.claim) AS claim_a, greatest(a.claim, b.claim) AS claim_b FROM pairs
JOIN (SELECT fact_id, doc_id || '#auto-' || fact_id AS claim FROM measured) a ON a.fact_id = fact_a JOIN (SELECT fact_id, doc_id || '#auto-' || fact_id AS claim FROM measured) b ON b.fact_id = fact_b WHERE a.claim <> b.claim""")
def contradiction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _measured(spark, sf_dir)
    none = F.array().cast("array<string>")
    claims = facts.select("fact_id", analytics.claim_of(none, F.col("doc_id").cast("string"), F.col("fact_id").cast("string")).alias("claim_id"))
    return analytics.contradiction_edges(analytics.contradiction_pairs(facts), claims)
