"""Queries on the graph: degrees, hubs, bounded searches, secured views, claims, co-occurrence and A-B-C links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.plans import standins as st
from factloom.plans.registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.add


@query(f"WITH {st.EDGES} SELECT node_key, count(*) AS degree FROM (SELECT src_key AS node_key FROM edges UNION ALL SELECT dst_key FROM edges) GROUP BY node_key")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(st.edges(spark, sf_dir))


@query(f"""WITH {st.EDGES}, deg AS (SELECT node_key, count(*) AS degree FROM (SELECT src_key AS node_key FROM edges UNION ALL SELECT dst_key FROM edges) GROUP BY node_key)
SELECT left(node_key, 1) AS label, count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS n_ends, max(degree) AS most FROM deg GROUP BY 1""")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(st.edges(spark, sf_dir)).groupBy(F.substring("node_key", 1, 1).alias("label")).agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("n_ends"), F.max("degree").alias("most"))


@query(f"""WITH {st.EDGES}, both_ways AS (SELECT DISTINCT src_key AS hub, dst_key AS neighbour FROM edges UNION SELECT dst_key, src_key FROM edges),
years AS (SELECT 'o:' || o_orderkey AS node_key, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders),
dated AS (SELECT hub, neighbour, year AS last_year FROM both_ways LEFT JOIN years ON neighbour = node_key WHERE hub IN ('n:1', 'n:2', 'p:5', 'p:6', 'c:9')),
r AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY last_year DESC NULLS LAST, neighbour) AS rank FROM dated) SELECT hub, neighbour, last_year, rank FROM r WHERE rank <= 25""")
def hub_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = spark.createDataFrame([(k,) for k in ("n:1", "n:2", "p:5", "p:6", "c:9")], "node_key string")
    years = st.table(spark, sf_dir, "orders").select(st.key("o", "o_orderkey").alias("node_key"), F.year("o_orderdate").cast("long").alias("year"))
    return graph.hub_neighbours(st.edges(spark, sf_dir), hubs, years)


_BFS = """steps AS (SELECT a, b FROM (SELECT src_key AS a, dst_key AS b FROM edges WHERE rel_type <> 'WORKS_AT' UNION SELECT dst_key, src_key FROM edges WHERE rel_type <> 'WORKS_AT') QUALIFY count(*) OVER (PARTITION BY a) <= 1000),
d0 AS (SELECT c_custkey AS query_id, 'c:' || c_custkey AS k FROM customer WHERE c_custkey % 100 = 0), d1 AS (SELECT DISTINCT query_id, b AS k FROM d0 JOIN steps ON a = k), d2 AS (SELECT DISTINCT query_id, b AS k FROM d1 JOIN steps ON a = k),
d3 AS (SELECT DISTINCT query_id, b AS k FROM d2 JOIN steps ON a = k),
reached AS (SELECT query_id, k AS node_key, CAST(min(d) AS BIGINT) AS depth FROM (SELECT *, 0 AS d FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) GROUP BY ALL),
found AS (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, node_key) <= 300)"""


#: The adjacency of a folder's edges is written once in an application: its tables do not change.
_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer whose key is divisible by 100 as a search of its own, all at once."""
    starts = st.table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), st.key("c", "c_custkey").alias("node_key"))
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _WRITTEN:
        _WRITTEN[place] = graph.adjacency(st.edges(spark, sf_dir))
    return graph.bounded_searches(_WRITTEN[place], starts, 3)


@query(f"WITH {st.EDGES}, {_BFS} SELECT * FROM found")
def bfs_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)


@query(f"""WITH {st.EDGES}, {st.DOCS}, {_BFS}, hidden AS (SELECT doc_id FROM docs WHERE access_level IS NULL OR access_level <> 'public'),
shown AS (SELECT DISTINCT node_key FROM found WHERE NOT (node_key LIKE 'o:%' AND CAST(CASE WHEN node_key LIKE 'o:%' THEN substr(node_key, 3) END AS BIGINT) IN (SELECT doc_id FROM hidden)))
SELECT src_key, dst_key, rel_type, count(*) AS n FROM edges WHERE NOT deleted AND src_key IN (SELECT node_key FROM shown) AND dst_key IN (SELECT node_key FROM shown)
AND (source_doc_id IS NULL OR source_doc_id NOT IN (SELECT doc_id FROM hidden)) GROUP BY ALL""")
def secured_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all searches together found, as a partner sees it: the searches pass hidden nodes, the view does not show them."""
    is_doc = F.col("node_key").startswith("o:")
    found = _search(spark, sf_dir).select("node_key").distinct()
    nodes = found.select("node_key", F.when(is_doc, "Document").otherwise("Material").alias("label"), F.when(is_doc, F.substr("node_key", F.lit(3)).cast("long")).alias("doc_id"), F.lit(None).cast("string").alias("superseded_by"))
    edges = graph.secured_view(nodes, st.edges(spark, sf_dir), st.documents(spark, sf_dir), partner=True)[1]
    return edges.groupBy("src_key", "dst_key", "rel_type").agg(F.count("*").alias("n"))


@query("""WITH support AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_quantity > 49 AND l_returnflag <> 'R' GROUP BY 1),
against AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09 GROUP BY 1)
SELECT 'claim:' || s_suppkey AS claim_id, coalesce(s.n, 0) AS n_support, coalesce(a.n, 0) AS n_contradictions FROM supplier LEFT JOIN support s ON s.l_suppkey = s_suppkey LEFT JOIN against a ON a.l_suppkey = s_suppkey""")
def claim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as claims: large deliveries support, returns of discounted goods contradict."""
    li = st.table(spark, sf_dir, "lineitem")
    claims = st.table(spark, sf_dir, "supplier").select(st.key("claim", "s_suppkey").alias("claim_id"))
    support = li.where("l_quantity > 49 AND l_returnflag <> 'R'").select(st.key("claim", "l_suppkey").alias("src_key"), st.key("o", "l_orderkey").alias("dst_key"), F.lit("SUPPORTED_BY").alias("rel_type"), F.lit(False).alias("deleted"))
    against = li.where("l_returnflag = 'R' AND l_discount > 0.09").select(st.key("claim", "l_suppkey"), st.key("other", "l_orderkey"), F.lit("CONTRADICTS"), F.lit(False))
    return graph.claim_statistics(claims, support.union(against)).where(F.col("claim_id").startswith("claim:"))


@query("""WITH used AS (SELECT p_brand AS material, p_partkey AS experiment FROM part), studied AS (SELECT DISTINCT l_partkey AS experiment, 'proc:' || l_suppkey AS process FROM lineitem),
held AS (SELECT DISTINCT l_partkey AS experiment, 'proc:' || l_suppkey AS process, l_linestatus AS equipment FROM lineitem WHERE l_returnflag = 'A')
SELECT material, experiment, process, equipment FROM used JOIN studied USING (experiment) LEFT JOIN held USING (experiment, process)""")
def chain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material, experiment, process and, where there is one, equipment."""
    used = st.table(spark, sf_dir, "part").select(F.col("p_brand").alias("material"), F.col("p_partkey").alias("experiment"))
    lines = st.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("experiment"), st.key("proc", "l_suppkey").alias("process"), F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")).alias("equipment"))
    return graph.chains(used, lines.select("experiment", "process").distinct(), lines.where("equipment IS NOT NULL").distinct())


_COOC = """e AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS entity FROM lineitem),
pairs AS (SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM e x JOIN e y ON x.chunk_id = y.chunk_id AND x.entity < y.entity GROUP BY 1, 2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence(st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity")))


@query(f"WITH {_COOC} SELECT * FROM pairs")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"""WITH {_COOC}, ed AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs),
t AS (SELECT p_partkey AS entity, CASE p_partkey % 3 WHEN 0 THEN 'reagent' WHEN 1 THEN 'process' ELSE 'metal' END AS type FROM part),
two AS (SELECT bc.b AS c, ab.b AS via, ab.weight AS w_ab, bc.weight AS w_bc FROM ed ab JOIN ed bc ON ab.b = bc.a WHERE ab.a = 7 AND bc.b <> 7),
s AS (SELECT two.*, coalesce(d.weight, 0) AS direct FROM two LEFT JOIN ed d ON d.a = 7 AND d.b = two.c WHERE c IN (SELECT entity FROM t WHERE type IN ('reagent', 'process', 'parameter'))),
r AS (SELECT *, (least(w_ab, w_bc) + 0.1::DOUBLE * (w_ab + w_bc)) / (1 + direct) AS score FROM s WHERE direct <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, via) AS n FROM r)
SELECT c, via AS b, w_ab, w_bc, direct, score FROM b WHERE n = 1 ORDER BY score DESC, c LIMIT 5""")
def abc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one part reaches through another one: parts are the entities, orders the chunks."""
    number = F.col("p_partkey") % 3
    types = st.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.when(number == 0, "reagent").when(number == 1, "process").otherwise("metal").alias("type"))
    return graph.abc_links(_pairs(spark, sf_dir), types, 7)
