"""Queries that put operators of resolution, review, evidence, reports and retrieval on whole tables of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import numbers
from factloom.operators import analytics, graph, mutation, resolution, retrieval, validation
from factloom.plans import standins as st
from factloom.plans.registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "lineitem")


@query("SELECT l_partkey AS entity_id, l_orderkey AS doc_id, min(l_linenumber) AS chunk_idx FROM lineitem GROUP BY 1, 2")
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities, orders as documents, lines as their chunks."""
    return mutation.first_mentions(_lines(spark, sf_dir).select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_idx"), F.col("l_suppkey").alias("ord")))


@query("""SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 'Curated' ELSE 'Found' END AS label, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'curated ' || c_custkey WHEN c_custkey % 2 = 1 THEN 'found ' || c_custkey ELSE 'curated ' || c_custkey END AS name,
CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS aliases FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0""")
def reference_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second customer is stored, every third one is curated; curated rows without a name, of odd keys, leave the one that is there. Each curated row comes twice."""
    ids = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    stored = ids.where("entity_id % 2 = 1").select("entity_id", F.lit("Found").alias("label"), F.concat(F.lit("found "), F.col("entity_id").cast("string")).alias("name"), F.array(F.lit("old")).alias("aliases"))
    curated = ids.where("entity_id % 3 = 0").select("entity_id", F.lit("Curated").alias("label"), F.when(F.col("entity_id") % 2 == 0, F.concat(F.lit("curated "), F.col("entity_id").cast("string"))).alias("name"), F.array(F.lit("new")).alias("aliases"))
    return mutation.load_references(stored, curated.unionByName(curated)).withColumn("aliases", F.array_join("aliases", "|"))


@query("""SELECT doc_id, type, lower(name) AS name_key, ord FROM (SELECT l_orderkey AS doc_id, l_returnflag AS type, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, l_linenumber * 100000 + l_partkey AS ord FROM lineitem JOIN part ON l_partkey = p_partkey)
QUALIFY row_number() OVER (PARTITION BY doc_id, type, lower(name) ORDER BY ord) = 1""")
def first_in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as entities of an order, every second one in capitals."""
    rows = _lines(spark, sf_dir).join(st.table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    named = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("type"), name.alias("name"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"))
    return resolution.first_in_document(named).select("doc_id", "type", "name_key", "ord")


@query("""SELECT p_brand AS label, replace(p_name, ' ', '-') AS slug, first_id, p_partkey AS other_id FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS first_id FROM part) WHERE p_partkey <> first_id""")
def duplicate_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and name, as unresolved entities."""
    return resolution.duplicate_stubs(st.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("label"), F.initcap("p_name").alias("name")))


@query("SELECT 'c:' || c_custkey AS victim_id, 'n:' || n_nationkey AS survivor_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def synonym_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as unresolved entities that have, behind a surface of their own, that of their nation: a few entities are hot keys."""
    nation = st.table(spark, sf_dir, "nation")
    index = resolution.alias_index(nation.select(st.key("n", "n_nationkey").alias("entity_id"), F.lit("Place").alias("label"), F.col("n_nationkey").cast("long").alias("ord"), F.array("n_name").alias("surfaces")))
    joined = st.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return resolution.synonym_merges(joined.select(st.key("c", "c_custkey").alias("entity_id"), F.lit("Place").alias("label"), F.array(F.concat(F.lit("own "), F.col("c_custkey").cast("string")), F.lower("n_name")).alias("surfaces")), index)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, len(list_distinct(list(l_suppkey || '-' || l_orderkey || '-' || l_returnflag) OVER w)) AS n_claims, min(l_suppkey || '-' || l_orderkey || '-' || l_returnflag) OVER w AS first_claim
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_suppkey)""")
def facts_with_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as facts; their order's claims about their supplier, one for each flag."""
    li = _lines(spark, sf_dir)
    source = F.col("l_suppkey").cast("string")
    facts = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("fact_id"), source.alias("source"), F.col("l_orderkey").alias("doc_id"))
    claims = li.select(F.concat_ws("-", source, F.col("l_orderkey").cast("string"), "l_returnflag").alias("claim_id"), F.col("l_orderkey").alias("doc_id"), F.array(source).alias("about")).distinct()
    found = analytics.facts_with_claims(facts, claims)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("claim_ids").cast("long").alias("n_claims"), F.try_element_at("claim_ids", F.lit(1)).alias("first_claim"))


@query("""SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey AS fact_id, l_returnflag AS rel_type, 'q ' || l_suppkey AS quote, CASE WHEN o_orderkey IS NOT NULL THEN 'order ' || o_orderkey END AS title FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 5 <> 0
WHERE NOT (l_linestatus = 'F' AND l_tax = 0) AND l_returnflag = 'R'""")
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as facts to review, with their order as the document that proves them; every fifth order is unknown."""
    facts = _lines(spark, sf_dir).select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("fact_id"), F.col("l_returnflag").alias("rel_type"), F.concat(F.lit("q "), F.col("l_suppkey").cast("string")).alias("quote"), F.col("l_orderkey").alias("source_doc_id"), ((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0)).alias("deleted"), (F.col("l_returnflag") == "R").alias("needs_review"))
    docs = st.table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("path").alias("source_path"))
    return graph.evidence(facts, docs, review_only=True).drop("source_path")


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS process, 'c' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS expert FROM lineitem JOIN orders ON l_orderkey = o_orderkey), r AS (SELECT *, row_number() OVER (PARTITION BY process ORDER BY expert) AS n FROM x)
SELECT process, count(*) AS n_experts, string_agg(expert, '|' ORDER BY expert) FILTER (WHERE n <= 5) AS experts FROM r GROUP BY process""")
def process_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as experts on the suppliers that deliver to them."""
    known = _lines(spark, sf_dir).join(st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    expertise = known.select(F.col("l_suppkey").alias("process"), F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("expert"))
    return graph.experts_of(expertise).withColumn("experts", F.array_join("experts", "|"))


@query(f"""WITH {st.EDGES}, deg AS (SELECT node_key, count(*) AS degree FROM (SELECT src_key AS node_key FROM edges UNION ALL SELECT dst_key FROM edges) GROUP BY 1), starts AS (SELECT 'p:' || p_partkey AS node_key FROM part UNION ALL SELECT 'n:' || n_nationkey FROM nation)
SELECT node_key, coalesce(degree, 0) AS degree, coalesce(degree, 0) > 30 AS hub FROM starts LEFT JOIN deg USING (node_key)""")
def hub_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts and nations as starts: those of over 30 edges are hubs."""
    starts = st.table(spark, sf_dir, "part").select(st.key("p", "p_partkey").alias("node_key")).union(st.table(spark, sf_dir, "nation").select(st.key("n", "n_nationkey")))
    few, hubs = graph.split_hubs(st.edges(spark, sf_dir), starts, limit=30)
    return few.withColumn("hub", F.lit(False)).unionByName(hubs.withColumn("hub", F.lit(True)))


@query("SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS doc_count FROM lineitem GROUP BY 1")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.document_counts(_lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity")))


@query("""WITH q AS (SELECT l_suppkey AS entity, l_returnflag || '-' || l_linenumber AS quote, min(l_orderkey * 8 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2)
SELECT entity, string_agg(quote, ' ' ORDER BY ord, quote) AS description FROM q GROUP BY entity""")
def experiment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines say of a supplier, each thing once, in the order in which it was said first."""
    li = _lines(spark, sf_dir)
    return validation.describe_experiments(li.select(F.col("l_suppkey").alias("entity"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.concat_ws("-", "l_returnflag", "l_linenumber").alias("quote")))


_REASON = "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'quote not in the text; unknown unit: x' WHEN 2 THEN 'numbers not near the quote: 5' ELSE 'unknown unit: x' END"
_TRIED = """f AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS fact_id, {reason} AS reason, CASE WHEN l_returnflag = 'A' THEN l_linestatus = 'O' END AS solved FROM lineitem),
r AS (SELECT *, CASE WHEN solved THEN nullif(CASE WHEN reason LIKE 'quote%' THEN 'unknown unit: x' WHEN reason LIKE 'number%' THEN '' ELSE reason END, '') ELSE reason END AS left_over FROM f)""".format(reason=_REASON)


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as facts with reasons by their number, and those with flag A as tried, open ones as solved."""
    li = _lines(spark, sf_dir).withColumn("fact_id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).withColumn("review_reason", F.expr(_REASON))
    facts = li.select("fact_id", "review_reason", F.col("review_reason").isNotNull().alias("needs_review"), F.lit(None).cast("boolean").alias("resolve_attempted"))
    return facts, li.where("l_returnflag = 'A'").select("fact_id", (F.col("l_linestatus") == "O").alias("solved")).distinct()


@query(f"WITH {_TRIED} SELECT left_over AS review_reason, left_over IS NOT NULL AS needs_review, solved IS NOT NULL AS resolve_attempted, count(*) AS n FROM r GROUP BY ALL")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.after_review(*_reviewed(spark, sf_dir)).groupBy("review_reason", "needs_review", "resolve_attempted").agg(F.count("*").alias("n"))


@query(f"WITH {_TRIED} SELECT CASE WHEN solved THEN 'solved' ELSE 'not proven' END AS outcome, count(*) AS n FROM r WHERE solved IS NOT NULL GROUP BY 1")
def review_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as confirmations by a reviewer; of closed ones too few words of the quote were found."""
    facts, tried = _reviewed(spark, sf_dir)
    given = tried.select("fact_id", F.lit("confirm").alias("verdict"), F.when(F.col("solved"), 0.9).otherwise(0.5).alias("coverage"), F.lit(True).alias("numbers_ok"))
    return validation.apply_proposals(facts, given)[1]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) IN (l_linenumber, 7, 12) AS from_question FROM lineitem""")
def question_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the number of a value is one of those that the question names."""
    value = F.concat(F.lit("about "), F.col("l_quantity").cast("long").cast("string"), F.lit(" units"))
    asked = F.concat(F.lit("from "), F.col("l_linenumber").cast("string"), F.lit(" to 7 or 12 of them"))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", validation.numbers_of_question(value, asked).alias("from_question"))


@query(r"""WITH q AS (SELECT doc_id, regexp_extract(text, '^\s*(\S+\s+){0,7}\S+') AS quote FROM documents)
SELECT doc_id, length(quote) <= 300 AND regexp_matches(quote, '[0-9A-Za-zА-Яа-яЁё]{2,}') AS found FROM q""")
def quote_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight words of every document as a quote whose words are looked for in it, without what stands between them: all are found in one place."""
    docs = st.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quote = F.regexp_extract("text", r"^\s*(\S+\s+){0,7}\S+", 0)
    asked = docs.select(F.col("doc_id").alias("fact_id"), F.when(F.length(quote) <= validation.ANCHOR_SPAN, F.regexp_replace(quote, r"[^0-9A-Za-zА-Яа-яЁё]+", " ")).alias("quote"), "text")
    return validation.anchored_windows(asked).select(F.col("fact_id").alias("doc_id"), (F.col("coverage") == 1).alias("found"))


@query("""SELECT 'Customer:' || c_custkey AS node, CAST(c_custkey AS VARCHAR) AS bare, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'c' || c_custkey END AS shown FROM customer UNION ALL SELECT 'Nation:' || n_name, n_name, n_name FROM nation""")
def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of two labels by their keys, and the first name that each has."""
    customers = st.table(spark, sf_dir, "customer").select(F.lit("Customer").alias("label"), F.col("c_custkey").cast("string").alias("k"), F.lit(None).cast("string").alias("title"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("").alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    nations = st.table(spark, sf_dir, "nation").select(F.lit("Nation"), F.lit(None).cast("string"), F.col("n_name"), F.lit(None).cast("string"), F.lit("?"))
    nodes = customers.union(nations)
    key = graph.node_key(F.col("label"), {"Customer": F.col("k"), "Nation": F.col("title")}, F.col("id"))
    return nodes.select(key.alias("node"), graph.bare_key(key).alias("bare"), graph.display_name(F.col("name"), F.col("title"), F.col("id")).alias("shown"))


@query("""SELECT l_returnflag AS rel_type, count(value) AS n_values, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'HAS_CONDITION' WHEN 'A' THEN 'PRODUCES' ELSE 'STUDIES' END AS l_returnflag, CASE WHEN l_returnflag IN ('R', 'A') THEN l_quantity END AS value FROM lineitem) GROUP BY 1""")
def stored_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "HAS_CONDITION").when(F.col("l_returnflag") == "A", "PRODUCES").otherwise("STUDIES")
    facts = _lines(spark, sf_dir).select(kind.alias("rel_type"), F.col("l_quantity").alias("value_min"))
    return mutation.relation_columns(facts).groupBy("rel_type").agg(F.count("value_min").alias("n_values"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) - l_linenumber AS DOUBLE) AS delta FROM lineitem")
def percent_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("с "), F.col("l_linenumber").cast("string"), F.lit(" % до "), F.col("l_quantity").cast("long").cast("string"), F.lit(",0 %"))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.percent_points(said).alias("delta"))


@query("""SELECT vec_id AS key, len(v) AS dim, 1.0::DOUBLE AS length, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] AS v FROM embeddings)""")
def short_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 places of every vector, of length 1 again."""
    short = st.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), retrieval.shorten("embedding", 16).alias("v"))
    return short.select("key", F.size("v").cast("long").alias("dim"), F.round(retrieval.norm("v"), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


@query("""WITH e AS (SELECT vec_id // 2 AS pair_id, vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.pair_id, round(list_cosine_similarity(a.v, b.v), 6) AS score, list_cosine_similarity(a.v, b.v) >= 0.5 AS similar FROM e a JOIN e b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1""")
def cross_lingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 2k and 2k + 1 as those of one text in two languages."""
    e = st.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), (F.col("vec_id") % 2).alias("side"), "embedding")
    pairs = e.where("side = 0").select("pair_id", F.col("embedding").alias("a")).join(e.where("side = 1").select("pair_id", F.col("embedding").alias("b")), "pair_id")
    return retrieval.similar_pairs(pairs).withColumn("score", F.round("score", 6))


@query("""SELECT count(*) AS n_statements, round(count(*) FILTER (WHERE l_linenumber % 3 > 0) * 1.0::DOUBLE / count(*), 9) AS citation_coverage, round(count(*) FILTER (WHERE l_linenumber % 3 > 0 AND l_returnflag = 'N') * 1.0::DOUBLE / count(*) FILTER (WHERE l_linenumber % 3 > 0), 9) AS verified_ratio FROM lineitem""")
def answer_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = retrieval.answer_measures(_lines(spark, sf_dir).select((F.col("l_linenumber") % 3).alias("n_citations"), (F.col("l_returnflag") == "N").alias("verified")))
    return measured.select("n_statements", *[F.round(c, 9).alias(c) for c in ("citation_coverage", "verified_ratio")])


@query("""SELECT l_partkey AS query_id, l_orderkey AS doc_id, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || CAST(l_quantity AS BIGINT) AS chunk_id, l_suppkey AS rank, 'order ' || l_orderkey AS title, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS access_level, 'line ' || l_quantity::BIGINT AS text
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0""")
def hit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as hits, with what their order and their own text say; hits in orders that are not known go."""
    li = _lines(spark, sf_dir).withColumn("chunk_id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")))
    hits = li.select(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").alias("doc_id"), "chunk_id", F.col("l_suppkey").alias("rank"))
    docs = st.table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("access_level"))
    chunks = li.select("chunk_id", F.concat(F.lit("line "), F.col("l_quantity").cast("long").cast("string")).alias("text")).distinct()
    return retrieval.enrich(hits, docs, chunks)


@query("""SELECT l_orderkey AS query_id, string_agg('[C' || l_linenumber || '] (' || p_name || ', ' || l_returnflag || ', en, ' || year(l_shipdate) || '): ' || CAST(l_quantity AS BIGINT), chr(10) || chr(10) ORDER BY l_linenumber, p_name, l_returnflag, year(l_shipdate), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS context
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as the cited chunks of an answer's context."""
    held = _lines(spark, sf_dir).join(st.table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    cited = held.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("n"), F.col("p_name").alias("title"), F.col("l_returnflag").alias("doc_type"), F.lit("en").alias("lang"), F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("long").cast("string").alias("quote"))
    return retrieval.numbered_context(cited)


@query("""SELECT p_partkey AS mention_id, (SELECT min(CAST(q.p_partkey AS VARCHAR)) FROM part q WHERE q.p_name = p.p_name AND q.p_partkey % 2 = 0 AND q.p_partkey % 7 <> 0) AS entity_id FROM part p
WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_name = p.p_name AND q.p_partkey % 2 = 0 AND q.p_partkey % 7 <> 0)""")
def fulltext_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name, in capitals, looked up among every second part's; every seventh of those is deleted. The words are few and very common."""
    part = st.table(spark, sf_dir, "part")
    mentions = part.select(F.col("p_partkey").alias("mention_id"), F.lit("Material").alias("label"), F.upper("p_name").alias("name"))
    entities = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit("Material").alias("label"), F.array(F.concat(F.lit("no "), F.col("p_partkey").cast("string")), "p_name").alias("surfaces"), F.lit(False).alias("unresolved"), (F.col("p_partkey") % 7 == 0).alias("deleted"))
    return resolution.text_fallback(mentions, entities, candidates=1_000_000)
