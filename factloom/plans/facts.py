"""Queries on the validation of facts, on writes, and on hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.operators import hypotheses, mutation, validation
from factloom.plans import standins as st
from factloom.plans.registry import Catalogue
from factloom.shipping import fresh_folder

CATALOGUE = Catalogue()
query = CATALOGUE.add


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items made unique: one row for each order, part, supplier and line number."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return st.table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"))


_K = "k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with a quote: right, from another chunk, with a wrong number, inside a longer number, and without a quote."""
    q, n = F.col("q").cast("long").cast("string"), F.col("l_linenumber")
    body = F.concat(F.lit("The sample  was held at "), q, F.lit(" degrees and\nthen at 1 0"), F.lpad(q, 2, "0"), F.lit(" units."))
    quote = F.element_at(F.array(F.concat(F.lit("was held at "), q), F.concat(F.lit("elsewhere "), q), F.concat(F.lit("held at "), q), F.lit("not said"), F.lit(" "), F.lit("then at"), F.lit("The sample was")), n.cast("int"))
    value = F.when(n == 3, F.lit("777")).when(n == 4, F.lit("")).when(n == 6, F.concat(F.lit("10"), F.lpad(q, 2, "0"))).when(n == 7, F.lit(None)).otherwise(q)
    return _keys(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quote.alias("quote"), body.alias("chunk_text"), F.when(n == 2, F.concat(F.lit("Said elsewhere  "), q, F.lit(" times."))).alias("doc_text"), value.alias("value_raw"))


@query(f"""WITH {_K} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 4 THEN 'quote not in the text' WHEN 5 THEN 'empty quote' END AS quote_reason,
CASE l_linenumber WHEN 3 THEN 'numbers not near the quote: 777' WHEN 4 THEN 'no value' END AS number_reason FROM k""")
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validation.validate_quotes(_written(spark, sf_dir))
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quote_reason", "number_reason")


@query("""WITH v AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q FROM lineitem), t AS (SELECT q, unnest([q, q * 10 + 1, 1000 + q]) AS held FROM v) SELECT q, held, q = held OR (held > 999 AND q = held - 1000 AND false) AS found FROM t""")
def number_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number is found by itself, not inside a longer number, and not across the spaces of one."""
    q = F.col("l_quantity").cast("long")
    rows = st.table(spark, sf_dir, "lineitem").select(q.alias("q")).distinct().select("q", F.explode(F.array(F.col("q"), F.col("q") * 10 + 1, F.col("q") + 1000)).alias("held"))
    shown = F.when(F.col("held") > 1000, F.concat(F.lit("1 "), F.lpad((F.col("held") - 1000).cast("string"), 3, "0"))).otherwise(F.col("held").cast("string"))
    return rows.select("q", "held", F.regexp_like(F.concat(F.lit("about "), shown, F.lit(" g")), numbers.number_pattern(F.col("q").cast("string"))).alias("found"))


def _labelled(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("Process", "Material", "Experiment", "Parameter", "Expert"))), (k % 5).cast("int") + 1)


_LABEL = "CASE {} % 5 WHEN 0 THEN 'Process' WHEN 1 THEN 'Material' WHEN 2 THEN 'Experiment' WHEN 3 THEN 'Parameter' ELSE 'Expert' END"
_ENDS = " OR ".join(f"(rel_type = '{r}' AND a IN ({', '.join(repr(x) for x in f)}) AND b IN ({', '.join(repr(x) for x in t)}))" for r, f, t in validation.ENDPOINTS)


@query(f"""WITH {_K}, t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_LABEL.format('l_partkey')} AS a, {_LABEL.format('l_suppkey')} AS b,
CASE l_linenumber % 3 WHEN 0 THEN 'HAS_CONDITION' WHEN 1 THEN 'PRODUCES' ELSE 'STUDIES' END AS rel_type, l_linenumber = 4 AS caption FROM k),
j AS (SELECT *, {_ENDS} AS fits FROM t), s AS (SELECT j.*, (SELECT {_ENDS} FROM (SELECT j.b AS a, j.a AS b, j.rel_type AS rel_type)) AND NOT fits AS swapped FROM j)
SELECT rel_type, CASE WHEN swapped THEN b ELSE a END AS src_label, CASE WHEN swapped THEN a ELSE b END AS dst_label, CASE WHEN swapped THEN 'direction' END AS auto_fixed,
nullif(concat_ws('; ', CASE WHEN NOT fits AND NOT swapped THEN 'ends do not fit the kind of edge' END, CASE WHEN caption AND rel_type IN ('PRODUCES', 'STUDIES') THEN 'quote is a caption' END), '') AS end_reason, count(*) AS n FROM s GROUP BY ALL""")
def endpoint_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "HAS_CONDITION").when(n % 3 == 1, "PRODUCES").otherwise("STUDIES")
    facts = _keys(spark, sf_dir).select(kind.alias("rel_type"), st.key("p", "l_partkey").alias("src"), _labelled(F.col("l_partkey")).alias("src_label"), st.key("s", "l_suppkey").alias("dst"), _labelled(F.col("l_suppkey")).alias("dst_label"), F.when(n == 4, "Рис. 3  Схема").otherwise("as said").alias("quote"))
    return validation.validate_ends(facts).groupBy("rel_type", "src_label", "dst_label", "auto_fixed", "end_reason").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS src, l_returnflag AS dst, CAST(l_quantity AS BIGINT) AS value_raw, l_suppkey % 3 AS lab FROM lineitem),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, src, dst) AS n FROM f) SELECT doc_id, src, dst, value_raw, n >= 2 AND lab <> 2 AS ambiguous FROM g""")
def ambiguity_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    facts = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), s.alias("src"), F.col("l_returnflag").alias("dst"), F.col("l_quantity").cast("long").cast("string").alias("value_raw"), F.lit("HAS_CONDITION").alias("rel_type"), F.when(s % 3 == 0, "Material").when(s % 3 == 1, "Process").otherwise("Experiment").alias("src_label")).distinct()
    return validation.flag_ambiguity(facts).select("doc_id", "src", "dst", F.col("value_raw").cast("long").alias("value_raw"), "ambiguous")


@query("""WITH f AS (SELECT DISTINCT l_orderkey, l_suppkey, l_quantity, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS c FROM lineitem)
SELECT l_suppkey AS src, CAST(l_quantity AS BIGINT) AS value_raw, count(*) AS n_before, min(struct_pack(c := c, chunk := l_linenumber, fact := l_orderkey)).fact AS fact_id FROM f GROUP BY 1, 2""")
def relation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    facts = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_suppkey").alias("src"), F.lit("x").alias("dst"), F.lit("PRODUCES").alias("rel_type"), F.col("l_quantity").cast("long").alias("value_raw"), F.lit(None).cast("string").alias("unit_raw"), F.lit("=").alias("operator_raw"), F.lit(None).cast("string").alias("value_text"), conf.alias("confidence"), F.col("l_linenumber").alias("chunk_idx")).distinct()
    counted = facts.groupBy("src", "value_raw").agg(F.count("*").alias("n_before"))
    return validation.dedupe(facts).join(counted, ["src", "value_raw"]).select("src", "value_raw", "n_before", "fact_id")


@query(f"WITH {_K}, e AS (SELECT DISTINCT l_orderkey, name FROM (SELECT l_orderkey, 'p' || l_partkey AS name FROM k WHERE l_linenumber <> 3 UNION ALL SELECT l_orderkey, 's' || l_suppkey FROM k WHERE l_linenumber <> 5)) SELECT l_orderkey AS doc_id, count(*) AS n FROM k WHERE EXISTS (SELECT 1 FROM e WHERE e.l_orderkey = k.l_orderkey AND e.name = 'p' || l_partkey) AND EXISTS (SELECT 1 FROM e WHERE e.l_orderkey = k.l_orderkey AND e.name = 's' || l_suppkey) GROUP BY 1")
def dangling_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keys(spark, sf_dir)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    facts = k.select(F.col("l_orderkey").alias("doc_id"), name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"))
    entities = k.where("l_linenumber <> 3").select(F.col("l_orderkey").alias("doc_id"), name("p", "l_partkey").alias("name")).union(k.where("l_linenumber <> 5").select("l_orderkey", name("s", "l_suppkey")))
    return validation.drop_dangling(facts, entities).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {_K} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(concat_ws('; ', CASE WHEN q < 10 THEN 'quote too short' END, CASE WHEN flag = 'R' THEN 'number doubtful' END, CASE WHEN l_linenumber = 1 THEN 'ends' END), '') AS reason, nullif(concat_ws('; ', CASE WHEN flag = 'R' THEN 'number doubtful' END, CASE WHEN l_linenumber = 1 THEN 'ends' END), '') AS stripped FROM k")
def reasons_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = validation.reasons(F.when(F.col("q") < 10, F.lit("quote too short")), F.when(F.col("flag") == "R", F.lit("number doubtful")), F.when(F.col("l_linenumber") == 1, F.lit("ends")))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return _keys(spark, sf_dir).select(*keys, reason.alias("reason")).select(*keys, "reason", validation.strip_reasons("reason", "quote").alias("stripped"))


@query("""WITH cur AS (SELECT o_orderkey AS source_doc_id, o_custkey AS v FROM orders WHERE o_orderkey % 3 <> 0), inc AS (SELECT o_orderkey AS source_doc_id, -o_custkey AS v FROM orders WHERE o_orderkey % 5 = 0)
SELECT source_doc_id, v FROM cur WHERE source_doc_id % 5 <> 0 UNION ALL SELECT source_doc_id, v FROM inc""")
def replace_by_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_doc_id"), F.col("o_custkey").alias("v"))
    changed = rows.where("source_doc_id % 5 = 0").select("source_doc_id", (-F.col("v")).alias("v"))
    return mutation.replace_by_provenance(rows.where("source_doc_id % 3 <> 0"), changed, changed.select(F.col("source_doc_id").alias("doc_id")))


@query("""SELECT c_custkey AS entity_id, 'Material' AS label, CASE WHEN c_custkey % 2 = 0 THEN 'cur' ELSE 'inc' END AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'Alpha|beta|gamma' WHEN c_custkey % 2 = 0 THEN 'Alpha|beta' ELSE 'BETA|gamma' END AS aliases FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def alias_union_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.lit("Material").alias("label"))
    current = ids.where("entity_id % 2 = 0").select("*", F.lit("cur").alias("name"), F.array(F.lit("Alpha"), F.lit("beta")).alias("aliases"))
    incoming = ids.where("entity_id % 3 = 0").select("*", F.lit("inc").alias("name"), F.array(F.lit("BETA"), F.lit("gamma")).alias("aliases"))
    return mutation.upsert_entities(current, incoming).withColumn("aliases", F.array_join("aliases", "|"))


@query("""WITH e AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, value, ts, event_id FROM events),
last AS (SELECT key, arg_max(op, struct_pack(t := ts, s := event_id)) AS op, max(ts) AS edited_at FROM e GROUP BY key), sets AS (SELECT key, arg_max(value, struct_pack(t := ts, s := event_id)) AS v FROM e WHERE op = 'set' GROUP BY key),
base AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer)
SELECT key, coalesce(v, value) AS value, coalesce(op = 'delete', false) AS deleted, op AS edited_by, edited_at FROM base FULL JOIN last USING (key) LEFT JOIN sets USING (key)""")
def edit_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances after the events as a log of edits."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    edits = st.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), op.alias("op"), "value", op.alias("edited_by"), F.col("ts").alias("edited_at"), F.col("event_id").alias("seq"))
    base = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return mutation.fold_edits(base, edits)


_STOP = ", ".join(f"'{w}'" for w in text.CONTENT_STOP_WORDS)
_STEMS = r"list_distinct(list_transform(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4 AND t NOT IN (" + _STOP + ")), lambda t: left(t, 5)))"


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), b AS MATERIALIZED (SELECT item_id AS statement_id, item_id % n AS k, {_STEMS.format('text')} AS own FROM benchmark, n),
d AS MATERIALIZED (SELECT doc_id % n AS k, {_STEMS.format('text')} AS held FROM documents, n),
f AS (SELECT statement_id, max(CASE WHEN len(own) > 0 THEN len(list_intersect(own, held)) * 1.0::DOUBLE / len(own) ELSE 0 END) AS best FROM b JOIN d USING (k) GROUP BY 1) SELECT statement_id, round(best, 3) AS faithfulness, best >= 0.55 AS verified FROM f""")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as statements; every document is a citation of one of them."""
    items, n = st.table(spark, sf_dir, "benchmark"), st.table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    said = items.crossJoin(n).select(F.col("item_id").alias("statement_id"), F.col("text").alias("statement"), (F.col("item_id") % F.col("n")).alias("k"))
    cited = st.table(spark, sf_dir, "documents").crossJoin(n).select((F.col("doc_id") % F.col("n")).alias("k"), "text")
    joined = said.join(cited, "k").select(F.lit(0).alias("hypothesis_id"), "statement_id", "statement", "text", F.lit(0.0).alias("similarity"))
    return hypotheses.verify(joined).drop("hypothesis_id")


def _hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, b = F.col("p_partkey"), lambda x: x.cast("double")
    return st.table(spark, sf_dir, "part").select(
        p.alias("hypothesis_id"), b((p % 10) / 10).alias("max_similarity"), b((p % 4) / 4).alias("rarity"), (p % 3 == 0).alias("is_abc"), b((p % 7) / 8).alias("alignment"), F.when(p % 5 == 0, "to be seen").otherwise(F.concat(F.lit("+"), (p % 9).cast("string"), F.lit(",5 %"))).alias("effect"),
        (p % 4).alias("n_citations"), F.least(p % 4, F.lit(1)).alias("n_authoritative"), F.lit(0).alias("n_recent"), b((p % 3) / 2).alias("metric"), (p % 6).alias("n_factors"), F.least(p % 6, F.lit(2)).alias("n_controllable"), b((p % 8) / 8).alias("mean_faithfulness"), b((p % 2) / 2).alias("unverified_share"), (p % 11 == 0).alias("contradicted"),
    )


_SCORES = """s AS (SELECT p_partkey AS hypothesis_id,
 round(greatest(0, least(1, 0.7::DOUBLE * (1 - (p_partkey % 10) / 10.0::DOUBLE) + 0.3::DOUBLE * ((p_partkey % 4) / 4.0::DOUBLE) + CASE WHEN p_partkey % 3 = 0 THEN 0.2::DOUBLE ELSE 0 END)), 3) AS novelty,
 round(greatest(0, least(1, 0.5::DOUBLE * ((p_partkey % 7) / 8.0::DOUBLE) + 0.3::DOUBLE * CASE WHEN p_partkey % 5 = 0 THEN 0.3::DOUBLE ELSE least(1, (p_partkey % 9 + 0.5::DOUBLE) / 5) END + 0.2::DOUBLE * CASE WHEN p_partkey % 4 = 0 THEN 0.3::DOUBLE ELSE 0.6::DOUBLE / (p_partkey % 4) END)), 3) AS value,
 round(greatest(0, least(1, 0.4::DOUBLE * ((p_partkey % 3) / 2.0::DOUBLE) + 0.3::DOUBLE * CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE least(p_partkey % 6, 2) * 1.0::DOUBLE / (p_partkey % 6) END + 0.3::DOUBLE * (1 - least(1, (p_partkey % 6) / 5.0::DOUBLE)))), 3) AS testability,
 round(greatest(0, least(1, 0.4::DOUBLE * (1 - (p_partkey % 8) / 8.0::DOUBLE) + 0.3::DOUBLE * ((p_partkey % 2) / 2.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END + 0.1::DOUBLE * CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END)), 3) AS risk FROM part)"""


@query(f"WITH {_SCORES} SELECT * FROM s")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypotheses.scores(_hypotheses(spark, sf_dir)).select("hypothesis_id", "novelty", "value", "testability", "risk")


_TOTAL = "t AS (SELECT hypothesis_id, round(greatest(0, least(1, round({n}::DECIMAL(9,4) * novelty::DECIMAL(9,3), 3)::DOUBLE + round({v}::DECIMAL(9,4) * value::DECIMAL(9,3), 3)::DOUBLE + round({t}::DECIMAL(9,4) * testability::DECIMAL(9,3), 3)::DOUBLE + round((-{r})::DECIMAL(9,4) * risk::DECIMAL(9,3), 3)::DOUBLE)), 3) AS total FROM s)"


@query(f"WITH {_SCORES}, {_TOTAL.format(n=0.3, v=0.3, t=0.25, r=0.15)} SELECT hypothesis_id, total FROM t")
def score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypotheses.totals(hypotheses.scores(_hypotheses(spark, sf_dir))).select("hypothesis_id", "total")


@query(f"WITH {_SCORES}, {_TOTAL.format(n=0.1, v=0.6, t=0.2, r=0.4)} SELECT hypothesis_id, total, row_number() OVER (ORDER BY total DESC, hypothesis_id) AS rank FROM t ORDER BY rank LIMIT 20")
def score_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = hypotheses.Weights(novelty=0.1, value=0.6, testability=0.2, risk=0.4)
    return hypotheses.totals(hypotheses.scores(_hypotheses(spark, sf_dir)), weights, top=20).select("hypothesis_id", "total", "rank")


@query("""WITH kept AS (SELECT l_orderkey AS source_doc_id, l_linenumber, CAST(l_quantity AS DOUBLE) AS value, 'v1' AS version FROM lineitem WHERE l_orderkey % 7 <> 0)
SELECT 'facts' AS name, * FROM kept UNION ALL SELECT 'claims', * FROM kept
UNION ALL SELECT 'facts', l_orderkey, l_linenumber, l_quantity + 1, 'v2' FROM lineitem WHERE l_orderkey % 7 = 0 AND l_orderkey % 35 <> 0 AND l_linenumber = 1""")
def write_document_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as documents with facts and claims, then every seventh again with a first fact only, and every thirty-fifth without any; none brings claims again. The rest comes unchanged and is skipped."""
    li = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_doc_id"), "l_linenumber", F.col("l_quantity").cast("double").alias("value"))
    orders = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    rows = li.withColumn("version", F.lit("v1"))
    first = mutation.save_tables(mutation.write_documents({}, orders.withColumn("content_hash", F.lit("one")), {"facts": rows, "claims": rows}).tables, fresh_folder(spark, "store"))
    again = li.where("source_doc_id % 35 <> 0 AND l_linenumber = 1").withColumns({"value": F.col("value") + 1, "version": F.lit("v2")})
    changed = orders.withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "two").otherwise("one"))
    second = mutation.write_documents(first, changed, {"facts": again}).tables
    named = [second[n].select(F.lit(n).alias("name"), "source_doc_id", "l_linenumber", "value", "version") for n in ("facts", "claims")]
    return named[0].unionByName(named[1])


@query("""SELECT 'facts' AS "table", 'unchanged' AS reason, count(*) AS n_rows FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0
UNION ALL SELECT 'facts', 'unknown', count(*) FROM lineitem WHERE l_orderkey % 11 = 0""")
def write_document_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many incoming rows a write does not take: those of documents that are stored as they are, and of documents that it does not name."""
    rows = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_doc_id"), "l_linenumber")
    orders = st.table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("k"))
    stored = {"documents": orders.select("doc_id", F.lit("one").alias("content_hash"))}
    given = orders.select("doc_id", F.when(F.col("k") % 7 == 0, "two").otherwise("one").alias("content_hash"))
    return mutation.write_documents(stored, given, {"facts": rows}).left_out


@query("""WITH RECURSIVE log AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'add_edge' WHEN 'error' THEN 'delete_edge' WHEN 'purchase' THEN 'merge_nodes' END AS op, user_id, event_id % 7 AS other, event_type FROM events WHERE event_type IN ('click', 'error', 'purchase')),
last AS (SELECT user_id AS src, other AS dst, arg_max(op, seq) AS op, bool_or(op = 'add_edge') AS added FROM log WHERE op <> 'merge_nodes' GROUP BY 1, 2),
base AS (SELECT DISTINCT user_id AS src, event_id % 7 AS dst FROM events WHERE event_type = 'view'),
kept AS (SELECT coalesce(b.src, l.src) AS src, coalesce(b.dst, l.dst) AS dst, coalesce(op = 'delete_edge', false) AS deleted, op FROM base b FULL JOIN last l ON b.src = l.src AND b.dst = l.dst WHERE b.src IS NOT NULL OR added),
merges AS (SELECT DISTINCT user_id AS victim, user_id - 3 AS survivor FROM log WHERE op = 'merge_nodes' AND user_id % 5 <> 0 AND user_id > 3),
roots AS (SELECT victim, survivor FROM merges UNION ALL SELECT r.victim, m.survivor FROM roots r JOIN merges m ON r.survivor = m.victim),
ends AS (SELECT victim, min(survivor) AS survivor FROM roots GROUP BY victim)
SELECT DISTINCT 'n' || coalesce(e.survivor, src) AS src_key, 't' || dst AS dst_key, 'USES' AS rel_type, deleted, op AS edited_by FROM kept LEFT JOIN ends e ON src = e.victim""")
def edit_ops_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as edges, and the other events as a log: clicks add edges, errors delete them, purchases merge a node into the third before it, so that merges form chains."""
    e = st.table(spark, sf_dir, "events")
    node, target = lambda c: F.concat(F.lit("n"), c.cast("string")), F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string"))
    op = F.when(F.col("event_type") == "click", "add_edge").when(F.col("event_type") == "error", "delete_edge").when((F.col("event_type") == "purchase") & (F.col("user_id") % 5 != 0) & (F.col("user_id") > 3), "merge_nodes")
    merge = F.col("event_type") == "purchase"
    log = e.select(F.col("event_id").alias("seq"), op.alias("op"), F.when(merge, node(F.col("user_id") - 3)).otherwise(node(F.col("user_id"))).alias("a"), F.when(merge, node(F.col("user_id"))).otherwise(target).alias("b"), F.lit("USES").alias("rel_type"), op.alias("edited_by"))
    edges = e.where("event_type = 'view'").select(node(F.col("user_id")).alias("src_key"), target.alias("dst_key"), F.lit("USES").alias("rel_type")).distinct()
    return mutation.edit_edges(edges, log.where("op IS NOT NULL"))


@query("""WITH f AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS fact_id, l_returnflag AS rel_type, l_linestatus = 'F' AND l_tax = 0 AS deleted, l_linenumber AS mode FROM lineitem),
c AS (SELECT fact_id, min(new_type) AS new_type FROM (SELECT fact_id, CASE WHEN mode = 1 THEN 'A' ELSE 'X' END AS new_type FROM f WHERE mode <= 2 UNION ALL SELECT fact_id, 'X' FROM f WHERE mode <= 2) GROUP BY 1),
n AS (SELECT f.*, new_type FROM f JOIN c USING (fact_id) WHERE rel_type <> new_type AND NOT deleted)
SELECT rel_type, deleted, edited_by, count(*) AS n FROM (SELECT f.rel_type, f.deleted OR n.fact_id IS NOT NULL AS deleted, CASE WHEN n.fact_id IS NOT NULL THEN 'me' END AS edited_by FROM f LEFT JOIN (SELECT DISTINCT fact_id FROM n) n USING (fact_id) UNION ALL SELECT new_type, false, 'me' FROM n) GROUP BY ALL""")
def retype_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as facts: the first two of an order change their kind, each change given twice."""
    li = st.table(spark, sf_dir, "lineitem")
    fact = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    facts = li.select(fact.alias("fact_id"), F.col("l_returnflag").alias("rel_type"), ((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0)).alias("deleted"), F.lit(None).cast("string").alias("edited_by"))
    some = li.where("l_linenumber <= 2").select(fact.alias("fact_id"), F.when(F.col("l_linenumber") == 1, "A").otherwise("X").alias("rel_type"))
    return mutation.retype(facts, some.unionByName(some.withColumn("rel_type", F.lit("X"))), "me").groupBy("rel_type", "deleted", "edited_by").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS claim_id, (SELECT max(event_id) FROM events WHERE user_id = o_custkey AND event_type = 'click') AS superseded_by FROM orders""")
def supersede_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims, superseded by the clicks of their customer: of many the last one counts."""
    orders = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), "o_custkey")
    clicks = st.table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("o_custkey"), F.col("event_id").alias("superseded_by"))
    return mutation.supersede(orders.select("claim_id"), orders.join(clicks, "o_custkey").select("claim_id", "superseded_by"))
