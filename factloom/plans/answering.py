"""Queries on goals, plans, the sources of answers, tables, chunks, snippets and the audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import chunking, text
from factloom.operators import names, planning, units
from factloom.plans import standins as st
from factloom.plans.registry import Catalogue
from factloom.sources import files

CATALOGUE = Catalogue()
query = CATALOGUE.add

_DICTIONARY = [("metal.Ni", "metal", "никеля"), ("process.smelting", "process", "плавки"), ("param.recovery", "parameter", "извлечение"), ("param.energy", "parameter", "энергозатраты")]
_NAMES = [("metal.Ni", "никель", "nickel"), ("process.smelting", "плавка", "smelting"), ("param.recovery", "извлечение", "recovery"), ("param.energy", "энергозатраты", "energy")]


def _goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A goal for each part: what to change, of which metal or process, by how much and within which limits."""
    p = F.col("p_partkey")
    verb = F.element_at(F.array(*map(F.lit, ("Повысить", "Снизить", "Изменить"))), (p % 3).cast("int") + 1)
    what = F.when(p % 2 == 0, "извлечение никеля").otherwise("энергозатраты плавки")
    by = F.when(p % 5 == 0, "").otherwise(F.concat(F.lit(" на "), (p % 9 + 1).cast("string"), F.lit(",5 %")))
    goals = st.table(spark, sf_dir, "part").select(p.alias("goal_id"), F.concat(verb, F.lit(" "), what, by, F.when(p % 4 == 0, "; при том же расходе").otherwise("")).alias("text"))
    kinds = F.create_map(*[F.lit(x) for e, kind, _ in _DICTIONARY for x in (e, kind)])
    found = names.find_names(goals, spark.createDataFrame(_DICTIONARY, "entity_id string, type string, name string"), "goal_id")
    return planning.parse_goals(goals, found.select("goal_id", "entity_id", kinds[F.col("entity_id")].alias("type"), "start_at"))


_GOALS = """g AS (SELECT p_partkey AS goal_id, p_partkey % 2 = 0 AS ni, CASE WHEN p_partkey % 3 = 1 OR (p_partkey % 3 = 2 AND p_partkey % 2 = 1) THEN 'decrease' ELSE 'increase' END AS direction,
CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 9 + 1.5::DOUBLE END AS magnitude, CASE WHEN p_partkey % 4 = 0 THEN 'при том же расходе' ELSE '' END AS limits,
CASE p_partkey % 3 WHEN 0 THEN 'Повысить' WHEN 1 THEN 'Снизить' ELSE 'Изменить' END || CASE WHEN p_partkey % 2 = 0 THEN ' извлечение никеля' ELSE ' энергозатраты плавки' END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' на ' || (p_partkey % 9 + 1) || ',5 %' END || CASE WHEN p_partkey % 4 = 0 THEN '; при том же расходе' ELSE '' END AS text FROM part)"""


@query(f"WITH {_GOALS} SELECT goal_id, CASE WHEN ni THEN 'metal.Ni' END AS target, CASE WHEN NOT ni THEN 'process.smelting' END AS process, CASE WHEN ni THEN 'param.recovery' ELSE 'param.energy' END AS metric, direction, magnitude, limits FROM g")
def kpi_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _goals(spark, sf_dir).select("goal_id", "target", "process", "metric", "direction", "magnitude", F.array_join("constraints", "|").alias("limits"))


def _filled(template: str) -> str:
    for key, value in (("direction", "d"), ("metric_en", "me"), ("metric", "m"), ("target_en", "te"), ("target", "t"), ("process_en", "pe"), ("process", "p")):
        template = template.replace("{" + key + "}", f"' || {value} || '")
    return f"'{template}'"


@query(f"""WITH {_GOALS}, s AS (SELECT *, CASE direction WHEN 'increase' THEN 'повышение' ELSE 'снижение' END AS d, 'никель' AS t, 'nickel' AS te, CASE WHEN ni THEN 'флотация' ELSE 'плавка' END AS p, CASE WHEN ni THEN 'flotation' ELSE 'smelting' END AS pe,
CASE WHEN ni THEN 'извлечение' ELSE 'энергозатраты' END AS m, CASE WHEN ni THEN 'recovery' ELSE 'energy' END AS me FROM g), l AS (SELECT goal_id, [text, {', '.join(map(_filled, planning.SUBQUERIES))}] AS q FROM s)
SELECT goal_id, CAST(unnest(range(0, 8)) AS INTEGER) AS ord, unnest(q) AS subquery FROM l""")
def goal_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.subqueries(_goals(spark, sf_dir), spark.createDataFrame(_NAMES, "entity_id string, name_ru string, name_en string"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH t AS (SELECT conv_id, turn, role, lower(trim(text)) AS t FROM conversations), w AS (SELECT *, regexp_extract_all(t, '[a-zа-яё]+') AS w FROM t)
SELECT conv_id, turn, role, t = '' OR (NOT (contains(t, '?') OR list_has_any(w, {_LIST(planning.QUESTION_WORDS)})) AND (list_has_any(w, {_LIST(planning.TALK_WORDS)}) OR len(list_filter({_LIST(planning.TALK_PHRASES)}, lambda x: contains(t, x))) > 0 OR length(t) <= 40)) AS talk FROM w""")
def small_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", planning.is_small_talk("text").alias("talk"))


@query("""SELECT o_orderkey AS plan_id, CASE o_orderkey % 6 WHEN 1 THEN 'review' WHEN 2 THEN 'compare' WHEN 3 THEN 'gaps' ELSE 'search' END AS intent, CASE WHEN o_orderkey % 6 = 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'method' ELSE 'geography' END WHEN o_orderkey % 5 = 0 AND o_orderkey % 6 <> 5 THEN 'method' END AS compare_by,
CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderstatus = 'F' THEN 'RU' WHEN o_orderstatus = 'O' THEN 'foreign' END AS geography, CASE WHEN o_orderkey % 6 <> 5 AND o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year_from,
CASE WHEN o_orderkey % 6 = 5 THEN '' WHEN o_orderkey % 2 = 0 THEN 'patent' ELSE 'patent|report' END AS doc_types, CASE WHEN o_orderkey % 6 = 5 THEN 'question' ELSE 'asked ' || o_custkey END AS query_ru FROM orders""")
def plan_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as a model writes them: other cases, unknown words, scalars for lists, years that are none, and broken JSON."""
    k, place = F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "RU").when(F.col("o_orderstatus") == "O", " foreign ").otherwise("both")
    intent = F.element_at(F.array(*map(F.lit, ("search", "Review", " compare", "GAPS", "dance", ""))), (k % 6).cast("int") + 1)
    filters = F.concat(F.lit('{"geography": "'), place, F.lit('", "year_from": '), F.when(k % 7 == 0, '"none"').otherwise(F.year("o_orderdate").cast("string")), F.lit(', "doc_types": '), F.when(k % 2 == 0, '"patent"').otherwise('["patent", " ", "report"]'), F.lit("}"))
    payload = F.concat(F.lit('{"intent": "'), intent, F.lit('", "compare_by": "'), F.when(k % 5 == 0, "method").otherwise("colour"), F.lit('", "query_text_ru": "asked '), F.col("o_custkey").cast("string"), F.lit('", "filters": '), filters, F.lit("}"))
    plans = st.table(spark, sf_dir, "orders").select(k.alias("plan_id"), F.lit("question").alias("question"), F.when(k % 6 == 5, "{broken").otherwise(payload).alias("payload"))
    return planning.coerce_plans(plans).select("plan_id", "intent", "compare_by", "geography", "year_from", F.array_join("doc_types", "|").alias("doc_types"), "query_ru")


_ORD = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1"


@query(f"""WITH l AS (SELECT l_orderkey AS plan_id, l_partkey, l_suppkey, l_returnflag AS flag, {_ORD} AS ord FROM lineitem), cited AS (SELECT plan_id, l_partkey AS doc_id, min(ord) AS pos FROM l GROUP BY 1, 2),
said AS (SELECT plan_id, l_suppkey AS doc_id, min(ord) AS fact, arg_min(CASE WHEN flag = 'A' THEN '' ELSE flag END, ord) AS quote FROM l GROUP BY 1, 2),
b AS (SELECT plan_id, doc_id, pos, coalesce(quote, '') AS quote, row_number() OVER (PARTITION BY plan_id ORDER BY pos NULLS LAST, fact, doc_id) AS n FROM cited FULL JOIN said USING (plan_id, doc_id))
SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY pos NULLS LAST, quote = '', p_name, doc_id) - 1 AS ord, doc_id, p_name AS title, quote, pos IS NOT NULL AS cited FROM b JOIN part ON p_partkey = doc_id WHERE pos IS NOT NULL OR n <= 8""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers that cite their parts; suppliers as the documents of facts."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), "l_partkey", "l_suppkey", "l_returnflag", (F.row_number().over(order) - 1).alias("ord"))
    cites = lines.groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "l_partkey"))), lambda x: F.concat(F.lit("see [P"), x["l_partkey"].cast("string"), F.lit("]"))), "; ").alias("answer"))
    keys = lines.select("plan_id", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("cite_key"), F.col("l_partkey").alias("doc_id")).distinct()
    facts = lines.select("plan_id", "ord", F.col("l_suppkey").alias("doc_id"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("quote"))
    docs = st.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    return planning.sources(cites, keys, facts, docs).withColumn("ord", F.col("ord").cast("long"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_suppkey AS s, l_returnflag AS f, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, l_partkey AS p FROM lineitem)
SELECT id, string_agg('line ' || n || ': Quantity = ' || q || '; Part = ' || p || '.', chr(10) ORDER BY n, p, s, f, q) AS text FROM l GROUP BY id""")
def table_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: a head without a label, and a row per line."""
    n, s = F.col("l_linenumber"), lambda c: F.col(c).cast("long").cast("string")
    row = F.array(F.concat(F.lit("line "), n.cast("string")), s("l_quantity"), s("l_partkey"))
    rows = st.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", row.alias("row")))).alias("held"))
    head = F.array(F.array(F.lit(""), F.lit("Quantity"), F.lit("Part")))
    return chunking.linear_tables(rows.select("id", F.concat(head, F.transform("held", lambda x: x["row"])).alias("rows")))


@query()
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document with their digests; one that fits the budget is one chunk."""
    return chunking.chunk_documents(st.table(spark, sf_dir, "documents")).select("doc_id", "idx", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query()
def smart_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shows for the query tokens of one of the benchmark's texts."""
    items = st.table(spark, sf_dir, "benchmark")
    n = items.agg(F.count("*").alias("n"))
    asked = items.crossJoin(n).select((F.col("item_id") % F.col("n")).alias("k"), text.query_tokens("text").alias("words"))
    docs = st.table(spark, sf_dir, "documents").crossJoin(n).select("doc_id", "text", (F.col("doc_id") % F.col("n")).alias("k"))
    return chunking.snippets(docs.join(asked, "k")).select("doc_id", F.length("snippet").cast("long").alias("n_chars"), F.sha2("snippet", 256).alias("snippet_sha256"))


_ZERO = "CASE l_suppkey % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE END"


@query(f"""WITH v AS (SELECT l_suppkey % 3 AS unit, CAST(l_quantity AS BIGINT) % 10 - 5 AS v, {_ZERO} AS d FROM lineitem)
SELECT unit, v, count(*) AS n, any_value(CASE WHEN v = 0 THEN 0 - coalesce(d, 0) ELSE round(least(0.9::DOUBLE * v, 1.1::DOUBLE * v), 6) END) AS value_min, any_value(CASE WHEN v = 0 THEN coalesce(d, 0) ELSE round(greatest(0.9::DOUBLE * v, 1.1::DOUBLE * v), 6) END) AS value_max, any_value(v = 0 AND d IS NULL) AS needs_review FROM v GROUP BY unit, v""")
def approx_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a value: a tenth to both sides; about zero what the unit's kind allows, or a review."""
    unit, v = (F.col("l_suppkey") % 3).alias("unit"), (F.col("l_quantity").cast("long") % 10 - 5).alias("v")
    rows = st.table(spark, sf_dir, "lineitem").groupBy(unit, v).agg(F.count("*").alias("n"))
    named = rows.select("*", F.col("v").cast("string").alias("value_raw"), F.element_at(F.array(F.lit("°C"), F.lit("pH"), F.lit("руб/т")), F.col("unit").cast("int") + 1).alias("unit_raw"), F.lit("~").alias("operator_raw"))
    read = units.parse_measurements(named, units.seed_units(spark))
    return read.select("unit", "v", "n", F.round("interval.value_min", 6).alias("value_min"), F.round("interval.value_max", 6).alias("value_max"), F.col("interval.needs_review").alias("needs_review"))


@query("""WITH good AS (SELECT event_id AS seq, event_type AS endpoint, user_id AS status FROM events WHERE event_type <> 'error') SELECT * FROM (SELECT * FROM good ORDER BY seq DESC LIMIT 100) ORDER BY seq""")
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred records of a trail whose lines of one kind are broken."""
    whole = F.to_json(F.struct(F.col("event_type").alias("endpoint"), F.col("user_id").alias("status")))
    lines = st.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.substring(whole, 1, 9)).otherwise(whole).alias("value"))
    return files.audit_tail(lines, "endpoint string, status long", 100)
