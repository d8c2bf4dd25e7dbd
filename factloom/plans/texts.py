"""Queries on text functions, numbers, units and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names, numbers, text
from factloom.operators import resolution, units
from factloom.plans import standins as st
from factloom.plans.registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "documents")


NORMAL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(8239), ' '), '\r\n?', chr(10), 'g'),
 '[\t\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+(\n|\z)', '\1', 'g'), '\n[ \t]*\n[ \t]*(?:\n[ \t]*)+', chr(10) || chr(10), 'g'), '\A[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z', '', 'g')"""


@query(rf"""WITH padded AS (SELECT doc_id, '  ' || chr(13) || chr(10) || replace(text, ' a', chr(160) || 'a') || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end ' || chr(8239) AS text FROM documents)
SELECT doc_id, length({NORMAL_SQL}) AS n, md5({NORMAL_SQL}) AS text_md5 FROM padded""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  \r\n"), F.replace("text", F.lit(" a"), F.lit(" a")), F.lit("  \n\n\n\nend  "))
    return _docs(spark, sf_dir).select("doc_id", text.normalize_text(padded).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text_md5"))


@query(rf"""WITH h AS (SELECT doc_id, sha256({NORMAL_SQL}) AS content_hash FROM documents) SELECT content_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM h GROUP BY content_hash""")
def text_content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content."""
    hashed = _docs(spark, sf_dir).select("doc_id", text.content_hash("text").alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query("""SELECT doc_id, length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g')) AS n_cyrillic, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_latin,
CASE WHEN length(regexp_replace(t, '[^Ѐ-ӿ]', '', 'g')) >= length(regexp_replace(t, '[^A-Za-z]', '', 'g')) THEN 'ru' ELSE 'en' END AS detected
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || 'электроэкстракция никеля из католита при высокой плотности тока' ELSE text END AS t FROM documents)""")
def text_lang_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("электроэкстракция никеля из католита при высокой плотности тока"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", text.count_matches("t", "Ѐ-ӿ").alias("n_cyrillic"), text.count_matches("t", "A-Za-z").alias("n_latin"), text.detect_lang("t").alias("detected"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(0, greatest(CASE WHEN len(words) <= 180 THEN 1 ELSE CAST(ceil((len(words) - 180) / 140.0) AS BIGINT) * 140 + 1 END, 1), 140)) AS first_word FROM w WHERE len(words) > 0),
k AS (SELECT doc_id, first_word, array_to_string(words[first_word + 1 : first_word + 180], ' ') AS t, len(words[first_word + 1 : first_word + 180]) AS n_words FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_word) - 1 AS idx, first_word, n_words, md5(t) AS text_md5 FROM k WHERE length(t) >= 80""")
def text_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _docs(spark, sf_dir).select("doc_id", F.explode(text.word_windows("text")).alias("w"))
    return windows.select("doc_id", F.col("w.idx").cast("long").alias("idx"), F.col("w.first_word").cast("long").alias("first_word"), F.size("w.words").cast("long").alias("n_words"), F.md5(F.array_join("w.words", " ")).alias("text_md5"))


@query(r"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", text.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_CONTENT_STOP = ", ".join(f"'{w}'" for w in text.CONTENT_STOP_WORDS)
_QUERY_STOP = ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS)


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 4 AND t NOT IN ({_CONTENT_STOP})), lambda t: left(t, 5)))), ' ') AS stems FROM documents""")
def text_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(text.prefix_tokens("text")), " ").alias("stems"))


@query(rf"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '[0-9A-Za-zА-Яа-яЁё]{{4,}}')) AS w, generate_subscripts(regexp_extract_all(text, '[0-9A-Za-zА-Яа-яЁё]{{4,}}'), 1) AS i FROM benchmark),
f AS (SELECT item_id, lower(w) AS w, min(i) AS i FROM t WHERE lower(w) NOT IN ({_QUERY_STOP}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM f)
SELECT item_id, string_agg(w, ' OR ' ORDER BY i) AS lucene FROM r WHERE n <= 16 GROUP BY item_id""")
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "benchmark").select("item_id", text.lucene_query("text").alias("lucene"))


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE regexp_replace(left(t, 280), ' [^ ]*\z', '') || '…' END AS quoted FROM (SELECT doc_id, trim(text) AS t FROM documents)""")
def text_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.quote("text").alias("quoted"))


@query("""SELECT doc_id, 'About: ' || doc_id AS title, lang, CAST(2000 + doc_id % 25 AS INTEGER) AS year, doc_id % 2 = 0 AS has_tags, length(text) AS n_body FROM documents""")
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("---\ntitle: \"About: "), d, F.lit("\"\nyear: "), (2000 + F.col("doc_id") % 25).cast("string"), F.lit("\nlang: "), "lang", F.when(F.col("doc_id") % 2 == 0, "\ntags: [#One, two]").otherwise(""), F.lit("\n---\n"), "text")
    read = _docs(spark, sf_dir).select("doc_id", raw.alias("raw")).select("doc_id", text.front_matter("raw").alias("m"), text.body_after_front_matter("raw").alias("body"), text.tags("raw").alias("tags"))
    return read.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["lang"].alias("lang"), F.col("m")["year"].cast("int").alias("year"), (F.col("tags") == F.array(F.lit("one"), F.lit("two"))).alias("has_tags"), F.length("body").cast("long").alias("n_body"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'report' ELSE 'patent' END AS doc_type, CASE WHEN lang = 'en' THEN 'en' END AS lang, CAST(1990 + doc_id % 35 AS INTEGER) AS year FROM documents""")
def file_name_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    stem = F.concat_ws("_", F.lit("doc"), d.cast("string"), F.when(d % 2 == 0, "Report").otherwise("patent"), "lang", (1990 + d % 35).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", text.file_name_facts(stem).alias("f")).select("doc_id", "f.*")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as texts: value_raw, unit_raw and operator_raw in the forms in which documents write them."""
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    b = (F.col("l_quantity") + 10).cast("long").cast("string")
    kind = (F.col("l_partkey") % 8).cast("int")
    value = F.element_at(F.array(F.concat(q, F.lit(","), n), F.concat(q, F.lit("–"), b), F.concat(F.lit("от "), q, F.lit(" до "), b), F.concat(q, F.lit(".."), b), F.concat(F.lit("−"), q), F.concat(F.lit("1 0"), F.lpad(q, 2, "0")), F.lit("много"), F.concat(q, F.lit("-"), b)), kind + 1)
    unit = F.element_at(F.array(F.lit("г/л"), F.lit("K"), F.lit("мг/л"), F.lit(" "), F.lit("фунт")), (F.col("l_suppkey") % 5).cast("int") + 1)
    operator = F.element_at(F.array(F.lit("="), F.lit("<"), F.lit(">="), F.lit("~"), F.lit("range"), F.lit("")), (F.col("l_orderkey") % 6).cast("int") + 1)
    return st.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_orderkey").alias("doc_id"), value.alias("value_raw"), unit.alias("unit_raw"), operator.alias("operator_raw"))


# The oracle computes from the numbers that the texts were written from: a and b of the range, v for the first number.
_RAW = """raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_partkey % 8 AS kind, l_orderkey % 6 AS op, l_suppkey % 5 AS un,
         CASE l_partkey % 8 WHEN 0 THEN l_quantity + l_linenumber / 10.0::DOUBLE WHEN 4 THEN -l_quantity WHEN 5 THEN 1000 + l_quantity WHEN 6 THEN NULL ELSE l_quantity END AS v,
         l_partkey % 8 IN (1, 2, 3, 7) AS is_range, l_quantity AS a, l_quantity + 10 AS b FROM lineitem),
intervals AS (
  SELECT *, CASE WHEN is_range AND op IN (4, 5) THEN a WHEN op = 1 THEN NULL WHEN op = 3 THEN least(0.9::DOUBLE * v, 1.1::DOUBLE * v) ELSE v END AS lo,
         CASE WHEN is_range AND op IN (4, 5) THEN b WHEN op = 2 THEN NULL WHEN op = 3 THEN greatest(0.9::DOUBLE * v, 1.1::DOUBLE * v) ELSE v END AS hi FROM raw)"""


@query(f"WITH {_RAW} SELECT kind, op, count(*) AS n, count(lo) AS n_lo, count(hi) AS n_hi, round(sum(lo), 3) AS sum_lo, round(sum(hi), 3) AS sum_hi FROM intervals GROUP BY kind, op")
def operator_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _measured(spark, sf_dir).select((F.col("l_partkey") % 8).alias("kind"), (F.col("l_orderkey") % 6).alias("op"), numbers.raw_interval("value_raw", "operator_raw").alias("r"))
    return r.groupBy("kind", "op").agg(F.count("*").alias("n"), F.count("r.lo").alias("n_lo"), F.count("r.hi").alias("n_hi"), F.round(F.sum("r.lo"), 3).alias("sum_lo"), F.round(F.sum("r.hi"), 3).alias("sum_hi"))


@query(f"WITH {_RAW} SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, round(sum(v), 3) AS sum_first, CAST(sum(CASE WHEN kind = 6 THEN 0 WHEN is_range THEN 2 ELSE 1 END) AS BIGINT) AS n_numbers FROM raw GROUP BY 1, 2, 3")
def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _measured(spark, sf_dir).withColumn("nums", numbers.numbers("value_raw"))
    return r.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"), F.round(F.sum(F.try_element_at("nums", F.lit(1))), 3).alias("sum_first"), F.sum(F.size("nums").cast("long")).alias("n_numbers"))


@query(f"WITH {_RAW} SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, sum(CASE WHEN is_range THEN a END) AS lo, sum(CASE WHEN is_range THEN b END) AS hi FROM raw GROUP BY 1, 2, 3")
def range_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _measured(spark, sf_dir).withColumn("r", numbers.detect_range("value_raw"))
    return r.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"), F.sum("r.lo").alias("lo"), F.sum("r.hi").alias("hi"))


@query(f"""WITH {_RAW}, converted AS (SELECT *, CASE un WHEN 0 THEN 1000.0::DOUBLE ELSE 1 END AS m, CASE un WHEN 1 THEN -273.15::DOUBLE ELSE 0 END AS o FROM intervals)
SELECT un, op, CASE WHEN kind <> 6 THEN CASE un WHEN 0 THEN 'мг/л' WHEN 1 THEN '°C' WHEN 2 THEN 'мг/л' END END AS unit_canon, count(*) AS n, round(sum(lo * m + o), 2) AS sum_min, round(sum(hi * m + o), 2) AS sum_max,
count_if(kind = 6 OR un = 4 OR (op = 4 AND NOT is_range)) AS n_review FROM converted GROUP BY 1, 2, 3""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = units.parse_measurements(_measured(spark, sf_dir), units.seed_units(spark))
    keys = [(F.col("l_suppkey") % 5).alias("un"), (F.col("l_orderkey") % 6).alias("op"), F.col("interval.unit_canon").alias("unit_canon")]
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("interval.value_min"), 2).alias("sum_min"), F.round(F.sum("interval.value_max"), 2).alias("sum_max"), F.count_if("interval.needs_review").alias("n_review"))


@query("""SELECT 'фунт' AS unit, count(*) AS n, count(DISTINCT (l_partkey % 8, CASE WHEN l_partkey % 8 <> 6 THEN l_quantity END, CASE WHEN l_partkey % 8 = 0 THEN l_linenumber END)) AS n_examples, count(DISTINCT l_orderkey) AS n_documents FROM lineitem WHERE l_suppkey % 5 = 4""")
def unknown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unknown_units(_measured(spark, sf_dir), units.seed_units(spark))


@query("""WITH v AS (SELECT l_linenumber, l_quantity AS q FROM lineitem GROUP BY 1, 2)
SELECT l_linenumber, q, CASE l_linenumber WHEN 1 THEN '≤' || CAST(q AS BIGINT) || ' мг/л' WHEN 2 THEN '≥' || CAST(q AS BIGINT) || ' мг/л' WHEN 3 THEN '= ' || CAST(q AS BIGINT) || ' мг/л' WHEN 4 THEN '«text»' ELSE '= ' || CAST(q AS BIGINT) || '–' || CAST(q + 1 AS BIGINT) || ' мг/л' END AS shown FROM v""")
def value_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("l_linenumber"), F.col("q")
    lo, hi = F.when(~k.isin(1, 4), q), F.when(k == 3, q).when(k == 1, q).when(~k.isin(2, 4), q + 1)
    rows = st.table(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.col("l_quantity").alias("q")).count()
    return rows.select("l_linenumber", "q", numbers.render_value(lo, hi, F.lit("мг/л"), F.lit("text")).alias("shown"))


_WORDS = ("Электролиз", "щёлочь", "Ёлка и жук", "Printing Ñandú", "шлак № 5", "—")


def _spell(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _WORDS)), (k % len(_WORDS)).cast("int") + 1)


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'elektroliz-' || s_suppkey WHEN 1 THEN 'scheloch-' || s_suppkey WHEN 2 THEN 'elka-i-zhuk-' || s_suppkey WHEN 3 THEN 'printing-and-' || s_suppkey WHEN 4 THEN 'shlak-5-' || s_suppkey ELSE s_suppkey::VARCHAR END AS slug FROM supplier""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "supplier").select("s_suppkey", names.slug(F.concat(_spell(F.col("s_suppkey")), F.lit(" "), F.col("s_suppkey").cast("string"))).alias("slug"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Иванов' WHEN 1 THEN 'Трофимов' WHEN 2 THEN 'Smith' WHEN 3 THEN 'Без автора' ELSE 'Ласточкина' END || ' ' || CASE WHEN c_custkey % 4 = 0 THEN 'б.г.' ELSE CAST(1990 + c_custkey % 30 AS VARCHAR) END AS cite_key FROM customer""")
def surname_cite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    lists = [["И.И. Иванов"], ["К.Т.Н. ТРОФИМОВ А.В.", "Другой"], ["", "Smith, J."], [" "], ["М.А. Ласточкина"]]
    authors = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in lists]), (c % 5).cast("int") + 1)
    year = F.when(c % 4 != 0, 1990 + c % 30)
    return st.table(spark, sf_dir, "customer").select("c_custkey", names.cite_key(authors, year).alias("cite_key"))


@query("""WITH people AS (SELECT c_custkey, c_custkey % 40 AS k, c_custkey % 3 AS form, CAST(round(c_acctbal) AS BIGINT) AS degree FROM customer),
keyed AS (SELECT *, max(struct_pack(degree := degree, n := CASE form WHEN 0 THEN 10 WHEN 1 THEN 12 ELSE 10 END, k := -c_custkey)) OVER (PARTITION BY k) AS best, count(*) OVER (PARTITION BY k) AS n FROM people)
SELECT -best.k AS survivor_id, c_custkey AS victim_id FROM keyed WHERE n >= 2 AND c_custkey <> -best.k""")
def dedupe_experts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under forty surnames in three forms of writing; balances are degrees."""
    c = F.col("c_custkey")
    family = F.concat(F.lit("Pers"), F.translate(F.lpad((c % 40).cast("string"), 2, "0"), "0123456789", "abcdefghij"))
    name = F.when(c % 3 == 0, F.concat(family, F.lit(" J.K"), F.lit(""))).when(c % 3 == 1, F.concat(family, F.lit(", J. K"), F.lit(""))).otherwise(F.concat(F.lit("JK"), F.lit("")))
    name = F.when(c % 3 == 2, F.concat(F.lit("J.K "), family)).otherwise(name)
    people = st.table(spark, sf_dir, "customer").select(c.alias("expert_id"), name.alias("name"), F.round("c_acctbal").cast("long").alias("degree"))
    return resolution.dedupe_people(people)


@query("""SELECT c_custkey AS mention_id, CASE c_custkey % 4 WHEN 0 THEN 'sup:' || c_custkey % 100 WHEN 1 THEN 'sup:7' WHEN 2 THEN 'sup:8' ELSE 'ponds-' || c_custkey % 10 END AS entity_id, c_custkey % 4 = 3 AS unresolved FROM customer""")
def alias_resolve_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions under a name, a short form, a form in the other script, and a name that nobody has."""
    ids = spark.range(100)
    surfaces = F.when(F.col("id") == 7, F.array(F.lit("Supplier 7"), F.lit("РУДА"))).when(F.col("id") == 8, F.array(F.lit("Supplier 8"), F.lit("nikel"))).otherwise(F.array(F.concat(F.lit("Supplier "), F.col("id").cast("string"))))
    index = resolution.alias_index(ids.select(st.key("sup", "id").alias("entity_id"), F.lit("Material").alias("label"), F.col("id").alias("ord"), surfaces.alias("surfaces")))
    c = F.col("c_custkey")
    name = F.when(c % 4 == 0, F.concat(F.lit(" supplier   "), (c % 100).cast("string"))).when(c % 4 == 1, F.lit("руда")).when(c % 4 == 2, F.lit("никел")).otherwise(F.concat(F.lit("Ponds "), (c % 10).cast("string")))
    mentions = st.table(spark, sf_dir, "customer").select(c.alias("mention_id"), F.lit("Material").alias("label"), name.alias("name"))
    return resolution.resolve(mentions, index).select("mention_id", "entity_id", "unresolved")


@query("""SELECT c_custkey AS mention_id, CASE c_custkey % 4 WHEN 0 THEN 'sup:' || c_custkey % 100 WHEN 1 THEN 'sup:7' WHEN 2 THEN 'sup:8' END AS entity_id FROM customer""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias_resolve_stub(spark, sf_dir).select("mention_id", F.when(~F.col("unresolved"), F.col("entity_id")).alias("entity_id"))


@query(f"""WITH {st.EDGES}, moved AS (SELECT CASE WHEN src_key LIKE 'c:%' AND CAST(substr(src_key, 3) AS BIGINT) % 10 = 3 THEN 'c:' || (CAST(substr(src_key, 3) AS BIGINT) - 1) ELSE src_key END AS src_key, dst_key, rel_type FROM edges WHERE rel_type <> 'USES_MATERIAL')
SELECT src_key, dst_key, rel_type FROM moved GROUP BY ALL""")
def merge_nodes_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose number ends in 3 are merged into the one before."""
    edges = st.edges(spark, sf_dir).where("rel_type <> 'USES_MATERIAL'").select("src_key", "dst_key", "rel_type")
    merges = st.table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(st.key("c", "c_custkey").alias("victim_id"), st.key("c", F.col("c_custkey") - 1).alias("survivor_id"))
    return resolution.remap_edges(edges, merges)


@query("""SELECT c_nationkey AS group_id, arg_max(c_custkey, struct_pack(ref := c_acctbal > 9980, degree := CAST(round(c_acctbal) AS BIGINT), k := c_custkey)) AS survivor_id
FROM customer GROUP BY 1 HAVING count(*) >= 2 AND count_if(c_acctbal > 9980) < 2""")
def synonym_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = st.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("entity_id"), (F.col("c_acctbal") > 9980).alias("is_reference"), F.round("c_acctbal").cast("long").alias("degree"))
    return resolution.survivors(groups)
