"""Queries on what comes in: names in texts, broken payloads, YAML files and base forms of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import importing, lemmas, names, resolution, units
from factloom.plans import standins as st
from factloom.plans.registry import Catalogue
from factloom.plans.texts import NORMAL_SQL
from factloom.shipping import checkpoint, fresh_folder
from factloom.sources import files, yaml_tables

CATALOGUE = Catalogue()
query = CATALOGUE.add


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of four letters and more of the benchmark's texts, and every two and three words in a row, as names."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda k: F.array_join(F.slice("w", k, n), " "))

    listed = st.table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(F.concat(*map(runs_of, (1, 2, 3)))).alias("name"))
    named = listed.where(F.length("name") >= 4).select(F.lower("name").alias("name")).distinct()
    return named.select(F.md5("name").alias("entity_id"), F.lit("term").alias("type"), "name")


@query(r"""WITH b AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark),
listed AS (SELECT unnest(w) AS name FROM b UNION ALL SELECT unnest(list_transform(range(1, greatest(len(w), 2)), lambda k: array_to_string(w[k:k + 1], ' '))) FROM b UNION ALL SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda k: array_to_string(w[k:k + 2], ' '))) FROM b),
named AS (SELECT DISTINCT lower(name) AS name FROM listed WHERE length(name) >= 4),
pieces AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS p FROM documents),
places AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM pieces),
runs AS (SELECT doc_id, array_to_string(p[k:k + n - 1], '') AS run FROM places, (SELECT unnest([1, 3, 5]) AS n) WHERE k + n - 1 <= len(p) AND p[k] <> ' ' AND (n < 3 OR p[k + 1] = ' ') AND (n < 5 OR p[k + 3] = ' '))
SELECT name, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM runs JOIN named ON lower(run) = name WHERE NOT regexp_matches(name, '[0-9]') OR run = name GROUP BY name""")
def name_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name of a large dictionary stands in the documents, overlapping ones too, by joins."""
    docs = st.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = names.occurrences(docs, _dictionary(spark, sf_dir), ["doc_id"])
    return found.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


@query()
def entities_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that every document holds, the longest first and without overlaps, by one automaton for the whole dictionary."""
    found = names.find_names(st.table(spark, sf_dir, "documents"), _dictionary(spark, sf_dir), "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities"), F.sum(F.col("end_at") - F.col("start_at")).alias("n_chars"), F.min("start_at").alias("first_at"))


def _relation(k: int) -> Column:
    quote = F.regexp_replace(F.substring("text", 1 + 30 * k, 30), r"[^\p{L} ]", " ")
    return F.concat(F.lit('{"type":"USES_MATERIAL","from":"d'), F.col("doc_id").cast("string"), F.lit(f'","to":"m{k}","quote":"'), quote, F.lit('"}'))


_SQL_RELATION = """'{{"type":"USES_MATERIAL","from":"d' || doc_id || '","to":"m{k}","quote":"' || regexp_replace(substr(text, {a}, 30), '[^\\p{{L}} ]', ' ', 'g') || '"}}'"""


@query("WITH r AS (SELECT doc_id, [" + ", ".join(_SQL_RELATION.format(k=k, a=1 + 30 * k) for k in range(6)) + r"""] AS rel FROM documents),
p AS (SELECT doc_id, rel, 'Here it is: {"entities":[],"relations":[' AS head, length(array_to_string(rel, ',')) AS n FROM r),
c AS (SELECT *, doc_id * 7919 % (length(head) + n + 3) AS cut FROM p),
e AS (SELECT doc_id, cut, k, length(head) + length(array_to_string(rel[1:k], ',')) AS ends FROM c, (SELECT unnest(range(1, 7)) AS k))
SELECT doc_id, 'm' || (k - 1) AS "to" FROM e WHERE ends <= cut""")
def payload_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's relations as JSON behind some words, cut at a place of its own: every relation that is whole before the cut is kept."""
    docs = st.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    payload = F.concat(F.lit('Here it is: {"entities":[],"relations":['), F.array_join(F.array(*[_relation(k) for k in range(6)]), ","), F.lit("]}"))
    cut = docs.select("doc_id", payload.alias("payload")).select("doc_id", F.substr("payload", F.lit(1), (F.col("doc_id") * 7919 % (F.length("payload") + 1)).cast("int")).alias("payload"))
    return files.read_extractions(cut, {"USES_MATERIAL": "USES_MATERIAL"}, tolerant=True)[0].select("doc_id", "to")


#: Part keys whose units share files, one for each type, so that a file has a bounded length.
_KEYS_A_FILE = 20_000


def _write_yaml(lines: DataFrame, spark: SparkSession, name: str) -> str:
    """Rows of file, ord and line as files, each `file` one of its own."""
    path = fresh_folder(spark, name)
    texts = lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("value"))
    texts.repartition("file").select("value").write.options(lineSep="\n", maxRecordsPerFile=1).text(path)
    return path


@query("""WITH parts AS (SELECT p_partkey AS k, p_type AS category, p_size AS size FROM part), measured AS (SELECT l_linenumber, l_partkey, l_quantity AS q FROM lineitem)
SELECT category, count(*) AS n, CAST(sum(CAST(q AS BIGINT) * size) AS DOUBLE) AS total FROM measured JOIN parts ON l_partkey = k GROUP BY category""")
def units_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a unit of a YAML file of its type and range of keys, so many of its type's own one, read back, and all quantities converted by it."""
    file = F.concat("p_type", F.lit("/"), F.floor(F.col("p_partkey") / _KEYS_A_FILE).cast("string"))
    part = st.table(spark, sf_dir, "part").withColumn("file", file)
    heads = part.select("p_type", "file").distinct().select("file", F.lit(0).alias("ord"), F.concat(F.lit("# units of one kind\ncategories:\n  "), "p_type", F.lit(":   # a category\n    canonical_unit: 'one "), "p_type", F.lit("'\n    abs_delta: null\nunits:")).alias("line"))
    entry = F.concat(F.lit('  "u'), F.col("p_partkey").cast("string"), F.lit(' #1": {category: '), "p_type", F.lit(", multiplier: "), F.col("p_size").cast("string"), F.lit(",\n      offset: 0.0}  # one of many"))
    written = heads.unionByName(part.select("file", (F.col("p_partkey") % _KEYS_A_FILE + 1).cast("int").alias("ord"), entry.alias("line")))
    table = yaml_tables.units_of(yaml_tables.read_yaml(spark, _write_yaml(written, spark, "units")))
    lines = st.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("u"), F.col("l_partkey").cast("string"), F.lit(" #1")).alias("unit_raw"), F.col("l_quantity").cast("long").cast("string").alias("value_raw"), F.lit(None).cast("string").alias("operator_raw"))
    converted = units.parse_measurements(lines, table)
    kind = F.regexp_replace("interval.unit_canon", "^one ", "").alias("category")
    return converted.groupBy(kind).agg(F.count("*").alias("n"), F.sum("interval.value_min").alias("total"))


@query("""SELECT 's' || s_suppkey AS entity_id, 'Process' AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'Name ' || s_suppkey ELSE 'слово ' || s_suppkey END AS name,
CASE WHEN s_suppkey % 2 = 0 THEN 'слово ' || s_suppkey || '|' ELSE '' END || 'word: ' || s_suppkey AS aliases FROM supplier""")
def glossary_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a term of a YAML glossary, merged into the entities that every second one is already."""
    supplier = st.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    number = F.col("k").cast("string")
    term = F.concat(F.lit("s"), number, F.lit(":\n  label: Process\n  ru: [слово "), number, F.lit("]   # a list\n  en:\n  - 'word: "), number, F.lit("'\n"))
    written = supplier.select((F.col("k") % 4).alias("file"), F.col("k").alias("ord"), term.alias("line"))
    terms = yaml_tables.glossary_of(yaml_tables.read_yaml(spark, _write_yaml(written, spark, "glossary")))
    entities = supplier.where("k % 2 = 0").select(F.concat(F.lit("s"), "k").alias("entity_id"), F.lit("Process").alias("label"), F.col("k").alias("ord"), F.concat(F.lit("Name "), "k").alias("name"), F.array().cast("array<string>").alias("aliases"))
    merged = resolution.glossary_merge(entities, terms)
    other = F.filter("aliases", lambda x: x != F.col("name"))
    return merged.select("entity_id", "label", "name", F.array_join(other, "|").alias("aliases"))


#: Endings that stand for the inflections of a word of the documents, by its last letter; each tells what the word ended in.
_ENDED = (("e", "ami"), ("n", "nov"), ("t", "tiy"), ("r", "rogo"), ("s", "shim"), ("d", "duyu"))
_INFLECTED = "CASE right(w, 1) " + " ".join(f"WHEN '{a}' THEN left(w, length(w) - 1) || '{b}'" for a, b in _ENDED) + " ELSE w || 'ovu' END"


@query(r"""SELECT DISTINCT w AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents)""")
def lemma_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, inflected and brought back by rules that were learned from one in five of them."""
    words = st.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    # The texts are read once; what is learned and looked up reads the distinct words many times.
    every = checkpoint(words.distinct())
    pairs = every.select(F.expr(_INFLECTED).alias("word"), F.col("w").alias("lemma"))
    rules = lemmas.learn(pairs.where("crc32(lemma) % 5 = 0"))
    return lemmas.lemmas(pairs, rules).select("lemma")


#: Folders that a corpus of one file for each document is dealt into.
_FOLDERS = 128


def _as_files(docs: DataFrame, spark: SparkSession) -> str:
    """A text file for each document (doc_id, text), in a few folders that are listed side by side.

    On a disk that all share (file:) tasks write them by themselves, as there Spark's writer starts a process for each file
    to set its mode. Few bytes are many files, so documents are dealt out by number, there only where the table is in few parts.
    """
    root = fresh_folder(spark, "corpus")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    if folder := files.local_path(root):
        few = rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
        files.write_texts(rows.repartition(_FOLDERS, "doc_id") if few else rows, folder)
        return root
    dealt = rows.select("value", F.pmod(F.xxhash64("doc_id"), F.lit(_FOLDERS)).alias("folder"))
    dealt.repartition(_FOLDERS, "folder").write.partitionBy("folder").options(maxRecordsPerFile=1).text(root)
    return root


_TERMS = r"(SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM benchmark) WHERE length(w) >= 9)"


@query(rf"""WITH d AS (SELECT doc_id, {NORMAL_SQL} AS t FROM documents), parsed AS (SELECT * FROM d WHERE length(t) >= 100),
contents AS (SELECT sha256(t) AS h, any_value(t) AS t FROM parsed GROUP BY 1), w AS (SELECT DISTINCT h, lower(unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'))) AS name FROM contents)
SELECT 'files' AS measure, count(*) AS n FROM d UNION ALL SELECT 'parsed', count(*) FROM parsed UNION ALL SELECT 'contents', count(*) FROM contents UNION ALL SELECT 'written', count(*) FROM contents
UNION ALL SELECT 'stored mentions', count(*) FROM w JOIN {_TERMS} USING (name)""")
def import_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file, imported with the benchmark's long words as a dictionary."""
    words = st.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    dictionary = words.where(F.length("w") >= 9).select(F.lower("w").alias("name")).distinct().select(F.md5("name").alias("entity_id"), F.lit("term").alias("type"), "name")
    root = _as_files(st.table(spark, sf_dir, "documents"), spark)
    return importing.import_corpus(spark, root, dictionary).report.where("measure <> 'stored chunks'")
