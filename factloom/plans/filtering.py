"""Queries on strict filters, relaxation and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numbers import overlaps
from factloom.operators import access, filters
from factloom.plans import standins as st
from factloom.plans.registry import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.add

REQUEST = filters.Filters(geography="foreign", year_from=1996, year_to=2000, doc_types=("F", "O"), materials=("mat:Brand#1", "mat:Brand#2", "mat:Brand#3"), processes=tuple(f"proc:{k}" for k in range(1, 8)), conditions_text=("FLAG A",))
_TABLES = f"WITH {st.DOCS}, {st.MENTIONS}, {st.FACTS}, live AS (SELECT * FROM facts WHERE NOT needs_review AND NOT deleted)"
_AXES = {
    "geography": "coalesce(geography = 'foreign', false)",
    "years": "coalesce(year >= 1996 AND year <= 2000, false)",
    "conditions_text": "doc_id IN (SELECT doc_id FROM live WHERE lower(value_text) LIKE '%flag a%')",
    "processes": "doc_id IN (SELECT doc_id FROM mentions WHERE entity_id IN ('proc:1', 'proc:2', 'proc:3', 'proc:4', 'proc:5', 'proc:6', 'proc:7'))",
    "materials": "doc_id IN (SELECT doc_id FROM mentions WHERE entity_id IN ('mat:Brand#1', 'mat:Brand#2', 'mat:Brand#3'))",
    "doc_types": "doc_type IN ('F', 'O')",
}


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return st.documents(spark, sf_dir), st.mentions(spark, sf_dir), st.facts(spark, sf_dir)


@query(f"{_TABLES} SELECT doc_id FROM docs WHERE {' AND '.join(_AXES.values())}")
def strict_filter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.strict_filter(*_tables(spark, sf_dir), REQUEST)


@query(f"{_TABLES} SELECT count(*) AS n_documents FROM docs WHERE access_level = 'public' AND {' AND '.join(_AXES.values())}")
def strict_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.strict_filter(*_tables(spark, sf_dir), REQUEST, role="partner").agg(F.count("*").alias("n_documents"))


#: A request that no document satisfies: the year range is empty.
IMPOSSIBLE = filters.Filters(geography="RU", year_from=2000, year_to=1990, doc_types=("P",), materials=("mat:Brand#5",), processes=("proc:3",))
_IMPOSSIBLE = {"geography": "coalesce(geography = 'RU', false)", "years": "coalesce(year >= 2000 AND year <= 1990, false)", "processes": "doc_id IN (SELECT doc_id FROM mentions WHERE entity_id = 'proc:3')", "materials": "doc_id IN (SELECT doc_id FROM mentions WHERE entity_id = 'mat:Brand#5')", "doc_types": "doc_type = 'P'"}
_ORDER = list(_IMPOSSIBLE)


def _and(axes: list[str]) -> str:
    return " AND ".join(_IMPOSSIBLE[a] for a in axes) or "true"


@query(f"""{_TABLES}, c AS (SELECT count(*) AS n_all, {', '.join(f"count_if({_and(_ORDER[k:])}) AS with_{_ORDER[k]}" for k in range(len(_ORDER) - 1, -1, -1))} FROM docs)
SELECT *, CASE {' '.join(f"WHEN with_{a} = 0 THEN '{a}'" for a in reversed(_ORDER))} END AS zeroed_by FROM c""")
def strict_zeroed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.zeroed_by(filters.axis_flags(*_tables(spark, sf_dir), IMPOSSIBLE))


@query(f"""{_TABLES}, c AS (SELECT {', '.join(f"count_if({_and(_ORDER[k:])}) AS n_{k}" for k in range(len(_ORDER) + 1))} FROM docs),
steps AS ({' UNION ALL '.join(f"SELECT CAST({k} AS BIGINT) AS n_dropped, '{','.join(_ORDER[:k])}' AS dropped, n_{k} AS n_documents FROM c" for k in range(len(_ORDER) + 1))})
SELECT * FROM steps WHERE n_documents > 0 OR n_dropped = {len(_ORDER)} ORDER BY n_dropped LIMIT 1""")
def strict_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.relaxed(filters.axis_flags(*_tables(spark, sf_dir), IMPOSSIBLE))


_RANGES = filters.Filters(numeric=(filters.NumericCondition("par:7", 10.0, None), filters.NumericCondition("par:7", None, 45.0)))


@query(f"""{_TABLES} SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM live WHERE parameter = 'par:7' AND (value_max IS NULL OR value_max >= 10))
AND doc_id IN (SELECT doc_id FROM live WHERE parameter = 'par:7' AND (value_min IS NULL OR value_min <= 45))""")
def interval_overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.strict_filter(*_tables(spark, sf_dir), _RANGES)


@query(f"""WITH {st.FACTS}, bands AS (SELECT CAST(range AS BIGINT) AS band, range * 10.0::DOUBLE AS lo, range * 10.0::DOUBLE + 2 AS hi FROM range(6))
SELECT band, count(*) AS n_facts, count(DISTINCT doc_id) AS n_documents FROM facts JOIN bands ON (value_max IS NULL OR value_max >= lo) AND (value_min IS NULL OR value_min <= hi) GROUP BY band""")
def interval_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that overlap each of six bands: the bands are an array of literals, so no join is needed."""
    bands = F.array(*[F.struct(F.lit(k).cast("long").alias("band"), F.lit(k * 10.0).alias("lo"), F.lit(k * 10.0 + 2).alias("hi")) for k in range(6)])
    hit = F.filter(bands, lambda b: overlaps(F.col("value_min"), F.col("value_max"), b["lo"], b["hi"]))
    return st.facts(spark, sf_dir).select("doc_id", F.explode(hit).alias("b")).groupBy(F.col("b.band").alias("band")).agg(F.count("*").alias("n_facts"), F.countDistinct("doc_id").alias("n_documents"))


@query(f"WITH {st.DOCS} SELECT doc_id, year FROM docs WHERE access_level = 'public'")
def rbac_public_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.visible(st.documents(spark, sf_dir), filters.PARTNER).select("doc_id", "year")


@query("""WITH chunks AS (SELECT doc_id AS chunk_id, lang, CASE doc_id % 5 WHEN 0 THEN 'deprecated' WHEN 1 THEN NULL ELSE 'normal' END AS authority, CASE WHEN doc_id % 7 <> 0 THEN 2010 + doc_id % 12 END AS year, CASE WHEN text LIKE '%the%' THEN 1 ELSE 0 END AS has FROM documents)
SELECT chunk_id FROM chunks WHERE coalesce(authority, 'normal') <> 'deprecated' AND coalesce(year, 0) >= 2015 AND lang IN ('en', 'fr') AND has = 1""")
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    chunks = st.table(spark, sf_dir, "documents").select(d.alias("chunk_id"), "lang", F.when(d % 5 == 0, "deprecated").when(d % 5 == 1, F.lit(None)).otherwise("normal").alias("authority"), F.when(d % 7 != 0, 2010 + d % 12).alias("year"), F.when(F.col("text").contains("the"), F.array(F.lit("the"), F.lit("x"))).alias("entities"))
    return filters.chunk_filter(chunks, min_year=2015, langs=("en", "fr"), require_entities=("the",)).select("chunk_id")


@query("""WITH files AS (SELECT url AS path, CASE WHEN page_id % 3 = 0 THEN 'open' WHEN page_id % 3 = 1 THEN 'secret' END AS tag FROM pages)
SELECT role, path, CASE role WHEN 'admin' THEN true WHEN 'reader' THEN regexp_matches(path, '^http://.*$') AND NOT contains(path, '#') AND coalesce(tag = 'open', false)
 ELSE (NOT contains(path, '/en/')) AND NOT coalesce(tag = 'secret', false) END AS allowed FROM files CROSS JOIN (SELECT unnest(['admin', 'reader', 'guest']) AS role)""")
def tag_path_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = st.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 0, F.array(F.lit("open"))).when(F.col("page_id") % 3 == 1, F.array(F.lit("secret"))).alias("file_tags"))
    rules = spark.createDataFrame(
        [("admin", "whitelist", [], [], [], True), ("reader", "whitelist", ["http://**"], ["**#**"], ["open"], False), ("guest", "blacklist", ["**/en/**"], [], ["secret"], False)],
        "role string, kind string, paths array<string>, exclude_paths array<string>, tags array<string>, everything boolean",
    )
    return access.allowed(files, rules)


@query("""WITH last AS (SELECT user_id AS key, arg_max(value, struct_pack(ts, event_id)) AS value, max(ts) AS put_at FROM events GROUP BY user_id)
SELECT * FROM last WHERE put_at + INTERVAL 900 SECOND > TIMESTAMP '2024-01-30 20:00:00'""")
def ttl_live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as puts into a cache of quarter hours, looked at in the last evening."""
    entries = st.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "value", F.col("ts").alias("put_at"), F.col("event_id").alias("seq"))
    return access.live_entries(entries, F.lit("2024-01-30 20:00:00").cast("timestamp_ntz").cast(entries.schema["put_at"].dataType), 900)


@query("""WITH g AS (SELECT user_id AS path, ts, value, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g)
SELECT path, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_writes, arg_max(value, struct_pack(ts, event_id)) AS value FROM b GROUP BY path, burst""")
def write_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = st.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").alias("at"), "value", F.col("event_id").alias("seq"))
    return access.coalesced_writes(writes, 3600)


@query("""SELECT conv_id AS session_id, arg_min(left(text, 60), turn) AS title, count(*) AS n_messages, CAST(max(turn) AS BIGINT) AS updated_at FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, session_id""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.sessions(st.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text", F.col("turn").cast("long").alias("at")))


@query("SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS text_md5 FROM conversations GROUP BY conv_id")
def doc_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = st.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")
    return access.reassemble(chunks).select("doc_id", F.md5("text").alias("text_md5"))
