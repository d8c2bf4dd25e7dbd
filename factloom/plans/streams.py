"""Queries that run as streams over all that a table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans import standins as st
from factloom.plans.registry import Catalogue
from factloom.plans.texts import NORMAL_SQL
from factloom.shipping import fresh_folder
from factloom.streaming import answers, jobs

CATALOGUE = Catalogue()
query = CATALOGUE.add


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. Written as a pattern, its path may be a single file too."""
    return spark.readStream.schema(st.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(f"SELECT DISTINCT sha256({NORMAL_SQL}) AS content_hash FROM documents")
def stream_ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents that a stream of documents writes: each once. A batch that is run again writes the same folder again."""
    out = fresh_folder(spark, "ingested")
    write = lambda batch, number: batch.select("doc_id", "content_hash").write.mode("overwrite").parquet(f"{out}/batch={number}")
    jobs.ingest(_stream(spark, sf_dir, "documents").select("doc_id", "text"), write, fresh_folder(spark, "ingest")).awaitTermination()
    return spark.read.schema("doc_id long, content_hash string").parquet(out).select("content_hash")


@query("""WITH l AS (SELECT event_id, ts, lag(value) OVER w AS before, lag(ts) OVER w AS put_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN put_at + INTERVAL 900 SECOND > ts THEN before END AS replaced FROM l""")
def stream_ttl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as puts into a cache of quarter hours, and the value that each one replaced."""
    out = fresh_folder(spark, "cache")
    puts = _stream(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("at"))
    kept = jobs.ttl_cache(puts, 900, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_folder(spark, "cache-state"))
    kept.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq long, key string, value string, replaced string").parquet(out).select(F.col("seq").alias("event_id"), F.col("replaced").cast("double").alias("replaced"))


def _deltas(docs: DataFrame) -> DataFrame:
    """The deltas of documents as answers, as answers.buffered takes them. A text is cut in one pass and stays behind: deltas carry no more than themselves."""
    cut = docs.select(F.col("doc_id").cast("string").alias("answer_id"), F.regexp_extract_all("text", F.lit("(?s).{1,25}"), F.lit(0)).alias("parts"), F.ceil(F.length("text") / 25).cast("int").alias("n"))
    deltas = cut.select("answer_id", "n", F.posexplode("parts").alias("k", "delta"))
    return deltas.select("answer_id", (F.col("k") + 1).cast("long").alias("seq"), "delta", (F.col("k") + 1 == F.col("n")).alias("done"), F.timestamp_seconds(F.col("k") + 1).alias("at"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS answer_id, sha256(text) AS text_sha256, true AS all_long_enough FROM documents WHERE text <> ''""")
def stream_answer_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer that comes in deltas of 25 characters, gathered into pieces of 40 and more: joined they are its text."""
    out = fresh_folder(spark, "answers")
    gathered = answers.buffered(_deltas(_stream(spark, sf_dir, "documents").where("text <> ''")), "1 hour", 600).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_folder(spark, "answers-state"))
    gathered.trigger(availableNow=True).start().awaitTermination()
    held = spark.read.schema("answer_id string, piece long, text string").parquet(out)
    pieces = held.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"))
    long_enough = F.forall(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: (F.length(x["text"]) >= answers.FLUSH_CHARS) | x["text"].contains("\n"))
    return pieces.select("answer_id", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), ""), 256).alias("text_sha256"), long_enough.alias("all_long_enough"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, true AS all_long_enough FROM documents""")
def answer_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in pieces that end with their words: joined they are the text, and all but the last have 60 characters."""
    pieces = st.table(spark, sf_dir, "documents").select("doc_id", answers.word_pieces(F.coalesce("text", F.lit(""))).alias("p"))
    long_enough = F.forall(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.length(x) >= answers.PIECE_CHARS)
    return pieces.select("doc_id", F.sha2(F.array_join("p", ""), 256).alias("text_sha256"), long_enough.alias("all_long_enough"))


#: What a user may do after what; sessions begin with any of the first two.
_STEPS = {answers.START: ("signup", "view"), "signup": ("view", "click"), "view": ("view", "click", "purchase"), "click": ("view", "click", "purchase", "error"), "purchase": ("view", "signup")}
_STEPS_SQL = ", ".join(f"('{a}', '{b}')" for a, following in _STEPS.items() for b in following)
_ORDER_SQL = f"""WITH e AS (SELECT user_id AS key, event_id AS seq, event_type AS kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT CAST(key AS VARCHAR) AS key, seq, before, kind FROM e WHERE (coalesce(before, ''), kind) NOT IN (VALUES {_STEPS_SQL}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1"""


def _kinds(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))


@query(_ORDER_SQL)
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user that may not follow the one before it."""
    return answers.first_offences(_kinds(st.table(spark, sf_dir, "events")), _STEPS)


@query(_ORDER_SQL)
def stream_event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream."""
    out = fresh_folder(spark, "order")
    found = answers.offences(_kinds(_stream(spark, sf_dir, "events")), _STEPS).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_folder(spark, "order-state"))
    found.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, seq long, before string, kind string").parquet(out)
