"""Operator 3: mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source's target is the common level times its weight, but at most `epochs`
times its size; the level is where the targets add up to the whole. With the
sources in the order in which a rising level clamps them, the level follows
from running sums: the sources before it are clamped, and what they leave is
shared by the weights of the rest. That is the fixed point of clamping and
sharing the excess again and again.

A source of size s and target t repeats each document floor(t / s) times. The
rest, t - s * floor(t / s) words, comes from one more repetition of some
documents: in the order of a seeded digest of their ids, those before the first
that does not fit, then FILLS times the largest of the others that still fits
what is missing, and last the one whose size brings the sum nearer still. The
order is cut into 4096 ranges of the digest, so that running sums within a
source, however large, run over many tasks; a filling document is found by one
aggregate over the others.

Defined results: a null text has size 0; an empty document is repeated like the
others of its source, at most `epochs` times; a null source is a source of its own,
after all others; a source of size 0 has target 0; rows that share an id are
taken together, as often as each other; an empty table gives an empty result;
columns besides id, source and text are only passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WORD, broadcast_if_small, checkpoint, column_name

WEIGHTS, EPOCHS, SEED = (1, 2, 3), 3, "mix-1"
#: Documents that fill up what the first ones of a source in digest order leave open.
FILLS = 6


def _key(id_col: str, seed: str) -> Column:
    known = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), known)), F.lit(":"), known)


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def levels(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds target to a table of one row per source: source_key, source, source_size. One row per source goes through one task."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.select(
        "source_key", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1).cast("long").alias("weight"),
        (F.col("source_size") * epochs).alias("most"),
    )
    before = everything.orderBy(F.col("most") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    sums = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double").alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double").alias("sharing"),
    )
    level = F.min(F.when(F.col("left") * F.col("weight") <= F.col("most") * F.col("sharing"), F.struct(F.col("most") / F.col("weight"), "source_key", (F.col("left") / F.col("sharing")).alias("level")))).over(everything)["level"]
    return sums.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(level * F.col("weight"), F.col("most").cast("double")))).select("source_key", "source_size", "target")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of docs (doc_id, source_key, key, size) and what is taken of each source.

    The second table has one row per source: source_key, source_size, target, whole, last_key and more_keys, of FILLS + 1 documents at most.
    """
    rows = checkpoint(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _source_key(source_col).alias("source_key"),
        _key(id_col, seed).alias("key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    sources = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    shares = checkpoint(
        levels(sources, weights, epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    small = broadcast_if_small(shares.select("source_key", "need"))
    units = rows.groupBy("source_key", "key").agg(F.sum("size").alias("size")).withColumn("range", F.substring("key", 1, 3))
    per_range = units.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("source_key", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("source_key", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    running = units.withColumn("within", F.sum("size").over(upto)).join(offsets, ["source_key", "range"])
    reached = checkpoint(running.select("source_key", "key", "size", (F.col("offset") + F.col("within")).alias("reached")).join(small, "source_key"))
    fits = (F.col("reached") <= F.col("need")) & (F.col("need") > 0)
    filled = reached.groupBy("source_key").agg(F.max(F.when(fits, F.col("key"))).alias("last_key"), (F.first("need") - F.coalesce(F.max(F.when(fits, F.col("reached"))), F.lit(0))).alias("missing"))
    filled = checkpoint(filled.withColumn("more_keys", F.array().cast("array<string>")))
    others = reached.where(~fits).where("size > 0").select("source_key", "key", "size")
    for fill in range(FILLS + 1):
        open_ = others.join(broadcast_if_small(filled), "source_key").where(~F.array_contains("more_keys", F.col("key")))
        # The largest that fits; at last the nearest, if it is nearer than none.
        fitting = F.col("size") <= F.col("missing") if fill < FILLS else F.col("size") < 2 * F.col("missing")
        distance = F.abs(F.col("missing") - F.col("size"))
        picked = open_.where(fitting).groupBy("source_key").agg(F.min(F.struct(distance.alias("d"), "key", "size")).alias("p"))
        more = F.when(F.col("p").isNull(), F.col("more_keys")).otherwise(F.array_append("more_keys", F.col("p.key")))
        filled = checkpoint(filled.join(picked, "source_key", "left").select("source_key", "last_key", (F.col("missing") - F.coalesce("p.size", F.lit(0))).alias("missing"), more.alias("more_keys")))
    plan = shares.join(filled, "source_key", "left").select("source_key", "source_size", "target", "whole", "last_key", "more_keys")
    return rows, checkpoint(plan)


def _copies() -> Column:
    more = F.coalesce(F.col("key") <= F.col("last_key"), F.lit(False)) | F.coalesce(F.array_contains("more_keys", F.col("key")), F.lit(False))
    return (F.col("whole") + more.cast("long")).alias("copies")


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each row."""
    rows, plan = plan_mix(docs, **options)
    taken = rows.join(broadcast_if_small(plan), "source_key").select("doc_id", "size", "source_size", "target", _copies())
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix takes it. Texts are not shuffled where the sources are few."""
    plan = broadcast_if_small(plan_mix(docs, id_col=id_col, source_col=source_col, seed=seed, **options)[1])
    taken, copy = column_name(docs, "factloom_taken"), column_name(docs, "factloom_copy")
    marked = docs.select(F.struct("*").alias(taken), _source_key(source_col).alias("source_key"), _key(id_col, seed).alias("key"))
    repeated = marked.join(plan, "source_key").select(taken, _copies()).where("copies > 0")
    return repeated.select(taken, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(copy)).select(f"{taken}.*")


_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS source_key,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (SELECT source_key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source_key),
weighed AS (
  SELECT source_key, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS most FROM sources),
sums AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS DOUBLE) AS remaining,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS sharing
  FROM weighed
  WINDOW b AS (ORDER BY CAST(most AS DOUBLE) / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT remaining / sharing AS level FROM sums WHERE remaining * weight <= most * sharing ORDER BY CAST(most AS DOUBLE) / weight, source_key LIMIT 1),
shares AS (
  SELECT source_key, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM (SELECT source_key, source_size, least(CAST(most AS DOUBLE), (SELECT level FROM lvl) * weight) AS target FROM sums)),
units AS (SELECT source_key, key, CAST(sum(size) AS BIGINT) AS size FROM rows GROUP BY source_key, key),
reached AS (
  SELECT u.source_key, u.key, u.size, s.target - s.whole * s.source_size AS need,
         sum(u.size) OVER (PARTITION BY u.source_key ORDER BY u.key ROWS UNBOUNDED PRECEDING) AS reached
  FROM units u JOIN shares s USING (source_key)),
filled_0 AS (
  SELECT source_key, max(key) FILTER (WHERE reached <= need AND need > 0) AS last_key,
         any_value(need) - coalesce(max(reached) FILTER (WHERE reached <= need AND need > 0), 0) AS missing, CAST([] AS VARCHAR[]) AS more_keys
  FROM reached GROUP BY source_key),
others AS (SELECT source_key, key, size FROM reached WHERE NOT (reached <= need AND need > 0) AND size > 0),
{fills}
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, s.source_size, s.target,
       CAST(r.size * (s.whole + CAST(coalesce(r.key <= f.last_key, false) OR coalesce(list_contains(f.more_keys, r.key), false) AS BIGINT)) AS BIGINT) AS taken,
       CAST(s.whole + CAST(coalesce(r.key <= f.last_key, false) OR coalesce(list_contains(f.more_keys, r.key), false) AS BIGINT) AS BIGINT) AS copies
FROM rows r JOIN shares s USING (source_key) LEFT JOIN filled_{last} f USING (source_key)
"""
_FILL = """picked_{n} AS (
  SELECT o.source_key, o.key, o.size FROM others o JOIN filled_{before} f USING (source_key) WHERE {fits} AND NOT list_contains(more_keys, o.key)
  QUALIFY row_number() OVER (PARTITION BY o.source_key ORDER BY abs(f.missing - o.size), o.key) = 1),
filled_{n} AS (
  SELECT f.source_key, last_key, missing - coalesce(p.size, 0) AS missing, CASE WHEN p.key IS NULL THEN more_keys ELSE list_append(more_keys, p.key) END AS more_keys
  FROM filled_{before} f LEFT JOIN picked_{n} p USING (source_key))"""
_FITS = ["o.size <= f.missing"] * FILLS + ["o.size < 2 * f.missing"]
SQL = _SQL.replace("{fills}", ",\n".join(_FILL.format(n=k + 1, before=k, fits=x) for k, x in enumerate(_FITS))).replace("{last}", str(FILLS + 1))
