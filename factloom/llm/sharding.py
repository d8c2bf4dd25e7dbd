"""Operator 12: sharding by proportional stratified interleaving, in DataFrame functions only.

The rows of each source are shuffled by a seeded digest and ranked from 0. The
row of rank r, of n in its source, gets the fraction (r + u) / n, where u is a
number from 0 to 1 drawn once for each source, so that the rows of many tiny
sources spread like those of one large one. In the order of fractions every run
of rows holds each source in its share of the whole, to within one row; it is
cut into shards of equal counts (the law `rows`), so every shard matches the
mixture. A row's slot is its place within its shard.

Places are counted without sorting everything in one task. Within a source,
the digest's first bits cut the shuffle into ranges; a range's offset is the
number of rows in those before it. Fractions are spread evenly by construction,
so ranges of them hold equally many rows whatever the sources' sizes are. No
text is shuffled: the rows that are ranked hold id, source, size and checksum.

Equal texts are not kept together: that would not let counts be at most one
apart. Which shard a row gets depends on all rows, so a larger number of shards
moves rows between old ones: grown_shard is null.

Defined results: a null text is as long as an empty one, size 1; a null source
is a source of its own; a null id is written as "null" in the digest; rows of
equal id, source, size and checksum are told apart by numbers, so they spread
over shards and each gets a slot; an empty table gives an empty result; fewer
rows than shards leave the last shards empty; texts may have any length; columns
besides id, source and text are only passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import broadcast_if_small, checkpoint, column_name, each_copy

SHARDS, SEED = 8, "shard-1"
#: Ranges of the shuffle of each source: the first three hexadecimal digits of a row's digest.
RANGE_DIGITS = 3
#: Rows that a range of fractions holds on average.
RANGE_ROWS = 50_000

_KEY = ("doc_id", "source", "size", "text_crc32")


def _fraction(digest: Column) -> Column:
    """A number from 0 to below 1 out of the first 13 hexadecimal digits."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def _named(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def _key(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """doc_id, source, size and text_crc32: rows that share them all are as good as each other."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    return [x.alias(c) for c, x in zip(_KEY, (F.col(id_col), F.col(source_col).cast("string"), size, crc), strict=True)]


def interleave(rows: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """rows (doc_id, source, size, text_crc32) with shard and slot, and copy: a number among equal rows."""
    units = checkpoint(rows.groupBy(*_KEY).agg(F.count("*").alias("n")))
    digest = F.md5(F.concat_ws(":", F.lit(seed), _named(F.col("doc_id")), _named(F.col("source")), F.col("size"), F.col("text_crc32"), F.col("copy")))
    keyed = each_copy(units, "n", "copy").withColumn("digest", digest).withColumn("range", F.substring("digest", 1, RANGE_DIGITS))
    keyed = keyed.withColumn("source_key", _named(F.col("source")))
    per_range = checkpoint(keyed.groupBy("source_key", "range").agg(F.count("*").alias("range_rows")))
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_key")
    offsets = per_range.select("source_key", "range", F.coalesce(F.sum("range_rows").over(earlier), F.lit(0)).alias("offset"), F.sum("range_rows").over(whole).alias("of_source"))
    within = Window.partitionBy("source_key", "range").orderBy("digest", *_KEY, "copy")
    ranked = keyed.withColumn("nth", F.row_number().over(within) - 1).join(broadcast_if_small(checkpoint(offsets)), ["source_key", "range"])
    start = _fraction(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source_key"))))
    fractions = checkpoint(ranked.select(*_KEY, "copy", "digest", ((F.col("offset") + F.col("nth") + start) / F.col("of_source")).alias("fraction")))
    total = units.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, total // RANGE_ROWS)
    placed = fractions.withColumn("range", F.floor(F.col("fraction") * ranges))
    # One row for each RANGE_ROWS rows of the table: the running sum over them is that of a table of counts.
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("range").orderBy("fraction", "digest", *_KEY, "copy")
    numbered = placed.withColumn("nth", F.row_number().over(order) - 1).join(broadcast_if_small(checkpoint(counts)), "range")
    # Shard k takes the places p with p * shards div total = k, so counts differ by one at most.
    rows_in_all = max(total, 1)
    cut = numbered.withColumn("place", F.col("offset") + F.col("nth")).withColumn("shard", F.expr(f"cast(place * {shards}L div {rows_in_all}L as int)"))
    return cut.select(*_KEY, "copy", "shard", F.expr(f"place - (shard * {rows_in_all}L + {shards - 1}L) div {shards}L").alias("slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source of each row."""
    dealt = interleave(docs.select(*_key(id_col, source_col, text_col)), shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS, seed: str = SEED) -> None:
    """Writes the rows of docs, with their columns and slot, as Parquet at path in a folder for each shard, sorted by slot within each file.

    Texts are shuffled once, by shard and ranges of slots, so a shard is written by many tasks.
    """
    dealt = checkpoint(interleave(docs.select(*_key(id_col, source_col, text_col)), shards, seed))
    shard, slot, part = (column_name(docs, c) for c in ("shard", "slot", "factloom_part"))
    named = docs.select(F.struct("*").alias("doc"), F.struct(*_key(id_col, source_col, text_col)).alias("key"))
    if dealt.where("copy > 0").isEmpty():
        named = named.withColumn("copy", F.lit(0).cast("long"))
    else:
        # Equal rows are numbered by where they lie: first within a task's input, then over tasks.
        named = checkpoint(named.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
        ahead = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        offsets = named.groupBy("key", "task").agg(F.count("*").alias("n")).select("key", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
        nth = F.row_number().over(Window.partitionBy("key", "task").orderBy("at")) - 1
        named = named.withColumn("nth", nth).join(offsets, ["key", "task"]).select("doc", "key", (F.col("offset") + F.col("nth")).alias("copy"))
    places = dealt.select(F.struct(*_KEY).alias("key"), "copy", F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = named.join(places, ["key", "copy"]).select("doc.*", shard, slot)
    ranged = joined.withColumn(part, F.floor(F.col(slot) / RANGE_ROWS)).repartition(shard, part)
    ranged.sortWithinPartitions(shard, slot).drop(part).write.partitionBy(shard).parquet(path)


SQL = r"""
WITH byte_step AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS step
  FROM (SELECT unnest(range(256)) AS b)),
narrow AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                         lambda c, b: xor(c // 256, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, byte_step),
named AS (
  SELECT *, coalesce('=' || CAST(doc_id AS VARCHAR), 'null') AS id_name, coalesce('=' || source, 'null') AS source_key,
         row_number() OVER (PARTITION BY doc_id, source, size, text_crc32) - 1 AS copy
  FROM narrow),
keyed AS (SELECT *, md5('shard-1:' || id_name || ':' || source_key || ':' || size || ':' || text_crc32 || ':' || copy) AS digest FROM named),
fractions AS (
  SELECT *, (row_number() OVER (PARTITION BY source_key ORDER BY digest) - 1 + CAST(CAST('0x' || left(md5('shard-1:' || source_key), 13) AS BIGINT) AS DOUBLE) / 4503599627370496)
            / count(*) OVER (PARTITION BY source_key) AS fraction
  FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, digest) - 1 AS place, count(*) OVER () AS n FROM fractions)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 8 // n AS INTEGER) AS shard, place - (place * 8 // n * n + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
"""
