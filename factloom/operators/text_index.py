"""A stored inverted index: postings in blocks with bounds, BM25's best chunks from it, segments added without a rebuild.

A segment's chunks are dealt into ranges of at most RANGE_DOCS chunks of like
length. A block holds the postings of one term in one range, so however common
a term is, no block is larger than a range, and blocks lie in buckets by their
term. With each block its largest tf and its least length are kept: together
they bound what the term can add to any chunk of the range, whatever the mean
length becomes when segments are added. The bounds of a query's terms add up to
a bound of each range. The ranges with the greatest bounds are scored first;
a range whose bound is below the k-th of those scores can't hold one of the k
best, and its postings are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import tokens
from factloom.operators.retrieval import EPSILON, K1, B, top_per_query
from factloom.shipping import checkpoint, ship

RANGE_DOCS, BUCKETS = 1024, 32
#: A task that counts terms holds about as many times RANGE_DOCS chunks, and of long chunks about so many bytes of text.
DEALT_RANGES, DEALT_BYTES = 4, 16_000_000
#: Bytes of terms that are counted at a time, and postings that are handed over at a time.
COUNTED_BYTES, POSTINGS_AT_ONCE = 256_000_000, 200_000
#: Rows of terms that are asked, and of ranges that are scored, up to which every task gets them.
SENT_ROWS = 100_000
#: Ranges of each query that are scored before any is skipped.
FIRST_RANGES = 4
#: Scores this near are told apart by nothing: sums vary in order.
SLACK = 1e-6


@dataclass(frozen=True)
class TextIndex:
    """What is known of an index without reading its postings; made by `open_index`."""

    path: str
    segments: tuple[int, ...]
    n_chunks: int
    mean_length: float
    mean_idf: float

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """Of finished segments only: what an addition left that didn't end is not read."""
        return spark.read.parquet(f"{self.path}/{name}").where(F.col("segment").isin(*self.segments))


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _idf(df: Column, n: int) -> Column:
    return F.log((F.lit(n) - df + 0.5) / (df + 0.5))


def create_index(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text") -> TextIndex:
    """Writes chunks as the first segment of a new index at path."""
    return _write_segment(chunks, path, 0, id_col, text_col)


def add_segment(index: TextIndex, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> TextIndex:
    """The index with chunks as a further segment. No posting that is there is read again or changed; an index opened before goes on without them."""
    return _write_segment(chunks, index.path, max(index.segments) + 1, id_col, text_col)


def _write_segment(chunks: DataFrame, path: str, segment: int, id_col: str, text_col: str) -> TextIndex:
    """A null text has no terms, but counts as a chunk. An id stands once.

    Texts are dealt once, and a task counts and writes the blocks of its own ranges: postings are not shuffled.
    """
    spark = chunks.sparkSession
    ship(spark)
    sought = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, n_bytes = sought.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    deals = max(8, n // RANGE_DOCS // DEALT_RANGES, (n_bytes or 0) // DEALT_BYTES)
    placed = sought.repartition(deals, "chunk_id").select("chunk_id", tokens("text").alias("terms"))
    kind = sought.schema["chunk_id"].dataType.simpleString()
    held = placed.mapInArrow(_blocks(RANGE_DOCS), f"range string, term string, postings array<struct<chunk_id: {kind}, tf: bigint, dl: bigint>>, most_tf long, least_dl long, n long, n_terms long")
    blocks = held.withColumn("segment", F.lit(segment)).withColumn("bucket", _bucket("term"))
    blocks.sortWithinPartitions("segment", "bucket", "term").write.partitionBy("segment", "bucket").mode("append").parquet(f"{path}/blocks")
    written = spark.read.parquet(f"{path}/blocks").where(F.col("segment") == segment)
    written.groupBy("term").agg(F.sum("n").alias("df")).withColumn("segment", F.lit(segment)).write.partitionBy("segment").mode("append").parquet(f"{path}/terms")
    length = written.agg(F.sum("n_terms")).first()[0] or 0
    # Last, as it makes the segment count.
    spark.range(1).select(F.lit(segment).alias("segment"), F.lit(n).cast("long").alias("n"), F.lit(length).cast("long").alias("total_length")).write.mode("append").parquet(f"{path}/stats")
    return open_index(spark, path)


def _blocks(range_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From chunk_id and terms of a task's chunks the blocks of its ranges, COUNTED_BYTES of terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            if held and sum(x.nbytes for x in held) + batch.nbytes > COUNTED_BYTES:
                yield from counted(held, range_docs, f"{task}-{part}")
                part, held = part + 1, []
            held.append(batch)
        if held:
            yield from counted(held, range_docs, f"{task}-{part}")

    return run


def counted(batches: list[pa.RecordBatch], range_docs: int, name: str) -> Iterator[pa.RecordBatch]:
    """The blocks of chunks (chunk_id, terms): their ranges are called after name, and hold at most range_docs chunks, none twice as long as another."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, terms = (table[c].combine_chunks() for c in ("chunk_id", "terms"))
    lengths = np.diff(terms.offsets.to_numpy()).astype(np.int64)
    if not lengths.sum():
        return
    # Places of chunks by their class of length, and of these every range_docs a range.
    order = np.argsort(np.frexp(lengths)[1], kind="stable")
    lengths_there, classes = lengths[order], np.frexp(lengths[order])[1]
    begins = np.flatnonzero(np.diff(classes, prepend=classes[0] - 1))
    nth = np.arange(len(classes)) - np.repeat(begins, np.diff(begins, append=len(classes)))
    ranges = np.cumsum((nth % range_docs == 0).astype(np.int64))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    coded = terms.flatten().dictionary_encode()
    # One number for a term in a chunk, so that postings lie by term, by range and by chunk.
    found, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(order) + np.repeat(place, lengths), return_counts=True)
    code, at = np.divmod(found, len(order))
    starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(ranges[at], prepend=-1) != 0))
    ends = np.append(starts[1:], len(found))
    names = pa.array([f"{name}-{k}" for k in range(int(ranges[-1]) + 1)])
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + POSTINGS_AT_ONCE, "right")))
        a, b, own = starts[first], ends[last - 1], starts[first:last]
        chunk, n_of, dl = at[a:b], tf[a:b].astype(np.int64), lengths_there[at[a:b]]
        each = pa.StructArray.from_arrays([ids.take(pa.array(order[chunk])), pa.array(n_of), pa.array(dl)], ["chunk_id", "tf", "dl"])
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(ranges[at[own]])), coded.dictionary.take(pa.array(code[own])), pa.ListArray.from_arrays(pa.array(np.append(own, b) - a, pa.int32()), each),
                pa.array(np.maximum.reduceat(n_of, own - a)), pa.array(np.minimum.reduceat(dl, own - a)), pa.array(ends[first:last] - own), pa.array(np.add.reduceat(n_of, own - a)),
            ],
            ["range", "term", "postings", "most_tf", "least_dl", "n", "n_terms"],
        )
        first = last


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """The numbers that all scores share: from one row of each segment and from the dictionary, not from postings."""
    found = spark.read.parquet(f"{path}/stats").collect()  # one row for each segment
    n, length = sum(r["n"] for r in found), sum(r["total_length"] for r in found)
    index = TextIndex(path, tuple(sorted(r["segment"] for r in found)), n, length / n if n else 0.0, 0.0)
    mean = _df(index, index.table(spark, "terms")).agg(F.avg(_idf(F.col("df"), n))).first()[0]
    return TextIndex(path, index.segments, n, index.mean_length, mean or 0.0)


def _df(index: TextIndex, terms: DataFrame) -> DataFrame:
    """term, df over all segments: a segment lists a term once."""
    return terms.select("term", "df") if len(index.segments) == 1 else terms.groupBy("term").agg(F.sum("df").alias("df"))


def _part(index: TextIndex, tf: Column, dl: Column) -> Column:
    """What a term of weight 1 adds."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(index.mean_length)))


def search(index: TextIndex, queries: DataFrame, k: int, digits: int = 6, first_ranges: int = FIRST_RANGES) -> DataFrame:
    """query_id, chunk_id, score, rank: of each query (query_id, text) the k best chunks by BM25; ties of rounded scores by chunk_id."""
    spark = queries.sparkSession
    asked = checkpoint(queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("asked")))
    # What is asked goes to the blocks, so that of all others nothing is shuffled.
    few = asked.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    sent = F.broadcast if few else lambda x: x
    df = _df(index, index.table(spark, "terms").join(sent(asked.select("term").distinct()), "term", "left_semi"))
    idf = _idf(F.col("df"), index.n_chunks)
    weight = F.col("asked") * F.when(idf < 0, F.lit(EPSILON * index.mean_idf)).otherwise(idf)
    weighed = checkpoint(df.join(sent(asked), "term").select("query_id", "term", weight.alias("weight"), _bucket("term").alias("bucket")))
    wanted = [r["bucket"] for r in weighed.select("bucket").distinct().collect()]  # BUCKETS at most
    blocks = index.table(spark, "blocks").where(F.col("bucket").isin(*wanted))
    place = ["query_id", "segment", "range"]
    # Of the blocks only the bounds are read here.
    most = F.col("weight") * _part(index, F.col("most_tf"), F.col("least_dl"))
    bounds = checkpoint(blocks.select("bucket", "term", "segment", "range", "most_tf", "least_dl").join(sent(weighed), ["bucket", "term"]).groupBy(*place).agg(F.sum(most).alias("bound")))

    def scores(ranges: DataFrame) -> DataFrame:
        held = blocks.select("bucket", "term", "segment", "range", "postings")
        if few:
            to = F.broadcast(ranges) if ranges.limit(SENT_ROWS + 1).count() <= SENT_ROWS else ranges
            ofs = held.join(sent(weighed), ["bucket", "term"]).join(to, place, "left_semi")
        else:
            ofs = held.join(weighed.join(ranges.select(*place), "query_id"), ["bucket", "term", "segment", "range"])
        each = ofs.select("query_id", "weight", F.explode("postings").alias("p"))
        return each.groupBy("query_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.sum(F.col("weight") * _part(index, F.col("p.tf"), F.col("p.dl"))).alias("score"))

    best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range")
    first = checkpoint(bounds.withColumn("nth", F.row_number().over(best_first)).where(F.col("nth") <= first_ranges))
    scored = checkpoint(scores(first))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = scored.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k).select("query_id", F.col("score").alias("kth"))
    # Negative weights would make bounds of ranges no bounds, so then nothing is skipped.
    least = F.col("kth") - SLACK if index.mean_idf >= 0 else F.lit(None).cast("double")
    rest = checkpoint(bounds.join(first.select(*place), place, "left_anti").join(kth, "query_id", "left").where(F.coalesce(F.col("bound") >= least, F.lit(True))))
    found = scored if rest.isEmpty() else scored.unionByName(scores(rest))
    return top_per_query(found.withColumn("score", F.round("score", digits)), k)


def ranges_of(index: TextIndex, spark: SparkSession) -> DataFrame:
    """segment, range and how many postings it holds: what a search may skip."""
    return index.table(spark, "blocks").groupBy("segment", "range").agg(F.sum("n").alias("n_postings"))
