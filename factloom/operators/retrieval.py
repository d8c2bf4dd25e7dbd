"""Retrieval: postings and BM25, hashed and dense vectors, rank fusion, and measures of a ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import column, tokens
from factloom.shipping import fresh_folder, ship

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
HASH_DIM = 512
#: Queries whose vectors are one matrix in every task.
QUERY_BLOCK = 4096
#: Cosines that a task holds at a time.
PRODUCTS = 1_000_000
#: The cosine that a chunk found by its words alone is given.
WORDS_ONLY_SCORE = 0.60


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """chunk_id, term, tf and dl (the chunk's number of terms), of the terms of `only` if given. One shuffle, after counting within each map task."""
    # Counted before they are exploded: what stands beside explode is computed anew for each term.
    held = chunks.select(F.col(id_col).alias("chunk_id"), tokens(text_col).alias("terms")).select("chunk_id", F.size("terms").cast("long").alias("dl"), "terms")
    exploded = held.select("chunk_id", "dl", F.explode("terms").alias("term"))
    exploded = exploded if only is None else exploded.join(only, "term", "left_semi")
    return exploded.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """query_id, chunk_id, score of every chunk with a term of the query. queries: query_id, text.

    Okapi's weights, where terms in more than half of the chunks get EPSILON of
    the mean weight over all terms. Only the queries' terms are joined. A null text
    counts as an empty chunk.
    """
    held = chunks.select(F.col(id_col).alias("chunk_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    corpus = held.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    # A chunk's distinct terms are counted within each map task, so postings of the whole corpus are never shuffled.
    df = held.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(corpus)  # of one row
    weighed = df.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = weighed.agg(F.avg("idf").alias("mean_idf"))
    weights = weighed.crossJoin(mean).select("term", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("asked"))
    sought = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    post = postings(sought, only=queries.select(F.explode(tokens("text")).alias("term")).distinct())
    scored = post.join(asked.join(weights, "term"), "term")
    part = F.col("asked") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top_per_query(scores: DataFrame, k: int, key: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """The k best of each query, ranked from 0; ties by key. Spark limits each partition's groups before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(key))
    return scores.withColumn(rank, (F.row_number().over(order) - 1).cast("long")).where(F.col(rank) < k)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(column(a), column(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 for a vector without length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def shorten(vector: Column | str, dim: int) -> Column:
    """The first dim places, brought back to length 1."""
    head = F.slice(column(vector), 1, dim)
    length = norm(head)
    return F.transform(head, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def _lengths(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))
    return np.where(n > 0, n, np.inf)


def nearest(unit: np.ndarray, held: np.ndarray, keys: np.ndarray, k: int, digits: int, products: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries (of length 1), keys and rounded cosines of the k rows of held nearest to each, ties by key; of some `products` pairs at a time."""
    order = np.argsort(keys, kind="stable")
    keys, held = keys[order], (held[order] / _lengths(held[order])[:, None]).T
    step = max(1, products // max(1, len(keys)))
    for at in range(0, len(unit), step):
        scores = np.round(unit[at : at + step] @ held, digits)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(scores)), best.shape[1])
        yield rows + at, keys[best.ravel()], scores[rows, best.ravel()]


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, key, score, rank: the k nearest rows of each query by cosine, compared with all rows in blocks.

    vectors: key, embedding. queries: query_id, embedding. Scores are rounded before they rank. Queries go to the tasks
    as matrices of QUERY_BLOCK rows; a task multiplies them with its batches of vectors, PRODUCTS pairs at a time, and passes
    on the k best per batch and query, so pairs are never rows. One block is on the driver at a time: with several, each is searched and its best
    rows are written before the next is fetched. A vector without length has cosine 0; a null vector, or one that holds a
    null, NaN or infinity, is never found and, as a query, finds nothing.
    """
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors, queries = vectors.where(finite), queries.where(finite)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "key"))}

    def search(block: int) -> DataFrame:
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").collect()
        asked = np.array([r["embedding"] for r in own], np.float64).reshape(len(own), -1)
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in own], asked / _lengths(asked)[:, None]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, unit = sent.value
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                held, keys = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["key"].to_numpy()
                for rows, near, scores in nearest(unit, held, keys, k, digits):
                    yield pd.DataFrame({"query_id": [ids[x] for x in rows], "key": near, "score": scores})

        found = vectors.select("key", "embedding").mapInPandas(run, f"query_id {kinds['query_id']}, key {kinds['key']}, score double")
        return top_per_query(found, k, "key")

    if blocks == 1:
        return search(0)
    path = fresh_folder(spark, "nearest")
    for block in range(blocks):
        search(block).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def hash_features(rows: DataFrame, id_col: str, text_col: str, dim: int = HASH_DIM) -> DataFrame:
    """id, bucket, weight: words (1) and their padded letter trigrams (0.5), hashed to dim buckets, of length 1 per row."""
    words = tokens(text_col)
    padded = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.struct(F.concat(F.lit("c#"), F.substring(padded(w), i, F.lit(3))).alias("f"), F.lit(0.5).alias("w")))))
    whole = F.transform(words, lambda w: F.struct(F.concat(F.lit("w#"), w).alias("f"), F.lit(1.0).alias("w")))
    exploded = rows.select(F.col(id_col).alias("id"), F.explode(F.concat(whole, grams)).alias("x")).groupBy("id", F.col("x.f").alias("f")).agg(F.sum("x.w").alias("w"))
    bucket = (F.conv(F.substring(F.md5("f"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    summed = exploded.groupBy("id", bucket.alias("bucket")).agg(F.sum("w").alias("w"))
    lengths = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return summed.join(lengths, "id").select("id", "bucket", (F.col("w") / F.col("len")).alias("weight"))


def sparse_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, score: dot products of two tables of features that share a bucket."""
    a, b = left.select(F.col("id").alias("left_id"), "bucket", F.col("weight").alias("wa")), right.select(F.col("id").alias("right_id"), "bucket", F.col("weight").alias("wb"))
    return a.join(b, "bucket").groupBy("left_id", "right_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def reciprocal(rank: Column | str, offset: int) -> Column:
    """What a rank from 0 adds to a fused score; offset 1 where ranks are meant from 1."""
    return F.coalesce(1.0 / (RRF_K + column(rank) + offset), F.lit(0.0))


def fuse(first: DataFrame, second: DataFrame, key: str, offset: int) -> DataFrame:
    """query_id, key, score, first_rank, second_rank: the sum of reciprocal ranks of two rankings."""
    a = first.select("query_id", key, F.col("rank").alias("first_rank"))
    b = second.select("query_id", key, F.col("rank").alias("second_rank"))
    return a.join(b, ["query_id", key], "full").withColumn("score", reciprocal("first_rank", offset) + reciprocal("second_rank", offset))


def hybrid_search(dense: DataFrame, words: DataFrame, allowed: DataFrame | None = None, k: int = 15, top: int = 12) -> DataFrame:
    """Fuses the k best of each kind within the allowed chunks (chunk_id), of all without any. dense, words: query_id, chunk_id, score."""
    if allowed is not None:
        dense, words = (x.join(allowed.select("chunk_id"), "chunk_id", "left_semi") for x in (dense, words))
    allowed_dense, allowed_words = dense, words
    fused = fuse(top_per_query(allowed_dense, k), top_per_query(allowed_words, k), "chunk_id", 1)
    return top_per_query(fused, top)


def document_search(dense: DataFrame, words: DataFrame, allowed: DataFrame, top: int) -> DataFrame:
    """Documents by chunks that were fetched before filtering.

    dense: query_id, chunk_id, doc_id, score; words: query_id, chunk_id, doc_id, rank over
    all hits. A document's cosine is its best chunk's. Its rank by words counts
    the hits of other documents too, also of those that are not allowed. Without
    any hits by words the cosine ranks, else the fused ranks from 0.
    """
    best = dense.groupBy("query_id", "doc_id").agg(F.max("score").alias("cosine")).join(allowed, "doc_id", "left_semi")
    by_cosine = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "doc_id")
    a = best.withColumn("rank", (F.row_number().over(by_cosine) - 1).cast("long"))
    b = words.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).join(allowed, "doc_id", "left_semi")
    fused = fuse(a, b, "doc_id", 0).join(a.select("query_id", "doc_id", "cosine"), ["query_id", "doc_id"], "left")
    any_words = F.max(F.col("second_rank").isNotNull()).over(Window.partitionBy("query_id"))
    return top_per_query(fused.withColumn("score", F.when(any_words, F.col("score")).otherwise(F.col("cosine"))), top, "doc_id")


def merge_subqueries(results: DataFrame, top: int = 12) -> DataFrame:
    """query_id, subquery, chunk_id, score, dense, words -> a query's chunks by the sum of their fused scores, rounded as sums vary in order."""
    return top_per_query(results.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score"), F.max("dense").alias("dense"), F.max("words").alias("words")), top)


def top_up(strict: DataFrame, free: DataFrame, least: int, top: int) -> DataFrame:
    """query_id, doc_id, rank, filled: strict hits, and where they are under `least` the best free ones up to `top`."""
    few = strict.groupBy("query_id").agg(F.count("*").alias("n"))
    rest = free.join(strict, ["query_id", "doc_id"], "left_anti").join(few, "query_id", "left").where(F.coalesce("n", F.lit(0)) < least)
    both = strict.select("query_id", "doc_id", "rank", F.lit(False).alias("filled")).union(rest.select("query_id", "doc_id", "rank", F.lit(True)))
    order = Window.partitionBy("query_id").orderBy("filled", "rank", "doc_id")
    return both.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < top)


def ranking_measures(ranked: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """query_id, recall, reciprocal_rank of a ranking against the relevant keys."""
    hits = relevant.join(ranked, ["query_id", key], "left")
    return hits.groupBy("query_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1.0 / (F.min("rank") + 1), F.lit(0.0)).alias("reciprocal_rank"))


def assert_one_space(vectors: DataFrame, provider: str, model: str, dim: int) -> None:
    """Refuses vectors of another provider, model or dimension than the space in use."""
    other = vectors.where((F.col("provider") != provider) | (F.col("model") != model) | (F.size("embedding") != dim)).limit(1).collect()
    if other:
        raise ValueError(f"vectors of another space: {other[0]['provider']}, {other[0]['model']}")


def pending(rows: DataFrame, most: int) -> DataFrame:
    """Rows that still need a vector: without one, and with text."""
    return rows.where(F.col("embedding").isNull() & (F.col("text") != "")).orderBy("key").limit(most)


def enrich(hits: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, chunk_id, rank) with title, year and access_level of their document and the text of their chunk; unknown ones go."""
    return hits.join(documents.select("doc_id", "title", "year", "access_level"), "doc_id").join(chunks.select("chunk_id", "text"), "chunk_id")


def answer_measures(statements: DataFrame) -> DataFrame:
    """One row: n_statements, citation_coverage (share with a citation) and verified_ratio (share of the cited ones that are verified). statements: n_citations, verified."""
    cited = F.col("n_citations") > 0
    counted = statements.agg(F.count("*").alias("n_statements"), F.count_if(cited).alias("c"), F.count_if(cited & F.col("verified")).alias("v"))
    return counted.select("n_statements", F.coalesce(F.try_divide("c", "n_statements"), F.lit(0.0)).alias("citation_coverage"), F.coalesce(F.try_divide("v", "c"), F.lit(0.0)).alias("verified_ratio"))


def similar_pairs(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """pair_id, score, similar: whether two embeddings (a, b) of one text in two languages are near enough."""
    return pairs.select("pair_id", cosine("a", "b").alias("score")).withColumn("similar", F.col("score") >= least)


def numbered_context(context: DataFrame) -> DataFrame:
    """query_id, context: the cited chunks as `[C1] (title, type, lang, year): quote` lines in the order of their numbers.

    context: query_id, n, title, doc_type, lang, year, quote; what is not known is shown as None, and lines stand apart by an empty one.
    """
    fields = ("title", "doc_type", "lang", "year")
    lines = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in fields], "quote"))).alias("x"))
    shown = F.transform("x", lambda r: F.concat(F.lit("[C"), r["n"].cast("string"), F.lit("] ("), F.concat_ws(", ", *[r[c] for c in fields]), F.lit("): "), r["quote"]))
    return lines.select("query_id", F.array_join(shown, "\n\n").alias("context"))


def without_vectors(rows: DataFrame) -> DataFrame:
    """The same rows with no embedding, as when another space comes into use."""
    return rows.withColumn("embedding", F.lit(None).cast(rows.schema["embedding"].dataType))
