import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import retrieval, text_index, vector_index


def rows_of(df, key):
    return sorted((r["query_id"], r["rank"], r[key], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Über", "слово", "x_1"]
    rows = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 60)))) for k in range(900)]
    rows += [(900, None), (901, ""), (902, "w0 " * 3000), (903, "rare"), (904, "rare w0")]
    asked = [(1, "w0 w1 w2"), (2, "rare"), (3, "слово w5 w5 über"), (4, "unknown"), (5, None), (6, "w62 x_1 w40")]
    return spark.createDataFrame(rows, "chunk_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize("segments", [1, 4])
def test_index_gives_what_reading_all_texts_gives(spark, texts, tmp_path, monkeypatch, segments):
    monkeypatch.setattr(text_index, "RANGE_DOCS", 16)
    chunks, asked = texts
    index = text_index.create_index(chunks.where(F.col("chunk_id") % segments == 0), str(tmp_path / "index"))
    for k in range(1, segments):
        index = text_index.add_segment(index, chunks.where(F.col("chunk_id") % segments == k))
    scores = retrieval.bm25(chunks, asked).withColumn("score", F.round("score", 6))
    want = rows_of(retrieval.top_per_query(scores, 5), "chunk_id")
    for first in (1, 4, 1000):
        assert rows_of(text_index.search(index, asked, 5, first_ranges=first), "chunk_id") == want
    assert rows_of(text_index.search(text_index.open_index(spark, index.path), asked, 5), "chunk_id") == want


def test_a_segment_that_did_not_end_is_not_read(spark, texts, tmp_path, monkeypatch):
    chunks, asked = texts
    index = text_index.create_index(chunks, str(tmp_path / "index"))
    want = rows_of(text_index.search(index, asked, 5), "chunk_id")
    monkeypatch.setattr(text_index, "open_index", lambda *a: 1 / 0)
    # Blocks are written, the segment's own row is not.
    spark.read.parquet(f"{index.path}/blocks").where("segment = 0").withColumn("segment", F.lit(1)).write.partitionBy("segment", "bucket").mode("append").parquet(f"{index.path}/blocks")
    monkeypatch.undo()
    assert rows_of(text_index.search(text_index.open_index(spark, index.path), asked, 5), "chunk_id") == want


def test_ranges_below_the_bound_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE_DOCS", 8)
    rows = [(k, "common " * 1 + f"filler{k} " * 200) for k in range(400)] + [(1000 + k, "common common common") for k in range(40)]
    index = text_index.create_index(spark.createDataFrame(rows, "chunk_id long, text string"), str(tmp_path / "index"))
    read = []
    plain = text_index._part
    monkeypatch.setattr(text_index, "_part", lambda *a: read.append(a) or plain(*a))
    asked = spark.createDataFrame([(1, "common")], "query_id long, text string")
    assert [r.chunk_id >= 1000 for r in text_index.search(index, asked, 5, first_ranges=60).collect()] == [True] * 5
    # Once for the bounds and once for the first ranges: no other range's postings were read.
    assert len(read) == 2 and text_index.ranges_of(index, spark).count() > 60


def test_postings_are_counted_where_they_are_written_and_read_without_a_shuffle(spark, texts, tmp_path, monkeypatch):
    chunks, asked = texts
    monkeypatch.setattr(text_index, "RANGE_DOCS", 16)
    index = text_index.create_index(chunks, str(tmp_path / "index"))
    task = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    tasks = spark.read.parquet(f"{index.path}/blocks").groupBy("range").agg(F.countDistinct(task).alias("n"), F.count_distinct("bucket").alias("buckets"))
    assert tasks.where("n > 1").count() == 0 < tasks.where("buckets > 8").count()
    plans = []
    plain = text_index.checkpoint
    monkeypatch.setattr(text_index, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text_index.search(index, asked, 5, first_ranges=1).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    joined = [x for x in plans if "postings" in x]
    assert joined and all("BroadcastHashJoin" in x and "SortMergeJoin" not in x and "ShuffledHashJoin" not in x for x in joined)


def test_more_asked_terms_than_are_sent_join_by_shuffle(spark, texts, tmp_path, monkeypatch):
    chunks, asked = texts
    index = text_index.create_index(chunks, str(tmp_path / "index"))
    want = rows_of(text_index.search(index, asked, 5, first_ranges=1), "chunk_id")
    monkeypatch.setattr(text_index, "SENT_ROWS", 1)
    assert rows_of(text_index.search(index, asked, 5, first_ranges=1), "chunk_id") == want


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.4 * rng.normal(size=16)).tolist()) for k in range(1500)]
    rows += [(2000 + k, (centres[0] + 0.01 * rng.normal(size=16)).tolist()) for k in range(700)]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [float("inf")] + [1.0] * 15), (3004, [None] + [1.0] * 15)]
    return spark.createDataFrame(rows + odd, "key long, embedding array<double>")


@pytest.mark.parametrize("part_rows, query_rows", [(8192, 1024), (50, 3)])
def test_all_cells_give_the_full_scan_and_few_nine_tenths(spark, vectors, tmp_path, monkeypatch, part_rows, query_rows):
    monkeypatch.setattr(vector_index, "PART_ROWS", part_rows)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", query_rows)
    index = vector_index.write_index(vectors, str(tmp_path / "index"))
    asked = vectors.where("key % 100 = 0 OR key >= 3000").withColumnRenamed("key", "query_id")
    exact = retrieval.vector_topk(vectors.where("key <> 3001"), asked.where("query_id <> 3001"), 10)
    assert rows_of(vector_index.search(index, asked, 10), "key") == rows_of(exact, "key")
    near = vector_index.search(vector_index.open_index(spark, index.path), asked, 10, probes=6)
    assert vector_index.recall(near, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert {r.query_id for r in near.collect()} == {r.query_id for r in asked.where("query_id < 3000").collect()}


def test_index_of_few_or_no_vectors(spark, vectors, tmp_path):
    one = vectors.where("key = 5")
    index = vector_index.write_index(one, str(tmp_path / "one"))
    assert [r.key for r in vector_index.search(index, one.withColumnRenamed("key", "query_id"), 3).collect()] == [5]
    none = vector_index.write_index(vectors.where("key >= 3000"), str(tmp_path / "none"))
    assert len(none.centroids) == 1


def test_queries_of_several_blocks(spark, vectors, monkeypatch):
    asked = vectors.where("key % 50 = 0").withColumnRenamed("key", "query_id")
    want = rows_of(retrieval.vector_topk(vectors, asked, 4), "key")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert rows_of(retrieval.vector_topk(vectors, asked, 4), "key") == want
    # One without length scores 0 with all; the others find nothing.
    odd = rows_of(retrieval.vector_topk(vectors, vectors.where("key >= 3000").withColumnRenamed("key", "query_id"), 2), "key")
    assert odd == [(3001, 0, 0, 0.0), (3001, 1, 1, 0.0)]


def test_a_task_holds_few_cosines_at_a_time():
    import tracemalloc

    import numpy as np

    from factloom.operators.retrieval import nearest

    random = np.random.default_rng(7)
    unit, held, keys = random.normal(size=(4096, 8)), random.integers(-2, 3, size=(10_000, 8)).astype(float), random.permutation(10_000)
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    tracemalloc.start()
    got = [[np.asarray(x) for x in part] for part in nearest(unit, held, keys, 15, 3)]
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    rows, near, scores = (np.concatenate(x) for x in zip(*got, strict=True))
    assert len(rows) == 4096 * 15
    lengths = np.maximum(np.sqrt((held * held).sum(axis=1)), 1e-300)
    for q in (0, 99, 100, 4095):
        every = np.round(held @ unit[q] / lengths, 3)
        want = sorted(zip(-every, keys, strict=True))[:15]
        assert [(-a, b) for a, b in want] == list(zip(scores[rows == q], near[rows == q], strict=True))


def test_cells_are_probed_until_recall_is_reached(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, x.tolist()) for k, x in enumerate(rng.normal(size=(3000, 16)))]
    vectors = spark.createDataFrame(rows, "key long, embedding array<double>").repartition(2).cache()
    index = vector_index.write_index(vectors, str(tmp_path / "index"), cells=40)
    probes = vector_index.probes_for(index, vectors, 10)
    assert 4 < probes <= 40
    asked = vectors.where("key % 50 = 0").withColumnRenamed("key", "query_id")
    mean = lambda n: vector_index.recall(vector_index.search(index, asked, 10, n), retrieval.vector_topk(vectors, asked, 10)).agg(F.avg("recall")).first()[0]
    assert mean(4) < 0.9 <= mean(probes)


def test_postings_move_as_blocks_only(spark, tmp_path):
    """What an index shuffles is its texts, its blocks and its dictionary, not a row for each posting."""
    rng = random.Random(9)
    words = [f"word{k:04d}" for k in range(3000)]
    rows = [(k, " ".join(rng.sample(words[: 300 if k % 2 else 3000], 150))) for k in range(2000)]
    docs = spark.createDataFrame(rows, "chunk_id long, text string").repartition(2)
    tracker, seen = spark.sparkContext.statusTracker(), set()
    spark.sparkContext.setJobGroup("text-index", "text-index")
    index = text_index.create_index(docs, str(tmp_path / "index"))
    jobs = tracker.getJobIdsForGroup("text-index")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark.sparkContext._jsc.sc().statusStore()
    for job in jobs:
        seen |= set(tracker.getJobInfo(job).stageIds)
    moved = sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in seen if tracker.getStageInfo(k))
    n_postings = index.table(spark, "blocks").agg(F.sum("n")).first()[0]
    assert n_postings == 300_000 and index.mean_length == 150.0
    n_blocks = index.table(spark, "blocks").count()
    assert moved < n_postings and moved < 2000 + 2 * n_blocks + 20_000
