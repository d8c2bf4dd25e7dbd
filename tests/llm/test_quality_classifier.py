import random
import zlib

import numpy as np

from factloom.llm import quality_classifier as qc


def corpus(spark, n=900):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeinorst", k=rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(words) + ("" if good else "$$$") for _ in range(rng.randint(20, 200)))
        docs.append((k, text))
        labels.append((k, int(good)))
    docs += [(n, None), (n + 1, ""), (None, "no id"), (n + 2, "z" * 100_000)]
    labels += [(5, None), (6, 0), (6, 1), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = qc.score(docs, qc.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id not in (5, 6, None)]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    kept = qc.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_long_texts_that_differ_late(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("aeinorst", k=rng.randint(2, 9))) for _ in range(400)]
    for size in (20_000, 70_000):  # within and beyond what was once left out
        rows = [(k, " ".join(rng.choices(words, k=1800))[:9000] + " ".join(w + "$$$" * (k % 2) for w in rng.choices(words, k=size // 6))) for k in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(100, 1)], "doc_id long, quality int")
        model = qc.train(docs, labels)
        assert model.good and b"$$$" in model.bad
        assert {r.doc_id for r in qc.keep_good(docs, labels).select("doc_id").collect()} == set(range(0, 60, 2))


def test_held_out_labels_teach_nothing(spark):
    docs, labels, _ = corpus(spark, 300)
    flipped = labels.selectExpr("doc_id", f"CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    first = {r.doc_id: r.score for r in qc.score(docs, qc.train(docs, labels)).collect()}
    assert first == {r.doc_id: r.score for r in qc.score(docs, qc.train(docs, flipped)).collect()}


def test_without_labels_and_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.score(odd, qc.train(odd, none)).collect()} == {0.5}
    assert qc.score(empty, qc.train(empty, none)).count() == 0
    assert qc.keep_good(odd, none).count() == odd.count()


def test_held_out_labels_of_the_tables(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = qc.score(docs, qc.train(docs, labels)).where("held_out").join(labels.where("quality is not null"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 100 and len(bad) > 30
    above = sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.98 and sum(r.predicted for r in good) / len(good) > 0.98 and sum(r.predicted for r in bad) / len(bad) < 0.3


def test_the_curve_is_found_where_whole_newton_steps_overshoot():
    for seed in (218, 339, 547, 693):
        rng = np.random.default_rng(seed)
        y = (np.arange(200) % 4 > 0).astype(float)
        x = np.stack([np.where(y > 0, 0.08, -0.06) + rng.normal(0, 0.03, 200), rng.uniform(3, 11, 200)], 1)
        far = rng.integers(0, 200, 6)
        x[far, 0] = rng.uniform(-0.5, 0.3, 6)
        a, b, c = qc._fit(x, y)
        p = 1 / (1 + np.exp(-(a + b * x[:, 0] + c * x[:, 0] * x[:, 1])))
        features = np.stack([np.ones(200), x[:, 0], x[:, 0] * x[:, 1]], 1)
        assert np.abs(features.T @ (y - p) - np.array([1e-3, 1e-4, 1e-4]) * (a, b, c)).max() < 1e-4
        assert ((p >= qc.THRESHOLD) != y).mean() < 0.1
