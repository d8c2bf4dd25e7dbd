import corpus_pipeline
from factloom.llm import quality_classifier, queries

from .test_simhash import brute_components, brute_fingerprint, close

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, classify), (_, exact), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    good = classify(spark, docs, SF).cache()
    scores = {r.doc_id: r.predicted for r in queries.op10_quality_classifier(spark, SF).collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {k for k, v in scores.items() if v}
    rows = good.collect()
    last = {}
    for r in rows:
        last[lower(r.text)] = max(r.doc_id, last.get(lower(r.text), -1))
    once = exact(spark, good, SF).cache()
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == set(last.values())
    prints = {r.doc_id: brute_fingerprint(r.text) for r in once.collect()}
    label = brute_components(sorted(prints), lambda a, b: close(prints[a], prints[b]))
    few = near(spark, once, SF).cache()
    assert few.columns == docs.columns and {r.doc_id for r in few.collect()} == set(label.values())
    mixed = mix(spark, few, SF).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in few.collect()}
    assert encode(spark, mixed, SF).count() == mixed.count()
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_the_classifier_keeps_labelled_good_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in quality_classifier.keep_good(docs, labels).select("doc_id").collect()}
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    assert sum(i in kept for i in good) / len(good) > 0.97
