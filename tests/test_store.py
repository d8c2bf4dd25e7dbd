import pytest
from pyspark.sql import functions as F

from factloom.operators import mutation, resolution
from factloom.sources.files import UnsupportedFormat, check_suffix, iso_times


def held(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_changed_document_loses_what_it_had_in_all_tables(spark, kind):
    name = (lambda k: k) if kind == "long" else (lambda k: f"d{k}")
    schema, facts_schema = f"doc_id {kind}, content_hash string", f"source_doc_id {kind}, value string"
    docs = spark.createDataFrame([(name(k), "a") for k in range(6)], schema)
    facts = spark.createDataFrame([(name(k), f"f{k}") for k in range(6)] + [(name(9), "of no document")], facts_schema)
    first = mutation.write_documents({}, docs, {"facts": facts, "claims": facts})
    assert held(first.tables["facts"]) == held(first.tables["claims"]) == [(name(k), f"f{k}") for k in range(6)]
    assert held(first.left_out) == [("claims", "unknown", 1), ("facts", "unknown", 1)]
    # Document 0 comes unchanged, 1 with a new fact, the others without; none brings claims.
    again = docs.where(F.col("doc_id") < name(4)).withColumn("content_hash", F.when(F.col("doc_id") == name(0), "a").otherwise("b"))
    new = spark.createDataFrame([(name(1), "new"), (name(0), "skipped"), (name(5), "not written")], facts_schema)
    second = mutation.write_documents(first.tables, again, {"facts": new})
    assert held(second.tables["facts"]) == [(name(0), "f0"), (name(1), "new"), (name(4), "f4"), (name(5), "f5")]
    assert held(second.tables["claims"]) == [(name(0), "f0"), (name(4), "f4"), (name(5), "f5")]
    assert held(second.tables["documents"]) == [(name(k), "b" if k in (1, 2, 3) else "a") for k in range(6)]
    assert held(second.left_out) == [("facts", "unchanged", 1), ("facts", "unknown", 1)] and held(second.changed) == [(name(k), "b") for k in (1, 2, 3)]


def test_tables_are_written_beside_those_they_come_from(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, content_hash string")
    facts = spark.createDataFrame([(1, "x")], "source_doc_id long, value string")
    one = mutation.save_tables(mutation.write_documents({}, docs, {"facts": facts}).tables, str(tmp_path / "1"))
    two = mutation.save_tables(mutation.write_documents(one, docs.withColumn("content_hash", F.lit("b")), {}).tables, str(tmp_path / "2"))
    assert held(one["facts"]) == [(1, "x")] and held(two["facts"]) == [] and held(two["documents"]) == [(1, "b")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        mutation.save_tables(one, str(tmp_path / "2"))


def test_a_document_that_stands_twice_is_refused(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, content_hash string")
    with pytest.raises(ValueError, match="doc_id is not unique"):
        mutation.write_documents({}, twice, {})


def test_merges_follow_chains_and_leave_circles(spark):
    pairs = [(f"n{k}", f"n{k - 1}") for k in range(1, 40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), ("b", "a"), ("c", "b"), ("d", "q"), ("d", "p")]
    got = dict(held(resolution.resolve_merges(spark.createDataFrame(pairs, "victim_id string, survivor_id string"))))
    assert got == {f"n{k}": "n0" for k in range(1, 40)} | {"b": "a", "c": "a", "d": "p"}
    edges = spark.createDataFrame([("c", "e", "R"), ("b", "a", "R"), ("a", "a", "R")], "src_key string, dst_key string, rel_type string")
    log = [(1, "merge_nodes", "b", "c"), (2, "merge_nodes", "a", "b")]
    df = spark.createDataFrame([(*x, None, "me") for x in log], "seq long, op string, a string, b string, rel_type string, edited_by string")
    assert [r[:2] for r in held(mutation.edit_edges(edges, df).select("src_key", "dst_key"))] == [("a", "a"), ("a", "e")]


def test_repeated_keys_give_one_row_each(spark):
    facts = spark.createDataFrame([("f", "A", False, None)], "fact_id string, rel_type string, deleted boolean, edited_by string")
    changes = spark.createDataFrame([("f", "B"), ("f", "B"), ("f", "C")], "fact_id string, rel_type string")
    assert [r[:3] for r in held(mutation.retype(facts, changes, "me").select("fact_id", "rel_type", "deleted"))] == [("f", "A", True), ("f~B", "B", False)]
    claims = spark.createDataFrame([(1,), (2,)], "claim_id long")
    pairs = spark.createDataFrame([(1, 5), (1, 7), (1, 5)], "claim_id long, superseded_by long")
    assert sorted((r.claim_id, r.superseded_by) for r in mutation.supersede(claims, pairs).collect()) == [(1, 7), (2, None)]
    schema = "entity_id long, label string, name string, aliases array<string>"
    incoming = spark.createDataFrame([(1, "M", "b", ["x"]), (1, "M", "a", ["y", "X"]), (1, None, None, None)], schema)
    for merged in (mutation.upsert_entities(incoming.where("1 = 0"), incoming), mutation.load_references(incoming.where("1 = 0"), incoming)):
        rows = merged.collect()
        assert len(rows) == 1 and rows[0].name == "a" and {x.lower() for x in rows[0].aliases} == {"x", "y"}


@pytest.mark.parametrize("path", ["a/b.MD", "c.txt"])
def test_text_files_are_accepted(path):
    check_suffix(path)


@pytest.mark.parametrize("path", ["a/b.pdf", "c.docx", "without"])
def test_other_files_are_refused(path):
    with pytest.raises(UnsupportedFormat):
        check_suffix(path)


def test_times_as_texts_have_their_offset(spark):
    row = iso_times(spark.sql("SELECT timestamp'2026-07-03 09:13:30.25' AS a, timestamp'2026-07-03 09:13:30' AS b, 1 AS n")).first()
    assert tuple(row) == ("2026-07-03T09:13:30.250000+00:00", "2026-07-03T09:13:30+00:00", 1)
