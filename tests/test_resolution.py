import time

from pyspark.sql import functions as F

from factloom.operators import resolution


def test_common_words_do_not_multiply_mentions_by_entities(spark):
    n = 20_000
    mentions = spark.range(n).select(F.col("id").alias("mention_id"), F.lit("Material").alias("label"), F.lit("RED  bolt").alias("name"))
    surfaces = F.array(F.when(F.col("id") % 2 == 0, "bolt red").otherwise("red bolt"))
    entities = spark.range(n).select(F.format_string("e%06d", "id").alias("entity_id"), F.lit("Material").alias("label"), surfaces.alias("surfaces"), (F.col("id") % 2 == 0).alias("unresolved"), (F.col("id") < 2).alias("deleted"))
    began = time.monotonic()
    assert [tuple(r) for r in resolution.text_fallback(mentions, entities, n).groupBy("entity_id").count().collect()] == [("e000003", n)]
    assert time.monotonic() - began < 60


def test_only_the_first_candidates_of_the_same_words_are_asked(spark):
    known = [("e1", ["bolt red"]), ("e2", ["bolt red", "Red Bolt bolt"]), ("e3", ["red bolt"])]
    entities = spark.createDataFrame([(e, "Material", s, False, False) for e, s in known], "entity_id string, label string, surfaces array<string>, unresolved boolean, deleted boolean")
    asked = spark.createDataFrame([(1, "Material", "red bolt"), (2, "Material", "bolt RED"), (3, "Material", "red bolt bolt")], "mention_id long, label string, name string")
    found = lambda n: {r["mention_id"]: r["entity_id"] for r in resolution.text_fallback(asked, entities, n).collect()}
    assert found(5) == {1: "e3", 2: "e1", 3: "e2"}
    assert found(2) == {2: "e1", 3: "e2"}


def test_of_people_alike_the_least_id_survives(spark):
    people = spark.range(200).select(F.col("id").alias("expert_id"), F.when(F.col("id") % 2 == 0, "Ivanov J.K").otherwise("J.K Ivanov").alias("name"), F.lit(3).alias("degree"))
    assert sorted(map(tuple, resolution.dedupe_people(people).collect())) == [(0, k) for k in range(1, 200)]


def test_experts_of_one_degree_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from factloom.plans import texts

    spark.range(400).select(F.col("id").alias("c_custkey"), F.lit(5.0).alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    got = texts.CATALOGUE.queries["dedupe_experts_by_key"](spark, str(tmp_path)).select("survivor_id", "victim_id").collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.sql(f"SELECT survivor_id, victim_id FROM ({texts.CATALOGUE.sql['dedupe_experts_by_key']})").fetchall())
