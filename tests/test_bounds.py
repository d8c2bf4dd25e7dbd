"""What a task holds, and how often tables are read, does not grow faster than the input."""

import pandas as pd
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from factloom.operators import analytics, importing, mutation, names, planning, validation
from factloom.plans import ingest, streams
from factloom.sources import files, yaml_tables

from .duck import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_goals_meet_their_names_without_a_shuffle(spark):
    parsed = spark.createDataFrame([(1, "x", "m", None, None, "increase")], "goal_id long, text string, target string, process string, metric string, direction string")
    got = planning.subqueries(parsed, spark.createDataFrame([("m", "никель", "nickel")], "entity_id string, name_ru string, name_en string"))
    assert "SortMergeJoin" not in plan_of(got) and got.count() == 8


def test_found_names_are_handed_over_in_parts():
    made = names.Automaton.of([("a", "term", "word")])
    texts = pd.DataFrame({"doc_id": range(300), "text": ["word " * 100] * 300})
    sizes = [len(f) for f in names.found_in(iter([texts]), made, "doc_id")]
    assert sum(sizes) == 30_000 and max(sizes) < names.ROWS_AT_ONCE + 100


def test_words_are_taken_from_the_texts_once(spark):
    assert "regexp_extract_all" not in plan_of(ingest.lemma_words(spark, SF))


def test_leaves_are_handed_over_in_parts():
    text = "\n".join(f"k{k}: {k}" for k in range(25_000))
    files = pd.DataFrame({"source_path": ["a", "b", "c"], "value": [text, "x: 1", "x: ["]})
    got = [*yaml_tables._leaves_of(iter([files]))]
    assert [len(f) for f in got] == [10_000, 10_000, 5_000, 1, 1] and got[-1]["error"].notna().all()


def test_each_yaml_file_is_a_file(spark):
    rows = spark.createDataFrame([(f, k, f"k{k}: {f}") for f in range(20) for k in range(3)], "file long, ord int, line string")
    path = ingest._write_yaml(rows, spark, "bounds")
    assert sorted(r.value for r in spark.read.text(path, wholetext=True).collect()) == sorted(f"k0: {f}\nk1: {f}\nk2: {f}\n" for f in range(20))


def test_documents_are_files_in_few_folders(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [r.path.split("/") for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(ingest._as_files(docs, spark)).select("path").collect()]
    assert len(found) == docs.count() and 8 < len({x[-2] for x in found}) <= 128


@pytest.fixture
def odd_corpus(tmp_path):
    root = tmp_path / "a corpus"
    for name in ("a b/c d%+#&é\u00a0слово.txt", "a b/folder=1/x.md", "_x/h.txt", ".y/h.txt", "_k=1/h.txt", "_z.txt", ".z.txt", "_z=.txt", "e.txt", "~$q.txt", "U.TXT", "dir.txt/in.txt", "p%20q.txt", "q'\"()[]{}^$@~!,;.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"{name}\n")
    (root / "empty.txt").write_text("")
    (root / "bad.txt").write_bytes(b"\xff\xfeab\xc3")
    (root / "link.txt").symlink_to(root / "e.txt")
    return root


def test_files_of_a_shared_disk_are_listed_and_opened_by_tasks(spark, odd_corpus, monkeypatch):
    plain = files.read_corpus(spark, str(odd_corpus))
    held = files.read_corpus(spark, f"file://{odd_corpus}/")
    assert "Scan text" in plan_of(plain) and "Scan text" not in plan_of(held)
    want = sorted((r.source_path, r.raw) for r in plain.select("source_path", F.hex("raw").alias("raw")).collect())
    monkeypatch.setattr(files, "FILES_AT_ONCE", 2)
    assert sorted((r.source_path, r.raw) for r in files.read_corpus(spark, f"file:{odd_corpus}").select("source_path", F.hex("raw").alias("raw")).collect()) == want and len(want) == 10
    assert sorted((r.source_path, r.raw) for r in held.select("source_path", F.hex("raw").alias("raw")).collect()) == want


def test_documents_become_files_without_sparks_writer(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(DataFrameWriter, "text", lambda *a, **b: 1 / 0)
    docs = spark.createDataFrame([(k, None if k == 3 else f"text {k}\r\n" * k) for k in range(300)], "doc_id long, text string")
    read = files.read_corpus(spark, ingest._as_files(docs, spark))
    assert sorted(r.raw for r in read.collect()) == sorted("\n" if k == 3 else f"text {k}\r\n" * k + "\n" for k in range(300))
    # A second attempt of a task leaves what the first has written.
    texts = docs.select(F.coalesce("text", F.lit("")).alias("value")).repartition(3, "value")
    assert [files.write_texts(texts, f"{tmp_path}/twice") for _ in range(2)] == [300, 300]
    assert files.read_corpus(spark, f"file:{tmp_path}/twice").count() == 300 and not [*(tmp_path / "twice").glob(".attempt*")]


def test_a_text_is_normalised_once_when_it_is_parsed(spark):
    corpus = spark.createDataFrame([("file:/a.txt", "word " * 30), ("file:/b.txt", "word")], "source_path string, raw string")
    parsed = files.parse_documents(corpus)
    assert sum(line.count("\\p{Z}]+(") for line in plan_of(parsed).splitlines()) == 1
    assert [r.source_path for r in parsed.collect()] == ["file:/a.txt"]


def test_rows_made_from_changed_documents_are_taken_without_a_join(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, content_hash string")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "source_doc_id string, text string")
    first = mutation.write_documents({}, docs, {"chunks": chunks}, of_changed=("chunks",)).tables["chunks"]
    assert "Join" not in plan_of(first) and sorted(map(tuple, first.collect())) == [("a", "x"), ("b", "y")]
    stored = {"documents": docs, "chunks": chunks}
    later = mutation.write_documents(stored, spark.createDataFrame([("a", "3"), ("b", "2")], docs.schema), {"chunks": spark.createDataFrame([("a", "z")], chunks.schema)}, of_changed=("chunks",))
    assert sorted(map(tuple, later.tables["chunks"].collect())) == [("a", "z"), ("b", "y")]


def test_texts_of_an_import_are_not_shuffled_for_a_few_copies(spark, monkeypatch, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.txt").write_text(f"Nickel matte {k % 4} is leached in sulphuric acid. " * 4)
    names_of = spark.createDataFrame([("ni", "metal", "nickel")], "entity_id string, type string, name string")
    plans, reports = [], []
    plain = importing.chunk_documents
    monkeypatch.setattr(importing, "chunk_documents", lambda df: plans.append(plan_of(df)) or plain(df))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (importing.SENT_ROWS, 1):
            monkeypatch.setattr(importing, "SENT_ROWS", most)
            reports.append(dict(map(tuple, importing.import_corpus(spark, f"file:{tmp_path}", names_of).report.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
    assert reports[0] == reports[1] == {"files": 6, "parsed": 6, "contents": 4, "written": 4, "stored chunks": 4, "stored mentions": 4}


def test_deltas_do_not_carry_their_text(spark):
    docs = spark.createDataFrame([(1, "ab\n" * 30), (2, "x" * 25), (3, "\U0001f600" * 26)], "doc_id long, text string")
    deltas = streams._deltas(docs)
    exploded = [line for line in plan_of(deltas).splitlines() if "Generate" in line]
    assert len(exploded) == 1 and "text" not in exploded[0] and "parts" not in exploded[0].split("), [", 1)[1].split("]")[0]
    got = [(r.answer_id, r.seq, len(r.delta), r.done) for r in deltas.orderBy("answer_id", "seq").collect()]
    assert got == [("1", 1, 25, False), ("1", 2, 25, False), ("1", 3, 25, False), ("1", 4, 15, True), ("2", 1, 25, True), ("3", 1, 25, False), ("3", 2, 1, True)]


def test_no_task_has_all_pairs_of_an_entity(spark, monkeypatch):
    monkeypatch.setattr(analytics, "PAIRS_A_TASK", 500)
    rows = [(c, "hot" if c % 10 else "cold", c // 2, "positive" if c % 3 else "negative") for c in range(200)] + [(5, "cold", 2, "positive"), (7, "cold", 90, "negative")]
    about = spark.createDataFrame(rows, "claim_id long, entity_id string, doc_id long, polarity string")
    met, parts = analytics.claims_met(about, block=20)
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert parts > 20 and sum(sizes) > 16_000 and max(sizes) < 4000
    known = {(c, c + 4) for c in range(100)}
    want = {}
    for a, e, d, p in rows:
        for b, f, g, q in rows:
            if a < b and e == f and d != g and (a, b) not in known:
                want[a, b] = want.get((a, b), False) or p != q
    got = analytics.opposing_claims(about, spark.createDataFrame(sorted(known), "claim_a long, claim_b long")).collect()
    assert len(got) == len(want) and {(r.claim_a, r.claim_b): r.opposite for r in got} == want


def test_publications_are_counted_in_partitions_that_grow(spark, monkeypatch):
    monkeypatch.setattr(analytics, "DOCS_A_TASK", 10)
    authored = [(f"c{d % 7}", d) for d in range(200)] + [("c1", 1), ("c2", 1), (None, 3), ("c1", None)]
    mentions = [(f"e{(d * k) % 5}", d) for d in range(210) for k in range(4)] + [("e0", None)]
    counted = analytics.publications(spark.createDataFrame(authored, "expert_id string, doc_id long"), spark.createDataFrame(mentions, "entity_id string, doc_id long"))
    want = {}
    for c, d in authored:
        for e, of in mentions:
            if d is not None and d == of:
                want.setdefault((c, e), set()).add(d)
    assert {(r.expert_id, r.entity_id): r.n_publications for r in counted.collect()} == {k: len(v) for k, v in want.items()}
    assert counted.rdd.getNumPartitions() == len(authored) // 10 + 1


def test_places_of_names_are_not_sorted(spark):
    text = " ".join(f"w{k}" for k in range(300))
    texts = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    listed = spark.createDataFrame([(str(k), "x", f"w{k} w{k + 1} w{k + 2}") for k in range(298)], "entity_id string, type string, name string")
    found = names.occurrences(texts, listed, ["id"])
    assert "Window" not in plan_of(found)
    assert sorted((r.id, r.name, r.start_at, r.end_at) for r in found.collect()) == sorted((1, n, text.index(n), text.index(n) + len(n)) for k in range(298) for n in [f"w{k} w{k + 1} w{k + 2}"])


def test_only_words_of_the_quote_are_rows(spark):
    rows = [(1, "Alpha beta", "x " * 5000 + "alphabet alphaſ ALPHA Beta"), (2, "kiloK.*", "(KILOK] kilok"), (3, "Ёлка 12", "ёЛКА 12 x12"), (4, ". a", "a"), (5, "mass", "maſs, mass"), (6, None, None)]
    placed = validation.anchored_windows(spark.createDataFrame(rows, "fact_id long, quote string, text string"))
    exploded = [line for line in plan_of(placed).splitlines() if "Generate" in line]
    assert len(exploded) == 1 and "zip_with" in exploded[0]
    got = {r.fact_id: (r.coverage, r.span) for r in placed.collect()}
    assert got == {1: (1.0, "ALPHA Beta"), 2: (1.0, "KILOK"), 3: (1.0, "ёЛКА 12"), 4: (0.0, ""), 5: (1.0, "mass"), 6: (0.0, "")}
