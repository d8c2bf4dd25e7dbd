"""Readers and writers: text corpora, dimensions, extractions, indexes, exports and the audit trail."""

from __future__ import annotations

import os
import re
import shutil
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text, tolerant_json
from factloom.shipping import checkpoint, ship

TEXT_SUFFIXES = ("md", "txt")
LEAST_CHARS = 100
#: Files and bytes of files that a task opens, about, and that it hands over at a time.
FILES_A_TASK, BYTES_A_TASK = 4000, 32_000_000
FILES_AT_ONCE, BYTES_AT_ONCE = 1000, 16_000_000
#: Tasks among which the folders of a level are dealt.
LISTING_TASKS = 128

EXTRACTION = T.StructType([
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("type", "name", "quote")]))),
    T.StructField("relations", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("type", "from", "to", "quote", "confidence", "value_raw", "unit_raw", "operator_raw", "value_text")]))),
    T.StructField("claims", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("about", T.ArrayType(T.StringType())), T.StructField("polarity", T.StringType()), T.StructField("quote", T.StringType())]))),
    T.StructField("_corrupt", T.StringType()),
])


class UnsupportedFormat(ValueError):
    """A file type that needs a parser which is not part of this library."""


def check_suffix(path: str) -> None:
    suffix = path.rpartition(".")[2].lower()
    if suffix not in TEXT_SUFFIXES:
        raise UnsupportedFormat(f"{suffix}: give its text as md or txt")


def local_path(path: str) -> str | None:
    """The path on disk of a file: path, None for any other."""
    found = re.fullmatch(r"file:(?://)?(/(?!/).*)", path, re.S)
    return found and found[1]


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """source_path, raw of all text files below root, temporary ones (~$), hidden and empty ones left out.

    Of a folder on a disk (file:) that all share, tasks list the folders and open the files: Spark's reader would hold all
    files' names on the driver, and takes longer to open a small file than to read it. Other roots are left to that reader.
    """
    folder = local_path(root)
    if folder and os.path.isdir(folder) and not re.search(r"[{}\[\]*?\\]", folder):
        named = _open_files(_list_files(spark, folder.rstrip("/")))
    else:
        found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(TEXT_SUFFIXES) + "}")
        named = found.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("raw"))
    return named.where(~F.substring_index("source_path", "/", -1).startswith("~$"))


def file_url(path: str) -> str:
    """A path on disk as Spark's reader names it."""

    def shown(c: str) -> str:
        return c if c > "\x7f" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc") else quote(c, safe="")

    return "file:" + re.sub(r"[^A-Za-z0-9/_\-!.~'()*;:@&=+$,]", lambda m: shown(m[0]), path)


def _list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of the text files below a folder, listed level by level. What Spark's reader takes for hidden is left out."""
    ship(spark)
    suffixes = tuple(f".{x}" for x in TEXT_SUFFIXES)
    rows_of = lambda held: pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["path", "size"])
    at_once = FILES_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple[str, int | None]] = []
                with os.scandir(path) as entries:
                    for x in entries:
                        if x.name.startswith(".") or x.name.startswith("_") and "=" not in x.name:
                            continue
                        if x.is_dir():
                            held.append((x.path, None))
                        elif x.name.endswith(suffixes) and (size := x.stat().st_size):
                            held.append((x.path, size))
                        if len(held) >= at_once:
                            yield rows_of(held)
                            held = []
                yield rows_of(held)

    level, every = spark.createDataFrame([(folder,)], "path string"), None
    while every is None or not level.isEmpty():
        found = checkpoint(level.mapInArrow(run, "path string, size long"))
        files = found.where("size IS NOT NULL")
        every = files if every is None else every.unionByName(files)
        level = found.where("size IS NULL").select("path").repartition(LISTING_TASKS, "path")
    return every


def _open_files(files: DataFrame) -> DataFrame:
    """source_path, raw of files (path, size), dealt out by their number and size."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(8, n // FILES_A_TASK, size // BYTES_A_TASK)
    at_once = FILES_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        urls, raw, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    raw.append(f.read())
                urls.append(file_url(path))
                held += len(raw[-1])
                if len(raw) >= at_once or held >= BYTES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(raw, pa.binary())], ["source_path", "raw"])
                    urls, raw, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(raw, pa.binary())], ["source_path", "raw"])

    opened = files.select("path").repartition(tasks, "path").mapInArrow(run, "source_path string, raw binary")
    return opened.select("source_path", F.col("raw").cast("string").alias("raw"))


def write_texts(texts: DataFrame, folder: str) -> int:
    """Writes each value, and a line end, as a text file below a folder on a disk that all share, and gives their number.

    Each task fills a folder of its own, which gets its name when all is written, so that of a task's attempts one counts.
    """
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        made, whole, n = f"{folder}/.attempt-{task.taskAttemptId()}", f"{folder}/folder={task.partitionId()}", 0
        os.makedirs(made)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                with open(f"{made}/{n}.txt", "wb") as out:
                    out.write(value + b"\n")
                n += 1
        try:
            os.rename(made, whole)
        except OSError:
            if not os.path.isdir(whole):
                raise
            shutil.rmtree(made)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return texts.select(F.col("value").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def parse_documents(corpus: DataFrame) -> DataFrame:
    """source_path, title, doc_type, lang, year, authority, access_level, text, content_hash: from front matter, then file name, then text."""
    stem = F.regexp_replace(F.substring_index("source_path", "/", -1), r"\.[^.]*\z", "")
    # A text is made once and its length looked at there: before a filter, it would be made anew for the filter.
    whole = F.explode(F.filter(F.array(text.normalize_text(text.body_after_front_matter("raw"))), lambda x: F.length(x) >= LEAST_CHARS))
    read = corpus.select("source_path", "raw", whole.alias("text")).select("source_path", stem.alias("stem"), text.front_matter("raw").alias("m"), text.file_name_facts(stem).alias("f"), "text")
    get = lambda k: F.nullif(F.try_element_at("m", F.lit(k)), F.lit(""))
    return read.select(
        "source_path", F.coalesce(get("title"), "stem").alias("title"), F.coalesce(get("doc_type"), "f.doc_type", F.lit("report")).alias("doc_type"),
        F.coalesce(get("lang"), "f.lang", text.detect_lang("text")).alias("lang"), F.coalesce(get("year").try_cast("int"), "f.year").alias("year"), F.coalesce(get("authority"), F.lit("normal")).alias("authority"),
        F.coalesce(get("access_level"), F.lit("public")).alias("access_level"), "text", F.sha2("text", 256).alias("content_hash"),
    )


def first_of_each_content(docs: DataFrame) -> DataFrame:
    """One document per content: the first by path."""
    order = Window.partitionBy("content_hash").orderBy("source_path")
    return docs.withColumn("factloom_nth", F.row_number().over(order)).where("factloom_nth = 1").drop("factloom_nth")


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV dimension with a header and # comments; `aliases` is split at semicolons."""
    df = spark.read.csv(path, header=True, schema=schema, comment="#", multiLine=True)
    if "aliases" in df.columns:
        df = df.withColumn("aliases", F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))
    return df


def repair_payloads(rows: DataFrame) -> DataFrame:
    """doc_id, payload (whole JSON, NULL without any), n_closed, n_commas and lost_chars: what was closed, dropped and cut off of each payload."""
    ship(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [tolerant_json.repair(x or "") for x in pdf["payload"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "payload": [x[0] for x in out], "n_closed": [x[1] for x in out], "n_commas": [x[2] for x in out], "lost_chars": [x[3] for x in out]})

    return rows.select("doc_id", "payload").mapInPandas(run, f"doc_id {kind}, payload string, n_closed long, n_commas long, lost_chars long")


def read_extractions(rows: DataFrame, type_aliases: dict[str, str], tolerant: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, payload (JSON) -> relations with known types, and counts of what was dropped by type. Broken JSON counts as _corrupt.

    If tolerant, payloads are repaired first: what is whole of a broken one is read, and it counts as _cut; one without any JSON as _corrupt.
    """
    cut = None
    if tolerant:
        rows = repair_payloads(rows)
        cut = rows.where("payload IS NOT NULL AND n_closed > 0").select(F.lit("_cut").alias("type"))
    parsed = rows.select("doc_id", F.from_json("payload", EXTRACTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"), F.col("payload").isNull().alias("nothing"))
    known = F.create_map(*[F.lit(v) for kv in type_aliases.items() for v in kv])
    relations = parsed.select("doc_id", F.explode("x.relations").alias("r")).select("doc_id", F.try_element_at(known, F.col("r.type")).alias("rel_type"), "r.*")
    broken = parsed.where(F.col("x._corrupt").isNotNull() | (F.col("nothing") & F.lit(tolerant))).select(F.lit("_corrupt").alias("type"))
    lost = relations.where("rel_type IS NULL").select("type").union(broken)
    dropped = (lost if cut is None else lost.union(cut)).groupBy("type").agg(F.count("*").alias("n_dropped"))
    return relations.where("rel_type IS NOT NULL").drop("type"), dropped


def save_index(docs: DataFrame, chunks: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/chunks")


def mirror_markdown(docs: DataFrame) -> DataFrame:
    """path, value: documents as Markdown with front matter, to be written as text."""
    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ndoc_type: "), "doc_type", F.lit("\nlang: "), "lang", F.lit("\n---\n"))
    return docs.select(F.regexp_replace("source_path", r"\.[^./]*\z", ".md").alias("path"), F.concat(head, "text").alias("value"))


def json_ld(nodes: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """node_key, document: each node as JSON-LD; a predicate with one target is a value, with several a list. Nulls and embeddings are left out."""
    targets = edges.groupBy("src_key", "rel_type").agg(F.array_sort(F.collect_set(F.concat(F.lit(base), "dst_key"))).alias("t"))
    one = F.when(F.size("t") == 1, F.to_json(F.struct(F.element_at("t", 1).alias("v")))).otherwise(F.to_json(F.struct(F.col("t").alias("v"))))
    parts = targets.select("src_key", F.concat(F.lit('"'), "rel_type", F.lit('":'), F.substr(one, F.lit(6), F.length(one) - 6)).alias("part"))
    joined = parts.groupBy("src_key").agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("links"))
    out = nodes.join(joined, nodes["node_key"] == joined["src_key"], "left")
    plain = [c for c in nodes.columns if c not in ("node_key", "label", "embedding")]
    own = F.to_json(F.struct(F.concat(F.lit(base), "node_key").alias("@id"), F.col("label").alias("@type"), *plain))
    return out.select("node_key", F.when(F.col("links").isNull(), own).otherwise(F.concat(F.substr(own, F.lit(1), F.length(own) - 1), F.lit(","), "links", F.lit("}"))).alias("document"))


def audit_tail(lines: DataFrame, schema: str, most: int) -> DataFrame:
    """The last records of an audit trail in their order; broken lines are skipped. lines: seq, value."""
    parsed = lines.select("seq", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.where("r._corrupt IS NULL").select("seq", "r.*").drop("_corrupt")
    return good.orderBy(F.desc("seq")).limit(most).orderBy("seq")


def import_report(outcomes: DataFrame) -> DataFrame:
    """One row of totals. outcomes: status, n_facts, n_review, n_unknown."""
    return outcomes.agg(F.count("*").alias("n_all"), F.count_if(F.col("status") == "written").alias("n_written"), F.count_if(F.col("status") == "skipped").alias("n_skipped"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.sum("n_facts").alias("n_facts"), F.sum("n_review").alias("n_review"), F.sum("n_unknown").alias("n_unknown"))


def read_claims(rows: DataFrame) -> DataFrame:
    """doc_id, text, about, polarity, quote of the claims in payloads (see read_extractions); an unknown polarity counts as neutral, blank claims go."""
    parsed = rows.select("doc_id", F.from_json("payload", EXTRACTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    claims = parsed.select("doc_id", F.explode("x.claims").alias("c")).where(F.trim("c.text") != "")
    polarity = F.lower(F.trim("c.polarity"))
    about = F.coalesce("c.about", F.array().cast("array<string>"))
    return claims.select("doc_id", F.trim("c.text").alias("text"), about.alias("about"), F.when(polarity.isin("positive", "negative", "neutral"), polarity).otherwise("neutral").alias("polarity"), F.col("c.quote").alias("quote"))


def read_entities(rows: DataFrame) -> DataFrame:
    """doc_id, type, name, quote of the entities in payloads (see read_extractions)."""
    parsed = rows.select("doc_id", F.from_json("payload", EXTRACTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    return parsed.select("doc_id", F.explode("x.entities").alias("e")).select("doc_id", F.trim("e.type").alias("type"), F.trim("e.name").alias("name"), F.col("e.quote").alias("quote"))


def append_audit(records: DataFrame, path: str) -> None:
    """Adds records to an audit trail of JSON lines."""
    records.write.mode("append").json(path)


def answer_markdown(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, document: an answer as Markdown: its question as the title, its text, and its sources as a numbered list. answers: answer_id, question, text; sources: answer_id, n, title, year."""
    line = F.concat(F.col("n").cast("string"), F.lit(". "), "title", F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))
    held = sources.select("answer_id", F.struct("n", line.alias("line")).alias("s")).groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("lines"))
    joined = answers.join(held, "answer_id", "left")
    return joined.select("answer_id", F.concat(F.lit("# "), "question", F.lit("\n\n"), "text", F.coalesce(F.concat(F.lit("\n\n## Sources\n\n"), "lines"), F.lit("")), F.lit("\n")).alias("document"))


def hypotheses_csv(hypotheses: DataFrame) -> DataFrame:
    """value: hypotheses as lines of CSV, strings quoted where they need it. hypotheses: rank, statement, total."""
    return hypotheses.select("rank", F.to_csv(F.struct("rank", "statement", "total")).alias("value"))


def bulk_texts(texts: DataFrame, most: int = 150_000) -> DataFrame:
    """idx, path, text of parsed files by idx: texts of under LEAST_CHARS characters go, longer ones than `most` are cut. texts: idx, path, text."""
    return texts.where(F.length(F.trim("text")) >= LEAST_CHARS).select("idx", "path", F.substring("text", 1, most).alias("text"))


def iso_times(rows: DataFrame) -> DataFrame:
    """The same columns with dates and times as ISO 8601 texts, a time with its offset and with microseconds only if it has any."""

    def text_of(name: str, kind: str) -> Column:
        if kind == "date":
            return F.date_format(name, "yyyy-MM-dd")
        offset = F.date_format(name, "xxx") if kind == "timestamp" else F.lit("")
        micros = F.date_format(name, "SSSSSS")
        return F.concat(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), offset)

    return rows.select(*[text_of(c, kind).alias(c) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c, kind in rows.dtypes])
