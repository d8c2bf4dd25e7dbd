"""One import, from files to tables: parse, drop repeated contents, chunk, find names, canonise, write, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factloom.functions.chunking import chunk_documents
from factloom.operators.mutation import first_mentions, save_tables, write_documents
from factloom.operators.names import find_names
from factloom.shipping import fresh_folder
from factloom.sources.files import first_of_each_content, parse_documents, read_corpus

#: What a table of documents holds besides doc_id and content_hash.
FIELDS = ("source_path", "title", "doc_type", "lang", "year", "authority", "access_level")

#: Ids of documents that are not to be imported up to which every task gets them.
SENT_ROWS = 500_000


@dataclass(frozen=True)
class Imported:
    """The stored tables after an import (documents, sources, chunks, mentions), and measure and n of its report."""

    tables: dict[str, DataFrame]
    report: DataFrame


def import_corpus(spark: SparkSession, root: str, dictionary: DataFrame, stored: dict[str, DataFrame] | None = None) -> Imported:
    """Imports all text files below root into stored tables, those of an earlier import, or new ones.

    dictionary: entity_id, type, name. A document is known by its path; of files of one content the first is imported.
    A file whose content is stored already is skipped, one that changed loses its chunks and mentions and gets new ones.
    Each step is written before the next reads it; the files' names and digests, not their texts, are compared with
    what is stored.
    """
    stored = stored or {}
    work = fresh_folder(spark, "import")
    corpus = read_corpus(spark, root)
    # Files are counted while they are parsed: to open each once more takes as long.
    files = Observation()
    parsed = parse_documents(corpus.observe(files, F.count(F.lit(1)).alias("n"))).withColumn("doc_id", F.substring(F.sha2("source_path", 256), 1, 16))
    parsed.write.option("compression", "zstd").parquet(f"{work}/parsed")
    parsed = spark.read.parquet(f"{work}/parsed")
    # The first of each content is chosen among digests, once; texts follow by their document.
    first_of_each_content(parsed.drop("text")).write.parquet(f"{work}/documents")
    docs = spark.read.parquet(f"{work}/documents")
    known = stored["documents"].select("doc_id", "content_hash") if "documents" in stored else docs.select("doc_id", "content_hash").limit(0)
    fresh = docs.join(known, ["doc_id", "content_hash"], "left_anti").select("doc_id")
    # Copies and what is stored are mostly few: then these are sent, else the texts are shuffled.
    texts, others = parsed.select("doc_id", "text"), parsed.select("doc_id").join(fresh, "doc_id", "left_anti")
    few = others.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    made = chunk_documents(texts.join(F.broadcast(others), "doc_id", "left_anti") if few else texts.join(fresh, "doc_id", "left_semi"))
    made.select(F.col("doc_id").alias("source_doc_id"), F.concat_ws("#", "doc_id", "idx").alias("chunk_id"), "idx", "text").write.option("compression", "zstd").parquet(f"{work}/chunks")
    chunks = spark.read.parquet(f"{work}/chunks")
    found = find_names(chunks.select("chunk_id", "text"), dictionary).join(chunks.select("chunk_id", "source_doc_id", "idx"), "chunk_id")
    mentions = first_mentions(found.select("entity_id", F.col("source_doc_id").alias("doc_id"), F.col("idx").alias("chunk_idx"), F.col("start_at").alias("ord")))
    written = write_documents(stored, docs.select("doc_id", "content_hash"), {
        "sources": docs.select(F.col("doc_id").alias("source_doc_id"), *FIELDS), "chunks": chunks,
        "mentions": mentions.select(F.col("doc_id").alias("source_doc_id"), "entity_id", "chunk_idx"),
    }, of_changed=("chunks", "mentions"))
    # The chunks of a first import are a table already.
    tables = save_tables({k: x for k, x in written.tables.items() if k != "chunks" or k in stored}, f"{work}/tables")
    tables.setdefault("chunks", chunks)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    new = chunks.select("source_doc_id").distinct()
    parts = [spark.createDataFrame([("files", files.get["n"])], "measure string, n long"), count(parsed, "parsed"), count(docs, "contents"), count(new, "written"), count(tables["chunks"], "stored chunks"), count(tables["mentions"], "stored mentions")]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return Imported(tables, report)
