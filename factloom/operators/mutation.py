"""Writes as pure functions of tables: replacing by provenance, upserts, and folding a log of edits."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.resolution import remap_edges, union_aliases


def changed_documents(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Incoming documents whose content is new or differs from what is stored under their id. Both: doc_id, content_hash."""
    return incoming.join(current.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def replace_by_provenance(current: DataFrame, incoming: DataFrame, documents: DataFrame, provenance: str = "source_doc_id") -> DataFrame:
    """current without the rows that documents (doc_id) brought, and with the incoming rows of these documents."""
    changed = documents.select(F.col("doc_id").alias(provenance)).distinct()
    return current.join(changed, provenance, "left_anti").select(*current.columns).unionByName(incoming.join(changed, provenance, "left_semi").select(*current.columns))


def _one_each(entities: DataFrame) -> DataFrame:
    """Entities with the least label and name of their rows and all their aliases."""
    every = F.array_sort(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))
    return entities.groupBy("entity_id").agg(F.min("label").alias("label"), F.min("name").alias("name"), F.array_distinct(every).alias("aliases"))


def upsert_entities(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities after a merge: present names win over incoming ones, aliases are united. Both: entity_id, label, name, aliases. An entity that comes in several rows is one."""
    a, b = current.alias("a"), _one_each(incoming).alias("b")
    joined = a.join(b, "entity_id", "full")
    return joined.select("entity_id", F.coalesce("a.label", "b.label").alias("label"), F.coalesce("a.name", "b.name").alias("name"), union_aliases(F.col("a.aliases"), F.col("b.aliases")).alias("aliases"))


def first_mentions(mentions: DataFrame) -> DataFrame:
    """One edge per entity and document, with its first chunk. mentions: entity_id, doc_id, chunk_idx, ord."""
    return mentions.groupBy("entity_id", "doc_id").agg(F.min(F.struct("chunk_idx", "ord"))["chunk_idx"].alias("chunk_idx"))


def fold_edits(base: DataFrame, edits: DataFrame) -> DataFrame:
    """key, value, deleted, edited_by, edited_at: rows after a log of set and delete, the last edit of each row counts.

    base: key, value. edits: key, op, value, edited_by, edited_at, seq. A delete only marks the row, and a later set
    brings it back.
    """
    last = edits.groupBy("key").agg(F.max_by(F.struct("op", "edited_by", "edited_at"), F.struct("edited_at", "seq")).alias("last"))
    sets = edits.where("op = 'set'").groupBy("key").agg(F.max_by("value", F.struct("edited_at", "seq")).alias("set_value"))
    joined = base.join(last, "key", "full").join(sets, "key", "left")
    return joined.select("key", F.coalesce("set_value", "value").alias("value"), F.coalesce(F.col("last.op") == "delete", F.lit(False)).alias("deleted"), F.col("last.edited_by").alias("edited_by"), F.col("last.edited_at").alias("edited_at"))


def supersede(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """claims with superseded_by from pairs (claim_id, superseded_by); of several claims that supersede one the greatest id counts."""
    return claims.drop("superseded_by").join(pairs.groupBy("claim_id").agg(F.max("superseded_by").alias("superseded_by")), "claim_id", "left")


def assert_unique(df: DataFrame, *key: str) -> None:
    """Refuses a table in which a key stands twice."""
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{', '.join(key)} is not unique: {twice[0].asDict()}")


@dataclass(frozen=True)
class Written:
    """Tables after a write, the documents that it changed (doc_id, content_hash), and table, reason and n_rows of the rows it did not take."""

    tables: dict[str, DataFrame]
    changed: DataFrame
    left_out: DataFrame


def write_documents(stored: dict[str, DataFrame], documents: DataFrame, tables: dict[str, DataFrame], provenance: str = "source_doc_id", of_changed: Collection[str] = ()) -> Written:
    """Replaces everything that documents (doc_id, content_hash) brought, in every stored table, by the rows of tables.

    stored and tables: by name, each with the provenance column, whose type is that of doc_id; stored["documents"] holds
    doc_id and content_hash of what was written before, and may be missing. Documents whose content is stored already are
    skipped with their rows (reason `unchanged`); rows of documents that are not written are not taken either (`unknown`).
    A changed document loses what it had in all stored tables, also in those that it brings no rows for. An id that stands
    twice is refused, as one of its contents would be lost. The tables named in of_changed were made from changed documents
    alone, so their rows are not compared with these once more.
    """
    assert_unique(documents, "doc_id")
    known = stored.get("documents", documents.select("doc_id", "content_hash").limit(0))
    changed = changed_documents(documents.select("doc_id", "content_hash"), known)
    out = {"documents": known.join(changed.select("doc_id"), "doc_id", "left_anti").select("doc_id", "content_hash").unionByName(changed)}
    left_out = []
    for name in sorted({*stored, *tables} - {"documents"}):
        held, incoming = stored.get(name), tables.get(name)
        held, incoming = (incoming.limit(0) if held is None else held), (held.limit(0) if incoming is None else incoming)
        if name in of_changed:
            out[name] = held.join(changed.select(F.col("doc_id").alias(provenance)), provenance, "left_anti").select(*held.columns).unionByName(incoming.select(*held.columns))
            continue
        out[name] = replace_by_provenance(held, incoming, changed, provenance)
        others = incoming.join(changed.select(F.col("doc_id").alias(provenance)), provenance, "left_anti")
        named = others.join(documents.select(F.col("doc_id").alias(provenance), F.lit("unchanged").alias("reason")), provenance, "left")
        left_out.append(named.groupBy(F.lit(name).alias("table"), F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n_rows")))
    nothing = documents.sparkSession.createDataFrame([], "table string, reason string, n_rows long")
    return Written(out, changed, reduce(DataFrame.unionByName, left_out, nothing))


def save_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Writes each table below folder, which must be new, and reads it back: what was read from stays as it is until the caller turns to the new folder."""
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    return {name: table.sparkSession.read.parquet(f"{folder}/{name}") for name, table in tables.items()}


def load_references(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Entities after loading curated ones: their aliases replace those stored, present names fill what they leave open. Both: entity_id, label, name, aliases."""
    a, b = current.alias("a"), _one_each(reference).alias("b")
    joined = a.join(b, "entity_id", "full")
    return joined.select("entity_id", F.coalesce("b.label", "a.label").alias("label"), F.coalesce("b.name", "a.name").alias("name"), F.coalesce("b.aliases", "a.aliases").alias("aliases"))


def edit_edges(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Edges after a log of add_edge, delete_edge and merge_nodes, with deleted and edited_by.

    edges: src_key, dst_key, rel_type. log: seq, op, a, b, rel_type, edited_by; merge_nodes moves the edges of b to a.
    Of the adds and deletes of one edge the last counts; a delete only marks it. Merges come after these, each node into
    the last survivor of its chain, and what they make equal, or a loop, goes.
    """
    own = log.where(F.col("op").isin("add_edge", "delete_edge")).groupBy(F.col("a").alias("src_key"), F.col("b").alias("dst_key"), "rel_type")
    last = own.agg(F.max_by(F.struct("op", "edited_by"), "seq").alias("last"), F.max(F.col("op") == "add_edge").alias("added"))
    joined = edges.select("src_key", "dst_key", "rel_type", F.lit(True).alias("there")).join(last, ["src_key", "dst_key", "rel_type"], "full")
    kept = joined.where(F.col("there") | F.col("added"))
    edited = kept.select("src_key", "dst_key", "rel_type", F.coalesce(F.col("last.op") == "delete_edge", F.lit(False)).alias("deleted"), F.col("last.edited_by").alias("edited_by"))
    merges = log.where("op = 'merge_nodes'").groupBy(F.col("b").alias("victim_id")).agg(F.max_by("a", "seq").alias("survivor_id"))
    return remap_edges(edited, merges)


def retype(facts: DataFrame, changes: DataFrame, by: str) -> DataFrame:
    """Facts after changing the kind of some (fact_id, rel_type): the old one is marked as deleted, a new one takes its place. Of several kinds for one fact the least counts."""
    new = facts.join(changes.groupBy("fact_id").agg(F.min("rel_type").alias("new_type")), "fact_id").where("rel_type != new_type AND NOT deleted")
    made = new.withColumns({"rel_type": F.col("new_type"), "fact_id": F.concat("fact_id", F.lit("~"), "new_type"), "edited_by": F.lit(by)}).select(*facts.columns)
    gone = new.select("fact_id").withColumn("gone", F.lit(True))
    old = facts.join(gone, "fact_id", "left").withColumns({"deleted": F.col("deleted") | F.coalesce("gone", F.lit(False)), "edited_by": F.when(F.col("gone"), F.lit(by)).otherwise(F.col("edited_by"))})
    return old.select(*facts.columns).unionByName(made)


def relation_columns(facts: DataFrame) -> DataFrame:
    """Facts as they are stored: values belong to conditions and products only."""
    numeric = F.col("rel_type").isin("HAS_CONDITION", "PRODUCES")
    return facts.withColumns({c: F.when(numeric, F.col(c)) for c in ("value_min", "value_max", "unit_canon", "value_text") if c in facts.columns})


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds n, from 1, by order within the whole of a small result."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
