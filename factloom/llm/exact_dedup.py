"""Operator 7: exact dedup by composable polynomial fingerprints.

A text, with A-Z lower-cased, is a string of UTF-8 bytes cut into chunks. A
chunk's fingerprint is its polynomial in four fixed bases modulo four primes
below 2^31, so 124 bits. The fingerprint of two parts in a row is the first's,
shifted by the base to the power of the second's length, plus the second's: the
chunks of all texts of a batch are hashed side by side, and each text's are
then combined, whatever its length.

Rows of equal fingerprints and lengths form a group. The texts of the groups
with two rows or more are then compared chunk by chunk: sorted by group and
chunk, the least and the greatest chunk at each place must be the same bytes.
Map-side aggregation leaves one row per group, chunk and map task, so copies by
the million meet in small numbers. If a group fails, its rows are told apart by
the SHA-256 of their texts. The rows of a very large group get its result by
broadcast, so they never meet in one task.

Defined results: a null text counts as empty, and all empty texts are equal; of
equal texts the row of the largest id stays (a null id is the smallest); of
rows that share this id too, exactly one stays; an empty table gives an empty
result; columns besides id and text are only passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, checkpoint, column_name, join_by_key, map_documents
from factloom.shipping import ship

#: The four largest primes below 2^31, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003331, 1103515249, 1220703133, 1566083943)
CHUNK_BYTES = 16_384
#: Bytes of text whose chunks are hashed together.
BLOCK_BYTES = 250_000
#: Parts of the map tasks whose chunks at one place are compared first.
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """For each prime, its base to the powers from 0 to CHUNK_BYTES."""
    if not _POWERS:
        for base, prime in zip(BASES, PRIMES, strict=True):
            row, x = [], 1
            for _ in range(CHUNK_BYTES + 1):
                row.append(x)
                x = x * base % prime
            _POWERS.append(np.array(row, np.uint64))
    return _POWERS


def combine(first: tuple[int, ...], second: tuple[int, ...], second_bytes: int) -> tuple[int, ...]:
    """The fingerprint of two parts in a row, from theirs and the second's length."""
    return tuple((a * pow(base, second_bytes, prime) + b) % prime for a, b, base, prime in zip(first, second, BASES, PRIMES, strict=True))


def fingerprints(texts: list[bytes]) -> list[tuple[int, ...]]:
    """The fingerprint of each string of bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chunks = np.maximum(-(-sizes // CHUNK_BYTES), 1)
    if not sizes.sum():
        return [(0,) * len(PRIMES)] * len(texts)
    buffer = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    # Every chunk's first byte in the buffer and its length.
    place = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = np.repeat(np.cumsum(sizes) - sizes, chunks) + place * CHUNK_BYTES
    length = np.minimum(np.repeat(sizes, chunks) - place * CHUNK_BYTES, CHUNK_BYTES)
    full = np.flatnonzero(length > 0)
    power = np.repeat(length[full], length[full]) - 1 - (np.arange(len(buffer)) - np.repeat(start[full], length[full]))
    hashed = np.zeros((len(PRIMES), len(start)), np.uint64)
    for k, (row, prime) in enumerate(zip(_powers(), PRIMES, strict=True)):
        # A byte times a power is below 2^39, so a chunk's sum is below 2^53.
        hashed[k, full] = np.add.reduceat(buffer * row[power], start[full]) % np.uint64(prime)
    parts, out, at = hashed.T.tolist(), [], 0
    lengths = length.tolist()
    for n in chunks.tolist():
        whole = tuple(parts[at])
        for k in range(at + 1, at + n):
            whole = combine(whole, tuple(parts[k]), lengths[k])
        out.append(whole)
        at += n
    return out


def _named(text: bytes, print_: tuple[int, ...]) -> str:
    return "".join(f"{x:08x}" for x in print_) + f"-{len(text):x}"


def _normalised(texts: pd.Series) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass").lower() for x in texts.fillna("")]  # of bytes: A-Z only


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    block, held = [], 0
    for text in texts:
        block.append(text)
        held += len(text)
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    yield block


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print and text_sha256 of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = _normalised(pdf["text"])
            prints = [_named(t, p) for block in _blocks(texts) for t, p in zip(block, fingerprints(block), strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "print": prints, "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})

    rows = _rows(docs, id_col, text_col)
    return map_documents(rows, run, "print string, text_sha256 string")


def _chunks(docs: DataFrame) -> DataFrame:
    """print, place and chunk: the normalised texts in chunks, under fingerprints made anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in _blocks(_normalised(pdf["text"])):
                names = [_named(t, p) for t, p in zip(block, fingerprints(block), strict=True)]
                yield pd.DataFrame(
                    [(name, at // CHUNK_BYTES, t[at : at + CHUNK_BYTES]) for name, t in zip(names, block, strict=True) for at in range(0, max(1, len(t)), CHUNK_BYTES)],
                    columns=["print", "place", "chunk"],
                )

    return docs.select("text").mapInPandas(run, "print string, place long, chunk binary")


def different_under_one_print(docs: DataFrame, suspects: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints that hold different texts, by comparing the texts of suspects (doc_id) chunk by chunk."""
    held = suspects.select(F.col("doc_id").alias("suspect")).distinct()
    texts = _rows(docs, id_col, text_col).join(held.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")
    # In two steps, as of a very large group every map task sends a chunk: first within one of SALTS parts of the tasks.
    parts = _chunks(texts).withColumn("salt", F.spark_partition_id() % SALTS)
    some = parts.groupBy("print", "place", "salt").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    places = some.groupBy("print", "place").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return places.where(F.col("least") != F.col("greatest")).select("print").distinct()


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (print, doc_id, text_sha256, copies) without repeats, and of each print keep_id and group_size."""
    once = checkpoint(rows.groupBy("print", "doc_id", "text_sha256").agg(F.sum("copies").alias("copies")))
    return once, checkpoint(once.groupBy("print").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))


def group_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    once, keep = _grouped(fingerprint_rows(docs, id_col, text_col).withColumn("copies", F.lit(1).cast("long")))
    suspects = join_by_key(once, keep.where("group_size > 1"), ["print"], "group_size")
    wrong = checkpoint(different_under_one_print(docs, suspects, id_col, text_col))
    if not wrong.isEmpty():
        apart = wrong.withColumn("apart", F.lit(True))
        named = F.when(F.col("apart"), F.concat("print", F.lit("-"), "text_sha256")).otherwise(F.col("print"))
        once, keep = _grouped(once.join(apart, "print", "left").withColumn("print", named).drop("apart"))
    # Of rows that share the id that stays, all but one are to go; they are one row again and again.
    joined = join_by_key(once, keep, ["print"], "group_size").withColumn("keeper", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    every = joined.select("doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "keeper", "text_sha256")
    return every.select("doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return keep_rows(docs, group_equal(docs, id_col, text_col).where("kept"), id_col, text_col)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id and normalised text are in kept (doc_id, text_sha256), as often as they are there."""
    id_name, sha_name, n_name, nth_name = (column_name(docs, f"factloom_{x}") for x in ("id", "sha", "n", "nth"))
    kept = checkpoint(kept.groupBy(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(sha_name)).agg(F.count("*").alias(n_name)))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    found = docs.join(kept.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(id_name)) & (sha == F.col(sha_name)))
    # Where rows share id and text, so many of them stay as kept says; without such rows this costs nothing.
    if docs_repeat(docs, id_col):
        nth = Window.partitionBy(id_name, sha_name).orderBy(F.lit(0))
        found = found.withColumn(nth_name, F.row_number().over(nth)).where(F.col(nth_name) <= F.col(n_name)).drop(nth_name)
    return found.drop(id_name, sha_name, n_name)


def docs_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether rows share an id; reads the id column only."""
    return not docs.groupBy(id_col).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()


SQL = r"""
WITH rows AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256)
"""
