"""Operator 6: SimHash near-dedup with anchor points from a covering code.

Of two 64-bit fingerprints that differ in at most 3 bits, one half of 32 bits
differs in at most 1. For each half, the anchors are the words of the Hamming
code of length 31 on its first 31 bits: every 31-bit word is within 1 of
exactly one of them (covering radius 1). A fingerprint is replicated to all
anchors within radius plus threshold, 1 + 1 = 2, of its half: to 1 anchor if it
is itself one, else to 16. The anchor next to one of the two is then within 2
of the other, so they meet there, and are compared on all 64 bits.

Equal fingerprints are one class before that. An anchor's class members are
compared in numpy, in blocks, and give links that connect what is connected
there; pairs are not emitted. An anchor with more members than a task should
hold is refined: its members differ in at most 3 bits of the other half, so one
of that half's 4 bytes is equal, and they meet under one of those bytes. What
is still too large is cut into blocks, and each pair of blocks is a task.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; a text of one or two words has its
words as its only shingle; texts are taken whole; repeated rows each get their
component; a null id gets a component of its fingerprint's class, or null if
that class has no id; columns besides id and text are only passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, join_by_key, map_documents
from factloom.llm.components import components
from factloom.llm.exact_dedup import keep_rows
from factloom.shipping import ship

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Members of an anchor that are compared in one task; larger anchors are refined and cut into blocks.
ANCHOR_ROWS = 4096
#: Shingles whose bits are counted together.
BLOCK_SHINGLES = 65_536


def fingerprint(text: str) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of its shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK_SHINGLES):
        block = np.array(hashes[at : at + BLOCK_SHINGLES], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_sha256 (of the lower-cased text) of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            prints = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
            sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass").lower()).hexdigest() for x in texts]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": prints, "text_sha256": sha})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_documents(rows, run, "fp long, text_sha256 string")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Of 31-bit words (bit k stands at place k + 1): 0 for a code word, else the place of the bit that leads to one."""
    out = np.zeros(words.shape, np.uint64)
    for k in range(31):
        out ^= ((words >> np.uint64(k)) & np.uint64(1)) * np.uint64(k + 1)
    return out


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of halves, anchor) for every anchor within 2 of the first 31 bits of 32-bit halves."""
    words = halves & np.uint64(0x7FFFFFFF)
    off = _syndrome(words)
    index = [np.arange(len(words))]
    found = [np.where(off > 0, words ^ (np.uint64(1) << (np.maximum(off, np.uint64(1)) - np.uint64(1))), words)]
    # Two flipped bits a and b lead to a code word where a ^ b is the syndrome.
    for a in range(1, 32):
        b = off ^ np.uint64(a)
        at = np.flatnonzero((off > 0) & (b > a))
        index.append(at)
        found.append(words[at] ^ (np.uint64(1) << np.uint64(a - 1)) ^ (np.uint64(1) << (b[at] - np.uint64(1))))
    return np.concatenate(index), np.concatenate(found)


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        for half in (0, 1):
            index, anchor = anchors((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
            key = anchor.view(np.int64) | (half << 32)
            yield pd.DataFrame({"anchor": key, "fp": pdf["fp"].to_numpy()[index]})


def connect(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within fps that connect what pairs at most THRESHOLD bits apart connect: at most one fewer than members."""
    fps = np.unique(fps)
    waiting = np.ones(len(fps), bool)
    left, right = [], []
    for seed in range(len(fps)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        front = np.array([seed])
        while len(front):  # breadth first: whatever waits and is close to the front joins it
            rest = np.flatnonzero(waiting)
            if not len(rest):
                break
            reached = []
            step = max(1, 2_000_000 // len(rest))
            for at in range(0, len(front), step):
                part = front[at : at + step]
                close = np.bitwise_count(fps[part][:, None] ^ fps[rest][None, :]) <= THRESHOLD
                hit = close.any(axis=0)
                left.append(fps[part][close[:, hit].argmax(axis=0)])
                right.append(fps[rest[hit]])
                reached.append(rest[hit])
                rest = rest[~hit]
                if not len(rest):
                    break
            front = np.concatenate(reached)
            waiting[front] = False
        if not waiting.any():
            break
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _frame(left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": left.astype(np.uint64).view(np.int64), "v": right.astype(np.uint64).view(np.int64)})


def _compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return _frame(*connect(pdf["fp"].to_numpy().view(np.uint64)))


def _compare_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by anchor: each anchor's links. An anchor may run over batches; it holds at most ANCHOR_ROWS rows."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf["anchor"].iloc[-1]
        held = pdf[pdf["anchor"] == last]
        yield _links_of(pdf[pdf["anchor"] != last])
    if held is not None and len(held):
        yield _links_of(held)


def _links_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of many anchors: small ones by comparing neighbours at growing distances, the rest one by one."""
    anchor, fps = pdf["anchor"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
    bounds = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(bounds, len(anchor)))
    group = np.repeat(sizes, sizes)
    left, right = [], []
    small = 16
    for gap in range(1, min(small, int(sizes.max(initial=0)))):
        near = (anchor[gap:] == anchor[:-gap]) & (group[gap:] <= small)
        close = near & (np.bitwise_count(fps[gap:] ^ fps[:-gap]) <= THRESHOLD)
        left.append(fps[:-gap][close])
        right.append(fps[gap:][close])
    for at, n in zip(bounds[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        a, b = connect(fps[at : at + n])
        left.append(a)
        right.append(b)
    empty = np.zeros(0, np.uint64)
    return _frame(np.concatenate([empty, *left]), np.concatenate([empty, *right]))


def _compare_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of an anchor that is still too large: links within each and between them, as a path may go to and fro."""
    return _frame(*connect(pdf["fp"].to_numpy().view(np.uint64)))


def _hot_links(hot: DataFrame) -> DataFrame:
    """anchor, fp of anchors with many members -> links, by the other half's bytes and, beyond that, by pairs of blocks."""
    other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(0xFFFFFFFF)
    byte = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(other, 8 * k).bitwiseAND(255).alias("b")) for k in range(4)]))
    refined = hot.select("anchor", "fp", byte.alias("byte")).select("anchor", F.col("byte.k").alias("k"), F.col("byte.b").alias("b"), "fp")
    counted = checkpoint(refined.groupBy("anchor", "k", "b").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int")))
    small = refined.join(counted.where("blocks = 1").select("anchor", "k", "b"), ["anchor", "k", "b"])
    links = small.groupBy("anchor", "k", "b").applyInPandas(_compare, "u long, v long")
    if counted.where("blocks > 1").isEmpty():
        return links
    large = refined.join(counted.where("blocks > 1").select("anchor", "k", "b", "blocks"), ["anchor", "k", "b"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))
    pairs = F.explode(F.transform(others, lambda x: F.struct(F.least(x, F.col("block")).alias("low"), F.greatest(x, F.col("block")).alias("high"))))
    paired = large.withColumn("block", own).withColumn("pair", pairs).select("anchor", "k", "b", "fp", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"))
    return links.union(paired.groupBy("anchor", "k", "b", "low", "high").applyInPandas(_compare_blocks, "u long, v long"))


def links(prints: DataFrame) -> DataFrame:
    """fp (distinct) -> u, v: links that connect what fingerprints at most THRESHOLD bits apart connect."""
    ship(prints.sparkSession)
    replicas = prints.select("fp").mapInPandas(_replicate, "anchor long, fp long")
    # Most anchors have one member: they go before anything is sorted.
    sizes = checkpoint(replicas.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    met = replicas.join(sizes.where(F.col("n") <= ANCHOR_ROWS).select("anchor"), "anchor", "left_semi")
    found = met.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInPandas(_compare_sorted, "u long, v long")
    hot = sizes.where(F.col("n") > ANCHOR_ROWS).select("anchor")
    if not hot.isEmpty():
        found = found.union(_hot_links(replicas.join(hot, "anchor", "left_semi")))
    return found.distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprinted rows of docs; and of each fingerprint fp its number of rows n, its first row (known ids first), and its root.

    A root stands for one component.
    """
    rows = checkpoint(fingerprint_rows(docs, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_sha256"))
    classes = checkpoint(rows.groupBy("fp").agg(F.count("*").alias("n"), first.alias("first")))
    found = components(links(classes))
    return rows, checkpoint(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id and text_sha256 of each row."""
    rows, rooted = _rooted(docs, id_col, text_col)
    roots = checkpoint(rooted.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"), F.count("*").alias("prints")))
    by_print = checkpoint(join_by_key(rooted, roots, ["root"], "prints").select("fp", "n", "component_id"))
    out = join_by_key(rows, by_print, ["fp"], "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_sha256")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the one of the least id, null ids last, and there of the least text_sha256."""
    kept = _rooted(docs, id_col, text_col)[1].groupBy("root").agg(F.min("first").alias("kept")).select("kept.doc_id", "kept.text_sha256")
    return keep_rows(docs, kept, id_col, text_col)
