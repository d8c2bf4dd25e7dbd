"""Operator 13: importance resampling towards a target by hashed word n-grams.

A text's features are its runs of 1 to `longest` words, joined by one space,
each in the bucket of its CRC-32. Word places are found on whole blocks of
bytes, and each word's CRC is computed once, side by side with all others of
its block. The CRC of a longer run follows from those of its parts: appending n
bytes multiplies a CRC by the n-th power of a 32 x 32 matrix over GF(2), after
which the part's own CRC is added. These powers are kept as tables of four
bytes by 256 values for each n below 64; longer words go by the powers of two
of 64. No run of words is ever put together as a string.

Two passes over the texts: each task of the first adds up its buckets before
anything is shuffled, and the second weighs every text with the buckets' gains,
of which there are as many as buckets. The draw is Gumbel top-k: scores are
whole numbers, so ranks follow from the number of rows of each score, and only
rows of one score are sorted together.

Defined results: a null text has no words, and weight 0; a null id is written
as "null" in the digest and is the last of equal scores; rows that share an id
are scored by their own texts, and equal rows are drawn as often as they fit;
with no document of `min_words` words nothing is drawn; empty tables give an
empty result, or gains by the other table alone; texts of any length are read
in blocks; columns besides id and text are only passed through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, broadcast_if_small, checkpoint, each_copy, map_documents
from factloom.llm.exact_dedup import keep_rows
from factloom.shipping import ship

BUCKETS, LONGEST, PERCENT, MIN_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Bytes of text whose words are found and hashed together.
BLOCK_BYTES = 1 << 19
#: Lengths below this have a table of their own; words of this many bytes or more are hashed one by one.
DIRECT = 64
#: The scores of one step of the coarse count; a range of scores of this width is summed up by one task.
SCORE_STEP = 256

_NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_IN_WORD = np.ones(256, bool)
_IN_WORD[:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False


def _byte_table() -> np.ndarray:
    """What a CRC's low byte adds when the CRC moves on by one byte."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


_STEP = _byte_table()


def _as_tables(columns: np.ndarray) -> np.ndarray:
    """A matrix, given by what it makes of each bit, as tables of what it makes of each byte at each of four places."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] ^ columns.reshape(4, 8)[:, bit, None]
    return out


def _times(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _powers() -> tuple[np.ndarray, list[np.ndarray]]:
    """The tables of a shift by each length below DIRECT, and by DIRECT times each power of two."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = _STEP[bits & 255] ^ (bits >> 8)
    columns, direct = bits, []
    for _ in range(DIRECT):
        direct.append(_as_tables(columns))
        columns = _times(_as_tables(one), columns)
    doubled = []
    for _ in range(32):
        doubled.append(_as_tables(columns))
        columns = _times(doubled[-1], columns)
    return np.stack(direct), doubled


_SHORT, _LONG = _powers()


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC times the matrix of its n appended bytes: crc32(a + b) is shift(crc32(a), len(b)) ^ crc32(b)."""
    rest = n & (DIRECT - 1)
    out = _SHORT[rest, 0, crc & 255] ^ _SHORT[rest, 1, (crc >> 8) & 255] ^ _SHORT[rest, 2, (crc >> 16) & 255] ^ _SHORT[rest, 3, crc >> 24]
    whole = n // DIRECT
    for tables in _LONG:
        if not whole.any():
            break
        odd = np.flatnonzero(whole & 1)
        out[odd] = _times(tables, out[odd])
        whole = whole >> 1
    return out


def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Numbered texts by blocks of some BLOCK_BYTES; a longer text is cut between words."""
    block, held = [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            cut = None if len(text) - at <= BLOCK_BYTES else _NO_WORD.search(text, at + BLOCK_BYTES)
            part = text[at : cut.end()] if cut else text[at:]
            block.append((k, part))
            held += len(part)
            if held >= BLOCK_BYTES:
                yield block
                block, held = [], 0
            if not cut:
                break
            at = cut.end()
    if block:
        yield block


def _words(block: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, the CRC and the length in bytes of each word of a block, in order."""
    whole = b"\n".join(part for _, part in block) + b"\n"
    buffer = np.frombuffer(whole, np.uint8)
    edge = np.flatnonzero(np.diff(_IN_WORD[buffer], prepend=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    first = np.cumsum([0] + [len(part) + 1 for _, part in block[:-1]])
    text = np.array([k for k, _ in block])[np.searchsorted(first, start, "right") - 1]
    order = np.argsort(-length, kind="stable")
    longest_first, state = length[order], np.full(len(start), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(-longest_first, -DIRECT, "right"))
    places = start[order]
    for k in range(int(longest_first[n_long]) if n_long < len(order) else 0):
        upto = int(np.searchsorted(-longest_first, -k, "left"))
        crc = state[n_long:upto]
        state[n_long:upto] = _STEP[(crc ^ buffer[places[n_long:upto] + k]) & 255] ^ (crc >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(n_long):
        state[k] = zlib.crc32(whole[places[k] : places[k] + longest_first[k]])
    crc = np.empty_like(state)
    crc[order] = state
    return text, crc, length


_SPACE = np.uint32(zlib.crc32(b" "))


def features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks: the text of each word, and the text and the bucket of each feature. texts are lower-cased bytes."""
    kept = (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for block in _blocks(texts):
        new = _words(block)
        n_old = len(kept[0])
        text, crc, length = (np.concatenate(x) for x in zip(kept, new, strict=True))
        # A word after a space, of which a run is lengthened.
        spaced = shift(np.full(len(crc), _SPACE), length) ^ crc
        of, found = [new[0]], [new[1] % np.uint32(buckets)]
        run, end = crc, np.arange(len(crc))
        for n in range(2, longest + 1):
            # run holds the CRC of the n - 1 words that end at each place of end.
            end = end[end + 1 < len(crc)] + 1
            same = text[end] == text[end - n + 1]
            run = run[: len(end)][same]
            end = end[same]
            run = shift(run, length[end] + 1) ^ spaced[end]
            fresh = end >= n_old
            of.append(text[end[fresh]])
            found.append(run[fresh] % np.uint32(buckets))
        yield new[0], np.concatenate(of), np.concatenate(found)
        at = max(0, len(text) - longest + 1)
        kept = (text[at:], crc[at:], length[at:])


def _lowered(texts: pd.Series) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass").lower() for x in texts.fillna("")]  # of bytes: A-Z only


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts each bucket holds. A task sends one row for each bucket at most."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for _, _, found in features(_lowered(pdf["text"]), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds: the floored 1000 times logarithm of its smoothed share in target over that in docs."""

    def counted(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in bucket_counts(df, longest=longest, buckets=buckets).collect():  # at most one row for each bucket
            out[r["bucket"]] = r["n"]
        return out

    s, t = counted(docs), counted(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))))


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, text_sha256 (of the lower-cased text), n_words, n_features, weight and score of each row."""
    ship(docs.sparkSession)
    buckets = len(gains)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, n, total = (np.zeros(len(pdf)) for _ in range(3))
            for text, of, found in features(_lowered(pdf["text"]), longest, buckets):
                words += np.bincount(text, minlength=len(pdf))
                n += np.bincount(of, minlength=len(pdf))
                total += np.bincount(of, gains[found], len(pdf))  # of whole numbers, so exact below 2^53
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_sha256": pdf["sha"], "n_words": words.astype(np.int64), "n_features": n.astype(np.int64), "weight": weight.astype(np.int64)})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(ascii_lower(text), 256).alias("sha"))
    weighed = map_documents(rows, run, "text_sha256 string, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of weighed with rank: 1, 2, 3 and so on from the highest score for the drawn ones, else null.

    weighed is read more than once, so it should be a checkpoint or a written table.
    """
    eligible = F.col("n_words") >= min_words
    columns = weighed.columns
    units = checkpoint(weighed.where(eligible).groupBy(*columns).agg(F.count("*").alias("n")))
    per_score = units.groupBy("score").agg(F.sum("n").alias("n")).withColumn("step", F.floor(F.col("score") / SCORE_STEP))
    # Scores are logarithms in thousandths, so there are some tens of thousands of them, and some hundreds of steps.
    higher_steps = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = per_score.groupBy("step").agg(F.sum("n").alias("n")).select("step", F.coalesce(F.sum("n").over(higher_steps), F.lit(0)).alias("above"))
    higher = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_score.join(broadcast_if_small(checkpoint(steps)), "step").select("score", (F.col("above") + F.coalesce(F.sum("n").over(higher), F.lit(0))).alias("offset"))
    wanted = percent * (units.agg(F.sum("n")).first()[0] or 0) // 100
    reached = checkpoint(offsets.where(F.col("offset") < wanted))
    placed = units.join(broadcast_if_small(reached), "score", "left")
    before = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in columns if c not in ("doc_id", "score")]).rowsBetween(Window.unboundedPreceding, -1)
    candidates = placed.where("offset IS NOT NULL").withColumn("offset", F.col("offset") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = each_copy(candidates, "n", "copy").withColumn("rank", F.col("offset") + F.col("copy") + 1)
    drawn = ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    others = each_copy(placed.where("offset IS NULL"), "n", "copy").select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(others).unionByName(weighed.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def rank_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """weigh and draw in one: of docs towards target (text), a row for each document, with text_sha256 and rank."""
    gains = bucket_gains(docs.select(F.col(text_col).alias("text")), target.select("text"), longest, buckets)
    return draw(checkpoint(weigh(docs, gains, id_col, text_col, longest, seed)), percent, min_words)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of docs, with all their columns."""
    drawn = rank_documents(docs, target, id_col, text_col, **options).where("rank IS NOT NULL")
    return keep_rows(docs, drawn, id_col, text_col)


SQL = r"""
WITH byte_step AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS step
  FROM (SELECT unnest(range(256)) AS b)),
texts AS (SELECT doc_id, 0 AS target, coalesce(text, '') AS text FROM documents UNION ALL SELECT NULL, 1, coalesce(text, '') FROM benchmark),
worded AS (
  SELECT doc_id, target, row_number() OVER () AS row_no,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
features AS (
  SELECT row_no, target, unnest(words) AS feature FROM worded
  UNION ALL
  SELECT row_no, target, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM worded),
hashed AS (
  SELECT feature, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                                  lambda c, b: xor(c // 256, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM features), byte_step),
placed AS (SELECT row_no, target, bucket FROM features JOIN hashed USING (feature)),
totals AS (SELECT CAST(count(*) FILTER (WHERE target = 0) AS DOUBLE) AS s_all, CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE) AS t_all FROM placed),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS gain
  FROM (SELECT bucket, CAST(count(*) FILTER (WHERE target = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE) AS t FROM placed GROUP BY bucket), totals),
weights AS (SELECT row_no, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight, count(*) AS n_features FROM placed JOIN gains USING (bucket) WHERE target = 0 GROUP BY row_no),
scored AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), 'null')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM worded w LEFT JOIN weights USING (row_no) WHERE w.target = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank, n_words FROM ranked
"""
