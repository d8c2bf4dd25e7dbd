"""Operator 9: substring dedup by hashing lines and paragraphs.

Units are lines, and paragraphs (blocks of several lines between blank ones), of
at least LINE_WORDS words, which is one. A unit is normalised (A-Z lower-cased,
white space made single spaces) and hashed to 128 bits, so a paragraph is the
same however it is broken into lines. Digests are grouped over all documents;
the occurrence in the document of the least id, and there at the least offset,
is kept, and every later one goes.

A passage that was pasted into other lines is no line of its own. So the words
of the whole text are cut as well, after words whose CRC32 is a multiple of
CUT_EVERY, which falls on the same words wherever a passage stands, into pieces
of PIECE_MIN to PIECE_MAX words. Short pieces repeat by chance: they go only in
runs of repeats that follow each other and have at least RUN_WORDS words (0
leaves pieces out). Removed spans hold code points of the original text, so
what stays can be traced to where it stood.

Units are made in one pass and written to the shared folder. Only digests, ids
and offsets are shuffled. A digest with very many occurrences is aggregated
map-side first and then meets its occurrences by broadcast; a document's own
repeats never leave its row.

Defined results: a null text counts as empty and has no units; texts are taken
whole; ids are of any type that can be ordered; rows that share an id rank
equally, so that each keeps what the id is the earliest for; a null id ranks
last; an empty table gives an empty result; columns besides id and text are
only passed through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, fresh_path, join_by_key, map_documents
from factloom.shipping import ship

LINE_WORDS, RUN_WORDS = 1, 24
PIECE_MIN, PIECE_MAX, CUT_EVERY = 4, 16, 4

#: First word, word after the last, digest, and whether it is a line or paragraph.
Unit = tuple[int, int, bytes, bool]


def _cuts(words: list[bytes]) -> list[int]:
    """The ends of the pieces of a text, as numbers of words. What is left at its end and shorter than PIECE_MIN is in none."""
    marked = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % CUT_EVERY == 0
    out, at = [], 0
    for end in [*(np.flatnonzero(marked) + 1).tolist(), len(words)]:
        while end - at > PIECE_MAX:
            at += PIECE_MAX
            out.append(at)
        if end - at >= PIECE_MIN:
            at = end
            out.append(at)
    return out


def units(text: str, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> list[Unit]:
    """The units of a text: its lines and paragraphs, and its pieces that are neither."""
    lines = [len(x.split()) for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    joined = b" ".join(words)
    offsets = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64).tolist()
    places, at, begun, held = set(), 0, 0, 0
    for n in [*lines, 0]:
        if n >= line_words:
            places.add((at, at + n))
        if n:
            held += 1
        else:
            if held > 1 and at - begun >= line_words:
                places.add((begun, at))
            begun, held = at, 0
        at += n
        begun = begun if held else at
    whole = [(a, b, True) for a, b in sorted(places)]
    ends = _cuts(words) if run_words else []
    pieces = [(a, b, False) for a, b in zip([0, *ends], ends, strict=False) if (a, b) not in places]
    return [(a, b, xxhash.xxh3_128_digest(joined[offsets[a] : offsets[b] - 1]), w) for a, b, w in whole + pieces]


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


#: First word, word after the last, start, end, and whether it is a line or paragraph.
Repeat = tuple[int, int, int, int, bool]


def runs(repeats: list[Repeat], run_words: int = RUN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, number of units) of what goes: lines and paragraphs, and pieces in runs of at least run_words words."""

    def joined(spans: list[Repeat]) -> list[list[int]]:
        found: list[list[int]] = []
        for first, last, start, end, _ in sorted(spans):
            if found and first <= found[-1][1]:
                run = found[-1]
                run[1], run[3], run[4] = max(run[1], last), max(run[3], end), run[4] + 1
            else:
                found.append([first, last, start, end, 1])
        return found

    goes: list[list[int]] = []
    for run in joined(repeats):
        goes += [run] if run[1] - run[0] >= run_words else joined([x for x in repeats if x[4] and run[0] <= x[0] and x[1] <= run[1]])
    return [(start, end, n) for _, _, start, end, n in goes]


def _text_key(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def unit_rows(docs: DataFrame, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text -> one row per unit: place in words (first, n_words) and code points (start_at, n_chars); later: its own text has it before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, keys, places, digests, later = [], [], [np.zeros((5, 0), np.int64)], [], []
            for text in pdf["text"]:
                found = units(text, line_words, run_words)
                seen: set[bytes] = set()
                for _, _, digest, _ in found:
                    later.append(digest in seen)
                    seen.add(digest)
                digests += [x[2] for x in found]
                sizes.append(len(found))
                keys.append(_text_key(text))
                if found:
                    starts, ends = word_bounds(text)
                    first, last, whole = np.array([(x[0], x[1], x[3]) for x in found]).T
                    places.append(np.stack([first, last - first, starts[first], ends[last - 1] - starts[first], whole]))
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            first, n_words, start, n_chars, whole = np.concatenate(places, axis=1).astype(np.int32)
            ids = pdf["doc_id"].repeat(sizes).reset_index(drop=True)
            yield pd.DataFrame({"doc_id": ids, "text_key": np.repeat(np.array(keys, np.int64), sizes), "first": first, "n_words": n_words, "start_at": start, "n_chars": n_chars, "whole": whole.astype(bool), "d1": pairs[:, 0], "d2": pairs[:, 1], "later": later})

    return map_documents(docs, run, "text_key long, first int, n_words int, start_at int, n_chars int, whole boolean, d1 long, d2 long, later boolean")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """gone_id, gone_key, spans (array of places, see _place): the repeats in each document that has some."""
    ship(docs.sparkSession)
    path = fresh_path(docs.sparkSession, "units")
    unit_rows(_named(docs, id_col, text_col), line_words, run_words).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    firsts = rows.where("NOT later")
    shared = checkpoint(firsts.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"))
    # What is shuffled holds a place in two numbers.
    words = F.shiftleft(F.col("first").cast("long"), 32) + F.col("n_words") * 2 + F.col("whole").cast("int")
    place = F.struct(words.alias("words"), (F.shiftleft(F.col("start_at").cast("long"), 32) + F.col("n_chars")).alias("chars")).alias("place")
    packed = firsts.select("doc_id", "text_key", "d1", "d2", place)
    across = join_by_key(packed, shared, ["d1", "d2"], "n").where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    gone = across.select("doc_id", "text_key", "place").union(rows.where("later").select("doc_id", "text_key", place))
    # Rows of one id and text count once, so spans are a set; it holds no more than the units of one text.
    return gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.collect_set("place").alias("spans"))


def _place(words: int, chars: int) -> Repeat:
    first, start, low = words >> 32, chars >> 32, words & 0xFFFFFFFF
    return first, first + (low >> 1), start, start + (chars & 0xFFFFFFFF), bool(low & 1)


def _with_spans(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (doc_id, text_key, ...) with the spans of their repeats, null where they have none."""
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    return rows.join(gone, same, "left").drop("gone_id", "gone_key", "text_key")


def _runs(cell: object, run_words: int) -> list[tuple[int, int, int]]:
    return [] if cell is None else runs([_place(int(x["words"]), int(x["chars"])) for x in cell], run_words)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_chars, n_removed (units), removed_chars and removed_spans (start:end, comma-joined) of each row."""
    gone = repeated_units(docs, id_col, text_col, line_words, run_words)
    named = _named(docs, id_col, text_col)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": [_text_key(x) for x in pdf["text"]], "n_chars": [len(x) for x in pdf["text"]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_runs(x, run_words) for x in pdf["spans"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": pdf["n_chars"], "n_removed": [sum(n for *_, n in x) for x in found], "removed_chars": [sum(b - a for a, b, _ in x) for x in found], "removed_spans": [",".join(f"{a}:{b}" for a, b, _ in x) for x in found]})

    rows = _with_spans(map_documents(named, measure, "text_key long, n_chars long"), gone)
    return map_documents(rows, run, "n_chars long, n_removed long, removed_chars long, removed_spans string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text (what stays) and spans (array of start, end: where it stood in the original) of each row."""
    gone = repeated_units(docs, id_col, text_col, line_words, run_words)
    named = _named(docs, id_col, text_col)

    def add_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text_key=[_text_key(x) for x in pdf["text"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, stays = [], []
            for text, cell in zip(pdf["text"], pdf["spans"], strict=True):
                at, kept = 0, []
                for a, b, _ in [*_runs(cell, run_words), (len(text), len(text), 0)]:
                    if a > at:
                        kept.append({"start_at": at, "end_at": a})
                    at = b
                texts.append("".join(text[x["start_at"] : x["end_at"]] for x in kept))
                stays.append(kept)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "spans": stays})

    rows = _with_spans(map_documents(named, add_key, "text string, text_key long"), gone)
    return map_documents(rows, run, "text string, spans array<struct<start_at: int, end_at: int>>")
