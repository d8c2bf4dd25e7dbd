"""Operator 1: byte-level BPE encoding and decoding on padded numpy matrices.

A text is split by the vocabulary's pattern. A piece that is itself a token is
taken whole. The other pieces become rows of matrices, one matrix per range of
lengths, which hold token ids (at first one per byte) and are padded with -1.
Each round looks every adjacent pair up in a hash table, and every row merges
its leftmost pair of the lowest rank; rows without a pair leave the matrix and
the columns that no row needs are cut off. Rows of over LONG_ROW bytes are
merged in the same order by a heap, one by one.

Defined results: a null text counts as empty; an empty text has no tokens;
texts of any length are encoded whole; equal rows give equal results; columns
besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_documents
from factloom.shipping import ship

#: Pieces whose ids a task remembers; beyond it the memory starts anew. Longer pieces than MEMO_CHARS are forgotten after their block.
MEMO_PIECES, MEMO_CHARS = 150_000, 256
#: Rows longer than this are merged one by one, as a matrix takes a round over all of a row for each merge.
LONG_ROW = 256
#: Cells of a matrix at most; longer inputs are taken in blocks of rows.
MATRIX_CELLS = 2_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file with a base64 token and its rank on each line."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class PairTable:
    """Open addressing over (left id, right id): the id of the concatenation, which is also its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, _NONE, np.int32)
        slot = self._slots(keys)
        waiting = np.arange(len(keys))
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = waiting[self.keys[slot[waiting]] == np.uint64(2**64 - 1)]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]] = keys[first]
            self.values[slot[first]] = merged[first]
            waiting = waiting[self.keys[slot[waiting]] != keys[waiting]]
            slot[waiting] = (slot[waiting] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, _NONE where a pair has none. A padding id (-1) has no pair."""
        keys = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        flat = keys.ravel()
        slot = self._slots(flat)
        found = np.where(self.keys[slot] == flat, self.values[slot], _NONE)
        going = np.flatnonzero((self.keys[slot] != flat) & (self.keys[slot] != np.uint64(2**64 - 1)))
        while len(going):
            slot[going] = (slot[going] + 1) & self.mask
            at = self.keys[slot[going]]
            hit = at == flat[going]
            found[going[hit]] = self.values[slot[going[hit]]]
            going = going[~hit & (at != np.uint64(2**64 - 1))]
        return found.reshape(keys.shape)


class BytePairCodec:
    """Encodes and decodes as the tiktoken library does with the same ranks and pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        parts = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.long_pairs: dict[tuple[int, int], int] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece, each piece by itself."""
        out: list[tuple[int, ...] | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = (whole,)
            elif not piece:
                out[k] = ()
            else:
                buckets.setdefault(len(piece) if len(piece) <= 32 else 32 << (len(piece) // 33).bit_length(), []).append(k)
        for width, rows in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(rows), step):
                block = rows[at : at + step]
                for k, ids in zip(block, self._merge([pieces[k] for k in block]), strict=True):
                    out[k] = ids
        return out  # type: ignore[return-value]

    def _merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        column = np.arange(width)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[column < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        if width > LONG_ROW:
            return [self._merge_long(row[:n]) for row, n in zip(ids, lengths, strict=True)]
        out: list[tuple[int, ...]] = [()] * len(pieces)
        own = np.arange(len(pieces))
        # A spare column of padding on the right lets every row have a right neighbour.
        ids = np.concatenate([ids, np.full((len(ids), 1), -1, np.int32)], axis=1)
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(own):
            at = ranks.argmin(axis=1)  # the first of equal ones: the leftmost
            row = np.arange(len(own))
            lowest = ranks[row, at]
            done = lowest == _NONE
            if done.any():
                for k, kept, n in zip(own[done].tolist(), ids[done].tolist(), lengths[done].tolist(), strict=True):
                    out[k] = tuple(kept[:n])
                going = ~done
                own, ids, ranks, lengths, at, lowest = own[going], ids[going], ranks[going], lengths[going], at[going], lowest[going]
                if not len(own):
                    break
                row = np.arange(len(own))
            # The merged id takes the left place; what stands right of the pair moves one place to the left.
            width = int(lengths.max())
            stays = np.arange(width) <= at[:, None]
            ids[row, at] = lowest
            ids = np.where(stays, ids[:, :width], ids[:, 1 : width + 1])
            ranks = np.where(stays, ranks[:, :width], np.concatenate([ranks, np.full((len(own), 1), _NONE, np.int32)], axis=1)[:, 1 : width + 1])
            lengths = lengths - 1
            before = np.maximum(at - 1, 0)
            after = np.minimum(at + 1, width - 1)
            right = np.where(at + 1 < width, ids[row, after], -1)
            ranks[row, before] = np.where(at > 0, self.pairs.ranks(ids[row, before], lowest), ranks[row, before])
            ranks[row, at] = self.pairs.ranks(lowest, right)
        return out

    def _merge_long(self, ids: np.ndarray) -> tuple[int, ...]:
        """One row by itself: a heap of (rank, place) gives the leftmost pair of the lowest rank, in n log n steps."""
        values = ids.tolist()
        n = len(values)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.ranks(ids[:-1], ids[1:])
        places = np.flatnonzero(first != _NONE)
        waiting = list(zip(first[places].tolist(), places.tolist(), strict=True))
        heapq.heapify(waiting)

        def push(left: int) -> None:
            pair = values[left], values[after[left]]
            rank = self.long_pairs.get(pair)
            if rank is None:
                rank = self.long_pairs[pair] = int(self.pairs.ranks(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
            if rank != _NONE:
                heapq.heappush(waiting, (rank, left))

        if len(self.long_pairs) > MEMO_PIECES:
            self.long_pairs.clear()
        while waiting:
            rank, left = heapq.heappop(waiting)
            right = after[left] if values[left] >= 0 else n
            # A pair that an earlier merge changed no longer gives this rank.
            if right >= n or self.bytes_of[values[left]] + self.bytes_of[values[right]] != self.bytes_of[rank]:
                continue
            values[left], values[right] = rank, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                push(left)
            if before[left] >= 0:
                push(before[left])
        return tuple(x for x in values if x >= 0)

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo.clear()
            new = list(pieces)
        self.memo.update(zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; texts go through in blocks of bounded size."""
        block: list[list[str]] = []
        held = 0
        for text in texts:
            block.append(self.find(text))
            held += len(block[-1])
            if held > 200_000:
                yield from self._flush(block)
                block, held = [], 0
        yield from self._flush(block)

    def _flush(self, block: list[list[str]]) -> Iterator[list[int]]:
        different = set().union(*block)
        self._learn(different)
        for pieces in block:
            ids: list[int] = []
            for found in map(self.memo.__getitem__, pieces):
                ids += found
            yield ids
        for piece in different:
            if len(piece) > MEMO_CHARS:
                del self.memo[piece]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file, built once per process. The file must be at that path on every machine."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded (binary) of each row. No shuffle: one pass over the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            for at in range(0, len(texts), 256):
                ids = [np.array(x, np.int32) for x in own.encode(texts[at : at + 256])]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + 256].to_numpy(), "n_tokens": [len(x) for x in ids], "ids": ids, "decoded": [own.decode(x.tolist()) for x in ids]})

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_documents(rows, run, "n_tokens long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes: encodes each text, decodes its ids, and keeps digests of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        digits = {i: str(i) for i in own.bytes_of}
        for pdf in batches:
            n_tokens, ids_sha, decoded_sha, n_bytes = [], [], [], []
            for ids in own.encode(pdf["text"].fillna("").tolist()):
                decoded = own.decode(ids)
                n_tokens.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                n_bytes.append(len(decoded))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n_tokens, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha, "n_bytes": n_bytes})

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_documents(rows, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
