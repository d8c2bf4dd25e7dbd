"""Operator 2: quality rules on repetition, from rolling hashes of several n-gram lengths.

The words of a block of texts become one numpy array of word ids. The hash of
an n-gram is a polynomial in its words' random 64-bit values, and rolls from n
to n + 1 by one multiplication and one addition for the whole block. N-grams
found twice or more in the same text mark their words; the marked words'
characters, as a share of all characters in words, are the coverage of that n.
Equal hashes are confirmed against the first n-gram of the same hash word by
word; if one fails, that block is counted anew from exact n-gram ids.

Defined results: a null or empty text has no words, zero counts, and fails the
base rules; texts of any length are taken whole; equal rows give equal results;
columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_documents
from factloom.shipping import ship

#: Most that duplicated n-grams of each length may cover of a text's word characters.
COVERAGE_LIMITS = {3: 0.5, 5: 0.4, 8: 0.3, 10: 0.25}
#: Most that repeated lines may hold of a text's word characters, and of its lines with words.
LINE_CHARS_LIMIT, LINES_LIMIT = 0.30, 0.50
#: Most symbols per word.
SYMBOLS_LIMIT = 0.1
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW = 20, 8
#: Bytes of text that are hashed together.
BLOCK_BYTES = 4_000_000

_BASE = np.uint64(0x5851F42D4C957F2D)
_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs twice or more, and for each the first position of its key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(starts, len(ranked)))
    twice = np.repeat(sizes > 1, sizes)
    return order[twice], np.repeat(order[starts], sizes)[twice]


def _exact_ids(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """An id of each n-gram without hashing, from the ids of its prefix and its last word."""
    ids = owner[: len(words) - n + 1]
    for k in range(n):
        ids = np.unique(np.stack([ids, words[k : len(words) - n + 1 + k]]), axis=1, return_inverse=True)[1].ravel()
    return ids


def repeated_words(words: np.ndarray, owner: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each n, which words stand in an n-gram that its own text holds twice or more. words and owner: ids by word."""
    found = {}
    values, texts = _mix(words), _mix(owner + 1)
    rolled = np.zeros(len(words), np.uint64)
    for n in range(1, max(lengths) + 1):
        if n > len(words):
            rolled = rolled[:0]
        else:
            rolled = rolled[: len(words) - n + 1] * _BASE + values[n - 1 :]
        if n not in lengths:
            continue
        marks = np.zeros(len(words) + 1, np.int32)
        inside = np.flatnonzero(owner[: len(rolled)] == owner[n - 1 :]) if len(rolled) else np.zeros(0, np.int64)
        if len(inside):
            at, first = _repeated(rolled[inside] ^ texts[inside])
            at, first = inside[at], inside[first]
            sure = all((words[at + k] == words[first + k]).all() for k in range(n)) and (owner[at] == owner[first]).all()
            if not sure:
                at = inside[_repeated(_exact_ids(words, owner, n)[inside])[0]]
            np.add.at(marks, at, 1)
            np.subtract.at(marks, at + n, 1)
        found[n] = np.cumsum(marks[:-1]) > 0
    return found


def _block(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text of a block."""
    n_texts = len(texts)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[ends - sizes]

    lead = ~_CONTINUES[buffer]
    out = {"word_chars": per_text(lead & ~_WHITE[buffer]), "n_symbols": per_text(_SYMBOL[buffer])}
    known: dict[bytes, int] = {}
    split = [t.split() for t in texts]  # of bytes: at the six ASCII white-space characters
    n_words = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, int(n_words.sum()))
    chars_of = np.array([len(w) for w in known], np.int64)
    if known:
        joined = np.frombuffer(b"".join(known), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(chars_of)])
        leads = np.concatenate([[0], np.cumsum(~_CONTINUES[joined], dtype=np.int64)])
        chars_of = leads[bounds[1:]] - leads[bounds[:-1]]
    owner = np.repeat(np.arange(n_texts), n_words)
    word_size = chars_of[words] if len(words) else np.zeros(0, np.int64)
    marked = repeated_words(words, owner, sorted({*COVERAGE_LIMITS, WINDOW}))
    out["n_words"] = n_words
    out["n_repeat_words"] = np.bincount(owner[marked[WINDOW]], minlength=n_texts)
    whole = np.maximum(out["word_chars"], 1)
    for n in COVERAGE_LIMITS:
        out[f"dup_{n}gram_chars"] = np.bincount(owner[marked[n]], word_size[marked[n]], n_texts) / whole
    dup_lines, lines, dup_chars = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64), np.zeros(n_texts)
    for k, text in enumerate(texts):
        if b"\n" not in text:
            lines[k] = bool(split[k])
            continue
        with_words = [x for x in text.split(b"\n") if x and not x.isspace()]
        lines[k] = len(with_words)
        if len(set(with_words)) < len(with_words):
            seen: set[bytes] = set()
            for line in with_words:
                if line in seen:
                    dup_lines[k] += 1
                    dup_chars[k] += sum(len(w.decode("utf-8", "replace")) for w in line.split())
                seen.add(line)
    out |= {"n_dup_lines": dup_lines, "dup_line_share": dup_lines / np.maximum(lines, 1), "dup_line_chars": dup_chars / whole}
    return out


def measure(texts: list[str]) -> pd.DataFrame:
    """All measures and both verdicts of each text."""
    parts, block, held = [], [], 0
    for text in texts:
        block.append(text.encode("utf-8", "surrogatepass"))
        held += len(block[-1])
        if held >= BLOCK_BYTES:
            parts.append(pd.DataFrame(_block(block)))
            block, held = [], 0
    parts.append(pd.DataFrame(_block(block)))
    m = pd.concat(parts, ignore_index=True)
    m["base_failed"] = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > 30 * m.n_words)
    bad = (m.n_symbols > SYMBOLS_LIMIT * m.n_words) | (m.dup_line_share > LINES_LIMIT) | (m.dup_line_chars > LINE_CHARS_LIMIT)
    for n, limit in COVERAGE_LIMITS.items():
        bad |= m[f"dup_{n}gram_chars"] > limit
    m["kept"] = ~m.base_failed & ~bad
    return m


_COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "dup_line_share": "double", "dup_line_chars": "double"} | {f"dup_{n}gram_chars": "double" for n in COVERAGE_LIMITS}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the coverage measures of each row. No shuffle: one pass."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), measure(pdf["text"].fillna("").tolist())[list(_COLUMNS)]], axis=1)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_documents(rows, run, ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))
