"""Operator 10: a quality classifier by compression.

Two zstandard dictionaries are made, from good and from bad labelled texts. A
text is cut into pieces, and each piece is compressed with either dictionary;
the difference of the two total sizes over their sum is positive where the good
dictionary fits better. A logistic curve, fitted on labelled texts that are in
neither dictionary, turns it into a score between 0 and 1.

Training sees at most TRAIN_ROWS labelled texts of each class for each of the
two steps, taken in the order of a digest of their ids; rows held out by the
caller and empty texts are never among them. The curve is fitted on whole texts.
A dictionary is made from all pieces of its texts or, beyond TRAIN_BYTES, from so
many of them: of each text first one piece, then a second one, and so on, in the
order of a digest, so that they lie anywhere in it. Scoring covers every row and
every byte.

Defined results: a null text counts as empty; an empty text has difference 0
and the score of that; without usable labels of both classes every score is
0.5; a label that is null, or of an id with labels that differ, is not used;
equal texts score alike; columns besides id and text are only passed through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, column_name, map_documents
from factloom.shipping import ship

#: Rows of each class and step, and bytes that a dictionary is made from, at most.
TRAIN_ROWS, TRAIN_BYTES = 1500, 12_582_912
#: Of a dictionary, of the samples it is made from, and of the pieces that are compressed.
DICTIONARY_BYTES, SAMPLE_BYTES, PIECE_BYTES, LEVEL = 32_768, 2048, 512, 3
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
THRESHOLD = 0.3


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS. A null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % FOLDS


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _ready: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_ready": []}

    def _compressors(self) -> list:
        if not self._ready:
            for raw in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(raw)
                known.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._ready

    def difference(self, text: str) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) / their sum, and the log of the text's bytes."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw or not self.good or not self.bad:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(raw[at : at + PIECE_BYTES])) for at in range(0, len(raw), PIECE_BYTES)) for c in self._compressors())
        return (bad - good) / (bad + good), float(np.log1p(len(raw)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(texts), 0.5)
        x = np.array([self.difference(t) for t in texts]).reshape(-1, 2)
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 0] * x[:, 1], -30, 30)))


def _pieces(text: str) -> list[tuple[int, int, bytes]]:
    """(rank, digest, piece): the pieces of a text in the order of their digests, all of it up to TRAIN_BYTES."""
    raw = text.encode("utf-8", "surrogatepass")
    digests = sorted((zlib.crc32(at.to_bytes(8, "big"), zlib.crc32(raw[at : at + SAMPLE_BYTES])), at) for at in range(0, len(raw), SAMPLE_BYTES))
    return [(k, digest, raw[at : at + SAMPLE_BYTES]) for k, (digest, at) in enumerate(digests[: TRAIN_BYTES // SAMPLE_BYTES])]


def _dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary trained on the pieces; of too few to train on, the pieces themselves, or as much from within each as has room."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        share = max(64, DICTIONARY_BYTES // len(pieces))
        if sum(map(len, pieces)) > DICTIONARY_BYTES:
            firsts = [zlib.crc32(x) % max(1, len(x) - share + 1) for x in pieces]
            pieces = [x[at : at + share] for x, at in zip(pieces, firsts, strict=True)]
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, slightly ridged; both classes weigh the same as they occur.

    A step is halved until it lowers the loss as far as its slope promises. Whole steps may overshoot to where every score
    is 0 or 1 and the curve is flat, and never come back.
    """
    features = np.stack([np.ones(len(x)), x[:, 0], x[:, 0] * x[:, 1]], axis=1)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-4, 1e-4])

    def loss(v: np.ndarray) -> float:
        z = features @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + v @ ridge @ v / 2)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -500, 500)))
        slope = features.T @ (y - p) - ridge @ w
        step = np.linalg.solve(features.T @ (features * (p * (1 - p))[:, None]) + ridge, slope)
        size = 1.0
        while size > 1e-12 and not loss(w + size * step) <= now - 1e-4 * size * float(slope @ step):
            size /= 2
        if size <= 1e-12:
            break
        w = w + size * step
        now = loss(w)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)  # type: ignore[return-value]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CompressionModel:
    """Fits the model on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("train_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("train_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0)
    known = known.withColumn("fold", fold("train_id")).where(F.col("fold") != HELD_OUT).join(rows.select("train_id").distinct(), "train_id", "left_semi")
    calibrates = F.col("fold") == CALIBRATION
    chosen = None
    for label in (0, 1):
        for part in (calibrates, ~calibrates):
            some = known.where((F.col("label") == label) & part).withColumn("digest", F.md5(F.concat(F.lit("train:"), F.col("train_id").cast("string")))).orderBy("digest", "train_id").limit(TRAIN_ROWS).select("train_id", "label", calibrates.alias("calibrates"), "digest")
            chosen = some if chosen is None else chosen.union(some)
    # At most 4 x TRAIN_ROWS narrow rows.
    got = checkpoint(rows.join(F.broadcast(chosen), "train_id").groupBy("train_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("calibrates").alias("calibrates"), F.first("digest").alias("digest")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["text"]:
                yield pd.DataFrame(_pieces(text), columns=["rank", "digest", "piece"])

    def dictionary(label: int) -> bytes:
        # At most TRAIN_BYTES go to the driver.
        pieces = got.where((F.col("label") == label) & ~F.col("calibrates")).select("text").mapInPandas(cut, "rank long, digest long, piece binary")
        some = [bytes(r["piece"]) for r in pieces.orderBy("rank", "digest", "piece").limit(TRAIN_BYTES // SAMPLE_BYTES).collect()]
        return _dictionary(some) if some else b""

    model = CompressionModel(dictionary(1), dictionary(0))
    if not model.good or not model.bad:
        return CompressionModel(b"", b"")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array([model.difference(t) for t in pdf["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"label": pdf["label"], "digest": pdf["digest"], "x0": found[:, 0], "x1": found[:, 1]})

    fitted = got.where("calibrates").mapInPandas(measure, "label long, digest string, x0 double, x1 double").toPandas().sort_values(["label", "digest"])
    if fitted["label"].nunique() < 2:
        return CompressionModel(b"", b"")
    model.weights = _fit(fitted[["x0", "x1"]].to_numpy(), fitted["label"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row. No shuffle: one pass."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": model.scores(pdf["text"].fillna("").tolist())})

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == HELD_OUT).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = map_documents(rows, run, "held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that the classifier does not reject. Rows pass through; nothing is joined."""
    ship(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    name = column_name(docs, "factloom_score")

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.fillna("").tolist()))

    return docs.withColumn(name, scored(F.col(text_col).cast("string"))).where(F.col(name) >= THRESHOLD).drop(name)
