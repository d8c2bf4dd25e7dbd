"""Operator 8: masked pseudo-likelihood by a bidirectional window network.

A document's score is the sum, over its tokens, of the log-probability of the
token given the tokens on both sides of it. The probability has two factors:
the network gives the token's class from the classes of the WINDOW tokens left
and right of it (one hidden layer over one embedding table per place, softmax
over the classes), and the class gives the token by its count. Frequent words
have classes of their own, other words share classes by their last letters. The
vocabulary is the VOCABULARY most frequent words; a word outside it is spelled
by byte frequencies.

What is gathered from the corpus covers all of it: the counts of all words of
all documents, and ROUNDS rounds in which every shard of the documents trains
the network in numpy, with the shards' networks averaged by their numbers of
trained tokens after each round, in a tree of bounded fan-in. Shards are dealt,
and put in order, by a digest of id and text, and there is one for every
SHARD_CHARS characters: the same rows give the same network however they are
partitioned. Each token of each document is the masked one in exactly one of
the rounds. The averages are taken on executors; the driver gets one network.

Defined results: a null or empty text has no tokens, log_prob 0 and a null
mean; texts are taken whole; equal texts have equal scores; an empty table
gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, map_documents
from factloom.shipping import ship

#: Words of the vocabulary at most: the bound of what is sent to every executor.
VOCABULARY = 65_536
OWN_CLASSES, SHARED_CLASSES, SPELLED, EDGE = 64, 62, 126, 127
CLASSES = 128
WINDOW, HIDDEN = 2, 16
ROUNDS, RATE, BATCH = 2, 2.0, 1024
SEED = 8
#: Words are taken into the vocabulary by bins of their counts, so many for each doubling.
BINS_PER_DOUBLING = 64
#: Counts are summed per word in a task until it holds so many words.
COUNTER_WORDS = 200_000
#: Networks that are averaged in one task. The averages are averaged again, until so few are left.
AVERAGE_FAN = 64
BLOCK_TOKENS = 200_000
#: Characters of text of one shard, on average: what one task trains a copy of the network on.
SHARD_CHARS = 8_000_000


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def word_class(word: bytes, rank: int) -> int:
    """Of a vocabulary word: its rank for the most frequent ones, else by its last three bytes."""
    return rank if rank < OWN_CLASSES else OWN_CLASSES + zlib.crc32(word[-3:]) % SHARED_CLASSES


@dataclass
class Vocabulary:
    ids: dict[bytes, int]
    classes: np.ndarray
    within: np.ndarray
    spelled: np.ndarray
    #: The share of each class in all tokens, from which the network starts.
    prior: np.ndarray

    @classmethod
    def of(cls, counts: list[tuple[bytes, int]], byte_counts: np.ndarray) -> Vocabulary:
        """counts: words by falling count. byte_counts: of the bytes 0-255 in all words, and at 256 the number of words."""
        ids = {w: k for k, (w, _) in enumerate(counts)}
        classes = np.array([word_class(w, k) for k, (w, _) in enumerate(counts)], np.int64)
        own = np.array([n for _, n in counts], np.float64)
        total = np.bincount(classes, own, CLASSES)
        within = np.log(own / total[classes]) if len(own) else own
        smooth = byte_counts + 1.0
        total[SPELLED] = max(0.0, byte_counts[256] - own.sum())
        return cls(ids, np.append(classes, SPELLED), np.append(within, 0.0), np.log(smooth / smooth.sum()), (total + 1e-3) / (total + 1e-3).sum())

    def class_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's id of each word, one beyond the last for unknown ones, and its class."""
        n = len(self.ids)
        get = self.ids.get
        at = np.fromiter([get(w, n) for w in words], np.int64, len(words))
        return at, self.classes[at]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and the log-probability of the word within its class."""
        at, classes = self.class_of(words)
        inside = self.within[at]
        unknown = np.flatnonzero(at == len(self.ids))
        if len(unknown):
            spelt = [words[k] for k in unknown.tolist()]
            ends = np.cumsum([len(w) for w in spelt])
            sums = np.concatenate([[0.0], np.cumsum(self.spelled[np.frombuffer(b"".join(spelt), np.uint8)])])
            inside[unknown] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])] + self.spelled[256]
        return classes, inside


@dataclass
class WindowNet:
    """tables: for each place of the window an embedding of each class; out and bias: the softmax layer."""

    tables: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, prior: np.ndarray) -> WindowNet:
        rng = np.random.default_rng(SEED)
        return cls(rng.normal(0, 0.3, (2 * WINDOW, CLASSES, HIDDEN)).astype(np.float32), rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.log(prior + 1e-6).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.tables.ravel(), self.out.ravel(), self.bias])

    @classmethod
    def unflat(cls, x: np.ndarray) -> WindowNet:
        a, b = 2 * WINDOW * CLASSES * HIDDEN, HIDDEN * CLASSES
        x = np.asarray(x, np.float32)
        return cls(x[:a].reshape(2 * WINDOW, CLASSES, HIDDEN).copy(), x[a : a + b].reshape(HIDDEN, CLASSES).copy(), x[a + b :].copy())

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.tables[0][context[:, 0]]
        for k in range(1, 2 * WINDOW):
            h += self.tables[k][context[:, k]]
        return np.tanh(h, out=h)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        z = self.hidden(context) @ self.out
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        picked = z[np.arange(len(z)), target]
        return picked - np.log(np.exp(z, out=z).sum(axis=1))

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """One step down the mean negative log-probability of a batch."""
        h = self.hidden(context)
        z = h @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z, out=z)
        p *= (RATE / len(p)) / p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), target] -= np.float32(RATE / len(p))
        back = (p @ self.out.T) * (1 - h * h)
        self.out -= h.T @ p
        self.bias -= np.ones(len(p), np.float32) @ p
        columns = np.ascontiguousarray(back.T, np.float64)
        for k in range(2 * WINDOW):
            classes = np.ascontiguousarray(context[:, k])
            self.tables[k] -= 4 * np.stack([np.bincount(classes, column, CLASSES) for column in columns], axis=1).astype(np.float32)


def windows(classes: np.ndarray, lengths: list[int] | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """The classes left and right of tokens of documents of the given lengths in a row (one document by default).

    EDGE stands beyond a document's ends. at: the tokens wanted, all by default.
    """
    lengths = [len(classes)] if lengths is None else lengths
    place = np.arange(len(classes)) + WINDOW * (1 + np.repeat(np.arange(len(lengths)), lengths))
    padded = np.full(len(classes) + WINDOW * (len(lengths) + 1), EDGE, np.int64)
    padded[place] = classes
    wanted = place if at is None else place[at]
    return padded[wanted[:, None] + np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])]


def targets(lengths: list[int], number: int) -> np.ndarray:
    """The tokens masked in a round, of documents of the given lengths in a row: each token is in one of ROUNDS rounds."""
    ends = np.cumsum(lengths)
    firsts = [(number + n) % ROUNDS for n in lengths]
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(e - n + f, e, ROUNDS) for e, n, f in zip(ends.tolist(), lengths, firsts, strict=True))]).astype(np.int64)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter[bytes] = Counter()
    for pdf in batches:
        for text in pdf["text"].fillna(""):
            held.update(tokens(text))
            if len(held) > COUNTER_WORDS:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held = Counter()
    yield pd.DataFrame({"word": list(held), "n": list(held.values())})


def gather_vocabulary(rows: DataFrame) -> Vocabulary:
    """Counts all words of all rows (text); keeps the most frequent ones and the bytes of all."""
    counts = checkpoint(rows.mapInPandas(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))

    def bytes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(257, np.int64)
        for pdf in batches:
            weights = pdf["n"].to_numpy()
            lengths = np.array([len(w) for w in pdf["word"]], np.int64)
            total[:256] += np.bincount(np.frombuffer(b"".join(pdf["word"]), np.uint8), np.repeat(weights, lengths), 256).astype(np.int64)
            total[256] += weights.sum()
        yield pd.DataFrame({"byte": np.arange(257), "n": total})

    byte_counts = np.zeros(257)
    for row in counts.mapInPandas(bytes_of, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 257 rows
        byte_counts[row["byte"]] = row["n"]
    top = _most_frequent(counts, VOCABULARY)
    return Vocabulary.of([(bytes(r["word"]), r["n"]) for r in top], byte_counts)


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The rows of the `most` most frequent words (word, n), by falling n; of words around the last place, those of the least digest."""

    def upto(sizes: list, room: int) -> tuple[int, int]:
        """How many of the sizes have room as a whole, and the room that is left."""
        k = 0
        while k < len(sizes) and sizes[k] <= room:
            room -= sizes[k]
            k += 1
        return k, room

    # Whole bins of counts from the top; of the first that does not fit whole ranges of digests; of the first such that does not fit its first words.
    bin_of = F.floor(F.log2("n") * BINS_PER_DOUBLING).cast("int")
    bins = sorted(counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect(), reverse=True)  # at most 64 * BINS_PER_DOUBLING rows
    k, room = upto([r["n"] for r in bins], most)
    top = counts.where(bin_of > bins[k]["bin"] if k < len(bins) else F.lit(True)).collect()  # at most VOCABULARY rows
    if k < len(bins):
        digest = F.xxhash64("word")
        split = counts.where(bin_of == bins[k]["bin"])
        ranges = sorted(split.groupBy(F.shiftright(digest, 48).alias("range")).agg(F.count("*").alias("n")).collect())  # at most 65,536 rows
        j, room = upto([r["n"] for r in ranges], room)
        found = split.withColumn("range", F.shiftright(digest, 48))
        if j:
            top += found.where(F.col("range") <= ranges[j - 1]["range"]).select("word", "n").collect()
        if room:
            top += found.where(F.col("range") == ranges[j]["range"]).orderBy(digest, "word").limit(room).select("word", "n").collect()
    return sorted(top, key=lambda r: (-r["n"], bytes(r["word"])))


def deal(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", shard_chars: int | None = None) -> tuple[DataFrame, int]:
    """text and shard of each row, in the order of a digest within a shard, as a checkpoint; and the number of shards.

    The digest is that of id and text, and there is a shard for every shard_chars characters of the whole table: where a row
    stands in its files and partitions makes no difference.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shards = max(1, (docs.agg(F.sum(F.length(text))).first()[0] or 0) // (shard_chars or SHARD_CHARS))
    known = [F.coalesce(F.col(id_col).cast("string"), F.lit(""))] if id_col else []
    dealt = docs.select(text.alias("text"), F.xxhash64(*known, text).alias("digest")).withColumn("shard", F.pmod("digest", F.lit(shards)))
    return checkpoint(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "digest", "text").select("text", "shard")), shards


def _train_round(rows: DataFrame, shards: int, vocabulary: Vocabulary, net: WindowNet, number: int) -> WindowNet:
    """Every shard of rows (text, shard) trains its copy of net; the copies are averaged."""
    sent = rows.sparkSession.sparkContext.broadcast((vocabulary, net.flat()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, flat = sent.value
        shard = own = None
        seen, held = 0, 0
        block: list[list[bytes]] = []

        def learn() -> int:
            lengths = [len(x) for x in block]
            at = targets(lengths, number)
            _, classes = words.class_of([w for x in block for w in x])
            context, target = windows(classes, lengths, at), classes[at]
            for k in range(0, len(at), BATCH):
                own.step(context[k : k + BATCH], target[k : k + BATCH])
            block.clear()
            return len(at)

        def ended() -> Iterator[pd.DataFrame]:
            n = seen + (learn() if block else 0)
            if n:
                yield pd.DataFrame({"node": [shard], "seen": [n], "net": [own.flat().astype(np.float64)]})

        for pdf in batches:
            for of, text in zip(pdf["shard"].tolist(), pdf["text"], strict=True):
                if of != shard:
                    yield from ended()
                    shard, own, seen, held = of, WindowNet.unflat(flat), 0, 0
                block.append(tokens(text))
                held += len(block[-1])
                if held > BLOCK_TOKENS:
                    seen += learn()
                    held = 0
        yield from ended()

    nodes, nets = shards, rows.mapInPandas(run, _NODE)
    while nodes > AVERAGE_FAN:
        nets, nodes = nets.groupBy(F.floor(F.col("node") / AVERAGE_FAN).alias("parent")).applyInPandas(_average, _NODE), -(-nodes // AVERAGE_FAN)
    trained = nets.toPandas()  # at most AVERAGE_FAN rows
    return WindowNet.unflat(_average((0,), trained)["net"][0]) if len(trained) else net


_NODE = "node long, seen long, net array<double>"


def _average(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The nets of one parent's nodes, by their numbers of trained tokens. In the order of the nodes, so that sums agree."""
    pdf = pdf.sort_values("node")
    seen = int(pdf["seen"].sum())
    total = sum(np.asarray(x) * n for x, n in zip(pdf["net"], pdf["seen"], strict=True))
    return pd.DataFrame({"node": [int(key[0])], "seen": [seen], "net": [total / seen]})


def score_texts(texts: list[str], vocabulary: Vocabulary, net: WindowNet) -> list[tuple[int, float]]:
    """The number of tokens and the summed log-probability of each text."""
    out, block = [], []

    def flush() -> None:
        lengths = [len(x) for x in block]
        target, inside = vocabulary.look_up([w for x in block for w in x])
        context = windows(target, lengths)
        for at in range(0, len(target), BATCH):
            inside[at : at + BATCH] += net.log_probs(context[at : at + BATCH], target[at : at + BATCH])
        sums = np.concatenate([[0.0], np.cumsum(inside)])
        at = 0
        for n in lengths:
            out.append((n, float(sums[at + n] - sums[at])))
            at += n
        block.clear()

    held = 0
    for text in texts:
        block.append(tokens(text))
        held += len(block[-1])
        if held > BLOCK_TOKENS:
            flush()
            held = 0
    flush()
    return out


def train(docs: DataFrame, text_col: str = "text", id_col: str | None = "doc_id") -> tuple[Vocabulary, WindowNet]:
    """The vocabulary and the network of docs, the same however docs is partitioned."""
    ship(docs.sparkSession)
    rows, shards = deal(docs, id_col, text_col)
    vocabulary = gather_vocabulary(rows.select("text"))
    net = WindowNet.fresh(vocabulary.prior)
    for number in range(ROUNDS):
        net = _train_round(rows, shards, vocabulary, net, number)
    return vocabulary, net


def score(docs: DataFrame, vocabulary: Vocabulary, net: WindowNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, flat = sent.value
        own = WindowNet.unflat(flat)
        for pdf in batches:
            found = score_texts(pdf["text"].fillna("").tolist(), words, own)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [n for n, _ in found], "log_prob": [round(x, 4) for _, x in found]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_documents(rows, run, "n_tokens long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def score_by_own_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on docs and scores them."""
    return score(docs, *train(docs, text_col, id_col), id_col, text_col)
