import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from factloom.llm import common, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def runs(words, longest=2):
    return [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, min_words=20, percent=25):
    """(doc_id, n_words, n_features, weight, score) of each row, and how many are drawn."""

    def counted(texts):
        out = {}
        for t in texts:
            for f in runs(words_of(t)):
                b = zlib.crc32(f.encode()) % 10000
                out[b] = out.get(b, 0) + 1
        return out

    s, t = counted(x for _, x in docs), counted(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        found = [zlib.crc32(f.encode()) % 10000 for f in runs(words_of(text))]
        gains = [math.floor(1000 * math.log((t.get(b, 0) + 1) * (s_all + 10000) / ((s.get(b, 0) + 1) * (t_all + 10000)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out, percent * sum(x[1] >= min_words for x in out) // 100


def found(df):
    return [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect()]


def check(spark, docs, target):
    want, n = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = found(importance.rank_documents(docs, target))
    assert sorted(map(str, (x[:5] for x in got))) == sorted(map(str, want))
    drawn = sorted((x for x in got if x[5] is not None), key=lambda x: x[5])
    assert [x[5] for x in drawn] == list(range(1, n + 1))
    best = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))[:n]
    assert [(x[0], x[4]) for x in drawn] == [(x[0], x[4]) for x in best]
    return got


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "Wörter über Wörter")], "item_id long, text string")


def test_odd_rows_against_brute_force(spark, odd, empty, target):
    got = check(spark, odd, target)
    assert sorted(map(str, got)) == sorted(map(str, found(importance.rank_documents(odd.repartition(5), target))))
    assert importance.rank_documents(empty, target).count() == 0
    check(spark, odd, target.where("1 = 0"))


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))


def test_ids_of_text(spark, texts_as_ids, target):
    check(spark, texts_as_ids, target)


def test_repeated_rows_are_drawn_one_by_one(spark, target, monkeypatch):
    monkeypatch.setattr(common, "COPIES_AT_ONCE", 3)
    rows = [(5, "the quick brown fox " * 6)] * 40 + [(k, f"w{k} " * 25) for k in range(100, 120)] + [(None, "lazy dog " * 15)] * 9
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), target)


def test_drawn_rows_keep_their_columns(spark, odd, target):
    drawn = importance.resample(odd, target, percent=50)
    assert drawn.columns == odd.columns
    ranks = importance.rank_documents(odd, target, percent=50).where("rank IS NOT NULL")
    assert sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(r.doc_id) for r in ranks.collect())


def test_crcs_compose_at_every_length(monkeypatch):
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (0, 1, 2, 63, 64, 65, 127, 128, 1000, 70_001)]
    for b in parts:
        crcs = np.array([zlib.crc32(a) for a in parts], np.uint32)
        got = importance.shift(crcs, np.full(len(parts), len(b))) ^ np.uint32(zlib.crc32(b))
        assert got.tolist() == [zlib.crc32(a + b) for a in parts]


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("block", [1, 7, 64, 1 << 19])
def test_blocks_do_not_change_features(monkeypatch, longest, block):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    texts = ["a bc, def!", "", "x" * 200 + " " + "y" * 63 + " " + "z" * 64 + "\nü漢 ok", " . ", "one", "a b a b a b a b a b", "ends here"]
    got = {}
    for _, of, bucket in importance.features([t.lower().encode() for t in texts], longest, 1 << 31):
        for k, b in zip(of.tolist(), bucket.tolist(), strict=True):
            got.setdefault(k, []).append(b)
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == sorted(zlib.crc32(f.encode()) % (1 << 31) for f in runs(words_of(t), longest))
