import hashlib
import zlib
from collections import Counter

from factloom.llm import common, sharding


def brute(rows, shards=8, seed="shard-1"):
    """(doc_id, source, size, crc, shard, slot), by sorting everything."""
    seen, keyed = Counter(), []
    for doc_id, text, source in rows:
        data = (text or "").encode()
        key = (doc_id, source, len(data) + 1, zlib.crc32(data))
        names = ["null" if x is None else f"={x}" for x in key[:2]]
        digest = hashlib.md5(":".join([seed, *names, str(key[2]), str(key[3]), str(seen[key])]).encode()).hexdigest()
        seen[key] += 1
        keyed.append((names[1], digest, key))
    count, nth, out = Counter(s for s, _, _ in keyed), Counter(), []
    for source, digest, key in sorted(keyed, key=lambda x: x[:2]):
        start = int(hashlib.md5(f"{seed}:{source}".encode()).hexdigest()[:13], 16) / 16**13
        out.append(((nth[source] + start) / count[source], digest, key))
        nth[source] += 1
    out.sort(key=lambda x: x[:2])
    taken, dealt = Counter(), []
    for place, (_, _, key) in enumerate(out):
        shard = place * shards // len(out)
        dealt.append((*key, shard, taken[shard]))
        taken[shard] += 1
    return dealt


def found(df):
    return [(r.doc_id, r.source, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()]


def check(docs, **options):
    got = found(sharding.shard_documents(docs, **options))
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], **options)
    assert sorted(map(str, got)) == sorted(map(str, want))
    counts = Counter(x[4] for x in got)
    per = [counts[k] for k in range(options.get("shards", 8))]
    assert max(per) - min(per) <= 1
    for k, n in counts.items():
        assert sorted(x[5] for x in got if x[4] == k) == list(range(n))
    return got


def test_odd_rows_against_brute_force(odd, empty):
    got = check(odd)
    assert sorted(map(str, got)) == sorted(map(str, found(sharding.shard_documents(odd.repartition(5)))))
    assert sharding.shard_documents(empty).count() == 0
    check(odd, shards=64)
    check(odd, shards=1, seed="other")


def test_ids_of_text(texts_as_ids):
    check(texts_as_ids)


def test_every_shard_holds_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    rows = [(k, "t", "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(3000)] + [(10_000 + k, "t", f"tiny{k}") for k in range(400)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6))
    whole = Counter(x[1] for x in got)
    for shard in range(8):
        part = Counter(x[1] for x in got if x[4] == shard)
        assert all(abs(part[s] - n / 8) <= 2 for s, n in whole.items() if n > 8)
        # Sources of one row each spread as well.
        assert 20 <= sum(n for s, n in part.items() if s.startswith("tiny")) <= 80


def test_equal_rows_each_get_a_slot(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES_AT_ONCE", 7)
    rows = [(1, "same", "a")] * 100 + [(None, None, None)] * 50 + [(k, "x" * k, "b") for k in range(2, 40)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))


def test_written_shards_hold_all_rows_and_columns(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    new = [c for c in back.columns if c not in odd.columns]
    assert new == ["slot", "shard"]
    assert sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    want = Counter((r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard_documents(odd, shards=4).collect())
    got = Counter((r.doc_id, len((r.text or "").encode()) + 1, r.shard, r.slot) for r in back.collect())
    assert got == want
