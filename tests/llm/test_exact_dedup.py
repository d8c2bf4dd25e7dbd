import functools

from factloom.llm import exact_dedup as ed


def polynomial(raw):
    return tuple(functools.reduce(lambda h, c: (h * base + c) % prime, raw, 0) for base, prime in zip(ed.BASES, ed.PRIMES, strict=True))


def test_fingerprints_are_polynomials_and_compose():
    parts = [b"", b"a", b"x" * 16_383, b"y" * 16_384, b"z" * 16_385, bytes(range(256)) * 200]
    assert ed.fingerprints(parts) == [polynomial(p) for p in parts]
    for a in parts:
        for b in parts:
            assert ed.combine(polynomial(a), polynomial(b), len(b)) == polynomial(a + b)
    assert ed.fingerprints([b"", b""]) == [(0,) * 4] * 2


def groups(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows)


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""), []).append(r.doc_id)
    out = []
    for ids in by.values():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: i != keep):
            kept = i == keep and left > 0
            left -= kept
            out.append((i is None, i or 0, keep, len(ids), kept))
    return sorted(out)


def test_groups_of_odd_rows(odd, empty):
    assert groups(ed.group_equal(odd).collect()) == brute(odd.collect())
    assert ed.group_equal(empty).count() == 0


def test_texts_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ed, "_named", lambda text, print_: "same")
    monkeypatch.setattr(ed, "ship", lambda spark: None)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(ed)  # so that the workers see the weakened name
    try:
        docs = spark.createDataFrame([(1, "A text"), (2, "a text"), (3, "b" * 40_000), (4, "b" * 39_999 + "c")], "doc_id long, text string")
        assert groups(ed.group_equal(docs).collect()) == brute(docs.collect())
    finally:
        cloudpickle.unregister_pickle_by_value(ed)


def test_rows_that_stay(odd, empty):
    kept = ed.drop_equal(odd)
    assert kept.columns == odd.columns and ed.drop_equal(empty).count() == 0
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 14, 2**63 - 1]


def test_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (1, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ed.drop_equal(docs).collect()) == [(1, "x"), (2, "y")]


def test_ids_of_text_and_hot_groups(texts_as_ids, spark, hot):
    got = sorted((r.doc_id or "", r.keep_id or "", r.group_size, r.kept) for r in ed.group_equal(texts_as_ids).collect())
    want = {}
    for r in texts_as_ids.collect():
        want.setdefault((r.text or "").lower(), []).append(r.doc_id or "")
    assert sorted((i, max(ids), len(ids)) for ids in want.values() for i in ids) == [x[:3] for x in got] and sum(x[3] for x in got) == len(want)
    docs = spark.createDataFrame([(k, "copy" if k % 3 else f"own {k}") for k in range(60)], "doc_id long, text string").repartition(4)
    assert groups(ed.group_equal(docs).collect()) == brute(docs.collect())
