import itertools
import re

import numpy as np
import pandas as pd
import xxhash

from factloom.llm import components, simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {n: top(n) for n in nodes}


def close(a, b):
    return (int(a) ^ int(b)).bit_count() <= 3


def planted(seed, families=12, size=15):
    rng = np.random.default_rng(seed)
    out = set(rng.integers(0, 2**63, 60, dtype=np.uint64).tolist()) | {0, 2**64 - 1}
    for start in rng.integers(0, 2**63, families, dtype=np.uint64).tolist():
        for _ in range(size):
            out.add(start)
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                start ^= 1 << b
    return sorted(out)


def test_fingerprints(spark, odd, empty):
    got = sorted((r.doc_id or -1, r.fingerprint) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted((r.doc_id or -1, f"{brute_fingerprint(r.text):016x}") for r in odd.collect())
    assert simhash.near_duplicates(empty).count() == 0


def test_close_halves_meet_at_an_anchor():
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.integers(0, 2**32, 500, dtype=np.uint64), np.array([0, 2**32 - 1], np.uint64)])

    def by_row(x):
        out = {}
        for k, anchor in zip(*simhash.anchors(x), strict=True):
            out.setdefault(int(k), set()).add(int(anchor))
        return out

    base = by_row(a)
    for bit in range(32):
        other = by_row(a ^ np.uint64(1 << bit))
        assert all(base[k] & other[k] for k in range(len(a)))


def test_components_of_planted_fingerprints(spark, monkeypatch):
    fps = planted(2)
    want = brute_components(fps, close)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(5)
    for rows in (4096, 6, 2):  # the last two send anchors through refinement and blocks
        monkeypatch.setattr(simhash, "ANCHOR_ROWS", rows)
        found = components.components(simhash.links(frame)).collect()
        label = {int(np.int64(r.node).view(np.uint64)): r.component for r in found}
        groups, truth = {}, {}
        for f in fps:
            groups.setdefault(label.get(f, f"own {f}"), set()).add(f)
            truth.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values())), rows


def test_a_path_to_and_fro_between_blocks_stays_connected():
    blocks = {0: [0x100000, 0x10003F], 1: [0x0C003F, 0x100007]}
    pdf = pd.DataFrame([(f, block) for block, fps in blocks.items() for f in fps], columns=["fp", "block"])
    fps = pdf["fp"].tolist()
    assert len(set(brute_components(fps, close).values())) == 1
    found = simhash._compare_blocks((1, 0, 0, 0, 1), pdf)
    linked = {frozenset(x) for x in zip(found["u"], found["v"], strict=True)}
    assert len(set(brute_components(fps, lambda a, b: frozenset((a, b)) in linked).values())) == 1


def test_component_of_documents_is_the_least_id(spark):
    words = " ".join(f"word{k}" for k in range(400))
    rows = [(30, words), (20, words + " x"), (10, words + " x y"), (5, "something else of its own entirely here"), (7, None), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = {}
    for root in brute_components(sorted(set(prints.values())), close).items():
        want.setdefault(root[1], set()).add(root[0])
    member = {f: min(i for i, p in prints.items() if p in group) for group in want.values() for f in group}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == member[prints[r.doc_id]] for r in got)
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(member.values())) and kept.columns == docs.columns


def test_each_component_keeps_one_row_whatever_its_ids(spark):
    words = " ".join(f"word{k}" for k in range(400))
    apart = [(None, "first text of a row without id"), (None, "quite another one without any id"), (3, "one of two texts that share an id"), (3, "unrelated words under the very same number")]
    near = [(None, words), (9, words + " x"), (9, words + " x"), (None, words + " x")]
    prints = sorted({brute_fingerprint(t) for _, t in apart} | {brute_fingerprint(words)})
    assert len(set(brute_components(prints, close).values())) == 5 and close(brute_fingerprint(words), brute_fingerprint(words + " x"))
    docs = spark.createDataFrame(apart + near, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [*apart, near[1]]))


def test_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 4999)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "u long, v long").repartition(6)).collect()}
    assert {found[k] for k in range(201)} == {0} and found[1299] == 1000 and found[5000] == 4999 and len(found) == 201 + 300 + 2


def test_large_groups_and_ids_of_text(spark, texts_as_ids, hot):
    rows = [(k, "the same words again and again" if k % 2 else f"own words of {k} here {k * 7} and {k * 11}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(sorted(prints), lambda a, b: close(prints[a], prints[b]))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(want.values())
    assert simhash.near_duplicates(texts_as_ids).count() == texts_as_ids.count()
    assert {r.doc_id for r in simhash.drop_near_duplicates(texts_as_ids).collect()} >= {"d1", "d3", "d7", None}
    star = [(0, k) for k in range(1, 50)] + [(k, k + 100) for k in range(1, 50)]
    assert {r.component for r in components.components(spark.createDataFrame(star, "u long, v long")).collect()} == {0}
