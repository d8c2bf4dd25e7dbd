import random
import re

import pytest

from factloom.operators import names, validation

SCHEMA = "entity_id string, type string, name string"
NAMES = [
    ("m.ni", "metal", "никель"), ("m.slag", "material", "никелевый шлак"), ("p.ph", "parameter", "pH"), ("m.Ni", "metal", "Ni"), ("c.feni", "alloy", "Fe-Ni"), ("c.nh", "reagent", "(NH4)2SO4"),
    ("a", "x", "a b"), ("b", "x", "b c d"), ("c", "x", "c"), ("d", "x", "a b c"), ("e", "x", "b c"), ("again", "x", "a b"), ("none", "x", None), ("empty", "x", ""), ("q", "parameter", "a b a b"),
]


def brute(text, entries):
    """Each name by its own pattern, the longest first."""
    taken, out = [], []
    for e, kind, n in sorted({x for x in entries if x[2]}, key=lambda x: (-len(x[2]), x[2], x[0])):
        exact = len(n) <= 3 or any(c.isdigit() for c in n)
        for m in re.finditer(rf"(?<!\w)(?={re.escape(n)}(?!\w))", text or "", 0 if exact else re.IGNORECASE):
            a, b = m.start(), m.start() + len(n)
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                number = re.search(r"\d+(?:[.,]\d+)?", text[b : b + 18]) if kind == "parameter" else None
                out.append((e, n, text[a:b], a, b, float(number[0].replace(",", ".")) if number else None))
    return sorted(out, key=lambda x: x[3])


@pytest.mark.parametrize("most_sent", [1000, 0])
def test_names_against_one_pattern_each(spark, most_sent):
    rng = random.Random(6)
    parts = ["a", "b", "c", "d", "A", "B", "Ni", "ni", "pH", "ph", "Fe-Ni", "никель", "Никелевый шлак", "(NH4)2SO4", "11,5", "x_a", "_"]
    texts = [(k, "".join(rng.choice(parts) + rng.choice([" ", " ", "", "-", "  ", "\n"]) for _ in range(rng.randint(0, 25)))) for k in range(300)]
    texts += [(900, None), (901, ""), (902, "Никелевый шлак и никель при pH 11,5; ni не Ni."), (903, "a b " * 3000)]
    df = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    got = {}
    for r in names.find_names(df, spark.createDataFrame(NAMES, SCHEMA), most_sent=most_sent).collect():
        got.setdefault(r.chunk_id, []).append((r.entity_id, r.name, r.surface, r.start_at, r.end_at, r.value))
    assert {k: sorted(v, key=lambda x: x[3]) for k, v in got.items()} == {k: f for k, t in texts if (f := brute(t, NAMES))}


def test_both_ways_agree_on_a_large_dictionary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    words = sorted({w for r in docs.collect() for w in re.findall(r"\w+", r.text)})
    rng = random.Random(7)
    listed = [(str(k), "x", " ".join(rng.choices(words, k=rng.choice([1, 1, 2])))) for k in range(4000)]
    df = spark.createDataFrame(listed, SCHEMA)
    sent, joined = (names.find_names(docs, df, "doc_id", most_sent=n).collect() for n in (10**6, 0))
    assert len(sent) > 1000 and sorted(map(str, sent)) == sorted(map(str, joined))


def best_place(text, quote, span=300):
    word = re.compile("[0-9A-Za-zА-Яа-яЁё]+")
    wanted = {w.lower() for w in word.findall(quote or "") if len(w) > 1}
    anchor = max(wanted, key=lambda w: (len(w), w), default=None)
    held = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(text or "") if m[0].lower() in wanted]
    best = None
    for i, (a, _, _) in enumerate(held):
        near = [x for x in held[i:] if x[1] - a <= span]
        firsts = {}
        for x in near:
            firsts.setdefault(x[2], x[1])
        if anchor in firsts:
            key = (len(firsts), a - max(firsts.values()), -a)
            best = max(best or key, key)
    return (0.0, "") if best is None else (best[0] / len(wanted), text[-best[2] : -best[2] - best[1]])


def test_anchored_windows_against_all_places(spark):
    rng = random.Random(8)
    vocabulary = ["nickel", "matte", "leached", "acid", "of", "Медь", "в", "1300", "a", "sulphuric", "и", "slag"]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 6))), " ".join(rng.choice(vocabulary) + rng.choice(["", ",", " " * rng.randint(0, 150)]) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    rows += [(500, None, "x"), (501, "zinc", None), (502, "leached nickel matte", "The nickel matte was leached in acid.")]
    got = {r.fact_id: (r.coverage, r.span) for r in validation.anchored_windows(spark.createDataFrame(rows, "fact_id long, quote string, text string")).collect()}
    assert got == {k: best_place(t, q) for k, q, t in rows}
