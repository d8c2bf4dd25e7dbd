import random
import re

from factloom.llm import substring_dedup as sd

PASSAGE = "A first sentence with some more words in it. The second sentence goes on and on for a while. A third one ends the passage that many documents share."


SPACE = re.compile("[ \\t\\n\\x0b\\x0c\\r]+")


def plain(text):
    return SPACE.sub(" ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).strip(" ")


def lines_and_paragraphs(text):
    """(start, end, normalised) of every line, and of every block of several lines, in code points; nothing of the operator is used."""
    out, at, block = [], 0, []
    for line in [*text.split("\n"), ""]:
        if plain(line):
            bare = line.strip(" \t\n\x0b\x0c\r")
            start = at + line.index(bare)
            out.append((start, start + len(bare), plain(line)))
            block.append((start, start + len(bare)))
        else:
            if len(block) > 1:
                a, b = block[0][0], block[-1][1]
                out.append((a, b, plain(text[a:b])))
            block = []
        at += len(line) + 1
    return out


def brute_lines(rows):
    """The characters (not white space) that go, by document, of lines and paragraphs alone."""
    first, out = {}, {}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for doc_id, text in ordered:
        for *_, unit in lines_and_paragraphs(text or ""):
            first.setdefault(unit, doc_id)
    for doc_id, text in ordered:
        own, gone = set(), set()
        for a, b, unit in sorted(lines_and_paragraphs(text or ""), key=lambda x: (x[0], x[1])):
            if first[unit] != doc_id or unit in own:
                gone |= {k for k in range(a, b) if not text[k].isspace()}
            own.add(unit)
        out[doc_id] = gone
    return out


def brute(rows):
    """Spans to go by document, from all units in the order of ids and offsets; a null id is the last."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        own, spans = set(), set()
        starts, ends = sd.word_bounds(text or "")
        for a, b, d, whole in sd.units(text or ""):
            if d in own or seen.get(d, doc_id) != doc_id:
                spans.add((a, b, int(starts[a]), int(ends[b - 1]), whole))
            own.add(d)
        for d in own:
            seen.setdefault(d, doc_id)
        out[doc_id] = ",".join(f"{a}:{b}" for a, b, _ in sd.runs(list(spans)))
    return {k: v for k, v in out.items() if v}


def gone_characters(df, texts):
    out = {}
    for r in df.collect():
        spans = [tuple(map(int, x.split(":"))) for x in r.removed_spans.split(",") if x]
        out[r.doc_id] = {k for a, b in spans for k in range(a, b) if not texts[r.doc_id][k].isspace()}
    return out


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=9)) for _ in range(n)]


def test_units():
    text = "short\n" + PASSAGE + "\n\n" + PASSAGE.upper() + "  \nend"
    found = sd.units(text)
    n = len(PASSAGE.split())
    whole = {x[:2] for x in found if x[3]}
    assert whole == {(0, 1), (1, 1 + n), (0, 1 + n), (1 + n, 1 + 2 * n), (1 + 2 * n, 2 + 2 * n), (1 + n, 2 + 2 * n)}
    assert len({d for a, b, d, _ in found if b - a == n}) == 1
    pieces = [x for x in found if not x[3]]
    assert all(sd.PIECE_MIN <= b - a <= sd.PIECE_MAX for a, b, *_ in pieces)
    assert all(x[1] <= y[0] for x, y in zip(pieces, pieces[1:], strict=False))
    assert sd.units("") == [] and [x[:2] for x in sd.units("two words")] == [(0, 2)] and len(sd.units("x" * 100_000 + " a b c")) == 1
    assert all(x[3] for x in sd.units(text, run_words=0))


def test_runs():
    n = sd.RUN_WORDS
    assert sd.runs([(0, n - 1, 0, 9, False)]) == [] and sd.runs([(0, 1, 0, 9, True)]) == [(0, 9, 1)]
    assert sd.runs([(5, n, 7, 9, False), (0, 5, 0, 6, False), (n + 1, 2 * n, 20, 40, False)]) == [(0, 9, 2)]
    assert sd.runs([(0, 4, 0, 9, False), (4, 8, 10, 19, True), (8, 9, 20, 21, False)]) == [(10, 19, 1)]


def test_every_later_line_and_paragraph_goes(spark):
    rng = random.Random(11)
    known = [" ".join(words(rng, n)) for n in (1, 1, 2, 3, 5, 8, 13, 13, 21, 40)]
    rows = []
    for k in range(80):
        lines = [rng.choice([rng.choice(known), rng.choice(known).upper() + " \r", " ".join(words(rng, rng.randint(1, 30))), "", " \t"]) for _ in range(rng.randint(0, 12))]
        rows.append((k, "\n".join(lines)))
    rows += [(100, "\n".join(known[:4]) + "\n\n" + "alone"), (101, "alone\n \n" + known[0] + " " + known[1] + "\n" + known[2] + " " + known[3]), (102, None), (None, "alone")]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_lines(rows)
    assert gone_characters(sd.removals(df, run_words=0), texts) == want
    # Pieces may add to what goes, and never leave a repeated line.
    more = gone_characters(sd.removals(df), texts)
    assert all(want[k] <= more[k] for k in want)


def test_a_shared_line_of_thirteen_words_goes_from_all_but_the_first(spark):
    rng = random.Random(12)
    line = " ".join(words(rng, 13))
    rows = [(k, " ".join(words(rng, 30)) + "\n" + line + "\n" + " ".join(words(rng, 30))) for k in range(5)]
    got = {r.doc_id: (r.n_removed, r.removed_chars) for r in sd.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 0)} | {k: (1, len(line)) for k in range(1, 5)}


def test_removals_against_brute_force(spark, odd, empty):
    rows = [(k, f"Own words of document number {k} stand at its start. {PASSAGE}\nAnd an end of its own for {k}.") for k in range(20)]
    rows += [(30, "Mitten im Satz " + PASSAGE), (31, PASSAGE + "\n" + PASSAGE), (32, None), (33, ""), (2**63 - 1, PASSAGE), (None, PASSAGE)]
    got = {r.doc_id: r.removed_spans for r in sd.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {k: v for k, v in got.items() if v} == brute(rows) and len(got) == len(rows) and not got[0] and got[2**63 - 1] and got[None]
    assert sd.removals(odd).count() == odd.count() and sd.removals(empty).count() == 0


def test_ids_of_text_and_null_ids(spark):
    rows = [("b", PASSAGE), ("a", PASSAGE + " x"), (None, PASSAGE), (None, PASSAGE + " y")]
    got = sorted((r.doc_id or "", r.removed_chars > 0) for r in sd.removals(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("", True), ("", True), ("a", False), ("b", True)]
    unknown = [r.removed_chars for r in sd.removals(spark.createDataFrame(rows[2:], "doc_id string, text string")).collect()]
    assert unknown == [0, 0]


def test_a_very_common_passage(spark, hot):
    longer = " ".join(words(random.Random(1), 60))
    rows = [(k, f"number {k} {longer} and on") for k in range(60)]
    got = {r.doc_id: r.removed_spans for r in sd.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {k: v for k, v in got.items() if v} == brute(rows) and sum(map(bool, got.values())) == 59


def test_passages_however_they_are_broken():
    rng = random.Random(9)

    def lines(flat, n, end="\n"):
        return end.join(" ".join(flat[k : k + n]) for k in range(0, len(flat), n))

    found = []
    for shape in (" ".join, lambda x: lines(x, 4), lambda x: lines(x, 3, ". "), lambda x: lines(x, 1), lambda x: lines(x, 40)):
        for _ in range(40):
            passage = shape(words(rng, 55))
            rows = [(k, " ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30))) for k in range(2)]
            gone = brute(rows)
            start = rows[1][1].index(passage)
            spans = [tuple(map(int, x.split(":"))) for x in gone.get(1, "").split(",") if x]
            assert 0 not in gone and all(start <= a and b <= start + len(passage) for a, b in spans)
            found.append(sum(b - a for a, b in spans) / len(passage))
    assert sum(x > 0.5 for x in found) >= 0.98 * len(found) and sum(found) > 0.75 * len(found)


def test_short_repeats_within_lines_stay():
    rng = random.Random(3)
    phrase = "this short phrase stands in every one of the documents"
    rows = [(k, " ".join(words(rng, 40)) + " " + phrase + " " + " ".join(words(rng, 40))) for k in range(50)]
    assert brute(rows) == {}
    assert brute([(1, "word " * 400)])[1].endswith(str(len("word " * 400) - 1))


def test_what_stays_can_be_traced(spark, odd):
    for r in sd.remove_repeats(odd).where("doc_id = 12").collect():
        assert r.text.count("a same line") == 1
    original = {}
    for r in odd.collect():
        original.setdefault(r.doc_id, []).append(r.text or "")
    for r in sd.remove_repeats(odd).collect():
        assert r.text in ["".join(text[s.start_at : s.end_at] for s in r.spans) for text in original[r.doc_id]]
