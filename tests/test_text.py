import random

from factloom.functions import chunking, names, text
from factloom.sources import files


def one(spark, expr, *values):
    schema = ", ".join(f"c{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(expr.alias("x")).first().x


def test_normalising(spark):
    assert one(spark, text.normalize_text("c0"), " a b \r\nc\t\r\n\r\n\r\n \n\nd  ") == "a b\nc\n\nd"


def test_greedy_chunks_keep_budget_and_overlap():
    paragraphs = [f"Абзац номер {k}. " + "Слово за словом идёт дальше. " * 12 for k in range(20)]
    chunks = chunking.greedy_chunks("\n\n".join(paragraphs), 300, 40)
    assert len(chunks) > 5 and all(len(c) // 3 <= 300 + 2 for c in chunks)
    for before, after in zip(chunks, chunks[1:], strict=False):
        assert after.split("\n\n")[0] in before
    assert chunking.greedy_chunks("short") == ["short"] and chunking.greedy_chunks("  ") == []
    whole = "x" * 4000
    assert "".join(chunking.greedy_chunks(whole, 300, 0)).replace("\n\n", "") == whole


def lines_of(spark, rows):
    return chunking.linear_tables(spark.createDataFrame([(1, rows)], "id long, rows array<array<string>>")).first().text


def test_tables(spark):
    assert lines_of(spark, [["", "Cu+Ni", "Pd"], ["Low", "3,14-7,24", "16,0"], ["High", "", "9"]]) == "Low: Cu+Ni = 3,14-7,24; Pd = 16,0.\nHigh: Pd = 9."
    assert lines_of(spark, [["a", None, "b"]]) == "a | b" and lines_of(spark, []) == ""
    assert lines_of(spark, [["", "Mass", "Mass"], ["", "Cu", "Ni"], ["Slag", "1", "2"]]) == "Slag: Mass, Cu = 1; Mass, Ni = 2."
    assert lines_of(spark, [["x", "y"], ["1", "2", "3"], [" ", None], ["4"], ["x", "y"]]) == "x = 1; y = 2.\nx = 4.\nx | y"
    assert lines_of(spark, [["", "t"], ["", "5"], ["a", ""]]) == "строка: t = 5.\na"


def snippet_of(spark, body, words, **options):
    return chunking.snippets(spark.createDataFrame([(1, body, words)], "doc_id long, text string, words array<string>"), **options).first().snippet


def brute_snippet(body, words, budget, margin=600):
    """Marks every character near a first place, word by word until the budget is full."""
    if len(body) <= budget:
        return body
    shown = set()
    for w in words:
        at = body.lower().find(w)
        if at >= 0 and len(shown) < budget:
            shown |= set(range(max(0, at - margin), min(len(body), at + len(w) + margin)))
    parts, before = [], None
    for k in sorted(shown)[:budget]:
        if before != k - 1:
            parts.append("")
        parts[-1] += body[k]
        before = k
    return "\n[...]\n".join(parts) or body[:budget]


def test_snippets_join_windows(spark):
    body = "a" * 2000 + " needle " + "b" * 100 + " thread " + "c" * 3000 + " needle "
    got = snippet_of(spark, body, ["needle", "thread"])
    assert "needle" in got and "thread" in got and len(got) <= 1500 + 10
    assert snippet_of(spark, body, ["nothing"]) == body[:1500] and snippet_of(spark, "short", ["x"]) == "short"
    assert snippet_of(spark, None, ["x"]) == "" and snippet_of(spark, body, []) == body[:1500]


def test_snippets_against_marked_characters(spark):
    rng = random.Random(4)
    marks = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = []
    for k in range(60):
        text = "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 6000)))
        for m in marks:
            at = rng.randint(0, len(text))
            text = text[:at] + (m if rng.random() < 0.8 else "") + text[at:]
        rows.append((k, text, rng.sample(marks, rng.randint(0, 5))))
    got = {r.doc_id: r.snippet for r in chunking.snippets(spark.createDataFrame(rows, "doc_id long, text string, words array<string>")).collect()}
    assert got == {k: brute_snippet(t, w, 1500) for k, t, w in rows}


def test_chunks_begin_with_whole_sentences():
    assert chunking.carried_over("One. Two is here. Three.", 3) == "Three."
    assert chunking.carried_over("One. Two.", 100) == "One. Two." and chunking.carried_over("One.", 0) == ""
    assert chunking.carried_over("x" * 50, 5) == "x" * 15


def test_names(spark):
    assert one(spark, names.slug("c0"), "Щёлочь  и Ёж") == "scheloch-i-ezh" and one(spark, names.slug("c0"), "—").startswith("x-")
    assert one(spark, names.cite_key("c0", "c1"), ["К.Т.Н. ТРОФИМОВ А.В."], 2020) == "Трофимов 2020"
    assert one(spark, names.surname("c0"), [" "]) == "Без автора"
    assert tuple(one(spark, names.person_key("c0"), "А.П. Иванов")) == tuple(one(spark, names.person_key("c0"), "Иванов А.П.")) == ("cyr", "иванов", "ап")
    assert tuple(one(spark, names.person_key("c0"), "Butcher, Alan R.")) == ("lat", "butcher", "ar")
    assert one(spark, names.person_key("c0"), "ООО Завод") is None
    assert one(spark, names.normalize_name(names.nfc("c0")), "Ёлка   X") == "елка x"


def test_corpus_reading(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    body = "Text of the body that is long enough to be taken into the corpus, with words and more words, and then some more of them."
    (tmp_path / "a_report_en_2019.txt").write_text(f"---\ntitle: \"A: b\"\nyear: 2001\n---\n{body}", encoding="utf-8")
    (tmp_path / "sub" / "b_patent_2011.md").write_text(body, encoding="utf-8")
    (tmp_path / "~$c.md").write_text(body, encoding="utf-8")
    (tmp_path / "d.md").write_text("short", encoding="utf-8")
    docs = files.parse_documents(files.read_corpus(spark, str(tmp_path)))
    got = {r.title: (r.doc_type, r.lang, r.year) for r in docs.collect()}
    assert got == {"A: b": ("report", "en", 2001), "b_patent_2011": ("patent", "en", 2011)}
    assert files.first_of_each_content(docs).count() == 1
    files.save_index(docs, docs, str(tmp_path / "index"))
    assert files.load_index(spark, str(tmp_path / "index"))[0].count() == 2


def test_extractions_and_audit(spark):
    rows = [(1, '{"relations":[{"type":"uses","from":"a","to":"b"},{"type":"odd","from":"a","to":"b"}]}'), (2, "{broken")]
    good, dropped = files.read_extractions(spark.createDataFrame(rows, "doc_id long, payload string"), {"uses": "USES_MATERIAL"})
    assert [r.rel_type for r in good.collect()] == ["USES_MATERIAL"] and {r.type: r.n_dropped for r in dropped.collect()} == {"odd": 1, "_corrupt": 1}
    lines = spark.createDataFrame([(1, '{"role":"a"}'), (2, "oops"), (3, '{"role":"b"}'), (4, '{"role":"c"}')], "seq long, value string")
    assert [r.role for r in files.audit_tail(lines, "role string", 2).collect()] == ["b", "c"]


def test_json_ld(spark):
    import json

    nodes = spark.createDataFrame([("a", "Material", "Slag"), ("b", "Process", None)], "node_key string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "PRODUCES"), ("a", "c", "PRODUCES"), ("a", "b", "ABOUT")], "src_key string, dst_key string, rel_type string")
    got = {r.node_key: json.loads(r.document) for r in files.json_ld(nodes, edges, "urn:").collect()}
    assert got["a"] == {"@id": "urn:a", "@type": "Material", "name": "Slag", "ABOUT": "urn:b", "PRODUCES": ["urn:b", "urn:c"]} and got["b"] == {"@id": "urn:b", "@type": "Process"}


def test_a_lone_initial_of_the_other_alphabet_is_folded(spark):
    # The initial is a Latin A in the first and a Cyrillic one in the second.
    assert tuple(one(spark, names.person_key("c0"), "Иванов A.П.")) == tuple(one(spark, names.person_key("c0"), "Иванов А.П.")) == ("cyr", "иванов", "ап")
    assert tuple(one(spark, names.person_key("c0"), "Smith А.")) == ("lat", "smith", "а")
