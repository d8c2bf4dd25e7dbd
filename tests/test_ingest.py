import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.tolerant_json import repair
from factloom.operators import lemmas, resolution, units
from factloom.sources import files, yaml_tables

WHOLE = '{"entities":[{"type":"m","name":"a, \\"b\\" ]}","quote":"x"}],"relations":[{"type":"A","from":"1","to":"{2}"},{"type":"B","from":"3","n":{"k":[1,{"z":null}]}},{"type":"C"}],"x":-1.5e3}'


def test_every_cut_keeps_every_whole_relation():
    relations = json.loads(WHOLE)["relations"]
    # Where each relation ends in the text.
    ends, at = [], WHOLE.index('"relations":[') + len('"relations":[')
    for r in relations:
        at += len(json.dumps(r, separators=(",", ":")))
        ends.append(at)
        at += 1
    for cut in range(len(WHOLE) + 1):
        value, closed, commas, lost = repair(WHOLE[:cut])
        held = json.loads(value).get("relations", []) if value else []
        assert held == [r for r, end in zip(relations, ends, strict=True) if end <= cut], cut
        assert 0 <= lost <= cut and (closed == 0) == (cut in (0, len(WHOLE))), cut


@pytest.mark.parametrize("text, want", [
    ('```json\n{"a":[1,2,],}\n``` bye', ('{"a":[1,2]}', 0, 2, 16)), ("[,1,,2,]", ("[1,2]", 0, 3, 0)), ("no", (None, 0, 0, 2)), ("", (None, 0, 0, 0)), ('{"a":{"b":1,"c"', ('{"a":{"b":1}}', 2, 0, 4)),
    ('{"a":[{"x":1},{"x":', ('{"a":[{"x":1}]}', 2, 0, 6)), ('{"a":1 "b":2}', ('{"a":1}', 1, 0, 7)), ('{"a":tru', ("{}", 1, 0, 7)), ("[1]]", ("[1]", 0, 0, 1)), ('{"a":"\n"}', ('{"a":"\n"}', 0, 0, 0)), ("[[1,2],[3", ("[[1,2]]", 1, 0, 3)),
])
def test_repairs(text, want):
    assert repair(text) == want


def test_valid_json_stays_as_it_is():
    rng = random.Random(3)

    def made(depth):
        kind = rng.randint(0, 5 if depth else 3)
        if kind > 3:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {rng.choice("abc,{") + str(k): made(depth - 1) for k in range(rng.randint(0, 3))}
        return [None, True, rng.randint(-99, 99) / 7, 'q"\\ü]'][kind]

    for _ in range(300):
        value = [made(4)]
        text, *counts = repair(json.dumps(value, indent=rng.choice([None, 1])))
        assert json.loads(text) == value and counts == [0, 0, 0]


def test_repaired_payloads(spark):
    rows = spark.createDataFrame([(1, WHOLE), (2, WHOLE[:-40]), (3, None), (4, "sorry"), (5, '{"relations":[{"type":"A"},{"type":"?"}')], "doc_id long, payload string")
    relations, dropped = files.read_extractions(rows, {"A": "X", "B": "Y", "C": "Z"}, tolerant=True)
    assert sorted((r.doc_id, r.rel_type) for r in relations.collect()) == [(1, "X"), (1, "Y"), (1, "Z"), (2, "X"), (5, "X")]
    assert dict(map(tuple, dropped.collect())) == {"?": 1, "_corrupt": 2, "_cut": 2}


TEXT = """\
# a comment
categories:
  temperature:   # of something
    canonical_unit: "°C"
    abs_delta: 2.0
  money:
    canonical_unit: руб/т
    abs_delta: null
units:
  "мг # л": {category: temperature, multiplier: 1.5, offset: -3}
  с: {category: money,
      multiplier: 2}     # over two lines
  'it''s': {category: money}
list:
- one
- {entity_id: a.b, synonyms: ["x, y", 'z', w], none: }
-
  - nested
  - "two\\n lines"
- key: v:w
  other: [a,
          b]
text: |
  first # no comment

   second
folded: >-
  a
  b
empty:
last: "#"
"""


def test_yaml_leaves():
    got = {"/".join(p): v for p, v, _ in yaml_tables.leaves(TEXT)}
    assert got == {
        "categories/temperature/canonical_unit": "°C", "categories/temperature/abs_delta": "2.0", "categories/money/canonical_unit": "руб/т", "categories/money/abs_delta": None,
        "units/мг # л/category": "temperature", "units/мг # л/multiplier": "1.5", "units/мг # л/offset": "-3", "units/с/category": "money", "units/с/multiplier": "2", "units/it's/category": "money",
        "list/0": "one", "list/1/entity_id": "a.b", "list/1/synonyms/0": "x, y", "list/1/synonyms/1": "z", "list/1/synonyms/2": "w", "list/1/none": None, "list/2/0": "nested", "list/2/1": "two\n lines",
        "list/3/key": "v:w", "list/3/other/0": "a", "list/3/other/1": "b", "text": "first # no comment\n\n second\n", "folded": "a b", "empty": None, "last": "#",
    }
    assert yaml_tables.leaves("") == [] and yaml_tables.leaves("# only\n") == [] and yaml_tables.leaves("[1, 2]") == [(["0"], "1", False), (["1"], "2", False)]
    for broken in ("a: [1", 'a: "x', "a: &b 1", "a:\n   b: 1\n  c: 2", "just words\nmore: 1"):
        with pytest.raises(ValueError):
            yaml_tables.leaves(broken)


def test_yaml_tables(spark, tmp_path):
    (tmp_path / "units.yaml").write_text(TEXT)
    (tmp_path / "broken.yaml").write_text("a: [1")
    (tmp_path / "glossary.yaml").write_text("nickel:\n  label: Material\n  ru: [никель, ni]\n  en: [nickel]\nslag:\n  label: Material\n  en: slag\n")
    (tmp_path / "ontology.yaml").write_text('entities:\n  # metals\n  - {entity_id: metal.Ni, type: metal,\n     synonyms: ["никель", Ni]}\n  - entity_id: p.ph\n    type: parameter\n    synonyms:\n    - pH\n')
    read = lambda name: yaml_tables.read_yaml(spark, str(tmp_path / f"{name}.yaml"))
    table = yaml_tables.units_of(read("units"))
    assert sorted(map(tuple, table.collect())) == [("it's", "money", 1.0, 0.0, "руб/т", None), ("мг # л", "temperature", 1.5, -3.0, "°C", 2.0), ("с", "money", 2.0, 0.0, "руб/т", None)]
    assert [(r.path, r.value, r.error) for r in read("broken").collect()] == [(None, None, "a bracket is not closed")]
    rows = spark.createDataFrame([("10", "мг # л", None), ("3", "С", "<")], "value_raw string, unit_raw string, operator_raw string")
    assert sorted((r.interval.value_min or 0, r.interval.value_max, r.interval.unit_canon) for r in units.parse_measurements(rows, table).collect()) == [(0, 6.0, "руб/т"), (12.0, 12.0, "°C")]
    terms = yaml_tables.glossary_of(read("glossary"))
    assert sorted((r.term_id, r.label, r.name, r.aliases) for r in terms.collect()) == [("nickel", "Material", "никель", ["ni", "nickel"]), ("slag", "Material", "slag", [])]
    entities = spark.createDataFrame([("mat-1", "Material", 0, "NI", [])], "entity_id string, label string, ord long, name string, aliases array<string>")
    assert {r.entity_id: r.name for r in resolution.glossary_merge(entities, terms).collect()} == {"mat-1": "NI", "slag": "slag"}
    assert sorted(map(tuple, yaml_tables.ontology_of(read("ontology")).collect())) == [("metal.Ni", "metal", "Ni"), ("metal.Ni", "metal", "никель"), ("p.ph", "parameter", "pH")]


# Stems of nouns by paradigm: the endings of nominative, genitive, dative, instrumental and prepositional, singular and plural.
NOUNS = {
    "masc": (["штейн", "кобальт", "раствор", "электролит", "процесс", "реактор", "концентрат", "металл", "анод", "катод", "шлам", "агломерат", "конвертер", "сорбент", "состав", "расход", "выход", "режим", "фильтр", "барабан"], ["", "а", "у", "ом", "е", "ы", "ов", "ам", "ами", "ах"]),
    "femn": (["плавк", "добавк", "переработк", "отсадк", "промывк", "загрузк", "выгрузк", "обработк", "сушк", "марк", "установк", "очистк", "проверк", "пробк"], ["а", "и", "е", "ой", "ам", "ами", "ах"]),
    "neut": (["извлечени", "обогащени", "выщелачивани", "содержани", "осаждени", "восстановлени", "давлени", "растворени", "окислени", "разделени", "испытани", "оборудовани"], ["е", "я", "ю", "ем", "й", "ям", "ями", "ях"]),
}
ADJECTIVES = ["катодн", "анодн", "сульфидн", "медн", "автоклавн", "кислотн", "обратн", "черн", "водн", "основн", "шахтн", "печн", "газов", "рудн", "насосн", "опытн"]
OF_ADJECTIVES = ["ый", "ого", "ому", "ым", "ом", "ая", "ой", "ую", "ое", "ые", "ых", "ыми"]
BASES = {"masc": "ый", "femn": "ая", "neut": "ое"}


def forms():
    """word, lemma, tag, gender and the number of the stem."""
    for gender, (stems, endings) in NOUNS.items():
        yield from ((s + e, s + endings[0], "NOUN", gender, n) for n, s in enumerate(stems) for e in endings)
    for n, s in enumerate(ADJECTIVES):
        yield from ((s + e, s + b, "ADJF", g, n) for e in OF_ADJECTIVES for g, b in BASES.items())


def test_lemmas_of_words_held_out(spark):
    rows = [*forms()]
    schema = "word string, lemma string, tag string, gender string"
    known = spark.createDataFrame([r[:4] for r in rows if r[4] % 3], schema)
    held = {(r[0], r[3]): r for r in rows if r[4] % 3 == 0}
    rules = lemmas.learn(known)
    asked = spark.createDataFrame(sorted({(w,) for w, _ in held}), "word string")
    got = lemmas.lemmas(asked, rules).collect()
    nouns = [r for r in got if (r.word, r.gender) in held and held[r.word, r.gender][2] == "NOUN"]
    right = sum(held[r.word, r.gender][1] == r.lemma for r in got if (r.word, r.gender) in held)
    asked_nouns = {w for (w, _), r in held.items() if r[2] == "NOUN"}
    assert right >= 0.9 * len(held) and len({r.word for r in nouns}) >= 0.9 * len(asked_nouns)
    # What the table holds comes from it, and an unknown ending leaves the word.
    more = lemmas.lemmas(spark.createDataFrame([("кобальтом",), ("xyz",), ("",), (None,)], "word string"), rules, known)
    assert sorted((r.word, r.lemma) for r in more.collect()) == [("xyz", "xyz"), ("кобальтом", "кобальт")]


def test_phrases_agree_with_their_head(spark):
    known = spark.createDataFrame([r[:4] for r in forms()], "word string, lemma string, tag string, gender string")
    said = {
        "катодного штейна": "катодный штейн", "Сульфидных добавками": "сульфидная добавка", "автоклавным выщелачиванием никеля": "автоклавное выщелачивание никеля", "переработке медного концентрата": "переработка медного концентрата",
        "КПП анодов": "КПП анод", "Fe-Ni шламы": "Fe-Ni шлам", "никеля": "никеля", "": "", "рудных газовых водных шахтных основных печных установок": "рудных газовых водных шахтных основных печных установок",
    }
    phrases = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "phrase_id long, name string")
    words = phrases.select(F.explode(F.split(F.lower("name"), " ")).alias("word")).where("word <> 'никеля' AND word <> 'установок'")
    got = {r.name: r.base for r in lemmas.base_phrases(phrases, lemmas.lemmas(words, lemmas.learn(known), known)).collect()}
    assert got == said


def test_an_import_and_the_next_one(spark, tmp_path):
    from factloom.operators.importing import import_corpus

    root = tmp_path / "corpus"
    (root / "below").mkdir(parents=True)
    body = "Nickel matte is leached in sulphuric acid at 80 °C for two hours under oxygen pressure, and copper stays. "
    (root / "a.md").write_text("---\ntitle: First\nyear: 2020\n---\n" + body)
    (root / "below" / "b.txt").write_text(body + "Cobalt follows nickel.")
    (root / "copy.txt").write_text(body + "Cobalt follows nickel.")
    (root / "short.txt").write_text("too short")
    (root / "~$a.md").write_text(body)
    dictionary = spark.createDataFrame([("ni", "metal", "nickel"), ("co", "metal", "cobalt"), ("m", "material", "nickel matte")], "entity_id string, type string, name string")
    first = import_corpus(spark, str(root), dictionary)
    report = dict(map(tuple, first.report.collect()))
    assert report == {"files": 4, "parsed": 3, "contents": 2, "written": 2, "stored chunks": 2, "stored mentions": 4}
    assert sorted((r.title, r.year) for r in first.tables["sources"].collect()) == [("First", 2020), ("b", None)]
    assert sorted(r.entity_id for r in first.tables["mentions"].collect()) == ["co", "m", "m", "ni"]
    # One file changes, the others are skipped and keep what they have.
    (root / "a.md").write_text("---\ntitle: Second\n---\n" + body.replace("Nickel", "Cobalt"))
    second = import_corpus(spark, str(root), dictionary, first.tables)
    report = dict(map(tuple, second.report.collect()))
    assert report == {"files": 4, "parsed": 3, "contents": 2, "written": 1, "stored chunks": 2, "stored mentions": 4}
    assert sorted(r.title for r in second.tables["sources"].collect()) == ["Second", "b"]
    assert sorted(r.entity_id for r in second.tables["mentions"].collect()) == ["co", "co", "m", "ni"]
