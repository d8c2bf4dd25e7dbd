import json

from factloom.operators import generation, planning, resolution, units

NAMES = [("metal.Ni", "никель", "nickel"), ("process.flotation", "флотация", "flotation"), ("param.recovery", "извлечение", "recovery"), ("param.energy", "энергозатраты", "energy")]


def goals(spark):
    texts = [(1, "Повысить извлечение никеля при флотации на 2,5 п.п., без роста расхода; pH любой"), (2, "Энергозатраты плавки"), (3, ""), (4, None), (5, "Снизить потери никеля на 3 %")]
    mentions = [(1, "param.recovery", "parameter", 9), (1, "metal.Ni", "metal", 20), (1, "process.flotation", "process", 31), (1, "metal.Cu", "metal", 60), (2, "param.energy", "parameter", 0), (5, "metal.Ni", "metal", 14)]
    return planning.parse_goals(spark.createDataFrame(texts, "goal_id long, text string"), spark.createDataFrame(mentions, "goal_id long, entity_id string, type string, start_at long"))


def test_goals(spark):
    got = {r.goal_id: r for r in goals(spark).collect()}
    assert (got[1].target, got[1].process, got[1].metric, got[1].direction, got[1].magnitude) == ("metal.Ni", "process.flotation", "param.recovery", "increase", 2.5)
    assert got[1].constraints == ["без роста расхода"]
    assert (got[2].metric, got[2].direction, got[2].magnitude) == ("param.energy", "decrease", None)
    assert (got[5].direction, got[5].magnitude) == ("decrease", 3.0)
    for k in (3, 4):
        assert (got[k].target, got[k].direction, got[k].magnitude, got[k].constraints) == (None, "increase", None, [])


def test_subqueries(spark):
    got = {}
    for r in planning.subqueries(goals(spark), spark.createDataFrame(NAMES, "entity_id string, name_ru string, name_en string")).orderBy("goal_id", "ord").collect():
        got.setdefault(r.goal_id, []).append(r.subquery)
    assert len(got[1]) == 8 and got[1][1] == "механизмы повышение извлечение никель при флотация" and got[1][-1].startswith("nickel flotation recovery selectivity")
    assert len(got[3]) == 7 and got[2][1] == "механизмы снижение энергозатраты никель при флотация"


def test_small_talk(spark):
    texts = [("Привет", True), ("", True), (None, True), ("что ты умеешь", False), ("спасибо?", False), ("показатели плавки и методы обессоливания воды для фабрики", False), ("спасибо, очень помогли мне разобраться в этом трудном вопросе", True), ("Добрый день, коллеги, рад приветствовать всех на заседании", True)]
    rows = spark.createDataFrame(texts, "t string, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", planning.is_small_talk("t")).collect())


def plans(spark):
    good = {
        "intent": " Compare ", "query_text_ru": "шлак", "filters": {
            "materials": ["Шлак", "неведомо", "шлак "], "processes": "плавка", "equipment": None, "geography": "both", "year_from": "2001", "year_to": "нет", "doc_types": ["patent", ""],
            "numeric": [{"param": "температура", "value_raw": "300", "unit_raw": "K", "operator_raw": "="}, {"param": "температура", "value_raw": "77", "operator_raw": "="}, {"param": "что-то", "value_raw": "300"}, {"param": "", "value_raw": "300"}, {"param": "температура", "value_raw": "300", "unit_raw": "попугай", "operator_raw": "="}]}}
    rows = [(1, "Что при 300 K?", json.dumps(good, ensure_ascii=False)), (2, "вопрос", "{broken"), (3, "q", None), (4, "q", json.dumps({"intent": "dance", "compare_by": "method", "query_text_en": "x", "filters": {"geography": "RU"}}))]
    return planning.coerce_plans(spark.createDataFrame(rows, "plan_id long, question string, payload string"))


def index(spark):
    known = [("mat:slag", "Material", 0, ["шлак"]), ("proc:smelt", "Process", 1, ["плавка"]), ("par:t", "Parameter", 2, ["Температура"])]
    return resolution.alias_index(spark.createDataFrame(known, "entity_id string, label string, ord long, surfaces array<string>"))


def test_plans(spark):
    got = {r.plan_id: r for r in plans(spark).collect()}
    assert (got[1].intent, got[1].compare_by, got[1].geography, got[1].year_from, got[1].year_to, got[1].doc_types) == ("compare", "geography", None, 2001, None, ["patent"])
    assert (got[2].intent, got[2].query_ru, got[2].names) == ("search", "вопрос", []) and got[3].query_ru == "q"
    assert (got[4].intent, got[4].compare_by, got[4].geography, got[4].query_ru) == ("search", "method", "RU", "")


def test_axes_and_numeric_filters(spark):
    got = {r.plan_id: r for r in planning.canonical_axes(plans(spark), index(spark)).collect()}
    assert got[1].ids == {"materials": ["mat:slag"], "processes": ["proc:smelt"]} and got[1].unresolved == ["неведомо"] and got[1].query_ru == "шлак неведомо"
    assert got[2].unresolved == [] and got[2].query_ru == "вопрос"
    kept = {r.ord: r for r in planning.numeric_filters(plans(spark), index(spark), units.seed_units(spark)).collect()}
    assert round(kept[0].value_min, 2) == round(kept[0].value_max, 2) == 26.85 and kept[0].parameter == "par:t" and kept[0].why_dropped is None
    assert [kept[k].why_dropped for k in (1, 2, 3, 4)] == ["number not in the question", "unknown parameter", "no value or parameter", "value or unit unclear"]


def test_start_keys(spark):
    named = spark.createDataFrame([(1, "processes", 0, "b"), (1, "materials", 1, "c"), (1, "materials", 0, "a")], "plan_id long, axis string, ord int, entity_id string")
    conditions = spark.createDataFrame([(1, 0, "p"), (1, 1, "a"), (1, 2, None)], "plan_id long, ord int, parameter string")
    hits = spark.createDataFrame([(1, k, 100 + k) for k in range(12)], "plan_id long, rank long, doc_id long")
    got = [r.node_key for r in planning.start_keys(named, conditions, hits).orderBy("ord").collect()]
    assert got == ["a", "c", "b", "p", *[str(100 + k) for k in range(8)]]


def test_sources(spark):
    answers = spark.createDataFrame([(1, "Так [B 2020; A 2019]. И ещё [X; Y], [нет].")], "plan_id long, answer string")
    keys = spark.createDataFrame([(1, "A 2019", 1), (1, "B 2020", 2), (1, "X; Y", 3), (1, "X", 4)], "plan_id long, cite_key string, doc_id long")
    facts = spark.createDataFrame([(1, k, 10 + k, "q" if k % 2 else None) for k in range(9)] + [(1, 20, 1, "said")], "plan_id long, ord long, doc_id long, quote string")
    docs = spark.createDataFrame([(k, f"t{k:02d}") for k in range(1, 20)], "doc_id long, title string")
    got = planning.sources(answers, keys, facts, docs).orderBy("ord").collect()
    assert [(r.doc_id, r.cited) for r in got] == [(2, True), (1, True), (3, True), (11, False), (13, False), (10, False), (12, False), (14, False)]
    assert got[1].quote == "said" and got[0].quote == ""


ENTITY = "array<struct<entity_id:string,type:string,label:string>>"


def context(spark):
    lime, ph, ni, cmc = ("r.lime", "reagent", "известь"), ("param.pH", "parameter", "pH пульпы"), ("metal.Ni", "metal", "никель"), ("r.cmc", "reagent", "КМЦ")
    flot, ox = ("process.flotation", "process", "флотация"), ("process.oxidation", "process", "окисление")
    rows = [
        (1, "C1", 0, 11, "Извлечение выросло", "с 80 % до 83,5 %", [ni, ph, lime, lime, flot]), (1, "C2", 1, 12, "Механизм: депрессия", "текст", [flot, ni]),
        (1, "C3", 2, 13, "ещё", "текст", [lime, ph]), (1, "C4", 3, 14, "механизм другой", "5 % и 5 %", [ox]), (1, "C5", 4, 15, "q", "t", [cmc]),
    ]
    return spark.createDataFrame(rows, f"goal_id long, citation string, ord int, chunk_id long, quote string, text string, entities {ENTITY}")


def test_candidates(spark):
    links = spark.createDataFrame([(1, 0, "pH", "r.cmc", "КМЦ"), (1, 1, "pH", "r.new", "Новый"), (1, 2, "Eh", "r.none", "Никакой"), (1, 3, "Eh", "r.late", "Поздний")], "goal_id long, ord int, b_label string, c_id string, c_label string")
    grounds = spark.createDataFrame([(1, "r.new", "C9"), (1, "r.late", "C9")], "goal_id long, entity_id string, citation string")
    got = generation.candidates(goals(spark), context(spark), links, grounds).orderBy("hypothesis_id").collect()
    assert [(r.labels, r.citation, r.mechanism, r.is_abc) for r in got] == [(["известь", "pH пульпы"], "C1", "C2", False), (["окисление"], "C4", "C2", False), (["КМЦ"], "C5", "C2", False), (["Новый"], "C9", None, True)]
    assert [r.effect for r in got] == ["+3.5 п.п.", "+2.5 п.п. (целевой ориентир)", "+2.5 п.п. (целевой ориентир)", "+2.5 п.п. (ориентир)"]
    assert got[0].statement == "Применение режима «известь, pH пульпы» повышает извлечения никеля на +3.5 п.п.." and got[0].factors == ["известь", "pH пульпы", "дозировка реагента"]
    assert got[0].citations == ["C1", "C2"] and got[3].via == "pH"
    assert [r.hypothesis_id for r in generation.candidates(goals(spark), context(spark), links, grounds, n=1).collect()] == ["H1", "H2"]


def test_parts_of_scores(spark):
    row = spark.createDataFrame([(["pH", "КМЦ", "время"], "извлечение", "оценить экспериментально", "Снижение извлечения никеля", "рост")], "f array<string>, m string, e string, a string, b string")
    got = row.select(generation.n_controllable("f"), generation.measurable("m", "e"), generation.reports_loss("a"), generation.reports_loss("b")).first()
    assert tuple(got) == (2, 0.5, True, False)


def test_parsed_hypotheses(spark):
    payload = json.dumps({"hypotheses": [{"title": "t", "statements": [{"text": "a", "citation_ids": ["C9", "C2", "C1", "C2"]}, {"text": "b", "citation_ids": ["C8"]}]}, {"title": "u", "statements": [{"text": "c", "citation_ids": []}]}]})
    rows = spark.createDataFrame([(1, payload), (2, "{broken"), (3, None)], "goal_id long, payload string")
    got = [tuple(r) for r in generation.parsed_hypotheses(rows, context(spark)).collect()]
    assert got == [(1, "t", "H1-s1", "a", ["C2", "C1"])]


def test_metadata(spark):
    from factloom.operators import validation

    schema = "doc_id long, file_name string, title string, authors array<string>, year string, doc_type string, language string, geography string, country string"
    rows = [(1, "a/b.c.pdf", " ", ["Ива Н.", " ива н. ", "", None, "B"], " 1999 ", "Patent", "EN", "ru", " "), (2, "x", "T", None, "1799", "poem", None, "foreign", "Чили"), (3, None, None, [], "19.5", None, "de", None, None)]
    got = [tuple(r) for r in validation.coerce_metadata(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()]
    assert got == [(1, "b.c", ["Ива Н.", "B"], 1999, "patent", "en", "RU", None), (2, "T", [], None, "article", "ru", "foreign", "Чили"), (3, None, [], None, "article", "ru", "RU", None)]
