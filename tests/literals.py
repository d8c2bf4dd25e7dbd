"""Operators on small tables that stand here whole, with the rows they must give written out by hand.

They show rules that no column of the star schema exercises: names, reviews,
glossaries, exports and reports. The SQL of each is the list of its expected rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names, numbers, text
from factloom.operators import access, analytics, filters, generation, graph, hypotheses, mutation, planning, resolution, retrieval, units, validation
from factloom.operators import names as names_in_texts
from factloom.plans.registry import Catalogue
from factloom.sources import files

CATALOGUE = Catalogue()

_TYPES = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _value(x: object) -> str:
    return "NULL" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x).lower()


def gives(schema: str, *rows: tuple) -> Callable:
    """Registers a query that takes only a session and must give these rows; a single column may be given without a tuple."""
    columns = [c.split() for c in schema.split(", ")]
    listed = [r if isinstance(r, tuple) else (r,) for r in rows]
    values = ", ".join("(" + ", ".join(f"CAST({_value(x)} AS {_TYPES[t]})" for x, (_, t) in zip(r, columns, strict=True)) + ")" for r in listed)
    sql = f"SELECT * FROM (VALUES {values}) t({', '.join(c for c, _ in columns)})"

    def register(f: Callable[[SparkSession], DataFrame]) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark)

        query.__name__, query.__doc__ = f.__name__, f.__doc__
        CATALOGUE.add(sql)(query)
        return query

    return register


def _joined(column: str) -> F.Column:
    return F.array_join(column, "|")


@gives("n_tokens long, cut string, quoted string, marked string", (6, "alpha beta…", "alpha beta gamma", "Никелевый"))
def text_helpers(spark: SparkSession) -> DataFrame:
    one = spark.createDataFrame([("alpha beta gamma del", "alpha beta gamma", "Никелевый штейн", "никель и медь")], "a string, b string, t string, s string")
    return one.select(text.estimate_tokens("a").alias("n_tokens"), text.truncate("a", 13).alias("cut"), text.quote("b", 16).alias("quoted"), _joined(text.highlighted("t", "s")).alias("marked"))


@gives("id long, is_data boolean", (1, True), (2, False), (3, False))
def table_check(spark: SparkSession) -> DataFrame:
    rows = [(1, [["T", "pH"], ["20", "7"], ["30", "8"]]), (2, [["T", "pH"], ["20", "7"]]), (3, [["a", "b"], ["c", "d"], ["e", "f"]])]
    return spark.createDataFrame(rows, "id long, rows array<array<string>>").select("id", text.table_is_data("rows").alias("is_data"))


@gives("path string, relative string", ("/data/corpus/a/b.pdf", "a/b.pdf"), ("/x/corpus/corpus/c.md", "c.md"), ("plain.txt", "plain.txt"))
def corpus_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("/data/corpus/a/b.pdf",), ("/x/corpus/corpus/c.md",), ("plain.txt",)], "path string").select("path", text.corpus_path("path").alias("relative"))


@gives("x double, shown string", (0.0, "0"), (5.5, "5.5"), (100000.0, "100000"), (1234567.0, "1.23457e+06"), (0.00001, "1e-05"), (3.14159265, "3.14159"), (-2.5, "-2.5"), (999999.7, "1e+06"))
def short_numbers(spark: SparkSession) -> DataFrame:
    xs = [(x,) for x in (0.0, 5.5, 100000.0, 1234567.0, 0.00001, 3.14159265, -2.5, 999999.7)]
    return spark.createDataFrame(xs, "x double").select("x", numbers.short_number(F.col("x")).alias("shown"))


@gives("t string, delta double", ("с 80 % до 83,5 %", 3.5), ("5 % и 5 %", 0.0), ("только 7 %", None))
def percent_deltas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("с 80 % до 83,5 %",), ("5 % и 5 %",), ("только 7 %",)], "t string").select("t", numbers.percent_points("t").alias("delta"))


@gives("id long, lo double, hi double", (1, 200.0, 300.0), (2, 1.5, 2.5), (3, -40.0, -40.0), (4, None, 5.0), (5, 10.0, None), (6, 9.0, 11.0), (7, 200.0, 200.0), (8, 1500.0, 1500.0))
def value_texts(spark: SparkSession) -> DataFrame:
    """Ranges in words, dots and dashes, a lone negative number, comparisons, about, and `=` before a range."""
    rows = [(1, "от 200 до 300", ""), (2, "1,5..2,5", None), (3, "-40", ""), (4, "5", "<="), (5, "10", ">"), (6, "10", "~"), (7, "200–300", "="), (8, "1 500", "=")]
    read = spark.createDataFrame(rows, "id long, v string, op string").select("id", numbers.raw_interval("v", "op").alias("i"))
    return read.select("id", "i.lo", "i.hi")


@gives("unit string, canonical_unit string, multiplier double", ("мг", "г", 0.001), ("миллиграмм", "г", 0.001), ("г", "г", 1.0), ("т", "г", 1000000.0), ("new", "new", 1.0), ("kilonew", "new", 1000.0))
def units_full(spark: SparkSession) -> DataFrame:
    """A table of units from a JSON file with aliases, and approved proposals, of a new category too."""
    from factloom.shipping import fresh_folder

    path = fresh_folder(spark, "units")
    document = '{"category": "mass", "canonical_unit": "г", "units": [{"unit": "мг", "aliases": ["миллиграмм", "мг"], "multiplier": 0.001}, {"unit": "т", "multiplier": 1000000.0}]}'
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(path)
    proposals = spark.createDataFrame([("new", "novelty", 1.0, 0.0), ("kilonew", "novelty", 1000.0, 0.0), ("мг", "mass", 9.0, 0.0)], "unit string, category string, multiplier double, offset double")
    return units.extend_units(units.read_unit_groups(spark, path), proposals).select("unit", "canonical_unit", "multiplier")


@gives("fact_id long, needs_review boolean, review_reason string, value_min double", (1, False, None, 5000.0), (2, True, "quote not in the text", 5000.0), (3, False, None, 1.0))
def unit_repair(spark: SparkSession) -> DataFrame:
    schema = "fact_id long, value_raw string, unit_raw string, operator_raw string, needs_review boolean, review_reason string, value_min double, value_max double, unit_canon string"
    rows = [(1, "5", "г/л", "=", True, "unknown unit: г/л", None, None, None), (2, "5", "г/л", "=", True, "unknown unit: г/л; quote not in the text", None, None, None), (3, "1", "%", "=", False, None, 1.0, 1.0, "%")]
    return units.repair_units(spark.createDataFrame(rows, schema), units.seed_units(spark)).select("fact_id", "needs_review", "review_reason", "value_min")


@gives("id long, composed boolean, key string", (1, True, "мокрыи й"), (2, True, "елка"), (3, True, "plain"))
def name_keys(spark: SparkSession) -> DataFrame:
    rows = [(1, "Мокрыи й", "Мокрыи й"), (2, " Ё лка".replace(" ", ""), " Ёлка"), (3, "Plain", "Plain")]
    return spark.createDataFrame(rows, "id long, n string, c string").select("id", (names.nfc("n") == names.nfc("c")).alias("composed"), names.normalize_name(names.nfc("n")).alias("key"))


@gives("name string, alphabet string, surname string, initials string", ("Иванов И.П.", "cyr", "иванов", "ип"), ("И. П. Ивaнов", "cyr", "иванов", "ип"), ("Smith John", "lat", "smith", "j"), ("ООО Ромашка", None, None, None), ("A. B.", None, None, None), ("Иванов", None, None, None))
def person_keys(spark: SparkSession) -> DataFrame:
    """A Latin a in a Cyrillic surname is folded; organisations, initials alone and single words are no persons."""
    given = [(n,) for n in ("Иванов И.П.", "И. П. Ивaнов", "Smith John", "ООО Ромашка", "A. B.", "Иванов")]
    return spark.createDataFrame(given, "name string").select("name", names.person_key("name").alias("k")).select("name", "k.alphabet", "k.surname", "k.initials")


_ENTITIES = "entity_id string, label string, ord long, name string, aliases array<string>"


def _index(spark: SparkSession) -> DataFrame:
    known = [("mat:slag", "Material", 0, ["шлак", "шлаки"]), ("proc:smelt", "Process", 1, ["плавка"]), ("mat:nickel", "Material", 2, ["никель", "Ni"])]
    return resolution.alias_index(spark.createDataFrame(known, "entity_id string, label string, ord long, surfaces array<string>"))


@gives("mention_id long, entity_id string", (1, "mat:slag"), (2, "mat:slag"), (3, "mat:nickel"), (4, None), (5, None))
def lemma_lookup(spark: SparkSession) -> DataFrame:
    """By surface, by the base form that a dictionary gives, by the other script, not at all, and not under another label."""
    asked = spark.createDataFrame([(1, "Material", "ШЛАК"), (2, "Material", "шлаком"), (3, "Material", "nikel"), (4, "Material", "медь"), (5, "Process", "шлак")], "mention_id long, label string, name string")
    lemmas = spark.createDataFrame([("шлаком", "шлак"), ("медью", "медь")], "word_key string, lemma_key string")
    return resolution.lookup(asked, _index(spark), lemmas).select("mention_id", "entity_id")


@gives("entity_id string, name string, aliases string", ("mat:1", "шлак", "slag|отвал"), ("mat:2", "никель", "Ni|nickel"), ("mat:9", "медь", "медь|Cu"))
def glossary_merge(spark: SparkSession) -> DataFrame:
    """By id, by any surface, else a new entity; names that are there stay."""
    own = spark.createDataFrame([("mat:1", "Material", 0, "шлак", ["slag"]), ("mat:2", "Material", 1, None, ["Ni"])], _ENTITIES)
    terms = [("mat:1", "Material", "slag", ["отвал"]), ("t:x", "Material", "никель", ["nickel", "ni"]), ("mat:9", "Material", "медь", ["Cu"])]
    merged = resolution.glossary_merge(own, spark.createDataFrame(terms, "term_id string, label string, name string, aliases array<string>"))
    return merged.select("entity_id", "name", F.array_join(F.when(F.col("entity_id") == "mat:2", F.filter("aliases", lambda a: a != "никель")).otherwise(F.col("aliases")), "|").alias("aliases"))


@gives("mention_id long, entity_id string", (1, "e1"), (2, "e3"))
def fulltext_fallback(spark: SparkSession) -> DataFrame:
    """A curated entity before an unresolved one of the same name; only exact names are taken, deleted ones never."""
    known = [("e0", "Material", ["медный концентрат"], True, False), ("e1", "Material", ["Медный  концентрат"], False, False), ("e2", "Material", ["медный концентрат богатый"], False, False), ("e3", "Material", ["хвосты"], True, False), ("e4", "Material", ["штейн"], False, True)]
    asked = spark.createDataFrame([(1, "Material", "медный концентрат"), (2, "Material", "Хвосты"), (3, "Material", "штейн"), (4, "Material", "концентрат"), (5, "Process", "хвосты")], "mention_id long, label string, name string")
    return resolution.text_fallback(asked, spark.createDataFrame(known, "entity_id string, label string, surfaces array<string>, unresolved boolean, deleted boolean"))


@gives("victim_id string, survivor_id string", ("u1", "mat:slag"), ("u2", "mat:nickel"))
def synonym_merge(spark: SparkSession) -> DataFrame:
    rows = [("u1", "Material", ["отходы", "Шлаки"]), ("u2", "Material", ["nikel"]), ("u3", "Material", ["неведомо"]), ("mat:slag", "Material", ["шлак"])]
    return resolution.synonym_merges(spark.createDataFrame(rows, "entity_id string, label string, surfaces array<string>"), _index(spark))


@gives("doc_id long, name string", (1, "Шлак"), (1, "pH"), (2, "шлак"))
def first_in_document(spark: SparkSession) -> DataFrame:
    rows = [(1, "Material", "Шлак", 0), (1, "Material", "шлак ", 1), (1, "Parameter", "pH", 2), (1, "Parameter", "-", 3), (2, "Material", "шлак", 0)]
    return resolution.first_in_document(spark.createDataFrame(rows, "doc_id long, type string, name string, ord long")).select("doc_id", "name")


@gives("label string, slug string, first_id string, other_id string", ("Material", "shlak", "a", "c"))
def duplicate_stubs(spark: SparkSession) -> DataFrame:
    rows = [("a", "Material", "шлак"), ("b", "Process", "шлак"), ("c", "Material", "Шлак!"), ("d", "Material", "медь")]
    return resolution.duplicate_stubs(spark.createDataFrame(rows, "entity_id string, label string, name string"))


@gives("chunk_id string, entity_id string, surface string, start_at long, value double", ("c1", "par:t", "температура плавки", 0, 1300.0), ("c1", "mat:ni", "Ni", 28, None), ("c2", "par:t", "Температура плавки", 3, None))
def dictionary_entities(spark: SparkSession) -> DataFrame:
    """Longer names first, short ones in their case only; ids of text."""
    dictionary = [("par:t", "parameter", "температура плавки"), ("par:x", "parameter", "температура"), ("mat:ni", "material", "Ni")]
    chunks = spark.createDataFrame([("c1", "температура плавки 1300 °C, Ni и ni"), ("c2", "   Температура плавки не дана")], "chunk_id string, text string")
    return names_in_texts.find_names(chunks, spark.createDataFrame(dictionary, "entity_id string, type string, name string")).select("chunk_id", "entity_id", "surface", "start_at", "value")


@gives("target string, node_key string", ("one", "n1"), ("two", "n3"))
def seed_targets(spark: SparkSession) -> DataFrame:
    wanted = spark.createDataFrame([("one", "n1", "медь"), ("two", "missing", "никел")], "target string, id string, words string")
    return resolution.target_by_id_or_name(wanted, spark.createDataFrame([("n1", "шлак", 1), ("n2", "никель", 2), ("n3", "Никелевый штейн", 9), ("n4", "медь", 99)], "node_key string, name string, degree long"))


@gives("doc_id long, idx long, known string", (1, 0, ""), (1, 3, ""), (1, 4, "a|b|c"), (1, 8, "a|b|c|d"), (2, 0, ""))
def known_entities(spark: SparkSession) -> DataFrame:
    """A group of four chunks knows what the groups before it named."""
    rows = [(1, 0, ["a", "b"]), (1, 3, ["c", "a"]), (1, 4, ["d", "b"]), (1, 8, []), (2, 0, ["z"])]
    return resolution.known_before(spark.createDataFrame(rows, "doc_id long, idx long, entities array<string>")).select("doc_id", "idx", _joined("known").alias("known"))


@gives("rel_type string, src string, dst string, confidence string, operator_raw string", ("STUDIES", "a", "b", "medium", None), ("HAS_CONDITION", "a", "b", "high", "="))
def extraction_cleanup(spark: SparkSession) -> DataFrame:
    """Unknown kinds and ends go; a value without an operator means "="."""
    rows = [(1, " STUDIES ", "a", " b", "sure", None, None), (1, "HAS_CONDITION", "a", "b", "High", " ", "200-300"), (1, "LIKES", "a", "b", "low", None, None), (1, "STUDIES", "a", "c", "low", None, None), (2, "STUDIES", "a", "b", "low", None, None)]
    names_ = spark.createDataFrame([(1, "a"), (1, "b "), (2, "a")], "chunk_id long, name string")
    cleaned = validation.clean_relations(spark.createDataFrame(rows, "chunk_id long, rel_type string, src string, dst string, confidence string, operator_raw string, value_raw string"), names_)
    return cleaned.select("rel_type", "src", "dst", "confidence", "operator_raw")


@gives("id long, windows string", (1, "aa KEY bb|zz key yy"), (2, "x KEY key y"), (3, ""))
def anchor_windows(spark: SparkSession) -> DataFrame:
    rows = [(1, "aa KEY bb ........ zz key2 yy", ["key", "key2"]), (2, "x KEY key y", ["key", "KEY key"]), (3, "nothing here", ["key"])]
    got = validation.windows_around(spark.createDataFrame([(1, "aa KEY bb ........ zz lock yy", ["key", "lock"]), *rows[1:]], "id long, text string, anchors array<string>"), reach=3)
    return got.select("id", F.replace(_joined("windows"), F.lit("lock"), F.lit("key")).alias("windows"))


@gives("fact_id long, coverage double, span string", (1, 1.0, "nickel matte was leached"), (2, 0.5, "copper"), (3, 0.0, ""))
def quote_anchors(spark: SparkSession) -> DataFrame:
    rows = [(1, "leached nickel matte", "The nickel matte was leached in acid."), (2, "copper slag", "only copper here"), (3, "zinc", None)]
    return validation.anchored_windows(spark.createDataFrame(rows, "fact_id long, quote string, text string"))


@gives("fact_id long, review_reason string, needs_review boolean, resolve_attempted boolean", (1, "unknown unit: x", True, True), (2, None, False, True), (3, "quote not in the text", True, True), (4, "empty quote", True, False))
def review_states(spark: SparkSession) -> DataFrame:
    rows = [(1, "quote not in the text; unknown unit: x", True, False), (2, "numbers not near the quote: 5", True, False), (3, "quote not in the text", True, None), (4, "empty quote", True, False)]
    facts = spark.createDataFrame(rows, "fact_id long, review_reason string, needs_review boolean, resolve_attempted boolean")
    return validation.after_review(facts, spark.createDataFrame([(1, True), (2, True), (3, False)], "fact_id long, solved boolean"))


@gives("outcome string, n long", ("solved", 1), ("not proven", 2), ("reject", 1))
def review_proposals(spark: SparkSession) -> DataFrame:
    """A confirmation needs coverage and its numbers; proposals on unknown facts do not count."""
    facts = spark.createDataFrame([(k, "quote not in the text", True, False) for k in range(1, 5)], "fact_id long, review_reason string, needs_review boolean, resolve_attempted boolean")
    given = [(1, "confirm", 0.75, True), (2, "confirm", 0.7, True), (3, "confirm", 0.9, False), (4, "reject", 1.0, True), (9, "confirm", 1.0, True)]
    return validation.apply_proposals(facts, spark.createDataFrame(given, "fact_id long, verdict string, coverage double, numbers_ok boolean"))[1]


@gives("value string, inside boolean", ("200-300", True), ("2000", False), ("2,5", True), ("", True))
def question_numbers(spark: SparkSession) -> DataFrame:
    rows = [(v,) for v in ("200-300", "2000", "2,5", "")]
    return spark.createDataFrame(rows, "value string").select("value", validation.numbers_of_question("value", F.lit("от 300 до 200 при 2.5 и 20")).alias("inside"))


@gives("doc_id long, title string, authors string, year int, doc_type string, language string, geography string", (1, "b.c", "Ива Н.|B", 1999, "patent", "en", "RU"), (2, "T", "", None, "article", "ru", "foreign"))
def metadata_rules(spark: SparkSession) -> DataFrame:
    schema = "doc_id long, file_name string, title string, authors array<string>, year string, doc_type string, language string, geography string, country string"
    rows = [(1, "a/b.c.pdf", " ", ["Ива Н.", " ива н. ", "", None, "B"], " 1999 ", "Patent", "EN", "ru", " "), (2, "x", "T", None, "1799", "poem", None, "foreign", None)]
    return validation.coerce_metadata(spark.createDataFrame(rows, schema)).select("doc_id", "title", _joined("authors").alias("authors"), "year", "doc_type", "language", "geography")


@gives("doc_id long, trust_level string, access_level string", (1, "high", "public"), (2, "low", "internal"), (3, "medium", "confidential"), (4, "medium", "public"))
def trust_rules(spark: SparkSession) -> DataFrame:
    rows = [(1, "patent", None, None, "/data/x.pdf"), (2, "patent", "low", "secret", "/data/Internal/x.pdf"), (3, "poem", "much", "confidential", "/a"), (4, None, None, None, "/internal.md")]
    docs = spark.createDataFrame(rows, "doc_id long, doc_type string, given_trust string, given_access string, source_path string")
    return validation.trust_and_access(docs, {"patent": "high", "article": "medium"}).select("doc_id", "trust_level", "access_level")


@gives("entity string, description string", ("e", "first second"), ("f", "x"))
def experiment_texts(spark: SparkSession) -> DataFrame:
    return validation.describe_experiments(spark.createDataFrame([("e", 2, "second"), ("e", 1, "first"), ("e", 3, "first"), ("e", 4, " "), ("f", 1, "x")], "entity string, ord long, quote string"))


@gives("fact_id long, end_id string", (1, "m1"), (2, "m1"), (3, None))
def end_entities(spark: SparkSession) -> DataFrame:
    """The wanted type and name, else the first of that name."""
    known = spark.createDataFrame([("ni", "Material", "m1", 0), ("ni", "Process", "p1", 1)], "name string, type string, entity_id string, ord long")
    return validation.resolve_ends(spark.createDataFrame([(1, "ni", "Material"), (2, "ni", "Equipment"), (3, "cu", "Material")], "fact_id long, end_name string, end_type string"), known).select("fact_id", "end_id")


@gives("count long, zeroed_by string, dropped string, applied string", (1, "years", "years", "doc_types"))
def filter_answer(spark: SparkSession) -> DataFrame:
    """What a request for strict filters answers when they leave nothing, and what is given up for it."""
    docs = spark.createDataFrame([(1, 2001, "RU", "article", "public"), (2, 1990, "RU", "patent", "public"), (3, 2020, "foreign", "article", "internal")], "doc_id long, year long, geography string, doc_type string, access_level string")
    mentions = spark.createDataFrame([], "entity_id string, doc_id long")
    facts = spark.createDataFrame([], "source string, parameter string, doc_id long, value_min double, value_max double, value_text string, needs_review boolean, deleted boolean")
    got = filters.run(docs, mentions, facts, filters.Filters(year_from=2000, doc_types=("patent",)), "partner")
    return spark.createDataFrame([(got["count"], got["zeroed_by"], "|".join(got["relaxed"]), "|".join(got["applied"]))], "count long, zeroed_by string, dropped string, applied string")


@gives("key string, first double, second double", ("a", 0.6, 0.8), ("z", 0.0, 0.0))
def short_vectors(spark: SparkSession) -> DataFrame:
    short = retrieval.shorten("v", 2)
    return spark.createDataFrame([("a", [3.0, 4.0, 9.0]), ("z", [0.0, 0.0, 1.0])], "key string, v array<double>").select("key", F.round(short[0], 9).alias("first"), F.round(short[1], 9).alias("second"))


@gives("left_id long, right_id long, score double", (1, 1, 0.5), (1, 2, 0.25))
def sparse_products(spark: SparkSession) -> DataFrame:
    make = lambda rows: spark.createDataFrame(rows, "id long, bucket int, weight double")
    return retrieval.sparse_similarity(make([(1, 3, 0.5), (1, 4, 0.5)]), make([(1, 3, 0.5), (1, 4, 0.5), (2, 4, 0.5), (3, 9, 1.0)]))


@gives("pair_id long, score double, near boolean", (1, 1.0, True), (2, 0.0, False))
def cross_lingual(spark: SparkSession) -> DataFrame:
    rows = [(1, [1.0, 2.0], [2.0, 4.0]), (2, [1.0, 0.0], [0.0, 1.0])]
    return retrieval.similar_pairs(spark.createDataFrame(rows, "pair_id long, a array<double>, b array<double>")).select("pair_id", F.round("score", 9).alias("score"), F.col("similar").alias("near"))


@gives("key long, refused boolean", (2, True))
def pending_vectors(spark: SparkSession) -> DataFrame:
    """What still needs a vector, and whether vectors of another space are refused."""
    rows = spark.createDataFrame([(1, "t", [1.0], "p", "m"), (2, "t", None, "p", "m"), (3, "", None, "p", "m"), (4, "t", None, "p", "m")], "key long, text string, embedding array<double>, provider string, model string")
    try:
        retrieval.assert_one_space(rows.where("embedding IS NOT NULL"), "p", "other", 1)
        refused = False
    except ValueError:
        refused = True
    return retrieval.pending(rows, 1).select("key", F.lit(refused).alias("refused"))


@gives("doc_id long, title string, text string", (1, "one", "t1"))
def hit_details(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame([(1, "one", 2001, "public")], "doc_id long, title string, year int, access_level string")
    hits = spark.createDataFrame([(7, 1, 11, 0), (7, 2, 12, 1), (7, 1, 19, 2)], "query_id long, doc_id long, chunk_id long, rank long")
    return retrieval.enrich(hits, docs, spark.createDataFrame([(11, "t1"), (12, "t2")], "chunk_id long, text string")).select("doc_id", "title", "text")


@gives("n_statements long, citation_coverage double, verified_ratio double", (4, 0.75, 0.666666667))
def answer_measures(spark: SparkSession) -> DataFrame:
    rows = [(1, True), (2, True), (1, False), (0, False)]
    return retrieval.answer_measures(spark.createDataFrame(rows, "n_citations int, verified boolean")).select("n_statements", "citation_coverage", F.round("verified_ratio", 9).alias("verified_ratio"))


@gives("query_id long, context string", (1, "[C1] (A, report, ru, 2020): first\n\n[C2] (B, None, en, None): second"))
def context_text(spark: SparkSession) -> DataFrame:
    return retrieval.numbered_context(spark.createDataFrame([(1, 2, "B", None, "en", None, "second"), (1, 1, "A", "report", "ru", 2020, "first")], "query_id long, n int, title string, doc_type string, lang string, year int, quote string"))


@gives("query_id long, chunk_id long, citation string", (1, 5, "C1"), (1, 3, "C2"), (2, 3, "C1"))
def citation_numbers(spark: SparkSession) -> DataFrame:
    rows = [(1, 5, 0), (1, 3, 1), (1, 5, 2), (2, 3, 9)]
    return hypotheses.numbered_citations(spark.createDataFrame(rows, "query_id long, chunk_id long, ord long")).select("query_id", "chunk_id", "citation")


@gives("hypothesis_id long, rarity double", (1, 0.75), (2, 0.6), (3, 1.0))
def rarities(spark: SparkSession) -> DataFrame:
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (2, None, None), (3, "x", "y")], "hypothesis_id long, a string, b string")
    return hypotheses.rarity(pairs, spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("p", "q", 8)], "a string, b string, weight long"))


@gives("node_key string, degree long, expanded boolean", ("a", 1, True), ("h", 4, False), ("none", 0, True))
def hub_split(spark: SparkSession) -> DataFrame:
    edges = spark.createDataFrame([("h", "a"), ("h", "b"), ("c", "h"), ("h", "d")], "src_key string, dst_key string")
    few, hubs = graph.split_hubs(edges, spark.createDataFrame([("a",), ("h",), ("none",)], "node_key string"), limit=3)
    return few.withColumn("expanded", F.lit(True)).union(hubs.withColumn("expanded", F.lit(False)))


@gives("claim_id string, cite_keys string", ("c1", "A 2001|B 2002"), ("c2", ""))
def claim_citations(spark: SparkSession) -> DataFrame:
    edges = spark.createDataFrame([("c1", "d2", "SUPPORTED_BY", False), ("c1", "d1", "SUPPORTED_BY", None), ("c1", "d1", "SUPPORTED_BY", False), ("c2", "d1", "SUPPORTED_BY", True)], "src_key string, dst_key string, rel_type string, deleted boolean")
    docs = spark.createDataFrame([("d1", "A 2001"), ("d2", "B 2002")], "node_key string, cite_key string")
    return graph.claim_citations(spark.createDataFrame([("c1",), ("c2",)], "claim_id string"), edges, docs).select("claim_id", _joined("cite_keys").alias("cite_keys"))


@gives("fact_id long, quote string, title string", (1, "q1", "T"), (3, "q3", None))
def fact_evidence(spark: SparkSession) -> DataFrame:
    rows = [(1, "STUDIES", "q1", 10, True, False), (2, "STUDIES", "q2", 10, True, True), (3, "PRODUCES", "q3", 99, True, None), (4, "STUDIES", "q4", 10, False, False)]
    facts = spark.createDataFrame(rows, "fact_id long, rel_type string, quote string, source_doc_id long, needs_review boolean, deleted boolean")
    return graph.evidence(facts, spark.createDataFrame([(10, "T", "/t")], "doc_id long, title string, source_path string"), review_only=True).select("fact_id", "quote", "title")


@gives("process string, n_experts long, experts string", ("p", 3, "a|b"), ("q", 1, "z"))
def process_experts(spark: SparkSession) -> DataFrame:
    rows = [("p", "c"), ("p", "a"), ("p", "b"), ("p", "a"), ("q", "z")]
    return graph.experts_of(spark.createDataFrame(rows, "process string, expert string"), most=2).select("process", "n_experts", _joined("experts").alias("experts"))


@gives("cite_key string, place long", ("B", 0), ("A", 1))
def citation_order(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("A", 5), ("B", 1), (None, 0), ("B", 9)], "cite_key string, ord long")
    return spark.createDataFrame([(r["cite_key"], k) for k, r in enumerate(graph.citations(rows, F.col("ord")).collect())], "cite_key string, place long")


@gives("experiment string, name string, n long", ("e1", "first", 2), ("e2", "e2", 0))
def near_experiments(spark: SparkSession) -> DataFrame:
    nodes = spark.createDataFrame([("e1", "Experiment", "first"), ("e2", "Experiment", None), ("e3", "Experiment", "far"), ("m", "Material", "ore"), ("p", "Parameter", "heat")], "node_key string, label string, name string")
    rows = [("e1", "m", "USES_MATERIAL", False), ("e1", "p", "HAS_CONDITION", None), ("e1", "p", "HAS_CONDITION", True), ("m", "e2", "STUDIES", False), ("e3", "p", "HAS_CONDITION", False)]
    edges = spark.createDataFrame([(*r, None, None, None, None) for r in rows], "src_key string, dst_key string, rel_type string, deleted boolean, value_min double, value_max double, unit_canon string, value_text string")
    found = graph.near_experiments(nodes, edges, spark.createDataFrame([("m",)], "node_key string"))
    return found.select("experiment", "name", F.size("conditions").cast("long").alias("n"))


@gives("key string, bare string, shown string", ("Material:mat:1", "mat:1", "ore"), ("Expert:17", "17", "alias"))
def node_names(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("Material", "mat:1", "ore", "x", 5), ("Expert", None, "", "alias", 17)], "label string, mat string, name string, alias string, element long")
    key = graph.node_key(F.col("label"), {"Material": F.col("mat")}, F.col("element"))
    return rows.select(key.alias("key"), graph.bare_key(key).alias("bare"), graph.display_name(F.col("name"), F.col("alias")).alias("shown"))


@gives("entity string, a string, b string, opposite boolean", ("e", "c1", "c2", True), ("e", "c2", "c3", False))
def opposing_pairs(spark: SparkSession) -> DataFrame:
    claims = spark.createDataFrame([("c1", "e", 1, "positive"), ("c2", "e", 2, "negative"), ("c3", "e", 1, "neutral"), ("c4", "f", 3, "positive"), ("c5", "e", 2, "positive")], "claim_id string, entity string, doc_id long, polarity string")
    known = spark.createDataFrame([("c5", "c1"), ("c3", "c5")], "a string, b string")
    return analytics.opposing_pairs(claims, known)


@gives("doc_id long, n_chunks long", (2, 3), (1, 2))
def largest_public(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame([(1, "public"), (2, "public"), (3, "internal"), (4, "public")], "doc_id long, access_level string")
    return analytics.largest_public(docs, spark.createDataFrame([(k,) for k in (1, 1, 2, 2, 2, 3, 3, 3, 3, 4)], "doc_id long"), 2)


@gives("fact_id long, claim_ids string", (1, "c1|c2"), (2, ""))
def facts_with_claims(spark: SparkSession) -> DataFrame:
    claims = spark.createDataFrame([("c2", 1, ["s", "t"]), ("c1", 1, ["s"]), ("c3", 2, ["s"])], "claim_id string, doc_id long, about array<string>")
    return analytics.facts_with_claims(spark.createDataFrame([(1, "s", 1), (2, "x", 1)], "fact_id long, source string, doc_id long"), claims).select("fact_id", _joined("claim_ids").alias("claim_ids"))


@gives("section string, item string, value double", ("quality", "needs_review", 33.3), ("quality", "unresolved", 50.0), ("risk", "claims", 2.0), ("coverage", "metals 2001", 2.0), ("coverage", "water 2001", 1.0))
def dashboard(spark: SparkSession) -> DataFrame:
    facts = spark.createDataFrame([(True,), (False,), (False,)], "needs_review boolean")
    entities = spark.createDataFrame([(True,), (False,)], "unresolved boolean")
    claims = spark.createDataFrame([(0, 0), (5, 1), (2, 0)], "n_support long, n_contradictions long")
    docs = spark.createDataFrame([("metals", 2001, 1), ("metals", 2001, 2), ("metals", 2001, 2), ("water", 2001, 1)], "domain string, year int, doc_id long")
    return analytics.dashboard(facts, entities, claims, docs)


@gives("doc_id long, branch string", (1, "home"), (2, "abroad"))
def compared_branches(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(1, "RU"), (2, "foreign"), (3, None)], "doc_id long, geography string")
    return analytics.branches(rows, "geography", {"RU": "home", "foreign": "abroad"}).select("doc_id", "branch")


@gives("entity_id string, name string, aliases string", ("a", "own", "new"), ("b", "ref", "b1"), ("c", "c", "c1"))
def reference_load(spark: SparkSession) -> DataFrame:
    """Curated aliases replace stored ones; names that the curated table leaves open stay."""
    make = lambda rows: spark.createDataFrame(rows, "entity_id string, label string, name string, aliases array<string>")
    loaded = mutation.load_references(make([("a", "M", "own", ["old"]), ("c", "M", "c", ["c1"])]), make([("a", None, None, ["new"]), ("b", "M", "ref", ["b1"])]))
    return loaded.select("entity_id", "name", _joined("aliases").alias("aliases"))


@gives("src_key string, dst_key string, rel_type string, deleted boolean, edited_by string", ("a", "b", "R", True, "u2"), ("a", "c", "R", False, "u4"), ("k", "z", "R", False, None))
def edit_ops_fold(spark: SparkSession) -> DataFrame:
    """An edge deleted, one added, and a merge of v into k that makes two edges one and drops a loop."""
    edges = spark.createDataFrame([("a", "b", "R"), ("v", "z", "R"), ("k", "z", "R"), ("v", "k", "R")], "src_key string, dst_key string, rel_type string")
    log = [(1, "add_edge", "a", "b", "R", "u1"), (2, "delete_edge", "a", "b", "R", "u2"), (3, "delete_edge", "a", "c", "R", "u3"), (4, "add_edge", "a", "c", "R", "u4"), (5, "merge_nodes", "k", "v", None, "u5"), (6, "delete_edge", "x", "y", "R", "u6")]
    return mutation.edit_edges(edges, spark.createDataFrame(log, "seq long, op string, a string, b string, rel_type string, edited_by string"))


@gives("fact_id string, rel_type string, deleted boolean, edited_by string", ("1", "STUDIES", True, "me"), ("1~PRODUCES", "PRODUCES", False, "me"), ("2", "STUDIES", False, None), ("3", "STUDIES", True, None))
def retype_facts(spark: SparkSession) -> DataFrame:
    facts = spark.createDataFrame([("1", "STUDIES", False, None), ("2", "STUDIES", False, None), ("3", "STUDIES", True, None)], "fact_id string, rel_type string, deleted boolean, edited_by string")
    return mutation.retype(facts, spark.createDataFrame([("1", "PRODUCES"), ("2", "STUDIES"), ("3", "PRODUCES")], "fact_id string, rel_type string"), "me")


@gives("claim_id string, superseded_by string", ("c1", "c2"), ("c2", None))
def superseded_claims(spark: SparkSession) -> DataFrame:
    return mutation.supersede(spark.createDataFrame([("c1", "old"), ("c2", "old")], "claim_id string, superseded_by string"), spark.createDataFrame([("c1", "c2")], "claim_id string, superseded_by string"))


@gives("entity_id string, doc_id long, chunk_idx long", ("a", 1, 2), ("a", 2, 0))
def first_mentions(spark: SparkSession) -> DataFrame:
    return mutation.first_mentions(spark.createDataFrame([("a", 1, 5, 0), ("a", 1, 2, 3), ("a", 2, 0, 0)], "entity_id string, doc_id long, chunk_idx long, ord long"))


@gives("fact_id long, value_min double, value_text string", (1, 5.0, "t"), (2, None, None))
def stored_relations(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(1, "HAS_CONDITION", 5.0, "t"), (2, "STUDIES", 5.0, "t")], "fact_id long, rel_type string, value_min double, value_text string")
    return mutation.relation_columns(rows).select("fact_id", "value_min", "value_text")


@gives("role string, at_least boolean, may boolean", ("partner", False, False), ("analyst", True, True), ("admin", True, True), ("guest", False, True))
def role_checks(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("partner", ["read"]), ("analyst", ["write"]), ("admin", ["*"]), ("guest", ["read", "write"])], "role string, p array<string>")
    return rows.select("role", access.at_least(F.col("role"), "analyst").alias("at_least"), access.may(F.col("p"), "write").alias("may"))


def _goals(spark: SparkSession) -> DataFrame:
    mentions = [(1, "param.recovery", "parameter", 9), (1, "metal.Ni", "metal", 20), (1, "process.flotation", "process", 31)]
    texts = spark.createDataFrame([(1, "Повысить извлечение никеля при флотации на 2,5 п.п.")], "goal_id long, text string")
    return planning.parse_goals(texts, spark.createDataFrame(mentions, "goal_id long, entity_id string, type string, start_at long"))


def _context(spark: SparkSession) -> DataFrame:
    lime, ph, ni = ("r.lime", "reagent", "известь"), ("param.pH", "parameter", "pH пульпы"), ("metal.Ni", "metal", "никель")
    flot, ox = ("process.flotation", "process", "флотация"), ("process.oxidation", "process", "окисление")
    rows = [(1, "C1", 0, 11, "Извлечение выросло", "с 80 % до 83,5 %", [ni, ph, lime, lime, flot]), (1, "C2", 1, 12, "Механизм: депрессия", "текст", [flot, ni]), (1, "C4", 3, 14, "механизм другой", "5 % и 5 %", [ox])]
    return spark.createDataFrame(rows, "goal_id long, citation string, ord int, chunk_id long, quote string, text string, entities array<struct<entity_id:string,type:string,label:string>>")


@gives("citation string, levers string", ("C1", "известь|pH пульпы"), ("C2", ""), ("C4", "окисление"))
def lever_sets(spark: SparkSession) -> DataFrame:
    held = _context(spark).select("citation", generation.levers("entities", F.lit("metal.Ni"), F.lit("param.recovery")).alias("x"))
    return held.select("citation", F.array_join(F.transform("x", lambda e: e["label"]), "|").alias("levers"))


@gives("hypothesis_id string, labels string, citation string, mechanism string, effect string, factors string, is_abc boolean", ("H1", "известь|pH пульпы", "C1", "C2", "+3.5 п.п.", "известь|pH пульпы|дозировка реагента", False), ("H2", "окисление", "C4", "C2", "+2.5 п.п. (целевой ориентир)", "окисление|pH пульпы|дозировка реагента", False), ("H3", "Новый", "C9", None, "+2.5 п.п. (ориентир)", "Новый|pH пульпы|дозировка реагента", True))
def template_hypotheses(spark: SparkSession) -> DataFrame:
    links = spark.createDataFrame([(1, 1, "pH", "r.new", "Новый"), (1, 2, "Eh", "r.none", "Никакой")], "goal_id long, ord int, b_label string, c_id string, c_label string")
    made = generation.candidates(_goals(spark), _context(spark), links, spark.createDataFrame([(1, "r.new", "C9")], "goal_id long, entity_id string, citation string"))
    return made.select("hypothesis_id", _joined("labels").alias("labels"), "citation", "mechanism", "effect", _joined("factors").alias("factors"), "is_abc")


@gives("n int, share double, loss boolean", (2, 0.5, True))
def hypothesis_checks(spark: SparkSession) -> DataFrame:
    row = spark.createDataFrame([(["pH", "КМЦ", "время"], "извлечение", "оценить экспериментально", "Снижение извлечения никеля")], "f array<string>, m string, e string, a string")
    return row.select(generation.n_controllable("f").alias("n"), generation.measurable("m", "e").alias("share"), generation.reports_loss("a").alias("loss"))


@gives("goal_id long, title string, statement_id string, text string, citations string", (1, "t", "H1-s1", "a", "C2|C1"))
def written_hypotheses(spark: SparkSession) -> DataFrame:
    payload = '{"hypotheses": [{"title": "t", "statements": [{"text": "a", "citation_ids": ["C9", "C2", "C1", "C2"]}, {"text": "b", "citation_ids": ["C8"]}]}]}'
    rows = spark.createDataFrame([(1, payload), (2, "{broken"), (3, None)], "goal_id long, payload string")
    return generation.parsed_hypotheses(rows, _context(spark)).withColumn("citations", _joined("citations"))


def _plans(spark: SparkSession) -> DataFrame:
    payload = '{"intent": "search", "query_text_ru": "шлак", "filters": {"materials": ["Шлак", "неведомо", "шлак "], "processes": "плавка", "numeric": [{"param": "температура", "value_raw": "300", "unit_raw": "K", "operator_raw": "="}, {"param": "температура", "value_raw": "77", "operator_raw": "="}, {"param": "что-то", "value_raw": "300"}]}}'
    return planning.coerce_plans(spark.createDataFrame([(1, "Что при 300 K?", payload)], "plan_id long, question string, payload string"))


def _plan_index(spark: SparkSession) -> DataFrame:
    known = [("mat:slag", "Material", 0, ["шлак"]), ("proc:smelt", "Process", 1, ["плавка"]), ("par:t", "Parameter", 2, ["Температура"])]
    return resolution.alias_index(spark.createDataFrame(known, "entity_id string, label string, ord long, surfaces array<string>"))


@gives("plan_id long, materials string, processes string, unresolved string, query_ru string", (1, "mat:slag", "proc:smelt", "неведомо", "шлак неведомо"))
def plan_axes(spark: SparkSession) -> DataFrame:
    found = planning.canonical_axes(_plans(spark), _plan_index(spark))
    axis = lambda name: F.array_join(F.try_element_at("ids", F.lit(name)), "|").alias(name)
    return found.select("plan_id", axis("materials"), axis("processes"), _joined("unresolved").alias("unresolved"), "query_ru")


@gives("ord long, parameter string, value_min double, why_dropped string", (0, "par:t", 26.85, None), (1, "par:t", None, "number not in the question"), (2, None, None, "unknown parameter"))
def plan_numbers(spark: SparkSession) -> DataFrame:
    got = planning.numeric_filters(_plans(spark), _plan_index(spark), units.seed_units(spark))
    return got.select(F.col("ord").cast("long").alias("ord"), "parameter", F.round("value_min", 6).alias("value_min"), "why_dropped")


@gives("ord long, node_key string", (0, "a"), (1, "c"), (2, "b"), (3, "p"), (4, "100"), (5, "101"))
def start_nodes(spark: SparkSession) -> DataFrame:
    named = spark.createDataFrame([(1, "processes", 0, "b"), (1, "materials", 1, "c"), (1, "materials", 0, "a")], "plan_id long, axis string, ord int, entity_id string")
    conditions = spark.createDataFrame([(1, 0, "p"), (1, 1, "a"), (1, 2, None)], "plan_id long, ord int, parameter string")
    hits = spark.createDataFrame([(1, k, 100 + k) for k in range(4)], "plan_id long, rank long, doc_id long")
    return planning.start_keys(named, conditions, hits, 2).select(F.col("ord").cast("long").alias("ord"), "node_key")


@gives("answer_id long, document string", (1, "# Q?\n\nSo [A].\n\n## Sources\n\n1. One (2001)\n2. Two\n"), (2, "# R?\n\nNo.\n"))
def answer_markdown(spark: SparkSession) -> DataFrame:
    answers = spark.createDataFrame([(1, "Q?", "So [A]."), (2, "R?", "No.")], "answer_id long, question string, text string")
    return files.answer_markdown(answers, spark.createDataFrame([(1, 2, "Two", None), (1, 1, "One", 2001)], "answer_id long, n int, title string, year int"))


@gives("rank long, value string", (1, '1,"a, b",0.5'), (2, "2,c,0.25"))
def hypotheses_csv(spark: SparkSession) -> DataFrame:
    return files.hypotheses_csv(spark.createDataFrame([(1, "a, b", 0.5), (2, "c", 0.25)], "rank long, statement string, total double"))


@gives("node_key string, document string", ("a", '{"@id":"x:a","@type":"Material","name":"ore","density":2.5,"R":["x:b","x:c"],"S":"x:b"}'), ("b", '{"@id":"x:b","@type":"Process"}'))
def json_ld_nodes(spark: SparkSession) -> DataFrame:
    nodes = spark.createDataFrame([("a", "Material", "ore", 2.5, [1.0]), ("b", "Process", None, None, None)], "node_key string, label string, name string, density double, embedding array<double>")
    return files.json_ld(nodes, spark.createDataFrame([("a", "c", "R"), ("a", "b", "R"), ("a", "b", "S")], "src_key string, dst_key string, rel_type string"), "x:")


@gives("kind string, what string, more string", ("relation", "STUDIES", "a>b"), ("claim", "works", "positive"), ("claim", "fails", "neutral"), ("entity", "ni", "Material"), ("dropped", "LIKES", "1"), ("dropped", "_corrupt", "1"))
def extraction_source(spark: SparkSession) -> DataFrame:
    """Relations, claims and entities of payloads, and what was dropped."""
    payload = '{"entities": [{"type": "Material", "name": " ni "}], "relations": [{"type": "studies", "from": "a", "to": "b"}, {"type": "LIKES", "from": "a", "to": "b"}], "claims": [{"text": "works", "about": ["ni"], "polarity": "Positive"}, {"text": "fails", "polarity": "bad"}, {"text": " "}]}'
    rows = spark.createDataFrame([(1, payload), (2, "{broken")], "doc_id long, payload string")
    relations, dropped = files.read_extractions(rows, {"studies": "STUDIES"})
    found = relations.select(F.lit("relation").alias("kind"), F.col("rel_type").alias("what"), F.concat_ws(">", "from", "to").alias("more"))
    found = found.union(files.read_claims(rows).select(F.lit("claim"), "text", "polarity")).union(files.read_entities(rows).select(F.lit("entity"), "name", "type"))
    return found.union(dropped.select(F.lit("dropped"), "type", F.col("n_dropped").cast("string")))


@gives("title string, doc_type string, lang string, year int, access_level string, n_same long", ("Front", "patent", "en", 2001, "internal", 1), ("b_report_ru_1999", "report", "ru", 1999, "public", 2))
def corpus_documents(spark: SparkSession) -> DataFrame:
    """Text files written below the shared folder and read again: front matter, then the file's name, then the text; of equal contents the first path stays."""
    from factloom.shipping import fresh_folder

    root = fresh_folder(spark, "corpus")
    body = "Long enough to be kept as a document of its own. " * 4
    texts = {"a": f"---\ntitle: Front\ndoc_type: patent\nyear: 2001\naccess_level: internal\n---\n{body}", "b_report_ru_1999": body + "и ещё", "c_report_ru_1999": body + "и ещё  ", "d": "too short"}
    rows = spark.createDataFrame(list(texts.items()), "name string, value string")
    for name in texts:
        rows.where(F.col("name") == name).select("value").coalesce(1).write.option("lineSep", "\x00").text(f"{root}/{name}")
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="part-*.txt").select(F.concat(F.regexp_extract(F.col("_metadata.file_path"), r".*/([^/]+)/[^/]+\z", 1), F.lit(".md")).alias("source_path"), F.regexp_replace("value", "\x00", "").alias("raw"))
    docs = files.parse_documents(read)
    same = docs.groupBy("content_hash").agg(F.count("*").alias("n_same"))
    return files.first_of_each_content(docs).join(same, "content_hash").select("title", "doc_type", "lang", "year", "access_level", "n_same")


@gives("kind string, n long", ("documents", 2), ("chunks", 3), ("dimension", 2), ("aliases", 3), ("audit", 3))
def stored_tables(spark: SparkSession) -> DataFrame:
    """An index saved and loaded, a CSV dimension with comments and aliases, and an audit trail that was added to twice."""
    from factloom.shipping import fresh_folder

    root = fresh_folder(spark, "stored")
    files.save_index(spark.range(2).toDF("doc_id"), spark.range(3).toDF("chunk_id"), f"{root}/index")
    docs, chunks = files.load_index(spark, f"{root}/index")
    spark.createDataFrame([("id,name,aliases\n# a comment\n1,ore,a; b;\n2,slag,c",)], "value string").coalesce(1).write.text(f"{root}/csv")
    dimension = files.read_dimension(spark, f"{root}/csv", "id long, name string, aliases string")
    for _ in range(2):
        files.append_audit(spark.createDataFrame([("u", "edit"), ("v", "view")][: 2 - _], "who string, what string"), f"{root}/audit")
    sizes = [("documents", docs.count()), ("chunks", chunks.count()), ("dimension", dimension.count()), ("aliases", dimension.select(F.explode("aliases")).count()), ("audit", spark.read.json(f"{root}/audit").count())]
    return spark.createDataFrame(sizes, "kind string, n long")


@gives("idx long, n_chars int", (0, 150), (2, 200))
def bulk_texts(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(2, "c", "x" * 900), (0, "a", "y" * 150), (1, "b", "short")], "idx long, path string, text string")
    return files.bulk_texts(rows, 200).select("idx", F.length("text").alias("n_chars"))


@gives("path string, value string", ("d/a.md", "---\ntitle: T\ndoc_type: article\nlang: ru\n---\nbody"))
def markdown_mirror(spark: SparkSession) -> DataFrame:
    return files.mirror_markdown(spark.createDataFrame([("d/a.pdf", "T", "article", "ru", "body")], "source_path string, title string, doc_type string, lang string, text string"))


@gives("entity string, doc_count long", ("a", 2), ("b", 1))
def document_counts(spark: SparkSession) -> DataFrame:
    return graph.document_counts(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "doc_id long, entity string"))


@gives("key long, vectors long", (1, 0), (2, 0))
def reset_vectors(spark: SparkSession) -> DataFrame:
    rows = retrieval.without_vectors(spark.createDataFrame([(1, [1.0]), (2, None)], "key long, embedding array<double>"))
    return rows.groupBy("key").agg(F.count("embedding").alias("vectors"))


@gives("n_all long, n_written long, n_skipped long, n_failed long, n_facts long, n_review long, n_unknown long", (4, 2, 1, 1, 7, 3, 1))
def import_report(spark: SparkSession) -> DataFrame:
    """Totals of an import; a failed document has no counts."""
    rows = [("written", 5, 2, 1), ("written", 2, 1, 0), ("skipped", 0, 0, 0), ("failed", None, None, None)]
    return files.import_report(spark.createDataFrame(rows, "status string, n_facts long, n_review long, n_unknown long"))


@gives("hypothesis_id long", 1, 3)
def grounded_hypotheses(spark: SparkSession) -> DataFrame:
    """A hypothesis stays with one verified statement: by shared words, by a citation that is near enough, not by either falling short."""
    rows = [
        (1, 1, "flotation raises recovery", "Flotation raised the recovery of copper", 0.0), (1, 2, "leaching lowers losses", "nothing alike", 0.2),
        (2, 3, "roasting needs oxygen", "unrelated words", 0.54), (3, 4, "smelting gives matte", "other words", 0.1), (3, 4, "smelting gives matte", "other words", 0.55),
    ]
    statements = spark.createDataFrame(rows, "hypothesis_id long, statement_id long, statement string, text string, similarity double")
    return hypotheses.grounded(hypotheses.verify(statements))


@gives("filter_id string, doc_id long", ("f", 1), (None, 9), ("old", 3), ("none", 4))
def filter_handles(spark: SparkSession) -> DataFrame:
    """A live filter narrows, an empty one leaves nothing; a filter that is missing, unknown or over 15 minutes old does not narrow."""
    hits = spark.createDataFrame([("f", 1), ("f", 2), (None, 9), ("old", 3), ("none", 4), ("empty", 5)], "filter_id string, doc_id long")
    puts = [("f", 1, "2026-07-03 09:50:00"), ("f", 7, "2026-07-03 09:50:00"), ("old", 8, "2026-07-03 09:45:00"), ("empty", None, "2026-07-03 09:59:00")]
    sets = spark.createDataFrame(puts, "filter_id string, doc_id long, put_at string").withColumn("put_at", F.to_timestamp("put_at"))
    return access.within_filters(hits, sets, F.to_timestamp(F.lit("2026-07-03 10:00:00")))


@gives("id long", 1, 2, 3)
def named_people(spark: SparkSession) -> DataFrame:
    rows = [(1, "Трофимова А.", None, None), (2, "Иванов", "Ivanov", ["трофимов"]), (3, None, "Mr ТРОФИМ", []), (4, "Петров", None, None)]
    return resolution.named_with(spark.createDataFrame(rows, "id long, name_ru string, name_en string, aliases array<string>"), "Трофим").select("id")


@gives("id long, zoned string, local string, day string", (1, "2026-07-03T09:13:30", "2026-07-03T09:13:30", "2026-07-03"), (2, "2026-07-03T09:13:30", "2026-07-03T09:13:30.000500", "2026-07-03"), (3, None, None, None))
def iso_texts(spark: SparkSession) -> DataFrame:
    """Of times with a zone only the first 19 letters, as the rest tells the session's zone."""
    rows = spark.createDataFrame([(1, "2026-07-03 09:13:30"), (2, "2026-07-03 09:13:30.0005"), (3, None)], "id long, t string")
    texts = files.iso_times(rows.select("id", F.to_timestamp("t").alias("zoned"), F.expr("to_timestamp_ntz(t)").alias("local"), F.to_date("t").alias("day")))
    return texts.withColumn("zoned", F.substring("zoned", 1, 19))
