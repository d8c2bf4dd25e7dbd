"""From questions to plans: goals, subqueries, filters, start nodes of the graph and the sources of an answer.

A question, goal or plan is a row, so that a table of them is planned like a
single one. What a language model would write comes in as JSON and is coerced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import bind, column
from factloom.operators.resolution import lookup
from factloom.operators.units import parse_measurements
from factloom.operators.validation import numbers_of_question

# What a plan may say.
INTENTS = ("search", "review", "compare", "gaps", "out_of_scope")
GEOGRAPHIES = ("RU", "foreign")
COMPARISONS = ("geography", "method")
ENTITY_AXES = {"materials": "Material", "processes": "Process", "equipment": "Equipment", "parameters": "Parameter"}
START_DOCUMENTS, SOURCES = 8, 8

# Stems and words that tell the direction and the limits of a goal, and the metrics that a goal may name.
UP = ("повыс", "увелич", "рост", "нараст", "improve", "increase", "raise", "higher")
DOWN = ("сниз", "уменьш", "сократ", "reduce", "decrease", "lower", "minimi", "меньше")
LIMITS = ("без ", "при том же", "не увелич", "сохран", "without", "constant", "не более", "в пределах")
METRICS = ("param.recovery", "param.grade", "param.selectivity", "param.reagent_consumption", "param.energy", "param.so2_emission")
COSTS = ("param.reagent_consumption", "param.energy", "param.so2_emission")
_MAGNITUDE = r"(?iu)([-+]?\d+(?:[.,]\d+)?)\s*(?:п\.?\s?п|%|процент)"

# The subqueries of a goal, and what stands for what it does not name.
SUBQUERIES = (
    "механизмы {direction} {metric} {target} при {process}",
    "реагенты собиратели и депрессоры для {process} {target} ксантогенат",
    "роль pH и окислительно-восстановительного потенциала Eh в {process}",
    "минералогия пирротин пентландит халькопирит селективность {target}",
    "патенты и аналоги режимы {process} повышение извлечения {target}",
    "что уже пробовали негативные результаты {metric} {target}",
    "{target_en} {process_en} {metric_en} selectivity pyrrhotite pentlandite chalcopyrite depression xanthate pH Eh oxidation",
)
UNNAMED = {"target": "никель", "process": "флотация", "metric": "извлечение", "target_en": "nickel", "process_en": "flotation", "metric_en": "recovery"}

# Words of small talk, and words that make a question of it.
TALK_WORDS = ("привет", "приветствую", "здравствуй", "здравствуйте", "спасибо", "благодарю", "пока", "хай", "салют", "ку", "здорово", "hi", "hello", "hey", "thanks", "thx", "bye", "goodbye")
TALK_PHRASES = ("добрый день", "добрый вечер", "доброе утро", "доброй ночи", "до свидания", "всего доброго", "хорошего дня", "thank you", "good morning", "good evening")
QUESTION_WORDS = (
    "что", "как", "почему", "зачем", "какие", "какой", "какая", "каков", "каковы", "кто", "где", "когда", "сколько", "чем", "можешь", "умеешь", "расскажи", "объясни", "помоги", "покажи", "найди",
    "help", "what", "how", "why", "which", "who", "when", "where", "can", "could", "tell", "explain", "show", "find",
)
TALK_LENGTH = 40
#: Names of entities up to which they are sent to every task.
MOST_SENT = 200_000


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: text.contains(p))


def is_small_talk(text: Column | str) -> Column:
    """Whether a message asks nothing: empty, or without a sign of a question and either a greeting or short."""
    t = F.lower(F.trim(F.coalesce(column(text), F.lit(""))))
    words = F.regexp_extract_all(t, F.lit("[a-zа-яё]+"), F.lit(0))
    asks = t.contains("?") | F.arrays_overlap(words, F.array(*map(F.lit, QUESTION_WORDS)))
    talks = F.arrays_overlap(words, F.array(*map(F.lit, TALK_WORDS))) | _any_of(t, TALK_PHRASES)
    return (t == "") | (~asks & (talks | (F.length(t) <= TALK_LENGTH)))


def parse_goals(goals: DataFrame, mentions: DataFrame) -> DataFrame:
    """goal_id, text, target, process, metric, direction, magnitude, constraints of goals written as text.

    goals: goal_id, text. mentions: goal_id, entity_id, type, start_at. The first
    metal, process and metric that a goal mentions count. Costs go down unless
    the text says up.
    """
    first = lambda which: F.min_by("entity_id", F.when(which, F.struct("start_at", "entity_id")))
    named = mentions.groupBy("goal_id").agg(*[F.when(F.count_if(w) > 0, first(w)).alias(n) for n, w in (("target", F.col("type") == "metal"), ("process", F.col("type") == "process"), ("metric", F.col("entity_id").isin(*METRICS)))])
    low = F.lower(F.coalesce("text", F.lit("")))
    down = (_any_of(low, DOWN) | F.coalesce(F.col("metric").isin(*COSTS), F.lit(False))) & ~_any_of(low, UP)
    number = F.regexp_extract(F.coalesce("text", F.lit("")), _MAGNITUDE, 1)
    limits = F.filter(F.split(F.coalesce("text", F.lit("")), "[;,.]"), lambda c: _any_of(F.lower(c), LIMITS))
    return goals.join(named, "goal_id", "left").select(
        "goal_id", F.trim("text").alias("text"), "target", "process", "metric", F.when(down, "decrease").otherwise("increase").alias("direction"),
        F.replace(number, F.lit(","), F.lit(".")).try_cast("double").alias("magnitude"), F.transform(limits, lambda c: F.trim(c)).alias("constraints"),
    )


def subqueries(parsed: DataFrame, names: DataFrame) -> DataFrame:
    """goal_id, ord, subquery: the goal's text and what asks for its mechanisms, reagents, regimes, mineralogy, patents and failures.

    names: entity_id, name_ru, name_en, a row per entity. Repeats in another case are left out.
    """
    # Goals name few entities, so a shuffle by one would bring very many goals into one task.
    if names.limit(MOST_SENT + 1).count() <= MOST_SENT:
        names = F.broadcast(names)
    for part in ("target", "process", "metric"):
        own = names.select(F.col("entity_id").alias(part), F.col("name_ru").alias(f"{part}_ru"), F.col("name_en").alias(f"{part}_en"))
        parsed = parsed.join(own, part, "left")
    said = {p: F.coalesce(F.nullif(F.col(f"{p}_ru"), F.lit("")), F.col(p), F.lit(UNNAMED[p])) for p in ("target", "process", "metric")}
    said |= {f"{p}_en": F.coalesce(F.nullif(F.col(f"{p}_en"), F.lit("")), F.lit(UNNAMED[f"{p}_en"])) for p in ("target", "process", "metric")}
    said["direction"] = F.when(F.col("direction") == "increase", "повышение").otherwise("снижение")

    def filled(template: str) -> Column:
        out = F.lit(template)
        for key, value in said.items():
            out = F.replace(out, F.lit("{" + key + "}"), value)
        return out

    # Each list is made once, not anew for each of its elements.
    every = F.filter(F.array(F.trim(F.coalesce("text", F.lit(""))), *map(filled, SUBQUERIES)), lambda s: s != "")
    once = bind(every, lambda e: bind(F.transform(e, F.lower), lambda low: F.filter(e, lambda s, i: F.array_position(low, low[i]) == i + 1)))
    return parsed.select("goal_id", F.posexplode(once).alias("ord", "subquery"))


def as_list(value: Column | str) -> Column:
    """A JSON value as an array of strings that are not blank: of an array its elements, of a scalar itself, else none."""
    v = F.trim(F.coalesce(column(value), F.lit("")))
    several = F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>"))
    parts = F.when(v.startswith("["), F.transform(several, lambda x: F.trim(x))).otherwise(F.array(v))
    return F.filter(parts, lambda x: x.isNotNull() & (x != ""))


def coerce_plans(plans: DataFrame) -> DataFrame:
    """plan_id, question, intent, query_ru, query_en, compare_by, gap_dimensions, geography, year_from, year_to, doc_types, conditions_text, names, numeric.

    plans: plan_id, question, payload (JSON). Unknown intents become searches, a
    comparison by nothing is one by geography, and broken JSON is an empty plan.
    names has an array of axis, ord and name; numeric an array of conditions as written.
    """
    fields = "intent string, query_text_ru string, query_text_en string, compare_by string, gap_dimensions string, filters map<string,string>"
    parsed = plans.select("plan_id", "question", F.from_json("payload", fields).alias("p"))
    raw = parsed.select("plan_id", "question", "p.*")
    held = lambda key: F.try_element_at("filters", F.lit(key))
    intent = F.lower(F.trim(F.coalesce(F.nullif("intent", F.lit("")), F.lit("search"))))
    intent = F.when(intent.isin(*INTENTS), intent).otherwise("search")
    ru, en = (F.trim(F.coalesce(c, F.lit(""))) for c in ("query_text_ru", "query_text_en"))
    by = F.trim("compare_by")
    by = F.when(by.isin(*COMPARISONS), by)
    place = F.trim(held("geography"))
    named = lambda axis: F.transform(as_list(held(axis)), lambda x, i: F.struct(F.lit(axis).alias("axis"), i.alias("ord"), x.alias("name")))
    names = F.flatten(F.array(*map(named, ENTITY_AXES)))
    numeric = F.from_json(F.coalesce(held("numeric"), F.lit("[]")), "array<struct<param:string,value_raw:string,unit_raw:string,operator_raw:string>>")
    return raw.select(
        "plan_id", "question", intent.alias("intent"), F.when((ru == "") & (en == ""), F.col("question")).otherwise(ru).alias("query_ru"), en.alias("query_en"),
        F.when((intent == "compare") & by.isNull(), "geography").otherwise(by).alias("compare_by"), as_list("gap_dimensions").alias("gap_dimensions"),
        F.when(place.isin(*GEOGRAPHIES), place).alias("geography"), F.trim(held("year_from")).try_cast("int").alias("year_from"), F.trim(held("year_to")).try_cast("int").alias("year_to"),
        as_list(held("doc_types")).alias("doc_types"), as_list(held("conditions_text")).alias("conditions_text"), names.alias("names"), numeric.alias("numeric"),
    )


def canonical_axes(plans: DataFrame, index: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Adds ids (a map from axis to distinct entity ids in the order of the names) and unresolved; what is unresolved joins query_ru.

    plans as from coerce_plans; index as from resolution.alias_index.
    """
    labels = F.create_map(*[F.lit(x) for kv in ENTITY_AXES.items() for x in kv])
    rows = plans.select("plan_id", F.explode("names").alias("n")).select("plan_id", "n.*")
    rows = rows.select(F.struct("plan_id", "axis", "ord").alias("mention_id"), labels[F.col("axis")].alias("label"), "name")
    found = lookup(rows, index, lemmas).select("mention_id.*", "name", "entity_id")
    place = F.struct(F.array_position(F.array(*map(F.lit, ENTITY_AXES)), F.col("axis")).alias("k"), "ord")
    listed = lambda c, what: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(place.alias("at"), F.col(what).alias("x"))))), lambda s: s["x"]))
    known = found.where("entity_id IS NOT NULL").groupBy("plan_id", "axis").agg(listed(F.lit(True), "entity_id").alias("ids"))
    maps = known.groupBy("plan_id").agg(F.map_from_entries(F.collect_list(F.struct("axis", "ids"))).alias("ids"))
    missed = found.groupBy("plan_id").agg(listed(F.col("entity_id").isNull(), "name").alias("unresolved"))
    joined = plans.join(maps, "plan_id", "left").join(missed, "plan_id", "left")
    extra = F.coalesce("unresolved", F.array().cast("array<string>"))
    return joined.withColumn("unresolved", extra).withColumn("query_ru", F.trim(F.concat_ws(" ", "query_ru", F.array_join(F.array_distinct("unresolved"), " "))))


def numeric_filters(plans: DataFrame, index: DataFrame, units: DataFrame) -> DataFrame:
    """plan_id, ord, parameter, value_min, value_max, unit_canon and why_dropped, a row per numeric condition of a plan.

    A condition is dropped without a value or a name, with numbers that the
    question does not have, with an unknown parameter, or if its value must be
    reviewed.
    """
    rows = plans.select("plan_id", "question", F.posexplode("numeric").alias("ord", "c")).select("plan_id", "question", "ord", "c.*")
    keyed = rows.withColumns({"mention_id": F.struct("plan_id", "ord"), "label": F.lit("Parameter"), "name": F.trim(F.coalesce("param", F.lit(""))), "value_raw": F.trim(F.coalesce("value_raw", F.lit(""))), "unit_raw": F.nullif(F.trim("unit_raw"), F.lit(""))})
    read = parse_measurements(lookup(keyed, index).drop("mention_id"), units)
    why = F.when((F.col("value_raw") == "") | (F.col("name") == ""), "no value or parameter").when(~numbers_of_question("value_raw", "question"), "number not in the question").when(F.col("entity_id").isNull(), "unknown parameter").when(F.col("interval.needs_review"), "value or unit unclear")
    kept = lambda c: F.when(why.isNull(), F.col(c))
    return read.select("plan_id", "ord", F.col("entity_id").alias("parameter"), kept("interval.value_min").alias("value_min"), kept("interval.value_max").alias("value_max"), kept("interval.unit_canon").alias("unit_canon"), why.alias("why_dropped"))


def start_keys(named: DataFrame, conditions: DataFrame, hits: DataFrame, documents: int = START_DOCUMENTS) -> DataFrame:
    """plan_id, ord, node_key: distinct entities of a plan by axis, then parameters of its conditions, then its first documents.

    named: plan_id, axis, ord, entity_id. conditions: plan_id, ord, parameter. hits: plan_id, rank, doc_id.
    """
    axis = F.array_position(F.array(*map(F.lit, ENTITY_AXES)), F.col("axis"))
    every = named.select("plan_id", F.lit(0).alias("part"), axis.cast("long").alias("a"), F.col("ord").cast("long").alias("b"), F.col("entity_id").cast("string").alias("node_key"))
    every = every.union(conditions.select("plan_id", F.lit(1), F.lit(0), "ord", F.col("parameter").cast("string")))
    every = every.union(hits.where(F.col("rank") < documents).select("plan_id", F.lit(2), F.lit(0), "rank", F.col("doc_id").cast("string")))
    first = every.where("node_key IS NOT NULL").groupBy("plan_id", "node_key").agg(F.min(F.struct("part", "a", "b")).alias("at"))
    return first.select("plan_id", (F.row_number().over(Window.partitionBy("plan_id").orderBy("at", "node_key")) - 1).alias("ord"), "node_key")


def sources(answers: DataFrame, keys: DataFrame, facts: DataFrame, docs: DataFrame, most: int = SOURCES) -> DataFrame:
    """plan_id, ord, doc_id, title, quote, cited: documents cited in an answer in the order of their first [key], then documents of facts up to `most`.

    answers: plan_id, answer. keys: plan_id, cite_key, doc_id, of what the reader may see. facts: plan_id, ord, doc_id, quote.
    docs: doc_id, title. Keys in one pair of brackets are divided by semicolons; all cited documents are shown, however many.
    """
    shown = answers.select("plan_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[([^\]]+)\]"), F.lit(1))).alias("a", "inner"))
    whole = shown.select("plan_id", "a", F.lit(-1).alias("b"), F.col("inner").alias("cite_key"))
    parts = shown.select("plan_id", "a", F.posexplode(F.transform(F.split("inner", ";"), lambda x: F.trim(x))).alias("b", "cite_key"))
    hit = whole.union(parts).join(keys, ["plan_id", "cite_key"])
    # Where the whole of a bracket is a key, its parts are not read.
    least = F.min("b").over(Window.partitionBy("plan_id", "a"))
    cited = hit.withColumn("least", least).where((F.col("least") >= 0) | (F.col("b") < 0)).groupBy("plan_id", "doc_id").agg(F.min(F.struct("a", "b")).alias("at"))
    said = facts.groupBy("plan_id", "doc_id").agg(F.min("ord").alias("fact"), F.min_by(F.coalesce("quote", F.lit("")), "ord").alias("quote"))
    both = cited.join(said, ["plan_id", "doc_id"], "full").select("plan_id", "doc_id", "at", "fact", F.coalesce("quote", F.lit("")).alias("quote"))
    order = Window.partitionBy("plan_id").orderBy(F.asc_nulls_last("at"), "fact", "doc_id")
    taken = both.withColumn("n", F.row_number().over(order)).where(F.col("at").isNotNull() | (F.col("n") <= most))
    named = taken.join(docs.select("doc_id", "title"), "doc_id").withColumn("title", F.coalesce("title", F.col("doc_id").cast("string")))
    # Cited ones stay in order; of the others those with a quote come first, by title.
    last = Window.partitionBy("plan_id").orderBy(F.asc_nulls_last("at"), F.col("quote") == "", "title", "doc_id")
    return named.select("plan_id", (F.row_number().over(last) - 1).alias("ord"), "doc_id", "title", "quote", F.col("at").isNotNull().alias("cited"))
