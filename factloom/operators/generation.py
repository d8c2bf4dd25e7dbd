"""Hypotheses from evidence: what can be changed, in which cited place, by how much, and how an experiment would test it.

Goals are as from planning.parse_goals. The context is a row per goal and
citation: goal_id, citation, ord, chunk_id, quote, text and entities, an array
of entity_id, type and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import percent_points, short_number
from factloom.functions.text import column

HYPOTHESES, ABC_SEEDS, LEVERS, FACTORS = 5, 3, 2, 4

# Parameters that can be set, the process that every chunk is about, and cues of a mechanism.
LEVER_PARAMETERS = ("param.pH", "param.Eh", "param.temperature", "param.dosage", "param.particle_size", "param.flotation_time")
COMMON_PROCESS = "process.flotation"
MECHANISM_CUES = ("механизм", "гидрофил", "окисл", "депресс", "hydroph", "oxidation", "mechanism", "depress")
# What marks a factor as one that can be controlled, and a citation as one that reports a loss.
CONTROLLABLE = ("ph", "рн", "eh", "овп", "дозиров", "расход", "температ", "врем", "крупност", "p80", "известь", "реагент")
LOSS = r"(?iu)(сниж[\p{L}\p{N}_]*|уменьш[\p{L}\p{N}_]*|потер[\p{L}\p{N}_]*|паден[\p{L}\p{N}_]*)[^.]{0,45}(никел|извлечени[\p{L}\p{N}_]*\s+ni)|извлечени[\p{L}\p{N}_]*\s+(никел|ni)[^.]{0,45}(сниж[\p{L}\p{N}_]*|уменьш[\p{L}\p{N}_]*|упал[\p{L}\p{N}_]*)"
# How magnitudes, factors and statements are worded.
UNMEASURED, AIM, SEED_AIM, POINTS = "оценить экспериментально", " п.п. (целевой ориентир)", " п.п. (ориентир)", " п.п."
ACIDITY, DOSAGE = "pH пульпы", "дозировка реагента"
GENITIVES = {"metal.Ni": "никеля", "metal.Cu": "меди", "metal.Pt": "платины", "metal.Pd": "палладия", "metal.Co": "кобальта"}
METRIC_PHRASES = {
    "param.recovery": "извлечения {m}", "param.grade": "качества концентрата по {m}", "param.selectivity": "селективности по {m}",
    "param.reagent_consumption": "расхода реагентов", "param.energy": "энергозатрат", "param.so2_emission": "выбросов SO2",
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def metric_phrase(target: Column | str, metric: Column | str) -> Column:
    """What the goal is about, in the genitive; recovery of nickel where it does not say."""
    metal = F.coalesce(F.try_element_at(_map(GENITIVES), column(target)), column(target), F.lit("никеля"))
    phrase = F.coalesce(F.try_element_at(_map(METRIC_PHRASES), F.coalesce(column(metric), F.lit("param.recovery"))), F.lit(METRIC_PHRASES["param.recovery"]))
    return F.replace(phrase, F.lit("{m}"), metal)


def levers(entities: Column | str, target: Column | str, metric: Column | str) -> Column:
    """Of a chunk's entities the distinct ones that can be changed, reagents first: not the goal's target or metric."""
    e = column(entities)
    able = lambda x: (x["type"] == "reagent") | ((x["type"] == "process") & (x["entity_id"] != COMMON_PROCESS)) | x["entity_id"].isin(*LEVER_PARAMETERS)
    own = F.filter(e, lambda x: able(x) & ~F.coalesce(x["entity_id"].eqNullSafe(column(target)) | x["entity_id"].eqNullSafe(column(metric)), F.lit(False)))
    once = F.filter(own, lambda x, i: F.array_position(F.transform(own, lambda y: y["entity_id"]), x["entity_id"]) == i + 1)
    return F.concat(F.filter(once, lambda x: x["type"] == "reagent"), F.filter(once, lambda x: x["type"] != "reagent"))


def magnitude_label(metric: Column | str, text: Column | str, magnitude: Column | str, direction: Column | str) -> Column:
    """The difference of two percentages in a text on recovery, else what the goal asks for, else that it must be measured."""
    delta = F.round(F.when(column(metric) == "param.recovery", percent_points(column(text))), 1)
    told = F.concat(F.when(delta > 0, "+").otherwise(""), delta.cast("string"), F.lit(POINTS))
    return F.when(delta != 0, told).otherwise(_asked(magnitude, direction))


def _asked(magnitude: Column | str, direction: Column | str) -> Column:
    m = column(magnitude)
    return F.when(m.isNotNull() & (m != 0), F.concat(F.when(column(direction) == "increase", "+").otherwise("-"), short_number(m), F.lit(AIM))).otherwise(F.lit(UNMEASURED))


def factors(labels: Column | str) -> Column:
    """The factors of an experiment: the labels, with acidity and dosage where they are missing, four at most."""
    given = column(labels)
    acid = F.when(F.exists(given, lambda x: x.contains("pH") | x.contains("рН")), F.array().cast("array<string>")).otherwise(F.array(F.lit(ACIDITY)))
    dose = F.when(F.exists(given, lambda x: F.lower(x).contains("дозир") | F.lower(x).contains("расход")), F.array().cast("array<string>")).otherwise(F.array(F.lit(DOSAGE)))
    return F.slice(F.concat(given, acid, dose), 1, FACTORS)


def n_controllable(named: Column | str) -> Column:
    """How many factors can be controlled."""
    return F.size(F.filter(column(named), lambda f: F.exists(F.array(*map(F.lit, CONTROLLABLE)), lambda c: F.lower(f).contains(c))))


def measurable(metric: Column | str, effect: Column | str) -> Column:
    """1 for an effect with a number, half for a metric alone, else 0."""
    has = F.coalesce(column(metric) != "", F.lit(False))
    numbered = F.coalesce((column(effect) != "") & ~column(effect).contains("оценить"), F.lit(False))
    return F.when(has & numbered, 1.0).when(has, 0.5).otherwise(0.0)


def reports_loss(text: Column | str) -> Column:
    """Whether a text says that the target's recovery went down."""
    return F.coalesce(F.rlike(column(text), F.lit(LOSS)), F.lit(False))


def candidates(goals: DataFrame, context: DataFrame, links: DataFrame, grounds: DataFrame, n: int = HYPOTHESES) -> DataFrame:
    """goal_id, hypothesis_id, labels, is_abc, via, citation, mechanism, effect, metric, statement, factors, citations.

    One hypothesis for each distinct set of at most two levers, from the first
    citation with it, its mechanism from the first other citation that has a cue
    of one. Then one for each of the first links (goal_id, ord, b_label, c_id,
    c_label) whose C is no lever yet and is held by a citation, or else by a chunk
    that a search found (grounds: goal_id, entity_id, citation). At most 2n each goal.
    """
    goal = goals.select("goal_id", "target", "metric", "direction", "magnitude")
    held = context.join(goal, "goal_id").withColumn("levers", F.slice(levers("entities", "target", "metric"), 1, LEVERS)).where(F.size("levers") > 0)
    named = held.withColumn("labels", F.transform("levers", lambda x: x["label"])).withColumn("same", F.array_sort(F.array_distinct(F.transform("labels", F.lower))))
    first = Window.partitionBy("goal_id", "same").orderBy("ord", "citation")
    direct = named.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    # Two cited mechanisms are enough: one of them is not the hypothesis's own citation.
    cue = F.exists(F.array(*map(F.lit, MECHANISM_CUES)), lambda c: F.lower(F.coalesce("quote", F.lit(""))).contains(c))
    at = Window.partitionBy("goal_id").orderBy("ord", "citation")
    mechanisms = context.where(cue).withColumn("nth", F.row_number().over(at)).where("nth <= 2").groupBy("goal_id").agg(F.array_sort(F.collect_list(F.struct("ord", "citation"))).alias("mechanisms"))
    cited = direct.join(mechanisms, "goal_id", "left").withColumn("mechanism", F.try_element_at(F.filter("mechanisms", lambda m: m["citation"] != F.col("citation")), F.lit(1))["citation"])
    phrase, up = metric_phrase("target", "metric"), F.col("direction") == "increase"
    effect = magnitude_label("metric", "text", "magnitude", "direction")
    told = F.concat(F.lit("Применение режима «"), F.array_join("labels", ", "), F.lit("» "), F.when(up, "повышает").otherwise("снижает"), F.lit(" "), phrase, F.when(effect != UNMEASURED, F.concat(F.lit(" на "), effect)).otherwise(""), F.lit("."))
    one = cited.select("goal_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), "labels", "same", F.lit(False).alias("is_abc"), F.lit(None).cast("string").alias("via"), "citation", "mechanism", effect.alias("effect"), phrase.alias("metric"), told.alias("statement"))

    by_context = context.select("goal_id", "citation", "ord", F.explode("entities").alias("e")).groupBy("goal_id", F.col("e.entity_id").alias("c_id")).agg(F.min_by("citation", F.struct("ord", "citation")).alias("own"))
    by_search = grounds.select("goal_id", F.col("entity_id").alias("c_id"), F.col("citation").alias("found"))
    seeds = links.where(F.col("ord") < ABC_SEEDS).join(by_context, ["goal_id", "c_id"], "left").join(by_search, ["goal_id", "c_id"], "left").withColumn("citation", F.coalesce("own", "found")).where("citation IS NOT NULL")
    fresh = seeds.withColumn("same", F.array(F.lower("c_label"))).join(direct.select("goal_id", "same").distinct(), ["goal_id", "same"], "left_anti")
    again = Window.partitionBy("goal_id", "same").orderBy("ord")
    fresh = fresh.withColumn("nth", F.row_number().over(again)).where("nth = 1").join(goal, "goal_id")
    aim = F.when(F.col("magnitude").isNotNull() & (F.col("magnitude") != 0), F.concat(F.lit("+"), short_number(F.col("magnitude")), F.lit(SEED_AIM))).otherwise(F.lit(UNMEASURED))
    said = F.concat(F.lit("«"), "c_label", F.lit("» способно обеспечить "), F.when(up, "повышение").otherwise("снижение"), F.lit(" "), phrase, F.lit(" через механизм «"), "b_label", F.lit("» (связь выявлена сопоставлением источников)."))
    two = fresh.select("goal_id", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.array("c_label").alias("labels"), "same", F.lit(True).alias("is_abc"), F.col("b_label").alias("via"), "citation", F.lit(None).cast("string").alias("mechanism"), aim.alias("effect"), phrase.alias("metric"), said.alias("statement"))

    order = Window.partitionBy("goal_id").orderBy("part", "ord", "citation")
    most = one.union(two).withColumn("number", F.row_number().over(order)).where(F.col("number") <= 2 * n)
    return most.select(
        "goal_id", F.concat(F.lit("H"), "number").alias("hypothesis_id"), "labels", "is_abc", "via", "citation", "mechanism", "effect", "metric", "statement",
        factors("labels").alias("factors"), F.array_distinct(F.array_compact(F.array("citation", "mechanism"))).alias("citations"),
    )


def parsed_hypotheses(rows: DataFrame, context: DataFrame) -> DataFrame:
    """goal_id, title, statement_id, text, citations of hypotheses that came as JSON (goal_id, payload).

    Statements keep the citations that the context has; one without any goes,
    and with its last statement the hypothesis does. Broken JSON gives no rows.
    """
    schema = "hypotheses array<struct<title:string,statements:array<struct<text:string,citation_ids:array<string>>>>>"
    listed = rows.select("goal_id", F.posexplode(F.from_json("payload", schema)["hypotheses"]).alias("h", "x")).select("goal_id", "h", "x.title", F.posexplode("x.statements").alias("s", "y"))
    cited = listed.select("goal_id", "h", "s", "title", "y.text", F.posexplode("y.citation_ids").alias("c", "citation"))
    valid = cited.join(context.select("goal_id", "citation").distinct(), ["goal_id", "citation"], "left_semi")
    held = valid.groupBy("goal_id", "h", "s", "title", "text").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("c", "citation"))), lambda z: z["citation"])).alias("citations"))
    return held.select("goal_id", "title", F.concat(F.lit("H"), F.col("h") + 1, F.lit("-s"), F.col("s") + 1).alias("statement_id"), "text", "citations")
