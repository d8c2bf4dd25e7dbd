"""Units: a dimension of spellings with factors, lookup in three steps, conversion, and what to do with unknown units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numbers import raw_interval
from factloom.functions.text import normalize_spaces
from factloom.shipping import fresh_folder

#: Distinct spellings of measurements up to which what they mean is sent to the rows.
BROADCAST_SPELLINGS = 50_000

SCHEMA = "unit string, category string, multiplier double, offset double, canonical_unit string, zero_delta double"

# Spellings that tests and demonstrations need. A full table is read with read_units.
SEED = [
    ("мг/л", "concentration", 1.0, 0.0, "мг/л", None), ("мг/дм³", "concentration", 1.0, 0.0, "мг/л", None), ("г/л", "concentration", 1000.0, 0.0, "мг/л", None),
    ("°C", "temperature", 1.0, 0.0, "°C", 2.0), ("С", "temperature", 1.0, 0.0, "°C", 2.0), ("K", "temperature", 1.0, -273.15, "°C", 2.0),
    ("с", "duration", 1.0, 0.0, "с", None), ("мин", "duration", 60.0, 0.0, "с", None), ("ч", "duration", 3600.0, 0.0, "с", None),
    ("м³/ч", "flow", 1.0, 0.0, "м³/ч", None), ("л/мин", "flow", 0.06, 0.0, "м³/ч", None),
    ("МПа", "pressure", 1.0, 0.0, "МПа", None), ("атм", "pressure", 0.101325, 0.0, "МПа", None), ("бар", "pressure", 0.1, 0.0, "МПа", None),
    ("т/сут", "throughput", 1.0, 0.0, "т/сут", None), ("кг/ч", "throughput", 0.024, 0.0, "т/сут", None),
    ("pH", "ph", 1.0, 0.0, "pH", 0.5), ("%", "share", 1.0, 0.0, "%", None), ("$/т", "economic", 1.0, 0.0, "$/т", None), ("руб/т", "economic_rub", 1.0, 0.0, "руб/т", None),
]


def seed_units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED, SCHEMA)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """A table of units from CSV files with a header."""
    return spark.read.csv(path, header=True, schema=SCHEMA, comment="#")


def read_unit_groups(spark: SparkSession, path: str) -> DataFrame:
    """A table of units from JSON files: category, canonical_unit, zero_delta, units (array of unit, aliases, multiplier, offset).

    Every spelling becomes a row; a canonical unit that no entry gives has factor 1.
    """
    schema = "category string, canonical_unit string, zero_delta double, units array<struct<unit: string, aliases: array<string>, multiplier: double, offset: double>>"
    groups = spark.read.schema(schema).json(path, multiLine=True)
    given = groups.select("category", "canonical_unit", "zero_delta", F.explode_outer("units").alias("u"))
    spelled = given.select("*", F.explode(F.array_distinct(F.concat(F.array("u.unit"), F.coalesce("u.aliases", F.array().cast("array<string>"))))).alias("unit")).where("unit IS NOT NULL")
    rows = spelled.select("unit", "category", F.coalesce("u.multiplier", F.lit(1.0)).alias("multiplier"), F.coalesce("u.offset", F.lit(0.0)).alias("offset"), "canonical_unit", "zero_delta")
    own = groups.select(F.col("canonical_unit").alias("unit"), "category", F.lit(1.0).alias("multiplier"), F.lit(0.0).alias("offset"), "canonical_unit", "zero_delta")
    return rows.unionByName(own.where("unit IS NOT NULL").join(rows.select("unit", "category"), ["unit", "category"], "left_anti").select(*rows.columns))


def lookup_table(units: DataFrame) -> DataFrame:
    """step, key and the unit's columns: exact spellings (0), without white space (1), in lower case (2).

    Lower-cased spellings that mean different things are left out, as с (seconds) and С (Celsius).
    """
    spec = F.struct("category", "multiplier", "offset", "canonical_unit", "zero_delta")
    tight = F.regexp_replace("unit", r"\s+", "")
    keys = units.select(F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("unit").alias("key")), F.struct(F.lit(1).alias("step"), tight.alias("key")), F.struct(F.lit(2).alias("step"), F.lower(tight).alias("key")))).alias("k"), spec.alias("spec"))
    one = keys.groupBy("k.step", "k.key").agg(F.min("spec").alias("spec"), F.max("spec").alias("other"))
    return one.where((F.col("step") < 2) | (F.col("spec") == F.col("other"))).select("step", "key", "spec")


def with_units(rows: DataFrame, units: DataFrame, unit_col: str = "unit_raw") -> DataFrame:
    """Adds spec, the unit's meaning by the first lookup step that knows it, else NULL."""
    known = lookup_table(units)
    tight = F.regexp_replace(F.trim(F.col(unit_col)), r"\s+", "")
    keyed = rows.withColumns({"factloom_0": F.trim(F.col(unit_col)), "factloom_1": tight, "factloom_2": F.lower(tight)})
    for step in range(3):
        one = known.where(F.col("step") == step).select(F.col("key").alias(f"factloom_{step}"), F.col("spec").alias(f"factloom_spec_{step}"))
        keyed = keyed.join(one, f"factloom_{step}", "left")
    return keyed.select(*rows.columns, F.coalesce("factloom_spec_0", "factloom_spec_1", "factloom_spec_2").alias("spec"))


def parse_measurements(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Adds interval (see _parsed) to rows with value_raw, unit_raw, operator_raw.

    Values come again and again in other documents, so each distinct spelling is
    parsed once and joined back. Where there are at most BROADCAST_SPELLINGS of them the rows stay
    where they are.
    """
    given = ("value_raw", "unit_raw", "operator_raw")
    path = fresh_folder(rows.sparkSession, "spellings")
    _parsed(rows.select(*given).distinct(), units).select(*[F.col(c).alias(f"factloom_{c}") for c in given], "interval").write.parquet(path)
    parsed = rows.sparkSession.read.parquet(path)
    if parsed.limit(BROADCAST_SPELLINGS + 1).count() <= BROADCAST_SPELLINGS:
        parsed = F.broadcast(parsed)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"factloom_{c}")) for c in given])
    return rows.join(parsed, same).select(*rows.columns, "interval")


def _parsed(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Adds interval: value_min, value_max, unit_canon, needs_review, review_reason of value_raw, unit_raw, operator_raw.

    The bounds are in the canonical unit, in order, NULL where open. An unknown
    unit keeps raw bounds and asks for a review; a text without a number has no
    bounds and asks for one too.
    """
    spec = with_units(rows, units)
    parsed = spec.withColumn("raw", raw_interval("value_raw", "operator_raw", F.col("spec.zero_delta")))
    has_unit = F.coalesce(F.trim("unit_raw") != "", F.lit(False))
    unknown = has_unit & F.col("spec").isNull()
    factor, shift = F.coalesce("spec.multiplier", F.lit(1.0)), F.coalesce("spec.offset", F.lit(0.0))
    lo, hi = F.col("raw.lo") * factor + shift, F.col("raw.hi") * factor + shift
    both = lo.isNotNull() & hi.isNotNull()
    reason = F.when(F.col("raw").isNull(), F.concat(F.lit("no number or operator: "), F.coalesce("value_raw", F.lit("")))).when(unknown, F.concat(F.lit("unknown unit: "), "unit_raw")).otherwise(F.col("raw.reason"))
    interval = F.struct(
        F.when(both, F.least(lo, hi)).otherwise(lo).alias("value_min"), F.when(both, F.greatest(lo, hi)).otherwise(hi).alias("value_max"),
        F.when(F.col("raw").isNotNull(), F.col("spec.canonical_unit")).alias("unit_canon"), reason.isNotNull().alias("needs_review"), reason.alias("review_reason"),
    )
    return parsed.withColumn("interval", interval).drop("spec", "raw")


def unknown_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """unit, n, n_examples, n_documents of the units that no lookup step knows."""
    missing = with_units(rows, units).where(F.col("spec").isNull() & (F.trim("unit_raw") != ""))
    return missing.groupBy(normalize_spaces("unit_raw").alias("unit")).agg(F.count("*").alias("n"), F.countDistinct("value_raw").alias("n_examples"), F.countDistinct("doc_id").alias("n_documents"))


def extend_units(units: DataFrame, proposals: DataFrame) -> DataFrame:
    """The table with approved proposals (unit, category, multiplier, offset) that it lacks.

    A category that is new takes the proposal with factor 1 and offset 0 as its canonical unit.
    """
    categories = units.groupBy("category").agg(F.min("canonical_unit").alias("canonical_unit"), F.min("zero_delta").alias("zero_delta"))
    own = proposals.where("multiplier = 1 AND offset = 0").groupBy("category").agg(F.min("unit").alias("own_canonical"))
    new = proposals.join(units.select("unit"), "unit", "left_anti").join(categories, "category", "left").join(own, "category", "left")
    named = new.withColumn("canonical_unit", F.coalesce("canonical_unit", "own_canonical")).where("canonical_unit IS NOT NULL")
    return units.unionByName(named.select(*units.columns))


def repair_units(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Parses flagged facts again and takes unit reasons away; other reasons stay."""
    flagged = parse_measurements(facts.where("needs_review"), units)
    kept = F.filter(F.transform(F.split(F.coalesce("review_reason", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("unit"))
    reasons = F.when(F.col("interval.needs_review"), F.array_append(kept, F.col("interval.review_reason"))).otherwise(kept)
    fixed = flagged.withColumn("review_reason", F.nullif(F.array_join(reasons, "; "), F.lit(""))).withColumn("needs_review", F.col("review_reason").isNotNull())
    for c in ("value_min", "value_max", "unit_canon"):
        fixed = fixed.withColumn(c, F.col(f"interval.{c}"))
    return facts.where("NOT needs_review").unionByName(fixed.select(*facts.columns))
