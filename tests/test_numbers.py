import math

import pytest

from factloom.functions import numbers
from factloom.operators import units

# value, unit, operator -> bounds in the canonical unit (None is open), unit, whether it must be reviewed
CASES = [
    ("200", "мг/л", "<", None, 200, "мг/л", False), ("1000", "мг/дм³", "<=", None, 1000, "мг/л", False),
    ("200", "мг/л", ">", 200, None, "мг/л", False), ("200", "мг/л", ">=", 200, None, "мг/л", False), ("250", "мг/л", "=", 250, 250, "мг/л", False),
    ("200-300", "мг/л", "range", 200, 300, "мг/л", False), ("200–300", "мг/л", "range", 200, 300, "мг/л", False), ("от 200 до 300", "мг/л", "range", 200, 300, "мг/л", False),
    ("0,2-0,3", "г/л", "range", 200, 300, "мг/л", False), ("200-300", "мг/л", "", 200, 300, "мг/л", False), ("200...300", "мг/л", None, 200, 300, "мг/л", False),
    ("60", "°C", "~", 54, 66, "°C", False), ("−40", "°C", "~", -44, -36, "°C", False), ("-40", "°C", "~", -44, -36, "°C", False),
    ("0", "°C", "~", -2, 2, "°C", False), ("0", "pH", "~", -0.5, 0.5, "pH", False), ("0", "руб/т", "~", 0, 0, "руб/т", True),
    ("95", None, "=", 95, 95, None, False), ("200-300", None, "range", 200, 300, None, False), ("42", "фунтов/дюйм", "=", 42, 42, None, True),
    ("15000", "$/т", "=", 15000, 15000, "$/т", False), ("0,2", "г/л", "=", 200, 200, "мг/л", False), ("1 000", "мг/л", "=", 1000, 1000, "мг/л", False),
    ("около комнатной", "°C", "~", None, None, None, True), ("200-300", "мг/л", "=", 200, 200, "мг/л", False), ("300", "K", "=", 26.85, 26.85, "°C", False),
    ("300", "K", "<", None, 26.85, "°C", False), ("5", "с", "=", 5, 5, "с", False), ("5", "С", "=", 5, 5, "°C", False), ("1,234.5", "мг/л", "=", 1.234, 1.234, "мг/л", False),
    ("7", "мг/л", "range", 7, 7, "мг/л", True),
]


def test_measurements(spark):
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, value_raw string, unit_raw string, operator_raw string")
    got = {r.k: r.interval for r in units.parse_measurements(rows, units.seed_units(spark)).collect()}
    for k, (value, unit, op, lo, hi, canon, review) in enumerate(CASES):
        i = got[k]
        for have, want in ((i.value_min, lo), (i.value_max, hi)):
            assert (have is None) == (want is None) and (want is None or math.isclose(have, want, abs_tol=1e-9)), (value, unit, op, i)
        assert (i.unit_canon, i.needs_review) == (canon, review), (value, unit, op, i)


@pytest.mark.parametrize(("text", "want"), [("200-300", [200, -300]), ("pH 11,5 и 1 000 мг", [11.5, 1000]), ("нет", []), ("−40", [-40])])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(numbers.numbers("t").alias("n")).first().n == want


def test_overlap_is_symmetric_and_open_sides_overlap(spark):
    ends = [None, 100.0, 200.0, 300.0]
    rows = spark.createDataFrame([(a, b, c, d) for a in ends for b in ends for c in ends for d in ends], "a double, b double, c double, d double")
    out = rows.select("*", numbers.overlaps("a", "b", "c", "d").alias("x"), numbers.overlaps("c", "d", "a", "b").alias("y")).collect()
    inf = math.inf
    for r in out:
        lo1, hi1, lo2, hi2 = (-inf if r.a is None else r.a), (inf if r.b is None else r.b), (-inf if r.c is None else r.c), (inf if r.d is None else r.d)
        assert r.x == r.y == (lo1 <= hi2 and lo2 <= hi1)


def test_contradictions_need_a_gap(spark):
    from pyspark.sql import functions as F

    rows = [(10.0, 20.0, 25.0, 30.0, True), (10.0, 20.0, 23.0, 30.0, False), (None, 20.0, 50.0, 60.0, False), (10.0, 20.0, 15.0, 30.0, False), (50.0, 60.0, 10.0, 20.0, True), (-5.0, 0.0, 1.0, 2.0, True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want boolean")
    assert all(r.got == r.want for r in df.select("want", numbers.contradict(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got")).collect())


def test_unit_repair_keeps_other_reasons(spark):
    facts = spark.createDataFrame(
        [(1, "5", "фут", "=", None, None, None, True, "unknown unit: фут; quote not in the text"), (2, "5", "м", "=", None, None, None, True, "unknown unit: м"), (3, "5", "г/л", "=", 1.0, 1.0, "x", False, None)],
        "fact_id long, value_raw string, unit_raw string, operator_raw string, value_min double, value_max double, unit_canon string, needs_review boolean, review_reason string",
    )
    proposals = spark.createDataFrame([("м", "length", 1.0, 0.0), ("фут", "length", 0.3048, 0.0)], "unit string, category string, multiplier double, offset double")
    table = units.extend_units(units.seed_units(spark), proposals)
    got = {r.fact_id: r for r in units.repair_units(facts, table).collect()}
    assert got[1].review_reason == "quote not in the text" and got[1].unit_canon == "м" and math.isclose(got[1].value_min, 1.524)
    assert got[2].needs_review is False and got[2].review_reason is None and got[3].value_min == 1.0
