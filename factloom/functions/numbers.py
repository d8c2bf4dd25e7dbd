"""Numbers, ranges and half-open intervals as column expressions. An open side is NULL, never infinity or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import bind as let
from factloom.functions.text import column, normalize_spaces

# Dashes that serve as minus or as range sign, and spaces between digits.
DASHES = "-‐‑‒–—−"
DIGIT_SPACES = "    "

_UNSIGNED = rf"\d[\d{DIGIT_SPACES}]*(?:[.,]\d+)?"
_SIGNED = rf"[{DASHES}]?{_UNSIGNED}"


def parse_number(token: Column | str) -> Column:
    """A number's text as a double: spaces between digits go; a comma is decimal unless a dot is there as well."""
    t = F.trim(column(token))
    t = F.concat(F.translate(F.substring(t, 1, 1), DASHES + DIGIT_SPACES, "-" * len(DASHES)), F.translate(F.substring(t, F.lit(2), F.length(t)), DIGIT_SPACES, ""))
    t = let(t, lambda x: F.when(x.contains("."), F.replace(x, F.lit(","), F.lit(""))).otherwise(F.replace(x, F.lit(","), F.lit("."))))
    return let(t, lambda x: F.when(x.rlike(r"\A-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), x.try_cast("double")))


def numbers(text: Column | str) -> Column:
    """All numbers of a text in order, signs included: `200-300` holds 200 and -300."""
    found = F.transform(F.regexp_extract_all(column(text), F.lit(_SIGNED), F.lit(0)), parse_number)
    return F.filter(found, lambda x: x.isNotNull())


def number_tokens(text: Column | str) -> Column:
    """The numbers of a text without sign, as digits with a decimal dot."""
    found = F.regexp_extract_all(column(text), F.lit(_UNSIGNED), F.lit(0))
    return F.transform(found, lambda x: F.translate(x, f",{DIGIT_SPACES}", "."))


def detect_range(text: Column | str) -> Column:
    """(lo, hi) of `от X до Y`, `X..Y` or `X–Y`, in this order of preference, else NULL. A single negative number is none."""
    def by(t: Column, could: Column, pattern: str) -> Column:
        ends = F.transform(F.array(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)), parse_number)
        return F.when(could, let(F.filter(ends, lambda x: x.isNotNull()), lambda x: F.when(F.size(x) == 2, F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi")))))

    # Most texts are no range, which a look for what a range needs finds sooner than its pattern.
    return let(
        normalize_spaces(text),
        lambda t: F.coalesce(
            by(t, F.lower(F.upper(t)).contains("до"), rf"(?iu)от\s*({_SIGNED})\s*до\s*({_SIGNED})"),
            by(t, t.contains(".."), rf"({_SIGNED})\s*\.{{2,}}\s*({_UNSIGNED})"),
            by(t, F.translate(t, DASHES, "") != t, rf"({_SIGNED})\s*[{DASHES}]\s*({_SIGNED})"),
        ),
    )


def interval(lo: Column, hi: Column, review: Column | None = None) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), (review if review is not None else F.lit(None).cast("string")).alias("reason"))


def approximate(v: Column, zero_delta: Column) -> Column:
    """10 % around v; around zero the category's absolute delta, and without one a point to be reviewed."""
    around = interval(F.least(0.9 * v, 1.1 * v), F.greatest(0.9 * v, 1.1 * v))
    zero = F.when(zero_delta.isNotNull(), interval(-F.abs(zero_delta), F.abs(zero_delta))).otherwise(interval(F.lit(0.0), F.lit(0.0), F.lit("about zero without a delta of the category")))
    return F.when(v == 0, zero).otherwise(around)


def raw_interval(value: Column | str, operator: Column | str, zero_delta: Column | None = None) -> Column:
    """The interval (lo, hi, reason) that a value's text and its operator mean, in the unit of the text; NULL if there is none.

    `=` and comparisons take the first number even of a range; an empty or unknown operator takes the range if there is one.
    """
    op = F.lower(F.trim(F.coalesce(column(operator), F.lit(""))))
    delta = zero_delta if zero_delta is not None else F.lit(None).cast("double")
    read = F.struct(op.alias("op"), detect_range(value).alias("rng"), numbers(value).alias("nums"), delta.alias("delta"))
    return let(read, lambda x: _by_operator(x["op"], x["rng"], x["nums"], x["delta"]))


def _by_operator(op: Column, rng: Column, nums: Column, delta: Column) -> Column:
    nothing = F.lit(None).cast("double")
    v, second = F.coalesce(F.try_element_at(nums, F.lit(1)), rng["lo"]), F.try_element_at(nums, F.lit(2))
    return (
        F.when(rng.isNotNull() & ~op.isin("<", "<=", ">", ">=", "~", "="), interval(rng["lo"], rng["hi"]))
        .when(v.isNull(), F.lit(None))
        .when(op.isin("<", "<="), interval(nothing, v))
        .when(op.isin(">", ">="), interval(v, nothing))
        .when(op == "=", interval(v, v))
        .when(op == "~", let(F.struct(v.alias("v"), delta.alias("d")), lambda x: approximate(x["v"], x["d"])))
        .when((op == "range") & second.isNotNull(), interval(F.least(v, second), F.greatest(v, second)))
        .when(op == "range", interval(v, v, F.lit("a range of a single number")))
        .otherwise(interval(v, v))
    )


def overlaps(a_min: Column | str, a_max: Column | str, b_min: Column | str, b_max: Column | str) -> Column:
    """Whether two intervals share a point; a NULL bound is open on its side. Never NULL."""
    a_min, a_max, b_min, b_max = map(column, (a_min, a_max, b_min, b_max))
    return (a_max.isNull() | b_min.isNull() | (a_max >= b_min)) & (a_min.isNull() | b_max.isNull() | (a_min <= b_max))


def contradict(a_min: Column, a_max: Column, b_min: Column, b_max: Column, gap: float = 0.2) -> Column:
    """Whether two closed intervals are apart by more than the share `gap` of the smaller near bound; open ones never are."""
    near_a = F.when(a_max < b_min, a_max).otherwise(a_min)
    near_b = F.when(a_max < b_min, b_min).otherwise(b_max)
    apart = F.abs(near_b - near_a)
    scale = F.least(F.abs(near_a), F.abs(near_b))
    closed = a_min.isNotNull() & a_max.isNotNull() & b_min.isNotNull() & b_max.isNotNull()
    disjoint = (a_max < b_min) | (b_max < a_min)
    return F.coalesce(closed & disjoint & F.when(scale == 0, apart > 0).otherwise(apart / scale > gap), F.lit(False))


def percent(part: Column | str, whole: Column | str) -> Column:
    """A share in percent with one decimal; 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(100 * column(part), column(whole)), 1), F.lit(0.0))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def short_number(x: Column) -> Column:
    """A double with six significant digits at most, as %g writes it: no needless zeros, an exponent below -4 and from 6 on."""

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(?=e|\z)", "$1"), r"\.(?=e|\z)", "")

    # The exponent is that of the number rounded to six digits.
    science = F.format_string("%.5e", x)
    exponent = F.substring_index(science, "e", -1).cast("int")
    plain = F.coalesce(*[F.when(exponent == k, F.format_string(f"%.{5 - k}f", x)) for k in range(-4, 6)])
    return F.when(x == 0, "0").when((exponent < -4) | (exponent > 5), trimmed(science)).otherwise(trimmed(plain))


def render_value(lo: Column | str, hi: Column | str, unit: Column | str, text: Column | str) -> Column:
    """`= a–b u`, `= a u`, `≥a u`, `≤b u`, or the text in quotation marks."""
    lo, hi, text = column(lo), column(hi), column(text)
    u = F.coalesce(F.concat(F.lit(" "), column(unit)), F.lit(""))
    return (
        F.when(lo.isNotNull() & hi.isNotNull() & (lo == hi), F.concat(F.lit("= "), short_number(lo), u))
        .when(lo.isNotNull() & hi.isNotNull(), F.concat(F.lit("= "), short_number(lo), F.lit("–"), short_number(hi), u))
        .when(lo.isNotNull(), F.concat(F.lit("≥"), short_number(lo), u))
        .when(hi.isNotNull(), F.concat(F.lit("≤"), short_number(hi), u))
        .when(text.isNotNull(), F.concat(F.lit("«"), text, F.lit("»")))
    )


def percent_points(text: Column | str) -> Column:
    """The second percentage of a text minus the first; NULL without two."""
    found = F.transform(F.regexp_extract_all(column(text), F.lit(r"(\d+(?:[.,]\d+)?)\s*%"), F.lit(1)), parse_number)
    return F.when(F.size(found) >= 2, F.try_element_at(found, F.lit(2)) - F.try_element_at(found, F.lit(1)))


def number_pattern(token: Column) -> Column:
    """A regular expression that finds a number token in a text, with spaces between digits and either decimal sign."""
    whole = F.array_join(F.split(F.substring_index(token, ".", 1), ""), f"[{DIGIT_SPACES}]?")
    fraction = F.when(token.contains("."), F.concat(F.lit(r"\s*[.,]\s*"), F.substring_index(token, ".", -1), F.lit(r"(?!\d)"))).otherwise(F.lit(rf"(?![\d{DIGIT_SPACES}]*\d)(?![.,]\d)"))
    return F.concat(F.lit(r"(?<!\d)"), whole, fraction)
