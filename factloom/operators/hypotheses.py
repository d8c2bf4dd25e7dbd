"""Hypotheses: grounding, four transparent scores, and re-weighting without another retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import clip01, parse_number
from factloom.functions.text import containment

VERIFIED = 0.55


@dataclass(frozen=True)
class Weights:
    """The weights of the four scores and of their parts."""

    novelty: float = 0.30
    value: float = 0.30
    testability: float = 0.25
    risk: float = 0.15
    corpus_distance: float = 0.7
    rarity: float = 0.3
    abc_bonus: float = 0.2
    alignment: float = 0.5
    magnitude: float = 0.3
    authority: float = 0.2
    metric: float = 0.4
    controllable: float = 0.3
    feasibility: float = 0.3
    unfaithful: float = 0.4
    ungrounded: float = 0.3
    extrapolation: float = 0.2
    contradiction: float = 0.1


def faithfulness(statement: Column | str, text: Column | str, similarity: Column | str) -> Column:
    """The better of shared word stems and vector similarity."""
    sim = F.col(similarity) if isinstance(similarity, str) else similarity
    return F.greatest(containment(statement, text), F.greatest(F.lit(0.0), sim))


def verify(statements: DataFrame, threshold: float = VERIFIED) -> DataFrame:
    """statement_id, hypothesis_id, faithfulness, verified: the best of each statement's citations.

    statements: hypothesis_id, statement_id, statement, text, similarity, a row per citation.
    """
    best = statements.groupBy("hypothesis_id", "statement_id").agg(F.max(faithfulness("statement", "text", "similarity")).alias("best"))
    return best.select("hypothesis_id", "statement_id", F.round("best", 3).alias("faithfulness"), (F.col("best") >= threshold).alias("verified"))


def grounded(verified: DataFrame) -> DataFrame:
    """hypothesis_id of hypotheses with a verified statement; the others are dropped."""
    return verified.where("verified").select("hypothesis_id").distinct()


def magnitude(text: Column) -> Column:
    """A fifth of the first number of an expected effect, at most 1; 0.3 without one."""
    found = F.abs(parse_number(F.regexp_extract(text, r"-?\d+(?:[.,]\d+)?", 0)))
    return F.when(found.isNotNull(), clip01(found / 5.0)).otherwise(F.lit(0.3))


def authority(authoritative: Column, recent: Column, n: Column) -> Column:
    """By the shares of authoritative and of recent citations; 0.3 without any."""
    return F.when(n > 0, clip01(0.6 * authoritative / n + 0.4 * recent / n)).otherwise(F.lit(0.3))


def scores(h: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Adds novelty, value, testability and risk, each clipped to 0..1 and rounded to 3 places.

    h: max_similarity, rarity, is_abc, alignment, effect, n_citations, n_authoritative,
    n_recent, metric, n_factors, n_controllable, mean_faithfulness, unverified_share, contradicted.
    """
    bonus, flag = F.when(F.col("is_abc"), w.abc_bonus).otherwise(0.0), F.when(F.col("is_abc"), 0.5).otherwise(0.0)
    factors = F.col("n_factors")
    novelty = w.corpus_distance * (1 - F.col("max_similarity")) + w.rarity * F.col("rarity") + bonus
    value = w.alignment * clip01(F.col("alignment")) + w.magnitude * magnitude(F.col("effect")) + w.authority * authority(F.col("n_authoritative"), F.col("n_recent"), F.col("n_citations"))
    testability = w.metric * F.col("metric") + w.controllable * F.when(factors > 0, F.col("n_controllable") / factors).otherwise(0.0) + w.feasibility * (1 - F.least(F.lit(1.0), factors / 5.0))
    risk = w.unfaithful * (1 - F.col("mean_faithfulness")) + w.ungrounded * F.col("unverified_share") + w.extrapolation * flag + w.contradiction * F.when(F.col("contradicted"), 1.0).otherwise(0.0)
    return h.withColumns({k: F.round(clip01(v), 3) for k, v in (("novelty", novelty), ("value", value), ("testability", testability), ("risk", risk))})


def totals(scored: DataFrame, w: Weights = Weights(), top: int | None = None) -> DataFrame:
    """Adds total and rank. Takes scores only, so other weights need no new retrieval."""
    signed = {"novelty": w.novelty, "value": w.value, "testability": w.testability, "risk": -w.risk}
    # In decimals, so that a half is rounded as a half.
    parts = {f"{k}_contribution": F.round(F.lit(str(weight)).cast("decimal(9,4)") * F.col(k).cast("decimal(9,3)"), 3).cast("double") for k, weight in signed.items()}
    total = F.round(clip01(sum((F.col(f"{k}_contribution") for k in signed), F.lit(0.0))), 3)
    ranked = scored.withColumns(parts).withColumn("total", total)
    if top is not None:
        ranked = ranked.orderBy(F.desc("total"), "hypothesis_id").limit(top)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "hypothesis_id")).cast("long"))


def rarity(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """hypothesis_id, rarity: 1 less the share of the strongest link among a hypothesis's entities; 0.6 for fewer than two.

    pairs: hypothesis_id, a, b (a < b, both NULL without a pair). weights: a, b, weight.
    """
    most = weights.agg(F.max("weight").alias("most"))
    held = pairs.join(weights, ["a", "b"], "left").groupBy("hypothesis_id").agg(F.max("weight").alias("strongest"), F.count("a").alias("n"))
    return held.crossJoin(most).select("hypothesis_id", F.when(F.col("n") == 0, 0.6).otherwise(clip01(1.0 - F.coalesce(F.try_divide("strongest", "most"), F.lit(0.0)))).alias("rarity"))


def numbered_citations(context: DataFrame) -> DataFrame:
    """Adds citation, C1, C2 and so on by the first appearance of each chunk within its query. context: query_id, chunk_id, ord."""
    first = context.groupBy("query_id", "chunk_id").agg(F.min("ord").alias("ord"))
    order = Window.partitionBy("query_id").orderBy("ord", "chunk_id")
    return first.withColumn("citation", F.concat(F.lit("C"), F.row_number().over(order)))
