"""Strict filters: documents that satisfy all axes, the axis that empties the result, and relaxation.

An axis is a set of alternatives; axes combine by AND. All questions about a
set of axes are answered from one table of a flag per document and axis, so
counts for every prefix of axes take one aggregation instead of a query each.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import overlaps

#: The order in which axes are given up.
RELAX_ORDER = ("geography", "years", "numeric", "conditions_text", "equipment", "processes", "materials", "doc_types")
PUBLIC, PARTNER = "public", "partner"


@dataclass(frozen=True)
class NumericCondition:
    parameter: str
    value_min: float | None = None
    value_max: float | None = None


@dataclass(frozen=True)
class Filters:
    geography: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    doc_types: tuple[str, ...] = ()
    materials: tuple[str, ...] = ()
    processes: tuple[str, ...] = ()
    equipment: tuple[str, ...] = ()
    numeric: tuple[NumericCondition, ...] = ()
    conditions_text: tuple[str, ...] = field(default=())

    def active(self) -> tuple[str, ...]:
        """The axes in use, in the order in which they are given up."""
        on = {
            "geography": self.geography is not None, "years": self.year_from is not None or self.year_to is not None,
            "numeric": bool(self.numeric), "conditions_text": bool(self.conditions_text), "equipment": bool(self.equipment),
            "processes": bool(self.processes), "materials": bool(self.materials), "doc_types": bool(self.doc_types),
        }
        return tuple(k for k in RELAX_ORDER if on[k])


def live(facts: DataFrame) -> DataFrame:
    """Facts that strict filters may use: neither under review nor deleted."""
    return facts.where(~F.coalesce("needs_review", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)))


def visible(docs: DataFrame, role: str) -> DataFrame:
    """Documents that a role may see. An access level that is not known hides a document from partners."""
    return docs.where(F.col("access_level") == PUBLIC) if role == PARTNER else docs


def _scalar(f: Filters, axis: str) -> Column | None:
    if axis == "geography":
        return F.col("geography") == f.geography
    if axis == "years":
        parts = ([F.col("year") >= f.year_from] if f.year_from is not None else []) + ([F.col("year") <= f.year_to] if f.year_to is not None else [])
        return reduce(lambda a, b: a & b, parts)
    if axis == "doc_types":
        return F.col("doc_type").isin(*f.doc_types)
    return None


def _evidence(f: Filters, axis: str, mentions: DataFrame, facts: DataFrame) -> list[DataFrame]:
    """For an axis on edges: the ids of the documents that satisfy it, one table for each condition that must hold."""
    if axis in ("materials", "processes", "equipment"):
        return [mentions.where(F.col("entity_id").isin(*getattr(f, axis))).select("doc_id")]
    if axis == "numeric":
        return [live(facts).where((F.col("parameter") == c.parameter) & overlaps("value_min", "value_max", F.lit(c.value_min).cast("double"), F.lit(c.value_max).cast("double"))).select("doc_id") for c in f.numeric]
    return [live(facts).where(F.contains(F.lower("value_text"), F.lit(t.lower()))).select("doc_id") for t in f.conditions_text]


def strict_filter(docs: DataFrame, mentions: DataFrame, facts: DataFrame, f: Filters, role: str = "researcher", axes: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id of the visible documents that satisfy all axes (by default all in use). Conditions on edges are semi-joins."""
    out = visible(docs, role)
    chosen = f.active() if axes is None else axes
    for axis in chosen:
        if (where := _scalar(f, axis)) is not None:
            out = out.where(where)
    for axis in chosen:
        if _scalar(f, axis) is None:
            for found in _evidence(f, axis, mentions, facts):
                out = out.join(found, "doc_id", "left_semi")
    return out.select("doc_id")


def axis_flags(docs: DataFrame, mentions: DataFrame, facts: DataFrame, f: Filters, role: str = "researcher") -> DataFrame:
    """doc_id and a boolean for each axis in use, of the visible documents."""
    out, flags = visible(docs, role), []
    for k, axis in enumerate(f.active()):
        where = _scalar(f, axis)
        if where is None:
            where = F.lit(True)
            for n, found in enumerate(_evidence(f, axis, mentions, facts)):
                name = f"factloom_{k}_{n}"
                out = out.join(found.distinct().withColumn(name, F.lit(True)), "doc_id", "left")
                where = where & F.coalesce(name, F.lit(False))
        flags.append(F.coalesce(where, F.lit(False)).alias(axis))
    return out.select("doc_id", *flags)


def _together(axes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a) for a in axes], F.lit(True))


def zeroed_by(flags: DataFrame) -> DataFrame:
    """One row: the axis that, with axes added from the last given up to the first, empties the result; and the counts.

    Axes are the flag columns, in the order in which they are given up.
    """
    axes = tuple(c for c in flags.columns if c != "doc_id")
    added = [axes[-k:] for k in range(1, len(axes) + 1)]
    counted = flags.agg(F.count("*").alias("n_all"), *[F.count_if(_together(a)).alias(f"with_{a[0]}") for a in added])
    emptied = F.coalesce(*[F.when(F.col(f"with_{a[0]}") == 0, F.lit(a[0])) for a in added], F.lit(None).cast("string"))
    return counted.withColumn("zeroed_by", emptied)


def relaxed(flags: DataFrame) -> DataFrame:
    """One row: how many axes must be given up for a result, which ones (comma-joined), and its count.

    If all are given up, the count is that of all visible documents.
    """
    axes = tuple(c for c in flags.columns if c != "doc_id")
    counts = flags.agg(*[F.count_if(_together(axes[k:])).alias(f"n_{k}") for k in range(len(axes) + 1)])
    steps = [F.when(F.col(f"n_{k}") > 0, F.struct(F.lit(k).cast("long").alias("n_dropped"), F.lit(",".join(axes[:k])).alias("dropped"), F.col(f"n_{k}").alias("n_documents"))) for k in range(len(axes))]
    k = len(axes)
    last = F.struct(F.lit(k).cast("long").alias("n_dropped"), F.lit(",".join(axes)).alias("dropped"), F.col(f"n_{k}").alias("n_documents"))
    return counts.select(F.coalesce(*steps, last).alias("x")).select("x.*")


def run(docs: DataFrame, mentions: DataFrame, facts: DataFrame, f: Filters, role: str = "researcher") -> dict:
    """What a filter request answers: the documents, how many, which axis emptied them and what was given up instead."""
    flags = axis_flags(docs, mentions, facts, f, role)
    axes = f.active()
    if not axes:
        return {"documents": flags.select("doc_id"), "count": flags.count(), "applied": [], "zeroed_by": None, "relaxed": []}
    given_up = relaxed(flags).first()
    dropped = given_up["dropped"].split(",") if given_up["n_dropped"] else []
    kept = tuple(a for a in axes if a not in dropped)
    return {"documents": strict_filter(docs, mentions, facts, f, role, kept), "count": given_up["n_documents"], "applied": list(kept), "zeroed_by": zeroed_by(flags).first()["zeroed_by"] if dropped else None, "relaxed": dropped}


def chunk_filter(chunks: DataFrame, include_deprecated: bool = False, min_year: int | None = None, doc_types: tuple[str, ...] = (), langs: tuple[str, ...] = (), require_entities: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that a retrieval may use; a missing year counts as 0, and all required entities must be in the chunk."""
    out = chunks if include_deprecated else chunks.where(F.coalesce("authority", F.lit("normal")) != "deprecated")
    if min_year is not None:
        out = out.where(F.coalesce("year", F.lit(0)) >= min_year)
    if doc_types:
        out = out.where(F.col("doc_type").isin(*doc_types))
    if langs:
        out = out.where(F.col("lang").isin(*langs))
    if require_entities:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, require_entities)), F.coalesce("entities", F.array().cast("array<string>")))) == 0)
    return out
