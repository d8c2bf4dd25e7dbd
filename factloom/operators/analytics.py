"""Coverage, gaps, quality and contradictions of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import contradict, percent
from factloom.shipping import checkpoint

OPEN_AXIS, GAPS, RISKS = 40, 50, 20
#: Facts of one key that may meet each other all, and how many of a larger key are one run of the sweep.
HOT_FACTS, RUN_FACTS = 1000, 256
#: Claims of one entity that meet its others in one block, and about how many pairs of claims one task holds.
BLOCK_CLAIMS, PAIRS_A_TASK = 1000, 250_000
#: About how many documents of experts one task holds with what they mention.
DOCS_A_TASK = 100_000


def open_axis(entities: DataFrame, mentions: DataFrame, most: int = OPEN_AXIS) -> DataFrame:
    """The entities of an open axis by mentions. One without any counts as one, as one with a single mention does."""
    counted = mentions.groupBy("entity_id").agg(F.count("*").alias("n"))
    return entities.join(counted, "entity_id", "left").withColumn("n_mentions", F.coalesce("n", F.lit(1))).drop("n").orderBy(F.desc("n_mentions"), "entity_id").limit(most)


def find_gaps(materials: DataFrame, processes: DataFrame, evidence: DataFrame) -> DataFrame:
    """material, process, n_documents, n_experiments of all pairs, also those without evidence.

    evidence: material, process, doc_id, experiment_id. Pairs are counted before
    they meet the product of the two axes, which holds one narrow row per pair;
    axes of bounded size come from open_axis.
    """
    counted = evidence.groupBy("material", "process").agg(F.countDistinct("doc_id").alias("nd"), F.countDistinct("experiment_id").alias("ne"))
    pairs = materials.select("material").distinct().crossJoin(processes.select("process").distinct())
    return pairs.join(counted, ["material", "process"], "left").select("material", "process", F.coalesce("nd", F.lit(0)).alias("n_documents"), F.coalesce("ne", F.lit(0)).alias("n_experiments"))


def top_gaps(gaps: DataFrame, most: int = GAPS) -> DataFrame:
    return gaps.orderBy("n_documents", "n_experiments", "material", "process").limit(most)


def coverage(evidence: DataFrame, *axes: str) -> DataFrame:
    """Distinct documents by the given columns."""
    return evidence.groupBy(*axes).agg(F.countDistinct("doc_id").alias("n_documents"))


def risk_zones(statistics: DataFrame, most: int = RISKS) -> DataFrame:
    """Claims with at most one support or with contradictions, most contradicted and least supported first."""
    at_risk = statistics.where((F.col("n_support") <= 1) | (F.col("n_contradictions") > 0))
    return at_risk.orderBy(F.desc("n_contradictions"), "n_support", "claim_id").limit(most)


def share(rows: DataFrame, what: Column, name: str) -> DataFrame:
    """One row: how many rows there are, how many satisfy `what`, and their percentage."""
    counted = rows.agg(F.count("*").alias("n_all"), F.count_if(what).alias("n_hit"))
    return counted.select(F.lit(name).alias("measure"), "n_all", "n_hit", percent("n_hit", "n_all").alias("percent"))


def publications(authored: DataFrame, mentions: DataFrame) -> DataFrame:
    """expert_id, entity_id, n_publications: documents by the expert that mention the entity. Both tables may repeat rows.

    Mentions are told apart where their document is, and counted after a second shuffle, as few of them share expert and
    entity: each in as many partitions as the documents need.
    """
    parts = authored.count() // DOCS_A_TASK + 1
    once, by = (rows.repartition(parts, "doc_id").distinct() for rows in (mentions.select("entity_id", "doc_id"), authored.select("expert_id", "doc_id")))
    each = by.join(once, "doc_id").select("expert_id", "entity_id").repartition(parts, "expert_id", "entity_id")
    return each.groupBy("expert_id", "entity_id").agg(F.count("*").alias("n_publications"))


def stale_versions(docs: DataFrame) -> DataFrame:
    """Documents older than the latest import of their path; several of the same time all stay."""
    latest = docs.groupBy("source_path").agg(F.max("imported_at").alias("latest"))
    return docs.join(latest, "source_path").where(F.col("imported_at") < F.col("latest")).drop("latest")


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Unresolved entities that no edge touches."""
    touched = edges.select(F.explode(F.array("src_key", "dst_key")).alias("entity_id"))
    return entities.where(F.coalesce("unresolved", F.lit(False))).join(touched, "entity_id", "left_anti")


def contradiction_pairs(facts: DataFrame, gap: float = 0.2, hot: int = HOT_FACTS, run: int = RUN_FACTS) -> DataFrame:
    """Pairs of facts on one source and parameter, in one unit, of different documents, that are apart by more than gap (below 2).

    facts: fact_id, source, parameter, doc_id, unit, value_min, value_max; rows with an open bound contradict nothing.
    The facts of most keys meet in an equi-join. Those of a key with over `hot` facts are swept instead, see `_swept`: what
    is compared there grows with the pairs that come out, not with the square of the facts.
    """
    key = ["source", "parameter", "unit_key"]
    closed = facts.where(F.col("value_min").isNotNull() & F.col("value_max").isNotNull())
    closed = checkpoint(closed.select("fact_id", "source", "parameter", F.coalesce(F.concat(F.lit("="), F.col("unit").cast("string")), F.lit("")).alias("unit_key"), "doc_id", "value_min", "value_max"))
    many = checkpoint(closed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*key))
    if many.isEmpty():
        pairs = _met(closed)
    else:
        pairs = _met(closed.join(many, key, "left_anti")).unionByName(_swept(closed.join(many, key, "left_semi"), gap, run))
    apart = contradict(F.col("a_min"), F.col("a_max"), F.col("b_min"), F.col("b_max"), gap)
    return pairs.where(apart).select("source", "parameter", F.least("a_fact", "b_fact").alias("fact_a"), F.greatest("a_fact", "b_fact").alias("fact_b"))


def _sides(facts: DataFrame, also: list[str]) -> tuple[DataFrame, DataFrame]:
    names = {"fact_id": "fact", "doc_id": "doc", "value_min": "min", "value_max": "max"}
    return tuple(facts.select("source", "parameter", "unit_key", *also, *[F.col(c).alias(f"{side}_{n}") for c, n in names.items()]) for side in "ab")


def _met(facts: DataFrame) -> DataFrame:
    """Each fact with those of its key that begin above its end."""
    a, b = _sides(facts, [])
    return a.join(b, ["source", "parameter", "unit_key"]).where("a_max < b_min AND a_doc != b_doc")


def _swept(facts: DataFrame, gap: float, run: int) -> DataFrame:
    """The same for keys of very many facts.

    All lower bounds of a key, and for each fact the least value at which
    another one must begin to be far enough from it, are sorted together into
    ranges over all partitions. The lower bounds before a fact's least value are
    counted, so each fact knows from which place on all others contradict it.
    Places are dealt into runs of `run`; a fact goes to the runs from its place
    on and meets each as a whole, so only in its first run it meets any in vain.
    """
    key = ["source", "parameter", "unit_key"]
    far = F.when(F.col("value_max") > 0, F.col("value_max") * (1 + gap)).otherwise(F.col("value_max") / (1 + gap))
    # A little lower than exact, as the pairs are tested afterwards and rounding may not lose any.
    far = far - F.abs(far) * 1e-9
    begins = facts.select("*", F.col("value_min").alias("at"), F.lit(1).alias("begins"))
    asks = facts.select("*", F.greatest(far, F.col("value_max")).alias("at"), F.lit(0).alias("begins"))
    order = [*key, "at", "begins", "fact_id"]
    swept = checkpoint(begins.unionByName(asks).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    in_part = Window.partitionBy(*key, "part").orderBy("at", "begins", "fact_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A key has one row here for each partition that holds some of it.
    per_part = swept.groupBy(*key, "part").agg(F.sum("begins").alias("n"))
    starts = per_part.select(*key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(*key)).alias("in_all"))
    placed = swept.withColumn("within", F.coalesce(F.sum("begins").over(in_part), F.lit(0))).join(starts, [*key, "part"])
    placed = checkpoint(placed.withColumn("place", F.col("start") + F.col("within")).drop("part", "within", "start", "at"))
    a, b = _sides(placed, ["begins", "place", "in_all"])
    a = a.where("begins = 0 AND place < in_all")
    runs = a.withColumn("run", F.explode(F.sequence(F.floor(F.col("place") / run), F.floor((F.col("in_all") - 1) / run)))).withColumnRenamed("place", "from_place")
    # The rows of one run are few, those that come to it may be very many: they are dealt into blocks, each with a copy of the run.
    block = F.pmod(F.xxhash64("a_fact"), F.greatest(F.lit(1), F.floor(F.col("in_all") / (64 * run)))).alias("block")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.floor(F.col("in_all") / (64 * run))) - 1)).alias("block")
    copied = b.where("begins = 1").select(*key, F.floor(F.col("place") / run).alias("run"), "place", "b_fact", "b_doc", "b_min", "b_max", blocks)
    asked = runs.select(*key, "run", "from_place", "a_fact", "a_doc", "a_min", "a_max", block)
    met = asked.join(copied, [*key, "run", "block"]).where("place >= from_place AND a_max < b_min AND a_doc != b_doc")
    return met.select(*key, *[f"{s}_{n}" for s in "ab" for n in ("fact", "doc", "min", "max")])


def claim_of(claims: Column | str, doc_id: Column | str, fact_id: Column | str) -> Column:
    """The first claim of a fact, or the id of one made for it."""
    made = F.concat(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit("#auto-"), F.translate(F.col(fact_id) if isinstance(fact_id, str) else fact_id, ":", "_"))
    return F.coalesce(F.try_element_at(F.col(claims) if isinstance(claims, str) else claims, F.lit(1)), made)


def contradiction_edges(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_a, claim_b (a < b): one edge for each pair of claims, however many facts of theirs contradict. claims: fact_id, claim_id."""
    a = claims.select(F.col("fact_id").alias("fact_a"), F.col("claim_id").alias("x"))
    b = claims.select(F.col("fact_id").alias("fact_b"), F.col("claim_id").alias("y"))
    met = pairs.join(a, "fact_a").join(b, "fact_b").where("x != y")
    return met.select(F.least("x", "y").alias("claim_a"), F.greatest("x", "y").alias("claim_b")).distinct()


def claims_met(about: DataFrame, entity: str = "entity_id", block: int = BLOCK_CLAIMS) -> tuple[DataFrame, int]:
    """Rows entity, a, b of two claims on one entity, a's claim_id the lesser, and a number of partitions for them. about: claim_id, the entity and more, which a and b hold.

    Claims of an entity of over `block` claims are dealt into blocks, and each block of a's meets each of b's by itself, so no
    task has all its pairs. The partitions grow with the pairs, as these grow faster than the claims.
    """
    about = checkpoint(about)
    counted = about.groupBy(entity).agg(F.count("*").alias("n"))
    parts = (counted.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0) // (2 * PAIRS_A_TASK) + 1
    sized = about.join(counted.select(entity, F.ceil(F.col("n") / block).alias("blocks")), entity)
    row = F.struct(*[c for c in about.columns if c != entity])
    own, every = F.pmod(F.xxhash64("claim_id"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    a = sized.select(entity, own.alias("of_a"), every.alias("of_b"), row.alias("a"))
    b = sized.select(entity, every.alias("of_a"), own.alias("of_b"), row.alias("b"))
    key = [entity, "of_a", "of_b"]
    met = a.repartition(parts, *key).join(b.repartition(parts, *key), key)
    return met.where("a.claim_id < b.claim_id").select(entity, "a", "b"), parts


def _opposite() -> Column:
    return F.coalesce(F.array_sort(F.array("a.polarity", "b.polarity")) == F.array(F.lit("negative"), F.lit("positive")), F.lit(False))


def opposing_claims(about: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs of claims on one entity from different documents without a contradiction yet; opposite polarities are marked.

    about: claim_id, entity_id, doc_id, polarity. existing: claim_a, claim_b with a < b. Known pairs meet the
    others in partitions whose number grows with the pairs.
    """
    met, parts = claims_met(about)
    pairs = met.where("a.doc_id != b.doc_id").select(F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), _opposite().alias("opposite"))
    named = pairs.repartition(parts, "claim_a", "claim_b").groupBy("claim_a", "claim_b").agg(F.max("opposite").alias("opposite"))
    return named.join(existing.select("claim_a", "claim_b").repartition(parts, "claim_a", "claim_b"), ["claim_a", "claim_b"], "left_anti")


def opposing_pairs(claims: DataFrame, contradictions: DataFrame) -> DataFrame:
    """entity, a, b, opposite: the claims of two documents about one entity that no contradiction links yet. claims: claim_id, entity, doc_id, polarity; contradictions: a, b.

    Pairs of claims about one entity are the result, so an entity with very many claims gives very many pairs.
    """
    met, parts = claims_met(claims, "entity")
    pairs = met.where("a.doc_id != b.doc_id").select("entity", F.col("a.claim_id").alias("a"), F.col("b.claim_id").alias("b"), _opposite().alias("opposite"))
    known = contradictions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition(parts, "a", "b").distinct()
    return pairs.repartition(parts, "a", "b").join(known, ["a", "b"], "left_anti").select("entity", "a", "b", "opposite")


def largest_public(docs: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """doc_id, n_chunks: the public documents with the most chunks."""
    public = docs.where("access_level = 'public'").select("doc_id")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).join(public, "doc_id", "left_semi").orderBy(F.desc("n_chunks"), "doc_id").limit(most)


def facts_with_claims(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """Facts with claim_ids: the claims of the fact's document about its source, sorted, none as an empty array. facts: fact_id, source, doc_id; claims: claim_id, doc_id, about."""
    held = claims.select("claim_id", "doc_id", F.explode("about").alias("source")).groupBy("doc_id", "source").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))
    return facts.join(held, ["doc_id", "source"], "left").withColumn("claim_ids", F.coalesce("claim_ids", F.array().cast("array<string>")))


def dashboard(facts: DataFrame, entities: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """section, item, value: the counts and shares of a dashboard as one table.

    facts: needs_review; entities: unresolved; claims: n_support, n_contradictions (see claim statistics); docs: domain, year.
    """
    shares = share(facts, F.col("needs_review"), "needs_review").union(share(entities, F.col("unresolved"), "unresolved"))
    quality = shares.select(F.lit("quality").alias("section"), F.col("measure").alias("item"), F.col("percent").cast("double").alias("value"))
    at_risk = claims.agg(F.count_if((F.col("n_support") <= 1) | (F.col("n_contradictions") > 0)).alias("n")).select(F.lit("risk"), F.lit("claims"), F.col("n").cast("double"))
    covered = docs.groupBy("domain", "year").agg(F.countDistinct("doc_id").alias("n")).select(F.lit("coverage"), F.concat_ws(" ", "domain", F.col("year").cast("string")), F.col("n").cast("double"))
    return quality.union(at_risk).union(covered)


def branches(rows: DataFrame, by: str, named: dict[str, str]) -> DataFrame:
    """Rows with branch: a comparison of values of a column, such as home and abroad, in one pass; rows of other values go."""
    names = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    return rows.withColumn("branch", F.try_element_at(names, F.col(by))).where("branch IS NOT NULL")
