"""The property graph as tables: degrees, hubs, bounded searches, secured views, co-occurrence and A-B-C links.

nodes: node_key, label, name and label-specific columns. edges: src_key, dst_key, rel_type, source_doc_id, deleted and more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.shipping import checkpoint, fresh_folder

# The kinds of edges that searches follow, and the bounds of a search.
TRAVERSED = (
    "USES_MATERIAL", "HAS_CONDITION", "PRODUCES", "STUDIES", "USED_EQUIPMENT", "EXPERT_IN", "MENTIONED_IN", "AUTHORED",
    "ABOUT", "SUPPORTED_BY", "CONTRADICTS",
)
HUB_DEGREE, HUB_NEIGHBOURS, MOST_NODES, MOST_DEPTH = 1000, 25, 300, 4
TARGET_TYPES = ("reagent", "process", "parameter")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: key, other and the edge's columns; loops once."""
    there = edges.select(F.col("src_key").alias("key"), F.col("dst_key").alias("other"), *[c for c in edges.columns if c not in ("src_key", "dst_key")])
    back = edges.where("src_key != dst_key").select(F.col("dst_key").alias("key"), F.col("src_key").alias("other"), *[c for c in edges.columns if c not in ("src_key", "dst_key")])
    return there.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """node_key, degree over all edges, deleted ones included."""
    ends = edges.select(F.explode(F.array("src_key", "dst_key")).alias("node_key"))
    return ends.groupBy("node_key").agg(F.count("*").alias("degree"))


def split_hubs(edges: DataFrame, starts: DataFrame, limit: int = HUB_DEGREE) -> tuple[DataFrame, DataFrame]:
    """node_key, degree of the start nodes that are expanded, and of the hubs that are not. Only the starts' ends of edges are counted."""
    ends = edges.select(F.explode(F.array("src_key", "dst_key")).alias("node_key")).join(starts.select("node_key"), "node_key", "left_semi")
    known = starts.join(ends.groupBy("node_key").agg(F.count("*").alias("degree")), "node_key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return known.where(F.col("degree") <= limit), known.where(F.col("degree") > limit)


def hub_neighbours(edges: DataFrame, hubs: DataFrame, years: DataFrame, most: int = HUB_NEIGHBOURS) -> DataFrame:
    """hub, neighbour, last_year, rank: each hub's neighbours by the latest year of their documents, unknown years last.

    years: node_key, year. Neighbours of a hub are aggregated first, so a hub's edges never meet in one sort.
    """
    near = both_ways(edges.select("src_key", "dst_key")).join(hubs.select(F.col("node_key").alias("key")), "key", "left_semi").distinct()
    last = years.groupBy("node_key").agg(F.max("year").alias("last_year"))
    dated = near.join(last, near["other"] == last["node_key"], "left").select(F.col("key").alias("hub"), F.col("other").alias("neighbour"), "last_year")
    order = Window.partitionBy("hub").orderBy(F.desc_nulls_last("last_year"), "neighbour")
    return dated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def adjacency(edges: DataFrame, most_degree: int = HUB_DEGREE) -> DataFrame:
    """key, others: the neighbours of each node over the traversed kinds, deleted edges included, written once in buckets by key.

    A node with over most_degree neighbours is a hub: it can be reached, but has no row, so no search goes on from it and
    no row is longer than that. Hubs are found by counts that are summed up before they are shuffled.
    """
    spark = edges.sparkSession
    steps = both_ways(edges.where(F.col("rel_type").isin(*TRAVERSED)).select("src_key", "dst_key")).distinct()
    path = fresh_folder(spark, "steps")
    steps.write.parquet(path)
    steps = spark.read.parquet(path)
    held = steps.groupBy("key").agg(F.count("*").alias("degree"))
    few = steps.join(held.where(F.col("degree") > most_degree).select("key"), "key", "left_anti")
    name = f"adjacency_{uuid.uuid4().hex}"
    buckets = max(8, spark.sparkContext.defaultParallelism)
    listed = few.groupBy("key").agg(F.collect_list("other").alias("others"))
    listed.write.bucketBy(buckets, "key").sortBy("key").option("path", fresh_folder(spark, "adjacency")).saveAsTable(name)
    return spark.table(name)


def bounded_searches(adjacent: DataFrame, starts: DataFrame, depth: int = 2, most: int = MOST_NODES) -> DataFrame:
    """query_id, node_key, depth: for each query (query_id, node_key: its starts) the nodes within `depth` steps, at most `most` by depth and key.

    All queries go on at once, a level at a time. The frontier meets the stored
    adjacency by key, and what a query has seen is anti-joined; both are
    checkpoints that stay on the executors. Within a level a query's new nodes
    are ranked by key: there are at most `most` times the hub limit of them. A
    query that has reached `most` has no frontier any more. adjacent: key,
    others, as `adjacency` writes it.
    """
    def ranked(rows: DataFrame, level: int) -> DataFrame:
        by_key = Window.partitionBy("query_id").orderBy("node_key")
        return rows.withColumn("nth", F.row_number().over(by_key)).where(F.col("nth") <= F.col("room")).select("query_id", "node_key", F.lit(level).cast("long").alias("depth"))

    front = checkpoint(ranked(starts.select("query_id", "node_key").distinct().withColumn("room", F.lit(most)), 0))
    seen = front
    for level in range(1, min(max(depth, 0), MOST_DEPTH) + 1):
        room = seen.groupBy("query_id").agg((F.lit(most) - F.count("*")).alias("room")).where("room > 0")
        near = front.join(adjacent, front["node_key"] == adjacent["key"]).select("query_id", F.explode("others").alias("node_key")).distinct()
        fresh = near.join(seen, ["query_id", "node_key"], "left_anti").join(room, "query_id")
        front = checkpoint(ranked(fresh, level))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionByName(front))
    return seen


def bounded_search(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int = MOST_NODES) -> DataFrame:
    """node_key, depth of one search from all starts (node_key)."""
    return bounded_searches(adjacency(edges), starts.select(F.lit(0).alias("query_id"), "node_key"), depth, most).select("node_key", "depth")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node_key)."""
    keys = nodes.select("node_key")
    some = edges.join(keys, edges["src_key"] == keys["node_key"], "left_semi")
    return some.join(keys, some["dst_key"] == keys["node_key"], "left_semi")


def hidden_documents(docs: DataFrame, referenced: DataFrame) -> DataFrame:
    """doc_id of referenced documents that are not public; unknown documents and levels count as not public."""
    known = referenced.select("doc_id").distinct().join(docs.select("doc_id", "access_level"), "doc_id", "left")
    return known.where(F.coalesce("access_level", F.lit("?")) != "public").select("doc_id")


def secured_view(nodes: DataFrame, edges: DataFrame, docs: DataFrame, partner: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to show: no superseded claims, no deleted edges, for partners nothing from documents that are not public.

    nodes: node_key, label, doc_id (of documents, chunks and claims, else NULL), superseded_by.
    """
    shown = nodes.where((F.col("label") != "Claim") | F.col("superseded_by").isNull())
    kept = edges.where(~F.coalesce("deleted", F.lit(False)))
    if partner:
        named = nodes.select("doc_id").union(edges.select("source_doc_id")).where("doc_id IS NOT NULL")
        hidden = hidden_documents(docs, named)
        shown = shown.join(hidden, "doc_id", "left_anti").select(*nodes.columns)
        kept = kept.join(hidden, kept["source_doc_id"] == hidden["doc_id"], "left_anti")
    return shown, induced(kept, shown)


def claim_statistics(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """claim_id, n_support, contradicted: supporting documents and whether any contradiction touches the claim."""
    live = edges.where(~F.coalesce("deleted", F.lit(False)))
    support = live.where("rel_type = 'SUPPORTED_BY'").groupBy(F.col("src_key").alias("claim_id")).agg(F.countDistinct("dst_key").alias("n_support"))
    against = live.where("rel_type = 'CONTRADICTS'").select(F.explode(F.array("src_key", "dst_key")).alias("claim_id")).groupBy("claim_id").agg(F.count("*").alias("n_contradictions"))
    out = claims.select("claim_id").join(support, "claim_id", "left").join(against, "claim_id", "left")
    return out.select("claim_id", F.coalesce("n_support", F.lit(0)).alias("n_support"), F.coalesce("n_contradictions", F.lit(0)).alias("n_contradictions"))


def claim_citations(claims: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """claim_id, cite_keys: the sorted distinct citations of the documents that support each claim, empty without any. documents: node_key, cite_key."""
    live = edges.where(~F.coalesce("deleted", F.lit(False)) & (F.col("rel_type") == "SUPPORTED_BY"))
    cited = live.join(documents.select(F.col("node_key").alias("dst_key"), "cite_key"), "dst_key").groupBy(F.col("src_key").alias("claim_id")).agg(F.array_sort(F.collect_set("cite_key")).alias("cite_keys"))
    return claims.select("claim_id").join(cited, "claim_id", "left").withColumn("cite_keys", F.coalesce("cite_keys", F.array().cast("array<string>")))


def chains(used: DataFrame, studied: DataFrame, equipment: DataFrame) -> DataFrame:
    """material, experiment, process, equipment (NULL without any): what links a material to a process.

    used: material, experiment; studied: experiment, process; equipment: experiment, process, equipment.
    """
    return used.join(studied, "experiment").join(equipment, ["experiment", "process"], "left").select("material", "experiment", "process", "equipment")


def evidence(facts: DataFrame, documents: DataFrame, review_only: bool = False) -> DataFrame:
    """fact_id, rel_type, quote, title, source_path: each live fact with the quote and the document that prove it; facts of unknown documents too."""
    live = facts.where(~F.coalesce("deleted", F.lit(False)))
    live = live.where("needs_review") if review_only else live
    return live.join(documents.select(F.col("doc_id").alias("source_doc_id"), "title", "source_path"), "source_doc_id", "left").select("fact_id", "rel_type", "quote", "title", "source_path")


def experts_of(expertise: DataFrame, most: int = 5) -> DataFrame:
    """process, n_experts, experts: how many know each process, and the first of them by name. expertise: process, expert."""
    once = expertise.select("process", "expert").distinct()
    nth = F.row_number().over(Window.partitionBy("process").orderBy("expert"))
    first = once.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("process").agg(F.array_sort(F.collect_list("expert")).alias("experts"))
    return once.groupBy("process").agg(F.count("*").alias("n_experts")).join(first, "process")


def cooccurrence(mentions: DataFrame, least: int = 1) -> DataFrame:
    """a, b, weight: pairs of entities (a < b) and the number of chunks with both. mentions: chunk_id, entity.

    A chunk's distinct entities are one array, so the pairs of a chunk arise without a join.
    """
    sets = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("es"))
    pairs = F.flatten(F.transform("es", lambda x, i: F.transform(F.slice("es", i + 2, F.greatest(F.size("es"), F.lit(1))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def abc_links(pairs: DataFrame, types: DataFrame, start: str | int, most_direct: int = 2, top: int = 5) -> DataFrame:
    """c, b, w_ab, w_bc, direct, score: what start A reaches through B without much direct evidence; the best B for each C.

    pairs: a, b, weight. types: entity, type.
    """
    edges = pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight"))
    ab = edges.where(F.col("a") == start).select(F.col("b").alias("via"), F.col("weight").alias("w_ab"))
    bc = edges.select(F.col("a").alias("via"), F.col("b").alias("c"), F.col("weight").alias("w_bc"))
    two = ab.join(bc, "via").where(F.col("c") != start)
    allowed = types.where(F.col("type").isin(*TARGET_TYPES)).select(F.col("entity").alias("c"))
    direct = ab.select(F.col("via").alias("c"), F.col("w_ab").alias("direct"))
    linked = two.join(allowed, "c", "left_semi").join(direct, "c", "left").withColumn("direct", F.coalesce("direct", F.lit(0)))
    score = (F.least("w_ab", "w_bc") + 0.1 * (F.col("w_ab") + F.col("w_bc"))) / (1 + F.col("direct"))
    best = Window.partitionBy("c").orderBy(F.desc("score"), "via")
    one = linked.where(F.col("direct") <= most_direct).withColumn("score", score).withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return one.select("c", F.col("via").alias("b"), "w_ab", "w_bc", "direct", "score").orderBy(F.desc("score"), "c").limit(top)


def document_counts(mentions: DataFrame) -> DataFrame:
    """entity, doc_count: the documents of each node of a co-occurrence graph. mentions: doc_id, entity."""
    return mentions.groupBy("entity").agg(F.countDistinct("doc_id").alias("doc_count"))


def node_key(label: Column, keys: dict[str, Column], element_id: Column) -> Column:
    """`Label:key` of a node: the key column of its label, else its element id."""
    own = F.coalesce(*[F.when(label == name, key) for name, key in keys.items()], element_id.cast("string"))
    return F.concat(label, F.lit(":"), own)


def bare_key(key: Column) -> Column:
    """A key without a `Label:` before it, if it has one."""
    return F.regexp_replace(key, r"\A[A-Z][A-Za-z]*:", "")


def display_name(*names: Column) -> Column:
    """The first of several names that is not empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def citations(rows: DataFrame, order: Column, key: str = "cite_key") -> DataFrame:
    """Distinct citations in the order of their first appearance."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first")).orderBy("first", key).select(key)


def near_experiments(nodes: DataFrame, edges: DataFrame, starts: DataFrame, most: int = 8) -> DataFrame:
    """experiment, name, conditions: the first experiments by key that a live edge links to a start, with what their live edges lead to.

    starts: node_key. conditions is an array of rel_type, target, value_min, value_max, unit_canon and value_text, empty without edges.
    """
    live = edges.where(~F.coalesce("deleted", F.lit(False)))
    linked = both_ways(live.select("src_key", "dst_key")).join(starts.select(F.col("node_key").alias("key")).distinct(), "key", "left_semi").select(F.col("other").alias("node_key"))
    own = nodes.where(F.col("label") == "Experiment").join(linked, "node_key", "left_semi").orderBy("node_key").limit(most).select(F.col("node_key").alias("experiment"), "name")
    targets = nodes.select(F.col("node_key").alias("dst_key"), F.col("name").alias("target"))
    values = live.join(own.select(F.col("experiment").alias("src_key")), "src_key", "left_semi").join(targets, "dst_key")
    held = values.groupBy(F.col("src_key").alias("experiment")).agg(F.array_sort(F.collect_list(F.struct("rel_type", "target", "value_min", "value_max", "unit_canon", "value_text"))).alias("conditions"))
    joined = own.join(held, "experiment", "left")
    return joined.select("experiment", F.coalesce("name", "experiment").alias("name"), F.when(F.col("conditions").isNull(), F.filter(F.array(F.lit(None).cast(held.schema["conditions"].dataType.elementType)), lambda x: x.isNotNull())).otherwise(F.col("conditions")).alias("conditions"))
