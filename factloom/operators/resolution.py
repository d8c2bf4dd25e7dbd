"""Entity resolution: an alias index, lookup in steps, stubs for what is unknown, and merging of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import normalize_name, person_key, slug, to_cyrillic, to_latin
from factloom.shipping import checkpoint


def alias_index(entities: DataFrame) -> DataFrame:
    """label, alias_key, entity_id: for every surface of every entity, the entity that registered it first.

    entities: entity_id, label, ord, surfaces (array of names and aliases). Single
    words of one script are registered in the other one too, after all others.
    """
    given = entities.select("label", "entity_id", "ord", F.posexplode("surfaces").alias("pos", "surface")).withColumn("alias_key", normalize_name("surface")).where("alias_key != ''")
    single = given.where(~F.contains("alias_key", F.lit(" ")))
    other = F.when(F.col("alias_key").rlike("[а-я]"), to_latin(F.col("alias_key"))).otherwise(to_cyrillic(F.col("alias_key")))
    cols = ("label", "entity_id", "ord", "pos", "alias_key")
    both = given.select(*cols, F.lit(0).alias("late")).union(single.withColumn("alias_key", other).select(*cols, F.lit(1)))
    first = F.min(F.struct("late", "ord", "pos", "entity_id"))
    return both.groupBy("label", "alias_key").agg(first["entity_id"].alias("entity_id"))


def lookup(mentions: DataFrame, index: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Adds entity_id by exact surface, then by lemma, then by the other script; NULL if none knows it. Reads only.

    mentions: mention_id, label, name. lemmas: word_key, lemma_key, for phrases that a dictionary can bring to a base form.
    """
    key = normalize_name("name")
    keyed = mentions.withColumn("factloom_0", key)
    if lemmas is not None:
        keyed = keyed.join(lemmas.select(F.col("word_key").alias("factloom_0"), F.col("lemma_key").alias("factloom_1")), "factloom_0", "left")
    else:
        keyed = keyed.withColumn("factloom_1", F.lit(None).cast("string"))
    other = F.when(F.col("factloom_0").rlike("[а-я]"), to_latin(F.col("factloom_0"))).otherwise(to_cyrillic(F.col("factloom_0")))
    tried = keyed.withColumn("factloom_key", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), c.alias("key")) for k, c in enumerate((F.col("factloom_0"), F.col("factloom_1"), F.when(~F.contains("factloom_0", F.lit(" ")), other)))])))
    steps = tried.select("mention_id", "label", F.col("factloom_key.step").alias("step"), F.col("factloom_key.key").alias("alias_key"))
    found = steps.join(index, ["label", "alias_key"]).groupBy("mention_id").agg(F.min_by("entity_id", "step").alias("entity_id"))
    return mentions.join(found, "mention_id", "left")


def resolve(mentions: DataFrame, index: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Like lookup; what is unknown gets a stub of its slug, marked as unresolved."""
    found = lookup(mentions, index, lemmas)
    return found.withColumn("unresolved", F.col("entity_id").isNull()).withColumn("entity_id", F.coalesce("entity_id", slug("name")))


def stubs(resolved: DataFrame) -> DataFrame:
    """entity_id, label, aliases of the stubs: the set of names that led to each."""
    return resolved.where("unresolved").groupBy("entity_id", "label").agg(F.array_sort(F.collect_set("name")).alias("aliases"))


def first_in_document(entities: DataFrame) -> DataFrame:
    """Of a document's entities with one type and normalised name the first; names of fewer than two letters or digits go."""
    named = entities.where(F.length(F.regexp_replace("name", r"[^\p{L}\p{N}]", "")) >= 2).withColumn("name_key", normalize_name("name"))
    order = Window.partitionBy("doc_id", "type", "name_key").orderBy("ord")
    return named.withColumn("factloom_nth", F.row_number().over(order)).where("factloom_nth = 1").drop("factloom_nth")


def duplicate_stubs(unresolved: DataFrame) -> DataFrame:
    """label, slug, first_id, other_id: unresolved entities that share a slug with the first one. unresolved: entity_id, label, name."""
    keyed = unresolved.withColumn("slug", slug("name"))
    first = keyed.groupBy("label", "slug").agg(F.min("entity_id").alias("first_id"))
    return keyed.join(first, ["label", "slug"]).where("entity_id != first_id").select("label", "slug", "first_id", F.col("entity_id").alias("other_id"))


def dedupe_people(people: DataFrame) -> DataFrame:
    """survivor_id, victim_id: people of one key; the survivor has the highest degree, then the longest name, then the least id. people: expert_id, name, degree."""
    keyed = people.withColumn("key", person_key("name")).where("key IS NOT NULL")
    ranked = keyed.groupBy("key", "degree", F.length("name").alias("n")).agg(F.min("expert_id").alias("expert_id"), F.count("*").alias("n_people"))
    survivors = ranked.groupBy("key").agg(F.max_by("expert_id", F.struct("degree", "n")).alias("survivor_id"), F.sum("n_people").alias("n_people")).where("n_people >= 2")
    return keyed.join(survivors, "key").where("expert_id != survivor_id").select("survivor_id", F.col("expert_id").alias("victim_id"))


def survivors(groups: DataFrame) -> DataFrame:
    """group_id, survivor_id of approved synonym groups: a reference entity, else the one of the highest degree.

    Groups with two reference entities, or with fewer than two members, are left alone. groups: group_id, entity_id, is_reference, degree.
    """
    ranked = F.max(F.struct("is_reference", "degree", "entity_id"))["entity_id"]
    counted = groups.groupBy("group_id").agg(F.count_if("is_reference").alias("n_ref"), F.count("*").alias("n"), ranked.alias("survivor_id"))
    return counted.where("n >= 2 AND n_ref < 2").select("group_id", "survivor_id")


def resolve_merges(merges: DataFrame) -> DataFrame:
    """victim_id, survivor_id of merges where a survivor may be merged away itself: the last one of each chain.

    Of several survivors of one victim the least counts. Each round replaces a survivor by its own, so the length of chains
    that are followed doubles. Nodes whose merges form a circle, or lead into one, stay as they are.
    """
    step = checkpoint(merges.where("victim_id != survivor_id").groupBy("victim_id").agg(F.min("survivor_id").alias("survivor_id")))
    rounds = step.count().bit_length() + 1
    for _ in range(rounds):
        ahead = step.select(F.col("victim_id").alias("survivor_id"), F.col("survivor_id").alias("next_id"))
        moved = step.join(ahead, "survivor_id", "left")
        if moved.where("next_id IS NOT NULL").isEmpty():
            return step
        step = checkpoint(moved.select("victim_id", F.coalesce("next_id", "survivor_id").alias("survivor_id")))
    return step.join(step.select(F.col("victim_id").alias("survivor_id")), "survivor_id", "left_anti").select("victim_id", "survivor_id")


def remap_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges with every victim's key replaced by its last survivor's; edges that become equal, or loops, go. merges: victim_id, survivor_id, chains of them too."""
    merges = resolve_merges(merges)
    a = merges.select(F.col("victim_id").alias("src_key"), F.col("survivor_id").alias("factloom_src"))
    b = merges.select(F.col("victim_id").alias("dst_key"), F.col("survivor_id").alias("factloom_dst"))
    moved = edges.join(a, "src_key", "left").join(b, "dst_key", "left")
    new = {"src_key": F.coalesce("factloom_src", "src_key"), "dst_key": F.coalesce("factloom_dst", "dst_key")}
    changed = F.col("factloom_src").isNotNull() | F.col("factloom_dst").isNotNull()
    loop = changed & (F.coalesce("factloom_src", "src_key") == F.coalesce("factloom_dst", "dst_key"))
    return moved.where(~loop).select(*[new.get(c, F.col(c)).alias(c) for c in edges.columns]).distinct()


def union_aliases(*lists: Column) -> Column:
    """Aliases of several lists once by their normalised key, in order."""
    every = F.filter(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), lambda x: F.trim(x) != "")
    keys = F.transform(every, normalize_name)
    return F.filter(every, lambda x, i: F.array_position(keys, normalize_name(x)) == i + 1)


def glossary_merge(entities: DataFrame, glossary: DataFrame) -> DataFrame:
    """Entities after merging a glossary: each term goes to the entity of its label and id, else to the one that has any of its surfaces, else it is new.

    entities: entity_id, label, ord, name, aliases; glossary: term_id, label, name, aliases. A merge fills a missing name and unites aliases.
    """
    surfaces = entities.select("entity_id", "label", "ord", F.concat(F.array(F.coalesce("name", F.lit(""))), "aliases").alias("surfaces"))
    by_id = glossary.join(entities.select("label", F.col("entity_id").alias("term_id"), F.col("entity_id").alias("own")), ["label", "term_id"], "left")
    keys = glossary.select("term_id", "label", F.posexplode(F.concat(F.array(F.coalesce("name", F.lit(""))), "aliases")).alias("pos", "surface")).withColumn("alias_key", normalize_name("surface"))
    hit = keys.join(alias_index(surfaces), ["label", "alias_key"]).groupBy("label", "term_id").agg(F.min_by("entity_id", "pos").alias("other"))
    placed = by_id.join(hit, ["label", "term_id"], "left").select("label", F.coalesce("own", "other", "term_id").alias("entity_id"), "name", "aliases", "term_id")
    nothing = F.array().cast("array<string>")
    united = F.array_sort(F.collect_list(F.struct("term_id", F.concat(F.array_compact(F.array("name")), F.coalesce("aliases", nothing)).alias("names"))))
    terms = placed.groupBy("label", "entity_id").agg(F.min_by("name", "term_id").alias("term_name"), F.flatten(F.transform(united, lambda x: x["names"])).alias("term_names"))
    joined = entities.drop("ord").join(terms, ["label", "entity_id"], "full")
    return joined.select("entity_id", "label", F.coalesce("name", "term_name").alias("name"), union_aliases(F.col("aliases"), F.col("term_names")).alias("aliases"))


def text_fallback(mentions: DataFrame, entities: DataFrame, candidates: int = 5) -> DataFrame:
    """mention_id, entity_id: among the `candidates` live entities of the label that share most words with a name, one with exactly that name.

    Curated entities come before unresolved ones, then the higher score. mentions: mention_id, label, name; entities: entity_id, label, surfaces, unresolved, deleted.
    """
    # By shared words over the root of a surface's number of words, no surface beats one of the very same words, and only
    # others of the same words equal it: so it is enough to meet those, and no common word is a key.
    words = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""))), " ")
    named = entities.where("NOT deleted").select("entity_id", "label", "unresolved", F.explode("surfaces").alias("surface")).withColumn("surface_key", normalize_name("surface"))
    held = named.withColumn("words", words(F.col("surface_key"))).where("words != ''").select("label", "words", "surface_key", "unresolved", "entity_id")
    # Who comes how far among the entities of the same words is one order for all names of these words, so it is found
    # once; each name then has one entity, and no mention meets more than that one.
    order = F.dense_rank().over(Window.partitionBy("label", "words").orderBy("unresolved", "entity_id"))
    near = held.withColumn("nth", order).where(F.col("nth") <= candidates)
    best = near.groupBy("label", "surface_key").agg(F.min(F.struct("unresolved", "entity_id")).alias("best"))
    asked = mentions.select("mention_id", "label", normalize_name("name").alias("surface_key"))
    return asked.join(best, ["label", "surface_key"]).groupBy("mention_id").agg(F.min("best")["entity_id"].alias("entity_id"))


def synonym_merges(unresolved: DataFrame, index: DataFrame) -> DataFrame:
    """victim_id, survivor_id: unresolved entities that the index knows by one of their surfaces, the first that it knows. unresolved: entity_id, label, surfaces."""
    surfaces = unresolved.select("entity_id", "label", F.posexplode("surfaces").alias("pos", "name"))
    asked = surfaces.select(F.struct("entity_id", "pos").alias("mention_id"), "label", "name")
    found = lookup(asked, index).where("entity_id IS NOT NULL AND entity_id != mention_id.entity_id")
    return found.groupBy(F.col("mention_id.entity_id").alias("victim_id")).agg(F.min_by("entity_id", "mention_id.pos").alias("survivor_id"))


def target_by_id_or_name(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """target, node_key: the node of a wanted id, else the one of the highest degree whose name contains the wanted words. wanted: target, id, words, a few rows; nodes: node_key, name, degree."""
    few = F.broadcast(wanted)  # a stated list
    hit = nodes.join(few, (F.col("node_key") == F.col("id")) | F.contains(F.lower("name"), F.lower("words")))
    return hit.groupBy("target").agg(F.max(F.struct(F.col("node_key") == F.col("id"), "degree", "node_key"))["node_key"].alias("node_key"))


def known_before(chunks: DataFrame, group: int = 4) -> DataFrame:
    """doc_id, idx, known: the entities that a document's earlier groups of chunks named, in order of appearance. chunks: doc_id, idx, entities."""
    named = chunks.select("doc_id", F.col("idx"), F.floor(F.col("idx") / group).alias("part"), F.posexplode("entities").alias("pos", "entity"))
    first = named.groupBy("doc_id", "entity").agg(F.min(F.struct("part", "idx", "pos")).alias("at"))
    per_part = first.groupBy("doc_id", F.col("at.part").alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "entity"))).alias("new"))
    before = Window.partitionBy("doc_id").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    parts = chunks.select("doc_id", F.floor(F.col("idx") / group).alias("part")).distinct().join(per_part, ["doc_id", "part"], "left")
    known = parts.withColumn("known", F.transform(F.flatten(F.collect_list("new").over(before)), lambda x: x["entity"])).select("doc_id", "part", "known")
    return chunks.select("doc_id", "idx", F.floor(F.col("idx") / group).alias("part")).join(known, ["doc_id", "part"]).select("doc_id", "idx", "known")


def named_with(entities: DataFrame, part: str) -> DataFrame:
    """Entities that have part in one of their names or aliases, letters in either case. entities: name_ru, name_en, aliases."""
    within = lambda name: F.coalesce(F.contains(F.lower(name), F.lower(F.lit(part))), F.lit(False))
    return entities.where(within(F.col("name_ru")) | within(F.col("name_en")) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), within))
