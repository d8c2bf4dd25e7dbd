"""Access of roles to files by path patterns and tags, sessions, and caches with an end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles by rank; a partner stands outside.
RANKS = {"partner": -1, "researcher": 0, "analyst": 1, "lead": 2, "admin": 3}
#: How long a filter's set of documents can be asked for by its handle.
FILTER_SECONDS = 900


def at_least(role: Column, least: str) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return F.coalesce(F.try_element_at(rank, role) >= RANKS[least], F.lit(False))


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression: ** passes slashes, * and ? do not."""
    quoted = F.regexp_replace(glob, r"([.+^$()|\[\]{}\\])", r"\\$1")
    stars = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    single = F.replace(F.replace(stars, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit(r"\A"), F.replace(F.replace(single, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*")), F.lit(r"\z"))


def matches(path: Column, globs: Column) -> Column:
    return F.exists(globs, lambda g: F.regexp_like(path, glob_pattern(g)))


def allowed(files: DataFrame, rules: DataFrame) -> DataFrame:
    """role, path, allowed for every pair of file and rule. Both a rule on paths and a rule on tags must allow a file.

    rules: role, kind (whitelist or blacklist), paths, exclude_paths, tags, everything; one row for each of a few roles.
    An excluded path is what the rule is not: not on a whitelist, not forbidden by a blacklist.
    """
    pairs = files.crossJoin(rules)
    white = F.col("kind") == "whitelist"
    by_path = F.when(F.size("paths") == 0, True).when(matches(F.col("path"), F.col("exclude_paths")), ~white).otherwise(matches(F.col("path"), F.col("paths")) == white)
    by_tag = F.when(F.size("tags") == 0, True).otherwise(F.coalesce(F.arrays_overlap("tags", "file_tags"), F.lit(False)) == white)
    return pairs.select("role", "path", (F.col("everything") | (by_path & by_tag)).alias("allowed"))


def may(permissions: Column, wanted: str) -> Column:
    return F.array_contains(permissions, "*") | F.array_contains(permissions, wanted)


def sessions(messages: DataFrame) -> DataFrame:
    """session_id, title, n_messages, updated_at, the latest first. messages: session_id, seq, text, at."""
    return messages.groupBy("session_id").agg(F.min_by(F.substring("text", 1, 60), "seq").alias("title"), F.count("*").alias("n_messages"), F.max("at").alias("updated_at")).orderBy(F.desc("updated_at"), "session_id")


def live_entries(entries: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Cache entries that have not ended: of each key the last put, if it is younger than `seconds`. entries: key, value, put_at, seq."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("value", "put_at"), F.struct("put_at", "seq")).alias("e")).select("key", "e.*")
    return last.where(F.timestamp_add("SECOND", F.lit(seconds), F.col("put_at")) > now)


def within_filters(hits: DataFrame, sets: DataFrame, now: Column, seconds: int = FILTER_SECONDS) -> DataFrame:
    """Hits (filter_id, doc_id) that are in the set of documents of their filter. sets: filter_id, doc_id, put_at; an empty set is a row with a null doc_id.

    Hits without a filter, or with one that is unknown or has ended, are not narrowed.
    """
    live = sets.where(F.timestamp_add("SECOND", F.lit(seconds), F.col("put_at")) > now).select("filter_id", "doc_id")
    known = live.select("filter_id").distinct()
    return hits.join(live, ["filter_id", "doc_id"], "left_semi").unionByName(hits.join(known, "filter_id", "left_anti"))


def coalesced_writes(writes: DataFrame, seconds: int) -> DataFrame:
    """path, started_at, ended_at, n_writes, value: writes with gaps under `seconds` become one, of the last value. writes: path, at, value, seq."""
    bursts = writes.groupBy("path", F.session_window("at", f"{seconds} seconds").alias("burst"))
    return bursts.agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("*").alias("n_writes"), F.max_by("value", F.struct("at", "seq")).alias("value")).drop("burst")


def reassemble(chunks: DataFrame) -> DataFrame:
    """doc_id, text: a document's chunks in order, with blank lines between them. chunks: doc_id, idx, text."""
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("c"))
    return held.select("doc_id", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("text"))
