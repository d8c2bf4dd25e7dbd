"""Names of a dictionary table in texts: an automaton over words and separators, or joins where the dictionary is too large to send.

A text is a row of pieces: runs of letters, digits and underscores, and single
other characters. A name is found where its pieces stand in a row, so it begins
and ends at the ends of words. Names of up to three characters or with digits
must match in case, others need not. Of names that overlap the longer one is
taken, of equally long ones the first in order, then the earlier place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import WORD
from factloom.shipping import checkpoint, ship

#: Names up to which the automaton is built on the driver and sent to every task.
MOST_SENT = 200_000
#: Rows after which a task hands over what it found.
ROWS_AT_ONCE = 10_000
#: Pieces of a text that are one row before its places are.
BLOCK = 64
#: Characters after a parameter within which its value is looked for.
REACH = 18

_PIECES = re.compile(r"\w+|\W")
_PIECE = WORD + r"|[^\p{L}\p{N}_]"
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")
FOUND = "entity_id string, name string, surface string, start_at long, end_at long, value double"


def is_exact(name: str) -> bool:
    """Whether a name must match in case."""
    return len(name) <= 3 or any(c.isdigit() for c in name)


def pieces_of(text: str) -> list[tuple[int, str]]:
    """Places and pieces of a text."""
    return [(m.start(), m[0]) for m in _PIECES.finditer(text)]


@dataclass
class Automaton:
    """A trie of names' pieces, each state with the longest other state that ends its path, so that no piece is read twice."""

    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    fallback: list[int] = field(default_factory=lambda: [0])
    #: The next state on the chain of fallbacks at which a name ends, 0 without any.
    shorter: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    ends: dict[int, list[tuple[str, str, str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, names: list[tuple[str, str, str]]) -> Automaton:
        """names: entity_id, type, name."""
        made = cls()
        for entry in sorted(names, key=lambda x: (x[2], x[0])):
            state = 0
            for _, piece in pieces_of(entry[2].lower()):
                if piece not in made.nodes[state]:
                    made.nodes[state][piece] = len(made.nodes)
                    made.nodes.append({})
                    made.fallback.append(0)
                    made.shorter.append(0)
                    made.depth.append(made.depth[state] + 1)
                state = made.nodes[state][piece]
            if state:
                made.ends.setdefault(state, []).append(entry)
        # A parent's state is done before its children's, level by level.
        level = list(made.nodes[0].values())
        while level:
            below = []
            for state in level:
                rest = made.fallback[state]
                made.shorter[state] = rest if rest in made.ends else made.shorter[rest]
                for piece, child in made.nodes[state].items():
                    back = rest
                    while back and piece not in made.nodes[back]:
                        back = made.fallback[back]
                    made.fallback[child] = made.nodes[back].get(piece, 0)
                    below.append(child)
            level = below
        return made

    def scan(self, text: str) -> Iterator[tuple[tuple[str, str, str], int, int]]:
        """Every name (entity_id, type, name) that stands in the text, with the places of its start and end, overlapping ones too."""
        held = _PIECES.findall(text)
        low = [x.lower() for x in held]
        begins = self.nodes[0]
        firsts = [k for k, piece in enumerate(low) if piece in begins]
        if not firsts:
            return
        starts = [0, *accumulate(map(len, held))]
        read = 0
        # Between names no state is kept, so only what a first piece begins is walked.
        for first in firsts:
            state, k = 0, max(first, read)
            while k < len(held) and (state or k == first):
                while state and low[k] not in self.nodes[state]:
                    state = self.fallback[state]
                state = self.nodes[state].get(low[k], 0)
                at = state if state in self.ends else self.shorter[state]
                while at:
                    start, end = starts[k - self.depth[at] + 1], starts[k + 1]
                    for entry in self.ends[at]:
                        if fits(entry[2], text, start, end):
                            yield entry, start, end
                    at = self.shorter[at]
                k += 1
            read = max(read, k)


def fits(name: str, text: str, start: int, end: int) -> bool:
    """Whether a name that stands there in some case is one in the right case and no part of a longer word."""
    if is_exact(name) and text[start:end] != name:
        return False
    return not (start and _word(text[start - 1])) and not (end < len(text) and _word(text[end]))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def without_overlaps(text: str, found: list[tuple[tuple[str, str, str], int, int]]) -> list[tuple]:
    """entity_id, name, surface, start_at, end_at and, of a parameter, the first number within REACH after it: the longest first."""
    taken = bytearray(len(text))
    kept = []
    for (entity, kind, name), start, end in sorted(found, key=lambda x: (-len(x[0][2]), x[0][2], x[0][0], x[1])):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            value = _NUMBER.search(text, end, end + REACH) if kind == "parameter" else None
            kept.append((entity, name, text[start:end], start, end, float(value[0].replace(",", ".")) if value else None))
    return sorted(kept, key=lambda x: x[3])


def found_in(batches: Iterator[pd.DataFrame], automaton: Automaton, id_col: str) -> Iterator[pd.DataFrame]:
    """id_col and FOUND of texts, handed over by ROWS_AT_ONCE rows and what the last text has more, as a batch of texts may hold very many names."""
    columns = [id_col, *(x.split()[0] for x in FOUND.split(", "))]
    for pdf in batches:
        out = []
        for key, text in zip(pdf[id_col], pdf["text"], strict=True):
            out += [(key, *x) for x in without_overlaps(text, [*automaton.scan(text)])]
            if len(out) >= ROWS_AT_ONCE:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)


def find_names(texts: DataFrame, names: DataFrame, id_col: str = "chunk_id", text_col: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """id_col, entity_id, name, surface, start_at, end_at, value of the names (entity_id, type, name) in texts, without overlaps.

    A dictionary of at most most_sent names is sent to every task as an automaton, and each text is read once. A larger one
    is joined, see occurrences. A null or empty text holds nothing; null and empty names are left out.
    """
    ship(texts.sparkSession)
    names = names.where("name != ''").select("entity_id", F.coalesce("type", F.lit("")).alias("type"), "name").distinct()
    rows = texts.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    if names.limit(most_sent + 1).count() <= most_sent:
        sent = texts.sparkSession.sparkContext.broadcast(Automaton.of([tuple(r) for r in names.collect()]))

        return rows.mapInPandas(lambda batches: found_in(batches, sent.value, id_col), f"{id_col} {kind}, {FOUND}")

    columns = [id_col, "times", *(x.split()[0] for x in FOUND.split(", "))]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [((e, k, n), s, t) for e, k, n, s, t in zip(pdf["entity_id"], pdf["type"], pdf["name"], pdf["start_at"], pdf["end_at"], strict=True)]
        return pd.DataFrame([(pdf[id_col].iloc[0], pdf["times"].iloc[0], *x) for x in without_overlaps(pdf["text"].iloc[0], found)], columns=columns)

    # Rows that share an id are told apart by their texts, equal rows are read once.
    once = checkpoint(rows.groupBy(id_col, F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count("*").alias("times")))
    held = occurrences(once, names, [id_col, "sha"]).withColumnsRenamed({id_col: "of_id", "sha": "of_sha"})
    joined = once.join(held, once[id_col].eqNullSafe(held["of_id"]) & (once["sha"] == held["of_sha"])).drop("of_id", "of_sha")
    chosen = joined.groupBy(id_col, "sha").applyInPandas(choose, f"{id_col} {kind}, times long, {FOUND}")
    return chosen.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def occurrences(texts: DataFrame, names: DataFrame, ids: list[str]) -> DataFrame:
    """ids, entity_id, type, name, start_at, end_at: all places of all names, overlapping ones too, by joins alone. texts: ids (unique), text.

    Each place at which some name's first piece stands is joined with the names of each length (in pieces) that such a name
    has, by the whole run of pieces: a first piece that many names share makes no product of its places and names. A text
    is cut into blocks of pieces within its own row, each with those that its last names may reach, so nothing is sorted by
    place, and of at most MOST_SENT names nothing but the texts is shuffled.
    """
    low = F.regexp_extract_all(F.lower("name"), F.lit(_PIECE), F.lit(0))
    listed = checkpoint(names.select("entity_id", "type", "name", F.array_join(low, "\x00").alias("run"), F.size(low).alias("n"), low[0].alias("first")))
    exact = (F.length("name") <= 3) | F.col("name").rlike(r"\p{Nd}")
    most = listed.agg(F.max("n").alias("n"), F.count("*").alias("names")).first()
    longest = most.n or 1
    sent = F.broadcast if most.names <= MOST_SENT else lambda df: df
    lengths = sent(listed.groupBy("first").agg(F.collect_set("n").alias("lengths")))
    size = max(BLOCK, longest)
    # Few files may hold all texts.
    cut = texts.repartition(*ids).select(*ids, F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0)).alias("pieces"))
    nth = F.sequence(F.lit(0), F.greatest(F.floor((F.size("pieces") - 1) / size), F.lit(0)).cast("int"))
    # A block begins with the piece before it, and has after it as many as the longest name and one more.
    blocks = F.transform(nth, lambda b: F.slice(F.concat(F.array(F.lit("")), F.slice("pieces", F.greatest(b * size, F.lit(1)), size + longest + 1)), F.when(b > 0, 2).otherwise(1), size + longest + 1))
    chars = F.transform(nth, lambda b: F.length(F.array_join(F.slice("pieces", b * size + 1, size), "")).cast("long"))
    begins = F.aggregate(chars, F.array(F.lit(0).cast("long")), lambda held, n: F.concat(held, F.array(F.element_at(held, -1) + n)))
    # There is one more beginning than blocks, and a text without pieces has a block without any.
    blocked = cut.select(*ids, F.inline(F.zip_with(blocks, begins, lambda block, at: F.struct(block.alias("block"), at.alias("at"))))).where(F.size("block") > 1)
    placed = blocked.select(*ids, "at", "block", F.explode(F.sequence(F.lit(2), F.least(F.lit(size), F.size("block") - 1) + 1)).alias("k")).select(
        *ids, F.element_at("block", F.col("k")).alias("piece"), F.element_at("block", F.col("k") - 1).alias("before"), F.slice("block", F.col("k"), longest + 1).alias("ahead"),
        (F.col("at") + F.length(F.array_join(F.slice("block", F.lit(2), F.col("k") - 2), ""))).alias("start_at"),
    )
    started = placed.join(lengths, F.lower("piece") == F.col("first")).withColumn("n", F.explode("lengths")).where(F.col("n") <= F.size("ahead"))
    held = F.slice("ahead", F.lit(1), F.col("n"))
    run = started.select(*ids, "start_at", F.array_join(held, "").alias("surface"), F.lower(F.array_join(held, "\x00")).alias("run"), "before", F.try_element_at("ahead", F.col("n") + 1).alias("after"))
    word = f"({WORD})"
    own_first, own_last = F.substring("surface", 1, 1).rlike(word), F.substring("surface", -1, 1).rlike(word)
    free = (own_first | ~F.coalesce(F.col("before").rlike(word), F.lit(False))) & (own_last | ~F.coalesce(F.col("after").rlike(word), F.lit(False)))
    met = run.join(sent(listed.drop("n", "first")), "run").where(free & (~exact | (F.col("surface") == F.col("name"))))
    return met.select(*ids, "entity_id", "type", "name", "start_at", (F.col("start_at") + F.length("surface")).alias("end_at"))
