"""Operator 11: repair of the structure of conversations by a retained-subsequence DP.

A conversation's rows stand by turn, nulls first, then by role and text. The
repair keeps or reroles a subsequence of them, so that the initials of the roles
that stay read `(s?(ua)+)?`. Between two retained rows all others are deleted,
which costs the difference of two prefix sums of deletion costs; the pair of
their roles says how many turns must be inserted between them. So, going from
the last row to the first, the cheapest way on from a row follows from one
running minimum for each role: that of prefix sum, retaining cost and way on of
the retained rows behind it. Of the cheapest repairs the one whose audit (the
edits' initials in order) is ASCII-least is taken: walking forward, the least
letter is chosen with which the remaining cost can still be met. A state (the
last role, or none) and a letter leave one next state, so the walk needs no
search.

Conversations of any length are repaired in parallel. All rows are sorted into
ranges of bounded size; a conversation within one range is done there. One that
crosses ranges is put together from its pieces: a piece has a 4 x 4 matrix of
the cheapest ways from each state to each, the matrices are multiplied from the
end (sums and minima), then each piece tells the state it leaves for each state
it may start in, and these are followed from the start. There are two pieces in
each range at most, so what is broadcast has two narrow rows for each partition.
Only the SHA-256 of such a conversation's repaired text has to be computed in
order; one task reads it, piece by piece.

Defined results: a null role or text counts as one space; a null conversation is
one as well; rows without a turn stand before all others and leave no gap; rows
of one turn stand by role and text; equal rows are one after another, all but
the first duplicates; a row whose role has no or another initial than s, u and a
can be reroled or deleted; conversations without rows have zeros and empty
strings; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from factloom.llm.common import checkpoint
from factloom.shipping import ship

#: Text of one range of rows, on average; a task holds that of one conversation within it.
RANGE_BYTES = 64 << 20
#: Repaired text of a conversation across ranges goes on in pieces of at least so many bytes.
PIECE_BYTES = 1 << 14

_SPACES = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60
#: States: the role of the last turn that stays, or none.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATE_OF = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_ROLE_OF = {_USER: "user", _ASSISTANT: "assistant"}
#: The role that comes next after each state, besides a system turn at the start.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_LEGAL = {"su", "ua", "au"}
_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)


@dataclass(frozen=True)
class Costs:
    """What an edit costs; a truncated row that stays adds `truncated`. Insertions must cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def between(self, state: int, role: int) -> int:
        """The turns inserted between a state and a retained turn of that role: none or one, as roles alternate."""
        if role == _SYSTEM:
            return 0 if state == _NONE else _NEVER
        return 0 if _NEXT[state] == role else self.insert

    def end(self) -> list[int]:
        """The turns inserted at the end, by state."""
        return [0, 2 * self.insert, self.insert, 0]


@dataclass
class _Unit:
    """Equal rows of a turn: the first may stay."""

    initial: str
    fault: int
    n: int
    turn: int | None
    role: str = ""
    text: str = ""

    def forced(self) -> bool:
        return self.fault in (_BLANK, _DUPLICATE)


def ways_on(units: list[_Unit], end: list[int], costs: Costs) -> list[list[int]]:
    """For each place and state the least cost from there on, with `end` that after the last unit."""
    deleted = costs.delete * sum(u.n for u in units)
    # Running minima of prefix sum + retaining cost + way on, by the role under which a unit stays.
    best = [_NEVER] * 4
    last = [min(_NEVER, deleted + x) for x in end]
    between = [[costs.between(q, r) for r in range(4)] for q in range(4)]
    way, prefix = list(end), deleted
    out = [way]
    for u in reversed(units):
        prefix -= costs.delete * u.n
        if not u.forced():
            stays = prefix + costs.delete * (u.n - 1) + (costs.truncated if u.fault == _TRUNCATED else 0)
            own = _STATE_OF.get(u.initial)
            for role in (_USER, _ASSISTANT):
                best[role] = min(best[role], stays + (0 if own == role else costs.rerole) + way[role])
            if own == _SYSTEM:
                best[_SYSTEM] = min(best[_SYSTEM], stays + way[_SYSTEM])
        way = [min(_NEVER, min(last[q], *(best[r] + between[q][r] for r in (_SYSTEM, _USER, _ASSISTANT))) - prefix) for q in range(4)]
        out.append(way)
    return out[::-1]


def walk(units: list[_Unit], ways: list[list[int]], state: int, costs: Costs, ends: bool = True) -> Iterator[tuple[str, int, str]]:
    """The edits of least audit: letter, number of the unit (-1 of an inserted turn) and role, by rows. The last item is the state left, as its number."""
    for k, u in enumerate(units):
        here, after = ways[k], ways[k + 1]
        own = _STATE_OF.get(u.initial)
        kept = own if own == _NEXT[state] or (own == _SYSTEM and state == _NONE) else None
        if costs.delete * u.n + after[state] == here[state]:
            yield from (("D", k, u.role) for _ in range(u.n))
            continue
        stays = costs.delete * (u.n - 1) + (costs.truncated if u.fault == _TRUNCATED else 0)
        while not u.forced() and costs.insert + here[_NEXT[state]] == here[state]:
            state = _NEXT[state]
            yield "I", -1, _ROLE_OF[state]
            kept = own if own == _NEXT[state] else None
        if kept is not None and stays + after[kept] == here[state]:
            state = kept
            yield "K", k, u.role
        else:
            state = _NEXT[state]
            yield "R", k, _ROLE_OF[state]
        yield from (("D", k, u.role) for _ in range(u.n - 1))
    while ends and ways[-1][state]:
        state = _NEXT[state]
        yield "I", -1, _ROLE_OF[state]
    yield "", state, ""


def _gaps(turns: list[int], distinct: int) -> int:
    return turns[-1] - turns[0] + 1 - distinct if turns else 0


def _counts(units: list[_Unit]) -> dict:
    """What the rows themselves show."""
    turns = [u.turn for u in units if u.turn is not None]
    pairs = zip(units, units[1:], strict=False)
    return {
        "blank": sum(u.n for u in units if u.fault == _BLANK),
        "duplicate": sum(u.n if u.fault == _DUPLICATE else u.n - 1 for u in units if u.fault != _BLANK),
        "truncated": sum(u.fault == _TRUNCATED for u in units),
        "illegal": sum(a.initial + b.initial not in _LEGAL for a, b in pairs) + sum(u.n - 1 for u in units),
        "distinct": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first_role": units[0].initial, "last_role": units[-1].initial,
    }


def _named(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _unnamed(kind: DataType) -> Column:
    return F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id")


def sorted_units(turns: DataFrame, n: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text; n: how often each row stands there) as a checkpoint of units, in order within and over its partitions.

    conv, part (the partition), has_turn, turn, role, text, initial, fault and n.
    """
    times = F.lit(1).cast("long") if n is None else F.col(n).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(
        _named(F.col("conv_id")).alias("conv"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("sha"), times.alias("n"),
    )
    key = ["conv", "has_turn", "turn", "role", "sha"]
    units = rows.groupBy(*key).agg(F.first("text").alias("text"), F.sum("n").alias("n"))
    # The first unit of each role and text; joined by all of a unit's own key, so that a text repeated in every turn is no hot key.
    firsts = rows.groupBy("conv", "role", "sha").agg(F.min(F.struct("has_turn", "turn")).alias("at")).select("conv", "at.has_turn", "at.turn", "role", "sha", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    fault = F.when(bare == "", _BLANK).when(F.col("first").isNull(), _DUPLICATE).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), _FINE).otherwise(_TRUNCATED)
    marked = units.join(firsts, key, "left").select("conv", "has_turn", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "n")
    # A first look at the sizes, of one column, so that a range's text fits into a task.
    size = turns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = turns.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, size // RANGE_BYTES + 1)
    order = ["conv", "has_turn", "turn", "role"]
    return checkpoint(marked.repartitionByRange(ranges, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id()))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[_Unit]]]:
    """The first row of each conversation of a partition and its units."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    for _, group in groupby(rows(), key=lambda r: r["conv"]):
        first = next(group)
        units = [_Unit(r["initial"], r["fault"], r["n"], r["turn"] if r["has_turn"] else None, r.get("role", ""), r.get("text", "")) for r in (first, *group)]
        yield first, units


_NARROW = ["conv", "part", "initial", "fault", "n", "has_turn", "turn"]
_PIECE = "conv string, part int, matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, first_turn bigint, last_turn bigint, first_role string, last_role string"
_JOINED = "conv string, part int, ends array<bigint>, final boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _crossing(units: DataFrame, costs: Costs) -> tuple[DataFrame, DataFrame]:
    """The pieces of conversations that cross partitions: conv, part, ends, final, start; and the counts and costs of these conversations.

    Both are checkpoints of two rows for each partition at most.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for found in _conversations(batches):
            first, last = first or found, found
        for row, rows in [first] * (first is not None) + [last] * (last is not first):
            matrix = []
            for q in range(4):
                matrix.append(ways_on(rows, [0 if k == q else _NEVER for k in range(4)], costs)[0])
            # ways_on gives, for one end, the way from each state: the matrix's columns.
            yield _batch([{"conv": row["conv"], "part": row["part"], "matrix": [matrix[b][a] for a in range(4) for b in range(4)], **_counts(rows)}], _arrow(_PIECE))

    def joined(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        if len(rows) < 2:
            return _arrow(_JOINED).empty_table()
        end = costs.end()
        out = []
        for k, r in enumerate(reversed(rows)):
            out.append({"conv": r["conv"], "part": r["part"], "ends": end, "final": k == 0})
            end = [min(_NEVER, *(r["matrix"][4 * a + b] + end[b] for b in range(4))) for a in range(4)]
        pairs = list(zip(rows, rows[1:], strict=False))
        turns = [t for r in rows for t in (r["first_turn"], r["last_turn"]) if t is not None]
        same = sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
        out[0] |= {x: sum(r[x] for r in rows) for x in ("blank", "duplicate", "truncated", "illegal")}
        out[0]["illegal"] += sum(a["last_role"] + b["first_role"] not in _LEGAL for a, b in pairs)
        out[0] |= {"gaps": _gaps(turns, sum(r["distinct"] for r in rows) - same), "cost": end[_NONE]}
        return pa.Table.from_pylist(out, _arrow(_JOINED))

    narrow = units.select(*_NARROW)
    found = checkpoint(narrow.mapInArrow(pieces, _PIECE).groupBy("conv").applyInArrow(joined, _JOINED))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rows in _conversations(batches):
            ways = ways_on(rows, row["ends"], costs)
            left = [[*walk(rows, ways, q, costs, False)][-1][1] if ways[0][q] < _NEVER else 0 for q in range(4)]
            yield _batch([{"conv": row["conv"], "part": row["part"], "left": left}], _arrow("conv string, part int, left array<bigint>"))

    def starts(group: pa.Table) -> pa.Table:
        state, out = _NONE, []
        for r in sorted(group.to_pylist(), key=lambda r: r["part"]):
            out.append({"conv": r["conv"], "part": r["part"], "start": state})
            state = r["left"][state]
        return pa.Table.from_pylist(out, _arrow("conv string, part int, start int"))

    of_pieces = narrow.join(F.broadcast(found.select("conv", "part", "ends")), ["conv", "part"])
    started = of_pieces.select(*_NARROW, "ends").mapInArrow(leaves, "conv string, part int, left array<bigint>").groupBy("conv").applyInArrow(starts, "conv string, part int, start int")
    border = checkpoint(found.select("conv", "part", "ends", "final").join(started, ["conv", "part"]))
    return border, found.where("cost IS NOT NULL").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _edited(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple[dict, list[_Unit], int, Iterator[tuple[str, int, str]]]]:
    """Of each conversation in a partition: its first row, its units, its cost and its edits."""
    for row, units in _conversations(batches):
        whole = row["ends"] is None
        ways = ways_on(units, costs.end() if whole else row["ends"], costs)
        start = _NONE if whole else row["start"]
        yield row, units, ways[0][start], walk(units, ways, start, costs, whole or row["final"])


def _with_border(units: DataFrame, border: DataFrame) -> DataFrame:
    return units.join(F.broadcast(border), ["conv", "part"], "left").select(*_NARROW, "role", "text", "ends", "final", "start")


def repair_turns(turns: DataFrame, costs: Costs | None = None, n: str | None = None) -> DataFrame:
    """The edits of all conversations of turns (conv_id, turn, role, text), a row each: conv_id, part, place, edit, turn, role and text.

    In the order of part and place, the rows whose edit is not D are the repaired conversation; an inserted turn has no turn number.
    """
    costs = costs or Costs()
    ship(turns.sparkSession)
    units = sorted_units(turns, n)
    border, _ = _crossing(units, costs)
    ddl = "conv string, part int, place bigint, edit string, turn bigint, role string, text string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, of, _, edits in _edited(batches, costs):
            held, size = [], 0
            for place, (edit, k, role) in enumerate(edits):
                if edit:
                    turn, text = (None, "") if k < 0 else (of[k].turn, of[k].text)
                    held.append({"conv": row["conv"], "part": row["part"], "place": place, "edit": edit, "turn": turn, "role": role, "text": text})
                    size += len(text)
                if size > PIECE_BYTES * 64 or not edit:
                    yield _batch(held, schema)
                    held, size = [], 0

    return _with_border(units, border).mapInArrow(run, ddl).select(_unnamed(turns.schema["conv_id"].dataType), "part", "place", "edit", "turn", "role", "text")


def audit_conversations(turns: DataFrame, known: DataFrame | None = None, costs: Costs | None = None, n: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of turns, and of those of known (conv_id) that have no rows there."""
    costs = costs or Costs()
    ship(turns.sparkSession)
    units = sorted_units(turns, n)
    border, of_border = _crossing(units, costs)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ddl = f"conv string, part int, piece bigint, {', '.join(f'{c} bigint' for c in counts)}, audit string, body binary, sha string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, of, cost, edits in _edited(batches, costs):
            whole, digest, letters, body, size, piece = row["ends"] is None, hashlib.sha256(), [], [], 0, 0
            started = False
            for edit, k, role in edits:
                letters.append(edit)
                if edit not in ("", "D"):
                    line = f"\n{role}:{'' if k < 0 else of[k].text}".encode("utf-8", "surrogatepass")
                    if whole:
                        digest.update(line if started else line[1:])
                        started = True
                        continue
                    body.append(line)
                    size += len(line)
                if not whole and (size >= PIECE_BYTES or len(letters) >= PIECE_BYTES or not edit):
                    yield _batch([{"conv": row["conv"], "part": row["part"], "piece": piece, "audit": "".join(letters), "body": b"".join(body)}], schema)
                    letters, body, size, piece = [], [], 0, piece + 1
            if whole:
                found = _counts(of)
                turns_ = [t for t in (found["first_turn"], found["last_turn"]) if t is not None]
                yield _batch([{"conv": row["conv"], **{c: found.get(c) for c in counts}, "gaps": _gaps(turns_, found["distinct"]), "cost": cost, "audit": "".join(letters), "sha": digest.hexdigest()}], schema)

    done = checkpoint(_with_border(units, border).mapInArrow(run, ddl))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        for conv, group in groupby(rows(), key=lambda r: r["conv"]):
            digest, letters, started = hashlib.sha256(), [], False
            for r in group:
                letters.append(r["audit"])
                digest.update(r["body"] if started else r["body"][1:])
                started = started or bool(r["body"])
            yield _batch([{"conv": conv, "audit": "".join(letters), "sha": digest.hexdigest()}], _arrow("conv string, audit string, sha string"))

    pieces = done.where("sha IS NULL").select("conv", "part", "piece", "audit", "body")
    in_order = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece").mapInArrow(hashed, "conv string, audit string, sha string")
    across = in_order.join(of_border, "conv")
    found = done.where("sha IS NOT NULL").select("conv", *counts, "audit", "sha").unionByName(across.select("conv", *counts, "audit", "sha"))
    if known is not None:
        found = known.select(_named(F.col("conv_id")).alias("conv")).distinct().join(found, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    none = hashlib.sha256(b"").hexdigest()
    return found.select(_unnamed(turns.schema["conv_id"].dataType), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(none)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults, by the checksum of conversation and turn: rows dropped, emptied, cut, repeated (column n: 2) or given to the user."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(named) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """What audit_conversations finds in damaged conversations, for each of conversations."""
    return audit_conversations(damage(conversations), conversations, n="n")


#: The same by recursion over places, with one insertion or two before each row written out.
SQL = r"""
WITH RECURSIVE byte_step AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS step
  FROM (SELECT unnest(range(256)) AS b)),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                         lambda c, b: xor(c // 256, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, byte_step),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS next_initial
  FROM placed),
priced AS (
  SELECT *, CASE fault WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 WHEN 'truncated' THEN 5 ELSE 0 END AS stays,
         CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END AS ks, CASE WHEN initial = 'u' THEN 0 ELSE 1 END AS ku, CASE WHEN initial = 'a' THEN 0 ELSE 1 END AS ka
  FROM faults),
ways AS (
  SELECT conv_id, max(n) + 1 AS i, [0, 10, 5, 0] AS w FROM priced GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [least(x[1], 5 + x[3], 10 + x[4]), least(x[2], 5 + x[3], 10 + x[4]), least(x[3], 5 + x[4]), least(x[4], 5 + x[3])]
  FROM (
    SELECT p.conv_id, p.i, [least(2 + w[1], stays + ks + w[2], stays + ku + w[3]), least(2 + w[2], stays + ku + w[3]), least(2 + w[3], stays + ka + w[4]), least(2 + w[4], stays + ku + w[3])] AS x
    FROM ways b JOIN priced p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.i = b.i - 1)),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM ways WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE following END, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE following WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT k.*, p.initial, p.role, p.text, CASE WHEN q = 3 THEN 4 ELSE 3 END AS following,
           CASE WHEN p.i IS NULL THEN 'I' WHEN 2 + a.w[q] = h.w[q] THEN 'D' WHEN 5 + h.w[CASE WHEN q = 3 THEN 4 ELSE 3 END] = h.w[q] THEN 'I'
                WHEN (q = 1 AND initial = 's' AND stays + a.w[2] = h.w[q]) OR (q <> 3 AND initial = 'u' AND stays + a.w[3] = h.w[q]) OR (q = 3 AND initial = 'a' AND stays + a.w[4] = h.w[q]) THEN 'K' ELSE 'R' END AS edit
    FROM walk k JOIN ways h ON h.conv_id IS NOT DISTINCT FROM k.conv_id AND h.i = k.i
         LEFT JOIN ways a ON a.conv_id IS NOT DISTINCT FROM k.conv_id AND a.i = k.i + 1
         LEFT JOIN priced p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.i = k.i
    WHERE p.i IS NOT NULL OR h.w[q] > 0)),
repaired AS (SELECT k.conv_id, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM walk k JOIN ways h ON h.conv_id IS NOT DISTINCT FROM k.conv_id AND h.i = k.i WHERE h.w[q] = 0 AND NOT EXISTS (SELECT 1 FROM priced p WHERE p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.i = k.i)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE next_initial IS NOT NULL AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.w[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ways b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
