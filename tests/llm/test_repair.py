import hashlib
import itertools
import random
import re
import zlib

import pytest

from factloom.llm import repair

SPACES = " \t\n\x0b\x0c\r"
ACCEPTED = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra's search over (place, roles so far as a state), least cost and then least audit: audits are kept whole."""
    import heapq

    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, lines
        # A longer audit may still be less than its own beginning with another letter, so only equal ones are dropped.
        if (k, state, cost, audit) in done:
            continue
        done.add((k, state, cost, audit))
        moves = []
        for role in ("user", "assistant"):
            if role[0] in states[state]:
                moves.append((5, "I", k, role[0], f"{role}:"))
        if k < len(rows):
            _, _, role, text = rows[k]
            moves.append((2, "D", k + 1, state, None))
            if found[k] not in ("blank", "duplicate"):
                more = 5 if found[k] == "truncated" else 0
                if role[:1] in states[state]:
                    moves.append((more, "K", k + 1, role[:1], f"{role}:{text}"))
                for new in ("user", "assistant"):
                    if new[0] in states[state]:
                        moves.append((more + 1, "R", k + 1, new[0], f"{new}:{text}"))
        for c, letter, at, then, line in moves:
            heapq.heappush(heap, (cost + c, audit + letter, at, then, lines if line is None else (*lines, line)))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = []
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(group)
        cost, audit, lines = cheapest(group, found)
        turns = [r[1] for r in group if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(group))
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def found(df):
    return [(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()]


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, n, longest, ids=None):
    rng = random.Random(seed)
    rows = []
    for conv in ids or range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "so it goes", " \n", "", None, "Why?", f"{turn} is it. ", f"{conv} {turn}"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, 1]), role, text))
    return rows


def same(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert sorted(map(str, found(repair.repair_damaged(df)))) == sorted(map(str, brute(rows)))


def test_odd_rows_against_search(spark):
    same(spark, made(1, 150, 7, [*range(148), None, 2**62]))
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("ranges", [1, 1000])
def test_a_conversation_across_ranges(spark, monkeypatch, ranges):
    # A range is so small that conversations cross several.
    monkeypatch.setattr(repair, "RANGE_BYTES", 1 << 30 if ranges == 1 else 40)
    monkeypatch.setattr(repair, "PIECE_BYTES", 3)
    same(spark, made(2, 3, 13))


def test_long_conversations_across_ranges_give_what_one_range_gives(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Turn {t} of {c}.", "cut off", ""])) for c in (7, 8) for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = found(repair.repair_damaged(df))
    monkeypatch.setattr(repair, "RANGE_BYTES", 300)
    assert sorted(whole) == sorted(found(repair.repair_damaged(df)))
    lines = {}
    for r in repair.repair_turns(repair.damage(df), n="n").orderBy("conv_id", "part", "place").collect():
        lines.setdefault(r.conv_id, []).append(r)
    for conv, *_, audit, sha in whole:
        assert "".join(r.edit for r in lines[conv]) == audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines[conv] if r.edit != "D").encode()).hexdigest() == sha
        assert ACCEPTED.match("".join(r.role[0] for r in lines[conv] if r.edit != "D"))


def test_given_costs_can_make_insertions_cheapest(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = repair.audit_conversations(df, costs=repair.Costs(rerole=9, delete=9, insert=1)).collect()[0]
    assert (got.cost, got.audit) == (1, "KIKK")
    assert repair.audit_conversations(df).collect()[0].audit == "DKK"


def test_many_equal_rows_are_one_unit(spark):
    same(spark, [(1, 0, "user", "Hello.")] + [(1, 3, "assistant", "Same.")] * 6 + [(1, None, "system", "S.")] * 2 + [(1, 5, "user", "Same.")])


def test_ids_of_text(spark):
    rows = [(f"c{k}", t, "user" if t % 2 else "assistant", "Yes.") for k in range(5) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = found(repair.repair_damaged(df))
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
