from factloom.llm import chat

ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "hey"),
    (2, 0, "system", "same"), (2, 1, "user", "q"), (3, 0, "system", "same"), (3, 1, "user", "q"), (3, 2, "assistant", "a"),
    (4, 0, None, None), (4, None, "user", "no turn"), (5, 0, "", ""), (5, None, "user", "no turn"),
    (6, 0, "user", "alone"), (9, 0, "user", "odd one"), (None, 0, "user", "no conversation"),
    (10, 0, "user", "twice"), (10, 0, "user", "twice"), (11, 0, "user", "twice"),
]


def test_prompts_and_completions(spark):
    turns = chat.neighbours_as_pairs(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(4))
    rows = chat.preference_rows(turns).collect()
    by = {}
    for r in rows:
        by.setdefault((r.pair_id, r.part), []).append((r.turn, r.rendered, r.rendered[r.loss_from : r.loss_to]))
    for x in by.values():
        x.sort(key=lambda t: (t[0] is None, t[0] or 0))
    assert [t[0] for t in by[0, "prompt"]] == [0] and by[0, "prompt"][0][2] == ""
    assert [(t[0], t[2]) for t in by[0, "chosen"]] == [(1, "hello<|end|>\n"), (2, "")]
    assert [(t[0], t[2]) for t in by[0, "rejected"]] == [(1, "hey<|end|>\n")]
    assert len(by[1, "prompt"]) == 2 and (1, "chosen") not in by and len(by[1, "rejected"]) == 1
    assert len(by[2, "prompt"]) == 1 and len(by[2, "chosen"]) == len(by[2, "rejected"]) == 1
    assert len(by[3, "chosen"]) == 1 and len(by[4, "rejected"]) == 1 and len(by[None, "chosen"]) == 1
    assert len(by[5, "chosen"]) == 2 and len(by[5, "rejected"]) == 1  # twice is not once
    whole = {r.pair_id: r for r in chat.assemble(chat.preference_rows(turns)).collect()}
    assert [whole[0].chosen[a:b] for a, b in whole[0].chosen_loss] == ["hello<|end|>\n"] and [whole[0].rejected[a:b] for a, b in whole[0].rejected_loss] == ["hey<|end|>\n"]
    for k, row in whole.items():
        for part, text, spans in (("chosen", row.chosen, row.chosen_loss), ("rejected", row.rejected, row.rejected_loss)):
            assert "".join(text[a:b] for a, b in spans) == "".join(t[2] for t in by.get((k, part), []))
    assert whole[0].prompt + whole[0].rejected == "<|user|>\nhi<|end|>\n<|assistant|>\nhey<|end|>\n"


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra string")
    assert chat.preference_rows(chat.neighbours_as_pairs(none)).count() == 0


def test_a_very_long_pair(spark, hot):
    rows = [(k % 2, k // 2, "user" if k % 4 < 2 else "assistant", f"text {k // 2 if k < 60 else k}") for k in range(200)]
    turns = chat.neighbours_as_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    got = chat.preference_rows(turns)
    assert {(r.part, r["count"]) for r in got.groupBy("part").count().collect()} == {("prompt", 30), ("chosen", 70), ("rejected", 70)}
    assert sorted((r.part, r.turn) for r in got.collect() if r.loss_to)[0] == ("chosen", 31)


def test_pairs_and_turns_of_larger_ones(spark):
    turns = chat.neighbours_as_pairs(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(4))
    every = chat.preferences(turns).collect()
    assert all(r.part is None for r in every) and len({r.pair_id for r in every}) == len(every)
    first = next(r for r in every if r.pair_id == 0)
    a, b = map(int, first.chosen_loss.split(":"))
    assert first.chosen[a:b] == "hello<|end|>\n" and first.prompt == "<|user|>\nhi<|end|>\n"
    # Pair 0 has 48 characters of roles and texts: over the limit its turns stay rows, those of smaller pairs do not.
    some = chat.preferences(turns, pair_chars=40).collect()
    apart = [r for r in some if r.part is not None]
    assert {r.pair_id for r in apart} == {0} and sorted((r.part, r.turn) for r in apart) == [("chosen", 1), ("chosen", 2), ("prompt", 0), ("rejected", 1)]
    assert {r.pair_id for r in some if r.part is None} == {r.pair_id for r in every} - {0}
    none = chat.preferences(turns, pair_chars=-1).collect()
    assert all(r.prompt is None for r in none) and len(none) == chat.preference_rows(turns).count()
