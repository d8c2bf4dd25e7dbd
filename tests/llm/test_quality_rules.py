import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import quality_rules as qr


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    marked = [False] * len(words)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            marked[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(marked)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check(texts):
    m = qr.measure(texts)
    for k, text in enumerate(texts):
        assert tuple(m.loc[k, COUNTS]) == brute(text), text[:80]
        n, _, _, _, repeated = brute(text)
        assert m.base_failed[k] == (n < 20 or 100 * repeated > 30 * n)
        assert not (m.kept[k] and m.base_failed[k])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#|", max_size=120), max_size=5))
def test_counts_against_brute_force(texts):
    check(texts)


def test_repeats_never_run_over_text_ends():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(9)]
    check([" ".join(words), " ".join(words), " ".join(words * 2), " ".join(rng.choices(words, k=200)), ""])


def test_colliding_hashes_are_counted_anew(monkeypatch):
    monkeypatch.setattr(qr, "_mix", lambda x: np.zeros(len(x), np.uint64))
    words = [f"w{k}" for k in range(30)]
    check([" ".join(words), " ".join(words + words[:9]), " ".join(words[::-1])])


def test_blocks_do_not_matter(monkeypatch):
    texts = ["one two three four five six seven eight " * 3, "b " * 30, "c d e"]
    whole = qr.measure(texts)
    monkeypatch.setattr(qr, "BLOCK_BYTES", 10)
    assert whole.equals(qr.measure(texts))


def test_verdicts():
    rng = random.Random(2)
    clean = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))
    symbols = " ".join(w + "$$$" for w in clean.split())
    stutter = " ".join(w for w in clean.split()[:16] for _ in range(5))
    lines = "\n".join(["one line that comes again"] * 12 + [clean])
    assert qr.measure([clean, symbols, stutter, lines]).kept.tolist() == [True, False, False, False]


def test_odd_rows(odd, empty):
    got = {r.doc_id: r for r in qr.quality_rules(odd).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[10].n_words == 40_000 and got[10].n_repeat_words == 40_000
    assert qr.quality_rules(odd).count() == odd.count() and qr.quality_rules(empty).count() == 0
