import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(PATH, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@pytest.mark.parametrize(
    "text",
    ["", "a", "a" * 5000, "ab" * 3000, "é" * 700, "   \n\n  x", " " * 5000, "it's we'll I'd", "漢字かな混じり文" * 50, "\x1c\x85\xa0 ½²", "<|endoftext|>"],
)
def test_encodes_as_the_library_and_back(text):
    ids = next(CODEC.encode([text]))
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_rows_match_the_library():
    rng = random.Random(3)
    for letters in ("abcdefgh", "=-_", "aA1", "the "):
        text = "".join(rng.choice(letters) for _ in range(6000))
        assert next(CODEC.encode([text])) == LIBRARY.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=400))
def test_any_text(text):
    ids = next(CODEC.encode([text]))
    assert ids == LIBRARY.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_matrices_merge_as_one_row_at_a_time():
    words = [bytes(random.Random(k).choices(b"abcdehinorst", k=5 + k % 40)) for k in range(300)]
    assert CODEC.encode_pieces(words) == [CODEC.encode_pieces([w])[0] for w in words]


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    texts = ["some words go here", "other words", "some words go there"]
    assert list(CODEC.encode(texts)) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_digests_of_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd, PATH, P.PATTERN).collect()}
    want = set()
    for r in odd.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want and bpe.encode_digests(odd, PATH, P.PATTERN).count() == odd.count()
    assert bpe.encode_digests(empty, PATH, P.PATTERN).count() == 0
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(odd, PATH, P.PATTERN).collect()}
    assert ids[9] == LIBRARY.encode_ordinary(next(r.text for r in odd.collect() if r.doc_id == 9))


def test_long_pieces_take_their_time_in_proportion():
    import random
    import time

    rng = random.Random(2)
    own = bpe.codec(PATH, P.PATTERN)
    began = time.perf_counter()
    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)), "a" * 300_000, "abab" * 50_000, "\n" * 5000):
        assert list(own.encode([text]))[0] == LIBRARY.encode_ordinary(text)
    assert time.perf_counter() - began < 60 and all(len(x) <= bpe.MEMO_CHARS for x in own.memo)
