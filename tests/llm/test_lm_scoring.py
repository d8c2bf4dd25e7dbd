import math
import random

import numpy as np

from factloom.llm import lm_scoring as lm


def corpus(n=300):
    """Words that follow each other in a ring, so that both neighbours tell the word between them."""
    rng = random.Random(6)
    return [(k, " ".join(f"w{(start + j) % 12}x" for j in range(rng.randint(30, 90)))) for k in range(n) for start in [rng.randrange(12)]]


def test_a_token_counts_only_through_its_neighbours():
    rng = np.random.default_rng(0)
    context = lm.windows(rng.integers(0, 100, 9))
    assert context.shape == (9, 4) and context[0, 0] == context[0, 1] == context[8, 3] == lm.EDGE
    classes = rng.integers(0, 100, 9)
    changed = classes.copy()
    changed[4] = 101
    assert (lm.windows(classes)[4] == lm.windows(changed)[4]).all()


def test_probabilities_add_up_and_training_helps(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocabulary, net = lm.train(docs)
    counts = {}
    for _, t in rows:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    assert len(vocabulary.ids) == len(counts)
    context = lm.windows(vocabulary.classes[:12])
    assert np.allclose(sum(np.exp(net.log_probs(context, np.full(len(context), c))) for c in range(lm.CLASSES)), 1, atol=1e-4)
    fresh = lm.WindowNet.fresh(np.full(lm.CLASSES, 1 / lm.CLASSES))
    texts = [t for _, t in rows[:40]]
    trained = sum(x for _, x in lm.score_texts(texts, vocabulary, net))
    assert trained > sum(x for _, x in lm.score_texts(texts, vocabulary, fresh))
    shuffled = [" ".join(random.Random(1).sample(t.split(), len(t.split()))) for t in texts]
    assert trained > sum(x for _, x in lm.score_texts(shuffled, vocabulary, net))


def test_sums_against_one_token_at_a_time(spark):
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string").coalesce(1)
    vocabulary, net = lm.train(docs)
    text = "w1x w2x unseen w4x"
    classes, inside = vocabulary.look_up(lm.tokens(text))
    by_hand = 0.0
    for k in range(4):
        padded = [lm.EDGE, lm.EDGE, *classes.tolist(), lm.EDGE, lm.EDGE]
        h = np.tanh(sum(net.tables[j][padded[k + o]] for j, o in enumerate((0, 1, 3, 4))))
        z = h @ net.out + net.bias
        by_hand += float(z[classes[k]] - math.log(np.exp(z).sum())) + inside[k]
    assert abs(lm.score_texts([text], vocabulary, net)[0][1] - by_hand) < 1e-3
    assert abs(inside[2] - (sum(vocabulary.spelled[b] for b in b"unseen") + vocabulary.spelled[256])) < 1e-9


def test_every_token_is_a_target_once():
    lengths = [0, 1, 2, 3, 4, 7, 8, 50, 1]
    at = np.concatenate([lm.targets(lengths, number) for number in range(lm.ROUNDS)])
    assert sorted(at.tolist()) == list(range(sum(lengths)))


def test_short_documents_are_trained_on(spark):
    docs = spark.createDataFrame([(k, ("a b c", "d e", "f")[k % 3]) for k in range(30)], "doc_id long, text string").coalesce(1)
    vocabulary, net = lm.train(docs)
    assert not np.array_equal(net.flat(), lm.WindowNet.fresh(vocabulary.prior).flat())


def test_the_vocabulary_is_full_whatever_the_counts(spark):
    once = [(f"w{k}", 1) for k in range(1000)]
    counts = spark.createDataFrame([("often", 9), ("twice", 2), *once], "word string, n long").selectExpr("cast(word as binary) word", "n").repartition(3)
    for most in (1, 2, 300, 5000):
        top = lm._most_frequent(counts, most)
        assert len(top) == min(most, 1002) and [bytes(r["word"]) for r in top][:2] == [b"often", b"twice"][:most]
    assert [r["word"] for r in lm._most_frequent(counts, 300)] == [r["word"] for r in lm._most_frequent(counts.repartition(5), 300)]
    assert lm._most_frequent(counts.where("n > 9"), 5) == []


def test_averaging_in_a_tree(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(40), "doc_id long, text string").repartition(9)
    monkeypatch.setattr(lm, "SHARD_CHARS", 1_000)
    _, flat = lm.train(docs)
    monkeypatch.setattr(lm, "AVERAGE_FAN", 2)
    _, deep = lm.train(docs)
    assert np.allclose(flat.flat(), deep.flat(), atol=1e-4)


def test_real_texts_score_above_texts_mixed_of_two_languages(spark):
    """The same words in both: the prose is invented word by word, so only its language ties neighbours."""
    rows = [(r.text, r.lang, r.doc_id % 10 == 0) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]
    vocabulary, net = lm.train(spark.createDataFrame([(t,) for t, _, held in rows if not held], "text string").repartition(2), id_col=None)
    by = {}
    for text, lang, held in rows:
        if held and len(text.split()) >= 60:
            by.setdefault(lang, []).append(text.split()[:60])
    pairs = [(x, y) for one, other in ((a, b) for a in by for b in by if a < b) for x, y in zip(by[one], by[other], strict=False)]
    real = [sum(s for _, s in lm.score_texts([" ".join(x), " ".join(y)], vocabulary, net)) for x, y in pairs]
    mixed = [sum(s for _, s in lm.score_texts([" ".join(w for p in zip(x[:30], y[:30], strict=True) for w in p), " ".join(w for p in zip(x[30:], y[30:], strict=True) for w in p)], vocabulary, net)) for x, y in pairs]
    assert len(pairs) > 30 and sum(a > b for a, b in zip(real, mixed, strict=True)) > 0.9 * len(pairs)


def test_odd_rows(odd, empty):
    got = lm.score_by_own_corpus(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count() and rows[3].n_tokens == 0 and rows[3].log_prob == 0 and rows[3].mean_log_prob is None
    assert rows[10].n_tokens == 40_000 and math.isfinite(rows[11].log_prob)
    assert lm.score_by_own_corpus(empty).count() == 0


def test_scores_do_not_depend_on_partitions(spark, odd, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_CHARS", 3_000)
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string")
    assert lm.deal(docs)[1] > 1
    first, again = (sorted((r.doc_id, r.log_prob) for r in lm.score_by_own_corpus(docs.repartition(n, "text")).collect()) for n in (1, 9))
    assert [i for i, _ in first] == [i for i, _ in again] and all(abs(x - y) < 1e-3 for (_, x), (_, y) in zip(first, again, strict=True))
    one, other = (sorted((str(r.doc_id), r.n_tokens, round(r.log_prob, 1)) for r in lm.score_by_own_corpus(odd.repartition(n)).collect()) for n in (1, 5))
    assert one == other
