import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from marktlens.llm import pseudolikelihood as pl

SMALL = pl.Shape(groups=4, within=5, others=4, hidden=6, share=1, rounds=2)


def log_probability(net, around, t):
    """Of class t, with loops and math alone."""
    h = np.tanh(sum(net.e[k][a].astype(float) for k, a in enumerate(around)) + net.c)
    top, low = h @ net.g + net.d, h @ net.w[t // net.shape.within] + net.b[t // net.shape.within]
    return float(np.log(np.exp(top[t // net.shape.within]) / np.exp(top).sum()) + np.log(np.exp(low[t % net.shape.within]) / np.exp(low).sum()))


def around_of(net, ids, i):
    return [ids[j] if 0 <= j < len(ids) else net.shape.size for j in (i - 2, i - 1, i + 1, i + 2)]


def slow_loss(net, texts):
    return -sum(log_probability(net, around_of(net, ids, i), t) for ids in texts for i, t in enumerate(ids))


def test_probabilities_sum_to_one():
    net = pl.Network(SMALL)
    ids = np.array([3, 1, 19, 7], np.int16)
    for place in range(4):
        assert abs(sum(np.exp(log_probability(net, around_of(net, ids, place), t)) for t in range(SMALL.size)) - 1) < 1e-5


def test_slow_twin():
    net, texts = pl.Network(SMALL), [[3, 1, 19, 7, 7, 2], [], [5], [0, 11, 11]]
    ids, sizes = np.array([t for x in texts for t in x], np.int16), np.array([len(x) for x in texts])
    want = [log_probability(net, around_of(net, x, i), t) for x in texts for i, t in enumerate(x)]
    assert np.allclose(net.log_probabilities(ids, sizes), want, atol=1e-5)


def test_gradient():
    net = pl.Network(SMALL)
    ids = np.array([3, 1, 19, 7, 7, 2, 5, 11], np.int16)
    before = net.vector.copy()
    net.learn(net.contexts(ids), ids)
    grad = (before - net.vector) / SMALL.rate
    r = np.random.default_rng(0)
    for i in [*r.choice(len(before), 40, replace=False), int(np.abs(grad).argmax())]:
        up, down = before.copy(), before.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        want = (slow_loss(pl.Network(SMALL, up), [ids]) - slow_loss(pl.Network(SMALL, down), [ids])) / np.sqrt(len(ids))
        assert abs(want / 2e-2 - grad[i]) < 2e-2


def corpus(spark, n=300):
    rows = [(i, " ".join(("red green blue black" if (i + j) % 2 else "one two three four") for j in range(30))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_orderly_text_scores_higher(spark):
    docs = corpus(spark)
    model = pl.train(docs, pl.Shape(groups=6, within=6, others=8, rate=0.1, share=1, rounds=10))
    asked = spark.createDataFrame([(1, "red green blue black one two three four"), (2, "black red two one blue four green three"), (3, None), (None, ""), (5, "red green blue black " * 30000), (1, "red")], "doc_id long, text string")
    rows = pl.score(asked, model).collect()
    assert len(rows) == 6
    by = {(r.doc_id, r.n_tokens): r for r in rows}
    assert by[1, 8].mean_log_probability > by[2, 8].mean_log_probability + 1
    assert by[3, 0].pseudo_log_likelihood == 0 and by[None, 0].mean_log_probability is None
    assert by[5, 120000].pseudo_log_likelihood < 0
    ids = model.vocabulary.ids("red green blue black one two three four")
    assert by[1, 8].pseudo_log_likelihood == pytest.approx(model.network.log_probabilities(ids).sum(), rel=1e-4)


def test_beats_word_frequencies_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    shape = pl.Shape(share=2, rounds=2)
    held = docs.filter("doc_id % 10 = 0")
    train = docs.filter("doc_id % 10 <> 0")
    model = pl.train(train, shape)
    mean = lambda m: pl.score(held, m).selectExpr("sum(pseudo_log_likelihood) / sum(n_tokens)").first()[0]
    untrained = pl.start(train, shape)  # begins at the words' frequencies
    flat = pl.Model(model.vocabulary, model.shares, model.unseen, pl.Network(shape))
    assert mean(model) > mean(untrained) + 0.01 > mean(flat)


def slow_counts(rows):
    counts = Counter()
    for t in rows:
        counts.update(re.findall(r"\w+|[^\w\s]", (t or "").lower()))
    return counts


def test_scores_against_brute_force(spark):
    """Counting, classes, shares, training of one replica and scoring, all anew with loops."""
    r = np.random.default_rng(3)
    pick = lambda n: " ".join(f"w{int(x)}" for x in r.zipf(1.5, n) % 60)
    rows = [(i, pick(int(r.integers(0, 40))), "clash") for i in range(30)] + [(7, "w1 w2. É", "x"), (7, "w1 w2. É", "y"), (None, "w3 w4", None), (99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").coalesce(1)
    shape = pl.Shape(groups=3, within=4, others=3, hidden=5, share=1, rounds=1)
    got = pl.train_and_score(docs, shape).collect()
    counts = slow_counts(t for _, t, _ in rows)
    own = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:9]]
    signed = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) - (xxhash.xxh64_intdigest(w.encode(), 42) >> 63 << 64)
    cls = {w: own.index(w) if w in own else 9 + signed(w) % 3 for w in counts}
    texts = [re.findall(r"\w+|[^\w\s]", (t or "").lower()) for _, t, _ in rows]
    n = np.zeros(12)
    for w, k in counts.items():
        n[cls[w]] += k
    net = pl.Network.of_counts(shape, n)
    assert np.allclose([sum(np.exp(net.d)), *np.exp(net.b).sum(1)], 1, atol=1e-5)
    # one step over all tokens in one batch: the gradient by small differences of the slow loss
    ids, step = [[cls[w] for w in t] for t in texts], shape.rate / np.sqrt(sum(counts.values()))
    grad = np.empty(len(net.vector))
    for i in range(len(grad)):
        up, down = net.vector.copy(), net.vector.copy()
        up[i] += 5e-3
        down[i] -= 5e-3
        grad[i] = (slow_loss(pl.Network(shape, up), ids) - slow_loss(pl.Network(shape, down), ids)) / 1e-2
    net = pl.Network(shape, net.vector - step * grad)
    kinds = Counter(cls.values())
    share = {w: 0 if w in own else np.log((counts[w] + 0.5) / (n[cls[w]] + 0.5 * (kinds[cls[w]] + 1))) for w in counts}
    want = [(d, len(t), -slow_loss(net, [x]) + sum(share[w] for w in t)) for (d, _, _), t, x in zip(rows, texts, ids)]
    key = lambda x: (str(x[0]), x[1], round(x[2], 2))
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.pseudo_log_likelihood) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-2, rel=1e-3)
    assert all((r.mean_log_probability is None) == (r.n_tokens == 0) for r in got)


def test_words_know_their_counts(spark):
    """Shares of a class and of one unseen word sum to one; a word that is more frequent scores higher in the same place."""
    docs = spark.createDataFrame([(i, f"the old {'crow' if i % 3 else 'heron'} sings") for i in range(30)], "doc_id long, text string")
    shape = pl.Shape(groups=2, within=2, others=1, share=1, rounds=1)
    model = pl.train(docs, shape)
    assert np.exp([r.log_share for r in model.shares.collect()]).sum() + np.exp(model.unseen[0]) == pytest.approx(1)
    asked = spark.createDataFrame([(0, "the old crow sings"), (1, "the old heron sings"), (2, "the old dodo sings")], "doc_id long, text string")
    s = {r.doc_id: r.pseudo_log_likelihood for r in pl.score(asked, model).collect()}
    assert s[0] > s[1] > s[2]


def test_empty(spark):
    docs = corpus(spark, 1).filter("false")
    assert pl.score(docs, pl.train(docs, SMALL)).collect() == [] == pl.train_and_score(docs, SMALL).collect()


def test_averaging_follows_every_document(spark):
    docs = corpus(spark, 40)
    a, b = pl.train(docs.repartition(3), SMALL), pl.train(docs.filter("doc_id < 39").repartition(3), SMALL)
    assert not np.array_equal(a.network.vector, b.network.vector)


def test_ids_kept_in_between(spark):
    docs = corpus(spark, 30).repartition(1)
    twin = pl.score(docs, pl.train(docs, SMALL)).orderBy("doc_id").collect()
    got = pl.train_and_score(docs, SMALL).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in twin] and all(abs(a.pseudo_log_likelihood - b.pseudo_log_likelihood) < 1e-2 for a, b in zip(got, twin))


def test_every_token_is_a_target(spark):
    shape = pl.Shape()
    for n in range(20):
        at = [pl.targets(bytes([n, 7]), n, turn, shape.share) for turn in range(shape.rounds)]
        assert sorted(np.concatenate(at)) == list(range(n))
    with pytest.raises(ValueError):
        pl.Shape(share=3, rounds=2)
    docs = spark.createDataFrame([(i, "red" if i % 2 else "red green") for i in range(6)], "doc_id long, text string")
    assert not np.array_equal(pl.train(docs, shape).network.vector, pl.start(docs, shape).network.vector)


def test_words_by_pieces_are_those_of_the_text(spark):
    """White space of any kind, marks, a sigma at a word's end, long runs without white space; pieces that occur again are counted as such."""
    texts = ["", " \n", "Don't stop_it, it's 5.0! a_ _", "\u039f\u0394\u039f\u03a3 \u0391\u03a3. a\u3000b\u2028c\x1cd\x85e\u00a0f\u200bg", "e\u0301t\u00e9 e\u0301 \u0130X \u00b2 \u0663", "x" * 500 + "-" + "y" * 500, "a,b " * 50]
    want = [pl._WORD.findall(t.lower()) for t in texts]
    assert [[w for p in pl.pieces(t) for w in pl.words_of(p)] for t in texts] == want
    assert pl.pieces(texts[-1]) == ["a,b"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.word: r.n for r in pl.word_counts(docs).collect()} == Counter(w for words in want for w in words)
