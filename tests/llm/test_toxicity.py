import math
import random
import zlib

import pytest

from marktlens.llm import queries, toxicity


def slow_segments(x, lo=0, hi=None):
    """By the definition: the best contiguous run, then the same to its left and right."""
    hi = len(x) if hi is None else hi
    best = max(((sum(x[a:b]), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    s, a, b = best
    return slow_segments(x, lo, a) + [(a, b, s)] + slow_segments(x, b, hi)


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    r = random.Random(seed)
    at = sorted(r.sample(range(40), r.randint(0, 20)))
    pos = {p: r.uniform(0.1, 3) for p in at}
    drift = r.choice([0.05, 0.7, 1.5])
    got = toxicity.segments(at, [pos[p] for p in at], drift)
    want = slow_segments([pos.get(i, -drift) for i in range(40)])
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def corpus(spark, n=400):
    r = random.Random(1)
    words = [f"{a}{b}{c}" for a in "ba ce di fo gu".split() for b in "lam ner tos wik rup zed".split() for c in "a e i o u en um is".split()]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        if i % 4 == 1:
            w[r.randrange(len(w))] = r.choice(["vilesome", "vilething", "nastybit"])
        rows.append((i, " ".join(w), "score?"))
        labels.append((i, int(i % 4 == 1)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_explains(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert {r.predicted for r in rows if r.doc_id % 4 == 1} == {1} and {r.predicted for r in rows if r.doc_id % 4 != 1} == {0}
    hit = next(r for r in rows if r.doc_id == 1)
    assert any("vile" in p.text or "nasty" in p.text for p in hit.passages) and hit.score > 0.9


def test_odd_rows(spark):
    docs, labels = corpus(spark, 100)
    odd = spark.createDataFrame([(None, "vilesome words"), (901, None), (902, ""), (903, "balam " * 50000), (904, "x" * 100000), (1, "copy vilesome"), (1, "copy vilesome")], "doc_id long, text string")
    labels = labels.union(spark.createDataFrame([(None, 1), (5, None), (901, 0), (1, 0)], "doc_id long, toxic int"))
    model = toxicity.train(docs.select("doc_id", "text").union(odd), labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert [r.predicted for r in rows if r.doc_id in (901, 902, 903, 904)] == [0] * 4


def test_without_labels(spark):
    docs, labels = corpus(spark, 20)
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        assert {(round(r.score, 6), r.predicted) for r in toxicity.score(docs, toxicity.train(docs, some)).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.filter("false"), toxicity.train(docs.filter("false"), labels)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in rows if rows[d].held_out]
    assert all(zlib.crc32(str(d).encode()) % 4 == 2 for d in held) and len(rows) == 1000
    pairs = [(rows[d].score, labels[d]) for d in held if d in labels]
    right = sum((a > b) + 0.5 * (a == b) for a, x in pairs if x for b, y in pairs if not y)
    n = sum(y for _, y in pairs)
    assert right / (n * (len(pairs) - n)) > 0.75


def test_middle_of_long_runs_is_scored(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    around = "_".join(["balam", "celam", "dinere", "fotosa"] * 6)
    for glue in ("_", ""):
        bad, good = around + glue + "vilesome" + glue + around, around + glue + "ruped" + glue + around
        rows = spark.createDataFrame([(1, bad), (2, good)], "doc_id long, text string")
        a, b = (r.score for r in toxicity.score(rows, model).orderBy("doc_id").collect())
        assert a > b and model.scan(bad, {})[1]
    for n in (1, 40, 41, 44, 45, 64, 100):
        w = "".join(chr(0x4E00 + i) for i in range(n))
        grams = {w[i : i + 5] for i in range(n - 4)}
        assert grams <= {x[i : i + 5] for x in toxicity.tokens(w) for i in range(len(x) - 4)} and all(len(x) <= 40 for x in toxicity.tokens(w))


def slow_features(word):
    marked = f"^{word}$"
    mask, out = (1 << 64) - 1, set()

    def mixed(h):
        h = (h ^ (h >> 31)) * 0x9E3779B97F4A7C15 & mask
        return (h ^ (h >> 29)) % toxicity.BUCKETS

    power = lambda k: pow(0x100000001B3, k, 1 << 64)
    out.add(mixed(sum(ord(c) * power(i) for i, c in enumerate(marked)) & mask))
    for n in (4, 5):
        for i in range(len(marked) - n + 1):
            out.add(mixed((sum(ord(marked[i + k]) * power(n - k) for k in range(n)) + n) & mask))
    return out


def test_counts_and_log_odds_against_loops(spark):
    """Features of each document, counts by label, the prior over all documents, and the lower bounds of the log-odds."""
    docs, labels = corpus(spark, 120)
    docs = docs.union(spark.createDataFrame([(1, "vilesome again", "x"), (500, None, "x")], docs.schema))
    model = toxicity.train(docs, labels, errors=0.5)
    toxic_of = {r.doc_id: r.toxic for r in labels.collect()}
    bags, one = [], {}
    for d, t, _ in docs.collect():
        bag = {f for w in (t or "").lower().split() for f in slow_features(w)}
        bags.append(bag)
        if d in toxic_of and zlib.crc32(str(d).encode()) % 4 != 2:
            key = ((t or "").lower(), toxic_of[d])
            one[key] = min(one.get(key, (d, bag)), (d, bag), key=lambda x: x[0])
    trained = [(y, bag) for (_, y), (d, bag) in one.items() if zlib.crc32(f"c{d}".encode()) % 4 != 0]
    n, clean, toxic = ({} for _ in range(3))
    for bag in bags:
        for f in bag:
            n[f] = n.get(f, 0) + 1
    for y, bag in trained:
        for f in bag:
            (toxic if y else clean)[f] = (toxic if y else clean).get(f, 0) + 1
    all_clean, all_toxic, all_n = sum(clean.values()), sum(toxic.values()), sum(n.values())
    want = {}
    for f, t in toxic.items():
        a = max(1e-9, all_toxic / all_n * max(n[f], clean.get(f, 0) + t))
        x, y = t + a, clean.get(f, 0) + a
        lower = math.log(x / (2 * all_toxic)) - math.log(y / (all_clean + all_toxic)) - 0.5 * math.sqrt(1 / x + 1 / y)
        if lower > 0:
            want[f] = lower
    got = {int(i): float(model.lower[i]) for i in model.lower.nonzero()[0]}
    assert got.keys() == want.keys() and len(got) > 5 and all(abs(got[f] - want[f]) < 1e-5 for f in got)


def test_words_of_many_texts_are_learned_together(monkeypatch):
    """Features are made for groups of texts, and give what each text gives by itself: bags, and segments, also where the memo fills up."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé_日", k=rng.choice((1, 3, 6, 45, 90)))) for _ in range(400)]
    texts = ["", *(" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(300)), ""]
    calls, make = [], toxicity.features
    monkeypatch.setattr(toxicity, "features", lambda w: calls.append(len(w)) or make(w))
    model = toxicity.Model()
    model.lower[rng.sample(range(toxicity.BUCKETS), 50_000)] = 1.5

    class Batch:
        def __init__(self, rows):
            self.rows = rows

        def column(self, _):
            return self

        def to_pylist(self):
            return self.rows

    batches = [Batch(texts[:200]), Batch([]), Batch(texts[200:])]
    want = [{f for w in toxicity.tokens(t) for f in slow_features(w)} for t in texts]
    assert [set(bag.tolist()) for _, _, bag in toxicity._bags(batches)] == want and len(calls) <= 3
    alone = [model.scan(t, {}) for t in texts]
    assert sum(bool(found) for _, found, _ in alone) > 100
    calls.clear()
    assert list(model.scan_all(texts, {})) == alone and len(calls) <= 3
    monkeypatch.setattr(toxicity, "MEMO", 300)
    monkeypatch.setattr(toxicity, "TOGETHER", 500)
    assert [set(bag.tolist()) for _, _, bag in toxicity._bags(batches)] == want
    assert list(model.scan_all(texts, {})) == alone
