import hashlib
import math
from collections import defaultdict

import pytest

from marktlens.llm import mixing, queries
from tests.compare import same


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")


ROWS = [(i, "w " * (i % 7), "big" if i % 3 else "mid", "x") for i in range(300)] + [(1000 + i, "a b c", "small", "x") for i in range(9)]
ODD = [(2000, None, "big", "x"), (None, "q r", "big", "x"), (2001, "a b c d", None, "x"), (2001, "a b c d", None, "x"), (2002, "", "void", None), (2003, "l " * 20000, "long", "x")]


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def test_oracle(spark):
    assert same(queries.op3_source_mixing(spark, "/root/testdata/sf0.001"), queries.OP3_SQL) > 200


def test_entropy_target(spark):
    rows = docs(spark, ROWS).selectExpr("source as _s", "size(filter(split(text, ' '), x -> x <> '')) as tokens")
    w = {r._s: r for r in mixing.weights(rows, target_entropy=0.9).collect()}
    assert abs(entropy([r.weight for r in w.values()]) - 0.9 * math.log(3)) < 1e-9
    assert min(r.quota / r.source_tokens for r in w.values()) >= 1 - 1e-6


def test_repeat_limit(spark):
    rows = docs(spark, ROWS).selectExpr("source as _s", "size(filter(split(text, ' '), x -> x <> '')) as tokens")
    w = mixing.weights(rows, max_repeats=3.0).collect()
    epochs = [r.quota / r.source_tokens for r in w]
    assert 2.9 < max(epochs) / min(epochs) <= 3.1


def test_draws_meet_quotas_in_every_block(spark):
    found = mixing.draw(docs(spark, ROWS + ODD), max_repeats=2.5, blocks=4).collect()
    by = defaultdict(int)
    for r in found:
        by[(r.source, r.block)] += r.tokens
    for s in ("big", "mid"):
        each = [by[(s, b)] for b in range(4)]
        assert max(each) - min(each) <= 14
    assert {r.doc_id for r in found} == {r[0] for r in ROWS + ODD}  # nothing is left out
    assert all(n == 1 for n in __import__("collections").Counter((r.doc_id, r.epoch) for r in found if r.doc_id != 2001).values())


def test_budget_cuts(spark):
    found = mixing.draw(docs(spark, ROWS), max_repeats=2.0, budget=100).collect()
    assert 60 <= sum(r.tokens for r in found) <= 101


def test_empty(spark):
    assert mixing.draw(docs(spark, []), target_entropy=0.9).collect() == []


def test_needs_one_target(spark):
    with pytest.raises(ValueError):
        mixing.draw(docs(spark, ROWS)).collect()


def test_mix_repeats_rows(spark):
    d = docs(spark, ROWS + ODD)
    got = mixing.mix(d, max_repeats=3.0)
    assert got.columns == d.columns
    assert got.filter("source = 'small'").count() >= 18 and got.filter("doc_id = 2001").count() % 2 == 0


def slow_mix(rows, max_repeats, blocks, seed=1):
    """Rows in the order of their draws, with loops: exponent by halving, quotas, then epoch after epoch of each source."""
    tokens = [len((t or "").split()) for _, t, _ in rows]
    sums = defaultdict(int)
    for (_, _, s), n in zip(rows, tokens):
        sums[s] += n
    live = {s: n for s, n in sums.items() if n}
    p = {s: n / sum(live.values()) for s, n in live.items()}
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (max(p.values()) / min(p.values())) ** (1 - mid) <= max_repeats else (mid, hi)
    z = sum(x**hi for x in p.values())
    w = {s: x**hi / z for s, x in p.items()}
    budget = max(live[s] / w[s] for s in live)
    out = []
    for s in sums:
        quota, start = (round(w[s] * budget), 0) if s in live else (0, 0)
        for epoch in range(quota // live[s] + 1 if s in live else 1):
            own = [(hashlib.md5(f"{seed}:{'-' if d is None else d}:{epoch}".encode()).hexdigest(), d, t, n) for (d, t, source), n in zip(rows, tokens) if source == s and (n or not epoch)]
            own.sort(key=lambda x: (int(x[0][:4], 16) % mixing.PIECES, x[0]))
            for o, d, t, n in own:
                if n and start + n > quota and epoch == quota // live[s]:
                    break
                out.append((min(start * blocks // quota, blocks - 1) if quota else 0, o, d, t, s))
                start += n
    return [x[2:] for x in sorted(out, key=lambda x: x[:2])]


def test_mix_against_slow_twin(spark):
    rows = [(i, "w " * (i % 7) + str(i), "big" if i % 3 else "mid") for i in range(200)] + [(900 + i, "a b c", "small") for i in range(9)] + [(950, None, "big"), (951, "", None), (952, "q r", None), (953, "", "void")]
    d = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, source string, epoch string, block string, tokens int")
    got = mixing.mix(d.repartition(3), max_repeats=2.6, blocks=8)
    assert got.columns == d.columns
    assert [(r.doc_id, r.text, r.source) for r in got.collect()] == slow_mix(rows, 2.6, 8)


def test_equal_rows_have_draws_of_their_own(spark):
    d = docs(spark, [(1, "a b", "s", "x")] * 5 + [(2, "c " * 40, "t", "x")])
    drawn = mixing.draw(d, max_repeats=2.5)
    assert mixing.mix(d, max_repeats=2.5).filter("source = 's'").count() == drawn.filter("source = 's'").count() > 5


def test_tiny_source(spark):
    """Shares 10^5 apart: many epochs of one short text, spread over spans; a limit of repeats goes before the entropy."""
    d = docs(spark, [(1, "a " * 400_000, "big", "x"), (2, "b c d e", "tiny", "x")])
    many = mixing.draw(d, target_entropy=0.95)
    r = many.filter("source = 'tiny'").selectExpr("count(*) as n", "max(epoch) as last", "count(distinct epoch) as kinds", "max(start) as at").first()
    assert r.n == r.kinds == r.last + 1 > 10_000 and r.at == 4 * r.last
    both = mixing.draw(d, target_entropy=0.95, max_repeats=3.0)
    assert both.filter("source = 'tiny'").count() == 3
    far = docs(spark, [(1, "a", "s", "x")]).selectExpr("'+big' as _s", "1000000000L as tokens").union(docs(spark, [(1, "a", "s", "x")]).selectExpr("'+tiny' as _s", "1L as tokens"))
    assert {r._s: r.epochs for r in mixing.weights(far, target_entropy=0.95, max_repeats=50.0).collect()} == {"+big": 1, "+tiny": 50}


def test_many_equal_rows_take_linear_time(spark):
    rows = [(1, "a b c", "x", i) for i in range(20_000)] + [(2, "d e", "y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = mixing.mix(df, max_repeats=2.0).collect()
    assert sorted(r.n for r in got if r.doc_id == 1) == list(range(20_000))  # each of the equal rows has a draw of its own
    assert len(got) > 20_001
