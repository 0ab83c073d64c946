import numpy as np
import pytest
from pyspark.sql import functions as F

from marktlens.llm import negatives, queries
from tests.compare import same


def brute(rows, positives=5, negatives=3, share=(50, 95)):
    """rows: vec_id, label, q, anchor."""
    good = {(i, x, tuple(q), a) for i, x, q, a in rows if i is not None and x is not None and q is not None and None not in q}
    out = []
    for a in good:
        if not a[3]:
            continue
        met = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a[2], r[2])))), r[0], r[1]) for r in good if r != a and len(r[2]) == len(a[2])]
        for s, p, _ in sorted(m for m in met if m[2] == a[1])[:positives]:
            hard = sorted(m for m in met if m[2] != a[1] and share[0] * -s <= 100 * -m[0] <= share[1] * -s)[:negatives]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(hard)]
    return sorted(out)


def data(n=260, dim=6, labels=4, wide=40, seed=2):
    r = np.random.default_rng(seed)
    return [(i, int(r.integers(labels)), [int(x) for x in r.integers(-wide, wide, dim)], i % 5 == 0) for i in range(n)]


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, q array<long>, a boolean, score string, block int")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("a"), **how).collect())


@pytest.mark.parametrize("size", [(16_384, 1_024, 64), (37, 11, 4)])
def test_matches_all_pairs(spark, monkeypatch, size):
    for name, x in zip(("ROWS", "ANCHORS", "STRIP"), size):
        monkeypatch.setattr(negatives, name, x)
    rows = data()
    want = brute(rows)
    assert len(want) > 300 and mined(spark, rows) == want


def test_odd_rows(spark):
    rows = data(90)
    rows += [rows[10], rows[10], (10, 2, [1, 2, 3, 4, 5, 6], True), (500, None, [1] * 6, True), (None, 1, [1] * 6, True), (501, 1, None, True), (502, 1, [1, None, 3, 4, 5, 6], True)]
    rows += [(600, 1, [], True), (601, 1, [], False), (602, 2, [], False), (603, 3, [7], True), (604, 3, [4], False), (605, 1, [3], False), (606, 1, [2], False)]
    rows += [(700 + i, i % 2, [9, 9, 9, 9, 9, 9], True) for i in range(12)]  # ties
    rows += [(800, 0, [-1, 0, 0, 0, 0, 0], True)]
    assert mined(spark, rows) == brute(rows)


def test_great_values(spark):
    for much in (2**20, 2**26, 2**40):
        rows = [(i, i % 2, [x * much for x in q], a) for i, _, q, a in data(40, dim=2)]
        want = brute(rows, share=(10, 100))
        assert want and mined(spark, rows, share=(10, 100)) == want


def test_other_numbers(spark):
    rows = data(60)
    assert mined(spark, rows, positives=2, negatives=7, share=(-40, 120)) == brute(rows, 2, 7, (-40, 120))


def test_bounds_hold_and_spare_scores():
    r = np.random.default_rng(0)
    v, a = (np.floor(256 * (x / np.linalg.norm(x, axis=1)[:, None])).astype(np.int64) for x in (r.normal(size=(3000, 64)), r.normal(size=(20, 64))))
    codes, low, high = negatives.cells(v)
    under, over = negatives.bounds(a, codes, low, high)
    exact = a @ v.T
    assert (under <= exact).all() and (exact <= over).all()
    third = np.partition(under, -3, axis=1)[:, -3]
    assert (over >= third[:, None]).mean() < 0.05


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1], False), (2, 2, [1], False)]) == []


def test_oracle(spark):
    assert same(queries.op12_hard_negatives(spark, "/root/testdata/sf0.001"), queries.OP12_SQL) > 0
