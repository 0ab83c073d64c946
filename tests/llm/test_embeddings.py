import math

import numpy as np
import pytest

from marktlens.llm import embeddings, queries
from tests.compare import same


def brute(rows, threshold=0.93):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, n[i], low.get(find(i)), low.get(find(i)) == d) for i, (d, _, _) in enumerate(rows)), key=str)


def data():
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    rows = [(i, [float(x) for x in np.float32(base[i % 12] + r.normal(size=8) * 0.25)], i % 3) for i in range(150)]
    rows += [(200 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(20)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (304, [float("inf")] + [1.0] * 7, 1), (305, [1.0] * 8, None), (306, [1.0] * 8, None), (307, [], 1), (308, [1.0] * 4, 1), (309, [2.0] * 4, 1), (310, [-0.0, 1.0], 2), (311, [0.0, 3.0], 2)]
    near = [1.0, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows += [(405, near, 7), (406, near[::-1], 7), (407, [1.0, 0.2] + near[2:], 7), (405, near[::-1], 8), (408, [0.0] * 7 + [1.0], 8), (405, near, 8), (405, near[::-1], 7)]  # one id in two labels
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_matches_all_pairs(spark, block):
    rows = data()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, size string")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_bound_holds():
    r = np.random.default_rng(1)
    a = r.normal(size=(300, 16))
    b = a[r.permutation(300)] + r.normal(size=(300, 16)) * 0.3
    x = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    got = {(int(i), int(j)) for p, q in embeddings.close_pairs(a, b, 0.9, step=64) for i, j in zip(p, q)}
    assert got == set(zip(*map(lambda z: z.tolist(), np.nonzero(x >= 0.9))))


def test_bound_holds_in_many_dimensions():
    a = np.sign(np.random.default_rng(2).normal(size=(6, 3000)))  # the greatest sums of products
    a[1] = a[0]
    a[1, :90] *= -1
    got = {(int(i), int(j)) for p, q in embeddings.close_pairs(a, a, 0.93) for i, j in zip(p, q)}
    assert got == {(0, 1), (1, 0), *((i, i) for i in range(6))}


def test_oracle(spark):
    assert same(queries.op2_embedding_near_dedup(spark, "/root/testdata/sf0.001"), queries.OP2_SQL) == 500


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).collect() == []
