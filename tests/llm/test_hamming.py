import random

import pytest

from marktlens.llm import hamming, queries
from tests.compare import same


def brute(codes, asked, k):
    out = []
    codes = {(i, c) for i, c in codes if i is not None and c is not None}
    for q, c in {(i, c) for i, c in asked if i is not None and c is not None}:
        near = sorted(((c ^ d) % (1 << 64)).bit_count() * (1 << 40) + i for i, d in codes if i != q)[:k]
        out += [(q, n + 1, x % (1 << 40), x >> 40) for n, x in enumerate(near)]
    return sorted(out)


def run(spark, codes, asked, k):
    a, b = (spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, code long, seg string") for rows in (codes, asked))
    return sorted(tuple(r) for r in hamming.top_k(a, b, k).collect())


@pytest.mark.parametrize("kind", ["random", "clustered", "few"])
def test_matches_all_pairs(spark, kind):
    r = random.Random(kind)
    centre = [r.getrandbits(64) for _ in range(4)]
    codes = []
    for i in range(3 if kind == "few" else 250):
        c = r.getrandbits(64) if kind != "clustered" else r.choice(centre) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5)))
        codes.append((i, c - (1 << 64) if c >> 63 else c))
    codes += [(1000 + i, codes[0][1]) for i in range(30)] + [(None, 5), (2000, None), (1000, codes[0][1])]
    asked = codes[::9] + [(5000, 77), (None, 1), (5001, None)]
    assert run(spark, codes, asked, 4) == brute(codes, asked, 4)


def test_oracle(spark):
    assert same(queries.op6_topk_search(spark, "/root/testdata/sf0.001"), queries.OP6_SQL) == 250


def test_empty(spark):
    assert run(spark, [], [(1, 2)], 3) == [] and run(spark, [(1, 2)], [], 3) == []


def test_codes_of_other_widths(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(n)]) for i, n in enumerate((0, 3, 63, 64, 65, 130, 128))] + [(9, None), (10, [None, 1.0])]
    got = {x.vec_id: x.code for x in hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, v in rows:
        want = None if v is None else sum(1 << b for b in range(64) if sum(x or 0 for x in v[b::64]) > 0)
        assert (got[i] if got[i] is None else got[i] % (1 << 64)) == want


def test_ties_across_the_last_place(spark):
    codes = [(i, 0) for i in range(2)] + [(100 - i, 0b111) for i in range(8)] + [(50 + i, 0b111 << 20) for i in range(4)]
    asked = [(0, 0), (999, 0b1)]
    assert run(spark, codes, asked, 5) == brute(codes, asked, 5)
