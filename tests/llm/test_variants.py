import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marktlens.llm import queries, variants
from tests.compare import SF, same


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(counts):
    form, out = {}, []
    for w, n in counts.items():
        close = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form[w] = (close[0][1], -close[0][0]) if close and -close[0][0] >= 2 * n else (None, None)
        out.append([w, n, len(close)])
    for row in out:
        root = row[0]
        while form[root][0] is not None:
            root = form[root][0]
        row[1:1] = [form[row[0]][0], root]
        row.append(form[row[0]][1])
    return sorted(map(tuple, out))


def counted(docs):
    got = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            got[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in got.items() if len(w) >= 5 and n >= 3}


def grouped(spark, counts):
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    return sorted(tuple(r) for r in variants.group(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed", range(3))
def test_group_matches_all_pairs(spark, seed):
    r = random.Random(seed)
    made = {"".join(r.choice("abß𝄞"[: 2 + seed]) for _ in range(r.randrange(8))): r.choice([1, 2, 3, 4, 7, 8, 15, 16, 40, 100, 1000]) for _ in range(150)}
    want = brute(made)
    assert sum(x[1] is not None for x in want) > 30 and grouped(spark, made) == want


def test_long_chains_and_long_words(spark):
    made = {"a" * k: 2**k for k in range(1, 40)}  # each leads to the next
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(60_000))
    made |= {long: 10, long[:777] + long[778:]: 5, long[:50_000] + "z" + long[50_001:]: 20, long[1:] + "b": 40}
    assert grouped(spark, made) == brute(made)


def test_keys_are_those_of_the_deletions():
    texts = ["", "a", "aa", "aab", "baaab", "äöäö", "abcabc"]
    of, key = variants.keys(texts)
    known = {}
    for i, k in zip(of, key):
        known.setdefault(int(i), []).append(int(k))
    alone = lambda t: int(variants.keys([t])[1][0])
    for i, t in enumerate(texts):
        assert sorted(known[i]) == sorted([alone(t), *map(alone, {t[:k] + t[k + 1 :] for k in range(len(t))})])


def test_colliding_keys_change_nothing(spark, monkeypatch):
    plain = variants.keys
    monkeypatch.setattr(variants, "keys", lambda texts: (lambda of, key: (of, key % np.uint64(5)))(*plain(texts)))
    made = {w: n for n, w in enumerate("haus hausn maus raus laus hauss hausss x y".split(), 3)}
    assert grouped(spark, made) == brute(made)


def test_words(spark):
    r = random.Random(4)
    words = ["Straße", "STRASSE", "garage", "Garagé", "été", "élèves", "×÷×÷×÷", "ÄÖÜäöüÿ", "abcde", "x", "naïve", "don't", "foo_bar1baz", "Łódź", "ÀÀÀÀÀÀ"]
    docs = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(120)] + [(None, "garage " * 300), (7, None), (8, ""), (9, "1 2 3"), (-5, "Straße" * 5_000), (3, "abcde-abcde"), (3, "abcde-abcde")]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, n int, word string")
    got = {x.word: x.n for x in variants.words(df).collect()}
    assert got == counted(docs) and any(len(w) == 5 and w == "garag"[:5] for w in got | {"garag": 1})


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(df).collect() == []
    with pytest.raises(ValueError):
        variants.group(df.select(F.col("text").alias("word"), F.lit(1).alias("n")), times=1)


def test_query(spark):
    assert same(queries.op11_spelling_variants(spark, SF), queries.OP11_SQL) > 1000
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = {r.word: r.n for r in queries.op11_spelling_variants(spark, SF).collect()}
    assert got == counted(docs)
