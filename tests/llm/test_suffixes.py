import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from marktlens.llm import queries, suffixes


def brute(rows, need=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + need] for b in raw for i in range(len(b) - need + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - need + 1):
            if seen[b[i : i + need]] > 1:
                gone[i : i + need] = True
        edges = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, lo int").repartition(5)
    return sorted((tuple(r) for r in suffixes.remove_repeats(docs, **options).drop("row_key", "removed", "kept").collect()), key=str)


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randint(40, 120)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(100, len(p))], text(r.randint(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(900, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (901, None), (902, ""), (903, "x" * 150), (904, "y" * 1000), (905, "z" * 200), (906, "ab" * 400), (907, "b" + "ab" * 300), (908, "\x00" * 230), (909, "\x00" * 199 + "a")]
    return rows


@pytest.mark.parametrize("options", [{}, {"batch": 3}, {"heavy": 2}, {"gram": 32}])
def test_matches_brute_force(spark, options):
    rows = corpus(str(options))
    assert run(spark, rows, **options) == brute(rows)


def test_other_length(spark):
    rows = corpus("other", 15)
    assert run(spark, rows, need=70, gram=20, batch=2) == brute(rows, 70)


def test_stretches_cover_each_start_once(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    r = random.Random(2)
    raw = bytes(r.randrange(3) for _ in range(3000)) + b"q" * 700
    lo, n, _ = suffixes.stretches(raw)
    assert sorted(i for a, k in zip(lo, n) for i in range(a, a + k)) == list(range(len(raw) - 199))


def test_equal_strings_have_equal_anchors():
    r = random.Random(4)
    body = bytes(r.randrange(256) for _ in range(260))
    found = []
    for head in (b"", bytes(300), b"abc" * 33):
        lo, n, anchor = suffixes.stretches(head + body + b"tail" * 60)
        by = {i - len(head): int(h) for a, k, h in zip(lo, n, anchor) for i in range(a, a + k)}
        found.append([by[i] for i in range(61)])
    assert found[0] == found[1] == found[2]


def test_levels_merge_geometrically():
    r = random.Random(5)
    texts = [bytes(r.randrange(2) for _ in range(60)) for _ in range(40)]
    family = suffixes.Levels(12)
    for i in range(0, 40, 4):
        family.add(texts[i : i + 4])
    assert [level["size"] for level in family.levels] == [8, 2]
    seen = Counter(t[i : i + 12] for t in texts for i in range(49))
    assert np.concatenate(family.repeated()).tolist() == [seen[t[i : i + 12]] > 1 for t in texts for i in range(49)]


def test_empty(spark):
    assert run(spark, []) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op5_suffix_array_dedup(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("heavy", [8, 4096])
def test_one_passage_in_many_contexts(spark, heavy):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(90))[:300]
    rows = [(i, " ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(30))) for i in range(250)]
    assert run(spark, rows, heavy=heavy) == brute(rows)
