import itertools
import math

import numpy as np
import pytest

import corpus_pipeline as cp
from marktlens.llm import shingles

SF = "/root/testdata/sf0.001"


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_ids that stay: the smallest of each component of all pairs with a Jaccard similarity of 0.8 and more."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
            root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted(low.values())


def test_stage_matches_all_pairs_by_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in dict(cp.STAGES)["simhash_near_dedup"](spark, docs, SF).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) < len({r.text for r in docs.collect()})


def test_chains_blocks_and_blanks(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(8)]  # neighbours at 0.88, others below 0.8
    rows += [(100 + i, " ".join(words[:90] + [f"x{i}"] * 9)) for i in range(12)] + [(200 + i, " ".join(words[200:250] + [f"y{i}-{j}" for j in range(40)])) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "ONE  two"), (305, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == brute(rows)
    assert shingles.keep_one(docs.filter("false")).count() == 0


@pytest.mark.parametrize("least", [1, 512])
def test_large_group_of_near_copies(spark, monkeypatch, least):
    """Two hundred variants in large buckets, a chain among them, and texts that share a bucket but no component; with one closest class at
    first it takes rounds."""
    monkeypatch.setattr(shingles, "LEAST", least)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[:150] + [f"v{i}"])) for i in range(200)]
    rows += [(300 + i, " ".join(words[12 * i + 500 : 12 * i + 700])) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cls string").repartition(6)
    kept = shingles.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == brute(rows) and all(r.cls == "x" for r in kept)


def test_a_nearly_similar_group_sends_few_pairs(spark, monkeypatch):
    """Of 240 variants and a near copy of each, whose other pairs are mostly at 0.76, fewer pairs leave the buckets than classes are in them."""
    asked, verified = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, *args: asked.append(pairs.count()) or verified(pairs, *args))
    r, rows = np.random.default_rng(5), []
    for i in range(240):
        words = [f"w{k}" for k in range(150)]
        for k in r.choice(29, 2, replace=False):
            words[5 * int(k) + 4] = f"v{i}-{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t + " end") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in shingles.keep_one(docs).collect()}
    assert set(brute(rows)) <= kept <= set(range(240))
    assert sum(asked) <= 480 * shingles.SMALL


@pytest.mark.parametrize("least", [1, 3, 512])
def test_forest_connects_what_all_pairs_connect(monkeypatch, least):
    monkeypatch.setattr(shingles, "LEAST", least)
    r = np.random.default_rng(least)
    for n in (1, 2, 9, 30, 30, 30):
        base = r.integers(0, 1 << 63, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[r.random(60) < 0.94], r.integers(0, 1 << 63, r.integers(1, 8)).astype(np.uint64)))) for _ in range(n)]

        def parts(links):
            part = list(range(n))
            for i, j in links:
                part = [part[i] if x == part[j] else x for x in part]
            return {frozenset(k for k in range(n) if part[k] == x) for x in part}

        links = shingles.forest(sets, 80)
        assert parts(links) == parts([x for x in itertools.combinations(range(n), 2) if shingles.similar(sets[x[0]], sets[x[1]], 80)])
        assert len(links) == n - len(parts(links)) and all(shingles.similar(sets[i], sets[j], 80) for i, j in links)


def test_ties_nulls_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, long), (3, long + " end"), (None, long), (None, "alone with no id at all"), (8, None), (7, ""), (7, None), (9, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in shingles.keep_one(docs).collect()), key=str)
    assert kept == sorted([(3, long + " end"), (None, "alone with no id at all"), (7, ""), (7, None), (9, "x " * 200_000)], key=str)


def test_tables_keep_the_recall_at_any_size():
    for n in (200, 10**5, 10**6, 10**7, 10**9, 10**12):
        for percent in (70, 80, 90):
            wide = shingles.width(n)
            tables = shingles.tables_for(wide, percent)
            meets = (1 - shingles.angle(percent)) ** wide
            assert 1 - (1 - meets) ** tables >= shingles.RECALL > 1 - (1 - meets) ** (tables - 1)
    assert shingles.tables_for(16, 80) == 53 and shingles.tables_for(30, 80) == 539 and shingles.tables_for(12, 100) == 1
    with pytest.raises(ValueError, match="tables"):
        shingles.tables_for(47, 40)


def test_recall_measured_at_any_width():
    """Pairs of sets just at 0.8, by the segments that a corpus of a thousand, a hundred thousand and ten million documents has."""
    r = np.random.default_rng(3)
    pairs = []
    for _ in range(120):
        x = r.integers(0, 1 << 63, 400).astype(np.uint64)
        pairs.append((np.unique(x), np.unique(np.concatenate((x[:356], r.integers(0, 1 << 63, 44).astype(np.uint64))))))  # 356 / 444
    for n in (10**3, 10**5, 10**7):
        wide = shingles.width(n)
        tables = shingles.tables_for(wide, 80)
        bits = shingles.CODE + 64 * math.ceil(tables * wide / 64)
        met = 0
        for a, b in pairs:
            x, y = (np.unpackbits(np.frombuffer(shingles.fingerprint(v, bits), np.uint8))[shingles.CODE :][: tables * wide].reshape(tables, wide) for v in (a, b))
            met += bool((x == y).all(1).any())
        assert met >= 0.94 * len(pairs)


def test_fingerprints_are_as_far_apart_as_the_angle_says():
    r = np.random.default_rng(1)
    apart = []
    for _ in range(30):
        x = r.integers(0, 1 << 63, 1000).astype(np.uint64)
        y = np.concatenate((x[:889], r.integers(0, 1 << 63, 111).astype(np.uint64)))  # 0.8
        a, b = (np.frombuffer(shingles.fingerprint(np.unique(v), 1152), np.uint64) for v in (x, y))
        apart.append(int(np.bitwise_count(a ^ b).sum()))
    assert abs(np.mean(apart) / 1152 - math.acos(0.889) / math.pi) < 0.01 and max(apart) <= shingles.most_bits(1152, 80, 4.0)
    assert 50 < shingles.most_bits(shingles.CODE, 80) < 60
