import itertools

import pytest
import xxhash
from pyspark.sql import functions as F

from marktlens.llm import simhash


def slow_fingerprint(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in b.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def brute(rows):
    """Component ids by flooding over all pairs."""
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


BASE = "the quick brown fox jumps over the lazy dog while seven green birds look at the river and sing of old times again " * 6
ROWS = [
    (7, BASE), (3, BASE), (9, BASE + "x"), (11, BASE.replace("seven", "eight", 1)), (12, BASE.upper()), (None, BASE), (None, "alone here"),
    (20, None), (21, ""), (22, " \t\n"), (23, "one"), (24, "one two"), (25, "one\x0btwo"), (26, "one two three"), (27, "café Été   x"), (7, BASE), (40, "a b c " * 30000),
]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs, **options).select("doc_id", "fingerprint", "component_id").collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("block", [4096, 2])
def test_matches_all_pairs(spark, block):
    near = [(100 + i, " ".join(f"w{(j * 7) % 50}" for j in range(200)) + " " + "z" * i) for i in range(12)]
    assert run(spark, ROWS + near, block=block) == brute(ROWS + near)


def test_links_at_up_to_three_bits(spark):
    values = [0, 0b111, 0b1111 << 31, 0b111 << 31, 1 << 63 | 3 << 30, 0b11111 << 40, 0b1111111 << 40, 0b11 << 60, 0b1011 << 60]
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = {frozenset(x % (1 << 64) for x in r) for r in simhash.links(distinct).collect()}
    want = {frozenset(p) for p in itertools.combinations(values, 2) if (p[0] ^ p[1]).bit_count() <= 3}
    assert got <= want

    def parts(links):
        groups = [{v} for v in values]
        for link in links:
            a, b = link
            ga, gb = (next(g for g in groups if x in g) for x in (a, b))
            if ga is not gb:
                groups.remove(gb)
                ga |= gb
        return {frozenset(g) for g in groups}

    assert parts(got) == parts(want)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert 3 in kept and not kept & {7, 9, 12, 21, 22} and 20 in kept and simhash.keep_one(docs).columns == ["doc_id", "text"]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()])


def test_copies_share_a_component(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(BASE).alias("text"))
    assert simhash.near_duplicates(docs).filter("component_id <> 0").count() == 0
