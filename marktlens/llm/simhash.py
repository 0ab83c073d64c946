"""SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits link when at most three bits differ. Each fingerprint is cut into two segments of 32 bits: of three
differing bits, at most one falls into one of them. Every distinct fingerprint is stored in a table under each of its
segments, and looked up there under every value of the small Hamming ball around that segment: the segment itself, and
the values with one more bit set (a pair that differs in a bit is found from the side that lacks it). Matches are verified
on all 64 bits. Equal fingerprints are one class from the start, and a bucket passes on a spanning forest of its links
instead of all its pairs, which leaves components as they are.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.llm.common import checkpoint, components, map_rows, per_key, salted, small_batches, texts

#: Stored fingerprints of a bucket that one task compares at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all word shingles; A-Z are lower-cased, words end at ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), seed)
    hashes = np.array([digest(b" ".join(x), seed) for x in zip(*(w[i:] for i in range(words)))], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """_d (doc_id), _k (row key), fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column("_t").to_pylist()], np.uint64)
            yield {"_d": b.column("_d"), "_k": b.column("_k"), "fp": fps.view(np.int64)}

    return map_rows(texts(docs), work, "_d long, _k long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs (a[i], b[j]) with at most `bits` differing bits."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= bits
        for x, y in zip(*np.nonzero(near)):
            u, v = int(a[i + x]), int(b[y])
            if u != v and (p := find(u)) != (q := find(v)):
                parent[p] = q
                links.append((u, v))
    return links


def _bucket_links(bits: int):
    """Rows come sorted by bucket, stored ones first; a bucket's stored rows stay in memory, looked-up ones pass by."""

    def work(batches):
        last, stored = None, np.empty(0, np.uint64)
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("seg", "key", "i", "j")]
            fp, probe = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), b.column("probe").to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(fp)]))
            first = tuple(int(c[0]) for c in cols)
            # single rows need no look, but for those that go on from, or into, another batch
            busy = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp)))
            links = []
            for g in busy:
                s, e = int(starts[g]), int(ends[g])
                bucket = first if s == 0 else tuple(int(c[s]) for c in cols)
                if bucket != last:
                    last, stored = bucket, np.empty(0, np.uint64)
                old, new, asked = stored, fp[s:e][probe[s:e] == 0], fp[s:e][probe[s:e] == 1]
                if len(new):
                    stored = np.concatenate((old, new))
                    links += _forest(new, stored, bits)
                if len(asked) and len(stored):
                    links += _forest(asked, stored, bits)
            if links:
                u = np.array(links, np.uint64).view(np.int64)
                yield {"a": u[:, 0], "b": u[:, 1]}

    return work


def links(distinct: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp that connect what lies within `bits` <= 3 bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of radius one cover at most three differing bits")
    half = F.array(F.expr("shiftrightunsigned(fp, 32)"), F.expr("fp & 4294967295L"))
    cut = distinct.select("fp", F.posexplode(half).alias("seg", "own"))
    stored = cut.select("seg", F.col("own").alias("key"), "fp", F.lit(0).alias("probe"))
    one_more = F.expr("filter(transform(sequence(0, 31), i -> own | shiftleft(1L, i)), k -> k != own)")
    asked = cut.select("seg", F.explode(one_more).alias("key"), "fp", F.lit(1).alias("probe"))
    heavy = checkpoint(stored.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    rows = stored.union(asked)
    zero = F.lit(0)
    if heavy.isEmpty():
        rows = rows.select("*", zero.alias("i"), zero.alias("j"))
    else:
        # block x of k meets every block: cells (min, max); a looked-up row meets each stored block alone
        k, own = F.ceil(F.coalesce("n", zero) / block).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.ceil(F.col("n") / block)).cast("int")
        rows = rows.join(heavy, ["seg", "key"], "left").select("seg", "key", "fp", "probe", k.alias("k"), own.alias("own"))
        rows = rows.withColumn("o", F.explode(F.when(F.col("k") > 0, F.sequence(zero, F.col("k") - 1)).otherwise(F.array(zero))))
        own, o = F.coalesce("own", zero), F.col("o")
        rows = rows.select("seg", "key", "fp", "probe", F.when(F.col("probe") == 1, o).otherwise(F.least(own, o)).alias("i"), F.when(F.col("probe") == 1, o).otherwise(F.greatest(own, o)).alias("j"))
    rows = rows.repartition("seg", "key", "i", "j").sortWithinPartitions("seg", "key", "i", "j", "probe")
    return map_rows(rows, _bucket_links(bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Per input row: doc_id, row_key, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id whose
    document is reachable by links, itself included).

    Null and blank texts have fingerprint zero and link like any other. Rows with a null doc_id take part, but a
    component's id is the smallest doc_id that is not null (null if it has none). Repeated rows come back as often as
    they came. An empty table gives an empty result; other columns are not read."""
    fps = checkpoint(salted(fingerprints(docs, words), "_d", "_k"))
    classes = checkpoint(fps.groupBy("fp").agg(F.min("_d").alias("low")))
    roots = components(links(classes.select("fp"), bits, block))
    known = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = salted(known, "fp")
    least = per_key(lowest, ["root"], F.min("low").alias("component_id"))
    by_class = lowest.join(least, ["root", "_salt"]).select("fp", "component_id")
    spread = per_key(fps, ["fp"]).join(by_class, "fp")
    return fps.join(spread, ["fp", "_salt"]).select(F.col("_d").alias("doc_id"), F.col("_k").alias("row_key"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their component; rows with a null doc_id stay only if their
    component has no other."""
    found = near_duplicates(docs, **options)
    dropped = found.filter("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("_gone"), "row_key").distinct()
    return docs.withColumn("_k", F.xxhash64("text")).join(dropped, F.expr("doc_id <=> _gone and _k = row_key"), "left_anti").drop("_k")
