"""SimHash near-dedup at a given similarity of word shingles.

Documents link when their sets of shingles have a Jaccard similarity of at least `percent` per cent. That is more bits apart than
a fingerprint of 64 bits can tell from chance (some 10 of 64 at 0.8, give or take 3), so that fingerprints are longer here: 256
bits, and `tables` segments as wide as the number of documents asks. The multi-index has a table for each segment; a lookup takes
the ball of radius zero, as many narrow segments find more per lookup than balls in few wide ones. Matches are verified on
256 bits, or all where buckets are large, and what is left on the whole sets. Two documents whose sets are
at an angle of t (cos t = 2s / (1 + s) at similarity s and equal sizes) differ in each bit with probability t / pi, and meet with
1 - (1 - (1 - t / pi)^width)^tables. There are as many tables as that takes for a stated recall at the similarity itself (0.98, and
more for pairs that are more similar): 53 of 16 bits for 10^5 documents, 539 of 30 for 10^9. A recall that would take over 2^15 tables is an error.

Equal sets are one class from the start. In a bucket of up to eight classes all pairs are compared on 256 bits, and those that are
close on their whole sets. A larger bucket gets the sets themselves: its classes that aren't connected yet are compared on them,
and it passes on a spanning forest of what is similar. So a large group of near copies gives fewer links than it has members in
each of its buckets, however many of its pairs are nearly similar enough, and no link between different components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.llm.common import checkpoint, components, map_rows, per_key, salted, small_batches, texts

#: LEAST: so many sets are compared with another one at once (memory alone follows it).
RECALL, SMALL, LEAST = 0.98, 8, 512
#: Where a bucket's key has the number of its table, above the bits of the segment.
SHIFT = 48
#: Bits of the complete distance, which a bucket's rows carry.
CODE = 256
PARTS = tuple(f"c{i}" for i in range(CODE // 64))
#: Rows of a table of two numbers that may be broadcast; larger ones are joined by a shuffle.
LIGHT = 200_000
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of all word shingles; A-Z are lower-cased, words end at ASCII white space. A shorter text is one
    shingle, a blank one none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), 42)] if w else [], np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(x), 42) for x in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1))


def fingerprint(found: np.ndarray, bits: int) -> bytes:
    """Majority bits of a set of hashes, each hash stretched to so many bits (a multiple of 64)."""
    salt = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(bits, np.int64)
    for i in range(0, len(found), 255):  # sums of so many bits fit into a byte
        h = (found[i : i + 255, None] ^ salt) * _ODD
        h ^= h >> np.uint64(31)
        h *= _ODD
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found)).tobytes()


def width(n: int) -> int:
    """Bits of a segment, such that a bucket holds about one of n classes by chance."""
    return min(SHIFT - 1, max(12, math.ceil(math.log2(max(2, n))) - 1))


def angle(percent: int) -> float:
    """The share of bits in which fingerprints of sets of this similarity, and of equal sizes, differ."""
    s = percent / 100
    return math.acos(min(1.0, 2 * s / (1 + s))) / math.pi


def tables_for(wide: int, percent: int, recall: float = RECALL) -> int:
    """Tables of so wide segments in which a pair of this similarity meets at least once with the given probability."""
    if not 0 < recall < 1:
        raise ValueError("recall must be between 0 and 1")
    meets = (1 - angle(percent)) ** wide
    n = 1 if meets == 1 else math.ceil(math.log(1 - recall) / math.log1p(-meets))
    if n >= 1 << (63 - SHIFT):
        raise ValueError(f"a recall of {recall} at {percent} % takes {n} tables of {wide} bits")
    return n


def most_bits(bits: int, percent: int, errors: float = 3.0) -> int:
    """Bits in which fingerprints of sets of this similarity differ at most, but for one pair in seven hundred (and fewer of those
    that are more similar)."""
    p = angle(percent)
    return math.ceil(p * bits + errors * math.sqrt(p * (1 - p) * bits))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """_d, _k, cls (hash of the set), n (its size) and fp (its fingerprint) of every row."""

    def work(batches):
        for b in batches:
            sets = [shingles(t, words) for t in b.column("_t").to_pylist()]
            yield {"_d": b.column("_d"), "_k": b.column("_k"), "cls": [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], "n": [len(s) for s in sets], "fp": [fingerprint(s, bits) for s in sets]}

    return map_rows(texts(docs), work, "_d long, _k long, cls long, n long, fp binary")


def _buckets(classes: DataFrame, tables: int, wide: int) -> DataFrame:
    """key (table and segment), cls and c0 to c3 (the first 256 bits) of each class, once for each table."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                bits = np.unpackbits(raw[:, CODE // 8 :], axis=1)[:, : tables * wide].reshape(b.num_rows, tables, wide)
                keys = bits @ (1 << np.arange(wide, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << SHIFT)
                code = np.ascontiguousarray(raw[:, : CODE // 8]).view(np.int64)
                yield {"key": keys.ravel(), **{c: np.repeat(code[:, i], tables) for i, c in enumerate(PARTS)}, "cls": np.repeat(b.column("cls").to_numpy(), tables)}

    return map_rows(classes.select("cls", "fp"), work, "key long, cls long" + "".join(f", {c} long" for c in PARTS))


def _whole_buckets(batches, *wanted: str):
    """The columns of whole buckets: rows come sorted by key, and the last bucket of a batch may go on."""
    left = None
    for batch in batches:
        if batch.num_rows:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in wanted}
            new = {c: np.concatenate((left[c], v)) for c, v in new.items()} if left else new
            last = int(np.searchsorted(new["key"], new["key"][-1]))
            left = {c: v[last:] for c, v in new.items()}
            if last:
                yield {c: v[:last] for c, v in new.items()}
    if left:
        yield left


def _edges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return starts, np.diff(np.append(starts, len(key)))


def _near(batches, most: int):
    """Close pairs (a, b) of small buckets, and a row (key, a) for each class of a large one."""
    for k in _whole_buckets(batches, "key", "cls", *PARTS):
        key, cls, parts = k["key"], k["cls"], [np.empty((2, 0), np.int64)]

        def close(i, j):
            return sum(np.bitwise_count(k[c][i].view(np.uint64) ^ k[c][j].view(np.uint64)).astype(np.int16) for c in PARTS) <= most

        _, sizes = _edges(key)
        few = np.repeat(sizes <= SMALL, sizes)
        for o in range(1, SMALL):
            i = np.flatnonzero((key[o:] == key[:-o]) & few[o:])
            i = i[close(i, i + o)]
            parts.append(np.stack((cls[i], cls[i + o])))
        a, b = np.concatenate(parts, axis=1)
        yield {"key": [None] * len(a), "a": np.minimum(a, b), "b": np.maximum(a, b)}
        yield {"key": key[~few], "a": cls[~few], "b": [None] * int((~few).sum())}


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places of sets that are similar: links that connect all that links between any two of them would connect, and no more than
    that takes. Sets are compared if nothing connects them yet."""
    size = np.array([len(s) for s in sets])
    kinds, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[flat] > 1  # what is in one set only is in no intersection
    edges = np.concatenate(([0], np.cumsum(shared)))[np.concatenate(([0], np.cumsum(size)))]
    flat = flat[shared]
    here, part, links = np.zeros(len(kinds), bool), np.arange(len(sets)), []
    for j in range(len(sets) - 1):
        here[flat[edges[j] : edges[j + 1]]] = True
        for lo in range(j + 1, len(sets), LEAST):
            i = lo + np.flatnonzero(part[lo : lo + LEAST] != part[j])
            i = i[100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])]
            n = edges[i + 1] - edges[i]
            ends = np.cumsum(n)
            if len(i) and ends[-1]:
                hits = np.concatenate(([0], np.cumsum(here[flat[np.repeat(edges[i] - ends + n, n) + np.arange(ends[-1])]])))
                both = hits[ends] - hits[ends - n]
                i = i[100 * both >= percent * (size[i] + size[j] - both)]
                old, first = np.unique(part[i], return_index=True)
                links += [(j, x) for x in i[first].tolist()]
                part[np.isin(part, old)] = part[j]
        here[flat[edges[j] : edges[j + 1]]] = False
    return links


def _within(batches, percent: int):
    """Links (a, b) that connect the similar classes of each bucket."""
    for k in _whole_buckets(batches, "key", "cls", "set"):
        found = [np.empty((0, 2), np.int64)]
        for s, n in zip(*(x.tolist() for x in _edges(k["key"]))):
            links = forest([np.frombuffer(x, np.uint64) for x in k["set"][s : s + n]], percent)
            found.append(k["cls"][s + np.array(links, np.int64).reshape(-1, 2)])
        a, b = np.concatenate(found).T
        yield {"a": a, "b": b}


def _sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """cls and set (its shingles' hashes) of the rows of reps (cls, rd, rk)."""

    def work(batches):
        for b in batches:
            yield {"cls": b.column("cls"), "set": [shingles(t, words).tobytes() for t in b.column("_t").to_pylist()]}

    if reps.count() <= LIGHT:  # three numbers each; texts need no shuffle then
        reps = F.broadcast(reps)
    rows = texts(docs).join(reps, F.expr("_d <=> rd and _k = rk")).select("cls", "_t")
    return map_rows(rows, work, "cls long, set binary").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar as sets. A class of many pairs is a skewed side of a join, which AQE splits."""

    def jaccard(batches):
        for b in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(c).to_pylist()] for c in ("x", "y"))
            near = np.array([similar(s, t, percent) for s, t in zip(x, y)], bool)
            yield {c: b.column(c).to_numpy()[near] for c in ("a", "b")}

    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    return map_rows(both.select("a", "b", "x", "y"), jaccard, "a long, b long")


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "cls")


def components_of(docs: DataFrame, classes: DataFrame, words: int, percent: int, tables: int, wide: int) -> DataFrame:
    """cls and root of the classes (cls, n, fp, rd, rk) that have links, by links that connect all those that are found and similar."""
    most = most_bits(CODE, percent)
    found = checkpoint(map_rows(_by_bucket(_buckets(classes.filter("n > 0"), tables, wide)), lambda batches: _near(batches, most), "key long, a long, b long"))
    pairs, held = found.filter("key is null").select("a", "b").distinct(), found.filter("key is not null").select("key", F.col("a").alias("cls"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(held.select("cls")).distinct()
    sets = checkpoint(_sets(docs, checkpoint(classes.select("cls", "rd", "rk").join(asked, "cls")), words)).hint("merge")  # not through the driver
    links = map_rows(_by_bucket(held.join(sets, "cls")), lambda batches: _within(batches, percent), "a long, b long")
    return components(_verified(pairs, sets, percent).union(links)).distinct().toDF("cls", "root")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """Per input row: doc_id, row_key, component_id (the smallest doc_id whose document is reachable by links, itself
    included).

    recall: the least probability with which a pair at `percent` is met. Null and blank texts have no shingles and are copies of each other. Rows with a null doc_id take part, but a component's id
    is the smallest doc_id that is not null (null if it has none). Repeated rows come back as often as they came. An empty
    table gives an empty result; only doc_id and text are read."""
    small_batches(docs.sparkSession)
    wide = width(docs.count())
    tables = tables_for(wide, percent, recall)
    bits = CODE + 64 * math.ceil(tables * wide / 64)
    rows = checkpoint(salted(_signatures(docs, words, bits), "_d", "_k"))
    classes = checkpoint(rows.groupBy("cls").agg(F.min("_d").alias("low"), F.min(F.struct("_k", "_d")).alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp")).select("cls", "n", "fp", "low", F.col("rep._d").alias("rd"), F.col("rep._k").alias("rk")))
    roots = components_of(docs, classes, words, percent, tables, wide)
    known = salted(classes.select("cls", "low").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "cls")
    least = per_key(known, ["root"], F.min("low").alias("component_id"))
    by_class = known.join(least, ["root", "_salt"]).select("cls", "component_id")
    spread = per_key(rows.select("cls", "_salt"), ["cls"]).join(by_class, "cls")
    return rows.select("_d", "_k", "cls", "_salt").join(spread, ["cls", "_salt"]).select(F.col("_d").alias("doc_id"), F.col("_k").alias("row_key"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their component; rows with a null doc_id stay only if their
    component has no other. Rows equal in doc_id and text stay or go together."""
    found = near_duplicates(docs, words, percent, recall)
    dropped = found.filter("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("_gone"), "row_key").distinct()
    return docs.withColumn("_k", F.xxhash64("text")).join(dropped, F.expr("doc_id <=> _gone and _k = row_key"), "left_anti").drop("_k")
