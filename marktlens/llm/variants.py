"""Spelling variants of a corpus's words by symmetric deletion.

Words are counted over all documents. Each word emits a key for itself and one for each distinct text that it is without one of its
code points; words that share a key are candidates, and those with an edit distance of exactly one are near. A word's form is its most
frequent near word if that is frequent enough, and following forms leads to a root.

Keys are hashes, so that long words don't multiply: a sum of mixed code points times powers of an odd number, of which prefix sums
give all deletions of a word at once. What collides is told apart by the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.llm.common import map_rows, written

#: Runs of letters that count as words before they are cut.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An odd multiplier and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Code points of words keyed at once.
POINTS = 1 << 20


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3, misspell: int = 97) -> DataFrame:
    """word and n: the distinct words of at least so many code points with at least so many occurrences.

    A run is lower-cased in A to Z alone. Where the crc32 of `doc_id:run` is a multiple of `misspell`, the code point at the crc32 modulo the
    run's length goes. Null texts have no words; a null doc_id counts as an empty one."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("_r"))
    runs = runs.select("_d", F.translate("_r", UPPER, LOWER).alias("_r")).withColumn("_h", F.crc32(F.concat("_d", F.lit(":"), "_r")))
    at = F.pmod(F.col("_h"), F.length("_r")).cast("int")
    cut = F.concat(F.substring("_r", F.lit(1), at), F.substring("_r", at + 2, F.length("_r")))
    made = runs.select(F.when(F.col("_h") % misspell == 0, cut).otherwise(F.col("_r")).alias("word")).filter(F.length("word") >= least_length)
    return made.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _mixed(points: np.ndarray) -> np.ndarray:
    x = points.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, key) of each text and of each distinct text with one code point less."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    at = np.arange(len(points)) - np.repeat(first, sizes)
    power = np.concatenate([np.ones(1, np.uint64), np.full(sizes.max(initial=1), BASE, np.uint64)]).cumprod()  # wraps around
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(points) * power[at])])  # over all texts; differences are a text's own
    start, end = upto[first][of], upto[first + sizes][of]
    without = (upto[:-1] - start) + (end - upto[1:]) * np.uint64(INVERSE)
    new = (at == 0) | (points != np.concatenate([points[:1], points[:-1]]))  # deletions within a run of one letter are the same
    return np.concatenate([np.arange(len(texts)), of[new]]), np.concatenate([upto[first + sizes] - upto[first], without[new]])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        texts, at = b["word"].to_pylist(), 0
        while at < len(texts):
            some, points = at, 0
            while some < len(texts) and (some == at or points + len(texts[some]) <= POINTS):
                points += len(texts[some])
                some += 1
            of, key = keys(texts[at:some])
            yield {"id": b["id"].to_numpy()[at:some][of], "key": key.view(np.int64)}
            at = some


def near_words(vocabulary: DataFrame) -> DataFrame:
    """a, b (ids) of each unordered pair of near words of a stored table (id, word), once."""
    emitted = written(map_rows(vocabulary.select("id", "word"), _emit, "id long, key long"), "keys")
    a, b = (emitted.select(F.col("id").alias(x), "key") for x in ("a", "b"))
    pairs = a.join(b, "key").filter("a < b").select("a", "b").distinct()
    texts = vocabulary.select("id", "word")
    pairs = pairs.join(texts.toDF("a", "_a"), "a").join(texts.toDF("b", "_b"), "b")
    return pairs.filter(F.levenshtein("_a", "_b", 1) == 1).select("a", "b")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """word and root, the last of the words reached by forms, for words that have a form. forms: word, form, without cycles. A round
    doubles the steps, and the work ends when none moves."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        up = at.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        moved = written(at.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return at
    raise RuntimeError(f"roots still move after {rounds} rounds")


def group(vocabulary: DataFrame, times: int = 2) -> DataFrame:
    """One row for each word of a vocabulary (word, n; distinct words): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of the largest n (ties: the
    smallest in code-point order) if its n is at least `times` the word's, which must be over 1 for forms to end; else null. The root of a
    word without a form is the word. Null words are left out, other columns aren't read; an empty table gives an empty result."""
    if times <= 1:
        raise ValueError("times must be over 1")
    held = vocabulary.filter("word is not null").select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n"))
    held = written(held, "words")  # ids are fixed from here on
    pairs = near_words(held)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("by")), F.struct(F.col("b").alias("id"), F.col("a").alias("by")))).alias("x")).select("x.*")
    named = both.join(held.select(F.col("id").alias("by"), F.col("word").alias("_w"), F.col("n").alias("_n")), "by")
    best = named.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), "_w")).alias("best"))
    rows = held.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best"))
    rows = written(rows.select("word", "n", "n_near", F.col("best._w").alias("form"), (-F.col("best.n")).alias("form_n")), "forms")
    found = roots(rows.filter("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """group over the words of all documents."""
    return group(words(docs))
