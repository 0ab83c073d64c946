"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

Codes are cut into segments; each distinct code is listed in a table under each of its segments. A query looks up all values
within a radius around each of its own segments, and the radius grows round by round: after radius r in all m segments, every
code within m * (r + 1) - 1 bits has been met, as a farther one alone could differ by more than r in each segment. A
query is done when its k-th best verified distance is within that bound. A code met through several segments counts at the
first. Queries and codes that are equal are searched once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marktlens.llm.common import checkpoint, per_key, salted

BITS = 64


def sign_codes(vectors: DataFrame) -> DataFrame:
    """vec_id and code of vectors: one bit for each of 64 components, set where it is above zero; in wider vectors, where the sum of
    the components at that place in each 64 is. Null components and those that are missing count as zero; null vectors have
    a null code."""
    value = f"aggregate(sequence(i, greatest(i, size(embedding) - 1), {BITS}), 0D, (s, k) -> s + coalesce(get(embedding, k), 0))"
    bits = F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (c, i) -> if({value} > 0, c | shiftleft(1L, i), c))")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("embedding").isNotNull(), bits).alias("code"))


def segments(n: int) -> int:
    """Segments whose length is about the binary logarithm of the number of codes, so that a bucket holds about one."""
    return max(2, min(8, round(BITS / max(1.0, math.log2(max(2, n))))))


def _cuts(m: int) -> list[tuple[int, int]]:
    """First bit and length of the segments."""
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(spark: SparkSession, m: int, radius: int) -> DataFrame:
    """seg and mask of all values at this distance, each bit of a segment being set or not; its size depends on m alone."""
    rows = [(s, sum(1 << (start + b) for b in bits)) for s, (start, length) in enumerate(_cuts(m)) for bits in itertools.combinations(range(length), radius)]
    return spark.createDataFrame([(s, x - (1 << BITS) if x >> (BITS - 1) else x) for s, x in rows], "seg int, mask long")


def _part(s: int, m: int) -> int:
    start, length = _cuts(m)[s]
    mask = ((1 << length) - 1) << start
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _distance(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))).cast("int")


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _best(rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("distance", "low")
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each row of queries (vec_id, code), the k rows of codes (vec_id, code) with the least Hamming distance, itself left
    out: query_id, rank (from 1), vec_id, distance. Ties go by vec_id; with fewer than k others there are fewer rows.

    Rows with a null id or code are neither found nor asked. Ids are taken to be distinct; rows with the same id and code
    count once, and an id with several codes is found by each. Empty tables give an empty result."""
    spark = codes.sparkSession
    want = k + 1  # a query may meet itself
    rows = salted(codes.filter("vec_id is not null and code is not null").select("vec_id", "code").distinct(), "vec_id")
    # of equal codes, only the k + 1 smallest ids can be among the best of anyone
    for by in (["code", "_salt"], ["code"]):
        w = Window.partitionBy(*by).orderBy("vec_id")
        rows = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= want)
    listed = checkpoint(rows.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("low")))
    n = listed.count()
    asked = checkpoint(salted(queries.filter("vec_id is not null and code is not null").select("vec_id", "code").distinct(), "vec_id"))
    if n == 0 or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    m = segments(n)
    parts = F.array(*[F.struct(F.lit(s).alias("seg"), F.col("code").bitwiseAND(F.lit(_part(s, m))).alias("key")) for s in range(m)])
    table = checkpoint(listed.select("code", "low", F.size("ids").alias("n_ids"), F.explode(parts).alias("p")).select("p.seg", "p.key", "code", "low", "n_ids"))
    open_queries = asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS))
    done, best = [], None
    for radius in range(BITS):
        masks = F.broadcast(_masks(spark, m, radius))
        probes = open_queries.select("q", "bound", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.col("q").bitwiseAND(F.lit(_part(s, m))).alias("own")) for s in range(m)])).alias("p"))
        # dealt out before the balls are enumerated, however few partitions the queries come in
        probes = probes.select("q", "bound", "p.seg", "p.own").repartition(_tasks(spark), "q", "seg").join(masks, "seg").withColumn("key", F.col("own").bitwiseXOR(F.col("mask")))
        # met before: an earlier segment at this radius or any segment within a smaller one
        apart = [F.bit_count(F.col("q").bitwiseXOR(F.col("code")).bitwiseAND(F.lit(_part(s, m)))) for s in range(m)]
        new = F.array_position(F.transform(F.array(*apart), lambda d: d <= radius), True) - 1 == F.col("t.seg")
        if radius:
            new = new & (F.array_min(F.array(*apart)) == radius)
        met = probes.alias("p").join(table.alias("t"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & new & (_distance("q", "code") <= F.col("bound")))
        met = met.select("q", "code", "low", "n_ids", _distance("q", "code").alias("distance"))
        if best is not None:
            met = met.unionByName(best.join(open_queries.select("q"), "q", "left_semi"))
        best = checkpoint(_best(met, want, ["q"]))
        # distance at which the ids of the codes met so far are k + 1
        upto = F.sum("n_ids").over(Window.partitionBy("q").orderBy("distance", "low"))
        reached = best.withColumn("_upto", upto).filter(F.col("_upto") >= want).groupBy("q").agg(F.min("distance").alias("reached"))
        covered = m * (radius + 1) - 1
        state = checkpoint(open_queries.select("q").join(reached, "q", "left"))
        finished = state.filter(F.col("reached") <= covered) if covered < BITS else state
        done.append(best.join(finished.select("q"), "q", "left_semi"))
        open_queries = state.join(finished.select("q"), "q", "left_anti").select("q", F.coalesce("reached", F.lit(BITS)).alias("bound"))
        if covered >= BITS or open_queries.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = found.select("q", "code", "distance").join(listed.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("low"))
    found = checkpoint(_best(found, want, ["q"]).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("low").alias("vec_id")))).alias("near")))
    spread = per_key(asked, ["code"]).join(found.withColumnRenamed("q", "code"), "code")
    out = asked.join(spread, ["code", "_salt"]).select(F.col("vec_id").alias("query_id"), F.slice(F.expr("filter(near, x -> x.vec_id <> vec_id)"), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.distance")
