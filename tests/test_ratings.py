import pytest
from pyspark.sql import functions as F

from marktlens.operators import aggregates
from marktlens.plans import expansion


def tables(spark):
    """Cities that share codes, a code listed twice, codes and cities that are null, a code with two ids, rates of any sign."""
    rated = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, None), (1, 5, 2), (2, 3, 7), (2, 4, -1), (2, None, 1), (3, 9, 1), (4, 4, 0)], "task_id long, city_id long, rate int")
    held = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, None), (4, "d"), (None, "a"), (None, "z"), (5, "e"), (5, "f")], "city_id int, plz string")
    plz = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (6, None), (7, "e"), (8, "f")], "id long, plz string")
    branches = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, None), (2, 1, 5), (2, 2, -3), (4, 1, 1)], "task_id long, branch_id long, rate int")
    return rated, branches, held, plz


def plainly(rated, held):
    return rated.filter("rate is not null").join(held, "city_id").groupBy("task_id", "plz").agg(F.min("rate").alias("rate"))


def in_order(df):
    return sorted(map(tuple, df.collect()), key=repr)


def aggregated(df):
    """What the optimized plan groups by."""
    return [line.split("Aggregate ")[1].split("]")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate " in line]


def test_best_rates_are_found_by_set_of_cities(spark):
    rated, _, held, _ = tables(spark)
    df = aggregates.plz_best_rate(rated, held)
    assert in_order(df.select("task_id", "plz", "rate")) == in_order(plainly(rated, held).select("task_id", "plz", "rate"))
    assert not any("task_id" in by and "plz" in by for by in aggregated(df))


def test_rated_places_are_counted_by_set_of_cities(spark):
    rated, _, held, _ = tables(spark)
    df = aggregates.rated_places(rated, held)
    assert in_order(df) == in_order(plainly(rated, held).groupBy("task_id").agg(F.countDistinct("plz").alias("places")))
    assert not any("task_id" in by and "plz" in by for by in aggregated(df))


def pairs(spark):
    rated, branches, held, plz = tables(spark)
    places = plainly(rated, held).join(plz, "plz").select("task_id", F.col("id").alias("plz_id"), F.col("rate").alias("r"))
    return places.join(branches.filter("rate is not null"), "task_id").select("task_id", "plz_id", "branch_id", (F.col("r") * F.col("rate")).cast("long").alias("score"))


@pytest.mark.parametrize("keep", [1, 2, 3, 5, 8, 100])
def test_best_pairs_are_ranked_by_set_of_cities(spark, keep):
    df = expansion.expand_pairs(*tables(spark), keep)
    every = {}
    for r in sorted(pairs(spark).collect(), key=lambda r: (r.task_id, r.score, r.plz_id, r.branch_id)):
        every.setdefault(r.task_id, []).append(r)
    assert in_order(df.select("task_id", "plz_id", "branch_id", "score", "rn")) == sorted(((*r, n) for of in every.values() for n, r in enumerate(of[:keep], 1)), key=repr)
    assert not any("task_id" in by and "plz" in by for by in aggregated(df))


def test_all_pairs_are_counted_by_set_of_cities(spark):
    df = expansion.pair_figures(*tables(spark))
    assert in_order(df) == in_order(pairs(spark).groupBy("task_id").agg(F.count("*").alias("pairs"), F.min("score").alias("least")))
    assert not any("task_id" in by and "plz" in by for by in aggregated(df))


def test_pairs_are_not_shuffled(spark):
    plan = expansion.expand_pairs(*tables(spark))._jdf.queryExecution().executedPlan().toString().splitlines()
    places = next(i for i, line in enumerate(plan) if "BroadcastHashJoin [cities" in line)
    assert not [line for line in plan[:places] if "Exchange" in line]
