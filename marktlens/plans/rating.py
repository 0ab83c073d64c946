"""Rating batches: what goes to the external scorer, when, and what becomes of its answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.operators.merge import complete_batches
from marktlens.operators.ranking import first_rows


def held_back(batches: DataFrame, as_of: str, least: int = 15, wait_minutes: int = 15) -> DataFrame:
    """Batches (task_id, first_seen, n) that may go: large enough, or old enough."""
    old = F.col("first_seen").cast("timestamp") <= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(wait_minutes))
    return batches.filter((F.col("n") >= least) | old)


def rate_batch(batch: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers of a scorer (task_id, contact_id, rate) to a batch; a task whose answers aren't complete and in range gets none."""
    answers = scorer(batch).select(F.col("task_id").alias("batch"), F.col("contact_id").alias("id"), "rate")
    asked = batch.select(F.col("task_id").alias("batch"), F.col("contact_id").alias("id"))
    good = complete_batches(answers, asked)
    return answers.join(good, "batch", "left_semi").select(F.col("batch").alias("task_id"), F.col("id").alias("contact_id"), "rate")


def city_batch(city_rating: DataFrame, tasks: int = 200, cities: int = 50) -> DataFrame:
    """Unrated cities of the first tasks that have any, by id, so many of each."""
    unrated = city_rating.filter("rate is null")
    some = unrated.select("task_id").distinct().orderBy("task_id").limit(tasks)
    return first_rows(unrated.join(some, "task_id", "left_semi"), ["task_id"], [F.col("city_id")], cities)


def dispatch(queue: DataFrame, capacity: dict[str, int], others: int = 0, pool: int = 10) -> DataFrame:
    """Of each task's best pairs, those that the catalogs' capacities let through (others: that of catalogs not named), the best of all
    tasks first. Each catalog's rows are cut down in sixty-four shares before one task orders what is left."""
    order = [F.col("rate").asc_nulls_last(), F.col("id")]
    heads = first_rows(queue, ["task_id"], order, pool).drop("rn")
    most = max([others, *capacity.values()])
    heads = first_rows(heads.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(64))), ["catalog", "_share"], order, most).drop("rn", "_share")
    room = F.lit(others)
    for catalog, n in capacity.items():
        room = F.when(F.col("catalog") == catalog, n).otherwise(room)
    return first_rows(heads, ["catalog"], order, most).filter(F.col("rn") <= room)
