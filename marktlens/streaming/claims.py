"""A queue of rows worked off in batches: each batch is claimed once, bad rows are set apart with the reason, good ones are folded into
a table of the latest state by key.

A batch writes its dead letters and its changes into folders of its own, and last its line in a ledger; readers see the batches of the
ledger. A batch that is cut off anywhere before that line is done anew by the same number over the same rows, and overwrites what it left; one
whose line is there already is not done again. So a killed driver or lost executors neither lose a row nor count one twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "batch long, good long, bad long"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """batch, good and bad (rows) of each batch that is done."""
    try:
        return spark.read.schema("good long, bad long, batch long").parquet(f"{root}/ledger").select("batch", "good", "bad")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _done(spark: SparkSession, root: str) -> int:
    """The number of the last batch done; -1 before the first."""
    last = ledger(spark, root).agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def _held(spark: SparkSession, root: str, table: str, upto: int) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}").filter(F.col("batch") <= upto)


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """The bad rows of all batches done, with `reason` and `batch`."""
    return _held(spark, root, "dead", _done(spark, root))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of the changes of each key those of its last batch."""
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_row")).select(key, "_row.*")


def state(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The table as the batches done have left it."""
    return latest(_held(spark, root, "changes", _done(spark, root)), key)


def work_off(rows: DataFrame, root: str, key: str, reason: Column, fold: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Works off what a stream of rows holds and ends. reason: why a row is bad, null for a good one. fold(held, good) gives the changed rows by
    `key` of a batch's good rows; held is the state of the keys before it (none before the first batch), of which it should
    read those that it needs. How many rows a batch claims is an option of the source."""

    def batch(claimed: DataFrame, number: int) -> None:
        spark = claimed.sparkSession
        if number <= _done(spark, root):
            return
        judged = claimed.withColumn("reason", reason).persist()
        try:
            good = judged.filter("reason is null").drop("reason")
            judged.filter("reason is not null").write.mode("overwrite").parquet(f"{root}/dead/batch={number}")
            before = latest(_held(spark, root, "changes", number - 1), key) if number else None
            fold(before, good).write.mode("overwrite").parquet(f"{root}/changes/batch={number}")
            _close(spark, root, number, judged.agg(F.count_if(F.col("reason").isNull()).alias("good"), F.count("reason").alias("bad")))
        finally:
            judged.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _close(spark: SparkSession, root: str, number: int, counts: DataFrame) -> None:
    counts.write.mode("overwrite").parquet(f"{root}/ledger/batch={number}")
