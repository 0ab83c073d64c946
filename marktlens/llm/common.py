"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Salts over which the rows of one key spread at most; they are the bits of one long.
SALTS = 60
#: By stage and maker what this worker process keeps from task to task.
_KEPT: dict[int, dict] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder of spark.checkpoint.dir; one of its own only where none is set (tests)."""
    shared(df.sparkSession)
    return df.checkpoint()


def shared(spark: SparkSession) -> str:
    """The shared folder. A cluster has to name one; only a local master gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read as often as need be."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Bounds the bytes of the Arrow batches that carry whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has partitions, however small they are: for rows that stand for much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def kept(make: Callable, *args):
    """make(*args), which a worker keeps for its other tasks of the same stage: workers outlive stages, and what all of a pipeline's
    stages have learned together would not fit. Called within map_rows, whose tasks first drop what other stages left."""
    mine = _KEPT.setdefault(_stage(), {})
    if (key := (make, *args)) not in mine:
        mine[key] = make(*args)
    return mine[key]


def _stage() -> int:
    task = TaskContext.get()
    return -1 if task is None else task.stageId()


def _drop_others() -> None:
    now = _stage()
    for stage in [x for x in _KEPT if x != now]:
        del _KEPT[stage]


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function that yields a dict of columns (lists or numpy arrays) for each batch it makes."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others()
        for cols in work(batches):
            made = (cols[f.name] for f in fields)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(made, fields)], schema=fields)

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """Id, row key and text of each row. Rows are told apart by id and text: those equal in both count as one document,
    and null ids need no special care. A null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_k"), F.coalesce("text", F.lit("")).alias("_t"), *more)


def salted(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def per_key(df: DataFrame, keys: list[str], *aggs: Column, having: str | None = None) -> DataFrame:
    """Aggregates of the rows of each key, once for each `_salt` that these rows have. Rows join it on the key and
    `_salt`, so that a key with a third of all rows is dealt to many tasks; the aggregation itself combines before it shuffles."""
    found = df.groupBy(*keys).agg(*aggs, F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_salts"))
    if having:
        found = found.filter(having)
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("getbit", F.col("_salts"), i) == 1)
    return found.withColumn("_salt", F.explode(salts)).drop("_salts")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of the undirected edges (a, b), longs: node, root (the smallest node reachable).

    Alternating large-star and small-star steps; each round is one written table, and the work ends when a round
    changes no edge. Hubs are spread by salts. Null edges and loops are left out; nodes without edges have no row. Edges that
    still change after so many rounds (which grow with the logarithm of the edges) are an error."""

    def toward_least(e: DataFrame, both: bool) -> DataFrame:
        """Every edge of a node moves to the least of the node and its neighbours."""
        sides = e.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if both:
            sides = sides.union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        sides = salted(sides, "y")
        least = per_key(sides, ["x"], F.least(F.min("y"), F.min("x")).alias("m"))
        moved = sides.join(least, ["x", "_salt"])
        if both:  # large star: larger neighbours only
            moved = moved.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:  # small star: the node itself too
            moved = moved.select(F.explode(F.array("x", "y")).alias("u"), F.col("m").alias("v"))
        return moved.filter("u > v").distinct()

    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    for _ in range(rounds):
        new = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new.n == 0 or (new.n, new.h) == state:
            break
        state = (new.n, new.h)
        e = checkpoint(toward_least(toward_least(e, True), False))
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v"), F.col("v")).distinct())
