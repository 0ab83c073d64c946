"""Several tables that change together.

A version is a folder with all its tables, and a ledger says which folders count. The row in the ledger is written last, in one
file, so that readers see all tables of a version or none; a reader keeps to the version that it began with.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "version long, folder string, tables array<string>"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The versions there are; of two writers that took one number, the one with the smaller folder name counts."""
    try:
        held = spark.read.schema(LEDGER).parquet(f"{root}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
    return held.groupBy("version").agg(F.min_by(F.struct("folder", "tables"), "folder").alias("v")).select("version", "v.*")


class Version:
    """The tables of one version; without a number, of the latest there is now."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        rows = ledger(spark, root)
        found = (rows.filter(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version"))).first()
        if found is None:
            raise LookupError(f"{root} has no version" + f" {version}" * (version is not None))
        self._spark, self._path = spark, f"{root}/{found.folder}"
        self.version, self.tables = found.version, list(found.tables)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"version {self.version} has no table {name}")
        return self._spark.read.parquet(f"{self._path}/{name}")


def reload(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> Version:
    """Writes the tables as the next version. If a table can't be written, the ledger and so all readers stay as they are; what was
    written of the others is never read. The tables may be read from the version before. A writer whose number another one
    took at the same time raises an error and may try again."""
    last = ledger(spark, root).agg(F.max("version")).first()[0]
    version, folder = (last or 0) + 1, uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{folder}/{name}")
    spark.createDataFrame([(version, folder, list(tables))], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    if ledger(spark, root).filter(F.col("version") == version).first().folder != folder:
        raise RuntimeError(f"another writer made version {version}")
    return Version(spark, root, version)
