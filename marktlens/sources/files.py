"""File sources and sinks: registers, coordinates, allowlists, tables replaced by key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marktlens.functions.text import comma_number, padded_plz


def municipal_register(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A register of fixed columns, converted to CSV: rows whose first column (the record type) is no number, headings among
    them, are dropped; the others keep their texts."""
    rows = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns))
    return rows.withColumn(columns[0], F.trim(columns[0]).try_cast("int")).filter(F.col(columns[0]).isNotNull())


def municipalities(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def plz_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Postal codes with latitude and longitude; rows without numbers are dropped, short codes get zeros in front."""
    rows = spark.read.csv(path, header=True).toDF("plz", "lat", "lon")
    rows = rows.select(padded_plz(F.trim("plz")).alias("plz"), comma_number(F.col("lat")).alias("lat"), comma_number(F.col("lon")).alias("lon"))
    return rows.filter("plz is not null and lat is not null and lon is not null")


def email_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case domains of a JSON list whose items are texts or objects with a domain."""
    text = spark.read.text(path, wholetext=True)
    items = F.explode(F.from_json("value", "array<string>"))
    item = text.select(items.alias("x"))
    domain = F.coalesce(F.get_json_object("x", "$.domain"), F.when(~F.startswith(F.trim("x"), F.lit("{")), F.col("x")))
    return item.select(F.lower(F.trim(domain)).alias("domain")).filter("domain <> ''").distinct()


def replace_by_key(rows: DataFrame, path: str, key: str, buckets: int = 64, keys: DataFrame | None = None) -> None:
    """Writes rows and replaces the earlier rows of their keys, and of those in `keys` (a column of the same name), for which there may be no
    rows; other keys keep theirs. Keys are dealt by hash to as many folders (the column `bucket`) as the table was made with, and only the
    folders of these keys are written anew, so that the number of files doesn't grow with that of the keys. A null key is one of its own."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = rows.withColumn("bucket", bucket)
    try:
        held = rows.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        gone = rows.select(F.col(key).alias("_gone"))
        gone = (gone if keys is None else gone.union(keys.select(key))).distinct()
        touched = gone.select(F.pmod(F.xxhash64("_gone"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
        kept = held.join(touched, "bucket", "left_semi").join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
        new = new.unionByName(kept.select(*new.columns))
        if keys is not None:  # folders that lose all their rows go, as a write leaves those alone for which it has no rows
            _drop(rows.sparkSession, [f"{path}/bucket={r.bucket}" for r in touched.join(new.select("bucket").distinct(), "bucket", "left_anti").collect()])
    spread = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]) % 8  # a hot key's rows go to some tasks
    new.repartition("bucket", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _drop(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)


def memo_join(rows: DataFrame, key: str, known: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """Rows with the results known for their key or computed for the keys that aren't; and the new results to append.
    compute: a function from a table of distinct keys to one of keys and results."""
    new = compute(rows.select(key).distinct().join(known.select(key), key, "left_anti"))
    return rows.join(known.unionByName(new), key, "left"), new
