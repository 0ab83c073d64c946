"""Titles that no two campaigns of a workspace share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marktlens.functions.nested import stripped

#: A title's number at its end.
NUMBER = r"(?U)\s*-\s*#\d+\s*$"


def unique_titles(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new (workspace_id, id, title) with `unique_title`; taken: workspace_id, title.

    A title that is free stays; one that is taken loses the number at its end, if it has one and is free without it, and else gets the first
    free number from 2 on. Of several new rows that ask for one title the one with the smallest id gets it. In a batch all titles that can stay are given
    first, then those without their number, then the numbers: the same as if rows were taken one after another in that order. A blank or
    null title gives an empty one."""
    rows = new.select("workspace_id", "id", F.coalesce(stripped(F.col("title")), F.lit("")).alias("_t"))
    base = stripped(F.regexp_replace("_t", NUMBER, ""))
    rows = rows.withColumn("_base", F.when(base == "", F.col("_t")).otherwise(base))
    held = taken.select("workspace_id", stripped(F.col("title")).alias("_t")).distinct()
    asked = rows.filter("_t <> ''")

    def first(of: DataFrame, by: str) -> DataFrame:
        """The rows that come first for a title among those whose title isn't held."""
        w = Window.partitionBy("workspace_id", by).orderBy("id")
        return of.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    stay = first(asked.join(held, ["workspace_id", "_t"], "left_anti"), "_t").withColumn("unique_title", F.col("_t"))
    rest = asked.join(stay.select("workspace_id", "id"), ["workspace_id", "id"], "left_anti")
    held = held.unionByName(stay.select("workspace_id", "_t"))
    bare = first(rest.join(held.withColumnRenamed("_t", "_base"), ["workspace_id", "_base"], "left_anti"), "_base").withColumn("unique_title", F.col("_base"))
    rest = rest.join(bare.select("workspace_id", "id"), ["workspace_id", "id"], "left_anti")
    held = held.unionByName(bare.select("workspace_id", F.col("_base").alias("_t")))
    # numbers in use, each with how many free ones lie before it; the i-th row passes over those with fewer than i
    used = held.select("workspace_id", F.regexp_extract("_t", r"(?s)^(.*) - #([1-9][0-9]*)$", 1).alias("_base"), F.regexp_extract("_t", r"(?s)^(.*) - #([1-9][0-9]*)$", 2).try_cast("long").alias("_k")).filter("_k >= 2").distinct()
    place = Window.partitionBy("workspace_id", "_base")
    used = used.withColumn("_at", F.col("_k") - 1 - F.row_number().over(place.orderBy("_k"))).select("workspace_id", "_base", "_at", F.lit(1).alias("_used"))
    rest = rest.withColumn("_at", F.row_number().over(place.orderBy("id")).cast("long")).withColumn("_used", F.lit(0))
    both = rest.unionByName(used, allowMissingColumns=True)
    passed = F.sum("_used").over(place.orderBy("_at", "_used").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = both.withColumn("_n", F.col("_at") + 1 + passed).filter("_used = 0").withColumn("unique_title", F.concat("_base", F.lit(" - #"), F.col("_n").cast("string")))
    out = ["workspace_id", "id", "unique_title"]
    return stay.select(*out).unionByName(bare.select(*out)).unionByName(numbered.select(*out)).unionByName(rows.filter("_t = ''").select("workspace_id", "id", F.lit("").alias("unique_title")))
