"""Lists of websites: one entry for each page, under one name of its host, with the best scheme, home pages first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marktlens.functions.nested import stripped


def parsed(rows: DataFrame, url: str) -> DataFrame:
    """Adds the parts of a website, lower-cased: literal (the text, where it has no host), scheme (http, https or empty), host (without
    user and port), base_host (without www.), tail (path, query and fragment; / for a home page) and is_root. Blank and null ones go."""
    rows = rows.withColumn("_u", F.lower(stripped(F.col(url)))).filter("_u <> ''")
    scheme = F.regexp_extract("_u", "^(https?)://", 1)
    rows = rows.withColumn("scheme", scheme).withColumn("_u2", F.regexp_replace("_u", "^https?://", ""))
    rows = rows.withColumn("_who", F.regexp_extract("_u2", "^[^/?#]*", 0))
    rows = rows.withColumn("host", F.when(F.col("_who").rlike(r"[\[\]\s]"), "").otherwise(F.regexp_extract("_who", "^(?:.*@)?([^:]*)", 1)))
    rest = F.substring("_u2", F.length("_who") + 1, F.length("_u2"))
    rows = rows.withColumn("_rest", rest)
    path, query, fragment = F.regexp_extract("_rest", "^[^?#]*", 0), F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1), F.regexp_extract("_rest", "#(.*)$", 1)
    mark = lambda m, part: F.when(part != "", F.concat(F.lit(m), part)).otherwise("")
    tail = F.concat(path, mark("?", query), mark("#", fragment))
    rows = rows.withColumn("tail", F.when(tail.isin("", "/"), "/").otherwise(tail)).withColumn("is_root", F.col("tail") == "/")
    rows = rows.withColumn("literal", F.when(F.col("host") == "", F.col("_u"))).withColumn("base_host", F.regexp_replace("host", r"^www\.", ""))
    return rows.drop("_u", "_u2", "_who", "_rest")


def merge_websites(rows: DataFrame, key: str, url: str, order: str) -> DataFrame:
    """rows (key, url, order): key, place (from 1) and url of what is left.

    A site that is named with and without www. goes by its name with it. Entries of one host and tail are one, with the best scheme that any of
    them has (https, then http, then none), at the place of the first; a home page comes before the other pages of its host. Texts
    without a host stay as they are, once. Orders tell the rows of a key apart. Every entry is reduced before it is ordered, and none is
    gathered into a list."""
    made = parsed(rows.select(key, url, order), url)
    hosts = made.filter("literal is null").groupBy(key, "base_host").agg((F.bool_or(F.startswith("host", F.lit("www."))) & F.bool_or(~F.startswith("host", F.lit("www.")))).alias("_both"))
    hosts = hosts.withColumnsRenamed({key: "_key", "base_host": "_base"})
    made = made.join(hosts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("base_host") == F.col("_base")), "left").drop("_key", "_base")
    host = F.when(F.coalesce("_both", F.lit(False)), F.concat(F.lit("www."), "base_host")).otherwise(F.col("host"))
    made = made.withColumn("host", F.when(F.col("literal").isNull(), host).otherwise(F.concat(F.lit(" "), "literal")))  # no host has a blank
    entry = made.groupBy(key, "host", "tail", "is_root", "literal").agg(F.min(order).alias("_at"), F.max(F.length("scheme")).alias("_scheme"))
    first = F.min("_at").over(Window.partitionBy(key, "host"))
    entry = entry.withColumn("_first", F.when(F.col("is_root") & F.col("literal").isNull(), F.struct(first.alias("at"), F.lit(0).alias("root"))).otherwise(F.struct(F.col("_at").alias("at"), F.lit(1).alias("root"))))
    prefix = F.when(F.col("_scheme") == 5, "https://").when(F.col("_scheme") == 4, "http://").otherwise("")
    apart = F.when(F.left("tail", F.lit(1)).isin("/", "?", "#"), "").otherwise("/")
    text = F.coalesce("literal", F.concat(prefix, "host", apart, "tail"))
    lines = entry.select(key, text.alias("url"), "_first").groupBy(key, "url").agg(F.min("_first").alias("_first"))
    return lines.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_first")).alias("place"), "url")
