"""Upserts and deletions as pure functions from tables to tables: callers overwrite or append what they get."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, source: DataFrame, keys: list[str], columns: list[str], as_of: str | None = None, only: str = "false") -> DataFrame:
    """`current` with new rows of `source` inserted and its changed ones updated. `action` is insert, update or keep; an
    updated row gets as_of in updated_at, if it has that column. Rows that `only` lets go and whose key `source` lacks are left out. Sources have
    one row for each key."""
    s = source.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_in"))
    rows = current.withColumn("_old", F.lit(True)).join(s, keys, "full_outer")
    rows = rows.filter(F.col("_in").isNotNull() | ~F.coalesce(F.expr(only), F.lit(False)))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_in") & differs, "update").otherwise("keep")
    rows = rows.withColumn("action", action)
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col("action") == "keep", F.col(c)).otherwise(F.col(f"_n_{c}")))
    if as_of and "updated_at" in current.columns:
        rows = rows.withColumn("updated_at", F.when(F.col("action") == "keep", F.col("updated_at")).otherwise(F.lit(as_of).cast("timestamp")))
    return rows.select(*current.columns, "action")


def reset_rates(rates: DataFrame, wanted: DataFrame, keys: list[str], forget: DataFrame | None = None) -> DataFrame:
    """Rates (keys, rate) with a row without a rate for each wanted key that has none; the rates of the keys in `forget` (all, if it is None)
    are null again."""
    hit = F.lit(True) if forget is None else F.coalesce("_hit", F.lit(False))
    rows = rates if forget is None else rates.join(forget.select(*forget.columns, F.lit(True).alias("_hit")).distinct(), forget.columns, "left")
    rows = rows.withColumn("rate", F.when(~hit, F.col("rate"))).select(*rates.columns)
    return insert_ignore(rows, wanted.select(*keys), keys)


def clamped(rows: DataFrame, key: str, column: str, low: int = 0, high: int = 120) -> DataFrame:
    """The rows whose value lies outside the bounds, with the nearest bound in its place."""
    return rows.withColumn("_new", F.least(F.lit(high), F.greatest(F.lit(low), F.col(column)))).filter(F.col("_new") != F.col(column)).select(key, F.col("_new").cast(rows.schema[column].dataType).alias(column))


def subset_answers(answer: DataFrame, given: DataFrame) -> DataFrame:
    """Answers (batch, id) of those batches that name nothing but what was given (batch, id); a batch with an id of its own loses all."""
    strange = answer.join(given.select("batch", "id"), ["batch", "id"], "left_anti").select("batch").distinct()
    return answer.join(strange, "batch", "left_anti")


def delete_missing(current: DataFrame, wanted: DataFrame, keys: list[str], only: str = "true") -> DataFrame:
    """`current` without the rows that `only` lets go and whose key `wanted` lacks."""
    held = wanted.select(*keys).distinct().withColumn("_held", F.lit(True))
    gone = F.coalesce(F.expr(only), F.lit(False)) & F.col("_held").isNull()
    return current.join(held, keys, "left").filter(~gone).drop("_held")


def insert_ignore(current: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """`current` and the rows of `source` with keys that it lacks; of several with one key, any one."""
    new = source.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(new, allowMissingColumns=True)


def stage_last(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of rows with equal keys, the one with the highest position."""
    w = Window.partitionBy(*keys).orderBy(F.col(position).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def update_changed(current: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of `values` whose key exists and whose columns differ from those held."""
    old = current.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return values.join(old, keys).filter(differs).select(*keys, *columns)


def set_where(df: DataFrame, column: str, value: Column, keys: DataFrame, on: list[str]) -> DataFrame:
    """`df` with a new value in the rows whose key is among `keys`."""
    hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, on, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(*df.columns)


def hard_bounce(log: DataFrame, contact: DataFrame, sending_list: DataFrame, bounced: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Letters that bounced for good (log ids in `id`): the log says so, the contact's address is wrong, and the contact goes
    from all lists."""
    hit = log.join(bounced.select("id").distinct(), "id", "left_semi").select("contact_id").distinct()
    return (
        set_where(log, "status", F.lit("BAD_ADDRESS"), bounced, ["id"]),
        set_where(contact, "wrong_email", F.lit(True), hit.select(F.col("contact_id").alias("id")), ["id"]),
        set_where(sending_list, "removed", F.lit(True), hit, ["contact_id"]),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys added, changed (other digest) or removed between two snapshots."""
    a, b = old.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_x")), new.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_y"))
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def complete_batches(answer: DataFrame, asked: DataFrame, low: int = 1, high: int = 100) -> DataFrame:
    """Batches whose answer (batch, id, rate) holds every asked id (batch, id) once, no other, and rates in range: all
    others are rejected as a whole."""
    ok = F.coalesce(F.col("rate").between(low, high), F.lit(False))
    a = answer.groupBy("batch").agg(F.bool_and(ok).alias("in_range"), F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))
    b = asked.groupBy("batch").agg(F.array_sort(F.collect_set("id")).alias("want"))
    return a.join(b, "batch").filter("in_range and n = size(ids) and ids = want").select("batch")


def lenient_batch(answer: DataFrame, asked: DataFrame, low: int = 1, high: int = 100) -> DataFrame:
    """Answers (pos, id, name, rate) to what was asked (id, name): the first valid one of each id with the asked name."""
    rows = answer.filter(F.coalesce(F.col("rate").between(low, high), F.lit(False))).join(asked.select("id", F.col("name").alias("_name")), "id").filter("name = _name").drop("_name")
    w = Window.partitionBy("id").orderBy("pos")
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def insert_unique(current: DataFrame, source: DataFrame, keys: list[list[str]], order: list[str], write: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The rows of `source` that get in, if they are inserted one after another and one that shares any of the keys with a row held or just
    inserted is passed over. order: columns that tell all rows apart. A null in a key conflicts with nothing.

    With one key that is the first row of each; with several it takes rounds: a row gets in that comes first by all of its keys among
    those left, and takes what it conflicts with out. `write` stores a round's rows (by its number) and returns them as read again; it
    is needed with several keys, where rounds end when no row is left."""
    left = source
    for key in keys:
        left = left.join(current.select(*key), key, "left_anti")
    if len(keys) == 1:
        return _first_of(left, keys[0], order)
    if write is None:
        raise ValueError("several keys need a place for the rounds' rows")
    made, left, n = None, write(left, 0), 0
    while not left.isEmpty():
        first = left
        for key in keys:
            first = first.join(_first_of(left, key, order).select(*order, F.lit(True).alias("_lead")), order, "left_semi")
        n += 2
        first = write(first, n - 1)
        made = first if made is None else made.unionByName(first)
        rest = left.join(first.select(*order), order, "left_anti")
        for key in keys:
            rest = rest.join(first.select(*key), key, "left_anti")
        left = write(rest, n)
    return left if made is None else made


def _first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null in it are each their own."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.filter(whole).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").unionByName(rows.filter(~whole))


def insert_counted(log: DataFrame, campaign: DataFrame, letters: DataFrame, write: Callable[[DataFrame, int], DataFrame] | None = None, keys: list[list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The letters (id, campaign_id, processed, ...) that get into the log, and the campaigns (id, sent_num) whose counters they
    raise, with their new numbers: each processed letter that gets in counts once. A letter that conflicts changes neither, so the same
    letters applied twice are inserted and counted once. Letters come in order of id; of several with one id any one counts."""
    new = insert_unique(log, letters.dropDuplicates(["id"]), keys or [["id"]], ["id"], write)
    raised = new.filter("processed").groupBy(F.col("campaign_id").alias("id")).agg(F.count("*").alias("_more"))
    counters = campaign.join(raised, "id").select("id", (F.coalesce("sent_num", F.lit(0)) + F.col("_more")).alias("sent_num"))
    return new, counters
