"""Joins of the audience model. Dimension sides carry no hint: AQE broadcasts those that turn out small."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_queue(task_pair: DataFrame, pair: DataFrame, plz: DataFrame, branch: DataFrame) -> DataFrame:
    """Pending pairs with their postal code, branch and catalog (a null flag is not pending here)."""
    p = pair.filter("collected = false").select(F.col("id").alias("cb_id"), "plz_id", "branch_id")
    return (
        task_pair.join(p, "cb_id")
        .join(plz.select(F.col("id").alias("plz_id"), "plz"), "plz_id")
        .join(branch.select(F.col("id").alias("branch_id"), "branch_name", "catalog"), "branch_id")
        .select("task_id", "id", "cb_id", "rate", "plz", "branch_name", "catalog")
    )


def pair_meta(pair: DataFrame, plz: DataFrame, branch: DataFrame, city_plz: DataFrame, city: DataFrame) -> DataFrame:
    """Postal code, branch and city of each pair; of several cities with the code, the one with the smallest id."""
    low = city_plz.groupBy("plz").agg(F.min("city_id").alias("city_id"))
    c = city.select(F.col("id").alias("city_id"), F.col("name").alias("city"), F.col("state_name").alias("land"))
    return (
        pair.select(F.col("id").alias("cb_id"), "plz_id", "branch_id")
        .join(plz.select(F.col("id").alias("plz_id"), "plz"), "plz_id")
        .join(branch.select(F.col("id").alias("branch_id"), F.col("branch_name").alias("branch"), "catalog"), "branch_id")
        .join(low, "plz", "left")
        .join(c, "city_id", "left")
        .select("cb_id", "plz", "branch", "catalog", "city", "land")
    )


def missing(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `current` whose key `wanted` doesn't have."""
    return current.join(wanted.select(*keys).distinct(), keys, "left_anti")


def fully_rated(ratings: DataFrame, task: str = "task_id") -> DataFrame:
    """Tasks that have ratings, none of them null."""
    return ratings.groupBy(task).agg(F.count("*").alias("n"), F.count("rate").alias("rated")).filter("n = rated").select(task)


def cell_width(places: DataFrame, widest: float = 720.0, halvings: int = 24) -> float:
    """The widest grid, halved again and again, whose cells hold two of the places at most, as a place meets it on average (the sum of
    squares of what cells hold over the sum): one job, of which the driver gets a number for each grid."""
    grid = places.select("lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(halvings))).alias("level"))
    cell = [F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("level")) / widest).alias(c) for c in ("lat", "lon")]
    held = grid.select("level", *cell).groupBy("level", "lat", "lon").agg(F.count("*").cast("double").alias("n"))
    met = held.groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("met")).filter("met <= 2")
    level = met.agg(F.min("level")).first()[0]
    return widest / 2 ** (halvings if level is None else level)


def nearest(points: DataFrame, places: DataFrame, cell: float | None = None) -> DataFrame:
    """For each point (id, lat, lon) the place (id, lat, lon) with the least squared distance in degrees; ties go to the
    smallest id. Points without coordinates have none, and places without aren't found.

    Grids of cells that double in width, from `cell` degrees (by default so wide that a place has its cell about to itself) to more
    than the globe's, tell how far a point has to look: if the 3 x 3 cells around it hold a place, the nearest one is less than three
    widths away, and so among the 3 x 3 cells of the grid four times as wide. Both joins are on cells; places are repeated, points aren't."""
    places = places.filter("lat is not null and lon is not null")
    cell = cell or cell_width(places)
    last = max(0, math.ceil(math.log2(720 / cell)))
    a = points.select(F.col("id").alias("point_id"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    b = places.select(F.col("id").alias("place_id"), "lat", "lon")

    def at(c: str) -> Column:
        return F.floor(F.col(c) / (F.lit(cell) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")

    def around(c: str) -> Column:
        return F.explode(F.sequence(at(c) - 1, at(c) + 1))

    levels = F.explode(F.sequence(F.lit(0), F.lit(last + 2))).alias("_level")
    near = b.select("*", levels).withColumn("_x", around("lat")).withColumn("_y", around("lon"))
    found = a.select("*", levels).withColumn("_x", at("_plat")).withColumn("_y", at("_plon")).join(near.select("_level", "_x", "_y").distinct(), ["_level", "_x", "_y"], "left_semi")
    first = found.groupBy("point_id", "_plat", "_plon").agg(F.least(F.min("_level") + 2, F.lit(last + 2)).alias("_level"))
    d2 = F.pow(F.col("lat") - F.col("_plat"), 2) + F.pow(F.col("lon") - F.col("_plon"), 2)
    pairs = first.withColumn("_x", at("_plat")).withColumn("_y", at("_plon")).join(near, ["_level", "_x", "_y"])
    return pairs.groupBy("point_id").agg(F.min(F.struct(d2.alias("d2"), "place_id")).alias("m")).select("point_id", "m.place_id", "m.d2")


def recent_mailboxes(log: DataFrame, campaign: DataFrame, as_of: str, days: int) -> DataFrame:
    """Mailboxes whose campaigns sent something in the last days before as_of."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    sent = log.filter(F.col("created_at") >= since).select("campaign_id").distinct()
    return campaign.join(sent, campaign.id == sent.campaign_id, "left_semi").select("mailbox_id").distinct()


def titles(branch: DataFrame, langs: DataFrame) -> DataFrame:
    """Branch titles by language as a map; the branch's own name stands under 'de' where that is missing."""
    pairs = langs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "title")))).alias("langs"))
    own = F.create_map(F.lit("de"), F.col("branch_name"))
    given = F.coalesce("langs", F.create_map().cast("map<string,string>"))
    return branch.join(pairs, "id", "left").select("id", F.when(F.map_contains_key(given, "de"), given).otherwise(F.map_concat(given, own)).alias("titles"))


def in_order_best(df: DataFrame, by: list[str], order: list, keep: int = 1) -> DataFrame:
    """The first rows of each group in an order; the rank is pushed below the shuffle by the optimizer."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


def surrogate_ids(staged: DataFrame, dimension: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The staged rows with the dimension's id, as `name`, in place of their natural keys; rows without a match go, as do those
    with a null in a key."""
    return staged.join(dimension.select(*keys, F.col("id").alias(name)), keys).drop(*keys)


def letters_of_campaigns(campaign: DataFrame, letter: DataFrame) -> DataFrame:
    """Each campaign with its letter (campaign_id, template, workspace_id, ...), if that belongs to its workspace too: one to one."""
    l = letter.select(F.col("campaign_id").alias("_c"), F.col("workspace_id").alias("_w"), "template")
    return campaign.join(l, (F.col("id") == F.col("_c")) & (F.col("workspace_id") == F.col("_w")), "left").drop("_c", "_w")


def system_sender(mailbox: DataFrame, smtp: DataFrame) -> DataFrame:
    """Of each workspace's mailboxes (id, workspace_id) that have an SMTP account (mailbox_id, host), the first by id."""
    rows = mailbox.join(smtp.select(F.col("mailbox_id").alias("id"), "host"), "id")
    return rows.groupBy("workspace_id").agg(F.min(F.struct("id", "host")).alias("m")).select("workspace_id", F.col("m.id").alias("mailbox_id"), "m.host")


def logins(user: DataFrame, token: DataFrame, asked: DataFrame, as_of: str) -> DataFrame:
    """asked (email) with the user (id, email) whose address it is in any case, and that user's latest token (user_id, token, expires_at, used)
    that is neither used nor expired."""
    key = lambda c: F.lower(F.trim(c))
    good = token.filter(~F.coalesce("used", F.lit(False)) & (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
    good = good.groupBy(F.col("user_id").alias("id")).agg(F.max_by("token", F.struct("expires_at", "token")).alias("token"))
    found = asked.select("email", key("email").alias("_k")).join(user.select("id", key("email").alias("_k")), "_k").join(good, "id")
    return found.select("email", F.col("id").alias("user_id"), "token")


def stale_letters(letter: DataFrame, rendered: Column) -> DataFrame:
    """Letters whose stored text isn't what their template gives now."""
    return letter.filter(~rendered.eqNullSafe(F.col("stored")))
