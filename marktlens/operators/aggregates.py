"""Grouped figures of lists, campaigns, clicks and ratings. Counts are longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktlens.operators.filters import changed, is_false


def count_if(c: Column | str) -> Column:
    return F.count_if(F.expr(c) if isinstance(c, str) else c)


def list_stats(sending_list: DataFrame, task: DataFrame) -> DataFrame:
    """Per task with contacts on its list: all, rated, unrated, within the limit, above it."""
    t = task.select(F.col("id").alias("task_id"), "rate_limit")
    rows = sending_list.filter(is_false("removed")).join(t, "task_id")
    return rows.groupBy("task_id").agg(
        F.count("*").alias("total"), F.count("rate").alias("rated"), count_if("rate is null").alias("unrated"), count_if("rate <= rate_limit").alias("good"), count_if("rate > rate_limit").alias("bad")
    )


def list_status(sending_list: DataFrame, task: DataFrame) -> DataFrame:
    """list_stats with the worst rate, the rated percentage (rounded down) and whether rating goes on, rests or is done."""
    worst = sending_list.filter(is_false("removed")).groupBy("task_id").agg(F.max("rate").cast("long").alias("max_rate"))
    pct = F.when(F.col("total") > 0, F.floor(F.col("rated") * 100 / F.col("total"))).otherwise(0).cast("long")
    active = F.col("user_active") & ~F.col("archived")
    done = (F.col("total") > 0) & (F.col("unrated") == 0)
    state = F.when(done, "completed").when(active, "run").otherwise("paused")
    flags = task.select(F.col("id").alias("task_id"), "user_active", "archived")
    return list_stats(sending_list, task).join(worst, "task_id").join(flags, "task_id").select("task_id", "total", "rated", "unrated", "max_rate", pct.alias("percent"), state.alias("state"))


def sent_per_campaign(log: DataFrame) -> DataFrame:
    return log.filter("status = 'SEND'").groupBy("campaign_id").agg(F.count("*").alias("sent"))


def _clicks(click: DataFrame, log: DataFrame) -> DataFrame:
    return click.join(log.select(F.col("id").alias("letter_id"), "campaign_id", "contact_id"), "letter_id")


def unique_viewers(click: DataFrame, log: DataFrame) -> DataFrame:
    return _clicks(click, log).groupBy("campaign_id").agg(F.countDistinct("contact_id").alias("viewers"))


def site_clicks(click: DataFrame, log: DataFrame) -> DataFrame:
    """Per campaign and contact: last click and number of clicks."""
    return _clicks(click, log).groupBy("campaign_id", "contact_id").agg(F.max("time").alias("seen_at"), F.count("*").alias("clicks"))


def group_count(click: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of site_clicks, for paging."""
    return _clicks(click, log).select("campaign_id", "contact_id").distinct().agg(F.count("*").alias("n_groups"))


def totals(campaign: DataFrame, sending_list: DataFrame, log: DataFrame) -> DataFrame:
    """Per campaign: contacts on its list, letters sent, and what is left, never below zero."""
    per_list = sending_list.filter(is_false("removed")).groupBy("task_id").agg(F.count("*").alias("total"))
    c = campaign.select(F.col("id").alias("campaign_id"), F.col("sending_list_id").alias("task_id"))
    out = c.join(per_list, "task_id", "left").join(sent_per_campaign(log), "campaign_id", "left").fillna(0, ["total", "sent"])
    return out.select("campaign_id", "total", "sent", F.greatest(F.lit(0), F.col("total") - F.col("sent")).alias("left_over"))


def send_success(log: DataFrame) -> DataFrame:
    """Per campaign: letters, good ones and their share (0 where there are none)."""
    ok = F.upper(F.coalesce("status", F.lit(""))) == "SEND"
    rows = log.groupBy("campaign_id").agg(F.count("*").alias("total"), count_if(ok).alias("ok"))
    return rows.withColumn("share", F.when(F.col("total") > 0, F.col("ok") / F.col("total")).otherwise(F.lit(0.0)))


def parent_last_send(campaign: DataFrame, log: DataFrame) -> DataFrame:
    """Last processed letter of each contact in campaigns that others follow."""
    parents = campaign.filter("campaign_parent_id is not null").select(F.col("campaign_parent_id").alias("campaign_id")).distinct()
    sent = log.filter("processed and status = 'SEND'").join(parents, "campaign_id", "left_semi")
    return sent.groupBy("campaign_id", "contact_id").agg(F.max(F.coalesce("processed_at", "created_at")).alias("parent_sent_at"))


def sent_recount(campaign: DataFrame, log: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Processed letters of any status per campaign, 0 without; with stored figures (campaign_id, sent_num), changes only."""
    n = log.filter("processed").groupBy("campaign_id").agg(F.count("*").alias("sent_num"))
    out = campaign.select(F.col("id").alias("campaign_id")).join(n, "campaign_id", "left").fillna(0, ["sent_num"])
    if stored is None:
        return out
    old = stored.select("campaign_id", F.col("sent_num").alias("_old"))
    return out.join(old, "campaign_id", "left").filter(changed("_old", "sent_num")).drop("_old")


def code_sets(city_plz: DataFrame) -> DataFrame:
    """Each postal code (plz) with its cities, in order."""
    return city_plz.groupBy("plz").agg(F.array_sort(F.collect_set("city_id")).alias("cities"))


def set_rates(city_rating: DataFrame, sets: DataFrame) -> DataFrame:
    """Least rate of a task among the cities of each set (cities, n: its codes): codes in the same cities have the same rate with every
    task, so that a task has a row for each set and not for each code. task_id, cities, n, rate."""
    each = sets.withColumn("city_id", F.explode("cities"))
    return city_rating.filter("rate is not null").join(each, "city_id").groupBy("task_id", "cities").agg(F.max("n").alias("n"), F.min("rate").cast("long").alias("rate"))


def plz_best_rate(city_rating: DataFrame, city_plz: DataFrame) -> DataFrame:
    """Least rate of a task among the cities that share a postal code. Rates are found by set of cities; codes come last, so that
    rows of task and code are made but not shuffled."""
    codes = code_sets(city_plz)
    return set_rates(city_rating, codes.groupBy("cities").agg(F.count("*").alias("n"))).join(codes, "cities").select("task_id", "plz", "rate")


def rated_places(city_rating: DataFrame, city_plz: DataFrame) -> DataFrame:
    """Per task, postal codes that have a rate, from the number of codes of each set of cities."""
    sets = code_sets(city_plz).groupBy("cities").agg(F.count("plz").alias("n"))
    return set_rates(city_rating, sets).groupBy("task_id").agg(F.sum("n").alias("places"))


def fingerprint_text(rating: DataFrame, key: str) -> DataFrame:
    """A task's ratings as one text, id:rate in order of ids, null rates empty: what a state hash is taken of."""
    one = F.concat(F.col(key).cast("string"), F.lit(":"), F.coalesce(F.col("rate").cast("string"), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key), one.alias("t"))))
    return rating.groupBy("task_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "|").alias("fingerprint"))


def contacts_per_branch(pair: DataFrame, pair_contact: DataFrame, task_pair: DataFrame) -> DataFrame:
    """Per task and branch, contacts summed over its pairs; branches without any are left out."""
    n = pair_contact.groupBy("cb_id").agg(F.count("*").alias("n"))
    rows = task_pair.select("task_id", "cb_id").join(n, "cb_id").join(pair.select(F.col("id").alias("cb_id"), "branch_id"), "cb_id")
    return rows.groupBy("task_id", "branch_id").agg(F.sum("n").alias("contacts")).filter("contacts > 0")


def contacts_per_city(pair: DataFrame, pair_contact: DataFrame, plz: DataFrame, city_plz: DataFrame) -> DataFrame:
    """Contacts per city; a postal code counts for the city with the smallest id."""
    n = pair_contact.groupBy("cb_id").agg(F.count("*").alias("n"))
    per_plz = pair.select(F.col("id").alias("cb_id"), "plz_id").join(n, "cb_id").groupBy("plz_id").agg(F.sum("n").alias("n"))
    low = city_plz.groupBy("plz").agg(F.min("city_id").alias("city_id"))
    rows = per_plz.join(plz.select(F.col("id").alias("plz_id"), "plz"), "plz_id").join(low, "plz")
    return rows.groupBy("city_id").agg(F.sum("n").alias("contacts")).filter("contacts > 0")


def collapse_branches(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows (id, name, rate, n) whose names are equal but for case become one: the first one's rate, the sum of n, all ids
    in order. German sharp s folds to ss."""
    key = F.replace(F.lower(F.col(name)), F.lit("ß"), F.lit("ss"))
    at = F.struct(*order)
    one = rows.withColumn("_key", key).groupBy("_key").agg(F.min(F.struct(at.alias("o"), F.col("rate"))).alias("f"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(at.alias("o"), F.col("id")))).alias("i"))
    return one.select(F.col("_key").alias("title"), F.col("f.rate").alias("rate"), "n", F.transform("i", lambda x: x["id"]).alias("ids"))


def hash_mismatch(rating: DataFrame, wanted: DataFrame, most: int = 500) -> DataFrame:
    """Per task: rated rows, whether any was rated under another hash, and whether a new rating is worth offering."""
    rows = rating.join(wanted.select("task_id", F.col("hash").alias("_want")), "task_id")
    out = rows.groupBy("task_id").agg(count_if("rate is not null").alias("rated"), F.bool_or(F.col("rate").isNotNull() & changed("hash_task", "_want")).alias("mismatch"))
    return out.withColumn("offer", F.col("mismatch") & (F.col("rated") <= most))


def contact_flags(sending_list: DataFrame) -> DataFrame:
    removed = F.coalesce("removed", F.lit(False))
    return sending_list.groupBy("contact_id").agg(F.bool_or(removed).alias("any_removed"), F.bool_or(~removed).alias("any_listed"))


def contact_arrays(sending_list: DataFrame, task: DataFrame, log: DataFrame) -> DataFrame:
    """Per listed contact: titles of its tasks in order, and times of its letters, latest first."""
    t = sending_list.join(task.select(F.col("id").alias("task_id"), "title"), "task_id").groupBy("contact_id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    s = log.filter("status = 'SEND'").groupBy("contact_id").agg(F.sort_array(F.collect_set(F.coalesce("processed_at", "created_at")), asc=False).alias("sent_at"))
    none = F.array().cast("array<timestamp>")
    return t.join(s.withColumn("sent_at", F.col("sent_at").cast("array<timestamp>")), "contact_id", "left").withColumn("sent_at", F.coalesce("sent_at", none))


def last_n_quality(sending_list: DataFrame, task: DataFrame, n: int) -> DataFrame:
    """Of the last n rated contacts of each task: better than the limit (strictly), not so, all."""
    w = Window.partitionBy("task_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("contact_id").desc())
    last = sending_list.filter("rate is not null").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    last = last.join(task.select(F.col("id").alias("task_id"), "rate_limit"), "task_id")
    return last.groupBy("task_id").agg(count_if("rate < rate_limit").alias("good"), count_if("rate >= rate_limit").alias("bad"), F.count("*").alias("total"))


def geo_rollup(city: DataFrame) -> DataFrame:
    """Cities and population by state and in all, in one pass."""
    out = city.rollup("state_name").agg(F.count("*").alias("cities"), F.sum(F.col("pop_total").cast("long")).alias("population"), F.grouping("state_name").cast("long").alias("level"))
    return out.select("state_name", "cities", "population", "level")


def city_codes(city: DataFrame, city_plz: DataFrame) -> DataFrame:
    """Each city's codes in order, and the first of its attributes that isn't null."""
    rows = city.join(city_plz, city.id == city_plz.city_id, "left")
    return rows.groupBy("id").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("plz")).alias("plz_list"))


def max_deficit(campaign: DataFrame, good: DataFrame) -> DataFrame:
    """Per task the largest shortfall of its campaigns: need less what is left of the good contacts after those sent."""
    available = F.greatest(F.lit(0), F.coalesce("good", F.lit(0)) - F.col("sent_num"))
    rows = campaign.join(good, "task_id", "left")
    return rows.groupBy("task_id").agg(F.max(F.greatest(F.lit(0), F.col("to_send_num") - available)).alias("deficit"))


def rating_progress(rating: DataFrame) -> DataFrame:
    out = rating.groupBy("task_id").agg(count_if("rate is not null").alias("rated"), count_if("rate is null").alias("unrated"))
    return out.withColumn("percent", F.floor(F.col("rated") * 100 / (F.col("rated") + F.col("unrated"))).cast("long"))
