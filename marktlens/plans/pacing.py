"""Campaign pacing: whether a campaign sends now, how far apart its letters are, and how many it can send by its next day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktlens.functions import window_time as wt

AHEAD = 14


def pace(campaign: DataFrame, mailbox: DataFrame, now_local: str) -> DataFrame:
    """campaign: id, mailbox_id, user_active, archived, window (its effective one); mailbox: id, limit_hour, limit_day; now as
    local wall-clock time. Campaigns of a mailbox share its limits on each day on which they have a window.

    Returns campaign_id, active, interval_ms (of today, or of the next day with a window), to_send."""
    now = F.lit(now_local).cast("timestamp_ntz")
    year = int(now_local[:4])
    years = (year, year + 1)
    cur = F.hour(now) * 60 + F.minute(now)
    today = F.to_date(now)
    c = campaign.select(F.col("id").alias("campaign_id"), "mailbox_id", "user_active", (~F.coalesce("archived", F.lit(False))).alias("pool"), "window")
    days = c.filter("pool").withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(AHEAD)))).withColumn("day", F.date_add(today, F.col("ahead")))
    days = days.withColumn("slots", wt.spans(F.col("window"), wt.day_key(F.col("day"), years))).withColumn("minutes", wt.window_minutes(F.col("slots"))).filter("minutes > 0")
    shared = days.groupBy("mailbox_id", "ahead").agg(F.sum("minutes").alias("total"), F.count("*").alias("n"))
    m = mailbox.select(F.col("id").alias("mailbox_id"), "limit_hour", "limit_day")
    shared = shared.join(m, "mailbox_id").select("mailbox_id", "ahead", wt.shared_interval_ms(F.col("total"), F.col("n"), F.col("limit_hour"), F.col("limit_day")).alias("interval"))
    days = days.join(shared, ["mailbox_id", "ahead"], "left")
    day = F.struct("ahead", "minutes", "interval")
    per = days.groupBy("campaign_id").agg(
        F.min(day).alias("pick"),
        F.min(F.when(F.col("ahead") > 0, day)).alias("next"),
        F.max(F.when(F.col("ahead") == 0, F.col("interval"))).alias("interval_today"),
        F.max(F.when(F.col("ahead") == 0, wt.remaining(F.col("slots"), cur))).alias("rest"),
        F.bool_or((F.col("ahead") == 0) & wt.in_window(F.col("slots"), cur)).alias("inside"),
    )
    send_today = F.when((F.col("rest") > 0) & (F.col("interval_today") > 0), F.floor(F.col("rest") * 60000 / F.col("interval_today")))
    send_next = F.when(F.col("next.interval") > 0, F.floor(F.col("next.minutes") * 60000 / F.col("next.interval")))
    to_send = F.when(send_today.isNotNull() | send_next.isNotNull(), F.coalesce(send_today, F.lit(0)) + F.coalesce(send_next, F.lit(0))).cast("long")
    active = F.col("pool") & F.col("user_active") & F.coalesce("inside", F.lit(False))
    return c.join(per, "campaign_id", "left").select("campaign_id", active.alias("active"), F.col("pick.interval").alias("interval_ms"), to_send.alias("to_send"))


def timeline(planned: DataFrame, recent: DataFrame, base: str, interval_ms: int) -> DataFrame:
    """Up to three letters sent and the next ones planned, each with its time: planned ones follow base in equal steps."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("rn") - 1) * F.lit(max(1.0, interval_ms / 1000)))
    sent = recent.filter("rn <= 3").select("campaign_id", "contact_id", F.col("sent_at").cast("timestamp").alias("at"), F.lit("sent").alias("kind"), (-F.col("rn")).alias("place"))
    room = recent.filter("rn <= 3").groupBy("campaign_id").agg(F.count("*").alias("_sent"))
    plan = planned.join(room, "campaign_id", "left").filter(F.col("rn") <= 5 - F.coalesce("_sent", F.lit(0)))
    plan = plan.select("campaign_id", "contact_id", (F.lit(base).cast("timestamp") + step).alias("at"), F.when(F.col("rn") == 1, "current").otherwise("planned").alias("kind"), F.col("rn").alias("place"))
    return sent.unionByName(plan)


def draw_key(weight: Column, seed: int, *by: str) -> Column:
    """An exponential waiting time with the rate `weight`, by a hash of seed and columns: taken in ascending order, rows come as in a draw
    without replacement with these weights. Null for weights that aren't positive."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])), 1, 13), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((bits + 0.5) / F.lit(2.0**52)) / weight)


def picks(pending: DataFrame, seed: int, per: list[str] | None = None, keep: int | None = None) -> DataFrame:
    """Campaigns (mailbox_id, campaign_id, pending) in the order in which a mailbox takes them, each drawn with a probability in
    proportion to its pending contacts among those left: `place` from 1. Campaigns without pending contacts aren't drawn. The same seed
    gives the same order; ties go by campaign."""
    per = per or ["mailbox_id"]
    w = Window.partitionBy(*per).orderBy("_key", "campaign_id")
    drawn = pending.withColumn("_key", draw_key(F.col("pending"), seed, "campaign_id")).filter("_key is not null")
    drawn = drawn.withColumn("place", F.row_number().over(w)).drop("_key")
    return drawn if keep is None else drawn.filter(F.col("place") <= keep)


def open_times(campaign: DataFrame, now_local: str, ahead: int = AHEAD) -> DataFrame:
    """campaign_id, opens, from_ms and upto_ms of the stretches of time in which each campaign (campaign_id, window) sends, from now on: a
    running sum of milliseconds over its slots and days. Slots that overlap are open once. Days are worked out once for each distinct window."""
    now = F.lit(now_local).cast("timestamp_ntz")
    years = (int(now_local[:4]), int(now_local[:4]) + 1)
    windows = campaign.select(F.to_json("window").alias("_w"), "window").groupBy("_w").agg(F.first("window").alias("window"))
    days = windows.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(ahead)))).withColumn("day", F.date_add(F.to_date(now), F.col("ahead")))
    slots = days.select("_w", "day", F.inline(wt.spans(F.col("window"), wt.day_key(F.col("day"), years))))
    at = lambda m: F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col(m))
    slots = slots.select("_w", at("a").alias("opens"), at("b").alias("closes")).withColumn("opens", F.greatest("opens", now))
    before = Window.partitionBy("_w").orderBy("opens", "closes").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("opens", F.greatest("opens", F.max("closes").over(before))).filter("opens < closes")
    ms = F.unix_millis(F.col("closes").cast("timestamp")) - F.unix_millis(F.col("opens").cast("timestamp"))
    slots = slots.withColumn("_ms", ms).withColumn("upto_ms", F.sum("_ms").over(Window.partitionBy("_w").orderBy("opens")))
    slots = slots.select("_w", "opens", (F.col("upto_ms") - F.col("_ms")).alias("from_ms"), "upto_ms")
    return campaign.select("campaign_id", F.to_json("window").alias("_w")).join(slots, "_w").drop("_w")


def send_times(planned: DataFrame, campaign: DataFrame, now_local: str, ahead: int = AHEAD) -> DataFrame:
    """When each planned letter (campaign_id, contact_id, rn) goes out: the first as soon as its campaign (campaign_id, window, interval_ms) is
    open, each further one interval_ms of open time later. Letters that no window within so many days holds, and those of campaigns
    without an interval, have no time and no row. Letters and openings are put in one order; no letter meets all openings."""
    letters = planned.join(campaign.select("campaign_id", "interval_ms"), "campaign_id").filter("interval_ms > 0")
    letters = letters.select("campaign_id", ((F.col("rn") - 1) * F.col("interval_ms")).alias("at_ms"), F.lit(1).alias("kind"), "contact_id", "rn")
    opens = open_times(campaign, now_local, ahead).select("campaign_id", F.col("from_ms").alias("at_ms"), F.lit(0).alias("kind"), F.struct("opens", "from_ms", "upto_ms").alias("slot"))
    upto = Window.partitionBy("campaign_id").orderBy("at_ms", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = letters.unionByName(opens, allowMissingColumns=True).withColumn("slot", F.last("slot", ignorenulls=True).over(upto))
    rows = rows.filter("kind = 1 and slot is not null and at_ms < slot.upto_ms")
    return rows.select("campaign_id", "contact_id", "rn", (F.col("slot.opens") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("at_ms") - F.col("slot.from_ms")) / 1000)).alias("at"))
