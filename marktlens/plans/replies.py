"""Replies and returned mail: which mails are new, whose letters they answer, what they say, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.functions import text
from marktlens.operators import merge

REPLIES = ("ANGRY_CONTACT", "AUTO_RESPONSE", "ANSWER")


def fresh(mails: DataFrame, done: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Mails (mailbox_id, folder, uid) that weren't worked off (done: the same, at) within so many days before as_of; the case of
    folder names doesn't count."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    known = done.filter(F.col("at") > since).select("mailbox_id", F.lower("folder").alias("_folder"), "uid").distinct()
    return mails.withColumn("_folder", F.lower("folder")).join(known, ["mailbox_id", "_folder", "uid"], "left_anti").drop("_folder")


def sort_out(mails: DataFrame, log: DataFrame, app: str, judge: Callable[[DataFrame], DataFrame], as_of: str) -> DataFrame:
    """Mails as `read_mails` gives them, with letter_id, contact_id, kind, status text and the time of the mail (as_of without one).

    A mail is ours if it names the application and a letter, and known if `log` (id, contact_id) has that letter. `judge`
    adds two answers, `angry` and `automatic`, to rows with `asked`: the text of a plain reply, null where there is nothing to
    judge."""
    mail = F.col("mail")
    said = F.coalesce(F.nullif(text.html_text(F.col("html")), F.lit("")), F.nullif(F.regexp_replace("plain", r"(?U)^\s+|\s+$", ""), F.lit("")))
    # what a mail says is taken from it before the join, which needs no mail; foreign mails have keys that no letter has, each its own
    rows = mails.select("mailbox_id", "folder", "uid", text.letter_id(mail, app).alias("letter_id"), text.bounce_kind(mail, F.col("has_report")).alias("bounce"), said.alias("said"), "headers", "html", "plain", "sent_at")
    rows = rows.withColumn("_key", F.coalesce("letter_id", -1 - F.pmod(F.xxhash64("mailbox_id", "folder", "uid"), F.lit(1 << 40))))
    known = log.select(F.col("id").alias("_key"), "contact_id", F.lit(True).alias("_known"))
    rows = rows.join(known, "_key", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    rows = judge(rows.withColumn("bounce", F.when(F.col("_known"), F.col("bounce"))).withColumn("asked", F.when(F.col("_known") & F.col("bounce").isNull(), F.col("said"))))
    angry, automatic = (F.coalesce(text.yes_no(F.col(c)), F.lit(False)) for c in ("angry", "automatic"))
    kind = text.reply_kind(F.col("letter_id").isNotNull(), F.col("_known"), F.col("bounce"), angry, automatic)
    at = F.coalesce("sent_at", F.lit(as_of).cast("timestamp"))
    return rows.select("mailbox_id", "folder", "uid", "letter_id", "contact_id", kind.alias("kind"), "asked", "headers", "html", "plain", at.alias("sent_at"))


def reply_log(found: DataFrame) -> DataFrame:
    """The rows that the log of replies gets."""
    return found.filter(F.col("kind").isin(*REPLIES)).select("letter_id", F.col("kind").alias("status"), "headers", "html", F.col("asked").alias("text"), "plain", "sent_at")


def effects(found: DataFrame, log: DataFrame, contact: DataFrame, sending_list: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log, contacts and lists after mail that came back for good."""
    return merge.hard_bounce(log, contact, sending_list, found.filter("kind = 'HARD'").select(F.col("letter_id").alias("id")))


def counters(found: DataFrame) -> DataFrame:
    """Per mailbox: mails seen, ours among them, returned ones, and those that block a contact."""
    ours = ~F.col("kind").isin("FOREIGN", "UNKNOWN")
    blocked = (F.col("kind") == "HARD") & F.col("contact_id").isNotNull()
    return found.groupBy("mailbox_id").agg(F.count("*").alias("seen"), F.count_if(ours).alias("ours"), F.count_if(F.col("kind").isin("HARD", "SOFT")).alias("returned"), F.count_if(blocked).alias("blocked"))
