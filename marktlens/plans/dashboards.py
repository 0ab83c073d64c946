"""Figures as the overview, statistics and management pages show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.operators import aggregates, ranking
from marktlens.operators.filters import display_name, rate_section, search


def pending(campaign: DataFrame, task: DataFrame, sending_list: DataFrame, contact: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """Per campaign, contacts still to be written to, 0 without."""
    n = ranking.candidates(campaign, task, sending_list, contact, log, as_of).groupBy("campaign_id").agg(F.count("*").alias("pending"))
    return campaign.select(F.col("id").alias("campaign_id")).join(n, "campaign_id", "left").fillna(0, ["pending"])


def overview(campaign: DataFrame, task: DataFrame, sending_list: DataFrame, contact: DataFrame, log: DataFrame, click: DataFrame, as_of: str) -> DataFrame:
    """Per campaign: sent, viewers, share of sent ones that were viewed, pending."""
    out = pending(campaign, task, sending_list, contact, log, as_of)
    out = out.join(aggregates.sent_per_campaign(log), "campaign_id", "left").join(aggregates.unique_viewers(click, log), "campaign_id", "left")
    out = out.fillna(0, ["sent", "viewers"])
    share = F.when(F.col("sent") > 0, F.round(F.col("viewers") / F.col("sent"), 6)).otherwise(F.lit(0.0))
    return out.select("campaign_id", "sent", "viewers", share.alias("viewed_share"), "pending")


def sending_statistics(log: DataFrame, contact: DataFrame) -> DataFrame:
    """Every letter with its contact's display name and time."""
    c = contact.select(F.col("id").alias("contact_id"), display_name("company_name", "email").alias("name"))
    return log.join(c, "contact_id").select("id", "campaign_id", "contact_id", "name", "status", F.coalesce("processed_at", "created_at").alias("at"))


def contacts_page(sending_list: DataFrame, task: DataFrame, contact: DataFrame, log: DataFrame, q: str, only_removed: bool, number: int, size: int) -> DataFrame:
    """A page of contacts that match q, by id, with their flags, task titles and letters."""
    flags = aggregates.contact_flags(sending_list)
    rows = contact.filter(search(q, "company_name", "email")).join(flags, contact.id == flags.contact_id).drop("contact_id")
    if only_removed:
        rows = rows.filter("any_removed")
    shown = ranking.page(rows.select(F.col("id").alias("contact_id"), display_name("company_name", "email").alias("name"), "any_removed", "any_listed"), [F.col("contact_id")], number, size)
    return shown.join(aggregates.contact_arrays(sending_list, task, log), "contact_id", "left")


def mailing_page(sending_list: DataFrame, task: DataFrame, contact: DataFrame, task_id: int, section: str, q: str, number: int, size: int) -> DataFrame:
    """A page of one task's list: a section by rate, contacts that match q, in the page's order."""
    rows = sending_list.filter((F.col("task_id") == task_id) & ~F.coalesce("removed", F.lit(False)))
    rows = rows.join(task.select(F.col("id").alias("task_id"), "rate_limit"), "task_id").filter(rate_section(section))
    rows = rows.join(contact.filter(search(q, "company_name", "email")).select(F.col("id").alias("contact_id"), display_name("company_name").alias("name")), "contact_id")
    return ranking.page(rows.select("contact_id", "name", "rate", "rate_cb"), ranking.mailing_page_order(), number, size)
