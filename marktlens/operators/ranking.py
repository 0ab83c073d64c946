"""Best rows of groups, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktlens.operators.filters import eligible, is_false

MOST = 1000  # contacts of a pair in one list


def first_rows(df: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first rows of each group, numbered from 1 in rn; the limit reaches below the shuffle (WindowGroupLimit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rn") <= keep)


def send_order() -> list[Column]:
    return [F.col("rate").asc_nulls_last(), F.col("rate_cb").asc_nulls_last(), F.col("contact_id").asc()]


def mailing_page_order() -> list[Column]:
    """As the mailing page lists contacts: among equal rates, the worse pair first."""
    return [F.col("rate").asc_nulls_last(), F.col("rate_cb").desc_nulls_last(), F.col("contact_id").asc()]


def candidates(campaign: DataFrame, task: DataFrame, sending_list: DataFrame, contact: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """Contacts that each campaign may still write to: eligible, not written to, and for a follow-up campaign, written to by
    the campaign before it at least so many days ago. One row for each contact, without regard to the order."""
    from marktlens.operators.aggregates import parent_last_send

    c = campaign.select(F.col("id").alias("campaign_id"), F.col("sending_list_id").alias("task_id"), "campaign_parent_id", F.coalesce("send_after_parent_days", F.lit(0)).alias("days"))
    rows = (
        sending_list.filter(is_false("removed") & F.col("rate").isNotNull())
        .join(task.select(F.col("id").alias("task_id"), "rate_limit"), "task_id")
        .filter("rate <= rate_limit")
        .join(contact.select(F.col("id").alias("contact_id"), "email", "company_name", "blocked", "wrong_email"), "contact_id")
        .filter(eligible())
        .join(c, "task_id")
    )
    sent = parent_last_send(campaign, log).withColumnRenamed("campaign_id", "campaign_parent_id")
    due = F.col("parent_sent_at") <= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.col("days"))
    rows = rows.join(sent, ["campaign_parent_id", "contact_id"], "left").filter(F.col("campaign_parent_id").isNull() | due)
    written = log.select("campaign_id", "contact_id").distinct()
    return rows.join(written, ["campaign_id", "contact_id"], "left_anti")


def planned(found: DataFrame, keep: int = 8) -> DataFrame:
    return first_rows(found, ["campaign_id"], send_order(), keep)


def recent_sends(log: DataFrame, keep: int = 3) -> DataFrame:
    at = F.coalesce("processed_at", "created_at")
    return first_rows(log.withColumn("sent_at", at), ["campaign_id"], [F.col("sent_at").desc_nulls_last(), F.col("id").desc(), F.col("contact_id")], keep)


def best_pair(task_pair: DataFrame, pair_contact: DataFrame) -> DataFrame:
    """For each task and contact, the pair with the least rate (nulls last), then the smallest id. Pairs go to their tasks with lists of their
    contacts, which become rows there, so that rows of task and contact are made but not shuffled."""
    lists = pair_contact.groupBy("cb_id").agg(F.collect_list(F.struct("contact_id")).alias("c"))  # a list of values would lose nulls
    cuts = F.transform(F.sequence(F.lit(1), F.size("c"), F.lit(MOST)), lambda i: F.transform(F.slice("c", i, MOST), lambda x: x["contact_id"]))
    rows = task_pair.join(lists.select("cb_id", F.explode(cuts).alias("_contacts")), "cb_id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "task_id").withColumn("contact_id", F.explode("_contacts")).drop("_contacts")
    return first_rows(rows, ["task_id", "contact_id"], [F.col("rate").asc_nulls_last(), F.col("id").asc()], 1).drop("rn")


def latest_health(event: DataFrame) -> DataFrame:
    """Latest status of each mailbox and action."""
    return event.groupBy("mailbox_id", "action").agg(F.max_by("status", F.struct("created_at", "event_id")).alias("status"), F.max("created_at").alias("created_at"))


def last_pair(pair_contact: DataFrame) -> DataFrame:
    return pair_contact.groupBy("contact_id").agg(F.max("cb_id").alias("cb_id"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of the ordered rows; numbers outside the range go to the nearest page. Without rows it is empty."""
    total = df.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_strip(number: int, last: int, around: int = 3) -> list[int | None]:
    """Page numbers to show: the edges, those around the current one, and None for a gap."""
    shown = sorted({1, last, *range(max(1, number - around), min(last, number + around) + 1)})
    out: list[int | None] = []
    for n in shown:
        if out and out[-1] is not None and n - out[-1] > 1:
            out.append(None)
        out.append(n)
    return out


def queue_head(queue: DataFrame, keep: int = 5) -> DataFrame:
    return first_rows(queue, ["task_id"], [F.col("rate").asc_nulls_last(), F.col("id").asc()], keep)


def rating_batch(sending_list: DataFrame, task: DataFrame, workspace: DataFrame, test_size: int = 20, size: int = 50) -> DataFrame:
    """The next unrated contacts of each task, best pairs first; tasks of test workspaces get small batches."""
    t = task.select(F.col("id").alias("task_id"), "workspace_id").join(workspace.select(F.col("id").alias("workspace_id"), "access_type"), "workspace_id")
    rows = sending_list.filter(is_false("removed") & F.col("rate").isNull()).join(t, "task_id")
    rows = first_rows(rows, ["task_id"], [F.col("rate_cb").asc_nulls_last(), F.col("contact_id").asc()], max(test_size, size))
    return rows.filter(F.col("rn") <= F.when(F.col("access_type") == "test", test_size).otherwise(size))


def prefix_pairs(task_pair: DataFrame, pair: DataFrame, keep: int = 500, null_is_pending: bool = True, null_rate: int = 10**9) -> DataFrame:
    """The collected pairs before each task's first pending one, the latest first."""
    from marktlens.plans.lists import before_first_hole

    rows = before_first_hole(task_pair, pair, null_is_pending, null_rate)
    order = F.coalesce("rate", F.lit(null_rate))
    return first_rows(rows, ["task_id"], [order.desc(), F.col("id").desc()], keep)


def drawn(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn by a hash of seed and key, in that order, with their `place`: the same ones at each run."""
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    few = rows.orderBy(*order).limit(n)
    return few.withColumn("place", F.row_number().over(Window.orderBy(*order)))
