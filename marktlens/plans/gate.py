"""Whether a task needs more rated contacts, by its workspace's access, its campaigns' demand and the quality of late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marktlens.operators.aggregates import count_if, max_deficit

TEST_GOOD, TEST_RATED, FULL_RATED, GOOD_SHARE, WINDOW = 20, 60, 100, 0.25, 3000


def more_needed(task: DataFrame, workspace: DataFrame, sending_list: DataFrame, campaign: DataFrame, continued: DataFrame | None = None) -> DataFrame:
    """task_id, needed, blocked (more is wanted, but the last contacts were bad), sample.

    campaign: sending_list_id, sent_num, to_send_num, archived. Good means a rate below the limit. Test workspaces stop at
    enough good or rated contacts. Those with full access stop when every campaign has what it needs, or without
    campaigns, at enough rated contacts; else the last contacts, as many as the largest shortfall, must hold a share
    of good ones, unless the task is among those continued regardless. Others need nothing."""
    t = task.join(workspace.select(F.col("id").alias("workspace_id"), F.lower(F.trim(F.coalesce("access_type", F.lit("")))).alias("access")), "workspace_id")
    t = t.select(F.col("id").alias("task_id"), "access", F.coalesce("rate_limit", F.lit(0)).alias("rate_limit"))
    rated = sending_list.filter("rate is not null").select("task_id", "contact_id", "rate", "updated_at").join(t, "task_id")
    counts = rated.groupBy("task_id").agg(F.count("*").alias("rated"), count_if("rate < rate_limit").alias("good"))
    c = campaign.filter("not coalesce(archived, false)").select(F.col("sending_list_id").alias("task_id"), F.greatest(F.lit(0), F.coalesce("sent_num", F.lit(0))).alias("sent_num"), F.greatest(F.lit(0), F.coalesce("to_send_num", F.lit(0))).alias("to_send_num"))
    deficit = max_deficit(c, counts.select("task_id", "good"))
    t = t.join(counts, "task_id", "left").join(deficit, "task_id", "left").fillna(0, ["rated", "good"])
    t = t.withColumn("sample", F.when(F.col("deficit").isNull(), FULL_RATED).otherwise(F.greatest(F.lit(1), F.col("deficit"))))
    w = Window.partitionBy("task_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("contact_id").desc())
    last = rated.withColumn("_rn", F.row_number().over(w)).join(t.select("task_id", "sample"), "task_id").filter("_rn <= sample")
    last = last.groupBy("task_id").agg(F.count("*").alias("seen"), count_if("rate < rate_limit").alias("seen_good"))
    t = t.join(last, "task_id", "left").fillna(0, ["seen", "seen_good"])
    t = t.join(continued.select("task_id").distinct().withColumn("_go", F.lit(True)), "task_id", "left") if continued is not None else t.withColumn("_go", F.lit(None).cast("boolean"))
    wanted = F.when(F.col("deficit").isNull(), F.col("rated") < FULL_RATED).otherwise(F.col("deficit") > 0)
    bad = ~F.coalesce("_go", F.lit(False)) & (F.col("seen") >= F.col("sample")) & (F.col("seen_good") / F.col("seen") < GOOD_SHARE)
    full = F.col("access").isin("full", "super", "custom")
    test = (F.col("access") == "test") & (F.col("good") < TEST_GOOD) & (F.col("rated") < TEST_RATED)
    blocked = F.coalesce(full & wanted & bad, F.lit(False))
    return t.select("task_id", (test | (full & wanted & ~blocked)).alias("needed"), blocked.alias("blocked"), F.col("sample").cast("long").alias("sample"))


def ready_active(task: DataFrame, task_pair: DataFrame, needed: DataFrame) -> DataFrame:
    """Ready: a pair with a positive rate; active: ready, not archived, switched on by its user, and more is needed."""
    ready = task_pair.filter("rate > 0").select(F.col("task_id").alias("id")).distinct().withColumn("ready", F.lit(True))
    rows = task.join(ready, "id", "left").fillna(False, ["ready"]).join(needed.select(F.col("task_id").alias("id"), "needed"), "id", "left")
    active = F.col("ready") & ~F.col("archived") & F.col("user_active") & F.coalesce("needed", F.lit(False))
    return rows.select(F.col("id").alias("task_id"), "ready", active.alias("active"))
