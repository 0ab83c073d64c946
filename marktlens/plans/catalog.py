"""Registered queries and their DuckDB oracles: Spark runs the library's operators, DuckDB hand-written SQL over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktlens.functions import geo, hashing, letters, text
from marktlens.operators import aggregates as ag
from marktlens.operators import filters, joins, merge, ranking
from marktlens.parsing import cards, mails
from marktlens.plans import dashboards, expansion, gate, lists, pacing, rating, replies, resolution
from marktlens.sources.tables import Tables, shared_folder, with_ctes
from marktlens.streaming import clicks, machines

AS_OF = "2001-12-31 00:00:00"
NOW = "2025-04-17 10:30:00"  # a Thursday before a holiday
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, make: Callable[[Tables], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = with_ctes(sql)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Eligible contacts of every campaign that are still to be written to.
CANDIDATES = f"""
SELECT c.id AS campaign_id, sl.contact_id, sl.rate, sl.rate_cb
FROM campaign c JOIN task t ON t.id = c.sending_list_id JOIN sending_list sl ON sl.task_id = t.id JOIN contact ac ON ac.id = sl.contact_id
LEFT JOIN (SELECT campaign_id, contact_id, MAX(COALESCE(processed_at, created_at)) AS sent_at FROM sending_log WHERE processed AND status = 'SEND' GROUP BY ALL) ps
  ON ps.campaign_id = c.campaign_parent_id AND ps.contact_id = sl.contact_id
WHERE COALESCE(sl.removed, FALSE) = FALSE AND sl.rate IS NOT NULL AND sl.rate <= t.rate_limit AND COALESCE(ac.blocked, FALSE) = FALSE AND COALESCE(ac.wrong_email, FALSE) = FALSE
  AND (c.campaign_parent_id IS NULL OR ps.sent_at <= TIMESTAMP '{AS_OF}' - c.send_after_parent_days * INTERVAL 1 DAY)
  AND NOT EXISTS (SELECT 1 FROM sending_log lg WHERE lg.campaign_id = c.id AND lg.contact_id = sl.contact_id)
"""


def found(t: Tables) -> DataFrame:
    return ranking.candidates(t.campaign, t.task, t.sending_list, t.contact, t.sending_log, AS_OF)


# --- figures -------------------------------------------------------------------------------------------------------------

query("A1_list_stats", lambda t: ag.list_stats(t.sending_list, t.task), """
SELECT sl.task_id, count(*) AS total, count(sl.rate) AS rated, count(*) FILTER (WHERE sl.rate IS NULL) AS unrated, count(*) FILTER (WHERE sl.rate <= t.rate_limit) AS good, count(*) FILTER (WHERE sl.rate > t.rate_limit) AS bad
FROM sending_list sl JOIN task t ON t.id = sl.task_id WHERE NOT coalesce(sl.removed, false) GROUP BY sl.task_id""")
query("A2_list_status", lambda t: ag.list_status(t.sending_list, t.task), """
SELECT sl.task_id, count(*) AS total, count(rate) AS rated, count(*) - count(rate) AS unrated, CAST(max(rate) AS BIGINT) AS max_rate, CAST(floor(count(rate) * 100.0 / count(*)) AS BIGINT) AS percent,
  CASE WHEN count(rate) = count(*) THEN 'completed' WHEN any_value(t.user_active AND NOT t.archived) THEN 'run' ELSE 'paused' END AS state
FROM sending_list sl JOIN task t ON t.id = sl.task_id WHERE NOT coalesce(removed, false) GROUP BY sl.task_id""")
query("A3_sent_per_campaign", lambda t: ag.sent_per_campaign(t.sending_log), "SELECT campaign_id, count(*) AS sent FROM sending_log WHERE status = 'SEND' GROUP BY campaign_id")
query("A4_unique_viewers", lambda t: ag.unique_viewers(t.click, t.sending_log), "SELECT lg.campaign_id, count(DISTINCT lg.contact_id) AS viewers FROM click c JOIN sending_log lg ON lg.id = c.letter_id GROUP BY lg.campaign_id")
query("A5_site_clicks", lambda t: ag.site_clicks(t.click, t.sending_log), "SELECT lg.campaign_id, lg.contact_id, max(c.time) AS seen_at, count(*) AS clicks FROM click c JOIN sending_log lg ON lg.id = c.letter_id GROUP BY ALL")
query("A6_group_count", lambda t: ag.group_count(t.click, t.sending_log), "SELECT count(*) AS n_groups FROM (SELECT lg.campaign_id, lg.contact_id FROM click c JOIN sending_log lg ON lg.id = c.letter_id GROUP BY ALL)")
query("A7_total_sent_left", lambda t: ag.totals(t.campaign, t.sending_list, t.sending_log), """
SELECT c.id AS campaign_id, coalesce(n.total, 0) AS total, coalesce(s.sent, 0) AS sent, greatest(0, coalesce(n.total, 0) - coalesce(s.sent, 0)) AS left_over
FROM campaign c LEFT JOIN (SELECT task_id, count(*) AS total FROM sending_list WHERE NOT coalesce(removed, false) GROUP BY 1) n ON n.task_id = c.sending_list_id
LEFT JOIN (SELECT campaign_id, count(*) AS sent FROM sending_log WHERE status = 'SEND' GROUP BY 1) s ON s.campaign_id = c.id""")
query("A8_send_success", lambda t: ag.send_success(t.sending_log), "SELECT campaign_id, count(*) AS total, count(*) FILTER (WHERE upper(coalesce(status, '')) = 'SEND') AS ok, count(*) FILTER (WHERE upper(coalesce(status, '')) = 'SEND') / count(*) AS share FROM sending_log GROUP BY 1")
query("A9_pending_per_campaign", lambda t: dashboards.pending(t.campaign, t.task, t.sending_list, t.contact, t.sending_log, AS_OF), f"SELECT c.id AS campaign_id, coalesce(n.pending, 0) AS pending FROM campaign c LEFT JOIN (SELECT campaign_id, count(*) AS pending FROM ({CANDIDATES}) GROUP BY 1) n ON n.campaign_id = c.id")
query("A10_parent_last_send", lambda t: ag.parent_last_send(t.campaign, t.sending_log), "SELECT campaign_id, contact_id, max(coalesce(processed_at, created_at)) AS parent_sent_at FROM sending_log WHERE processed AND status = 'SEND' AND campaign_id IN (SELECT campaign_parent_id FROM campaign WHERE campaign_parent_id IS NOT NULL) GROUP BY ALL")
query("A11_sent_recount", lambda t: ag.sent_recount(t.campaign, t.sending_log, t.campaign.select(F.col("id").alias("campaign_id"), (F.col("id") % 3).alias("sent_num"))), """
SELECT c.id AS campaign_id, coalesce(n, 0) AS sent_num FROM campaign c LEFT JOIN (SELECT campaign_id, count(*) AS n FROM sending_log WHERE processed GROUP BY 1) s ON s.campaign_id = c.id WHERE coalesce(n, 0) <> c.id % 3""")
query("A12_plz_best_rate", lambda t: ag.plz_best_rate(t.task_city_rating, t.city_plz), "SELECT r.task_id, m.plz, CAST(min(r.rate) AS BIGINT) AS rate FROM task_city_rating r JOIN city_plz m USING (city_id) WHERE r.rate IS NOT NULL GROUP BY ALL")
query("A13_rated_places", lambda t: ag.rated_places(t.task_city_rating, t.city_plz), "SELECT r.task_id, count(DISTINCT m.plz) AS places FROM task_city_rating r JOIN city_plz m USING (city_id) WHERE r.rate IS NOT NULL GROUP BY 1")
query("A14_fingerprint_text", lambda t: ag.fingerprint_text(t.task_branch_rating, "branch_id"), "SELECT task_id, string_agg(concat(branch_id, ':', coalesce(CAST(rate AS VARCHAR), '')), '|' ORDER BY branch_id) AS fingerprint FROM task_branch_rating GROUP BY 1")
query("A15_contacts_per_branch", lambda t: ag.contacts_per_branch(t.pair, t.pair_contact, t.task_pair), "SELECT tp.task_id, p.branch_id, CAST(sum(n.n) AS BIGINT) AS contacts FROM task_pair tp JOIN (SELECT cb_id, count(*) AS n FROM pair_contact GROUP BY 1) n USING (cb_id) JOIN pair p ON p.id = tp.cb_id GROUP BY ALL HAVING sum(n.n) > 0")
query("A16_contacts_per_city", lambda t: ag.contacts_per_city(t.pair, t.pair_contact, t.plz, t.city_plz), """
SELECT m.city_id, CAST(sum(n.n) AS BIGINT) AS contacts FROM pair p JOIN (SELECT cb_id, count(*) AS n FROM pair_contact GROUP BY 1) n ON n.cb_id = p.id
JOIN plz z ON z.id = p.plz_id JOIN (SELECT plz, min(city_id) AS city_id FROM city_plz GROUP BY 1) m ON m.plz = z.plz GROUP BY 1""")
query("A17_branch_collapse", lambda t: ag.collapse_branches(
    t.task_branch_rating.join(t.branch, F.col("branch_id") == F.col("id")).select("id", F.when(F.col("id") % 2 == 0, F.upper(F.concat(F.lit("Straße "), (F.col("id") % 7).cast("string")))).otherwise(F.concat(F.lit("straße "), (F.col("id") % 7).cast("string"))).alias("name"), F.col("rate").cast("long").alias("rate"), F.lit(1).alias("n"), "task_id"),
    "name", ["task_id", "id"]).select("title", "rate", "n", F.size("ids").cast("long").alias("n_ids"), F.get("ids", F.lit(0)).alias("first_id")), """
WITH r AS (SELECT b.id, replace(lower(CASE WHEN b.id % 2 = 0 THEN upper(concat('Straße ', b.id % 7)) ELSE concat('straße ', b.id % 7) END), 'ß', 'ss') AS title, CAST(r.rate AS BIGINT) AS rate, r.task_id FROM task_branch_rating r JOIN branch b ON b.id = r.branch_id)
SELECT title, arg_min_null(rate, (task_id, id)) AS rate, count(*) AS n, count(*) AS n_ids, arg_min(id, (task_id, id)) AS first_id FROM r GROUP BY title""")
query("A18_hash_mismatch", lambda t: ag.hash_mismatch(
    t.task_branch_rating.withColumn("hash_task", F.when(F.col("branch_id") % 10 < 8, F.col("task_id") % 5)), t.task.select(F.col("id").alias("task_id"), (F.col("id") % 5 + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("hash")), 8), """
SELECT r.task_id, count(r.rate) AS rated, bool_or(r.rate IS NOT NULL AND (CASE WHEN branch_id % 10 < 8 THEN r.task_id % 5 END) IS DISTINCT FROM (r.task_id % 5 + CASE WHEN r.task_id % 4 = 0 THEN 1 ELSE 0 END)) AS mismatch,
  bool_or(r.rate IS NOT NULL AND (CASE WHEN branch_id % 10 < 8 THEN r.task_id % 5 END) IS DISTINCT FROM (r.task_id % 5 + CASE WHEN r.task_id % 4 = 0 THEN 1 ELSE 0 END)) AND count(r.rate) <= 8 AS offer
FROM task_branch_rating r JOIN task t ON t.id = r.task_id GROUP BY 1""")
query("A19_contact_flags", lambda t: ag.contact_flags(t.sending_list), "SELECT contact_id, bool_or(coalesce(removed, false)) AS any_removed, bool_or(NOT coalesce(removed, false)) AS any_listed FROM sending_list GROUP BY 1")
query("A20_sorted_arrays", lambda t: ag.contact_arrays(t.sending_list, t.task, t.sending_log).select("contact_id", F.array_join("titles", "|").alias("titles"), F.array_join(F.transform("sent_at", lambda x: F.date_format(x, "yyyy-MM-dd")), "|").alias("sent_days")), """
SELECT l.contact_id, l.titles, coalesce(s.days, '') AS sent_days
FROM (SELECT sl.contact_id, string_agg(DISTINCT t.title, '|' ORDER BY t.title) AS titles FROM sending_list sl JOIN task t ON t.id = sl.task_id GROUP BY 1) l
LEFT JOIN (SELECT contact_id, string_agg(strftime(sent, '%Y-%m-%d'), '|' ORDER BY sent DESC) AS days FROM (SELECT DISTINCT contact_id, coalesce(processed_at, created_at) AS sent FROM sending_log WHERE status = 'SEND') GROUP BY 1) s ON s.contact_id = l.contact_id""")
query("A21_changed_tasks", lambda t: merge.update_changed(t.task.select("id", "rate_limit"), t.task.select("id", F.when(F.col("id") % 3 == 0, F.lit(40)).otherwise(F.col("rate_limit")).alias("rate_limit")), ["id"], ["rate_limit"]).agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("ids")), "SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM task WHERE id % 3 = 0 AND rate_limit <> 40")
query("A22_last_n_quality", lambda t: ag.last_n_quality(t.sending_list, t.task, 10), """
SELECT r.task_id, count(*) FILTER (WHERE r.rate < t.rate_limit) AS good, count(*) FILTER (WHERE r.rate >= t.rate_limit) AS bad, count(*) AS total
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC NULLS LAST, contact_id DESC) AS rn FROM sending_list WHERE rate IS NOT NULL) r JOIN task t ON t.id = r.task_id WHERE rn <= 10 GROUP BY 1""")
query("A23_rated_good", lambda t: t.sending_list.filter("rate is not null").join(t.task.select(F.col("id").alias("task_id"), "rate_limit"), "task_id").groupBy("task_id").agg(F.count("*").alias("rated"), F.count_if(F.expr("rate < rate_limit")).alias("good")), "SELECT sl.task_id, count(*) AS rated, count(*) FILTER (WHERE sl.rate < t.rate_limit) AS good FROM sending_list sl JOIN task t ON t.id = sl.task_id WHERE sl.rate IS NOT NULL GROUP BY 1")
query("A24_geo_rollup", lambda t: ag.geo_rollup(t.city), "SELECT state_name, count(*) AS cities, CAST(sum(pop_total) AS BIGINT) AS population, CAST(grouping(state_name) AS BIGINT) AS level FROM city GROUP BY ROLLUP (state_name)")
query("A25_first_and_plz_list", lambda t: ag.city_codes(t.city, t.city_plz).withColumn("plz_list", F.array_join("plz_list", ",")), "SELECT c.id, min(c.name) AS name, coalesce(string_agg(DISTINCT m.plz, ',' ORDER BY m.plz), '') AS plz_list FROM city c LEFT JOIN city_plz m ON m.city_id = c.id GROUP BY 1")


def demand(t: Tables) -> DataFrame:
    """Campaigns with made-up figures of what they sent and need."""
    return t.campaign.select("sending_list_id", F.col("sending_list_id").alias("task_id"), (F.col("id") % 4).alias("sent_num"), (F.col("id") % 23).alias("to_send_num"), (F.col("id") % 17 == 0).alias("archived"))


DEMAND = "SELECT sending_list_id AS task_id, id % 4 AS sent_num, id % 23 AS to_send_num, id % 17 = 0 AS archived FROM campaign"
query("A28_max_deficit", lambda t: ag.max_deficit(demand(t).drop("sending_list_id"), t.sending_list.filter("rate < 50").groupBy("task_id").agg(F.count("*").alias("good"))), f"""
SELECT d.task_id, max(greatest(0, d.to_send_num - greatest(0, coalesce(g.good, 0) - d.sent_num))) AS deficit FROM ({DEMAND}) d LEFT JOIN (SELECT task_id, count(*) AS good FROM sending_list WHERE rate < 50 GROUP BY 1) g USING (task_id) GROUP BY 1""")
query("A29_rating_progress", lambda t: ag.rating_progress(t.task_city_rating), "SELECT task_id, count(rate) AS rated, count(*) - count(rate) AS unrated, CAST(floor(count(rate) * 100.0 / count(*)) AS BIGINT) AS percent FROM task_city_rating GROUP BY 1")
query("A30_gate_percent", lambda t: ag.last_n_quality(t.sending_list, t.task, 10).select("task_id", F.bround(F.col("good") * 100 / F.col("total")).cast("long").alias("percent")), """
SELECT r.task_id, CAST(round_even(count(*) FILTER (WHERE r.rate < t.rate_limit) * 100.0 / count(*), 0) AS BIGINT) AS percent
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC NULLS LAST, contact_id DESC) AS rn FROM sending_list WHERE rate IS NOT NULL) r JOIN task t ON t.id = r.task_id WHERE rn <= 10 GROUP BY 1""")

# --- best rows, orders, pages ----------------------------------------------------------------------------------------------

RN = "row_number() OVER (PARTITION BY {} ORDER BY {}) AS rn"
SEND = "rate ASC NULLS LAST, rate_cb ASC NULLS LAST, contact_id"
query("W1_planned_top8", lambda t: ranking.planned(found(t)).select("campaign_id", "contact_id", "rn"), f"SELECT campaign_id, contact_id, CAST(rn AS INT) AS rn FROM (SELECT *, {RN.format('campaign_id', SEND)} FROM ({CANDIDATES})) WHERE rn <= 8")
query("W2_recent_top3", lambda t: ranking.recent_sends(t.sending_log).select("campaign_id", "id", "sent_at", "rn"), f"SELECT campaign_id, id, sent_at, CAST(rn AS INT) AS rn FROM (SELECT *, {RN.format('campaign_id', 'sent_at DESC, id DESC, contact_id')} FROM (SELECT *, coalesce(processed_at, created_at) AS sent_at FROM sending_log)) WHERE rn <= 3")
query("W3_best_pair_per_contact", lambda t: ranking.best_pair(t.task_pair, t.pair_contact).select("task_id", "contact_id", "cb_id", "rate"), "SELECT DISTINCT ON (tp.task_id, pc.contact_id) tp.task_id, pc.contact_id, tp.cb_id, tp.rate FROM task_pair tp JOIN pair_contact pc USING (cb_id) ORDER BY tp.task_id, pc.contact_id, tp.rate ASC NULLS LAST, tp.id")
query("W4_latest_health", lambda t: ranking.latest_health(t.mailbox_event), "SELECT DISTINCT ON (mailbox_id, action) mailbox_id, action, status, created_at FROM mailbox_event ORDER BY mailbox_id, action, created_at DESC, event_id DESC")
query("W5_latest_check", lambda t: ranking.latest_health(t.mailbox_event.filter("action = 'IMAP_CHECK'")).select("mailbox_id", "status"), "SELECT mailbox_id, arg_max(status, (created_at, event_id)) AS status FROM mailbox_event WHERE action = 'IMAP_CHECK' GROUP BY 1")
query("W6_last_pair", lambda t: ranking.last_pair(t.pair_contact), "SELECT contact_id, max(cb_id) AS cb_id FROM pair_contact GROUP BY 1")
query("W7_pair_count", lambda t: t.task_pair.groupBy("task_id").agg(F.count("*").alias("pairs")), "SELECT task_id, count(*) AS pairs FROM task_pair GROUP BY 1")
query("W8_keep_first", lambda t: joins.in_order_best(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
query("L1_queue_head", lambda t: ranking.queue_head(joins.pair_queue(t.task_pair, t.pair, t.plz, t.branch)).select("task_id", "id", "rate", "plz", "catalog", "rn"), f"SELECT task_id, id, rate, plz, catalog, CAST(rn AS INT) AS rn FROM (SELECT tp.task_id, tp.id, tp.rate, z.plz, b.catalog, {RN.format('tp.task_id', 'tp.rate ASC NULLS LAST, tp.id')} FROM task_pair tp JOIN pair p ON p.id = tp.cb_id JOIN plz z ON z.id = p.plz_id JOIN branch b ON b.id = p.branch_id WHERE p.collected = false) WHERE rn <= 5")
query("L2_send_order", lambda t: ranking.first_rows(found(t), ["campaign_id"], ranking.send_order(), 200).select("campaign_id", "contact_id", "rn"), f"SELECT campaign_id, contact_id, CAST(rn AS INT) AS rn FROM (SELECT *, {RN.format('campaign_id', SEND)} FROM ({CANDIDATES})) WHERE rn <= 200")
query("L3_page", lambda t: ranking.page(t.contact.select("id", "company_name"), [F.col("id")], 7, 25), "SELECT id, company_name FROM contact ORDER BY id LIMIT 25 OFFSET (SELECT (least(7, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT))) - 1) * 25 FROM contact)")
query("L5_rehash_allowed", lambda t: t.sending_list.groupBy("task_id").agg((F.count("rate") <= 10).alias("allowed")), "SELECT task_id, count(rate) <= 10 AS allowed FROM sending_list GROUP BY 1")
query("L6_backlog", lambda t: expansion.window_size(t.task_pair, t.pair), "SELECT tp.task_id, count(*) AS n, count(*) FILTER (WHERE NOT p.collected AND tp.rate > 0) AS waiting, CASE WHEN count(*) FILTER (WHERE NOT p.collected AND tp.rate > 0) < 5000 THEN count(*) + 5000 ELSE count(*) END AS wanted FROM task_pair tp JOIN pair p ON p.id = tp.cb_id GROUP BY 1")
query("L7_rating_batch", lambda t: ranking.rating_batch(t.sending_list, t.task, t.workspace).select("task_id", "contact_id", "rn"), f"SELECT task_id, contact_id, CAST(rn AS INT) AS rn FROM (SELECT sl.task_id, sl.contact_id, w.access_type, {RN.format('sl.task_id', 'sl.rate_cb ASC NULLS LAST, sl.contact_id')} FROM sending_list sl JOIN task t ON t.id = sl.task_id JOIN workspace w ON w.id = t.workspace_id WHERE NOT coalesce(sl.removed, false) AND sl.rate IS NULL) WHERE rn <= CASE WHEN access_type = 'test' THEN 20 ELSE 50 END")

BEFORE = """SELECT tp.* FROM task_pair tp JOIN pair p ON p.id = tp.cb_id LEFT JOIN (SELECT tp.task_id, min((coalesce(CAST(tp.rate AS BIGINT), {n}), tp.id)) AS hole FROM task_pair tp JOIN pair p ON p.id = tp.cb_id WHERE p.collected = false GROUP BY 1) h USING (task_id)
WHERE p.collected AND (h.hole IS NULL OR (coalesce(CAST(tp.rate AS BIGINT), {n}), tp.id) < h.hole)"""
query("L9_prefix_pairs", lambda t: ranking.prefix_pairs(t.task_pair, t.pair, 20).select("task_id", "id", "rn"), f"SELECT task_id, id, CAST(rn AS INT) AS rn FROM (SELECT *, {RN.format('task_id', 'coalesce(rate, 1000000000) DESC, id DESC')} FROM ({BEFORE.format(n=10**9)})) WHERE rn <= 20")

# --- joins and filters -----------------------------------------------------------------------------------------------------

query("J1_pair_queue", lambda t: joins.pair_queue(t.task_pair, t.pair, t.plz, t.branch), "SELECT tp.task_id, tp.id, tp.cb_id, tp.rate, z.plz, b.branch_name, b.catalog FROM task_pair tp JOIN pair p ON p.id = tp.cb_id JOIN plz z ON z.id = p.plz_id JOIN branch b ON b.id = p.branch_id WHERE p.collected = false")
query("J2_pair_meta", lambda t: joins.pair_meta(t.pair, t.plz, t.branch, t.city_plz, t.city), "SELECT p.id AS cb_id, z.plz, b.branch_name AS branch, b.catalog, c.name AS city, c.state_name AS land FROM pair p JOIN plz z ON z.id = p.plz_id JOIN branch b ON b.id = p.branch_id LEFT JOIN (SELECT plz, min(city_id) AS city_id FROM city_plz GROUP BY 1) m ON m.plz = z.plz LEFT JOIN city c ON c.id = m.city_id")
query("J3_before_first_hole", lambda t: lists.before_first_hole(t.task_pair, t.pair).select("task_id", "id"), f"SELECT task_id, id FROM ({BEFORE.format(n=2**63 - 1)})")
query("J4_unsent", lambda t: t.sending_list.select("task_id", "contact_id").join(t.sending_log.select("contact_id").distinct(), "contact_id", "left_anti").groupBy("task_id").agg(F.count("*").alias("unsent")), "SELECT task_id, count(*) AS unsent FROM sending_list sl WHERE NOT EXISTS (SELECT 1 FROM sending_log lg WHERE lg.contact_id = sl.contact_id) GROUP BY 1")
query("J5_delete_missing", lambda t: joins.missing(t.task_pair, t.task_pair.filter("rate < 25"), ["task_id", "cb_id"]).select("task_id", "cb_id"), "SELECT task_id, cb_id FROM task_pair a WHERE NOT EXISTS (SELECT 1 FROM task_pair b WHERE b.rate < 25 AND b.task_id = a.task_id AND b.cb_id = a.cb_id)")
query("J6_fully_rated_tasks", lambda t: joins.fully_rated(t.task_city_rating), "SELECT DISTINCT task_id FROM task_city_rating a WHERE NOT EXISTS (SELECT 1 FROM task_city_rating b WHERE b.task_id = a.task_id AND b.rate IS NULL)")
query("J10_surrogate_ids", lambda t: joins.surrogate_ids(t.task_pair.join(t.pair, F.col("cb_id") == t.pair.id).select("task_id", "plz_id", "branch_id", t.task_pair.rate), t.pair, ["plz_id", "branch_id"], "cb_id").select("task_id", "cb_id", "rate"), "SELECT tp.task_id, p.id AS cb_id, tp.rate FROM task_pair tp JOIN pair s ON s.id = tp.cb_id JOIN pair p ON p.plz_id = s.plz_id AND p.branch_id = s.branch_id")


def points(t: Tables) -> DataFrame:
    return t.plz.select("id", (47.3 + (F.col("id") * 37 % 97) / 14).alias("lat"), (5.9 + (F.col("id") * 53 % 89) / 10).alias("lon"))


query("J12_nearest_city", lambda t: joins.nearest(points(t), t.city).select("point_id", "place_id", F.round("d2", 6).alias("d2")), """
SELECT p.id AS point_id, arg_min(c.id, (d2, c.id)) AS place_id, round(min(d2), 6) AS d2 FROM (SELECT id, 47.3 + (id * 37 % 97) / 14 AS lat, 5.9 + (id * 53 % 89) / 10 AS lon FROM plz) p, city c, LATERAL (SELECT pow(c.lat - p.lat, 2) + pow(c.lon - p.lon, 2) AS d2) GROUP BY p.id""")
query("J13_geo_labels", lambda t: t.nation.join(t.region.filter("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.concat(F.lit("Kreis "), F.col("n_regionkey").cast("string"))).alias("label")), "SELECT n_nationkey, coalesce(r_name, concat('Kreis ', n_regionkey)) AS label FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON r_regionkey = n_regionkey")
query("J18_recent_mailboxes", lambda t: joins.recent_mailboxes(t.sending_log, t.campaign, "2000-06-01 00:00:00", 20), "SELECT DISTINCT c.mailbox_id FROM campaign c WHERE c.id IN (SELECT campaign_id FROM sending_log WHERE created_at >= TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 20 DAY)")
query("J20_titles", lambda t: joins.titles(t.branch, t.branch.filter("id % 3 <> 0").select("id", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("lang")).withColumn("title", F.concat("lang", F.lit(" "), F.col("id").cast("string")))).select("id", F.element_at("titles", "de").alias("de"), F.try_element_at("titles", F.lit("en")).alias("en"), F.try_element_at("titles", F.lit("fr")).alias("fr")), "SELECT id, branch_name AS de, CASE WHEN id % 3 <> 0 THEN concat('en ', id) END AS en, CASE WHEN id % 3 <> 0 THEN concat('fr ', id) END AS fr FROM branch")
query("P1_changed", lambda t: t.sending_list.filter(filters.changed("rate", "rate_cb")).groupBy("task_id").agg(F.count("*").alias("n")), "SELECT task_id, count(*) AS n FROM sending_list WHERE rate IS DISTINCT FROM rate_cb GROUP BY 1")
query("P3_eligible", lambda t: t.sending_list.join(t.task.select(F.col("id").alias("task_id"), "rate_limit"), "task_id").join(t.contact.select(F.col("id").alias("contact_id"), "blocked", "wrong_email"), "contact_id").filter(filters.eligible()).groupBy("task_id").agg(F.count("*").alias("n")), "SELECT sl.task_id, count(*) AS n FROM sending_list sl JOIN task t ON t.id = sl.task_id JOIN contact c ON c.id = sl.contact_id WHERE NOT coalesce(sl.removed, false) AND sl.rate <= t.rate_limit AND NOT coalesce(c.blocked, false) AND NOT coalesce(c.wrong_email, false) GROUP BY 1")


def sections(t: Tables) -> DataFrame:
    rows = t.sending_list.join(t.task.select(F.col("id").alias("task_id"), "rate_limit"), "task_id")
    return rows.groupBy("task_id").agg(*[F.count_if(F.coalesce(filters.rate_section(s), F.lit(False))).alias(f"n_{s}") for s in ("in", "out", "rated", "all")])


query("P5_sections", sections, "SELECT sl.task_id, count(*) FILTER (WHERE rate <= rate_limit) AS n_in, count(*) FILTER (WHERE rate > rate_limit) AS n_out, count(rate) AS n_rated, count(*) - count(rate) AS n_all FROM sending_list sl JOIN task t ON t.id = sl.task_id GROUP BY 1")
query("P6_search", lambda t: t.contact.filter(filters.search("o17", "company_name", "email")).select("id"), "SELECT id FROM contact WHERE company_name ILIKE '%o17%' OR email ILIKE '%o17%'")
query("P11_population_bands", lambda t: t.city.filter(geo.in_bands(F.col("pop_total"), ["medium", "metropolis"])).select("id", "name"), "SELECT id, name FROM city WHERE pop_total BETWEEN 50000 AND 199999 OR pop_total BETWEEN 500000 AND 4000000")
query("P12_radius", lambda t: geo.within_radius(t.city, "nation_1%", 300.0).select("id", F.round("km", 4).alias("km")), """
WITH c AS (SELECT lat AS a, lon AS b FROM city WHERE name ILIKE 'nation_1%' ORDER BY pop_total DESC, id LIMIT 1)
SELECT * FROM (SELECT id, round(6371 * acos(least(1, greatest(-1, cos(radians(a)) * cos(radians(lat)) * cos(radians(lon) - radians(b)) + sin(radians(a)) * sin(radians(lat))))), 4) AS km FROM city, c) WHERE km <= 300""")
query("P8_one_of", lambda t: t.branch.filter(filters.one_of("id", [1, 5, 7, 50])).select("id"), "SELECT id FROM branch WHERE id IN (1, 5, 7, 50)")
query("P9_none_of", lambda t: t.branch.filter(filters.one_of("id", [1, 5, 7, 50], but=True)).select("id"), "SELECT id FROM branch WHERE id NOT IN (1, 5, 7, 50)")
query("P10_branch_rule", lambda t: t.branch.filter(filters.where({"any": [{"all": [{"like": {"branch_name": ["%branche 1%", "% 4_"]}}, {"not": {"like": {"branch_name": ["%5"]}}}]}, {"like": {"branch_name": ["BRANCHE 33"]}}]})).select("id"), "SELECT id FROM branch WHERE ((branch_name ILIKE '%branche 1%' OR branch_name ILIKE '% 4_') AND NOT branch_name ILIKE '%5') OR branch_name ILIKE 'BRANCHE 33'")
query("P11_city_rule", lambda t: geo.within_radius(t.city, "germany", 900).filter(filters.where({"all": [{"like": {"state_name": ["a%", "europe", "middle%"]}}, {"bands": {"pop_total": ["small", "large", "metropolis"]}}]})).select("id", F.round("km", 4).alias("km")), """
SELECT id, round(km, 4) AS km FROM (SELECT c.*, 6371 * acos(least(1, greatest(-1, cos(radians(m.lat)) * cos(radians(c.lat)) * cos(radians(c.lon) - radians(m.lon)) + sin(radians(m.lat)) * sin(radians(c.lat))))) AS km FROM city c, (SELECT lat, lon FROM city WHERE name ILIKE 'germany') m)
WHERE km <= 900 AND (state_name ILIKE 'a%' OR state_name ILIKE 'europe' OR state_name ILIKE 'middle%') AND (pop_total BETWEEN 12000 AND 49999 OR pop_total BETWEEN 200000 AND 499999 OR pop_total BETWEEN 500000 AND 4000000)""")
query("P13_display_name", lambda t: t.contact.select("id", filters.display_name("company_name", "email").alias("name")), "SELECT id, coalesce(nullif(trim(company_name), ''), nullif(trim(email), ''), '—') AS name FROM contact")
query("P14_valid_rates", lambda t: t.task_city_rating.filter(filters.valid_rate("rate", 10, 60)).groupBy("task_id").agg(F.count("*").alias("n")), "SELECT task_id, count(*) AS n FROM task_city_rating WHERE rate BETWEEN 10 AND 60 GROUP BY 1")
query("P16_workspace_scope", lambda t: filters.in_workspace(t.campaign, "7").select("id"), "SELECT id FROM campaign WHERE workspace_id = '7'")

# --- merges ----------------------------------------------------------------------------------------------------------------


def wanted(t: Tables) -> DataFrame:
    return lists.prefix_list(t.task_pair, t.pair, t.pair_contact)


WANTED = f"""SELECT task_id, contact_id, cb_id, rate AS rate_cb FROM (SELECT tp.*, pc.contact_id, row_number() OVER (PARTITION BY tp.task_id, pc.contact_id ORDER BY tp.rate ASC NULLS LAST, tp.id) AS rn FROM ({BEFORE.format(n=2**63 - 1)}) tp JOIN pair_contact pc USING (cb_id)) WHERE rn = 1"""
query("M1_upsert_changed", lambda t: merge.upsert(t.sending_list, wanted(t), ["task_id", "contact_id"], ["cb_id", "rate_cb"], AS_OF).filter("action <> 'keep'").select("task_id", "contact_id", "cb_id", "rate_cb", "action"), f"""
SELECT w.task_id, w.contact_id, w.cb_id, w.rate_cb, CASE WHEN sl.task_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM ({WANTED}) w LEFT JOIN sending_list sl USING (task_id, contact_id)
WHERE sl.task_id IS NULL OR sl.cb_id IS DISTINCT FROM w.cb_id OR sl.rate_cb IS DISTINCT FROM w.rate_cb""")
query("M2_delete_unrated_missing", lambda t: merge.delete_missing(t.sending_list, wanted(t), ["task_id", "contact_id"], "rate is null").select("task_id", "contact_id"), f"SELECT sl.task_id, sl.contact_id FROM sending_list sl LEFT JOIN ({WANTED}) w USING (task_id, contact_id) WHERE sl.rate IS NOT NULL OR w.task_id IS NOT NULL")
query("M3_insert_ignore", lambda t: merge.insert_ignore(t.task_city_rating, t.task.crossJoin(t.city.filter("id < 3").select(F.col("id").alias("city_id"))).select(F.col("id").alias("task_id"), "city_id"), ["task_id", "city_id"]).select("task_id", "city_id", F.col("rate").cast("long").alias("rate")), "SELECT task_id, city_id, CAST(rate AS BIGINT) AS rate FROM task_city_rating UNION ALL SELECT t.id, c.id, NULL FROM task t, city c WHERE c.id < 3 AND NOT EXISTS (SELECT 1 FROM task_city_rating r WHERE r.task_id = t.id AND r.city_id = c.id)")
query("M4_stage_last", lambda t: merge.stage_last(t.li.select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_quantity"), ["k"], "pos"), "SELECT l_partkey AS k, max(l_orderkey * 10 + l_linenumber) AS pos, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM li GROUP BY 1")
query("M5_pairs_refresh", lambda t: expansion.refresh(t.task_pair, t.task_pair.filter("cb_id % 3 <> 0").withColumn("rate", F.when(F.col("cb_id") % 5 == 0, F.lit(9)).otherwise(F.col("rate")))).select("task_id", "cb_id", "rate", "action"), "SELECT task_id, cb_id, CASE WHEN cb_id % 5 = 0 THEN 9 ELSE rate END AS rate, CASE WHEN cb_id % 5 = 0 AND rate IS DISTINCT FROM 9 THEN 'update' ELSE 'keep' END AS action FROM task_pair WHERE cb_id % 3 <> 0")
query("M6_zero_rates", lambda t: expansion.zero_rates(t.task_pair, t.task.filter("archived").select(F.col("id").alias("task_id"))).select("id", "rate"), "SELECT tp.id, 0 AS rate FROM task_pair tp JOIN task t ON t.id = tp.task_id WHERE t.archived AND tp.rate IS DISTINCT FROM 0")
query("M7_changed_only", lambda t: merge.update_changed(t.task.select("id", "archived"), gate.ready_active(t.task, t.task_pair, t.task.select(F.col("id").alias("task_id"), F.lit(True).alias("needed"))).select(F.col("task_id").alias("id"), F.col("active").alias("archived")), ["id"], ["archived"]), "SELECT t.id, t.active AS archived FROM (SELECT t.id, t.archived, NOT t.archived AND t.user_active AND EXISTS (SELECT 1 FROM task_pair p WHERE p.task_id = t.id AND p.rate > 0) AS active FROM task t) t WHERE t.active <> t.archived")
query("M8_write_back", lambda t: merge.upsert(t.sending_list, t.sending_list.filter("rate is null and contact_id % 2 = 0").select("task_id", "contact_id", (F.col("contact_id") % 100 + 1).cast("int").alias("rate")), ["task_id", "contact_id"], ["rate"]).groupBy("task_id").agg(F.count("rate").alias("rated"), F.sum(F.col("rate").cast("long")).alias("sum_rate")), "SELECT task_id, count(r) AS rated, CAST(sum(r) AS BIGINT) AS sum_rate FROM (SELECT task_id, CASE WHEN rate IS NULL AND contact_id % 2 = 0 THEN contact_id % 100 + 1 ELSE rate END AS r FROM sending_list) GROUP BY 1")
query("M9_block", lambda t: merge.set_where(t.sending_list, "removed", F.lit(True), t.contact.filter("blocked").select(F.col("id").alias("contact_id")), ["contact_id"]).groupBy("task_id").agg(F.count_if("removed").alias("removed")), "SELECT task_id, count(*) FILTER (WHERE sl.removed OR c.blocked) AS removed FROM sending_list sl JOIN contact c ON c.id = sl.contact_id GROUP BY 1")


def cascade(t: Tables) -> DataFrame:
    log, contact, listed = merge.hard_bounce(t.sending_log, t.contact, t.sending_list, t.sending_log.filter("id % 97 = 0").select("id"))
    bad = log.groupBy().agg(F.count_if(F.col("status") == "BAD_ADDRESS").alias("bad_letters"))
    return bad.join(contact.agg(F.count_if("wrong_email").alias("wrong")), F.lit(True)).join(listed.agg(F.count_if("removed").alias("removed")), F.lit(True))


query("M11_bounce_cascade", cascade, """
WITH hit AS (SELECT DISTINCT contact_id FROM sending_log WHERE id % 97 = 0)
SELECT (SELECT count(*) FROM sending_log WHERE status = 'BAD_ADDRESS' OR id % 97 = 0) AS bad_letters, (SELECT count(*) FROM contact WHERE wrong_email OR id IN (SELECT contact_id FROM hit)) AS wrong,
  (SELECT count(*) FROM sending_list WHERE removed OR contact_id IN (SELECT contact_id FROM hit)) AS removed""")
query("U1_complete_batches", lambda t: merge.complete_batches(t.li.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("int").alias("rate")), t.li.select(F.col("l_orderkey").alias("batch"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("id")).distinct()), "SELECT l_orderkey AS batch FROM li GROUP BY 1 HAVING bool_and(CAST(l_quantity AS INT) BETWEEN 1 AND 100) AND count(*) = count(DISTINCT l_linenumber) AND list_sort(list(DISTINCT l_linenumber)) = [1, 2, 3]")
query("U2_lenient_batch", lambda t: merge.lenient_batch(t.orders.select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 25).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string"))).alias("name"), (F.col("o_orderkey") % 140).alias("rate")), t.city.select("id", "name")).select("pos", "id", "rate"), "SELECT DISTINCT ON (id) pos, id, rate FROM (SELECT o_orderkey AS pos, o_custkey % 25 AS id, o_orderkey % 140 AS rate FROM orders WHERE o_orderkey % 3 <> 0) WHERE rate BETWEEN 1 AND 100 ORDER BY id, pos")
query("U3_snapshot_diff", lambda t: merge.snapshot_diff(t.part.filter("p_partkey % 10 <> 0").select("p_partkey", F.md5("p_name").alias("h")), t.part.filter("p_partkey % 7 <> 0").select("p_partkey", F.md5(F.when(F.col("p_partkey") % 5 == 0, "new").otherwise(F.col("p_name"))).alias("h")), "p_partkey", "h"), "SELECT * FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 AND p_partkey % 7 <> 0 THEN 'added' WHEN p_partkey % 10 <> 0 AND p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 10 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 = 0 THEN 'changed' END AS change FROM part) WHERE change IS NOT NULL")

# --- pipelines -------------------------------------------------------------------------------------------------------------

SCORES = "SELECT r.task_id, z.id AS plz_id, b.branch_id, CAST(r.rate * b.rate AS BIGINT) AS score FROM (SELECT r.task_id, m.plz, min(r.rate) AS rate FROM task_city_rating r JOIN city_plz m USING (city_id) WHERE r.rate IS NOT NULL GROUP BY ALL) r JOIN plz z ON z.plz = r.plz JOIN task_branch_rating b ON b.task_id = r.task_id AND b.rate IS NOT NULL"
query("C2_pair_expansion", lambda t: expansion.expand_pairs(t.task_city_rating, t.task_branch_rating, t.city_plz, t.plz, 40), f"SELECT task_id, plz_id, branch_id, score, CAST(rn AS INT) AS rn FROM (SELECT *, {RN.format('task_id', 'score, plz_id, branch_id')} FROM ({SCORES})) WHERE rn <= 40")
query("C2_whole_window", lambda t: expansion.expand_pairs(t.task_city_rating, t.task_branch_rating, t.city_plz, t.plz), f"SELECT task_id, plz_id, branch_id, score, CAST(rn AS INT) AS rn FROM (SELECT *, {RN.format('task_id', 'score, plz_id, branch_id')} FROM ({SCORES})) WHERE rn <= 10000")
query("J11_all_pairs", lambda t: expansion.pair_figures(t.task_city_rating, t.task_branch_rating, t.city_plz, t.plz), f"SELECT task_id, count(*) AS pairs, min(score) AS least FROM ({SCORES}) GROUP BY 1")

GATE = f"""
WITH t AS (SELECT t.id AS task_id, w.access_type AS access, t.rate_limit FROM task t JOIN workspace w ON w.id = t.workspace_id),
r AS (SELECT sl.*, t.rate_limit, row_number() OVER (PARTITION BY sl.task_id ORDER BY updated_at DESC NULLS LAST, contact_id DESC) AS rn FROM sending_list sl JOIN t USING (task_id) WHERE rate IS NOT NULL),
n AS (SELECT task_id, count(*) AS rated, count(*) FILTER (WHERE rate < rate_limit) AS good FROM r GROUP BY 1),
d AS (SELECT d.task_id, max(greatest(0, d.to_send_num - greatest(0, coalesce(n.good, 0) - d.sent_num))) AS deficit FROM ({DEMAND}) d LEFT JOIN n USING (task_id) WHERE NOT d.archived GROUP BY 1),
x AS (SELECT t.*, coalesce(n.rated, 0) AS rated, coalesce(n.good, 0) AS good, d.deficit, CASE WHEN d.deficit IS NULL THEN 100 ELSE greatest(1, d.deficit) END AS sample FROM t LEFT JOIN n USING (task_id) LEFT JOIN d USING (task_id)),
q AS (SELECT x.task_id, count(*) AS seen, count(*) FILTER (WHERE r.rate < r.rate_limit) AS seen_good FROM x JOIN r ON r.task_id = x.task_id AND r.rn <= x.sample GROUP BY 1),
y AS (SELECT x.*, access IN ('full', 'super', 'custom') AND CASE WHEN deficit IS NULL THEN rated < 100 ELSE deficit > 0 END AS wanted, x.task_id % 9 <> 0 AND coalesce(q.seen, 0) >= sample AND q.seen_good / q.seen < 0.25 AS bad FROM x LEFT JOIN q USING (task_id))
SELECT task_id, (access = 'test' AND good < 20 AND rated < 60) OR (wanted AND NOT coalesce(bad, false)) AS needed, coalesce(wanted AND bad, false) AS blocked, CAST(sample AS BIGINT) AS sample FROM y"""


def needed(t: Tables) -> DataFrame:
    return gate.more_needed(t.task, t.workspace, t.sending_list, demand(t), t.task.filter("id % 9 = 0").select(F.col("id").alias("task_id")))


query("C7_gate", needed, GATE)
query("C4_ready_active", lambda t: gate.ready_active(t.task, t.task_pair, needed(t)), f"""
SELECT t.id AS task_id, r.id IS NOT NULL AS ready, r.id IS NOT NULL AND NOT t.archived AND t.user_active AND coalesce(g.needed, false) AS active
FROM task t LEFT JOIN (SELECT DISTINCT task_id AS id FROM task_pair WHERE rate > 0) r ON r.id = t.id LEFT JOIN ({GATE}) g ON g.task_id = t.id""")
query("C5_prefix_list", wanted, WANTED)
query("C5_rebuilt_list", lambda t: lists.rebuild(t.sending_list, wanted(t), AS_OF).groupBy("task_id", "action").agg(F.count("*").alias("n"), F.count("rate").alias("rated")), f"""
SELECT coalesce(sl.task_id, w.task_id) AS task_id, CASE WHEN sl.task_id IS NULL THEN 'insert' WHEN w.task_id IS NOT NULL AND (sl.cb_id IS DISTINCT FROM w.cb_id OR sl.rate_cb IS DISTINCT FROM w.rate_cb) THEN 'update' ELSE 'keep' END AS action, count(*) AS n, count(sl.rate) AS rated
FROM sending_list sl FULL JOIN ({WANTED}) w USING (task_id, contact_id) WHERE w.task_id IS NOT NULL OR sl.rate IS NOT NULL GROUP BY ALL""")
query("C6_candidates", lambda t: found(t).select("campaign_id", "contact_id", "rate", "rate_cb"), CANDIDATES)
query("C9_overview", lambda t: dashboards.overview(t.campaign, t.task, t.sending_list, t.contact, t.sending_log, t.click, AS_OF), f"""
SELECT c.id AS campaign_id, coalesce(s.sent, 0) AS sent, coalesce(v.viewers, 0) AS viewers, CASE WHEN s.sent > 0 THEN round(coalesce(v.viewers, 0) / s.sent, 6) ELSE 0 END AS viewed_share, coalesce(p.pending, 0) AS pending
FROM campaign c LEFT JOIN (SELECT campaign_id, count(*) AS sent FROM sending_log WHERE status = 'SEND' GROUP BY 1) s ON s.campaign_id = c.id
LEFT JOIN (SELECT lg.campaign_id, count(DISTINCT lg.contact_id) AS viewers FROM click k JOIN sending_log lg ON lg.id = k.letter_id GROUP BY 1) v ON v.campaign_id = c.id
LEFT JOIN (SELECT campaign_id, count(*) AS pending FROM ({CANDIDATES}) GROUP BY 1) p ON p.campaign_id = c.id""")
query("C10_stats_sending", lambda t: dashboards.sending_statistics(t.sending_log, t.contact), "SELECT lg.id, lg.campaign_id, lg.contact_id, coalesce(nullif(trim(c.company_name), ''), nullif(trim(c.email), ''), '—') AS name, lg.status, coalesce(lg.processed_at, lg.created_at) AS at FROM sending_log lg JOIN contact c ON c.id = lg.contact_id")
query("C11_contacts_page", lambda t: dashboards.contacts_page(t.sending_list, t.task, t.contact, t.sending_log, "ring", True, 2, 10).select("contact_id", "name", "any_removed", "any_listed", F.array_join("titles", "|").alias("titles"), F.size("sent_at").cast("long").alias("n_sent")), """
WITH f AS (SELECT contact_id, bool_or(coalesce(removed, false)) AS any_removed, bool_or(NOT coalesce(removed, false)) AS any_listed FROM sending_list GROUP BY 1),
m AS (SELECT c.id AS contact_id, coalesce(nullif(trim(company_name), ''), nullif(trim(email), ''), '—') AS name, any_removed, any_listed FROM contact c JOIN f ON f.contact_id = c.id WHERE any_removed AND (company_name ILIKE '%ring%' OR email ILIKE '%ring%')),
p AS (SELECT * FROM m ORDER BY contact_id LIMIT 10 OFFSET (SELECT (least(2, greatest(1, CAST(ceil(count(*) / 10.0) AS BIGINT))) - 1) * 10 FROM m))
SELECT p.*, (SELECT string_agg(DISTINCT t.title, '|' ORDER BY t.title) FROM sending_list sl JOIN task t ON t.id = sl.task_id WHERE sl.contact_id = p.contact_id) AS titles, (SELECT count(DISTINCT coalesce(processed_at, created_at)) FROM sending_log lg WHERE lg.status = 'SEND' AND lg.contact_id = p.contact_id) AS n_sent FROM p""")
query("C12_mailing_page", lambda t: dashboards.mailing_page(t.sending_list, t.task, t.contact, 31, "in", "", 1, 20), """
SELECT sl.contact_id, coalesce(nullif(trim(c.company_name), ''), '—') AS name, sl.rate, sl.rate_cb FROM sending_list sl JOIN task t ON t.id = sl.task_id JOIN contact c ON c.id = sl.contact_id
WHERE sl.task_id = 31 AND NOT coalesce(sl.removed, false) AND sl.rate <= t.rate_limit ORDER BY sl.rate, sl.rate_cb DESC NULLS LAST, sl.contact_id LIMIT 20""")

#: A window with a lunch break, a slot that overlaps, one that isn't a time and one that ends before it begins.
DAY_SLOTS = [("mon", [("09:00", "12:00"), ("13:00", "17:30")]), ("tue", [("08:00", "10:00"), ("09:30", "11:00")]), ("wed", [("25:00", "26:00")]), ("thu", [("10:00", "10:45"), ("12:00", "11:00")]), ("fri", [("07:15", "08:00")]), ("sat", []), ("hol", [("10:00", "10:20")])]


def paced(t: Tables) -> DataFrame:
    own = F.create_map(*[x for d, slots in DAY_SLOTS for x in (F.lit(d), F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in slots]).cast("array<struct<`from`:string,`to`:string>>"))])
    c = t.campaign.join(t.task.select(F.col("id").alias("sending_list_id"), "user_active", "archived"), "sending_list_id").withColumn("window", F.when(F.col("id") % 3 == 0, own).otherwise(F.map_filter(own, lambda k, v: k.isin("mon", "thu"))))
    m = t.campaign.select(F.col("mailbox_id").alias("id")).distinct().select("id", (F.col("id") % 61).cast("int").alias("limit_hour"), (F.col("id") * 10).cast("int").alias("limit_day"))
    return pacing.pace(c, m, NOW)


# Minutes by day ahead of Thursday 17 April 2025 (18 and 21 April are holidays): which days have a window, and its minutes.
query("C8_pacing", paced, """
WITH c AS (SELECT c.id AS campaign_id, c.mailbox_id, t.user_active, NOT t.archived AS pool, c.id % 3 = 0 AS whole FROM campaign c JOIN task t ON t.id = c.sending_list_id),
cal AS (SELECT * FROM (VALUES (0, 'thu'), (1, 'hol'), (2, 'sat'), (3, 'sun'), (4, 'hol'), (5, 'tue'), (6, 'wed'), (7, 'thu'), (8, 'fri'), (9, 'sat'), (10, 'sun'), (11, 'mon'), (12, 'tue'), (13, 'wed'), (14, 'hol')) v(ahead, k)),
mins AS (SELECT * FROM (VALUES ('mon', 450), ('tue', 210), ('thu', 45), ('fri', 45), ('hol', 20)) v(k, minutes)),
days AS (SELECT c.*, cal.ahead, mins.minutes FROM c, cal JOIN mins USING (k) WHERE c.pool AND (c.whole OR k IN ('mon', 'thu'))),
s AS (SELECT mailbox_id, ahead, CASE WHEN mailbox_id % 61 > 0 AND mailbox_id * 10 > 0 THEN CAST(ceil(greatest(sum(minutes) * 60000.0 / (mailbox_id * 10), count(*) * 3600000.0 / (mailbox_id % 61))) AS BIGINT) END AS iv FROM days GROUP BY mailbox_id, ahead),
d AS (SELECT days.*, s.iv FROM days JOIN s USING (mailbox_id, ahead)),
p AS (SELECT campaign_id, arg_min_null(iv, ahead) AS interval_ms, max(iv) FILTER (WHERE ahead = 0) AS iv0, arg_min_null(iv, ahead) FILTER (WHERE ahead > 0) AS iv1, arg_min(minutes, ahead) FILTER (WHERE ahead > 0) AS m1 FROM d GROUP BY 1)
SELECT c.campaign_id, c.pool AND c.user_active AS active, p.interval_ms,
  CASE WHEN p.iv0 > 0 OR p.iv1 > 0 THEN CAST(coalesce(floor(15 * 60000 / p.iv0), 0) + coalesce(floor(p.m1 * 60000 / p.iv1), 0) AS BIGINT) END AS to_send
FROM c LEFT JOIN p USING (campaign_id)""")
query("T14_timeline", lambda t: pacing.timeline(ranking.planned(found(t)), ranking.recent_sends(t.sending_log), "2002-01-01 09:00:00", 90_000).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")), f"""
WITH s AS (SELECT campaign_id, contact_id, sent_at, rn FROM (SELECT *, {RN.format('campaign_id', 'sent_at DESC, id DESC, contact_id')} FROM (SELECT *, coalesce(processed_at, created_at) AS sent_at FROM sending_log)) WHERE rn <= 3),
n AS (SELECT campaign_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT campaign_id, contact_id, rn FROM (SELECT *, {RN.format('campaign_id', SEND)} FROM ({CANDIDATES})) WHERE rn <= 8)
SELECT campaign_id, contact_id, strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS at, 'sent' AS kind, CAST(-rn AS INT) AS place FROM s -- latest first
UNION ALL SELECT p.campaign_id, p.contact_id, strftime(TIMESTAMP '2002-01-01 09:00:00' + (p.rn - 1) * INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S'), CASE WHEN p.rn = 1 THEN 'current' ELSE 'planned' END, CAST(p.rn AS INT) FROM p LEFT JOIN n USING (campaign_id) WHERE p.rn <= 5 - coalesce(n.n, 0)""")

# --- state machines --------------------------------------------------------------------------------------------------------

RESULTS = {"view": "OK", "click": "SEARCH HTTP 503", "signup": "FAILED TO PARSE", "purchase": "BLOCKED", "error": "AJAX HTTP 500"}


def crawl_results(t: Tables) -> DataFrame:
    """Results of crawled pairs, made up of events; a good result only now and then."""
    kind = F.col("event_type")
    result = F.when((kind == "view") & (F.col("event_id") % 4 > 0), "BLOCKED")
    for k, v in RESULTS.items():
        result = result.when(kind == k, v)
    return t.events.select(F.col("user_id").alias("cb_id"), F.col("event_id").alias("seq"), result.alias("result"))


query("T4_retry_fold", lambda t: machines.retry_fold(crawl_results(t)), """
WITH RECURSIVE e AS (
  SELECT user_id AS cb_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
    CASE WHEN event_type = 'view' AND event_id % 4 > 0 THEN 'BLOCKED' ELSE CASE event_type WHEN 'view' THEN 'OK' WHEN 'click' THEN 'SEARCH HTTP 503' WHEN 'signup' THEN 'FAILED TO PARSE' WHEN 'purchase' THEN 'BLOCKED' ELSE 'AJAX HTTP 500' END END AS result FROM events
), f(cb_id, n, error, collected) AS (
  SELECT DISTINCT cb_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), false FROM e
  UNION ALL
  SELECT f.cb_id, f.n + 1, CASE WHEN result = 'OK' THEN NULL WHEN result = 'BLOCKED' THEN error
    WHEN result LIKE '%HTTP%' THEN CASE error WHEN 'HTTP ERROR 1' THEN 'HTTP ERROR 2' WHEN 'HTTP ERROR 2' THEN result ELSE 'HTTP ERROR 1' END
    ELSE CASE error WHEN 'FAILED TO PARSE 1' THEN 'FAILED TO PARSE 2' WHEN 'FAILED TO PARSE 2' THEN 'FAILED TO PARSE' ELSE 'FAILED TO PARSE 1' END END,
    result = 'OK' OR (result LIKE '%HTTP%' AND coalesce(error, '') = 'HTTP ERROR 2') OR (result = 'FAILED TO PARSE' AND coalesce(error, '') = 'FAILED TO PARSE 2')
  FROM f JOIN e ON e.cb_id = f.cb_id AND e.n = f.n + 1 WHERE NOT f.collected
)
SELECT cb_id, arg_max_null(error, n) AS error, bool_or(collected) AS collected, CAST(max(n) AS INT) AS seen FROM f GROUP BY cb_id""")
query("T5_soft_bounce", lambda t: machines.soft_bounces(t.events.select(F.col("user_id").alias("contact_id"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "purchase", F.when(F.col("event_type") == "view", 550).otherwise(451)).alias("code")), 3, 1), """
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'view' THEN 550 ELSE 451 END AS code FROM events),
x AS (SELECT *, CASE WHEN code IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS s FROM e),
y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT DISTINCT user_id AS contact_id FROM (SELECT user_id, run FROM y WHERE code = 451 GROUP BY ALL HAVING count(*) >= 3)""")


def streamed_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click lines written to the shared folder, read as a stream, appended to a table, and counted by the hour."""
    folder = shared_folder(spark)
    t = Tables(spark, sf_dir)
    line = F.concat_ws("\t", F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.col("letter_id").cast("string"))
    t.click.select(line.alias("value")).union(t.click.limit(5).select(F.lit("no click").alias("value"))).write.text(f"{folder}/log")
    clicks.append(clicks.click_stream(spark, f"{folder}/log"), f"{folder}/table", f"{folder}/state").awaitTermination()
    rows = spark.read.parquet(f"{folder}/table")
    return rows.groupBy(F.date_format(F.date_trunc("hour", "time"), "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("clicks"), F.countDistinct("letter_id").alias("letters"))


QUERIES["T1_click_stream"] = streamed_clicks
ORACLES["T1_click_stream"] = with_ctes("SELECT strftime(date_trunc('hour', time), '%Y-%m-%d %H') AS hour, count(*) AS clicks, count(DISTINCT letter_id) AS letters FROM click GROUP BY 1")

# --- functions over texts and literals -------------------------------------------------------------------------------------

#: Addresses of contacts, many of them spoilt, and those that documents hold.
ADDRESSES = """
SELECT CONCAT(CASE id % 7 WHEN 1 THEN '.' WHEN 2 THEN 'mailto:' WHEN 3 THEN REPEAT('l', CAST(50 + id % 20 AS INT)) WHEN 4 THEN 'a..b' ELSE '' END, CASE id % 3 WHEN 0 THEN email ELSE TRIM(email) END,
  CASE id % 13 WHEN 1 THEN '@x' WHEN 2 THEN '..de' WHEN 3 THEN ' ' WHEN 4 THEN '?subject=x' WHEN 5 THEN '-' WHEN 6 THEN '_' WHEN 7 THEN CONCAT('.', REPEAT('d', CAST(50 + id % 20 AS INT))) WHEN 8 THEN '.' WHEN 9 THEN '.-x.de' ELSE '' END) AS m FROM contact"""


def addresses(t: Tables) -> DataFrame:
    return t.sql(ADDRESSES).union(t.documents.select(F.explode(text.emails_in(F.col("text"))))).distinct()


query("F_mail_syntax", lambda t: addresses(t).select("m", text.bad_email(F.col("m")).alias("bad"), text.clean_email(F.col("m")).alias("cleaned")), f"""
SELECT m, length(m) > 254 OR len(regexp_extract_all(m, '@')) <> 1 OR l = '' OR length(l) > 64 OR regexp_matches(m, '\\s') OR l LIKE '.%' OR l LIKE '%.' OR l LIKE '%..%' OR d NOT LIKE '%.%' OR NOT regexp_full_match(d, '[a-z0-9.-]+')
  OR len(list_filter(string_split(d, '.'), lambda x: x = '' OR length(x) > 63 OR x LIKE '-%' OR x LIKE '%-')) > 0 AS bad, CASE WHEN length(c) >= 5 AND c LIKE '%@%' AND string_split(c, '@')[-1] LIKE '%.%' THEN c END AS cleaned
FROM (SELECT m, split_part(m, '@', 1) AS l, lower(split_part(m, '@', 2)) AS d, trim(split_part(regexp_replace(trim(m), '^mailto:', ''), '?', 1)) AS c
  FROM ({ADDRESSES} UNION SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}')) FROM documents) v(m))""")
query("F_extract_emails", lambda t: t.documents.select("doc_id", F.array_join(text.emails_in(F.col("text")), "|").alias("emails"), F.size(text.urls_in(F.col("text"))).cast("long").alias("urls")).filter("emails <> '' or urls > 0"), r"""
SELECT doc_id, coalesce(array_to_string(list_distinct_in_order, '|'), '') AS emails, len(list_distinct(regexp_extract_all(text, 'https?://[^\s"''<>]+'))) AS urls
FROM (SELECT doc_id, text, list_filter(e, lambda x, i: list_position(e, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') AS e FROM documents)) WHERE len(list_distinct_in_order) > 0 OR regexp_matches(text, 'https?://[^\s"''<>]+')""")
query("F_clean_text", lambda t: t.documents.select("doc_id", F.md5(text.clean("text")).alias("h")), r"SELECT doc_id, md5(nullif(trim(regexp_replace(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '')) AS h FROM documents")
query("F_great_circle", lambda t: t.city.alias("a").join(t.city.alias("b"), F.expr("a.id < b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(geo.great_circle_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 4).alias("km")), "SELECT a.id AS a, b.id AS b, round(6371 * acos(least(1, greatest(-1, cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon) - radians(a.lon)) + sin(radians(a.lat)) * sin(radians(b.lat))))), 4) AS km FROM city a JOIN city b ON a.id < b.id")
query("F_city_and_plz", lambda t: t.contact.select("id", F.concat(F.lit("Ort "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ", Stadt").when(F.col("id") % 3 == 1, ", Nord").otherwise("")).alias("c")).select("id", text.city_name(F.col("c")).alias("name"), text.before_comma(F.col("c")).alias("head"), text.padded_plz(F.col("id").cast("string")).alias("plz")), "SELECT id, CASE WHEN id % 3 = 1 THEN concat('Ort ', id, ', Nord') ELSE concat('Ort ', id) END AS name, concat('Ort ', id) AS head, CASE WHEN length(CAST(id AS VARCHAR)) >= 5 THEN CAST(id AS VARCHAR) ELSE lpad(CAST(id AS VARCHAR), 5, '0') END AS plz FROM contact")
query("F_phone_url", lambda t: t.contact.select("id", F.concat(F.lit("tel:+49 "), F.expr("id * 37 % 100000"), F.lit("?x")).alias("p"), F.when(F.col("id") % 4 == 0, "javascript:void(0)").when(F.col("id") % 4 == 1, F.concat(F.lit(" https://a.de/"), F.col("id"), F.lit("/ "))).when(F.col("id") % 4 == 2, "b.de/x").otherwise("no link").alias("u")).select("id", text.clean_phone(F.col("p")).alias("phone"), text.clean_url(F.col("u")).alias("url"), text.link_label(text.clean_url(F.col("u"))).alias("label")), "SELECT id, CASE WHEN id * 37 % 100000 >= 1000 THEN concat('+49 ', id * 37 % 100000) END AS phone, CASE id % 4 WHEN 1 THEN concat('https://a.de/', id, '/') WHEN 2 THEN 'b.de/x' END AS url, CASE id % 4 WHEN 1 THEN concat('a.de/', id) WHEN 2 THEN 'b.de/x' END AS label FROM contact")

# --- beyond SQL ------------------------------------------------------------------------------------------------------------

query("F_h64", lambda t: t.contact.select("id", hashing.h64(F.col("company_name")).alias("h")), None)
query("F_html_text", lambda t: t.pages.select("page_id", letters.page_text_udf("html").alias("text")), None)
query("F_sanitize", lambda t: t.pages.select("page_id", letters.sanitize_udf("html").alias("html"), letters.plain_udf("html").alias("text")), None)
query("X1_cards", lambda t: cards.cards(t.pages), None)
query("X2_index_links", lambda t: cards.index_links(t.pages), None)


def raw_cards(t: Tables) -> DataFrame:
    """Cards made up of parts and their suppliers: several for each address, some of them bad. Of lines with one number, the one
    with the least part, pair and flag is the card."""
    one = t.li.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min(F.struct("l_partkey", "cb_id", "l_suppkey", "l_returnflag", "l_linenumber")).alias("li")).select("id", "li.*")
    return one.select(
        "id", "cb_id",
        F.when(F.col("l_partkey") % 11 == 0, "").when(F.col("l_partkey") % 13 == 0, "broken@@x").otherwise(F.concat(F.lit(" Info"), (F.col("l_partkey") % 97).cast("string"), F.lit("@Example.de"))).alias("email"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Firma "), F.col("l_suppkey").cast("string"))).alias("company_name"),
        F.concat(F.lit("Ort "), (F.col("l_suppkey") % 9).cast("string")).alias("city"), F.lit(None).cast("string").alias("land"),
        F.array(F.concat(F.lit("0"), (F.col("l_suppkey") % 5).cast("string"))).alias("phones"), F.array().cast("array<string>").alias("websites"),
        F.array(F.col("l_returnflag")).alias("categories"), F.concat(F.lit("Text "), (F.col("l_suppkey") % 3).cast("string")).alias("description"),
    )


LINES = "SELECT DISTINCT ON (l_orderkey * 10 + l_linenumber) l_orderkey, l_linenumber, l_partkey, cb_id, l_suppkey, l_returnflag FROM li ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, cb_id, l_suppkey, l_returnflag"
# Valid cards; {late} tells those of a second batch, which comes after the first.
CARDS = f"""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN {{late}} THEN 1 ELSE 0 END * 9007199254740992 + l_orderkey * 10 + l_linenumber AS o, cb_id, concat('info', l_partkey % 97, '@example.de') AS email,
  CASE WHEN l_linenumber % 3 = 0 THEN concat('Firma ', l_suppkey) END AS company_name, concat('Ort ', l_suppkey % 9) AS city, concat('0', l_suppkey % 5) AS phones, l_returnflag AS categories, concat('Text ', l_suppkey % 3) AS description
  FROM ({LINES}) WHERE l_partkey % 11 <> 0 AND l_partkey % 13 <> 0"""
RESOLVED = f"""
WITH c AS ({CARDS}), {", ".join(f"{x}_of AS (SELECT email, list(v ORDER BY o) AS {x} FROM (SELECT email, {x} AS v, min(o) AS o FROM c GROUP BY 1, 2) GROUP BY 1)" for x in ("phones", "categories", "description"))},
  pairs_of AS (SELECT email, list(concat(cb_id, ':', id) ORDER BY cb_id) AS pairs FROM (SELECT email, cb_id, max(id) AS id FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT email, company_name, city, phones, categories, array_to_string(description, chr(10) || chr(10)) AS description, n_cards, pairs
FROM (SELECT email, arg_min(company_name, o) FILTER (WHERE company_name IS NOT NULL) AS company_name, arg_min(city, o) AS city, count(*) AS n_cards FROM c GROUP BY 1)
JOIN phones_of USING (email) JOIN categories_of USING (email) JOIN description_of USING (email) JOIN pairs_of USING (email)"""


def resolved(contacts: DataFrame) -> DataFrame:
    pairs = F.transform("pairs", lambda p: F.concat_ws(":", p["cb_id"], p["card_id"]))
    return contacts.select("email", "company_name", "city", "phones", "categories", "description", "n_cards", pairs.alias("pairs"))


def in_two_batches(t: Tables) -> DataFrame:
    """The first two lines of each order are resolved before the later ones come."""
    late = F.col("id") % 10 > 2
    held = resolution.resolve(raw_cards(t).filter(~late))
    changed = resolution.resolve_into(held, raw_cards(t).filter(late))
    return changed.unionByName(joins.missing(held, changed, ["email"]))


query("C3_outcome", lambda t: resolution.outcome(raw_cards(t), t.contact.select("email")), f"""
WITH c AS (SELECT CASE WHEN l_partkey % 11 = 0 THEN 'EMPTY' WHEN l_partkey % 13 = 0 THEN 'INVALID' ELSE 'OK' END AS verdict, concat('info', l_partkey % 97, '@example.de') AS email FROM ({LINES})),
  n AS (SELECT email, count(*) AS n, CASE WHEN email IN (SELECT lower(trim(email)) FROM contact) THEN 0 ELSE 1 END AS made FROM c WHERE verdict = 'OK' GROUP BY 1)
SELECT verdict AS outcome, count(*) AS n FROM c WHERE verdict <> 'OK' GROUP BY 1 UNION ALL SELECT 'CREATED', CAST(sum(made) AS BIGINT) FROM n HAVING sum(made) > 0 UNION ALL SELECT 'UPDATED', CAST(sum(n - made) AS BIGINT) FROM n HAVING sum(n - made) > 0""")
query("C3_resolution", lambda t: resolved(resolution.resolve(raw_cards(t))), RESOLVED.format(late="false"))
query("T2_incremental", lambda t: resolved(in_two_batches(t)), RESOLVED.format(late="l_linenumber > 2"))

# --- replies and returned mail ---------------------------------------------------------------------------------------------

FAR = 10**12  # beyond all letters


def letters_of(t: Tables) -> DataFrame:
    return t.sending_log.groupBy("id").agg(F.min("contact_id").alias("contact_id"), F.min("campaign_id").alias("campaign_id"))


def raw_mails(t: Tables) -> DataFrame:
    """A mail for each letter, of seven kinds: foreign, about an unknown letter, returned for good or for now, an angry answer in HTML,
    an automatic one in Latin-1, a plain one."""
    k = F.col("id") % 7
    mark = F.concat(F.lit(f"{text.MARKS[0]}: Marktlens 1\r\n{text.MARKS[1]}: "), F.when(k == 1, F.col("id") + FAR).otherwise(F.col("id")).cast("string"), F.lit("\r\n"))
    html = "Content-Type: multipart/alternative; boundary=cut\r\n\r\n--cut\r\nContent-Type: text/plain\r\n\r\nkurz\r\n--cut\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<style>p {}</style><p>St=C3=B6rt <b>nie</b> wieder</p>\r\n--cut--\r\n"
    away = "Content-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: base64\r\n\r\nQvxybyBpbSBVcmxhdWI=\r\n"
    body = F.when(k == 0, F.lit("\r\nHallo\r\n")).when(k == 2, F.lit("\r\nStatus: 5.1.1\r\n")).when(k == 3, F.lit("\r\nDiagnostic-Code: smtp; 451 later\r\n")).when(k == 4, html).when(k == 5, away).otherwise(F.concat(F.lit("\r\nGern, Nummer "), F.col("id").cast("string"), F.lit("\r\n")))
    mail = F.concat(F.lit("From: a@x.de\r\nDate: Thu, 17 Apr 2025 10:30:00 +0200\r\n"), F.when(k == 0, "").otherwise(mark), body)
    return letters_of(t).select((F.col("campaign_id") % 50).alias("mailbox_id"), F.lit("INBOX").alias("folder"), F.col("id").cast("string").alias("uid"), F.encode(mail, "UTF-8").alias("raw"))


def judged(rows: DataFrame) -> DataFrame:
    """A stand-in for the two questions to a model."""
    return rows.withColumn("angry", F.when(F.contains("asked", F.lit("nie wieder")), "Yes.").otherwise("no")).withColumn("automatic", F.when(F.contains("asked", F.lit("Urlaub")), "yes, it is").otherwise("No"))


def sorted_out(t: Tables) -> DataFrame:
    return replies.sort_out(mails.read_mails(raw_mails(t)), letters_of(t), "marktlens", judged, NOW)


def returned(t: Tables) -> DataFrame:
    log, contact, listed = replies.effects(sorted_out(t), t.sending_log, t.contact, t.sending_list)
    figures = [log.agg(F.count_if(F.col("status") == "BAD_ADDRESS").alias("bad_letters")), contact.agg(F.count_if(F.col("wrong_email")).alias("wrong")), listed.agg(F.count_if(F.col("removed")).alias("removed"))]
    return figures[0].join(figures[1]).join(figures[2])  # a row each


LETTERS = "SELECT id, min(contact_id) AS contact_id, min(campaign_id) % 50 AS mailbox_id, id % 7 AS k FROM sending_log GROUP BY id"
query("C17_replies", lambda t: sorted_out(t).select("mailbox_id", "uid", "letter_id", "kind", "asked", F.date_format("sent_at", "yyyy-MM-dd HH:mm").alias("at")), f"""
SELECT mailbox_id, CAST(id AS VARCHAR) AS uid, CASE k WHEN 0 THEN NULL WHEN 1 THEN id + {FAR} ELSE id END AS letter_id,
  CASE k WHEN 0 THEN 'FOREIGN' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'HARD' WHEN 3 THEN 'SOFT' WHEN 4 THEN 'ANGRY_CONTACT' WHEN 5 THEN 'AUTO_RESPONSE' ELSE 'ANSWER' END AS kind,
  CASE k WHEN 4 THEN 'Stört nie wieder' WHEN 5 THEN 'Büro im Urlaub' WHEN 6 THEN concat('Gern, Nummer ', id) END AS asked, '2025-04-17 08:30' AS at FROM ({LETTERS})""")
query("C17_effects", returned, f"""
WITH hit AS (SELECT DISTINCT contact_id FROM sending_log WHERE id % 7 = 2)
SELECT (SELECT count(*) FROM sending_log WHERE status = 'BAD_ADDRESS' OR id % 7 = 2) AS bad_letters, (SELECT count(*) FROM contact WHERE wrong_email OR id IN (SELECT contact_id FROM hit)) AS wrong,
  (SELECT count(*) FROM sending_list WHERE removed OR contact_id IN (SELECT contact_id FROM hit)) AS removed""")
query("A27_mailbox_counters", lambda t: replies.counters(sorted_out(t)), f"SELECT mailbox_id, count(*) AS seen, count(*) FILTER (WHERE k > 1) AS ours, count(*) FILTER (WHERE k IN (2, 3)) AS returned, count(*) FILTER (WHERE k = 2) AS blocked FROM ({LETTERS}) GROUP BY 1")
query("T8_unseen_mails", lambda t: replies.fresh(raw_mails(t), raw_mails(t).filter("cast(uid as long) % 5 = 0").select("mailbox_id", F.lower("folder").alias("folder"), "uid", (F.lit(NOW).cast("timestamp") - F.make_dt_interval((F.col("uid").cast("long") % 14).cast("int"))).alias("at")), NOW).select("mailbox_id", "uid"), f"SELECT mailbox_id, CAST(id AS VARCHAR) AS uid FROM ({LETTERS}) WHERE NOT (id % 5 = 0 AND id % 14 < 7)")
query("F_answer_json", lambda t: t.orders.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "```json\n").when(F.col("o_orderkey") % 3 == 1, "Here: ").otherwise(""), F.lit('{"items": [{"id": '), F.col("o_custkey"), F.lit(', "rate": 5}]'), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("}"), F.when(F.col("o_orderkey") % 3 == 0, "\n```").otherwise(""))
    .alias("a")).select("o_orderkey", F.get_json_object(text.answer_json(F.col("a")), "$.items[0].id").cast("long").alias("id"), text.json_object(F.col("a")).alias("safe")), """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 2 THEN concat('{"items": [{"id": ', o_custkey, ', "rate": 5}]}') ELSE '{}' END AS safe FROM orders""")
query("L11_drawn_contacts", lambda t: ranking.drawn(t.contact.filter("not blocked"), "id", 25, 7).select("id", "place"), "SELECT id, CAST(row_number() OVER (ORDER BY md5(concat('7:', id)), id) AS INT) AS place FROM contact WHERE NOT blocked ORDER BY md5(concat('7:', id)), id LIMIT 25")

# --- rating, dispatch, snapshots -------------------------------------------------------------------------------------------


def scored(batch: DataFrame) -> DataFrame:
    """A stand-in for the external scorer; some of its answers are out of range."""
    return batch.withColumn("rate", (F.col("contact_id") * 7 % 100 + F.when(F.col("task_id") % 10 == 0, 50).otherwise(1)).cast("int"))


query("C14_rating", lambda t: rating.rate_batch(ranking.rating_batch(t.sending_list, t.task, t.workspace), scored), f"""
WITH b AS (SELECT task_id, contact_id, CAST(contact_id * 7 % 100 + CASE WHEN task_id % 10 = 0 THEN 50 ELSE 1 END AS INT) AS rate FROM (SELECT sl.task_id, sl.contact_id, w.access_type, {RN.format('sl.task_id', 'sl.rate_cb ASC NULLS LAST, sl.contact_id')} FROM sending_list sl JOIN task t ON t.id = sl.task_id JOIN workspace w ON w.id = t.workspace_id WHERE NOT coalesce(sl.removed, false) AND sl.rate IS NULL) WHERE rn <= CASE WHEN access_type = 'test' THEN 20 ELSE 50 END)
SELECT * FROM b WHERE task_id NOT IN (SELECT task_id FROM b WHERE rate NOT BETWEEN 1 AND 100)""")
query("C15_city_batch", lambda t: rating.city_batch(t.task_city_rating).select("task_id", "city_id", "rn"), f"SELECT task_id, city_id, CAST(rn AS INT) AS rn FROM (SELECT task_id, city_id, {RN.format('task_id', 'city_id')} FROM task_city_rating WHERE rate IS NULL AND task_id IN (SELECT DISTINCT task_id FROM task_city_rating WHERE rate IS NULL ORDER BY task_id LIMIT 200)) WHERE rn <= 50")
query("T12_dispatch", lambda t: rating.dispatch(joins.pair_queue(t.task_pair, t.pair, t.plz, t.branch), {"gs": 40}, 15).select("catalog", "task_id", "id", "rn"), f"""
SELECT catalog, task_id, id, CAST(rn AS INT) AS rn FROM (SELECT *, {RN.format('catalog', 'rate ASC NULLS LAST, id')} FROM (SELECT task_id, id, rate, catalog FROM (SELECT tp.task_id, tp.id, tp.rate, b.catalog, {RN.format('tp.task_id', 'tp.rate ASC NULLS LAST, tp.id')} FROM task_pair tp JOIN pair p ON p.id = tp.cb_id JOIN plz z ON z.id = p.plz_id JOIN branch b ON b.id = p.branch_id WHERE p.collected = false) WHERE rn <= 10)) WHERE rn <= CASE WHEN catalog = 'gs' THEN 40 ELSE 15 END""")
query("T9_held_back", lambda t: rating.held_back(t.sending_list.filter("rate is null").groupBy("task_id").agg(F.min("updated_at").alias("first_seen"), F.count("*").alias("n")), "1998-06-01 00:00:00").select("task_id", "n"), "SELECT task_id, n FROM (SELECT task_id, min(updated_at) AS first_seen, count(*) AS n FROM sending_list WHERE rate IS NULL GROUP BY 1) WHERE n >= 15 OR first_seen <= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 15 MINUTE")
query("T3_stale_snapshots", lambda t: ag.fingerprint_text(t.task_city_rating, "city_id").select("task_id", F.md5("fingerprint").alias("h")).join(ag.fingerprint_text(t.task_city_rating.withColumn("rate", F.when(F.col("task_id") % 4 == 0, F.lit(5)).otherwise(F.col("rate"))), "city_id").select("task_id", F.md5("fingerprint").alias("stored")), "task_id").filter(filters.changed("h", "stored")).select("task_id", "h"), """
WITH f AS (SELECT task_id, string_agg(concat(city_id, ':', coalesce(CAST(rate AS VARCHAR), '')), '|' ORDER BY city_id) AS a, string_agg(concat(city_id, ':', coalesce(CAST(CASE WHEN task_id % 4 = 0 THEN 5 ELSE rate END AS VARCHAR), '')), '|' ORDER BY city_id) AS b FROM task_city_rating GROUP BY 1)
SELECT task_id, md5(a) AS h FROM f WHERE a <> b""")
query("T8_first_seen", lambda t: t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_at"), F.count("*").alias("n")), "SELECT user_id, event_type, min(ts) AS first_at, count(*) AS n FROM events GROUP BY ALL")
query("J14_unrated_counts", lambda t: t.task.select(F.col("id").alias("task_id")).join(t.task_city_rating.filter("rate is null").groupBy("task_id").agg(F.count("*").alias("unrated")), "task_id", "left").fillna(0, ["unrated"]), "SELECT id AS task_id, (SELECT count(*) FROM task_city_rating r WHERE r.task_id = t.id AND r.rate IS NULL) AS unrated FROM task t")
query("J16_task_access", lambda t: t.task.join(t.workspace.select(F.col("id").alias("workspace_id"), "access_type"), "workspace_id").select(F.col("id").alias("task_id"), "access_type", "rate_limit"), "SELECT t.id AS task_id, w.access_type, t.rate_limit FROM task t JOIN workspace w ON w.id = t.workspace_id")
query("L10_test_contacts", lambda t: ranking.first_rows(t.sending_list.join(t.task.select(F.col("id").alias("task_id"), "rate_limit"), "task_id").join(t.contact.select(F.col("id").alias("contact_id"), "email", "blocked", "wrong_email"), "contact_id").filter(filters.eligible()).filter("trim(email) <> ''"), ["task_id"], ranking.send_order(), 10).select("task_id", "contact_id", "rn"), f"SELECT task_id, contact_id, CAST(rn AS INT) AS rn FROM (SELECT sl.task_id, sl.contact_id, {RN.format('sl.task_id', 'sl.rate ASC NULLS LAST, sl.rate_cb ASC NULLS LAST, sl.contact_id')} FROM sending_list sl JOIN task t ON t.id = sl.task_id JOIN contact c ON c.id = sl.contact_id WHERE NOT coalesce(sl.removed, false) AND sl.rate <= t.rate_limit AND NOT coalesce(c.blocked, false) AND NOT coalesce(c.wrong_email, false) AND trim(c.email) <> '') WHERE rn <= 10")
query("L8_list_page", lambda t: ranking.page(t.sending_list.filter("task_id = 31").select("contact_id", "rate", "rate_cb"), ranking.send_order(), 2, 10), "SELECT contact_id, rate, rate_cb FROM sending_list WHERE task_id = 31 ORDER BY rate ASC NULLS LAST, rate_cb ASC NULLS LAST, contact_id LIMIT 10 OFFSET (SELECT (least(2, greatest(1, CAST(ceil(count(*) / 10.0) AS BIGINT))) - 1) * 10 FROM sending_list WHERE task_id = 31)")
query("P2_null_flags", lambda t: t.contact.agg(F.count_if(filters.is_false("wrong_email")).alias("good"), F.count_if(F.col("wrong_email").isNull()).alias("unknown")), "SELECT count(*) FILTER (WHERE NOT coalesce(wrong_email, false)) AS good, count(*) FILTER (WHERE wrong_email IS NULL) AS unknown FROM contact")

# beyond the domain: clicks by the hour and sessions, as the streams count them
query("X_click_windows", lambda t: t.click.groupBy(F.window(F.col("time").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("clicks")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "clicks"), "SELECT strftime(date_trunc('hour', time), '%Y-%m-%d %H:%M') AS start, count(*) AS clicks FROM click GROUP BY 1")
