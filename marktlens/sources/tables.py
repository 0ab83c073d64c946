"""Domain views (workspaces, tasks, contacts, pairs, lists, campaigns, logs) over the benchmark's star schema.

Each view is one SQL projection that Spark and DuckDB both accept, so that a query and its oracle read the same definition:
Spark gets it as a lazily planned temporary view, DuckDB as a common table expression.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> SELECT; a view may use the base tables and any view above it. Text type: VARCHAR (STRING in Spark).
VIEWS: dict[str, str] = {
    "workspace": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS company_name, CASE n_nationkey % 6 WHEN 0 THEN 'full' WHEN 1 THEN 'test' WHEN 2 THEN 'stat_only' WHEN 3 THEN 'closed' WHEN 4 THEN 'super' ELSE 'custom' END AS access_type FROM nation",
    "task": "SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS workspace_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS type, CAST(20 + c_custkey % 41 AS INT) AS rate_limit, c_custkey % 11 = 0 AS archived, c_custkey % 7 <> 0 AS user_active FROM customer",
    "contact": "SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS company_name, CONCAT(' Info', CAST(p_partkey AS VARCHAR), '@Example.de') AS email, p_partkey % 17 = 0 AS blocked, CASE WHEN p_partkey % 19 = 0 THEN TRUE WHEN p_partkey % 3 = 0 THEN NULL ELSE FALSE END AS wrong_email FROM part",
    "city": "SELECT n_nationkey AS id, n_name AS name, r_name AS state_name, CAST((n_nationkey + 1) * 37000 AS INT) AS pop_total, 47.3 + (n_nationkey % 8) * 0.97 AS lat, 5.9 + (n_nationkey % 7) * 1.3 AS lon FROM nation JOIN region ON n_regionkey = r_regionkey",
    "plz": "SELECT s_suppkey AS id, LPAD(CAST(s_suppkey * 97 % 100000 AS VARCHAR), 5, '0') AS plz, s_nationkey FROM supplier",
    "city_plz": "SELECT s_nationkey AS city_id, plz FROM plz UNION ALL SELECT (s_nationkey + 1) % 25 AS city_id, plz FROM plz WHERE id % 10 = 0",
    "branch": "SELECT DISTINCT CAST(p_size AS BIGINT) AS id, CONCAT('Branche ', CAST(p_size AS VARCHAR)) AS branch_name, CASE WHEN p_size % 2 = 0 THEN 'gs' ELSE '11880' END AS catalog FROM part",
    "task_city_rating": "SELECT o_custkey AS task_id, o_orderkey % 25 AS city_id, MIN(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 1 + o_orderkey * 7 % 100 END) AS rate FROM orders GROUP BY o_custkey, o_orderkey % 25",
    "task_branch_rating": "SELECT o_custkey AS task_id, 1 + o_orderkey % 50 AS branch_id, MIN(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1 + o_orderkey * 3 % 20 END) AS rate FROM orders GROUP BY o_custkey, 1 + o_orderkey % 50",
    "li": "SELECT l.*, o_custkey, o_orderdate, p_size, l_suppkey * 100 + p_size AS cb_id FROM lineitem l JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey",
    "pair": "SELECT cb_id AS id, MIN(l_suppkey) AS plz_id, CAST(MIN(p_size) AS BIGINT) AS branch_id, cb_id % 16 <> 0 AS collected FROM li GROUP BY cb_id",
    "task_pair": "SELECT o_custkey * 1000000 + cb_id AS id, o_custkey AS task_id, cb_id, MIN(CASE WHEN l_linenumber >= 6 THEN NULL ELSE CAST(l_quantity AS INT) END) AS rate FROM li GROUP BY o_custkey, cb_id",
    "pair_contact": "SELECT DISTINCT l_partkey AS contact_id, cb_id FROM li",
    "sending_list": "SELECT o_custkey AS task_id, l_partkey AS contact_id, MIN(cb_id) AS cb_id, MIN(CAST(l_quantity AS INT)) AS rate_cb, MIN(CASE WHEN l_linenumber >= 4 THEN NULL ELSE 1 + CAST(l_quantity AS INT) * 2 % 100 END) AS rate, MAX(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END) = 1 AS removed, MAX(l_shipdate) AS updated_at FROM li GROUP BY o_custkey, l_partkey",
    "campaign": "SELECT c_custkey * 10 + k AS id, CAST(c_nationkey AS VARCHAR) AS workspace_id, c_custkey AS sending_list_id, CASE WHEN k = 2 THEN c_custkey * 10 + 1 END AS campaign_parent_id, 30 AS send_after_parent_days, c_custkey % 50 + 1 AS mailbox_id FROM customer CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) kk",
    "sending_log": "SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey * 10 + 1 AS campaign_id, l_partkey AS contact_id, l_linestatus = 'F' AS processed, CASE WHEN l_returnflag = 'A' THEN 'BAD_ADDRESS' ELSE 'SEND' END AS status, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS processed_at, o_orderdate AS created_at FROM li WHERE l_linenumber <= 2",
    "click": "SELECT event_id % (SELECT COUNT(*) FROM orders) * 10 + 1 AS letter_id, ts AS time FROM events WHERE event_type IN ('click','view')",
    "mailbox_event": "SELECT user_id AS mailbox_id, CASE event_type WHEN 'view' THEN 'SMTP_AUTH_CHECK' WHEN 'click' THEN 'SMTP_SEND_CHECK' WHEN 'error' THEN 'IMAP_CHECK' WHEN 'signup' THEN 'DOMAIN_CHECK_TECH' ELSE 'DOMAIN_CHECK_REPUTATION' END AS action, CASE WHEN value < 10 THEN 'FAIL' ELSE 'SUCCESS' END AS status, ts AS created_at, event_id FROM events",
}


def needed(sql: str) -> list[str]:
    """The views that a statement uses, directly or through others, in order of definition."""
    words = set(re.findall(r"\w+", sql))
    for name in reversed(VIEWS):
        if name in words:
            words |= set(re.findall(r"\w+", VIEWS[name]))
    return [name for name in VIEWS if name in words]


def with_ctes(sql: str) -> str:
    """The statement with the views it needs as leading common table expressions, for DuckDB."""
    heads = [f"{name} AS ({VIEWS[name]})" for name in needed(sql)]
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ",\n".join([*heads, body[len(start) :]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The tables and views of one folder: attribute access gives a DataFrame, sql() runs a statement over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self._run(VIEWS[name])
            else:
                self._made[name] = base(self._spark, self._dir, name)
        return self._made[name]

    def _run(self, sql: str) -> DataFrame:
        used = {m[1] for m in re.finditer(r"(?i)\b(?:FROM|JOIN)\s+(\w+)", sql)}
        frames = {n: getattr(self, n) for n in [*BASE, *VIEWS] if n in used}
        for n in frames:
            sql = re.sub(rf"(?i)(\b(?:FROM|JOIN)\s+){n}\b", rf"\1{{{n}}}", sql)
        return self._spark.sql(re.sub(r"\bVARCHAR\b", "STRING", sql), **frames)

    def sql(self, statement: str) -> DataFrame:
        return self._run(statement)


def shared_folder(spark: SparkSession) -> str:
    """A new folder within the one that driver and executors share (spark.checkpoint.dir). A cluster has to name one; only a local master
    gets one of its own, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp()}/tables-{uuid.uuid4().hex}"
