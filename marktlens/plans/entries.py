"""Further registered queries: the geography of a register, reloads, claims, states with an expiry, pacing, texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktlens.functions import hashing, letters, nested, text, websites
from marktlens.functions import window_time as wt
from marktlens.operators import joins, merge, ranking, titles
from marktlens.parsing import catalogs
from marktlens.plans import catalog, geography, pacing, resolution
from marktlens.plans.catalog import NOW, ORACLES, QUERIES, query
from marktlens.sources import versions
from marktlens.sources.tables import Tables, shared_folder, with_ctes
from marktlens.streaming import claims, expiring

# --- geography -------------------------------------------------------------------------------------------------------------

#: A register made of customers (three rows for each municipality, with gaps) and suppliers (units above, not all of them).
REGISTER = """
SELECT CAST(60 AS INT) AS record, CAST(1 + k % 7 AS INT) AS land, CAST(k % 3 AS INT) AS rb, CAST(k % 11 AS INT) AS kreis, CAST(floor(k / 7.0) AS INT) % 4 AS vb, CAST(k % 997 AS INT) AS gem,
  CASE WHEN c % 5 > 0 THEN name END AS name, CASE WHEN c % 4 > 0 THEN k % 400 / 4.0e0 END AS area_km2, CASE WHEN c % 6 > 0 THEN k * 37 % 90000 END AS pop_total, k * 17 % 45000 AS pop_male, k * 19 % 45000 AS pop_female, CASE WHEN c % 3 > 0 THEN k % 100 / 2.0e0 END AS pop_density,
  CASE WHEN c % 10 > 0 THEN CAST(c * 97 % 100000 AS VARCHAR) END AS plz, CASE WHEN k % 13 > 0 THEN 5.9e0 + k * 53 % 8999 / 1000.0e0 END AS lon, CASE WHEN k % 13 > 0 THEN 47.3e0 + k * 37 % 7919 / 1000.0e0 END AS lat,
  CAST(k % 3 AS VARCHAR) AS urban_code, CONCAT('Typ ', CAST(k % 3 AS VARCHAR)) AS urban_name, CAST(k % 5 AS VARCHAR) AS travel_code, CONCAT('Gebiet ', CAST(c % 5 AS VARCHAR)) AS travel_name, c AS pos
FROM (SELECT c_custkey AS c, CAST(floor(c_custkey / 3.0) AS BIGINT) AS k, c_name AS name FROM customer) x
UNION ALL
SELECT CAST(u.record AS INT), CAST(1 + s_suppkey % CASE WHEN u.record = 10 THEN 9 ELSE 7 END AS INT), CASE WHEN u.record > 10 THEN CAST(s_suppkey % 3 AS INT) END, CASE WHEN u.record > 10 THEN CAST(s_suppkey % 11 AS INT) END, CASE WHEN u.record = 50 THEN CAST(1 + s_suppkey % 3 AS INT) END, CAST(NULL AS INT),
  CONCAT(s_name, ' ', CAST(u.record AS VARCHAR)), s_suppkey / 4.0e0, s_suppkey * 1000, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, s_suppkey
FROM supplier CROSS JOIN (SELECT 10 AS record UNION ALL SELECT 40 UNION ALL SELECT 50) u WHERE s_suppkey % 9 <> 3"""
POINTS = "SELECT LPAD(CAST(s_suppkey * 97 % 1000 AS VARCHAR), 5, '0') AS plz, 47.3e0 + s_suppkey * 71 % 7919 / 1000.0e0 AS lat, 5.9e0 + s_suppkey * 43 % 8999 / 1000.0e0 AS lon FROM supplier"


def built(t: Tables) -> dict[str, DataFrame]:
    made = geography.build(t.sql(REGISTER), t.sql(POINTS))
    return made | {"cities": made["cities"].withColumn("plz_list", F.array_join("plz_list", ","))}


GEO = f"""
WITH reg AS ({REGISTER}), c AS (
  SELECT land, rb, kreis, vb, gem, {", ".join(f"arg_min({x}, pos) FILTER (WHERE {x} IS NOT NULL) AS {x}" for x in geography.FACTS)}, coalesce(string_agg(DISTINCT lpad(plz, 5, '0'), ',' ORDER BY lpad(plz, 5, '0')), '') AS plz_list,
    CAST(concat(land, rb, lpad(CAST(kreis AS VARCHAR), 2, '0'), lpad(CAST(vb AS VARCHAR), 4, '0'), lpad(CAST(gem AS VARCHAR), 3, '0')) AS BIGINT) AS id
  FROM reg WHERE record = 60 GROUP BY ALL
), l AS (SELECT DISTINCT ON (land) land, name, area_km2, pop_total FROM reg WHERE record = 10 ORDER BY land, pos),
r AS (SELECT DISTINCT ON (land, rb) land, rb, name, area_km2, pop_total FROM reg WHERE rb <> 0 ORDER BY land, rb, record, pos),
k AS (SELECT DISTINCT ON (land, rb, kreis) land, rb, kreis, name, area_km2, pop_total FROM reg WHERE record = 40 ORDER BY land, rb, kreis, pos),
v AS (SELECT DISTINCT ON (land, rb, kreis, vb) land, rb, kreis, vb, name, area_km2, pop_total FROM reg WHERE record = 50 ORDER BY land, rb, kreis, vb, pos)
"""
for _table, _alias, _keys in (("states", "l", ["land"]), ("regions", "r", ["land", "rb"]), ("districts", "k", ["land", "rb", "kreis"]), ("subdistricts", "v", ["land", "rb", "kreis", "vb"])):
    _by = ", ".join(_keys)
    query(f"C1_{_table}", lambda t, _table=_table: built(t)[_table], f"""{GEO}
SELECT {_by}, name, CASE WHEN n > 0 THEN s.area_km2 ELSE {_alias}.area_km2 END AS area_km2, CASE WHEN n > 0 THEN s.pop_total ELSE {_alias}.pop_total END AS pop_total
FROM {_alias} LEFT JOIN (SELECT {_by}, count(*) AS n, sum(area_km2) AS area_km2, CAST(sum(pop_total) AS BIGINT) AS pop_total FROM c GROUP BY ALL) s USING ({_by})""")
query("C1_cities", lambda t: built(t)["cities"], f"""{GEO}, p AS ({POINTS}),
near AS (SELECT plz, arg_min(c.id, (pow(c.lat - p.lat, 2) + pow(c.lon - p.lon, 2), c.id)) AS id FROM p, c WHERE c.lat IS NOT NULL GROUP BY p.plz, p.lat, p.lon),
codes AS (SELECT id, string_agg(DISTINCT plz, ',' ORDER BY plz) AS codes FROM near GROUP BY id)
SELECT c.* EXCLUDE (plz_list), coalesce(codes, plz_list) AS plz_list, coalesce(l.name, concat('Land ', c.land)) AS state_name, coalesce(r.name, concat('RB ', c.rb)) AS region_name, coalesce(k.name, concat('Kreis ', c.kreis)) AS district_name,
  CASE WHEN c.vb <> 0 THEN coalesce(v.name, concat('VB ', c.vb)) END AS subdistrict_name
FROM c LEFT JOIN l USING (land) LEFT JOIN r ON r.land = c.land AND r.rb = c.rb LEFT JOIN k ON k.land = c.land AND k.rb = c.rb AND k.kreis = c.kreis LEFT JOIN v ON v.land = c.land AND v.rb = c.rb AND v.kreis = c.kreis AND v.vb = c.vb LEFT JOIN codes ON codes.id = c.id""")


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables written as one version, and a second time with the cities of one state alone; counts by version and table."""
    t, root = Tables(spark, sf_dir), f"{shared_folder(spark)}/geography"
    first = versions.reload(spark, root, geography.build(t.sql(REGISTER)))
    kept = {name: first.table(name).filter("land = 1") if name == "cities" else first.table(name) for name in first.tables}
    second = versions.reload(spark, root, kept)
    figures = [v.table(n).agg(F.count("*").alias("n"), F.sum("pop_total").alias("population")).select(F.lit(v.version).alias("version"), F.lit(n).alias("table_name"), "n", "population") for v in (versions.Version(spark, root, first.version), second) for n in v.tables]
    out = figures[0]
    for more in figures[1:]:
        out = out.unionByName(more)
    return out


QUERIES["S12_reload"] = reloaded
ORACLES["S12_reload"] = with_ctes(f"""{GEO}, f AS (
  SELECT 'cities' AS table_name, count(*) AS n, sum(pop_total) AS population FROM c {" ".join(f"UNION ALL SELECT '{n}', count(*), sum(CASE WHEN m > 0 THEN s.pop_total ELSE x.pop_total END) FROM {a} x LEFT JOIN (SELECT {', '.join(geography.KEYS[:d])}, count(*) AS m, sum(pop_total) AS pop_total FROM c GROUP BY ALL) s USING ({', '.join(geography.KEYS[:d])})" for (n, d, _), a in zip(geography.LEVELS, 'lrkv'))}
)
SELECT CAST(1 AS BIGINT) AS version, table_name, n, CAST(population AS BIGINT) AS population FROM f
UNION ALL SELECT 2, table_name, CASE WHEN table_name = 'cities' THEN (SELECT count(*) FROM c WHERE land = 1) ELSE n END, CAST(CASE WHEN table_name = 'cities' THEN (SELECT sum(pop_total) FROM c WHERE land = 1) ELSE population END AS BIGINT) FROM f""")


# --- claims and counters ---------------------------------------------------------------------------------------------------

CUTS = 4


def queued(t: Tables) -> DataFrame:
    """Raw cards, some of them without a pair."""
    return catalog.raw_cards(t).withColumn("cb_id", F.when(F.col("id") % 29 > 0, F.col("cb_id")))


def worked_off(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, str]:
    """The queue in four parts of ascending ids, each one claim, worked off into the shared folder. Cards are made once, and a part is queued and
    claimed in as many files as it was made in."""
    root = shared_folder(spark)
    queued(Tables(spark, sf_dir)).write.parquet(f"{root}/cards")
    cards = spark.read.parquet(f"{root}/cards")
    most = cards.agg(F.max("id")).first()[0] or 0
    verdict = resolution.verdict(F.col("email"))
    reason = F.when(verdict == "EMPTY", "no address").when(verdict == "INVALID", "bad address").when(F.col("cb_id").isNull(), "no pair")
    fold = lambda held, good: resolution.resolve(good) if held is None else resolution.resolve_into(held, good)
    for k in range(CUTS):  # what is new in the queue is one claim
        cards.filter(F.expr(f"id * {CUTS} div {most + 1} = {k}")).write.mode("append").parquet(f"{root}/queue")
        rows = spark.readStream.schema(cards.schema).parquet(f"{root}/queue")
        claims.work_off(rows, f"{root}/work", "email", reason, fold, f"{root}/state").awaitTermination()
    return spark, f"{root}/work"


QUERIES["M12_claims"] = lambda spark, sf_dir: catalog.resolved(claims.state(*worked_off(spark, sf_dir), "email"))
ORACLES["M12_claims"] = with_ctes(catalog.RESOLVED.format(late="false").replace("WHERE l_partkey % 11 <> 0", "WHERE (l_orderkey * 10 + l_linenumber) % 29 > 0 AND l_partkey % 11 <> 0"))
QUERIES["M12_dead_letters"] = lambda spark, sf_dir: claims.dead_letters(*worked_off(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))
ORACLES["M12_dead_letters"] = with_ctes(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 11 = 0 THEN 'no address' WHEN l_partkey % 13 = 0 THEN 'bad address' WHEN (l_orderkey * 10 + l_linenumber) % 29 = 0 THEN 'no pair' END AS reason FROM ({catalog.LINES})) WHERE reason IS NOT NULL GROUP BY 1")


def counted_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of two batches, the first applied twice, each appended to the stored log: what the counters of the campaigns say in the end."""
    t, root = Tables(spark, sf_dir), shared_folder(spark)
    letters = catalog.letters_of(t).join(t.sending_log.groupBy("id").agg(F.bool_or("processed").alias("processed")), "id")
    letters.filter("id % 3 = 0").write.parquet(f"{root}/log")
    campaign = t.campaign.select("id", (F.col("id") % 4).alias("sent_num"))
    for n, rows in enumerate(("id % 3 < 2", "id % 3 < 2", "id % 6 > 1")):
        batch = letters.filter(rows)
        new, counters = merge.insert_counted(spark.read.parquet(f"{root}/log"), campaign, batch.unionByName(batch.filter("id % 7 = 0")))
        counters.unionByName(campaign.join(counters, "id", "left_anti")).write.parquet(f"{root}/campaign{n}")
        new.write.mode("append").parquet(f"{root}/log")
        campaign = spark.read.parquet(f"{root}/campaign{n}")
    return campaign.select(F.col("id").alias("campaign_id"), "sent_num")


QUERIES["M10_counted_letters"] = counted_letters
ORACLES["M10_counted_letters"] = with_ctes("""
SELECT c.id AS campaign_id, c.id % 4 + coalesce(n, 0) AS sent_num FROM campaign c
LEFT JOIN (SELECT campaign_id, count(*) AS n FROM (SELECT id, min(campaign_id) AS campaign_id, bool_or(processed) AS processed FROM sending_log GROUP BY id) WHERE processed AND (id % 3 = 1 OR id % 3 = 2 AND id % 6 > 1) GROUP BY 1) s ON s.campaign_id = c.id""")

# --- states that expire ----------------------------------------------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOURS = 3600 * 1000


def streamed(spark: SparkSession, events: DataFrame, machine, cuts: int = 3) -> DataFrame:
    """A machine's output over events that arrive in files of ascending numbers, one file a micro-batch."""
    root, key = shared_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    most, before = events.agg(F.max("seq")).first()[0] or 0, spark.conf.get(key, None)
    for k in range(cuts):
        events.filter(F.expr(f"seq * {cuts} div {most + 1} = {k}")).coalesce(1).write.mode("append").parquet(f"{root}/events")
    spark.conf.set(key, ROCKS)
    try:
        rows = machine(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.parquet(f"{root}/out")


def in_time(t: Tables, *columns: str) -> DataFrame:
    """Events numbered in order of time for each task."""
    return t.sql("SELECT user_id AS task_id, CAST(ts AS TIMESTAMP) AS time, event_type, value, event_id FROM events").withColumn("seq", F.unix_micros("time") - F.lit(1_704_067_200_000_000)).selectExpr("task_id", "time", "seq", *columns)


VISIT = "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'a' WHEN event_type = 'error' THEN 'b' END AS hash"
QUERIES["T3_rebuild_stream"] = lambda spark, sf_dir: streamed(spark, in_time(Tables(spark, sf_dir), VISIT), lambda rows: expiring.rebuilds(rows, (12 * HOURS, 12 * HOURS)))
ORACLES["T3_rebuild_stream"] = """
WITH e AS (SELECT user_id AS task_id, CAST(epoch_us(ts) - 1704067200000000 AS BIGINT) AS seq, epoch_ms(ts) AS ms, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'a' WHEN event_type = 'error' THEN 'b' END AS h FROM events)
SELECT task_id, seq, CASE WHEN h = lag(h) OVER w AND ms < lag(ms) OVER w + 12 * 3600000 THEN 'increment' ELSE 'rebuild' END AS action FROM e WINDOW w AS (PARTITION BY task_id ORDER BY seq)"""

GATED = ["CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'added' ELSE 'check' END AS kind", "CAST(floor(value) AS BIGINT) AS n", "event_id % 5 > 0 AS wanted", "event_type = 'error' AS fresh", "20 AS sample", "event_id % 8 AS good", "event_id % 41 AS total"]
QUERIES["T10_gate_stream"] = lambda spark, sf_dir: streamed(spark, in_time(Tables(spark, sf_dir), *GATED), lambda rows: expiring.gates(rows, 100, 0.25, 30 * HOURS, (9 * HOURS, 9 * HOURS)))
ORACLES["T10_gate_stream"] = """
WITH RECURSIVE e AS (
  SELECT user_id AS task_id, CAST(epoch_us(ts) - 1704067200000000 AS BIGINT) AS seq, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'added' ELSE 'check' END AS kind, CAST(floor(value) AS BIGINT) AS n,
    event_id % 5 > 0 AS wanted, event_type = 'error' AS fresh, event_id % 41 < 20 OR event_id % 8 >= 0.25 * (event_id % 41) AS fine FROM events
), f AS ( -- state after event i: mode and until when, contacts of the window, answer and until when; what event i was told
  SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS mode, CAST(0 AS BIGINT) AS mode_until, CAST(0 AS BIGINT) AS got, CAST(NULL AS BOOLEAN) AS answer, CAST(0 AS BIGINT) AS answer_until FROM e
  UNION ALL
  SELECT task_id, i,
    CASE WHEN kind = 'start' THEN 'window' WHEN kind = 'added' THEN CASE WHEN full_now THEN NULL ELSE mode END WHEN held THEN mode WHEN NOT wanted THEN NULL WHEN mode = 'window' THEN mode WHEN fine THEN NULL ELSE 'blocked' END,
    CASE WHEN kind = 'start' OR adds OR kind = 'check' AND NOT held AND wanted AND coalesce(mode, '') <> 'window' AND NOT fine THEN ms + 30 * 3600000 ELSE mode_until END,
    CASE WHEN kind = 'start' THEN 0 WHEN adds THEN got + n ELSE got END,
    CASE WHEN kind = 'start' THEN NULL WHEN kind = 'added' OR held THEN answer ELSE wanted AND (coalesce(mode, '') = 'window' OR fine) END,
    CASE WHEN kind = 'check' AND NOT held THEN ms + 9 * 3600000 ELSE answer_until END
  FROM (SELECT *, kind = 'check' AND answer IS NOT NULL AND NOT fresh AS held, kind = 'added' AND coalesce(mode, '') = 'window' AND n > 0 AS adds, kind = 'added' AND coalesce(mode, '') = 'window' AND n > 0 AND got + n >= 100 AS full_now FROM (
    SELECT e.*, CASE WHEN ms < f.mode_until THEN f.mode END AS mode, f.mode_until, CASE WHEN ms < f.mode_until THEN f.got ELSE 0 END AS got, CASE WHEN ms < f.answer_until THEN f.answer END AS answer, f.answer_until FROM f JOIN e ON e.task_id = f.task_id AND e.i = f.i + 1))
)
SELECT f.task_id, e.seq, f.answer AS needed, f.mode FROM f JOIN e USING (task_id, i) WHERE e.kind = 'check'"""

QUERIES["T11_exhausted_stream"] = lambda spark, sf_dir: streamed(spark, in_time(Tables(spark, sf_dir), "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS found"), lambda rows: expiring.exhausted(rows, 24 * HOURS))
ORACLES["T11_exhausted_stream"] = """
WITH RECURSIVE e AS (SELECT user_id AS task_id, CAST(epoch_us(ts) - 1704067200000000 AS BIGINT) AS seq, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, event_type = 'error' AS none FROM events),
f AS (
  SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS until, false AS skipped FROM e
  UNION ALL
  SELECT e.task_id, e.i, CASE WHEN ms < until THEN until WHEN none THEN ms + 24 * 3600000 ELSE 0 END, ms < until FROM f JOIN e ON e.task_id = f.task_id AND e.i = f.i + 1
)
SELECT task_id, seq, skipped FROM f JOIN e USING (task_id, i)"""

# --- sending ---------------------------------------------------------------------------------------------------------------


def windowed(t: Tables) -> DataFrame:
    """Campaigns with a window, two in three of them with its Mondays and Thursdays alone, and an interval of some minutes."""
    own = F.create_map(*[x for d, slots in catalog.DAY_SLOTS for x in (F.lit(d), F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in slots]).cast("array<struct<`from`:string,`to`:string>>"))])
    window = F.when(F.col("id") % 3 == 0, own).otherwise(F.map_filter(own, lambda k, v: k.isin("mon", "thu")))
    return t.campaign.select(F.col("id").alias("campaign_id"), window.alias("window"), F.when(F.col("id") % 19 > 0, (F.col("id") % 23 + 1) * 61_000).cast("long").alias("interval_ms"))


def letters_ahead(t: Tables) -> DataFrame:
    planned = ranking.first_rows(catalog.found(t), ["campaign_id"], ranking.send_order(), 200)
    return pacing.send_times(planned, windowed(t), NOW).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


query("T13_send_times", letters_ahead, f"""
WITH cal AS (SELECT * FROM (VALUES (0, 'thu'), (1, 'hol'), (2, 'sat'), (3, 'sun'), (4, 'hol'), (5, 'tue'), (6, 'wed'), (7, 'thu'), (8, 'fri'), (9, 'sat'), (10, 'sun'), (11, 'mon'), (12, 'tue'), (13, 'wed'), (14, 'hol')) v(ahead, k)),
slot AS (SELECT * FROM (VALUES ('mon', 540, 720), ('mon', 780, 1050), ('tue', 480, 660), ('thu', 600, 645), ('fri', 435, 480), ('hol', 600, 620)) v(k, a, b)),
s AS (SELECT whole, ahead, greatest(a, CASE WHEN ahead = 0 THEN 630 ELSE 0 END) AS a, b FROM cal JOIN slot USING (k), (VALUES (true), (false)) w(whole) WHERE whole OR k IN ('mon', 'thu')),
r AS (SELECT *, sum((b - a) * 60000) OVER (PARTITION BY whole ORDER BY ahead, a) - (b - a) * 60000 AS from_ms, (b - a) * 60000 AS ms FROM s),
p AS (SELECT campaign_id, contact_id, rn, (rn - 1) * (campaign_id % 23 + 1) * 61000 AS at_ms, campaign_id % 3 = 0 AS whole FROM (SELECT *, {catalog.RN.format('campaign_id', catalog.SEND)} FROM ({catalog.CANDIDATES})) WHERE rn <= 200 AND campaign_id % 19 > 0)
SELECT campaign_id, contact_id, CAST(rn AS INT) AS rn, strftime(TIMESTAMP '2025-04-17 00:00:00' + ahead * INTERVAL 1 DAY + a * INTERVAL 1 MINUTE + (at_ms - from_ms) * INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S') AS at
FROM p JOIN r ON r.whole = p.whole AND at_ms >= from_ms AND at_ms < from_ms + ms""")
query("T13_picks", lambda t: pacing.picks(catalog.found(t).groupBy("campaign_id").agg(F.count("*").alias("pending")).join(t.campaign.select(F.col("id").alias("campaign_id"), "mailbox_id"), "campaign_id"), 11).select("mailbox_id", "campaign_id", "pending", "place"), f"""
SELECT mailbox_id, campaign_id, pending, CAST(row_number() OVER (PARTITION BY mailbox_id ORDER BY -ln((CAST(concat('0x', substr(md5(concat('11:', campaign_id)), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496.0e0) / pending, campaign_id) AS INT) AS place
FROM (SELECT campaign_id, count(*) AS pending FROM ({catalog.CANDIDATES}) GROUP BY 1) n JOIN campaign c ON c.id = n.campaign_id""")

# --- texts and nested values -----------------------------------------------------------------------------------------------

#: Websites as contacts name them: with and without www, schemes, slashes and capitals, some of them no websites.
SITES = """
SELECT p_partkey % 50 AS contact_id, p_partkey AS pos, CONCAT(CASE p_partkey % 5 WHEN 1 THEN 'http://' WHEN 2 THEN 'HTTPS://' WHEN 3 THEN ' ' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'www.' ELSE '' END,
  CASE p_partkey % 7 WHEN 0 THEN 'localhost' WHEN 1 THEN 'a.de' WHEN 2 THEN 'B.de' WHEN 3 THEN 'a.de:8080' WHEN 4 THEN 'x@c.org' ELSE 'a.de' END,
  CASE p_partkey % 11 WHEN 1 THEN '/' WHEN 2 THEN '/x' WHEN 3 THEN '/x/' WHEN 4 THEN '?q=1' WHEN 5 THEN '/?' WHEN 6 THEN '#top' WHEN 7 THEN '/x?b=2#z' ELSE '' END) AS url FROM part
UNION ALL SELECT p_partkey % 50, p_partkey + 1000000000, CASE p_partkey % 4 WHEN 0 THEN '/Only/Path' WHEN 1 THEN '   ' WHEN 2 THEN '?x' END FROM part"""
query("F_web_merge", lambda t: websites.merge_websites(t.sql(SITES), "contact_id", "url", "pos"), f"""
WITH u AS (SELECT contact_id, pos, lower(trim(url)) AS u FROM ({SITES}) WHERE trim(url) <> ''),
a AS (SELECT *, regexp_extract(u, '^(https?)://', 1) AS scheme, regexp_replace(u, '^https?://', '') AS r FROM u),
b AS (SELECT *, regexp_extract(r, '^[^/?#]*') AS who, substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1) AS rest FROM a),
c AS (SELECT *, string_split(string_split(who, '@')[-1], ':')[1] AS host, string_split(string_split(rest, '#')[1], '?')[1] AS path, CASE WHEN split_part(string_split(rest, '#')[1], '?', 2) <> '' THEN concat('?', split_part(string_split(rest, '#')[1], '?', 2)) ELSE '' END AS query, CASE WHEN split_part(rest, '#', 2) <> '' THEN concat('#', split_part(rest, '#', 2)) ELSE '' END AS mark FROM b),
d AS (SELECT *, regexp_replace(host, '^www\\.', '') AS base, CASE WHEN concat(path, query, mark) IN ('', '/') THEN '/' ELSE concat(path, query, mark) END AS tail FROM c),
e AS (SELECT d.*, CASE WHEN both_ways THEN concat('www.', base) ELSE host END AS name FROM d LEFT JOIN (SELECT contact_id, base, count(DISTINCT host LIKE 'www.%') = 2 AS both_ways FROM d WHERE host <> '' GROUP BY ALL) f USING (contact_id, base)),
g AS (SELECT contact_id, name, tail, min(pos) AS seen, max(CASE scheme WHEN 'https' THEN 2 WHEN 'http' THEN 1 ELSE 0 END) AS best FROM e WHERE host <> '' GROUP BY ALL),
h AS (SELECT contact_id, concat(CASE best WHEN 2 THEN 'https://' WHEN 1 THEN 'http://' ELSE '' END, name, tail) AS url, CASE WHEN tail = '/' THEN min(seen) OVER (PARTITION BY contact_id, name) ELSE seen END AS o, CASE WHEN tail = '/' THEN 0 ELSE 1 END AS later FROM g
  UNION ALL SELECT contact_id, u, min(pos), 1 FROM e WHERE host = '' GROUP BY ALL)
SELECT contact_id, CAST(row_number() OVER (PARTITION BY contact_id ORDER BY o, later) AS INT) AS place, url FROM (SELECT contact_id, url, min(o) AS o, arg_min(later, (o, later)) AS later FROM h GROUP BY ALL)""")

#: Campaigns that ask for titles which others have, with and without numbers.
TITLES = "SELECT workspace_id, id, CONCAT(CASE WHEN id % 5 = 0 THEN ' ' ELSE '' END, 'Aktion ', CAST(id % 4 AS VARCHAR), CASE id % 6 WHEN 1 THEN ' - #2' WHEN 2 THEN CONCAT(' - #', CAST(id % 17 AS VARCHAR)) WHEN 3 THEN '-#3' WHEN 4 THEN ' - #2 - #4' ELSE '' END) AS title FROM campaign"
query("F_title", lambda t: titles.unique_titles(t.sql(TITLES).filter("id % 3 > 0"), t.sql(TITLES).filter("id % 3 = 0").select("workspace_id", "title")), f"""
WITH t AS (SELECT workspace_id AS w, id, trim(title) AS t, coalesce(nullif(trim(regexp_replace(trim(title), '\\s*-\\s*#\\d+\\s*$', '')), ''), trim(title)) AS base FROM ({TITLES})),
held AS (SELECT DISTINCT w, t FROM t WHERE id % 3 = 0), new AS (SELECT * FROM t WHERE id % 3 > 0),
a AS (SELECT w, t, min(id) AS id FROM new WHERE (w, t) NOT IN (SELECT (w, t) FROM held) GROUP BY ALL),
h2 AS (SELECT * FROM held UNION SELECT w, t FROM a), n2 AS (SELECT * FROM new WHERE id NOT IN (SELECT id FROM a)),
b AS (SELECT w, base, min(id) AS id FROM n2 WHERE (w, base) NOT IN (SELECT (w, t) FROM h2) GROUP BY ALL),
h3 AS (SELECT * FROM h2 UNION SELECT w, base FROM b), n3 AS (SELECT *, row_number() OVER (PARTITION BY w, base ORDER BY id) AS i FROM n2 WHERE id NOT IN (SELECT id FROM b)),
free AS (SELECT w, base, c, row_number() OVER (PARTITION BY w, base ORDER BY k) AS i FROM (SELECT w, base, k, concat(base, ' - #', k) AS c FROM (SELECT w, base, unnest(range(2, (SELECT max(i) FROM n3) + 100)) AS k FROM n3 GROUP BY w, base)) WHERE (w, c) NOT IN (SELECT (w, t) FROM h3))
SELECT w AS workspace_id, id, t AS unique_title FROM a UNION ALL SELECT w, id, base FROM b UNION ALL SELECT w, id, c FROM n3 JOIN free USING (w, base, i)""")

TEMPLATE = "Guten Tag {{company}}, {{ name }} aus {{ city }}: {{ unknown }} {{ company_long }} {{ rate }}"


def lettered(t: Tables) -> DataFrame:
    """Letters filled for each contact, and the variables put back."""
    name = F.concat(F.lit("Firma "), F.col("id").cast("string"))
    values = F.create_map(F.lit("name"), F.concat(F.lit("Herr "), F.col("id").cast("string"), F.lit(" {x}")), F.lit("company"), name, F.lit("company_long"), F.concat(name, F.lit(" GmbH & Co. (name)")), F.lit("city"), F.concat(F.lit("Ort$1 "), (F.col("id") % 9).cast("string")), F.lit("rate"), F.when(F.col("id") % 2 == 0, "name"), F.lit("none"), F.lit(""))
    text = letters.filled(F.lit(TEMPLATE), values)
    return t.contact.select("id", text.alias("letter"), letters.unfilled(text, values).alias("template"))


query("F_letters", lettered, """
SELECT id, concat('Guten Tag Firma ', id, ', Herr ', id, ' {x} aus Ort$1 ', id % 9, ': {{ unknown }} Firma ', id, ' GmbH & Co. (name) ', CASE WHEN id % 2 = 0 THEN 'name' ELSE '' END) AS letter,
  concat('Guten Tag {{ company }}, {{ name }} aus {{ city }}: {{ unknown }} {{ company_long }} ', CASE WHEN id % 2 = 0 THEN '{{ rate }}' ELSE '' END) AS template FROM contact""")

CSS = "CONCAT('p {{ margin: ', CAST(id % 5 AS VARCHAR), 'px; color : red }}\n.c', CAST(id % 3 AS VARCHAR), '{{ top:1px; top: 2px;; junk }} h1 {{ }}', CASE WHEN id % 2 = 0 THEN 'p{{color:blue}}' ELSE '' END)"
HTML = "CONCAT('<P class=\"c', CAST(id % 4 AS VARCHAR), '\" align=\"left\">Hi <A href=\"x\" style=\"q\">y</A></p>', CASE WHEN id % 7 = 0 THEN '<p>open' ELSE '</p>' END)"
CELL = letters.PARAGRAPH[0]
query("F_css", lambda t: t.sql(f"SELECT id, {CSS} AS css, {HTML} AS html FROM contact").select("id", letters.css_udf("css").alias("css"), letters.inline_udf("html", "css").alias("html")), f"""
SELECT id, concat('.c', id % 3, '{{top:2px;}}', chr(10), 'p{{color:', CASE WHEN id % 2 = 0 THEN 'blue' ELSE 'red' END, ';margin:', id % 5, 'px;}}') AS css,
  concat('{CELL.split("{}")[0]} style="', s, CASE WHEN id % 4 = id % 3 THEN 'top:2px;' ELSE '' END, '"{CELL.split("{}")[1]}Hi <a href="x">y</A>{letters.PARAGRAPH[1]}', CASE WHEN id % 7 = 0 THEN concat('{CELL.split("{}")[0]} style="', s, '"{CELL.split("{}")[1]}open{letters.PARAGRAPH[1]}') ELSE '</p>' END) AS html
FROM (SELECT id, concat('margin:', id % 5, 'px;color:', CASE WHEN id % 2 = 0 THEN 'blue' ELSE 'red' END, ';') AS s FROM contact)""")

#: What an order says as JSON, wrong in one of nine ways (braces are doubled, as Tables.sql wants them).
ORDER_JSON = """SELECT o_orderkey, CASE o_orderkey % 11 WHEN 9 THEN 'no json' WHEN 10 THEN NULL ELSE CONCAT('{{"id": ', CASE o_orderkey % 11 WHEN 1 THEN '"1"' WHEN 2 THEN '1.0' ELSE CAST(o_orderkey AS VARCHAR) END, ', "status": "', CASE o_orderkey % 11 WHEN 3 THEN 'X' ELSE 'O' END,
  '", "customer": {{"id": ', CAST(o_custkey AS VARCHAR), CASE o_orderkey % 11 WHEN 4 THEN '' WHEN 5 THEN ', "vip": 1' ELSE ', "vip": true' END, '}}, "tags": ["a"', CASE o_orderkey % 11 WHEN 6 THEN ', 5' ELSE '' END, '], "note": ', CASE o_orderkey % 2 WHEN 0 THEN 'null' ELSE '"x"' END, CASE o_orderkey % 11 WHEN 7 THEN ', "more.x": 1, "a": 2' ELSE '' END, '}}') END AS json FROM orders"""
ORDER_SPEC = {"id": int, "status": ("O", "F", "P"), "customer": {"id": int, "vip": bool}, "tags": [str], "note": nested.Maybe(str)}
query("F_typed", lambda t: t.sql(ORDER_JSON).select("o_orderkey", F.array_join(nested.json_errors(F.col("json"), ORDER_SPEC), "; ").alias("errors")), """
SELECT o_orderkey, CASE o_orderkey % 11 WHEN 1 THEN '$.id: must be int' WHEN 2 THEN '$.id: must be int' WHEN 3 THEN '$.status: must be one of F, O, P' WHEN 4 THEN '$.customer.vip: missing' WHEN 5 THEN '$.customer.vip: must be bool' WHEN 6 THEN '$.tags[1]: must be str'
  WHEN 7 THEN '$.a: extra; $.more.x: extra' WHEN 9 THEN '$: not JSON' WHEN 10 THEN '$: not JSON' ELSE '' END AS errors FROM orders""")
query("F_typed_events", lambda t: t.events.groupBy(F.array_join(nested.json_errors(F.col("props"), {"k": int}), "; ").alias("errors"), F.array_join(nested.json_errors(F.col("props"), {"k": str, "v": bool}), "; ").alias("others")).agg(F.count("*").alias("n")), "SELECT '' AS errors, '$.v: missing; $.k: must be str' AS others, count(*) AS n FROM events")


def known(t: Tables) -> DataFrame:
    """Contacts as resolved, with other names and addresses that repeat, and blanks."""
    c = resolution.resolve(catalog.raw_cards(t))
    norm = F.struct(
        F.col("company_name"), F.array(F.upper("company_name"), F.col("company_name"), F.lit(" "), F.upper("company_name")).alias("company_names"), F.concat(F.lit(" "), F.col("city")).alias("address"),
        F.when(F.length("email") % 2 == 0, "Land").otherwise("Ort").alias("land"), F.array(F.col("city"), F.concat("city", F.lit(", Land")), F.lit(None)).alias("addresses"), F.col("categories"), F.array().cast("array<string>").alias("keywords"),
        F.array(F.lit("  ")).alias("statuses"), F.col("phones"), F.array(F.lit("x.com/1")).alias("socials"), F.lit("\n\t").alias("description_web"), F.col("description"),
    )
    return c.select("email", norm.alias("norm"))


TEXT_CARD = f"""
SELECT email, concat_ws(chr(10) || chr(10), company_name, address, concat('Geschaeftskategorien:', chr(10), array_to_string(categories, chr(10))), array_to_string(phones, chr(10)), description, concat('Soziale Netzwerke:', chr(10), 'x.com/1'),
  CASE WHEN company_name IS NOT NULL THEN concat('Weitere Unternehmensnamen:', chr(10), upper(company_name)) END, concat('Weitere Adressen:', chr(10), CASE WHEN address = city THEN concat(city, ', Land') ELSE city END)) AS text
FROM (SELECT *, CASE WHEN length(email) % 2 = 0 THEN concat(city, ', Land') ELSE city END AS address FROM ({catalog.RESOLVED.format(late="false")}))"""
query("F_text_card", lambda t: known(t).select("email", nested.contact_text(F.col("norm")).alias("text")), TEXT_CARD)


def emptied(t: Tables) -> DataFrame:
    rows = known(t)
    clean = nested.drop_empty(F.col("norm"), rows.schema["norm"].dataType)
    return rows.select("email", F.to_json(clean).alias("json"))


query("F_drop_empty", emptied, f"""
SELECT email, concat('{{', CASE WHEN company_name IS NOT NULL THEN concat('"company_name":"', company_name, '","company_names":["', upper(company_name), '","', company_name, '","', upper(company_name), '"],') ELSE '' END, '"address":"', city, '","land":"', CASE WHEN length(email) % 2 = 0 THEN 'Land' ELSE 'Ort' END,
  '","addresses":["', city, '","', city, ', Land"],"categories":["', array_to_string(categories, '","'), '"],"phones":["', array_to_string(phones, '","'), '"],"socials":["x.com/1"],"description":"', replace(description, chr(10), '\\n'), '"}}') AS json FROM ({catalog.RESOLVED.format(late="false")})""")

# --- pages of the two catalogs -----------------------------------------------------------------------------------------------

#: Detail pages made of suppliers; braces are doubled, as Tables.sql wants them.
GS_PAGES = """
SELECT s_suppkey AS page_id, CONCAT('<html><h1 class="big mod-TeilnehmerKopf__name"> ', CASE WHEN s_suppkey % 5 > 0 THEN s_name ELSE '' END, ' <b>x</b></h1><div class="mod-TeilnehmerKopf__branchen"><span data-selenium="teilnehmerkopf__branche">Branche ', CAST(s_suppkey % 7 AS VARCHAR), '</span><span>no</span></div>',
  '<address class="mod-TeilnehmerKopf__adresse"><span class="mod-TeilnehmerKopf__adresse-daten">Weg ', CAST(s_suppkey AS VARCHAR), ', </span><span class="mod-TeilnehmerKopf__adresse-daten">', CASE WHEN s_suppkey % 3 > 0 THEN LPAD(CAST(s_suppkey % 90 AS VARCHAR), 5, '0') ELSE '' END, '</span><p><span class="mod-TeilnehmerKopf__adresse-daten--noborder">Ort &amp; ', CAST(s_suppkey % 9 AS VARCHAR), '</span></address>',
  '<div class="aktionsleiste"><a href="mailto:info', CAST(s_suppkey AS VARCHAR), '@x.de?subject=a">mail</a><a title="w" href="javascript:void(0)">www.s', CAST(s_suppkey AS VARCHAR), '.de</a></div><div class="mod mod-Kontaktdaten"><span class="gc-text--h2">', UPPER(s_name), CASE WHEN s_suppkey % 2 = 0 THEN '  ' ELSE '' END, '</span>',
  '<ul><li class="mod-Kontaktdaten__list-item contains-icon-big-tel"><a href="#">call</a><span data-role="telefonnummer" data-suffix="0123 ', CAST(s_suppkey + 100 AS VARCHAR), '">+</span></li><li class="mod-Kontaktdaten__list-item contains-icon-big-tel"><a href="tel:0999', CAST(s_suppkey + 100 AS VARCHAR), '?x">t</a><br></li></ul><div class="contains-icon-big-homepage"><a href="http://s', CAST(s_suppkey AS VARCHAR), '.de">h</a></div></div>',
  '<section id="beschreibung"><div class="mod-Beschreibung">We <i>sell</i><script>var a</script> things.</div></section></html>') AS html FROM supplier"""
query("X1_gs_cards", lambda t: catalogs.details(t.sql(GS_PAGES), "gs").select("page_id", "company_name", "street", "plz", "city", "email", "website", "description", *[F.array_join(c, "|").alias(c) for c in ("categories", "phones", "websites", "emails")]), """
SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 5 > 0 THEN s_name ELSE upper(s_name) END AS company_name, concat('Weg ', s_suppkey) AS street, CASE WHEN s_suppkey % 3 > 0 THEN lpad(CAST(s_suppkey % 90 AS VARCHAR), 5, '0') END AS plz, concat('Ort & ', s_suppkey % 9) AS city, concat('info', s_suppkey, '@x.de') AS email,
  concat('www.s', s_suppkey, '.de') AS website, 'We sell things.' AS description, concat('Branche ', s_suppkey % 7) AS categories, concat('0123 ', s_suppkey + 100, '|0999', s_suppkey + 100) AS phones, concat('www.s', s_suppkey, '.de|http://s', s_suppkey, '.de') AS websites, concat('info', s_suppkey, '@x.de') AS emails FROM supplier""")

#: An index page for each nation, with a card for each of its suppliers; some are listed twice, some have another postal code.
GS_INDEX_PAGES = """
SELECT s_nationkey AS page_id, 'http://gs/x' AS url, LPAD(CAST(s_nationkey AS VARCHAR), 5, '0') AS plz, CONCAT('<div>', {array_join}, '</div>') AS html FROM (
  SELECT s_suppkey, s_nationkey, CONCAT('<article class="mod mod-Treffer"><a href="https://g.de/gsbiz/', CAST(s_suppkey - s_suppkey % 2 AS VARCHAR), '"><h2 class="mod-Treffer__name">', s_name, '</h2></a><p class="mod-Treffer--besteBranche"> B </p><div class="mod-AdresseKompakt__adress-text">Weg 1, <span class="mod-AdresseKompakt__adress__ort">', CASE WHEN s_suppkey % 6 > 0 THEN LPAD(CAST(s_nationkey AS VARCHAR), 5, '0') ELSE '99999' END,
    ' Ort</span> (Mitte)</div><p class="mod-TelefonnummerKompakt__phoneNumber">0123 ', CAST(s_suppkey + 100 AS VARCHAR), '</p></article>') AS card FROM supplier) c GROUP BY s_nationkey"""


def gs_index_pages(t: Tables) -> DataFrame:
    return t.sql(GS_INDEX_PAGES.replace("{array_join}", "array_join(transform(array_sort(collect_list(struct(s_suppkey, card))), x -> x.card), '')"))


query("X2_gs_index", lambda t: catalogs.index_cards(gs_index_pages(t), "gs", F.col("plz")).select("page_id", "place", "url", "company_name", "category", "street", "plz", "city", "district", "address", "phone"), """
SELECT s_nationkey AS page_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS place, concat('https://g.de/gsbiz/', s_suppkey - s_suppkey % 2) AS url, s_name AS company_name, 'B' AS category, 'Weg 1' AS street, plz, 'Ort' AS city, 'Mitte' AS district, concat('Weg 1, ', plz, ' Ort') AS address, concat('0123 ', s_suppkey + 100) AS phone
FROM (SELECT *, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS plz, row_number() OVER (PARTITION BY s_nationkey, s_suppkey - s_suppkey % 2 ORDER BY s_suppkey) AS again FROM supplier WHERE s_suppkey % 6 > 0) WHERE again = 1""")

B_PAGES = """
SELECT s_suppkey AS page_id, CONCAT('<h1>', s_name, ' <small>GmbH</small></h1><script type="application/ld+json">{{"name": "', s_name, '", "geo": 1}}</script><script type="application/ld+json">{{"@type": ["', CASE WHEN s_suppkey % 2 = 0 THEN 'FAQPage' ELSE 'Thing' END, '"], "geo": 2}}</script><div id="kontakt">',
  '<div class="entry-detail-list__item"><i class="entry-detail-list__icon entry-detail-list__icon--location"></i><div class="entry-detail-list__label"><div><div>Weg ', CAST(s_suppkey AS VARCHAR), '</div><div><span class="js-postal-code">', LPAD(CAST(s_suppkey % 90 AS VARCHAR), 5, '0'), '</span> <span class="js-address-locality">Bonn</span> (Mitte)</div></div></div></div>',
  '<div class="entry-detail-list__item"><i class="entry-detail-list__icon entry-detail-list__icon--', CASE WHEN s_suppkey % 3 = 0 THEN 'cellphone' ELSE 'phone' END, '"></i><span class="entry-detail-list__label">Tel.: 0123 ', CAST(s_suppkey + 100 AS VARCHAR), '</span></div>',
  '<div class="entry-detail-list__item"><i class="entry-detail-list__icon entry-detail-list__icon--email"></i><a class="entry-detail-list__label" href="/x"><span class="__cf_email__" data-cfemail="01606341792f6564">[email protected]</span></a></div>',
  '<div class="entry-detail-list__item"><i class="entry-detail-list__icon entry-detail-list__icon--website"></i><span class="entry-detail-list__label">see www.s', CAST(s_suppkey AS VARCHAR), '.de, or call</span></div></div><p class="top-media-keywords">Maler (+5 km), Putz & Farben in Bonn</p><meta itemprop="email" content="b', CAST(s_suppkey AS VARCHAR), '@y.de">',
  '<ul class="features"><li>A</li><li>B<b>c</b></li></ul><div id="additional-features"><span class="additional-feature-label">open</span></div><section id="trade-service-features"><p>Das Unternehmen wird unter folgenden Suchworten gefunden:</p><div class="term-box__panel-content"><span class="term-box__panel-col">Putz</span><span class="term-box__panel-col">Kalk</span></div></section>') AS html FROM supplier"""
query("X3_11880_cards", lambda t: catalogs.details(t.sql(B_PAGES), "11880").select("page_id", "company_name", "street", "plz", "city", "district", "address", "email", "website", "data", "data2", *[F.array_join(c, "|").alias(c) for c in ("categories", "phones", "emails", "keywords", "statuses")]), """
SELECT s_suppkey AS page_id, concat(s_name, ' GmbH') AS company_name, concat('Weg ', s_suppkey) AS street, lpad(CAST(s_suppkey % 90 AS VARCHAR), 5, '0') AS plz, 'Bonn' AS city, 'Mitte' AS district, concat('Weg ', s_suppkey, ' ', lpad(CAST(s_suppkey % 90 AS VARCHAR), 5, '0'), ' Bonn (Mitte)') AS address, 'ab@x.de' AS email,
  concat('www.s', s_suppkey, '.de') AS website, concat('{"name": "', s_name, '"}') AS data, CASE WHEN s_suppkey % 2 = 1 THEN '{"@type": ["Thing"], "geo": 2}' END AS data2, 'A|B' AS categories, concat('0123 ', s_suppkey + 100) AS phones, concat('ab@x.de|b', s_suppkey, '@y.de') AS emails, 'Maler|Putz|Farben|Kalk' AS keywords, 'open' AS statuses FROM supplier""")

B_INDEX_PAGES = """
SELECT s_suppkey AS page_id, 'https://b.de/suche/?page=2' AS url, LPAD(CAST(s_suppkey % 90 AS VARCHAR), 5, '0') AS plz, CONCAT('<script type="application/ld+json">{{"a": [{{"itemListElement": [{{"item": {{"url": "https://b.de/', CAST(s_suppkey AS VARCHAR), '", "name": " ', s_name, ' ", "address": {{"streetAddress": "Weg 1", "postalCode": "', LPAD(CAST(s_suppkey % 90 AS VARCHAR), 5, '0'), '", "addressLocality": "Bonn"}}, "telephone": ["1", "0123 456"], "email": "mailto:a@x.de", "aggregateRating": {{"ratingValue": 4.5, "reviewCount": ', CAST(s_suppkey AS VARCHAR), '}}}}}}, ',
  '{{"item": {{"url": "https://b.de/', CAST(s_suppkey AS VARCHAR), '", "name": "again", "address": {{"postalCode": "', LPAD(CAST(s_suppkey % 90 AS VARCHAR), 5, '0'), '"}}}}}}, {{"item": {{"url": "https://b.de/far", "name": "far", "address": {{"postalCode": "99999"}}}}}}]}}]}}</script><div class="pagination"><span class="numbertext--current"> 2 </span><span class="numbertext"><a href="?page=7">7</a><a href="?page=1">1</a></span><a class="numbertext--counter" href="/suche/drei" data-page="', CASE WHEN s_suppkey % 2 = 0 THEN '3' ELSE 'x' END, '">3</a></div>') AS html FROM supplier"""
query("X4_11880_index", lambda t: catalogs.index_cards(t.sql(B_INDEX_PAGES), "11880", F.col("plz")).select("page_id", "place", "url", "company_name", "address", "phone", "email", "rating", "reviews", "next_page"), """
SELECT s_suppkey AS page_id, CAST(1 AS INT) AS place, concat('https://b.de/', s_suppkey) AS url, s_name AS company_name, concat('Weg 1, ', lpad(CAST(s_suppkey % 90 AS VARCHAR), 5, '0'), ' Bonn') AS address, '0123 456' AS phone, 'a@x.de' AS email, '4.5' AS rating, nullif(CAST(s_suppkey AS VARCHAR), '0') AS reviews,
  CASE WHEN s_suppkey % 2 = 0 THEN 'https://b.de/suche/drei' ELSE 'https://b.de/suche/?page=7' END AS next_page FROM supplier""")

# --- smaller pieces ----------------------------------------------------------------------------------------------------------

query("F_short_ids", lambda t: t.orders.select("o_orderkey", hashing.short_id(F.col("o_orderkey"), 0x5A5A5A5A, 2654435761).alias("short")).withColumn("back", hashing.long_id(F.col("short"), 0x5A5A5A5A, 2654435761)), """
SELECT o_orderkey, ltrim(concat(d[CAST(n // 916132832 % 62 AS INT) + 1], d[CAST(n // 14776336 % 62 AS INT) + 1], d[CAST(n // 238328 % 62 AS INT) + 1], d[CAST(n // 3844 % 62 AS INT) + 1], d[CAST(n // 62 % 62 AS INT) + 1], d[CAST(n % 62 AS INT) + 1]), '0') AS short, o_orderkey AS back
FROM (SELECT o_orderkey, CAST(CAST(xor(o_orderkey, 1515870810) AS HUGEINT) * 2654435761 % 4294967296 AS BIGINT) + 1 AS n, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz' AS d FROM orders)""")
query("F_memo_key", lambda t: t.contact.select("id", hashing.memo_key("rate", F.col("id"), F.col("blocked")).alias("key")), """SELECT id, sha1(concat('rate:["', id, '","', CASE WHEN blocked THEN 'true' ELSE 'false' END, '"]')) AS key FROM contact""")
query("F_times", lambda t: t.events.select("event_id", wt.local_text(F.col("ts")).alias("local"), *[c.alias(n) for n, c in wt.months_ahead(F.date_add(F.to_date("ts"), 28)).items()]), """
SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%d.%m %H:%M') AS local, d AS date, CAST(d + INTERVAL 1 MONTH AS DATE) AS date_plus_1m, CAST(d + INTERVAL 3 MONTH AS DATE) AS date_plus_3m FROM (SELECT event_id, ts, CAST(CAST(ts AS DATE) + 28 AS DATE) AS d FROM events)""")
query("F_same_scalar", lambda t: t.part.select("p_partkey", text.same_scalar(F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit(" "), F.col("p_name"))), F.when(F.col("p_partkey") % 3 == 0, F.upper(F.col("p_name"))).otherwise(F.lit("other")), F.lit("  ")).alias("name")), "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN trim(p_name) WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE 'other' END AS name FROM part")
query("P20_normal_windows", lambda t: windowed(t).select("campaign_id", F.array_join(F.transform(F.map_entries(wt.normalised(F.col("window"))), lambda e: F.concat(e["key"], F.size(e["value"]).cast("string"))), ",").alias("slots")), "SELECT id AS campaign_id, CASE WHEN id % 3 = 0 THEN 'mon2,tue2,wed1,thu2,fri1,sat0,sun0,hol1' ELSE 'mon2,tue0,wed0,thu2,fri0,sat0,sun0,hol0' END AS slots FROM campaign")
query("P19_stale_letters", lambda t: joins.stale_letters(t.contact.withColumn("stored", F.concat(F.lit("Hi "), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, "!").otherwise(""))), letters.filled(F.lit("Hi {{ id }}"), F.create_map(F.lit("id"), F.col("id").cast("string")))).select("id"), "SELECT id FROM contact WHERE id % 5 = 0")
query("P17_logins", lambda t: joins.logins(t.contact.select("id", "email"), t.orders.select((F.col("o_custkey") + 1).alias("user_id"), F.col("o_orderkey").alias("token"), F.col("o_orderdate").cast("timestamp").alias("expires_at"), (F.col("o_orderkey") % 3 == 0).alias("used")), t.contact.filter("id % 2 = 0").select(F.upper("email").alias("email")), "1997-01-01 00:00:00"), """
SELECT upper(c.email) AS email, c.id AS user_id, token FROM contact c JOIN (SELECT o_custkey + 1 AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS token FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate > TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1) k ON k.id = c.id WHERE c.id % 2 = 0""")
LETTER = "SELECT id AS campaign_id, CASE WHEN id % 8 = 0 THEN 'other' ELSE workspace_id END AS workspace_id, CONCAT('T', CAST(id AS VARCHAR)) AS template FROM campaign WHERE id % 5 > 0"
query("J17_campaign_letters", lambda t: joins.letters_of_campaigns(t.campaign, t.sql(LETTER)).select("id", "template"), "SELECT id, CASE WHEN id % 5 > 0 AND id % 8 > 0 THEN concat('T', id) END AS template FROM campaign")
query("J19_system_sender", lambda t: joins.system_sender(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("workspace_id")), t.supplier.filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("mailbox_id"), F.concat(F.lit("smtp"), F.col("s_suppkey").cast("string")).alias("host"))), "SELECT s_nationkey AS workspace_id, min(s_suppkey) AS mailbox_id, concat('smtp', min(s_suppkey)) AS host FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1")
query("M13_reset_rates", lambda t: merge.reset_rates(t.task_city_rating, t.task_branch_rating.select("task_id", (F.col("branch_id") % 25).alias("city_id")).distinct(), ["task_id", "city_id"], t.task.filter("id % 4 = 0").select(F.col("id").alias("task_id"))).select("task_id", "city_id", F.col("rate").cast("long").alias("rate")), """
SELECT task_id, city_id, CASE WHEN task_id % 4 > 0 THEN CAST(rate AS BIGINT) END AS rate FROM task_city_rating UNION ALL SELECT DISTINCT task_id, branch_id % 25, NULL FROM task_branch_rating b WHERE NOT EXISTS (SELECT 1 FROM task_city_rating c WHERE c.task_id = b.task_id AND c.city_id = b.branch_id % 25)""")
query("M16_clamped", lambda t: merge.clamped(t.part.select("p_partkey", (F.col("p_size") * 5 - 60).alias("size")), "p_partkey", "size").select("p_partkey", F.col("size").cast("long").alias("size")), "SELECT p_partkey, CAST(least(120, greatest(0, p_size * 5 - 60)) AS BIGINT) AS size FROM part WHERE p_size * 5 - 60 NOT BETWEEN 0 AND 120")
query("X10_subset_answers", lambda t: merge.subset_answers(t.li.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("id")), t.li.filter("l_linenumber < 5").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("id"))).select("batch", F.col("id").cast("long").alias("id")), "SELECT l_orderkey AS batch, CAST(l_linenumber AS BIGINT) AS id FROM li WHERE l_orderkey NOT IN (SELECT l_orderkey FROM li WHERE l_linenumber >= 5)")
