import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marktlens.operators import merge
from marktlens.plans import entries, pacing
from marktlens.streaming import claims, expiring
from tests.compare import SF

START = dt.datetime(2024, 1, 1)
H = expiring.HOUR


def events(spark, rows, more):
    """rows: task, hours, then what `more` names; numbered in order."""
    made = [(r[0], START + dt.timedelta(hours=r[1]), i, *r[2:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, f"task_id long, time timestamp, seq long, {more}")


def told(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def test_lists_are_rebuilt(spark):
    rows = [(1, 0, "a"), (1, 5, "a"), (1, 14, "a"), (1, 20, "b"), (1, 21, None), (1, 22, None), (1, 23, "b"), (2, 23, "b"), (1, 34.9, "b"), (1, 46.9, "b")]
    want = ["rebuild", "increment", "increment", "rebuild", "rebuild", "rebuild", "rebuild", "rebuild", "increment", "rebuild"]
    df = events(spark, rows, "hash string")
    assert [x for x, in told(expiring.rebuilds(df, (12 * H, 12 * H)), "action")] == want
    assert expiring.rebuilds(df.filter("false")).collect() == []


def test_times_to_forget_differ_by_task():
    spans = {expiring.spread(t, expiring.BUILT_FOR) for t in range(200)}
    assert len(spans) > 190 and min(spans) >= 24 * H and max(spans) <= 48 * H and expiring.spread(7, (5, 5)) == 5


def test_gates(spark):
    check = lambda h, wanted=True, fresh=True, good=0, total=20: (1, h, "check", None, wanted, fresh, 20, good, total)
    event = lambda h, kind, n=None: (1, h, kind, n, None, None, None, None, None)
    rows = [
        check(0), check(0.5, fresh=False, good=20), check(1.2, fresh=False, good=5),  # bad; the answer holds; then good enough
        event(2, "start"), check(2.1), event(3, "added", 60), check(4), event(5, "added", 0), event(6, "added", 40), check(7),  # a window until a hundred came
        check(8, total=19), check(9, wanted=False), event(10, "start"), check(11, wanted=False), check(12),  # too few to judge; not wanted, which ends a window
        event(13, "start"), check(13 + 167), check(14 + 167), event(300, "added", 500), check(301, fresh=False),  # a window is forgotten after a week
    ]
    got = told(expiring.gates(events(spark, rows, "kind string, n long, wanted boolean, fresh boolean, sample long, good long, total long"), 100, 0.25, flag=(H, H)), "needed", "mode")
    want = [(False, "blocked"), (False, "blocked"), (True, None), (True, "window"), (True, "window"), (False, "blocked"), (True, None), (False, None), (False, None), (False, "blocked"), (True, "window"), (False, "blocked"), (False, "blocked")]
    assert got == want


def test_exhausted_tasks_are_skipped(spark):
    rows = [(1, 0, 3), (1, 1, 0), (1, 1.1, 5), (1, 1.15, 0), (2, 1.15, 1), (1, 1.2, 5), (1, 1.25, 0), (1, 9, 0)]
    assert [x for x, in told(expiring.exhausted(events(spark, rows, "found long")), "skipped")] == [False, False, True, True, False, False, False, False]


def test_streams_give_what_tables_give(spark):
    r = random.Random(3)
    rows = sorted(((r.randrange(6), r.randrange(4000) / 10, r.choice(["a", "b", None])) for _ in range(300)), key=lambda x: x[1])
    df = events(spark, rows, "hash string")
    for cuts in (1, 4):
        got = entries.streamed(spark, df, lambda x: expiring.rebuilds(x, (12 * H, 12 * H)), cuts)
        assert told(got, "seq", "action") == told(expiring.rebuilds(df, (12 * H, 12 * H)), "seq", "action")


def test_claims_survive_a_kill_anywhere(spark, tmp_path, monkeypatch):
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, f"k{i % 3}", i) for i in range(7)] + [(k * 10 + 9, None, 1)], "id long, name string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/queue")
    rows = lambda: spark.readStream.schema("id long, name string, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/queue")

    def fold(held, good):
        sums = good.groupBy("name").agg(F.sum("n").alias("n"))
        return sums if held is None else sums.join(held.select("name", F.col("n").alias("m")), "name", "left").select("name", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))

    def run(root):
        claims.work_off(rows(), f"{tmp_path}/{root}", "name", F.when(F.col("name").isNull(), "no name"), fold, f"{tmp_path}/{root}-state").awaitTermination()

    def tables(root):
        at = f"{tmp_path}/{root}"
        return [sorted(map(tuple, df.collect())) for df in (claims.state(spark, at, "name"), claims.dead_letters(spark, at).select("id", "reason", "batch"), claims.ledger(spark, at))]

    run("whole")
    want = tables("whole")
    assert want[0] == [("k0", 27), ("k1", 15), ("k2", 21)] and [x[1] for x in want[1]] == ["no name"] * 3 and want[2] == [(0, 7, 1), (1, 7, 1), (2, 7, 1)]
    plain, calls = claims._close, []

    def stops(spark, root, number, counts):
        """Fails in batch 1 before its line is written, and again right after."""
        calls.append(number)
        if calls.count(1) == 1 and number == 1:
            raise RuntimeError("killed before")
        plain(spark, root, number, counts)
        if calls.count(1) == 2 and number == 1:
            raise RuntimeError("killed after")

    monkeypatch.setattr(claims, "_close", stops)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run("cut")
        assert claims.ledger(spark, f"{tmp_path}/cut").count() == len(calls) - 1  # what is half done isn't seen
    run("cut")
    assert calls == [0, 1, 1, 2] and tables("cut") == want


def test_inserts_pass_over_conflicts(spark, tmp_path):
    r = random.Random(2)
    held = [(i, r.randrange(8), r.randrange(8)) for i in range(10)]
    new = [(i, r.choice([r.randrange(30), None]), r.randrange(12)) for i in range(5, 120)]
    ids, pairs, want = {h[0] for h in held}, {h[1:] for h in held}, []
    for row in new:
        if row[0] not in ids and (None in row[1:] or row[1:] not in pairs):
            want.append(row)
            ids.add(row[0])
            pairs.add(row[1:])
    schema = "id long, campaign_id long, contact_id long"

    def write(df, n):
        df.write.parquet(f"{tmp_path}/{n}")
        return spark.read.parquet(f"{tmp_path}/{n}")

    a, b = spark.createDataFrame(held, schema), spark.createDataFrame(new, schema)
    got = merge.insert_unique(a, b, [["id"], ["campaign_id", "contact_id"]], ["id"], write)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        merge.insert_unique(a, b, [["id"], ["contact_id"]], ["id"])


def test_counters_rise_once(spark):
    log = spark.createDataFrame([(1, 7, True)], "id long, campaign_id long, processed boolean")
    campaign = spark.createDataFrame([(7, None), (8, 5), (9, 1)], "id long, sent_num long")
    batch = spark.createDataFrame([(1, 7, True), (2, 7, True), (2, 7, True), (3, 8, False), (4, 99, True)], log.schema)
    new, counters = merge.insert_counted(log, campaign, batch)
    assert sorted(r.id for r in new.collect()) == [2, 3, 4] and [tuple(r) for r in counters.collect()] == [(7, 1)]
    again, counters = merge.insert_counted(log.unionByName(new), campaign, batch)
    assert again.count() == counters.count() == 0


def test_draws_follow_the_weights(spark):
    rows = [(m, m * 10 + k, w) for m in range(3000) for k, w in enumerate((1, 3, 6, 0))]
    got = pacing.picks(spark.createDataFrame(rows, "mailbox_id long, campaign_id long, pending long"), 5).collect()
    assert len(got) == 9000
    first = Counter(r.pending for r in got if r.place == 1)
    assert all(abs(first[w] / 3000 - w / 10) < 4 * math.sqrt(w / 10 * (1 - w / 10) / 3000) for w in (1, 3, 6))
    second = Counter(r.pending for r in got if r.place == 2)  # without replacement
    want = {1: 0.3 * 1 / 7 + 0.6 * 1 / 4, 3: 0.1 * 3 / 9 + 0.6 * 3 / 4, 6: 0.1 * 6 / 9 + 0.3 * 6 / 7}
    assert all(abs(second[w] / 3000 - p) < 0.04 for w, p in want.items())


def test_letters_keep_to_windows(spark):
    slots = {"mon": [("09:00", "09:10"), ("09:05", "09:20"), ("12:00", "11:00"), ("23:50", "23:59")], "wed": [("10:00", "10:05")]}
    window = F.create_map(*[x for d, s in slots.items() for x in (F.lit(d), F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in s]))])
    campaign = spark.createDataFrame([(1, 7 * 60_000), (2, None), (3, 60_000)], "campaign_id long, interval_ms long").withColumn("window", F.when(F.col("campaign_id") < 3, window).otherwise(F.map_filter(window, lambda k, v: F.lit(False))))
    planned = spark.createDataFrame([(c, 100 + k, k) for c in (1, 2, 3) for k in range(1, 12)], "campaign_id long, contact_id long, rn int")
    got = pacing.send_times(planned, campaign, "2025-06-02 09:04:00", ahead=7).orderBy("rn").collect()  # a Monday
    at = [(r.campaign_id, r.rn, r.at.strftime("%d %H:%M")) for r in got]
    # 16 + 9 minutes on Monday, 5 on Wednesday, 20 + 9 on the next (a holiday's Monday has no window)
    assert at == [(1, 1, "02 09:04"), (1, 2, "02 09:11"), (1, 3, "02 09:18"), (1, 4, "02 23:55"), (1, 5, "04 10:03")]


def test_queued_cards_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        made.add(1)
        return i

    rows = [(i, i % 3, f"a{i % 2}@b.de", "A", "Ort", None, [str(i)], [], [], "T") for i in range(1, 13)]
    cards = spark.createDataFrame(rows, "id long, cb_id long, email string, company_name string, city string, land string, phones array<string>, websites array<string>, categories array<string>, description string")
    monkeypatch.setattr(entries, "queued", lambda t: cards.withColumn("id", seen("id")))
    spark, root = entries.worked_off(spark, SF)
    assert made.value == 12 and [tuple(r) for r in claims.ledger(spark, root).orderBy("batch").collect()] == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0)]
