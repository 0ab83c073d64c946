import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from marktlens.functions import hashing, letters, text
from marktlens.functions import window_time as wt
from marktlens.operators import filters, joins, ranking
from marktlens.parsing import cards, mails
from marktlens.plans import expansion, resolution
from marktlens.sources import files
from marktlens.streaming import clicks, machines


def one(spark, value, *columns, schema="v string"):
    return tuple(spark.createDataFrame([(value,)], schema).select(*columns).first())


def test_hash_values(spark):
    assert one(spark, "", hashing.h64("v")) == (-1970711489451281740,)
    rows = spark.range(1, 400).select(hashing.short_id(F.col("id"), 0x5A5A, 2654435761).alias("s")).distinct().count()
    assert rows == 399


def test_holidays():
    assert wt.easter(2025) == dt.date(2025, 4, 20) and wt.easter(2024) == dt.date(2024, 3, 31)
    assert dt.date(2025, 6, 9) in wt.german_holidays(2025) and len(wt.german_holidays(2025)) == 9


SLOTS = [{"from": "09:00", "to": "12:00"}, {"from": "11:00", "to": "13:00"}, {"from": "x", "to": "13:00"}, {"from": "14:00", "to": "13:00"}, {"from": "24:00", "to": "25:00"}]


@pytest.mark.parametrize("now,inside,rest", [("08:59", False, 300), ("09:00", True, 300), ("12:00", True, 60), ("13:00", False, 0)])
def test_windows(spark, now, inside, rest):
    df = spark.createDataFrame([({"thu": SLOTS},)], f"w {wt.WINDOW}")
    cur = F.lit(int(now[:2]) * 60 + int(now[3:]))
    s = wt.spans(F.col("w"), F.lit("thu"))
    assert tuple(df.select(wt.window_minutes(s), wt.in_window(s, cur), wt.remaining(s, cur)).first()) == (300, inside, rest)


def test_next_start(spark):
    df = spark.createDataFrame([({"thu": [{"from": "09:00", "to": "10:00"}], "hol": [{"from": "07:30", "to": "08:00"}]},)], f"w {wt.WINDOW}")

    def at(now):
        return str(df.select(wt.next_start(F.col("w"), F.lit(now).cast("timestamp"), (2025, 2026))).first()[0])

    assert at("2025-04-17 09:30:00") == "2025-04-17 09:30:00"  # within a slot
    assert at("2025-04-17 10:00:00") == "2025-04-18 07:30:00"  # Good Friday
    assert at("2025-04-22 00:00:00") == "2025-04-24 09:00:00"


def test_texts(spark):
    assert one(spark, " a \t b ", text.clean(F.col("v"))) == ("a b",)
    assert one(spark, "  ", text.clean(F.col("v"))) == (None,)
    assert one(spark, "1.234", text.comma_number(F.lit("12,5")), text.comma_number(F.lit("x"))) == (12.5, None)
    assert one(spark, "1067", text.padded_plz(F.col("v")), text.padded_plz(F.lit("123456"))) == ("01067", "123456")
    assert one(spark, "Yes, of course", text.yes_no(F.col("v")), text.yes_no(F.lit("нет.")), text.yes_no(F.lit("maybe"))) == (True, False, None)
    assert one(spark, "a\n\nb", text.append_paragraph(F.col("v"), F.lit("b")), text.append_paragraph(F.col("v"), F.lit("c"))) == ("a\n\nb", "a\n\nb\n\nc")
    assert one(spark, "x", text.address(F.lit(None), F.lit("Weg 1"), F.lit("01067"), F.lit("Ort")), text.address(F.lit(" A "), F.lit("Weg 1"), F.lit(""), F.lit(""))) == ("Weg 1, 01067 Ort", "A")


def test_bounces(spark):
    false = F.lit(False)
    for mail, want in (("Status: 5.1.1\n", "hard"), ("x\n status: 4.2.2", "soft"), ("Diagnostic-Code: smtp; 550 no", "hard"), ("smtp said 451 later", "soft"), ("From: Mailer-Daemon", "soft"), ("hello 550", None)):
        assert one(spark, mail, text.bounce_kind(F.col("v"), false)) == (want,), mail
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("string")
    got = one(spark, "", text.reply_kind(f, t, n, f, f), text.reply_kind(t, f, n, f, f), text.reply_kind(t, t, F.lit("hard"), t, f), text.reply_kind(t, t, n, t, t), text.reply_kind(t, t, n, f, t), text.reply_kind(t, t, n, f, f))
    assert got == ("FOREIGN", "UNKNOWN", "HARD", "ANGRY_CONTACT", "AUTO_RESPONSE", "ANSWER")


def test_letters():
    assert letters.fill("Hi {{ name }}, {{other}}", {"name": "A"}) == "Hi A, {{other}}"
    assert letters.mark_links('<a href="https://a.de/?x=1#f">', 7) == '<a href="https://a.de/?x=1&smrel=7#f">'
    assert letters.sanitize('<p class="x" onclick="y()">a<script>bad()</script><i>b</i> &lt;c&gt;</p>') == '<p class="x">ab &lt;c&gt;</p>'
    assert letters.plain('<p>Go <a href="http://a.de">here</a><br>now</p>') == "Go here (http://a.de)\nnow"
    page = "<html><body><nav>Home | Shop | About | More</nav><p>A real line of words here</p><p>A real line of words here</p><p>short</p><p>Unser Impressum finden Sie hier</p></body></html>"
    assert letters.page_text(page) == "A real line of words here" and letters.page_text("no body") == ""


def test_cards():
    html = '<h1>Firma &amp; Co</h1><a href="mailto:A@b.de?x">m</a><span data-cfemail="422302206c2627"></span><a href="tel:+49 123456">t</a><p>Weg 1, 01067 Ort</p><script type="application/ld+json">{"name": "x", "geo": {"a": 1}}</script><script type="application/ld+json">{bad</script>'
    c = cards.card(html)
    assert c["company_name"] == "Firma & Co" and c["emails"] == ["a@b.de", "a@b.de"[:0] + "a@b.de"][:1] and c["plz"] == "01067" and json.loads(c["data"]) == [{"name": "x"}] and c["phones"] == ["+49 123456"]


def test_resolution(spark):
    rows = [(1, 5, " A@x.de", None, "K", None, ["1"], ["w"], ["c"], "p"), (2, 5, "a@X.de", "Late", "L", "S", ["2", "1"], [], ["d"], "q"), (3, 6, "a@x.de", "Later", "", "T", None, ["w"], None, "p"), (4, 6, "", "E", "", "", [], [], [], ""), (5, 6, "a@@x", "E", "", "", [], [], [], "")]
    df = spark.createDataFrame(rows, "id long, cb_id long, email string, company_name string, city string, land string, phones array<string>, websites array<string>, categories array<string>, description string").repartition(3)
    r = resolution.resolve(df).first()
    assert (r.email, r.company_name, r.city, r.land, r.phones, r.websites, r.categories, r.description, r.n_cards) == ("a@x.de", "Late", "K", "S", ["1", "2"], ["w"], ["c", "d"], "p\n\nq", 3)
    assert [(p.cb_id, p.card_id) for p in r.pairs] == [(5, 2), (6, 3)]
    got = {x.outcome: x.n for x in resolution.outcome(df, df.filter("id < 0")).collect()}
    assert got == {"CREATED": 1, "UPDATED": 2, "EMPTY": 1, "INVALID": 1}


def test_resolution_in_batches(spark):
    """Batches in order of their ids give what all cards give at once, long lists of one address and repeated cards included."""
    schema = "id long, cb_id long, email string, company_name string, city string, land string, phones array<string>, websites array<string>, categories array<string>, description string"
    rows = [(i, i % 4, f"{'hot' if i % 3 else i % 7}@x.de", None if i % 5 else f"n{i}", "", None, [str(i % 6), None, str(i % 2)], None if i % 2 else [], [], "p\n\nq" if i % 2 else f"r{i % 4}") for i in range(60)]
    cards = spark.createDataFrame(rows, schema)
    whole = {r.email: r for r in resolution.resolve(cards).collect()}
    held = resolution.resolve(cards.filter("id < 25"))
    changed = resolution.resolve_into(held, cards.filter("id >= 25"))
    assert {r.email: r for r in changed.unionByName(held.join(changed, "email", "left_anti")).collect()} == whole
    assert whole["hot@x.de"].description == "p\n\nq\n\nr2\n\nr0" and whole["hot@x.de"].websites == [] and whole["hot@x.de"].n_cards == 40
    assert resolution.resolve_into(held, cards.filter("false")).count() == 0


def test_best_pairs_of_any_rates(spark):
    """Pruning by ranks keeps the best pairs, with ties and with rates of zero and below."""
    schema = "task_id long, {} long, rate int"
    cities = spark.createDataFrame([(t, i, (i * 7 + t) % 5 - (t == 2)) for t in (1, 2, 3) for i in range(12)], schema.format("city_id")).withColumn("rate", F.expr("if(task_id = 3, rate + 1, rate)"))
    branches = spark.createDataFrame([(t, i, (i * 3 + t) % 4 + (t == 3)) for t in (1, 2, 3) for i in range(9)], schema.format("branch_id"))
    codes = spark.createDataFrame([(i, f"{i:05d}", i) for i in range(12)], "id long, plz string, city_id long")
    args = (cities, branches, codes.select("city_id", "plz"), codes.select("id", "plz"))
    every = [tuple(r) for r in expansion.expand_pairs(*args, None).select("task_id", "score", "plz_id", "branch_id").collect()]
    for keep in (1, 7, 30, 500):
        got = expansion.expand_pairs(*args, keep).select("task_id", "score", "plz_id", "branch_id", "rn").collect()
        want = [x for t in (1, 2, 3) for x in sorted(e for e in every if e[0] == t)[:keep]]
        assert sorted(tuple(r)[:4] for r in got) == sorted(want)


def test_rules():
    with pytest.raises(ValueError):
        filters.where({"sql": "1 = 1"})


def test_pages(spark):
    df = spark.range(23)
    at = lambda n: [r.id for r in ranking.page(df, [F.col("id")], n, 10).collect()]
    assert at(0) == list(range(10)) and at(99) == [20, 21, 22]
    assert ranking.page_strip(10, 20) == [1, None, 7, 8, 9, 10, 11, 12, 13, None, 20]


def test_retry_and_bounce(spark):
    def fold(*results):
        df = spark.createDataFrame([(1, i, r) for i, r in enumerate(results)], "cb_id long, seq long, result string")
        r = machines.retry_fold(df).first()
        return r.error, r.collected

    assert fold("SEARCH HTTP 500", "FAILED TO PARSE", "SEARCH HTTP 500") == ("HTTP ERROR 1", False)
    assert fold("SEARCH HTTP 500", "AJAX HTTP 1", "DETAIL HTTP 502") == ("DETAIL HTTP 502", True)
    assert fold("FAILED TO PARSE x", "BLOCKED", "FAILED TO PARSE", "FAILED TO PARSE") == ("FAILED TO PARSE", True)
    assert fold("OK", "SEARCH HTTP 500") == (None, True) and fold("SEARCH HTTP 404") == ("SEARCH HTTP 404", True)

    def blocked(*codes):
        df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1 + i), i, c) for i, c in enumerate(codes)], "contact_id long, time timestamp, seq long, code int")
        return machines.soft_bounces(df).count() == 1

    assert blocked(451, 451, 451) and not blocked(451, 451, None, 451)


def test_streams(spark, tmp_path):
    rows = [(1, i, r) for i, r in enumerate(["SEARCH HTTP 500"] * 3)] + [(2, 9, "OK")]
    spark.createDataFrame(rows, "cb_id long, seq long, result string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cb_id long, seq long, result string").parquet(str(tmp_path / "in"))
    q = machines.retry_stream(stream).writeStream.format("memory").queryName("retry").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.cb_id, r.error, r.collected, r.seen) for r in spark.table("retry").collect()} == {(1, "SEARCH HTTP 500", True, 3), (2, None, True, 1)}
    bounces = [(1, dt.datetime(2024, 1, d), d, 451) for d in (1, 2, 3)] + [(2, dt.datetime(2024, 1, d), d, c) for d, c in ((1, 451), (2, None), (3, 451))]
    spark.createDataFrame(bounces, "contact_id long, time timestamp, seq long, code int").coalesce(1).write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema("contact_id long, time timestamp, seq long, code int").parquet(str(tmp_path / "b"))
    q = machines.soft_bounce_stream(stream).writeStream.format("memory").queryName("bounce").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.contact_id for r in spark.table("bounce").collect()] == [1]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("2024-01-01T00:00:05Z\t7\nbad\n2024-01-01T00:10:00+01:00\t8\nx\t9\n")
    clicks.append(clicks.click_stream(spark, str(tmp_path / "log")), str(tmp_path / "t"), str(tmp_path / "e")).awaitTermination()
    assert {(r.letter_id, str(r.time)) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(7, "2024-01-01 00:00:05"), (8, "2023-12-31 23:10:00")}


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",lat,lng\n1067,51.06,13.7\n99999,x,1\n")
    assert [tuple(r) for r in files.plz_coordinates(spark, str(tmp_path / "p.csv")).collect()] == [("01067", 51.06, 13.7)]
    (tmp_path / "a.json").write_text(json.dumps([{"domain": "A.de"}, "b.de", {"x": 1}]))
    assert {r.domain for r in files.email_allowlist(spark, str(tmp_path / "a.json")).collect()} == {"a.de", "b.de"}
    (tmp_path / "g.csv").write_text("head,,\n60,x,1\nnote,y,2\n")
    assert [tuple(r) for r in files.municipal_register(spark, str(tmp_path / "g.csv"), ["kind", "name", "n"]).collect()] == [(60, "x", "1")]
    out = str(tmp_path / "k")
    files.replace_by_key(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), out, "k")
    files.replace_by_key(spark.createDataFrame([(1, "c")], "k long, v string"), out, "k")
    assert {tuple(r) for r in spark.read.parquet(out).select("k", "v").collect()} == {(1, "c"), (2, "b")}
    files.replace_by_key(spark.createDataFrame([(None, "d"), (2, "e"), (2, "f")], "k long, v string"), out, "k")
    files.replace_by_key(spark.createDataFrame([(None, "g")], "k long, v string"), out, "k")
    assert {tuple(r) for r in spark.read.parquet(out).select("k", "v").collect()} == {(1, "c"), (2, "e"), (2, "f"), (None, "g")}
    files.replace_by_key(spark.createDataFrame([(3, "h")], "k long, v string"), out, "k", keys=spark.createDataFrame([(2,), (3,), (9,)], "k long"))
    assert {tuple(r) for r in spark.read.parquet(out).select("k", "v").collect()} == {(1, "c"), (3, "h"), (None, "g")}
    files.replace_by_key(spark.createDataFrame([], "k long, v string"), out, "k", keys=spark.createDataFrame([(1,), (None,)], "k long"))
    assert {tuple(r) for r in spark.read.parquet(out).select("k", "v").collect()} == {(3, "h")}
    rows, new = files.memo_join(spark.createDataFrame([(1,), (2,)], "k long"), "k", spark.createDataFrame([(1, 10)], "k long, r long"), lambda keys: keys.withColumn("r", F.col("k") * 100))
    assert {tuple(r) for r in rows.collect()} == {(1, 10), (2, 200)} and new.count() == 1


def test_sanitize_keeps_entities_and_addresses():
    assert letters.sanitize("<p>a &amp; b &lt;i&gt; &#8364; 1 < 2</p>") == "<p>a &amp; b &lt;i&gt; &#8364; 1 &lt; 2</p>"
    assert letters.sanitize('<a href="a?x=1&amp;y=2" onclick="x" CLASS=\'b "c"\' align=left>t</a>') == '<a href="a?x=1&amp;y=2" class="b &quot;c&quot;" align="left">t</a>'
    assert letters.sanitize('<a href="&#106;avascript:x()">t</a>') == "<a>t</a>"
    assert 'href="https://a.de/?x=1&y=2"' in letters.sanitize('<a href="https://a.de/?x=1&y=2">t</a>')


def test_page_text_needs_a_closed_body():
    line = "A line that says something about pumps"
    assert letters.page_text(f"<html><body><p>{line}</p><script>var hidden = 1</script></body></html>") == line
    assert letters.page_text(f"<html><body><p>{line}</p>") == "" == letters.page_text(None)
    page = f"<body><nav>Start of the long navigation of this page</nav><p>{line}</p><!-- no --><p>{line}</p>Home | Shop | Cart | Help<p>ok</p></body>"
    assert letters.page_text(page, fix_blocks=True) == line and "navigation" in letters.page_text(page)


def test_bounce_status_lines(spark):
    mails = ["Status: 5.1.1 (bad)", "x\nstatus : 4.2.2\n", "Status: 5.1\nSMTP error 451 later", "status 5.1.1", "Status: 2.0.0"]
    rows = spark.createDataFrame(list(enumerate(mails)), "i int, mail string")
    got = [r.k for r in rows.select("i", text.bounce_kind(F.col("mail"), F.lit(False)).alias("k")).orderBy("i").collect()]
    assert got == ["hard", "soft", "soft", None, None]


def test_nearest_far_and_near(spark):
    r = random.Random(3)
    places = [(i, r.uniform(47, 55), r.uniform(5, 15)) for i in range(40)] + [(100, -80.0, 170.0), (101, 50.0, 7.0), (102, 50.0, 7.0)]
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)] + [(60 + i, r.uniform(47, 55), r.uniform(5, 15)) for i in range(60)] + [(200, 50.0, 7.0)]
    got = {x.point_id: x.place_id for x in joins.nearest(spark.createDataFrame([*points, (300, None, 1.0)], "id long, lat double, lon double"), spark.createDataFrame(places, "id long, lat double, lon double"), 0.25).collect()}
    assert got == {p: min(((b - y) ** 2 + (c - x) ** 2, i) for i, b, c in places)[1] for p, y, x in points}


def test_mails_of_all_sorts():
    assert mails.read(None)[:3] == ("", False, {}) and mails.read(b"\xff\xfe no head")[5] is None
    report = b"Date: nonsense\r\nContent-Type: multipart/report; boundary=b\r\n\r\n--b\r\nContent-Type: message/delivery-status\r\n\r\nStatus: 4.0.0\r\n\r\n--b--\r\n"
    assert mails.read(report)[1] is True and mails.read(report)[5] is None
    odd = b"Date: Mon, 1 Jan 2024 00:00:00\r\nContent-Type: text/plain; charset=no-such\r\n\r\ncaf\xc3\xa9"
    assert mails.read(odd)[4] == "caf\u00e9" and mails.read(odd)[5] == dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_letter_ids(spark):
    for mail, want in {"Sent-By: App 2\nLetter: 17": 17, "> letter: 5\r\n> SENT-BY: app": 5, "Letter: 5": None, "Sent-By: app\nLetter: 0": None, "Sent-By: other\nLetter: 5": None, "": None}.items():
        assert one(spark, mail, text.letter_id(F.col("v"), "app", ("Sent-By", "Letter"))) == (want,), mail


def test_answers(spark):
    for answer, want in {'{"a": 1}': '{"a": 1}', '```json\n{"a": 1}\n```': '{"a": 1}', 'Sure: {"a": {"b": 2}} done': '{"a": {"b": 2}}', "none": None, "": None, "{broken": None}.items():
        assert one(spark, answer, text.answer_json(F.col("v"))) == (want,), answer
    assert [one(spark, v, text.json_object(F.col("v")))[0] for v in (None, " ", "[1]", '{"a": 1}', "{")] == ["{}", "{}", "{}", '{"a": 1}', "{}"]
    with pytest.raises(Exception, match="no JSON object"):
        one(spark, "[1]", text.json_object(F.col("v"), strict=True))


def test_headers_that_mails_share_are_parsed_once():
    raw = b"From: a@x.de\r\nDate: Thu, 17 Apr 2025 10:30:00 +0200\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHallo\r\n"
    first, before = mails.read(raw), mails.POLICY.header_factory.cache_info().misses
    assert all(mails.read(raw) == first for _ in range(20)) and mails.POLICY.header_factory.cache_info().misses == before
    assert mails.read(raw.replace(b"a@x", b"b@x"))[2]["from"] == "b@x.de" and mails.read(raw)[2]["from"] == "a@x.de"
