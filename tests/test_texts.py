import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marktlens.functions import letters, nested, websites
from marktlens.operators import titles


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def merged(spark, urls):
    rows = spark.createDataFrame([(1, i, u) for i, u in enumerate(urls)], "k long, pos int, url string")
    return [r.url for r in websites.merge_websites(rows, "k", "url", "pos").orderBy("place").collect()]


def test_websites(spark):
    assert merged(spark, ["http://a.de/x/", "www.a.de", "https://a.de/x", "b.org?q=1", "Junk"]) == ["www.a.de/", "http://www.a.de/x/", "https://www.a.de/x", "b.org?q=1", "junk/"]
    assert merged(spark, ["http://A.de/x", "https://b.de", "a.de", "a.de/"]) == ["a.de/", "http://a.de/x", "https://b.de/"]
    assert merged(spark, ["/only/path", "", None, " /only/path ", "localhost", "user:pw@h.de:80/p?#f"]) == ["/only/path", "localhost/", "h.de/p#f"]
    assert merged(spark, ["a.de/x?b", "a.de/x", "a.de/x#c", "a.de/x?b"]) == ["a.de/x?b", "a.de/x", "a.de/x#c"]
    rows = spark.createDataFrame([(None, 0, "a.de"), (None, 1, "www.a.de"), (2, 0, "a.de")], "k long, pos int, url string")
    assert sorted(map(tuple, websites.merge_websites(rows, "k", "url", "pos").collect()), key=str) == [(2, 1, "a.de/"), (None, 1, "www.a.de/")]


def serial(new, taken):
    """Titles one after another: first those that can stay, then those that only lose their number, then the rest."""
    held, out, left = set(taken), {}, sorted(new)
    for step in range(3):
        waiting = []
        for w, i, t in left:
            base = re.sub(r"\s*-\s*#\d+\s*$", "", t.strip()).strip() or t.strip()
            if step == 0 and (t.strip() == "" or (w, t.strip()) not in held):
                out[w, i] = t.strip()
            elif step == 1 and (w, base) not in held:
                out[w, i] = base
            elif step == 2:
                k = 2
                while (w, f"{base} - #{k}") in held:
                    k += 1
                out[w, i] = f"{base} - #{k}"
            else:
                waiting.append((w, i, t))
                continue
            if out[w, i]:
                held.add((w, out[w, i]))
        left = waiting
    return out


def test_titles(spark):
    r = random.Random(1)
    some = ["A", " A ", "A - #2", "A - #3", "A-#5", "A - #2 - #2", "B", "B - #07", "B - #2", "#1", " - #2", "", "C - #99999999999999999999", "C"]
    for size in (5, 60, 200):
        new = [(r.choice("xy"), i, r.choice(some)) for i in range(size)]
        taken = [(r.choice("xy"), r.choice(some).strip()) for _ in range(size // 5)] + [("x", f"A - #{k}") for k in (4, 6, 7, 11)]
        got = titles.unique_titles(spark.createDataFrame(new, "workspace_id string, id long, title string"), spark.createDataFrame(taken, "workspace_id string, title string"))
        got = {(x.workspace_id, x.id): x.unique_title for x in got.collect()}
        assert got == serial(new, taken)
        assert len({(w, t) for (w, _), t in got.items() if t}) == sum(t != "" for t in got.values())


def test_variables_come_back(spark):
    put = letters.filled(F.col("t"), F.col("m"))
    schema = "t string, m map<string,string>"
    values = {"a": "Anna", "b": "Anna Maria", "name": "a", "empty": "", "none": None, "re": "$1 (.*) \\"}
    text = "{{b}} {{ a }}: {{name}}, {{ re }}{{ empty }}|{{none}}{{ other }}{{ b"
    full = one(spark, schema, (text, values), put)
    assert full == "Anna Maria Anna: a, $1 (.*) \\|{{ other }}{{ b"
    assert one(spark, schema, (full, values), letters.unfilled(F.col("t"), F.col("m"))).startswith("{{ b }} {{ a }}: {{ name }}, {{ re }}|{{ other }}")
    assert one(spark, schema, ("", values), put) == "" and one(spark, schema, (None, values), put) is None
    assert one(spark, schema, ("plain", {}), letters.unfilled(F.col("t"), F.col("m"))) == "plain"
    assert letters.fill(text, {k: v or "" for k, v in values.items()}) == full


RULES = st.dictionaries(st.from_regex(r"\A[.a-z][a-z0-9]{0,5}\Z"), st.dictionaries(st.from_regex(r"\A[a-z-]{1,8}\Z"), st.from_regex(r"\A[a-z0-9#(),%]{1,9}(:[a-z]{1,3})?\Z"), min_size=1, max_size=4), max_size=5)


@settings(max_examples=150, deadline=None)
@given(RULES)
def test_css_round_trip(rules):
    assert letters.parse_css(letters.css_text(rules)) == rules


def test_css():
    css = "p { color : red; color: blue ; x ; :y; k:a:b }\n h1{}\n.c{top:1px}.c{left:2px;top:3px} p{margin:0}"
    assert letters.parse_css(css) == {"p": {"color": "blue", "k": "a:b", "margin": "0"}, ".c": {"top": "3px", "left": "2px"}}
    assert letters.css_text({"b": {"y": "1", "x": None}, "a": {}, ".z": {"q": "2"}}) == ".z{q:2;}\nb{y:1;}"


def test_styles_go_inline():
    rules = {"p": {"margin": "0", "color": "red"}, ".big": {"color": "blue", "font-size": "20px"}, "a": {"top": "1px"}}
    begin, end = letters.PARAGRAPH
    assert letters.inline_styles('<p class="big">x</p>', rules) == begin.format(' style="margin:0;color:blue;font-size:20px;"') + "x" + end
    assert letters.inline_styles('<A href="u" style=\'x\' class="none">y</A>', rules) == '<a href="u" style="top:1px;">y</A>'
    assert letters.inline_styles("<td class=\"q\" style=z>1</td></p><p>2<p>3</p>", {}) == "<td>1</td></p>" + begin.format("") + "2" + begin.format("") + "3" + end + end
    assert letters.inline_styles(None, rules) == "" and letters.inline_styles("a < b", rules) == "a < b"
    assert letters.render("<p>{{ content }}</p>", "{{ x }}", {"x": "1"}, {}) == begin.format("") + "1" + end


def test_what_is_empty_goes(spark):
    schema = "s struct<a:string,b:array<struct<c:string,d:int>>,m:map<string,array<string>>,e:struct<f:string,g:struct<h:string>>,n:int,t:boolean>"
    value = ("  x ", [(" ", None), (None, 0), None], {"k": ["", None], "l": [" y"]}, (" ", ("\t",)), None, False)
    df = spark.createDataFrame([(value,), ((None, [], {}, None, None, None),), (None,)], schema)
    got = [r.j and json.loads(r.j) for r in df.select(F.to_json(nested.drop_empty(F.col("s"), df.schema["s"].dataType)).alias("j")).collect()]
    assert got == [{"a": "x", "b": [{"d": 0}], "m": {"l": ["y"]}, "t": False}, None, None]


def test_typed_json(spark):
    spec = {"host": str, "port": int, "security": ("ssl", "starttls", 1, True), "more": nested.Maybe({"deep": [{"x": int}], "any": dict}), "list": list, "share": float}
    good = {"host": "h", "port": 12345678901234567890, "security": "ssl", "more": {"deep": [{"x": 1}], "any": {}}, "list": [1, "a"], "share": 1}

    def errors(value):
        return one(spark, "t string", (value if value is None or isinstance(value, str) else json.dumps(value),), nested.json_errors(F.col("t"), spec))

    assert errors(good) == [] and errors(good | {"more": None, "security": 1, "share": 1.5}) == [] and errors(good | {"security": True}) == []
    assert errors(good | {"port": True, "host": None, "security": "1"}) == ["$.host: must be str", "$.port: must be int", "$.security: must be one of 1, True, ssl, starttls"]
    assert errors(good | {"port": 1.0, "share": "1", "list": {}}) == ["$.port: must be int", "$.list: must be list", "$.share: must be float"]
    assert errors(good | {"more": {"deep": [{"x": 1}, {"x": "1", "y": 2}, 3], "any": []}}) == ["$.more.deep[1].y: extra", "$.more.deep[1].x: must be int", "$.more.deep[2]: must be dict", "$.more.any: must be dict"]
    assert errors({"host": "h", "zz": 1, "a.b": 2}) == [f"$.{k}: missing" for k in ("list", "more", "port", "security", "share")] + ["$.a.b: extra", "$.zz: extra"]
    assert errors("[1]") == ["$: must be dict"] and errors("nope") == errors(None) == ["$: not JSON"]


def test_contact_text(spark):
    fields = "company_name string, company_names array<string>, address string, land string, addresses array<string>, categories array<string>, keywords array<string>, statuses array<string>, phones array<string>, socials array<string>, description_web string, description string"
    row = (" Firma ", ["Firma", "Alt", "Alt "], "Weg 1", "Hessen", ["Weg 1, Hessen", "Weg 2"], ["a", "a", None], None, [" "], ["1", "2"], [], "Web", "  ")
    said = lambda r: one(spark, f"s struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>", (r,), nested.contact_text(F.col("s")))
    assert said(row) == "Firma\n\nWeg 1, Hessen\n\nGeschaeftskategorien:\na\n\n1\n2\n\nWeb\n\nWeitere Unternehmensnamen:\nAlt\n\nWeitere Adressen:\nWeg 2"
    assert said((None,) * 12) == ""
    with pytest.raises(Exception, match="company_name"):
        one(spark, "s struct<x:int>", ((1,),), nested.contact_text(F.col("s")))
