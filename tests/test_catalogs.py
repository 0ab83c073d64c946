import pytest

from marktlens.parsing import blocks, catalogs


def test_places():
    page = blocks.Page('<div id=a class="x y"><p class=y>1<b>2</b> 3<br>4<p>5</div></i><p class="y">6<script>"</p>"</script></p><style>q</style>&amp;', {"in": "#a .y", "any": "p.y", "bold": "div b", "all": "p"})
    assert [f.text for f in page.named("in")] == ["1 2 3 4 5"] and [(f.first, f.text) for f in page.named("any")] == [("1", "1 2 3 4 5"), ("6", "6")]
    assert page.one("bold").text == "2" and page.one("bold", page.one("any")) is page.one("bold") and page.one("bold", page.named("any")[1]) is None
    assert len(page.named("all")) == 3 and blocks.Page(None, {"x": "p"}).found == []
    page = blocks.Page('<a href="1" data-role="n">x</a><a data-role="m">y</a><a>z', {"n": "a[data-role=n]", "a": "a"})
    assert [f.text for f in page.named("n")] == ["x"] and [f.text for f in page.named("a")] == ["x", "y", "z"]


def test_scalars():
    assert catalogs.mail(" mailto:a@b.de?x ") == "a@b.de" and catalogs.mail("a@b") == catalogs.mail(None) == catalogs.mail("a.de") == ""
    assert catalogs.phone("TEL:0123 456?x") == "0123 456" and catalogs.phone("12345") == ""
    assert catalogs.site("javascript:x.y") == catalogs.site("no link") == "" and catalogs.site(" a.de ") == "a.de" and catalogs.site("http://a b") == "http://a b"
    assert catalogs.longest_same("Haus  A", "HAUS a", "z") == "Haus A" and catalogs.longest_same("ab", "AB ") == "ab" and catalogs.longest_same("", "b") == "b" and catalogs.longest_same() == ""


def test_gs_detail():
    assert catalogs.gs_detail("<p>nothing</p>") is None and catalogs.gs_detail(None) is None
    card = catalogs.gs_detail(
        '<div class="mod mod-Kontaktdaten"><span class="gc-text--h2">Only Here</span><div class="mod-Kontaktdaten__address-container"><p class="adresse-text">Weg 1,<br>Ort</p></div><ul><li class="mod-Kontaktdaten__list-item contains-icon-big-fax">Fax 12</li>'
        '<li class="mod-Kontaktdaten__list-item contains-icon-big-tel">Ruf: 0123 / 4567</li></ul><div class="contains-icon-big-email"><a href="#">c@d.de</a></div><a href="mailto:e@f.de">x</a><div class="mod-Kontaktdaten__social-media-iconlist"><a href="https://s.de/1">s</a><a href="https://s.de/1">s</a></div></div>'
        '<a class="mod-WeitereStandorte__list-item" href=" /1 ">a</a><address class="mod-TeilnehmerKopf__adresse"><span class="mod-TeilnehmerKopf__adresse-daten">Platz 3,</span><span class="mod-TeilnehmerKopf__adresse-daten">Köln</span></address>'
    )
    assert (card["company_name"], card["address"], card["street"], card["plz"], card["city"]) == ("Only Here", "Weg 1, Ort", "Platz 3", "", "Köln")
    assert (card["emails"], card["email"], card["fax"], card["phones"], card["socials"], card["children"], card["websites"]) == (["c@d.de", "e@f.de"], "c@d.de", ["Fax 12"], ["Ruf: 0123 / 4567"], ["https://s.de/1"], ["/1"], [])


@pytest.mark.parametrize("code, plz", [("", ""), ("00012", "00012"), ("D-00012", "D-00012"), ("00012,", "00012,")])
def test_streets_with_five_digits_are_no_code(code, plz):
    parts = "".join(f'<span class="mod-TeilnehmerKopf__adresse-daten">{p}</span>' for p in ("Weg 12345, ", code, "Ort"))
    card = catalogs.gs_detail(f'<h1 class="mod-TeilnehmerKopf__name">A</h1><address class="mod-TeilnehmerKopf__adresse">{parts}</address>')
    assert (card["street"], card["plz"], card["city"]) == ("Weg 12345", plz, "Ort")


def test_index_pages_keep_to_their_code():
    one = lambda n, town: f'<article class="mod mod-Treffer"><a href="/other">o</a><a href="https://g.de/gsbiz/{n}">l</a><h2 class="mod-Treffer__name">N{n}</h2><span class="mod-AdresseKompakt__adress__ort">{town}</span></article>'
    html = one(1, "12345 Ort") + one(2, "99999 Ort") + one(1, "12345 Ort") + one(3, "Ort") + '<article class="mod mod-Treffer">no link</article>'
    assert [c["url"][-1] for c in catalogs.gs_index(html, plz="12345")[0]] == ["1"]
    found, further = catalogs.gs_index(html)
    assert [(c["company_name"], c["plz"], c["city"], c["address"]) for c in found] == [("N1", "12345", "Ort", "12345 Ort"), ("N2", "99999", "Ort", "99999 Ort"), ("N3", "", "", "Ort")] and further == ""
    assert catalogs.b_index('<script type="application/ld+json">[{"itemListElement": [1, {"item": 2}, {"item": {"url": "x.de/1"}}, {"item": {"url": "x.de/2", "name": "A", "address": "text", "telephone": null}}]}, "x"]</script>') [0] == [{"url": "x.de/2", "company_name": "A", "street": "", "plz": "", "city": "", "address": "", "phone": "", "email": "", "rating": "", "reviews": ""}]
    pages = '<div class="pagination"><span class="numbertext"><a href="http://b.de/?page=3">3</a><a href="http://b.de/?page=2">2</a><a href="http://b.de/?page=1">1</a></span></div>'
    assert catalogs.b_index(pages)[1] == "http://b.de/?page=2" and catalogs.b_index(pages + '<div class="pagination"><b class="numbertext--current">3</b></div>')[1] == ""


@pytest.mark.parametrize("catalog", ["gs", "11880"])
def test_odd_pages(spark, catalog):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<h1>x"), (4, "u", "<" * 5000)], "page_id long, url string, html string")
    assert [r.company_name for r in catalogs.details(df, catalog).collect()] == ([] if catalog == "gs" else ["x"])
    assert catalogs.index_cards(df, catalog).collect() == [] and catalogs.details(df.filter("false"), catalog).collect() == []


def test_cards_of_an_index_page_look_at_what_is_within_them(monkeypatch):
    looked, within = [], blocks.Found.within
    monkeypatch.setattr(blocks.Found, "within", lambda self, other: looked.append(1) or within(self, other))
    one = '<article class="mod mod-Treffer"><a href="https://g.de/gsbiz/{}">l</a><h2 class="mod-Treffer__name">N{}</h2></article>'
    found, _ = catalogs.gs_index("".join(one.format(i, i) for i in range(200)))
    assert [c["company_name"] for c in found] == [f"N{i}" for i in range(200)] and len(looked) <= 200 * 8
