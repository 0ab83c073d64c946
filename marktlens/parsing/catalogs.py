"""Cards of the two business catalogs, `gs` and `11880`: of detail pages, and of index pages with several cards each.

What stands where on their pages is a table of places for each kind of page; a page is parsed once, in batches on Spark. Pages without a
company's name give no card. Texts are cleaned; lists have no repeats and keep their order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktlens.parsing.blocks import Found, Page, clean
from marktlens.parsing.cards import embedded, hidden_email

# Places of the fields on the pages of the two catalogs.
GS_DETAIL = {
    "name": "h1.mod-TeilnehmerKopf__name", "category": ".mod-TeilnehmerKopf__branchen span[data-selenium=teilnehmerkopf__branche]", "address": "address.mod-TeilnehmerKopf__adresse", "part": "address.mod-TeilnehmerKopf__adresse .mod-TeilnehmerKopf__adresse-daten", "bare": "address.mod-TeilnehmerKopf__adresse .mod-TeilnehmerKopf__adresse-daten--noborder",
    "mail": "#email_versenden", "bar": "div.aktionsleiste a", "home": "div.aktionsleiste a i.icon-homepage",
    "contact": "div.mod-Kontaktdaten", "contact_name": "div.mod-Kontaktdaten .gc-text--h2", "contact_address": "div.mod-Kontaktdaten .mod-Kontaktdaten__address-container .adresse-text",
    "phone": "div.mod-Kontaktdaten .mod-Kontaktdaten__list-item.contains-icon-big-tel", "fax": "div.mod-Kontaktdaten .mod-Kontaktdaten__list-item.contains-icon-big-fax", "site": "div.mod-Kontaktdaten .contains-icon-big-homepage a",
    "link": "div.mod-Kontaktdaten a", "mail_link": "div.mod-Kontaktdaten .contains-icon-big-email a", "social": "div.mod-Kontaktdaten .mod-Kontaktdaten__social-media-iconlist a", "number": "div.mod-Kontaktdaten [data-role=telefonnummer]",
    "about": "section#beschreibung .mod-Beschreibung", "child": "a.mod-WeitereStandorte__list-item",
}
GS_INDEX = {
    "card": "article.mod-Treffer", "link": "article.mod-Treffer a", "name": "article.mod-Treffer h2.mod-Treffer__name", "category": "article.mod-Treffer p.mod-Treffer--besteBranche", "street": "article.mod-Treffer .mod-AdresseKompakt__adress-text",
    "town": "article.mod-Treffer span.mod-AdresseKompakt__adress__ort", "phone": "article.mod-Treffer .mod-TelefonnummerKompakt__phoneNumber", "site": "article.mod-Treffer .mod-WebseiteKompakt a",
}
B_DETAIL = {
    "name": "h1", "item": ".item-detail-information .entry-detail-list__item", "contact": "#kontakt .entry-detail-list__item", "icon": ".entry-detail-list__icon", "label": ".entry-detail-list__label", "row": ".entry-detail-list__label div div", "code": ".js-postal-code", "town": ".js-address-locality",
    "link": ".entry-detail-list__item a", "hidden": ".entry-detail-list__item .__cf_email__", "site": ".tracking--entry-detail-website-link", "trade": ".trades-list", "feature": ".features li", "entry_feature": ".entry-detail-feature-list li",
    "status": "#additional-features .additional-feature-label", "keywords": ".top-media-keywords", "about": ".box-entry-detail--about", "about_us": "#ueber-uns .content", "about_box": "#about-us .content", "about_entry": ".entry-detail-about-us .content",
    "term": "#trade-service-features p", "terms": "#trade-service-features .term-box__panel-content", "column": "#trade-service-features .term-box__panel-content .term-box__panel-col",
}
B_INDEX = {"current": ".pagination .numbertext--current", "page": ".pagination .numbertext a", "counter": ".pagination a.numbertext--counter"}
TERMS = {"categories": "Dieses Unternehmen bietet Dienstleistungen in folgenden Branchen an:", "keywords": "Das Unternehmen wird unter folgenden Suchworten gefunden:"}
DETAIL_LINK = "/gsbiz/"
CODE = r"(?:[A-Z]{1,2}[ -]+)?\d{5}\W*"  # a part of an address that is a postal code; a street may have five digits too

TEXTS = ["company_name", "street", "plz", "city", "district", "address", "email", "website", "description", "data", "data2"]
LISTS = ["categories", "emails", "phones", "fax", "websites", "socials", "keywords", "statuses", "children"]
DETAIL = "page_id long, " + ", ".join(f"{c} string" for c in TEXTS) + "".join(f", {c} array<string>" for c in LISTS)
INDEX_TEXTS = ["url", "company_name", "category", "street", "plz", "city", "district", "address", "phone", "email", "website", "rating", "reviews"]
INDEX = "page_id long, place int, " + ", ".join(f"{c} string" for c in INDEX_TEXTS) + ", next_page string"


def mail(text: str | None) -> str:
    """An address without mailto: and what follows a question mark, or nothing."""
    t = clean(text).removeprefix("mailto:").split("?")[0].strip()
    return t if len(t) >= 5 and "." in t.partition("@")[2] else ""


def phone(text: str | None) -> str:
    """A number as it is written, without tel:, if it has six digits."""
    t = clean(text)
    t = clean(t[4:].split("?")[0]) if t.lower().startswith("tel:") else t
    return t if len(re.sub(r"\D", "", t)) >= 6 else ""


def site(text: str | None) -> str:
    t = clean(text)
    bad = t.lower().startswith("javascript:")
    return t if not bad and (t.startswith(("http://", "https://")) or "." in t and " " not in t) else ""


def unique(values: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def longest_same(*values: str) -> str:
    """The first of the values; if another says the same but for case and blanks, the longer of both."""
    told = [v for v in map(clean, values) if v]
    same = [v for v in told[1:] if v.lower() == told[0].lower()][:1]
    return max(told[:1] + same, key=len, default="")


def _linked(a: Found, cleaner: Callable[[str], str]) -> str:
    """What a link leads to, or else the first of its texts that will do."""
    return cleaner(a.attributes.get("href", "")) or next((c for c in map(cleaner, a.all) if c), "")


def gs_detail(html: str | None) -> dict | None:
    """The card of a detail page of `gs`: its head, completed by its block of contact data."""
    page = Page(html, GS_DETAIL)
    first = lambda name: f.first if (f := page.one(name)) else ""
    name = longest_same(first("name"), first("contact_name"))
    if not name:
        return None
    parts = [t for f in page.found if f.name in ("part", "bare") for t in map(clean, f.own) if t]
    at = next((i for i, p in enumerate(parts) if re.fullmatch(CODE, p)), None)
    if at is None:
        street, plz, city = (parts[0].rstrip(",").strip() if parts else ""), "", (parts[1] if len(parts) > 1 else "")
    else:
        street, plz, city = ", ".join(p.rstrip(",").strip() for p in parts[:at]), parts[at], (parts[at + 1] if len(parts) > at + 1 else "")
    bar, links = page.named("bar"), page.named("link")
    emails = [mail(f.attributes.get("data-link")) for f in page.named("mail")[:1]] + [_linked(a, mail) for a in bar if a.attributes.get("href", "").startswith("mailto:")]
    emails += [_linked(a, mail) for a in page.found if a.name == "mail_link" or a.name == "link" and a.attributes.get("href", "").startswith("mailto:")]
    home = [a for i in page.named("home") for a in i.around if a.name == "bar"][:1]
    own_site = next((s for s in [*(_linked(a, site) for a in home), *(_linked(a, site) for a in bar if "title" in a.attributes)] if s), "")
    sites = unique(_linked(a, site) for a in page.named("site"))

    def numbers(kind: str) -> list[str]:
        out = []
        for block in page.named(kind):
            linked = next((p for a in links if a.within(block) and (p := _linked(a, phone))), "")
            suffix = phone(f.attributes.get("data-suffix")) if kind == "phone" and (f := page.one("number", block)) else ""
            out.append(linked or suffix or phone(block.text) or (block.text if kind == "fax" else ""))
        return unique(out)

    emails = unique(emails)
    return {
        "company_name": name, "street": street, "plz": plz, "city": city, "address": f.text if (f := page.one("contact_address")) else "", "email": emails[0] if emails else "", "website": longest_same(own_site, sites[0] if sites else ""),
        "description": f.text if (f := page.one("about")) else "", "categories": unique(f.first for f in page.named("category")), "emails": emails, "phones": numbers("phone"), "fax": numbers("fax"),
        "websites": unique([own_site, *sites]), "socials": unique(_linked(a, site) for a in page.named("social")), "children": unique(clean(a.attributes.get("href")) for a in page.named("child")),
    }


def gs_index(html: str | None, url: str | None = None, plz: str | None = None) -> tuple[list[dict], str]:
    """The cards of an index page of `gs`, those of one postal code if one is expected; each link once."""
    page, out = Page(html, GS_INDEX), {}
    for card in page.named("card"):
        first = lambda name, card=card: f.first if (f := page.one(name, card)) else ""
        link = site(next((a.attributes.get("href") for a in page.named("link", card) if DETAIL_LINK in a.attributes.get("href", "")), ""))
        town, street = first("town"), first("street").rstrip(",").strip()
        code = m[1] if (m := re.search(r"\b(\d{5})\b", town)) else ""
        district = next((m[1] for f in page.named("street", card) for t in f.own if (m := re.search(r"\(([^)]+)\)", t))), "")
        if link and (not plz or code == plz):
            out.setdefault(link, {"url": link, "company_name": first("name"), "category": first("category"), "street": street, "plz": code, "city": clean(town.replace(code, "", 1)) if code else "", "district": clean(district), "address": ", ".join(x for x in (street, town) if x), "phone": phone(first("phone")), "website": site(next((a.attributes.get("href") for a in page.named("site", card)), ""))})
    return list(out.values()), ""


def b_detail(html: str | None) -> dict | None:
    """The card of a detail page of `11880`: its list of entries, each told by its icon, embedded data, keywords and marks."""
    page = Page(html, B_DETAIL)
    name = f.text if (f := page.one("name")) else ""
    if not name:
        return None
    got: dict[str, list[str]] = {k: [] for k in ("phones", "fax", "emails", "websites")}
    street = plz = city = district = address = ""
    items = {id(f.attributes): f for f in page.found if f.name in ("item", "contact")}.values()
    for item in items:
        icon = " ".join(f.attributes.get("class", "") for f in page.named("icon", item))
        label = clean(" ".join(f.text for f in page.named("label", item))) or item.text
        hrefs = [clean(a.attributes["href"]) for a in page.named("link", item) if clean(a.attributes.get("href"))]
        tel = next((p for h in hrefs if h.lower().startswith("tel:") and (p := phone(h))), "")
        if "__icon--phone" in icon or "__icon--cellphone" in icon:
            got["phones"].append(tel or phone(re.sub(r"(?i)^(telefon|tel\.?)\s*:?\s*", "", label)))
        elif "__icon--fax" in icon:
            got["fax"].append(tel or phone(re.sub(r"(?i)^fax\s*:?\s*", "", label)))
        elif "__icon--email" in icon:
            told = [mail(h) for h in hrefs if h.lower().startswith("mailto:")] + [mail(hidden_email(c)) for f in page.named("hidden", item) if re.fullmatch(r"(?:[0-9a-fA-F]{2}){2,}", c := clean(f.attributes.get("data-cfemail")))]
            got["emails"] += [t for t in told if t] or ([] if "[email" in label.lower() else list(map(mail, re.findall(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", label))))
        elif "__icon--website" in icon:
            told = [site(h) for h in hrefs if not h.lower().startswith(("tel:", "mailto:"))]
            got["websites"] += [t for t in told if t] or list(map(site, re.findall(r"https?://[^\s,]+|www\.[^\s,]+", label)))
        elif "__icon--location" in icon and not address:
            address = label
            rows = page.named("row", item)
            street = rows[0].text if rows else ""
            plz, city = (clean(" ".join(f.text for f in page.named(k, item))) for k in ("code", "town"))
            district = clean(m[1]) if (m := re.search(r"\(([^)]+)\)\s*$", address)) else ""
    meta = lambda prop: re.findall(rf"""<[^>]*\bitemprop=["']{prop}["'][^>]*\bcontent=["']([^"']*)""", html or "")[:1]
    emails = unique([*got["emails"], *map(mail, meta("email"))])
    sites = unique([*got["websites"], *(site(f.attributes.get("href")) for f in page.named("site")[:1]), *map(site, meta("url"))])

    def terms(kind: str) -> list[str]:
        """The columns of the first box after the line that announces it."""
        after = next((page.found.index(f) for f in page.named("term") if TERMS[kind] in f.text), None)
        box = next((f for f in page.found[after:] if f.name == "terms"), None) if after is not None else None
        return [t for f in page.named("column", box) for t in map(clean, f.own)] if box else []

    said = re.sub(r"\(\+\d+\s*km\)", "", f.text) if (f := page.one("keywords")) else ""
    words = [clean(w) for w in re.split(r"\s*[,&]\s*", said) if clean(w)]
    if words and city:
        words[-1] = clean(re.sub(rf"(?i)\s+in\s+{re.escape(city)}\s*$", "", words[-1]))
    data, whole = embedded(html or ""), embedded(html or "", banned=())
    kinds = whole[1].get("@type", []) if len(whole) > 1 and isinstance(whole[1], dict) else []
    trades = [t for f in page.named("trade") for t in map(clean, f.all)]
    features = [t for f in page.found if f.name in ("feature", "entry_feature") for t in map(clean, f.own)]
    return {
        "company_name": name, "street": street, "plz": plz, "city": city, "district": district, "address": address, "email": emails[0] if emails else "", "website": sites[0] if sites else "",
        "description": next((f.text for k in ("about", "about_us", "about_box", "about_entry") if (f := page.one(k)) and f.text), ""), "data": json.dumps(data[0], sort_keys=True) if data else "", "data2": json.dumps(whole[1], sort_keys=True) if len(whole) > 1 and "FAQPage" not in kinds else "",
        "categories": unique([*trades, *terms("categories"), *features]), "emails": emails, "phones": unique(got["phones"]), "fax": unique(got["fax"]), "websites": sites, "keywords": unique([*words, *terms("keywords")]), "statuses": unique(f.first for f in page.named("status")),
    }


def _lists(node) -> Iterator[dict]:
    """The items of all item lists in JSON data, at any depth."""
    if isinstance(node, dict):
        if isinstance(node.get("itemListElement"), list):
            yield from (row["item"] for row in node["itemListElement"] if isinstance(row, dict) and isinstance(row.get("item"), dict))
        node = list(node.values())
    if isinstance(node, list):
        for x in node:
            yield from _lists(x)


def b_index(html: str | None, url: str | None = None, plz: str | None = None) -> tuple[list[dict], str]:
    """The cards of an index page of `11880`, from its embedded data, and the next page: of the pages with a greater number than this one the
    first."""
    out: dict[str, dict] = {}
    for item in _lists(embedded(html or "", banned=())):
        link, name, at, rated = site(str(item.get("url") or "")), clean(item.get("name")), item.get("address"), item.get("aggregateRating")
        at, rated = at if isinstance(at, dict) else {}, rated if isinstance(rated, dict) else {}
        street, code, city = (clean(at.get(k)) for k in ("streetAddress", "postalCode", "addressLocality"))
        numbers = item.get("telephone") or []
        if link and name and (not plz or code == plz):
            out.setdefault(link, {"url": link, "company_name": name, "street": street, "plz": code, "city": city, "address": clean(" ".join(x for x in (street and f"{street},", code, city) if x)), "phone": next(filter(None, map(phone, [numbers] if isinstance(numbers, str) else numbers)), ""), "email": mail(item.get("email")), "rating": clean(str(rated.get("ratingValue") or "")), "reviews": clean(str(rated.get("reviewCount") or ""))})
    page, later = Page(html, B_INDEX), []
    here = int(f.first) if (f := page.one("current")) and f.first.isdigit() else 1
    for a in page.found:
        if a.name != "current" and "href" in a.attributes and (link := site(urljoin(url or "", a.attributes["href"]))):
            n = next((x for x in [*parse_qs(urlparse(link).query).get("page", [])[:1], a.attributes.get("data-page", "")] if x.isdigit()), None)
            later += [(int(n), link)] if n and int(n) > here else []
    return list(out.values()), min(later, key=lambda x: x[0])[1] if later else ""


DETAILS = {"gs": gs_detail, "11880": b_detail}
INDEXES = {"gs": gs_index, "11880": b_index}


def details(pages: DataFrame, catalog: str) -> DataFrame:
    """pages (page_id, html): a card for each detail page of a catalog that names a company. Empty texts are null."""
    parse = DETAILS[catalog]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": i} | {c: card.get(c) or None for c in TEXTS} | {c: card.get(c) or [] for c in LISTS} for i, h in zip(b["page_id"], b["html"]) if (card := parse(h))]
            yield pd.DataFrame(rows, columns=["page_id", *TEXTS, *LISTS])

    return pages.select("page_id", "html").mapInPandas(work, DETAIL)


def index_cards(pages: DataFrame, catalog: str, plz: Column | None = None) -> DataFrame:
    """pages (page_id, url, html): the cards of index pages of a catalog, in order, each with the link to the next page. plz: the postal code
    that a page is expected to be about, from its columns; cards of others are left out."""
    parse = INDEXES[catalog]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, url, html, code in zip(b["page_id"], b["url"], b["html"], b["plz"]):
                cards, further = parse(html, url, code)
                rows += [{"page_id": i, "place": n, "next_page": further or None} | {c: card.get(c) or None for c in INDEX_TEXTS} for n, card in enumerate(cards, 1)]
            yield pd.DataFrame(rows, columns=["page_id", "place", *INDEX_TEXTS, "next_page"])

    code = (F.lit(None) if plz is None else plz).cast("string").alias("plz")
    return pages.select("page_id", "url", "html", code).mapInPandas(work, INDEX)
