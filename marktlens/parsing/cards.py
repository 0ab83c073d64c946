"""Company cards from pages, one row in, any number out: contact details, links and embedded data."""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from marktlens.functions.letters import plain

CARD = "page_id long, company_name string, emails array<string>, phones array<string>, websites array<string>, plz string, description string, data string"
# Keys of embedded data that are left out.
BANNED = {"review", "mediaGallery", "aggregateRating", "potentialAction", "openingHoursSpecification", "geo"}
_LD = re.compile(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>")


def embedded(html: str, banned: Collection[str] = BANNED) -> list:
    """All JSON-LD values of a page that parse, without the banned keys at any depth."""

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k not in banned}
        return [strip(v) for v in x] if isinstance(x, list) else x

    out = []
    for raw in _LD.findall(html or ""):
        try:
            out.append(strip(json.loads(raw)))
        except ValueError:
            continue
    return out


def hidden_email(code: str) -> str:
    """An address written as hex numbers, each crossed with the first."""
    raw = bytes.fromhex(code)
    return bytes(b ^ raw[0] for b in raw[1:]).decode("utf-8", "replace")


def _unique(found) -> list[str]:
    return list(dict.fromkeys(x.strip() for x in found if x and x.strip()))


def card(html: str) -> dict:
    """What a detail page says of its company."""
    html = html or ""
    heads = re.search(r"(?is)<h1[^>]*>(.*?)</h1>", html) or re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
    mails = [m.split("?")[0] for m in re.findall(r"(?i)href=[\"']mailto:([^\"']+)", html)] + [hidden_email(c) for c in re.findall(r"data-cfemail=[\"']([0-9a-fA-F]{4,})[\"']", html) if len(c) % 2 == 0]
    phones = [p.split("?")[0] for p in re.findall(r"(?i)href=[\"']tel:([^\"']+)", html) if len(re.sub(r"\D", "", p)) >= 6]
    body = plain(html)
    plz = re.search(r"\b(\d{5})\b", body)
    about = re.search(r"(?is)<article[^>]*>(.*?)</article>", html)
    data = embedded(html)
    return {
        "company_name": plain(heads[1]) or None if heads else None, "emails": _unique(m.lower() for m in mails), "phones": _unique(phones),
        "websites": _unique(re.findall(r"(?i)href=[\"'](https?://[^\"']+)", html)), "plz": plz[1] if plz else None, "description": plain(about[1]) or None if about else None, "data": json.dumps(data, sort_keys=True) if data else None,
    }


def cards(pages: DataFrame) -> DataFrame:
    """A card for each page."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"page_id": i} | card(h) for i, h in zip(b["page_id"], b["html"])], columns=["page_id", "company_name", "emails", "phones", "websites", "plz", "description", "data"])

    return pages.select("page_id", "html").mapInPandas(work, CARD)


def index_links(pages: DataFrame) -> DataFrame:
    """The links of an index page, each once, in order; and the next page's number: the least above its own."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, url, html in zip(b["page_id"], b["url"], b["html"]):
                own = re.search(r"[?&]page=(\d+)", url or "")
                own = int(own[1]) if own else 1
                links = _unique(re.findall(r"(?i)<a\s[^>]*href=[\"']([^\"'#]+)", html or ""))
                later = sorted(n for link in links for n in map(int, re.findall(r"[?&]page=(\d+)", link)) if n > own)
                rows += [(i, n, link, later[0] if later else None) for n, link in enumerate(links, 1)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "link", "next_page"]).astype({"next_page": "Int64"})

    return pages.select("page_id", "url", "html").mapInPandas(work, "page_id long, place int, link string, next_page long")
