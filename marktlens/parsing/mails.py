"""Raw mails as rows: headers, texts and report parts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from email.headerregistry import HeaderRegistry
from email.message import EmailMessage
from email.parser import BytesParser
from email.policy import default
from email.utils import parsedate_to_datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

# Headers that are kept of a reply, and parts that mark a delivery report.
HEADERS = ("From", "To", "Subject", "Date", "Message-Id", "In-Reply-To", "References")
REPORTS = ("message/delivery-status", "message/rfc822")

#: A header is parsed each time that it is asked for, several times by the parser itself, and many mails share theirs: values met before are kept.
POLICY = default.clone(header_factory=lru_cache(maxsize=2048)(HeaderRegistry()))

READ = ["mail", "has_report", "headers", "html", "plain", "sent_at"]
MAIL = "mailbox_id long, folder string, uid string, mail string, has_report boolean, headers map<string,string>, html string, plain string, sent_at timestamp"


def _text(part: EmailMessage) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:  # no such charset
        return raw.decode("utf-8", "replace")


def _header(message: EmailMessage, name: str) -> str:
    try:
        return str(message[name] or "").strip()
    except (ValueError, IndexError, TypeError, AttributeError):  # headers that break the grammar
        return ""


def _time(date: str) -> dt.datetime | None:
    try:
        at = parsedate_to_datetime(date)
    except (ValueError, IndexError, TypeError):
        return None
    return at.astimezone(dt.timezone.utc) if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)


def read(raw: bytes | None) -> tuple:
    """The mail's whole text, whether a part is a delivery report, its headers by lower-case names, the first HTML and the first
    plain text part, and its date (null if it has none or a broken one)."""
    raw = bytes(raw or b"")
    message = BytesParser(policy=POLICY).parsebytes(raw)
    parts: dict[str, EmailMessage] = {}
    for part in message.walk():
        parts.setdefault(part.get_content_type().lower(), part)
    headers = {h.lower().replace("-", "_"): v for h in HEADERS if (v := _header(message, h))}
    html, plain = (_text(parts[k]) if k in parts else None for k in ("text/html", "text/plain"))
    return raw.decode("utf-8", "replace"), any(k in parts for k in REPORTS), headers, html, plain, _time(headers.get("date", ""))


def read_mails(mails: DataFrame) -> DataFrame:
    """Mails (mailbox_id, folder, uid, raw) with what `read` finds in them."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([read(raw) for raw in b["raw"]], columns=READ, index=b.index)
            rows["sent_at"] = pd.to_datetime(rows["sent_at"], utc=True)
            yield pd.concat([b[["mailbox_id", "folder", "uid"]], rows], axis=1)

    return mails.select("mailbox_id", "folder", "uid", "raw").mapInPandas(work, MAIL)
