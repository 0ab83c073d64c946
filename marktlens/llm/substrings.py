"""Substring dedup by hashed text units.

Units are whole lines, and passages: from the start of each sentence on, the fewest whole sentences that together have
`min_words` words. Words are what blanks separate; where a script or a run of characters has none, two ideographs, kana or letters of
South-East Asian scripts, or twenty other characters, count as one. Sentences end at stops before a blank, closing quotes and brackets included, and at full-width
stops. A unit is compared in normal form (lower case, single blanks) by a 128-bit digest. Of equal units the
one that ranks first, by doc_id (nulls last), row key and offset, stays; the spans of all others are removed.

Each task first reduces its own rows: later occurrences of a unit within it go for certain, so that only its first one
meets those of other tasks. A unit that every document holds thus sends one row for each task, not for each document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marktlens.llm.common import map_rows, small_batches, texts

_END = re.compile("[.!?\u2026]+[\"'\u2019\u201d\u00bb)\\]]*(?=\\s|$)|[\u3002\uff01\uff1f\uff61]+[\u300d\u300f\u2019\u201d\uff09)]*")
#: Letters of scripts that are written without blanks.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Units of a task that are reduced together.
TASK_UNITS = 400_000
_SPANS = "array<struct<start:int,end:int>>"


def _words(pieces: list[str]) -> int:
    """How many words the blank-separated pieces of a text count as."""
    n = len(pieces)
    joined = "".join(pieces)
    if not joined.isascii() and (dense := len(_DENSE.findall(joined))):
        return sum(max(1, (k := len(_DENSE.findall(x))) // 2 + (len(x) - k) // 20) for x in pieces)
    return n if len(joined) <= 20 * n else sum(max(1, len(x) // 20) for x in pieces)


def units(text: str, min_words: int, line_words: int) -> list[tuple[int, int, str]]:
    """start, end (code points) and normal form of the units of a text, in order of their starts."""
    out = []
    marks: list[tuple[int, int, str, int]] = []  # sentences: start, end, normal form, words
    at = 0
    for line in text.split("\n"):
        if line and not line.isspace():
            words = s = 0
            for e in [*(m.end() for m in _END.finditer(line)), len(line)]:
                if w := line[s:e].split():
                    size = _words(w)
                    marks.append((at + s, at + e, " ".join(w).lower(), size))
                    words += size
                s = e
            if words >= line_words:
                out.append((at, at + len(line), "l " + " ".join(line.split()).lower()))
        at += len(line) + 1
    e = total = 0
    for s in range(len(marks)):
        while e < len(marks) and total < min_words:
            total += marks[e][3]
            e += 1
        if total < min_words:
            break
        out.append((marks[s][0], marks[e - 1][1], "p " + (marks[s][2] if e == s + 1 else " ".join(x[2] for x in marks[s:e]))))
        total -= marks[s][3]
    return out


def _first_in_task(min_words: int, line_words: int):
    """One row for each unit: `later` ones repeat an earlier unit of the same task; the others are to be compared."""

    def work(batches):
        digests, docs, keys, spans, where = [], [], [], [], []
        for b in batches:
            d, k = b.column("_d").to_pylist(), b.column("_k").to_pylist()
            for i, text in enumerate(b.column("_t").to_pylist()):
                found = units(text, min_words, line_words)
                if found:
                    where.append(len(found))
                    docs.append((d[i] is None, d[i] or 0))
                    keys.append(k[i])
                    spans.append(np.array([x[:2] for x in found], np.int64))
                    digests.append(np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[2].encode("utf-8", "surrogatepass")) for x in found), ">u8").reshape(-1, 2).astype(np.uint64))
            if sum(where) >= TASK_UNITS:  # bounds the memory; the rest of the task is reduced for itself
                yield from reduce(digests, docs, keys, spans, where)
                digests, docs, keys, spans, where = [], [], [], [], []
        if where:
            yield from reduce(digests, docs, keys, spans, where)

    def reduce(digests, docs, keys, spans, where):
        dig, span, of = np.concatenate(digests), np.concatenate(spans), np.repeat(np.arange(len(where)), where)
        none, doc, key = np.array([x[0] for x in docs])[of], np.array([x[1] for x in docs], np.int64)[of], np.array(keys, np.int64)[of]
        order = np.lexsort((span[:, 1], span[:, 0], key, doc, none, dig[:, 1], dig[:, 0]))
        dig, span, none, doc, key = dig[order], span[order], none[order], doc[order], key[order]
        later = np.zeros(len(dig), bool)
        later[1:] = (dig[1:] == dig[:-1]).all(1)
        # repeated rows are one document: a unit at the same place of it is the same unit
        same = np.zeros(len(dig), bool)
        same[1:] = later[1:] & (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (none[1:] == none[:-1]) & (span[1:] == span[:-1]).all(1)
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(dig))))
        later = later[lead]
        back = np.flatnonzero(~same)
        back = back[np.lexsort((span[back, 0], key[back], doc[back]))]  # rows of a document stay together, which compresses well
        for i in range(0, len(back), 100_000):
            p = back[i : i + 100_000]
            yield {"hi": dig[p, 0].view(np.int64), "lo": dig[p, 1].view(np.int64), "_d": pa.array(doc[p], mask=none[p]), "_k": key[p], "start": span[p, 0], "end": span[p, 1], "later": later[p]}

    return work


def repeated_spans(docs: DataFrame, min_words: int = 8, line_words: int = 5) -> DataFrame:
    """_d, _k, spans: for each document with units that repeat an earlier one, their spans (not merged, in no order)."""
    small_batches(docs.sparkSession)
    rows = map_rows(texts(docs), _first_in_task(min_words, line_words), "hi long, lo long, _d long, _k long, start int, end int, later boolean")
    # what is settled is spread by document, so that common units do not meet
    rows = rows.withColumn("hi", F.when(F.col("later"), F.xxhash64("_d", "_k")).otherwise(F.col("hi"))).withColumn("lo", F.when(F.col("later"), F.xxhash64("_k", "start")).otherwise(F.col("lo")))
    rank = Window.partitionBy("hi", "lo", "later").orderBy(F.col("_d").asc_nulls_last(), "_k", "start", "end")
    place = F.struct(F.col("_d"), F.col("_k"), F.col("start"), F.col("end"))
    rows = rows.withColumn("first", F.first(place).over(rank)).filter(F.col("later") | ~F.col("first").eqNullSafe(place))
    return rows.groupBy("_d", "_k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: str, gone: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """What is left of a text, and the offsets that it had and that the rest had. A line that a removal leaves blank goes
    with it."""
    kept, removed, at = [], [], 0
    for s, e in [*gone, (len(text), len(text))]:
        if s > at:
            if kept and text[at] == "\n" and text[kept[-1][1] - 1] == "\n":
                at += 1
            if removed or at:
                removed.append((kept[-1][1] if kept else 0, at))
            if s > at:
                kept.append((at, s))
        at = max(at, e)
    end = kept[-1][1] if kept else 0
    return "".join(text[s:e] for s, e in kept), kept, merge([x for x in [*removed, (end, len(text))] if x[1] > x[0]])


def dedup_substrings(docs: DataFrame, min_words: int = 8, line_words: int = 5) -> DataFrame:
    """The rows of `docs` with repeated units cut out of `text`, and: n_removed_units, n_removed_chars (long), removed and kept
    (arrays of start and end, in code points of the text as it came).

    `text` is what `kept` says, and `removed` is all else. Null texts stay null, with no unit, as empty and blank ones do. Lines of
    fewer than `line_words` words are units only as parts of passages. Rows equal in doc_id and text count as one document and come out alike; rows with a null
    doc_id rank last. Columns of the input with the names of the new ones are replaced; an empty table stays empty."""
    spans = repeated_spans(docs, min_words, line_words).withColumnsRenamed({"_d": "_rd", "_k": "_rk"})
    new = ["removed", "kept", "n_removed_units", "n_removed_chars"]
    rest = [c for c in docs.columns if c not in (*new, "text")]
    rows = docs.select(*rest, F.col("text").alias("_t")).withColumn("_k", F.xxhash64("_t"))
    rows = rows.join(spans, F.expr("doc_id <=> _rd and _k = _rk"), "left").select(*rest, "_t", "spans")

    def work(batches):
        for b in batches:
            out = {c: b.column(c) for c in rest} | {"text": [], **{c: [] for c in new}}
            for text, found in zip(b.column("_t").to_pylist(), b.column("spans").to_pylist()):
                gone = merge([(x["start"], x["end"]) for x in found or ()])
                left, kept, gone = cut(text or "", gone)
                out["text"].append(None if text is None else left)
                out["removed"].append([{"start": s, "end": e} for s, e in gone])
                out["kept"].append([{"start": s, "end": e} for s, e in kept])
                out["n_removed_units"].append(len(found or ()))
                out["n_removed_chars"].append(sum(e - s for s, e in gone))
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest]
    schema = ", ".join([*fields, "text string", f"removed {_SPANS}", f"kept {_SPANS}", "n_removed_units long", "n_removed_chars long"])
    return map_rows(rows, work, schema)
