"""Removal of byte strings that occur more than once in a corpus, over a family of suffix arrays.

Every string of `need` bytes holds an anchor: of its `gram`-byte substrings, the leftmost with the least hash. The starts of
a document's strings that share an anchor form a stretch; equal strings have equal anchors, so that stretches whose anchor
occurs once in the corpus hold no repeated string, and all others meet by their anchor's hash. Where all stretches of
an anchor are equal, all their strings repeat. The distinct stretches of other anchors go, batch by batch, into a
logarithmic family of suffix arrays: a batch's suffixes are sorted to depth `need`, merge-scanned against each level for
common prefixes of that length, and levels of equal size merge. Anchors with very many distinct stretches are dealt
out further, by digests of their single strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marktlens.llm.common import map_rows, per_key, salted, small_batches, texts, written
from marktlens.llm.substrings import merge

NEED, GRAM = 200, 64
SPANS = "_d long, _k long, start int, end int"
#: Stretches in a batch, and distinct stretches of an anchor above which its strings are dealt out by digest.
BATCH, HEAVY = 512, 4096
#: Starts looked at together in a long text, and anchors that a task reduces together.
CHUNK, TASK_ROWS = 1 << 18, 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _gram_hashes(data: np.ndarray, gram: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of each substring of `gram` bytes that depends on its bytes alone (arithmetic modulo 2^64)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def stretches(text: bytes, need: int = NEED, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and anchor hash of the stretches of a text: together they hold each start of a string
    of `need` bytes once."""
    width = need - gram + 1
    n = len(text) - need + 1
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    size = min(n, CHUNK) + need
    up, down = _powers(_BASE, size), _powers(_INVERSE, size)
    low = np.uint64((1 << 20) - 1)
    for first in range(0, n, CHUNK):
        starts = min(CHUNK, n - first)
        h = _gram_hashes(data[first : first + starts + need - 1], gram, up, down)
        ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # least hash, then leftmost
        padded = np.full(-(-len(h) // width) * width, ~np.uint64(0))
        padded[: len(h)] = ranked
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & low).astype(np.int64)
        at = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        parts.append((at + first, np.diff(np.append(at, starts)), h[anchor[at]]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _candidates(need: int, gram: int):
    """A task's stretches. Those that equal another one of the task are settled; one of them stays, marked twice."""

    def reduce(rows):
        anchor, seg, lo, n = (np.concatenate([r[i] for r in rows]) for i in range(4))
        size = [len(r[0]) for r in rows]
        doc, key, none = (np.repeat(np.array([r[i] for r in rows], dtype=t), size) for i, t in ((4, np.int64), (5, np.int64), (6, bool)))
        order = np.lexsort((lo, seg, anchor))
        a, s = anchor[order], seg[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(new) - 1
        twice = np.bincount(group)[group] > 1
        # settled spans, merged by document as far as they touch
        back = np.sort(order[twice])
        for p in (order[new], back):
            settled = p is back
            if settled and len(back):
                end = lo[p] + n[p] - 1 + need
                joined = np.zeros(len(p), bool)
                joined[1:] = (doc[p][1:] == doc[p][:-1]) & (key[p][1:] == key[p][:-1]) & (none[p][1:] == none[p][:-1]) & (lo[p][1:] == lo[p][:-1] + n[p][:-1])
                heads = np.flatnonzero(~joined)
                last = np.append(heads[1:], len(p)) - 1
                p, length = p[heads], end[last] - lo[p][heads] - need + 1
            else:
                length = n[p]
            flag = np.full(len(p), settled)
            double = np.zeros(len(p), bool) if settled else twice[new]
            q = np.arange(len(p)) if settled else np.argsort(p, kind="stable")  # in the order of documents, which compresses well
            for i in range(0, len(q), 100_000):
                x = p[q[i : i + 100_000]]
                y = q[i : i + 100_000]
                yield {"anchor": anchor[x].view(np.int64), "seg": seg[x].view(np.int64), "_d": pa.array(doc[x], mask=none[x]), "_k": key[x], "lo": lo[x], "n": length[y], "twice": double[y], "settled": flag[y]}

    def work(batches):
        rows, total = [], 0
        for b in batches:
            d, k = b.column("_d").to_pylist(), b.column("_k").to_pylist()
            for i, text in enumerate(b.column("_t").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                lo, n, anchor = stretches(raw, need, gram)
                if len(lo):
                    view = memoryview(raw)
                    seg = np.fromiter((xxhash.xxh3_64_intdigest(view[a:e]) for a, e in zip(lo.tolist(), (lo + n + need - 1).tolist())), np.uint64, len(lo))
                    rows.append((anchor, seg, lo, n, d[i] or 0, k[i], d[i] is None))
                    total += len(lo)
                if total >= TASK_ROWS:
                    yield from reduce(rows)
                    rows, total = [], 0
        if rows:
            yield from reduce(rows)

    return work


def sort_suffixes(data: np.ndarray, need: int) -> np.ndarray:
    """Rank of each position among all by its next `need` bytes, equal ones sharing a rank, by prefix doubling. The data
    ends in at least `need` bytes of padding; the positions in it have no rank."""
    n, depth = len(data) - need, 8
    eight = np.ascontiguousarray(sliding_window_view(data, 8)).view(">u8").ravel().astype(np.uint64)
    rank = np.unique(eight, return_inverse=True)[1].astype(np.uint64)
    while depth < need:
        step = min(depth, need - depth)
        size = len(rank) - step
        pair = rank[:size] * np.uint64(len(data) + 1) + rank[step : step + size]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        depth += step
    return rank[:n].astype(np.int64)


class Levels:
    """A logarithmic family of suffix arrays: each level holds its texts, and the sorted starts of one suffix for each
    distinct string of `need` bytes, marked if it was met more than once."""

    def __init__(self, need: int):
        self.need, self.levels = need, []

    def _keys(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(sliding_window_view(data, self.need)[starts])
        return rows.view(f"S{self.need}").ravel()

    def add(self, segments: list[bytes]) -> None:
        """Adds a batch of texts that are at least `need` bytes long."""
        need = self.need
        data = np.frombuffer(b"".join(segments) + bytes(need), np.uint8)
        ends = np.cumsum([len(s) for s in segments])
        starts = np.concatenate([np.arange(e - len(s), e - need + 1) for s, e in zip(segments, ends)])
        rank = sort_suffixes(data, need)[starts]
        order = np.argsort(rank, kind="stable")
        sorted_rank = rank[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        group = np.cumsum(new) - 1
        repeated = np.bincount(group) > 1
        level = {"data": data, "start": starts[order[new]], "repeated": repeated, "size": 1, "members": [(starts, order, group)], "slots": [np.arange(len(repeated))]}
        for other in self.levels:  # merge-scan: both sides are sorted
            mine, theirs = self._keys(data, level["start"]), self._keys(other["data"], other["start"])
            at = np.searchsorted(theirs, mine)
            at[at == len(theirs)] = 0
            same = theirs[at] == mine
            level["repeated"][same] = True
            other["repeated"][at[same]] = True
        self.levels.append(level)
        while len(self.levels) > 1 and self.levels[-1]["size"] == self.levels[-2]["size"]:
            self._merge()

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        shift = len(a["data"])
        data = np.concatenate((a["data"], b["data"]))
        start = np.concatenate((a["start"], b["start"] + shift))
        order = np.argsort(self._keys(data, start), kind="stable")
        keys = self._keys(data, start[order])
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        repeated = np.zeros(int(new.sum()), bool)
        np.logical_or.at(repeated, group, np.concatenate((a["repeated"], b["repeated"])))
        na = len(a["start"])
        self.levels.append({
            "data": data, "start": start[order[new]], "repeated": repeated, "size": a["size"] + b["size"],
            "members": a["members"] + b["members"], "slots": [group[:na][s] for s in a["slots"]] + [group[na:][s] for s in b["slots"]],
        })

    def repeated(self) -> list[np.ndarray]:
        """For each batch, in the order of adding, which of its starts begin a repeated string."""
        out = []
        for level in self.levels:
            for (starts, order, group), slot in zip(level["members"], level["slots"]):
                found = np.empty(len(starts), bool)
                found[order] = level["repeated"][slot[group]]
                out.append(found)
        return out


def _repeats(need: int, batch: int):
    """Rows come sorted by key; the spans of stretches (not marked twice, as those are settled) that repeat another's strings."""

    def settle(rows):
        """All rows of some whole groups; a group larger than a batch comes alone."""
        family = Levels(need)
        for i in range(0, len(rows), batch):
            family.add([r[5] for r in rows[i : i + batch]])
        at, marks = 0, np.concatenate(family.repeated())
        for r in rows:
            own = marks[at : at + r[4]]
            at += r[4]
            if r[6] or not own.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            yield from ((r[1], r[2], r[3] + int(a), r[3] + int(e) - 1 + need) for a, e in zip(edge[::2], edge[1::2]))

    def work(batches):
        def out(spans):
            return {"_d": [s[0] for s in spans], "_k": [s[1] for s in spans], "start": [s[2] for s in spans], "end": [s[3] for s in spans]}

        held, last = [], None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "_d", "_k", "lo", "n", "bytes", "twice")]
            spans = []
            for r in zip(*cols):
                if r[0] != last and len(held) >= batch:
                    spans += settle(held)
                    held = []
                last = r[0]
                held.append(r)
            if spans:
                yield out(spans)
        if held and (spans := list(settle(held))):
            yield out(spans)

    return work


def _asked(whole: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the rows' documents, with the rows of each."""
    asked = rows.groupBy("_d", "_k").agg(F.collect_list(F.struct("anchor", "lo", "n", "twice")).alias("asked"))
    return whole.join(asked.withColumnsRenamed({"_d": "_ad", "_k": "_ak"}), F.expr("_d <=> _ad and _k = _ak")).select("_d", "_k", "_t", "asked")


def _by_family(whole: DataFrame, rows: DataFrame, need: int, batch: int) -> DataFrame:
    """Spans of the rows' strings that repeat, each anchor's stretches in one family of suffix arrays."""

    def cut_out(batches):
        for b in batches:
            out = []
            for d, k, t, asked in zip(*(b.column(c).to_pylist() for c in ("_d", "_k", "_t", "asked"))):
                raw = t.encode("utf-8", "surrogatepass")
                out += [(x["anchor"], d, k, x["lo"], x["n"], raw[x["lo"] : x["lo"] + x["n"] - 1 + need], x["twice"]) for x in asked]
            for i in range(0, len(out), 20_000):
                yield dict(zip(("key", "_d", "_k", "lo", "n", "bytes", "twice"), zip(*out[i : i + 20_000])))

    pieces = map_rows(_asked(whole, rows), cut_out, "key long, _d long, _k long, lo int, n int, bytes binary, twice boolean")
    pieces = pieces.repartition("key").sortWithinPartitions("key")
    return map_rows(pieces, _repeats(need, batch), SPANS)


def _by_digest(whole: DataFrame, rows: DataFrame, need: int) -> DataFrame:
    """Spans of the rows' strings that repeat, by 128-bit digests of the single strings. A stretch marked twice counts as two, and
    its own strings are settled. Counts combine before they are shuffled, and a digest's rows are dealt out by salts."""

    def cut_out(batches):
        for b in batches:
            for d, k, t, asked in zip(*(b.column(c).to_pylist() for c in ("_d", "_k", "_t", "asked"))):
                raw = t.encode("utf-8", "surrogatepass")
                for x in asked:
                    at = np.arange(x["lo"], x["lo"] + x["n"])
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + need]) for i in at.tolist()), np.int64).reshape(-1, 2)
                    yield {"h": digests[:, 0], "l": digests[:, 1], "_d": pa.array([d] * len(at), pa.int64()), "_k": np.full(len(at), k), "start": at, "twice": np.full(len(at), x["twice"])}

    single = salted(map_rows(_asked(whole, rows), cut_out, "h long, l long, _d long, _k long, start int, twice boolean"), "_d", "_k", "start")
    single = written(single, "digests")
    often = per_key(single, ["h", "l"], F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("times"), having="times > 1")
    found = single.filter("not twice").join(often, ["h", "l", "_salt"])
    return found.select("_d", "_k", "start", F.expr(f"start + {int(need)}").alias("end"))


def repeated_spans(docs: DataFrame, need: int = NEED, gram: int = GRAM, batch: int = BATCH, heavy: int = HEAVY) -> DataFrame:
    """_d, _k, start, end: byte spans of each document that strings of `need` bytes which also start elsewhere cover; they
    may overlap. The stretches that matter are written once to the shared folder."""
    small_batches(docs.sparkSession)
    whole = texts(docs)
    rows = map_rows(whole, _candidates(need, gram), "anchor long, seg long, _d long, _k long, lo int, n int, twice boolean, settled boolean")
    rows = rows.withColumn("anchor", F.when(F.col("settled"), F.xxhash64("_d", "_k", "lo")).otherwise(F.col("anchor"))).repartition("anchor")
    same = Window.partitionBy("anchor", "settled", "seg").orderBy("_d", "_k", "lo")
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("same", F.count("*").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("kinds", F.sum((F.col("nth") == 1).cast("int")).over(Window.partitionBy("anchor", "settled")))
    rows = rows.withColumn("twice", F.col("twice") | (F.col("same") > 1)).filter("settled or twice or kinds > 1")
    rows = written(rows.select("_d", "_k", "anchor", "lo", "n", "twice", "settled", F.expr("not settled and nth = 1 and kinds > 1").alias("open"), (F.col("kinds") > heavy).alias("heavy")), "stretches")
    found = rows.filter("settled or twice").select("_d", "_k", F.col("lo").alias("start"), F.expr(f"lo + n - 1 + {int(need)}").alias("end"))
    found = found.unionByName(_by_family(whole, rows.filter("open and not heavy"), need, batch))
    dealt = rows.filter("open and heavy")
    return found if dealt.isEmpty() else found.unionByName(_by_digest(whole, dealt, need))


def remove_repeats(docs: DataFrame, need: int = NEED, gram: int = GRAM, batch: int = BATCH, heavy: int = HEAVY) -> DataFrame:
    """Per input row: doc_id, row_key, n_bytes, n_removed, n_spans (maximal removed runs), removed (their byte offsets), kept
    (the remaining bytes, which may begin or end within a character) and kept_sha256.

    A null text has no bytes. Rows equal in doc_id and text are documents of their own, whose strings repeat each other's;
    they come out alike. Null ids need no care; other columns are not read; an empty table gives an empty result."""
    spans = repeated_spans(docs, need, gram, batch, heavy)
    spans = spans.groupBy("_d", "_k").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"_d": "_sd", "_k": "_sk"})
    rows = texts(docs).join(spans, F.expr("_d <=> _sd and _k = _sk"), "left").select("_d", "_k", "_t", "spans")

    def work(batches):
        for b in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "removed", "kept", "kept_sha256")}
            for text, spans in zip(b.column("_t").to_pylist(), b.column("spans").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                gone = merge([(s["start"], s["end"]) for s in spans or ()])
                at, kept = 0, []
                for s, e in [*gone, (len(raw), len(raw))]:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join(kept)
                for c, v in zip(out, (len(raw), len(raw) - len(kept), len(gone), [{"start": s, "end": e} for s, e in gone], kept, hashlib.sha256(kept).hexdigest())):
                    out[c].append(v)
            yield {"doc_id": b.column("_d"), "row_key": b.column("_k")} | out

    return map_rows(rows, work, "doc_id long, row_key long, n_bytes long, n_removed long, n_spans long, removed array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
