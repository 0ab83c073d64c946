"""Hard negatives of anchor vectors by a vector-approximation file.

Rows are packed into blocks. A block quantises each dimension into cells of about equally many of its rows, keeps a cell number of one
byte for each component, and the least and greatest value in each cell. For an anchor, a table has the least and greatest product of
its component with any value of a cell; summing what the table says of a row's cells bounds the row's score from both sides. A block
scores exactly only the rows whose upper bound reaches the k-th best lower bound, or that may lie in a window of scores and reach the
k-th best of those surely in it. Anchors are packed too, and each block of them meets each block of rows: once within classes
of labels for their positives, once everywhere for the negatives. Blocks pass on their k best, and the best of those stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktlens.llm.common import dealt, map_rows, small_batches, written

#: Rows of a block, anchors of a block, anchors worked on at once, cells of a dimension, classes of labels that blocks are dealt by.
ROWS, ANCHORS, STRIP, CELLS, CLASSES = 8_192, 1_024, 64, 64, 64
LEAST, GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integer rows [n, d]: cell numbers [d, n], least and greatest values of the cells [d, cells]."""
    n, d = v.shape
    c = min(CELLS, n)
    at = np.arange(n) * c // n
    first = np.searchsorted(at, np.arange(c))
    last = np.append(first[1:], n) - 1
    codes, low, high = np.empty((d, n), np.uint8), np.empty((d, c), np.int64), np.empty((d, c), np.int64)
    for k in range(d):
        order = np.argsort(v[:, k], kind="stable")
        codes[k, order] = at
        low[k], high[k] = v[order[first], k], v[order[last], k]
    return codes, low, high


def most(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """What no score of these anchors and cells exceeds."""
    return float((np.abs(a.astype(float)).max(0, initial=0) * np.maximum(np.abs(low.astype(float)), np.abs(high.astype(float))).max(1, initial=0)).sum())


def bounds(a: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [anchors, rows] of the scores of anchors [s, d] with the rows of a block, by table lookup."""
    top, s = most(a, low, high), len(a)
    kind = np.float32 if top < 1 << 24 else np.float64  # sums of integers that it holds exactly
    slack = 0.0 if top < 1 << 52 else top * 2.0**-40
    total = np.zeros((codes.shape[1], 2 * s), kind)
    for k in range(len(codes)):
        x, y = np.multiply.outer(low[k].astype(float), a[:, k].astype(float)), np.multiply.outer(high[k].astype(float), a[:, k].astype(float))
        total += np.concatenate([np.minimum(x, y), np.maximum(x, y)], 1).astype(kind)[codes[k]]
    low, high = np.ascontiguousarray(total[:, :s].T) - kind(slack), np.ascontiguousarray(total[:, s:].T) + kind(slack)
    return (low, high) if top < 1 << 62 else (np.clip(low, -(2.0**63), 2.0**63), np.clip(high, -(2.0**63), 2.0**63))


def scores(a: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of the pairs, by Python's integers where 64 bits might not hold them; the nearest long beyond 64 bits."""
    out = []
    for at in range(0, len(i), 1 << 15):
        x, y = a[i[at : at + (1 << 15)]].astype(np.int64), v[j[at : at + (1 << 15)]].astype(np.int64)
        out.append(np.einsum("nd,nd->n", x, y) if top < 1 << 62 else np.array([max(LEAST, min(GREATEST, n)) for n in (x.astype(object) * y.astype(object)).sum(1)], np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _kth(low: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest lower bound of each anchor's rows that are ok; least of all if there are fewer."""
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return np.partition(np.where(ok, low, -np.inf), low.shape[1] - k, axis=1)[:, low.shape[1] - k]


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~score, group))
    g = group[order]
    new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(new, np.diff(np.r_[new, len(g)])) < k]


class _Block:
    def __init__(self, r: dict, of: str):
        self.ids, self.labels = np.frombuffer(r[f"{of}ids"], "<i8"), np.frombuffer(r[f"{of}labels"], "<i8")
        self.v = np.frombuffer(r[f"{of}v"], r[f"{of}kind"]).reshape(len(self.ids), r["dim"])
        if of == "r_":
            self.codes = np.frombuffer(r["r_codes"], np.uint8).reshape(r["dim"], len(self.ids))
            self.low, self.high = (np.frombuffer(r[c], "<i8").reshape(r["dim"], min(CELLS, len(self.ids))) for c in ("r_low", "r_high"))


def _pack(names: list[str], with_cells: bool):
    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "label"], ignore_index=True)
        v = np.stack(rows["q"].to_numpy()).astype(np.int64)
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= v.min(initial=0) and v.max(initial=0) <= np.iinfo(k).max)
        out = {n: [k] for n, k in zip(names, key)}
        out |= {"ids": [rows["vec_id"].to_numpy("<i8").tobytes()], "labels": [rows["label"].to_numpy("<i8").tobytes()], "kind": [kind], "v": [v.astype(kind).tobytes()]}
        if with_cells:
            codes, low, high = cells(v)
            out |= {"codes": [codes.tobytes()], "low": [low.astype("<i8").tobytes()], "high": [high.astype("<i8").tobytes()]}
        return pd.DataFrame(out)

    return work


def _classes(rows: DataFrame, size: int) -> DataFrame:
    """For each dimension and class of labels: k, the blocks of about `size` rows that it fills, first, the number of its first one, and total,
    the blocks of the dimension. A row for each class, so CLASSES at most for one dimension."""
    own = rows.groupBy("dim", "g").agg(F.ceil(F.count("*") / size).alias("k"))
    upto = F.sum("k").over(Window.partitionBy("dim").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    return own.select("dim", "g", "k", (upto - F.col("k")).alias("first"), F.sum("k").over(Window.partitionBy("dim")).alias("total"))


def _packed(rows: DataFrame, classes: DataFrame, names: list[str], with_cells: bool) -> DataFrame:
    """The rows in blocks, a row with binary columns for each."""
    made = rows.join(classes, ["dim", "g"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id", "label", "q"), F.col("k")))
    schema = ", ".join(f"{n} {'int' if n == 'dim' else 'long'}" for n in names) + ", ids binary, labels binary, kind string, v binary" + ", codes binary, low binary, high binary" * with_cells
    return written(made.select(*names, "vec_id", "label", "q").groupBy(*names).applyInPandas(_pack(names, with_cells), schema), "vectors")


def _positives(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                a, v = _Block(r, "a_"), _Block(r, "r_")
                top = most(a.v, v.low, v.high)
                for at in range(0, len(a.ids), STRIP):
                    s = slice(at, at + STRIP)
                    ok = a.labels[s, None] == v.labels[None, :]
                    for i, j in zip(*np.nonzero(ok & (a.ids[s, None] == v.ids[None, :]))):  # rows are distinct: equal ones are the anchor
                        ok[i, j] = not np.array_equal(a.v[at + i], v.v[j])
                    if not ok.any():
                        continue
                    low, high = bounds(a.v[s], v.codes, v.low, v.high)
                    i, j = np.nonzero(ok & (high >= _kth(low, ok, k)[:, None]))
                    score = scores(a.v[s], v.v, i, j, top)
                    best = _best(i, score, v.ids[j], k)
                    n = len(best)
                    yield {"dim": [r["dim"]] * n, "a": [r["a_block"]] * n, "pos": i[best] + at, "anchor_id": a.ids[i[best] + at], "id": v.ids[j[best]], "score": score[best]}

    return work


def _negatives(k: int, share: tuple[int, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                a, v = _Block(r, "a_"), _Block(r, "r_")
                top = most(a.v, v.low, v.high)
                wanted = sorted(r["wanted"], key=lambda w: (w["pos"], w["place"]))
                by = {}
                for w in wanted:  # windows of whole scores
                    by.setdefault(w["place"], {})[w["pos"]] = (-(-share[0] * w["score"] // 100), share[1] * w["score"] // 100, w)
                for at in range(0, len(a.ids), STRIP):
                    s = range(at, min(at + STRIP, len(a.ids)))
                    other = a.labels[s, None] != v.labels[None, :]
                    if not other.any():
                        continue
                    low, high = bounds(a.v[s], v.codes, v.low, v.high)
                    maybe = {}
                    for place, own in by.items():
                        least, greatest = (np.array([float(own[p][x]) if p in own else (np.inf, -np.inf)[x] for p in s])[:, None] for x in (0, 1))
                        open_ = other & (high >= least) & (low <= greatest)
                        if open_.any():
                            maybe[place] = open_ & (high >= _kth(low, other & (low >= least) & (high <= greatest), k)[:, None])
                    if not maybe:
                        continue
                    i, j = np.nonzero(np.logical_or.reduce(list(maybe.values())))
                    score = scores(a.v[s], v.v, i, j, top)
                    for place, open_ in maybe.items():
                        at_i = np.array([p in by[place] for p in s])[i]
                        ask = np.flatnonzero(open_[i, j] & at_i)
                        edges = [by[place][at + x][:2] for x in i[ask]]
                        ask = ask[[e[0] <= x <= e[1] for e, x in zip(edges, score[ask].tolist())]] if len(ask) else ask
                        best = ask[_best(i[ask], score[ask], v.ids[j[ask]], k)]
                        n, own = len(best), [by[place][at + x][2] for x in i[best]]
                        yield {"dim": [r["dim"]] * n, "a": [r["a_block"]] * n, "pos": i[best] + at, "place": [place] * n, "anchor_id": a.ids[i[best] + at], "positive_id": [w["id"] for w in own], "positive_score": [w["score"] for w in own], "negative_id": v.ids[j[best]], "negative_score": score[best]}

    return work


def _as(df: DataFrame, mark: str) -> DataFrame:
    return df.select("dim", *[F.col(c).alias(mark + c) for c in df.columns if c != "dim"])


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each anchor and each of its positives (its best rows of the same label), the best rows of other labels whose score is
    from share[0] to share[1] per cent of the positive's: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. vectors: vec_id, label, q (an array of integers); anchor: a condition on these.

    Scores are inner products; higher ones come first, ties by smaller vec_id. Rows with a null id, label or vector, or with a null
    component, take no part, and vectors meet only those of their length (empty ones score 0). A row that comes several times counts once;
    rows that share only a vec_id are rows of their own, and anchors each. A positive below zero has no window, so no negatives. Scores beyond
    64 bits count as the nearest long. Other columns are not read; an empty table gives an empty result."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("q").cast("array<long>").alias("q"), anchor.alias("_anchor"))
    rows = rows.filter("vec_id is not null and label is not null and q is not null and forall(q, x -> x is not null)").distinct()
    rows = written(rows.withColumn("dim", F.size("q")).withColumn("g", F.pmod(F.xxhash64("label"), F.lit(CLASSES)).cast("int")), "rows")
    classes, anchors = _classes(rows, ROWS), rows.filter("_anchor")
    v = _as(_packed(rows, classes, ["dim", "block"], True), "r_")
    # anchors have blocks of their own, which know where the rows of their class are
    anchors = anchors.join(classes.select("dim", "g", F.col("first").alias("rows_first"), F.col("k").alias("rows_k"), F.col("total").alias("rows_total")), ["dim", "g"])
    a = _as(_packed(anchors, _classes(anchors, ANCHORS), ["dim", "block", "rows_first", "rows_k", "rows_total"], False), "a_")
    steps = lambda lo, n: F.explode(F.sequence(lo, lo + n - 1)).alias("r_block")
    v = dealt(v, "dim", "r_block")  # few rows that stand for much work
    tiles = dealt(a.select("*", steps(F.col("a_rows_first"), F.col("a_rows_k"))), "dim", "r_block").join(v, ["dim", "r_block"])
    found = map_rows(tiles, _positives(positives), "dim int, a long, pos int, anchor_id long, id long, score long")
    near = Window.partitionBy("dim", "a", "pos").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= positives)
    wanted = best.groupBy("dim", F.col("a").alias("a_block")).agg(F.collect_list(F.struct("pos", "place", "id", "score")).alias("wanted"))
    asked = written(a.join(wanted, ["dim", "a_block"]), "anchors")
    tiles = dealt(asked.select("*", steps(F.lit(0).cast("long"), F.col("a_rows_total"))), "dim", "r_block").join(v, ["dim", "r_block"])
    schema = "dim int, a long, pos int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = Window.partitionBy("dim", "a", "pos", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = map_rows(tiles, _negatives(negatives, share), schema).withColumn("rank", F.row_number().over(far)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
