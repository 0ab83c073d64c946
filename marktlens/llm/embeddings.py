"""Embedding near-dedup within labels by int8 tile products.

Vectors of unit length are rounded to int8 with a scale each, and the norm of what rounding took away bounds, by the
Cauchy-Schwarz inequality, how far a product of rounded vectors is from the cosine. Equal vectors of a label are one class.
The classes of a label are dealt into blocks of bounded size; every pair of blocks is one tile, multiplied in int8 values
(exactly, as single-precision numbers hold such sums). Only pairs that the bound leaves open are computed in double
precision. A tile returns counts of links by class, and a spanning forest of its links for the components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.llm.common import checkpoint, components, per_key, salted

#: Classes in a block, about; a tile of two holds some megabytes.
BLOCK = 2048


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and error norms of unit vectors: v = scale * q + e, |e| at most the error norm."""
    scale = np.abs(v).max(1, initial=0) / 127
    q = np.rint(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    error = np.linalg.norm(v - scale[:, None] * q, axis=1)
    return q, scale, error * (1 + 1e-9) + 1e-12


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, step: int = 512):
    """Index pairs (i, j) of rows with cosine >= threshold in double precision; rows are finite and not zero."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    (qa, sa, ea), (qb, sb, eb) = quantise(a / na[:, None]), quantise(b / nb[:, None])
    # |u.v - u'.v'| <= |e_u| |v'| + |u'| |e_v| + |e_u| |e_v|, where |u'| <= 1 + |e_u|
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # which holds the sums exactly
    fb = qb.astype(kind).T
    for lo in range(0, len(a), step):
        hi = min(lo + step, len(a))
        product = (qa[lo:hi].astype(kind) @ fb).astype(np.float64) * sa[lo:hi, None] * sb[None, :]
        e, f = ea[lo:hi, None], eb[None, :]
        i, j = np.nonzero(product + (e * (1 + f) + (1 + e) * f + e * f + 1e-9) >= threshold)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)]
            sure = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            yield x[sure], y[sure]


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    root, out = list(range(n)), []
    for u, v in pairs:
        a, b = u, v
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            out.append((u, v))
    return out


def _tile(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the classes of two blocks, or within one: by class, the number of vectors linked, and forest edges."""
        one = rows["i"].iloc[0] == rows["j"].iloc[0]
        rows = rows.sort_values("id", ignore_index=True)
        v, ids, sizes = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["id"].to_numpy(), rows["size"].to_numpy()
        left, right = (np.arange(len(rows)),) * 2 if one else (np.flatnonzero(rows["own"] == rows["i"]), np.flatnonzero(rows["own"] == rows["j"]))
        linked, edges = np.zeros(len(rows), np.int64), []
        for x, y in close_pairs(v[left], v[right], threshold):
            x, y = left[x], right[y]
            if one:
                x, y = x[x < y], y[x < y]
            np.add.at(linked, x, sizes[y])
            np.add.at(linked, y, sizes[x])
            edges = _forest(len(rows), [*edges, *zip(x.tolist(), y.tolist())])
        at = np.flatnonzero(linked)
        a, b = (np.array([ids[e[k]] for e in edges], dtype=np.int64) for k in (0, 1))
        none = [None] * len(a)
        return pd.DataFrame({"id": [*ids[at], *none], "n": [*linked[at], *none], "a": [*([None] * len(at)), *a], "b": [*([None] * len(at)), *b]}).astype("Int64")

    return work


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors of its label with cosine >= threshold), component_id (the
    smallest vec_id reachable by links, itself included) and kept (vec_id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or id, link with
    nothing. Vectors of different lengths don't link. Rows with the same vec_id count as vectors of their own, of equal
    id. Other columns are not read; an empty table gives an empty result."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("_label"), F.col("embedding").alias("_v"))
    good = F.expr("_label is not null and vec_id is not null and size(_v) > 0 and forall(_v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(_v, x -> x <> 0)")
    # adding 0 makes a negative zero a zero; the dimension is part of what must be equal
    rows = rows.withColumn("_ok", F.coalesce(good, F.lit(False))).withColumn("_key", F.when(F.col("_ok"), F.sha2(F.transform("_v", lambda x: x + F.lit(0.0)).cast("array<double>").cast("string"), 256)))
    rows = salted(rows, "vec_id")
    usable = rows.filter("_ok")
    classes = usable.groupBy("_label", F.size("_v").alias("dim"), "_key").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("_v").alias("v"))
    # a class has a number of its own, as one id may stand in several
    classes = checkpoint(classes.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(60)).cast("int")).withColumn("c", F.monotonically_increasing_id()))
    # blocks: as many for a label as its classes fill
    counts = per_key(classes, ["_label", "dim"], F.count("*").alias("n"))
    dealt = classes.join(counts, ["_label", "dim", "_salt"]).withColumn("k", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("_key", F.lit(7)), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("_label", "dim", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", F.col("c").alias("id"), "size", "v")
    found = checkpoint(dealt.groupBy("_label", "dim", "i", "j").applyInPandas(_tile(threshold), "id long, n long, a long, b long"))
    linked = found.filter("id is not null").groupBy(F.col("id").alias("c")).agg(F.sum("n").alias("_n"))
    roots = components(found.filter("a is not null").select("a", "b")).distinct().withColumnRenamed("node", "c")
    known = classes.select("_label", "_key", "c", "id", "size", "_salt").join(linked, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    known = known.join(per_key(known, ["root"], F.min("id").alias("_root")), ["root", "_salt"])
    known = known.select("_label", "_key", "_root", (F.coalesce(F.col("_n"), F.lit(0)) + F.col("size") - 1).alias("_links"))
    spread = per_key(usable, ["_label", "_key"]).join(known, ["_label", "_key"])
    out = rows.join(spread, ["_label", "_key", "_salt"], "left")
    component = F.coalesce("_root", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
