"""Toxicity by maximum-scoring segments.

A token's score is how much likelier toxic documents hold it than clean ones: the log-odds of its features (the word, and
its character 4- and 5-grams, in a fixed number of hash buckets) under Dirichlet priors in proportion to the features'
counts over all documents, less a multiple of the standard error. Scores of ordinary tokens are slightly negative, so the
linear-time scan of all maximal scoring segments gives the passages where evidence gathers. Runs of more than 40 word characters (clauses of scripts without blanks, joined words)
count as overlapping tokens, which together hold each of their n-grams. How high segments rise in
clean documents by chance follows an exponential tail (Karlin-Altschul statistics): from it each document's best segment
gets a p-value for its length, and from that the document's score by a one-variable logistic fit.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktlens.llm.common import checkpoint, map_rows, small_batches, texts

BUCKETS = 1 << 20
#: Remembered words of a task; when full they are forgotten and counted anew.
MEMO = 200_000
#: Characters of texts whose words are looked up together.
TOGETHER = 1 << 16
_WORD = re.compile(r"\w+")


#: Longest token, and length and step of the tokens that longer runs are cut into; neighbours share the longest n-gram but one.
LONGEST, PIECE, STEP = 40, 24, 20
_POWERS = np.uint64(0x100000001B3) ** np.arange(LONGEST + 2, dtype=np.uint64)


def tokens(text: str) -> list[str]:
    return split_long(_WORD.findall(text.lower()))


def split_long(words: list[str]) -> list[str]:
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [x for w in words for x in ([w] if len(w) <= LONGEST else [w[i : i + PIECE] for i in range(0, len(w) - (PIECE - STEP), STEP)])]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


def split_texts(texts: list[str], memo: dict) -> Iterator[tuple[list[list[str]], list[str]]]:
    """The tokens of each of some texts that come one after the other, and the distinct ones that the memo lacks, which the caller
    puts there; a memo that gets full is emptied first."""
    at = 0
    while at < len(texts):
        lists, size = [], 0
        while at < len(texts) and (not lists or size + len(texts[at]) <= TOGETHER):
            lists.append(_WORD.findall(texts[at].lower()))
            size += len(texts[at])
            at += 1
        new = set().union(*lists).difference(memo)
        if max(map(len, new), default=0) > LONGEST:  # the memo holds no long ones
            lists = [split_long(words) for words in lists]
            new = set().union(*lists).difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set().union(*lists)
        yield lists, list(new)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words, one after the other, and where those of each word begin: the word itself and its 4- and
    5-grams with marks at both ends."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    fours, fives = np.maximum(sizes - 3, 0), np.maximum(sizes - 4, 0)
    each = 1 + fours + fives
    first = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.int32)
    out[first] = _mixed(np.add.reduceat(codes * _POWERS[place], starts) if len(words) else codes)
    for n, before in ((4, first + 1), (5, first + 1 + fours)):
        if len(codes) >= n:
            h = sum(codes[k : len(codes) - n + 1 + k] * _POWERS[n - k] for k in range(n)) + np.uint64(n)
            inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            out[before[owner[inside]] + place[inside]] = _mixed(h[inside])
    return out, first


def segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of tokens that score -drift but for those at the places `at`, whose
    scores are positive. Linear time: a stack of candidates with the running totals before and after them; a new one
    joins the nearest that began lower and ended no higher."""
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total before and after, nearest earlier one with less before
    total, last = 0.0, 0
    for p, s in zip(at, scores):
        start, before = p, total - drift * (p - last)
        total, last = before + s, p + 1
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            start, _, before, _, nearer = stack[j]
            del stack[j:]
            j = nearer
        stack.append((start, p + 1, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in stack]


@dataclass
class Model:
    """Token scores by feature bucket and the calibration; its size is fixed by BUCKETS."""

    lower: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    drift: float = 0.05
    rate: float = 1.0  # lambda: how fast chance segments get rarer with their score
    per_token: float = 1.0  # K: chance segments a token
    slope: float = 0.0
    offset: float = -100.0

    def learn(self, words: list[str], memo: dict[str, float]) -> None:
        """Puts the scores of tokens into the memo."""
        if words:
            found, starts = features(words)
            best = np.maximum.reduceat(self.lower[found], starts)
            memo.update(zip(words, np.where(best > 0, best - self.drift, -self.drift).tolist()))

    def scan_all(self, texts: list[str], memo: dict[str, float]) -> Iterator[tuple[int, list[tuple[int, int, float]], list[str]]]:
        """Of each text the number of tokens, segments over them, and the tokens."""
        for lists, new in split_texts(texts, memo):
            self.learn(new, memo)
            edges = np.cumsum([0, *map(len, lists)])
            scores = np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(lists)), np.float64, int(edges[-1]))
            at = np.flatnonzero(scores > 0)
            scores, cuts = scores[at], np.searchsorted(at, edges).tolist()
            for words, start, lo, hi in zip(lists, edges, cuts, cuts[1:]):
                yield len(words), segments((at[lo:hi] - start).tolist(), scores[lo:hi].tolist(), self.drift) if lo < hi else [], words

    def scan(self, text: str, memo: dict[str, float]) -> tuple[int, list[tuple[int, int, float]], list[str]]:
        """Number of tokens, segments over them, and the tokens."""
        return next(self.scan_all([text], memo))

    def surprise(self, n: int, best: float) -> float:
        """-ln of the chance that n clean tokens hold a segment as good as `best`, at most 50."""
        if best <= 0 or n == 0:
            return 0.0
        expected = self.per_token * n * math.exp(-min(700.0, self.rate * best))
        return min(50.0, -math.log(max(1e-300, -math.expm1(-expected))))

    def score(self, n: int, best: float) -> float:
        z = self.slope * self.surprise(n, best) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def _counts(batches_of_features, width: int):
    """Sums of bucket counts of a task as sparse rows."""
    total = np.zeros((width, BUCKETS), np.int64)
    for side, f in batches_of_features:
        total[side][f] += 1  # once, however often f holds a bucket
    at = np.flatnonzero(total.sum(0))
    for i in range(0, len(at), 100_000):
        p = at[i : i + 100_000]
        yield {"bucket": p, **{f"c{s}": total[s][p] for s in range(width)}}


def _room(held: np.ndarray, n: int) -> np.ndarray:
    return held if n <= len(held) else np.concatenate((held, np.empty(max(len(held), n - len(held)), held.dtype)))


def _bags(batches):
    """The features of each text, some of them more than once."""
    memo: dict[str, int] = {}  # numbers of words, whose features stand between two edges
    held, edges = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
    for b in batches:
        i = 0
        for lists, new in split_texts(b.column("_t").to_pylist(), memo):
            if new:
                found, starts = features(new)
                n, size = len(memo), int(edges[len(memo)])
                held, edges = _room(held, size + len(found)), _room(edges, n + len(new) + 1)
                held[size : size + len(found)] = found
                edges[n + 1 : n + len(new) + 1] = size + np.append(starts[1:], len(found))
                memo.update(zip(new, range(n, n + len(new))))
            bags = [set(words) for words in lists]
            sizes = np.cumsum([0, *map(len, bags)])
            words = np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(bags)), np.int64, int(sizes[-1]))
            first, each = edges[words], edges[words + 1] - edges[words]
            ends = np.concatenate(([0], np.cumsum(each)))
            found = held[np.arange(ends[-1]) + np.repeat(first - ends[:-1], each)]
            cuts = ends[sizes].tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                yield b, i, found[lo:hi]
                i += 1


def background(docs: DataFrame) -> DataFrame:
    """bucket and n: in how many of all documents each feature bucket occurs."""

    def work(batches):
        return _counts(((0, bag) for _, _, bag in _bags(batches)), 1)

    return map_rows(texts(docs), work, "bucket int, c0 long").groupBy("bucket").agg(F.sum("c0").alias("n"))


def labelled(labels: DataFrame, share: str, most: int) -> DataFrame:
    """Up to `most` rows of labels for training, drawn by a hash of the id: _l (doc_id) and toxic. An id labelled twice
    is toxic if it is so once; null ids and labels are left out."""
    rows = labels.filter("doc_id is not null and toxic is not null").filter(share)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("_l")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return rows.orderBy(F.xxhash64("_l"), "_l").limit(most)


def train(docs: DataFrame, labels: DataFrame, share: str = "crc32(cast(doc_id as string)) % 4 != 2", most: int = 20_000, prior: float = 1.0, errors: float = 1.75, drift: float = 0.05) -> Model:
    """Fits the model on the texts of at most `most` labelled rows (those of `share`): three quarters of them give the counts,
    the others the calibration. The prior weighs `prior` times the toxic texts' counts and covers all documents.

    Texts that are equal in their tokens train as one for each label. Null ids have no label; null and empty texts have no
    tokens, and count as one text; an id with several rows labels each of them. Without both labels, every score is 0."""
    small_batches(docs.sparkSession)
    model = Model(drift=drift)
    chosen = F.broadcast(labelled(labels, share, most))  # at most `most` rows of two numbers
    rows = texts(docs).filter("_d is not null").join(chosen, F.col("_d") == F.col("_l")).select("_d", "_t", "toxic")

    def digests(batches):
        for b in batches:
            keys = [xxhash.xxh3_128_hexdigest(" ".join(tokens(t)).encode("utf-8", "surrogatepass")) for t in b.column("_t").to_pylist()]
            yield {"_d": b.column("_d"), "toxic": b.column("toxic"), "key": keys, "_t": b.column("_t")}

    rows = map_rows(rows, digests, "_d long, toxic int, key string, _t string")
    rows = rows.groupBy("key", "toxic").agg(F.min(F.struct("_d", "_t")).alias("one"))
    aside = F.crc32(F.concat(F.lit("c"), F.col("one._d").cast("string"))) % 4 == 0
    rows = rows.select("toxic", F.col("one._t").alias("_t"), aside.alias("aside")).persist()

    def counted(batches):
        return _counts(((int(b.column("toxic")[i].as_py() > 0), bag) for b, i, bag in _bags(batches)), 2)

    seen = map_rows(rows.filter("not aside"), counted, "bucket int, c0 long, c1 long").groupBy("bucket").agg(F.sum("c0").alias("clean"), F.sum("c1").alias("toxic"))
    seen = checkpoint(seen)
    n = seen.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    if not n.clean or not n.toxic:
        rows.unpersist()
        return model
    base = checkpoint(background(docs))
    all_n = base.agg(F.sum("n")).first()[0]
    # only buckets with evidence for toxicity come to the driver
    prior = prior * n.toxic
    a = F.greatest(F.lit(prior / all_n) * F.greatest(F.col("n"), F.col("clean") + F.col("toxic")), F.lit(1e-9))
    counts = seen.filter("toxic > 0").join(base, "bucket").withColumn("a", a)
    t, c = F.col("toxic") + F.col("a"), F.col("clean") + F.col("a")
    odds = F.log(t / F.lit(n.toxic + prior)) - F.log(c / F.lit(n.clean + prior))
    found = counts.select("bucket", (odds - F.lit(errors) * F.sqrt(1 / t + 1 / c)).alias("lower")).filter("lower > 0").toArrow()  # BUCKETS rows at most
    model.lower[found["bucket"].to_numpy()] = found["lower"].to_numpy()
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def risen(batches):
        m, memo = shipped.value, {}
        for b in batches:
            n, segs = [], []
            for k, found, _ in m.scan_all(b.column("_t").to_pylist(), memo):
                n.append(k)
                segs.append(sorted((x[2] for x in found), reverse=True)[:1])
            yield {"toxic": b.column("toxic"), "aside": b.column("aside"), "n": n, "best": [x[0] if x else 0.0 for x in segs]}

    top = map_rows(rows, risen, "toxic int, aside boolean, n long, best double").toPandas()  # three numbers for each text, `most` at most
    rows.unpersist()
    if min(top["aside"][top["toxic"] == c].sum() for c in (0, 1)) >= 10:  # else too few: calibrated on all
        top = top[top["aside"]]
    _calibrate(model, top["toxic"].to_numpy() > 0, top["n"].to_numpy(), top["best"].to_numpy())
    return model


def _calibrate(model: Model, toxic: np.ndarray, n: np.ndarray, best: np.ndarray) -> None:
    """Tail of the best segments of clean texts, then the logistic fit over the surprise."""
    clean = np.sort(best[~toxic & (best > 0)])
    tokens = max(1, int(n[~toxic].sum()))
    model.per_token = max(1, len(clean)) / tokens  # too few to tell a tail: the rate that likelihood ratios have anyway
    if len(clean) >= 5:
        floor = clean[len(clean) // 2]
        over = clean[clean >= floor]
        model.rate = 1 / max(1e-3, float((over - floor).mean() + 1 / len(over)))
        model.per_token = len(over) / tokens * math.exp(min(500.0, model.rate * floor))
    x, y = np.array([model.surprise(int(k), float(b)) for k, b in zip(n, best)]), toxic.astype(float)
    w = np.array([math.log(y.mean() / (1 - y.mean())), 0.0]) if 0 < y.mean() < 1 else np.zeros(2)
    z = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-3 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    model.offset, model.slope = float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, significant: float = 0.05) -> DataFrame:
    """The rows of `docs` with score (double), predicted (int) and passages: token ranges, text and p-value of the
    segments that clean texts of that length hold with a chance below `significant`.

    Null and empty texts have no segment and get the lowest score; columns with the names of the new ones are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    new = ("score", "predicted", "passages")
    rest = [f for f in docs.schema if f.name not in new]

    def work(batches):
        m, memo = shipped.value, {}
        for b in batches:
            out = {f.name: b.column(f.name) for f in rest} | {c: [] for c in new}
            for n, found, words in m.scan_all([t or "" for t in b.column("text").to_pylist()], memo):
                best = max((x[2] for x in found), default=0.0)
                s = m.score(n, best)
                out["score"].append(s)
                out["predicted"].append(int(s >= threshold))
                passages = []
                for a, e, v in found:
                    p = math.exp(-m.surprise(n, v))
                    if p < significant:
                        passages.append({"start": a, "end": e, "p_value": p, "text": " ".join(words[a:e])})
                out["passages"].append(passages)
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return map_rows(docs.select(*[f.name for f in rest]), work, f"{fields}, score double, predicted int, passages array<struct<start:int,end:int,p_value:double,text:string>>")
