"""Masked pseudo-likelihood of documents under a bidirectional window network.

A network with one hidden layer predicts every token from the tokens on both sides of it, itself masked. What it predicts is the
token's class: the corpus's most frequent words are classes of their own, all other words share those of hashed groups.
The output is a two-level softmax (groups of classes, classes within their group), which gives exact probabilities at the
cost of the square root of the number of classes. Within its class a word has its share of the class's count, as counted
over all documents in a table that grows with their distinct words; words that were never counted share what half a count
for each word and one more leaves them. So every word has a probability, and those of all counted words and one that is new
sum to one.

Training is data-parallel in numpy: in each round every task takes gradient steps on its own documents from the same start,
and the parameters are averaged by tokens, chunk by chunk, in a shuffle. A document's score is the sum of its tokens'
conditional log-probabilities. The words' shares come by a join of the distinct shared-class words of each batch of
documents with the word table; no word outside the classes of their own can be frequent, so that no key is hot.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktlens.llm.common import checkpoint, folder, map_rows, small_batches, texts

_WORD = re.compile(r"\w+|[^\w\s]")
#: Remembered words of a task; when full they are forgotten and looked up anew.
MEMO = 500_000
#: Characters that a text's pieces have on average at most; longer ones would hardly occur twice.
LONG = 32
#: Tokens scored or learned together, and numbers of a parameter vector that are averaged together.
STEP, CHUNK = 4096, 8192
#: What a word's count is raised by, and the count of words never seen.
RAISE = 0.5


@dataclass(frozen=True)
class Shape:
    """Sizes of the network; the number of parameters follows from them alone."""

    groups: int = 32
    within: int = 32  # groups * within classes
    others: int = 64  # of these, hashed groups of all but the most frequent words
    width: int = 2  # tokens on either side
    hidden: int = 16
    rate: float = 0.04
    share: int = 2  # each round trains on every share-th token; as many rounds take every token once
    rounds: int = 2
    seed: int = 1

    def __post_init__(self):
        if self.rounds < self.share:
            raise ValueError("fewer rounds than shares leave tokens out")
        if self.size >= 1 << 15:
            raise ValueError("classes are numbers of 16 bits")

    @property
    def size(self) -> int:
        return self.groups * self.within

    @property
    def own(self) -> int:
        return self.size - self.others

    def parts(self) -> dict[str, tuple[int, ...]]:
        return {"e": (2 * self.width, self.size + 1, self.hidden), "c": (self.hidden,), "g": (self.hidden, self.groups), "d": (self.groups,), "w": (self.groups, self.hidden, self.within), "b": (self.groups, self.within)}


class Network:
    """The network's parameters as views into one vector, its probabilities and gradient steps."""

    def __init__(self, shape: Shape, vector: np.ndarray | None = None):
        self.shape = shape
        sizes = {k: int(np.prod(s)) for k, s in shape.parts().items()}
        if vector is None:
            vector = np.random.default_rng(shape.seed).normal(0, 0.1, sum(sizes.values())).astype(np.float32)
        self.vector, at = np.array(vector, np.float32), 0
        for k, s in shape.parts().items():
            setattr(self, k, self.vector[at : at + sizes[k]].reshape(s))
            at += sizes[k]

    @classmethod
    def of_counts(cls, shape: Shape, counts: np.ndarray) -> Network:
        """A network that begins near the classes' frequencies, whatever is around."""
        net = cls(shape)
        n = (counts + 1.0).reshape(shape.groups, shape.within)
        net.d[:] = np.log(n.sum(1) / n.sum())
        net.b[:] = np.log(n / n.sum(1, keepdims=True))
        return net

    def padded(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes of texts of these sizes with end marks between them, and where their tokens are."""
        w = self.shape.width
        padded = np.full(len(ids) + w * (len(sizes) + 1), self.shape.size, np.int16)
        place = np.arange(len(ids)) + np.repeat(np.arange(1, len(sizes) + 1) * w, sizes)
        padded[place] = ids
        return padded, place

    def around(self, padded: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Classes around the tokens at some places, one row for each side and distance; the end mark beyond a text."""
        w = self.shape.width
        return np.stack([padded.take(place + o) for o in range(-w, w + 1) if o])

    def contexts(self, ids: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Classes around each token of one text, or of texts of these sizes one after the other."""
        return self.around(*self.padded(ids, np.array([len(ids)]) if sizes is None else sizes))

    def _forward(self, around: np.ndarray, target: np.ndarray):
        """Rows are in the order of their targets' groups: hidden values, exponentials and sums of both levels, places, edges."""
        h = self.e[0].take(around[0], axis=0)
        for i in range(1, len(around)):
            h += self.e[i].take(around[i], axis=0)
        h += self.c
        np.tanh(h, out=h)
        p = h @ self.g
        p += self.d
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        group = target // self.shape.within
        edges = np.searchsorted(group, np.arange(self.shape.groups + 1))
        q = np.empty((len(target), self.shape.within), np.float32)
        for k in np.flatnonzero(np.diff(edges)):
            s = slice(edges[k], edges[k + 1])
            np.matmul(h[s], self.w[k], out=q[s])
            q[s] += self.b[k]
        q -= q.max(1, keepdims=True)
        np.exp(q, out=q)
        ones = np.ones(self.shape.groups, np.float32), np.ones(self.shape.within, np.float32)
        return h, p, p @ ones[0], q, q @ ones[1], group, target % self.shape.within, edges

    def log_probabilities(self, ids: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Of the class of every token given those around it."""
        around, out = self.contexts(ids, sizes), np.empty(len(ids), np.float64)
        for i in range(0, len(ids), STEP):
            target = ids[i : i + STEP]
            order = np.argsort(target, kind="stable")
            _, p, ps, q, qs, group, place, _ = self._forward(around[:, i : i + STEP].take(order, axis=1), target[order])
            rows = np.arange(len(target))
            out[i + order] = np.log(np.maximum(p[rows, group] / ps, 1e-30)) + np.log(np.maximum(q[rows, place] / qs, 1e-30))
        return out

    def learn(self, around: np.ndarray, target: np.ndarray) -> None:
        """One step down the gradient of the sum of negative log-probabilities by the root of their number."""
        order = np.argsort(target, kind="stable")
        around, target = around.take(order, axis=1), target[order]
        h, p, ps, q, qs, group, place, edges = self._forward(around, target)
        rows, step = np.arange(len(target)), np.float32(self.shape.rate / np.sqrt(len(target)))
        p *= (1 / ps)[:, None]
        q *= (1 / qs)[:, None]
        p[rows, group] -= 1
        q[rows, place] -= 1
        one = np.ones(len(target), np.float32)
        dh = p @ self.g.T
        for k in np.flatnonzero(np.diff(edges)):
            s = slice(edges[k], edges[k + 1])
            dh[s] += q[s] @ self.w[k].T
            self.w[k] -= step * (h[s].T @ q[s])
            self.b[k] -= step * (one[s] @ q[s])
        self.g -= step * (h.T @ p)
        self.d -= step * (one @ p)
        h *= h
        np.subtract(1, h, out=h)
        h *= dh
        h *= step
        self.c -= one @ h
        for i, ids in enumerate(around):
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            self.e[i][ids[first]] -= np.add.reduceat(h.take(order, axis=0), first, axis=0)


class Vocabulary(dict):
    """Numbers of the words that a task has met, and by number their classes and hashes (XXH64 of UTF-8, seed 42)."""

    def __init__(self, frequent: list[str], shape: Shape):
        super().__init__()
        self.own, self.shape = {w: i for i, w in enumerate(frequent)}, shape
        self.classes, self.hashes = [], []

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        h -= h >> 63 << 64
        self.classes.append(self.own.get(word, self.shape.own + h % self.shape.others))
        self.hashes.append(h)
        found = self[word] = len(self.classes) - 1
        return found

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of some texts, one after the other, and how many each text has."""
        if len(self) >= MEMO:
            self.clear()
            self.classes, self.hashes = [], []
        words = [_WORD.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum())), sizes

    def ids(self, text: str) -> np.ndarray:
        found, _ = self.numbers([text])
        return np.array(self.classes, np.int16)[found]


@dataclass
class Model:
    """The frequent words, the shares of all others within their classes (_w, the word's hash, and log_share), the log-shares of
    words never counted by class, and the network."""

    vocabulary: Vocabulary
    shares: DataFrame
    unseen: np.ndarray
    network: Network


def targets(ids: bytes, n: int, turn: int, share: int) -> np.ndarray:
    """Places of the tokens of a document that a round trains on: `share` rounds in a row take each of its n tokens once."""
    return np.arange((zlib.crc32(ids) + turn) % share, n, share)


def pieces(text: str) -> list[str]:
    """What stands between white space in the lower-cased text: no word reaches across, so that the words of the pieces are those of
    the text, and a piece that occurs again needs no other look. Where pieces are long, the words (each a piece with itself as its
    only word)."""
    text = text.lower()
    found = text.split()
    return found if len(text) <= LONG * len(found) else _WORD.findall(text)


def words_of(piece: str) -> list[str]:
    """The words of a piece that isn't empty: mostly it is one, or one with a mark behind it."""
    if piece.isalnum():
        return [piece]
    word, last = piece[:-1], piece[-1]
    return [word, last] if word.isalnum() and last != "_" else _WORD.findall(piece)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: how often each word occurs in all documents."""
    small_batches(docs.sparkSession)

    def work(batches):
        counts: Counter[str] = Counter()

        def flush():
            words: dict[str, int] = {}
            for piece, n in counts.items():
                for w in words_of(piece):
                    words[w] = words.get(w, 0) + n
            yield {"word": list(words), "n": list(words.values())}
            counts.clear()

        for b in batches:
            for text in b.column("_t").to_pylist():
                counts.update(pieces(text))
                if len(counts) > MEMO:
                    yield from flush()
        yield from flush()

    return map_rows(texts(docs), work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def start(docs: DataFrame, shape: Shape) -> Model:
    """Counts the words of all documents: the most frequent get classes of their own (ties go by the word), and the others a
    table of their shares. The network isn't trained yet."""
    words = checkpoint(word_counts(docs).select("word", "n", F.xxhash64("word").alias("_w")))
    own = words.orderBy(F.desc("n"), "word").limit(shape.own).collect()  # bounded by the shape
    rest = words.filter("false") if len(own) < shape.own else words.filter((F.col("n") < own[-1].n) | (F.col("n") == own[-1].n) & (F.col("word") > own[-1].word))
    place = F.pmod("_w", F.lit(shape.others)).cast("int")
    n, kinds = np.zeros(shape.others), np.zeros(shape.others)
    for r in rest.groupBy(place.alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        n[r["at"]], kinds[r["at"]] = r.n, r.kinds
    total = n + RAISE * (kinds + 1)
    shares = rest.select("_w", (F.log(F.col("n") + F.lit(RAISE)) - F.log(_of_class(total, place))).alias("log_share"))
    counts = np.zeros(shape.size)
    counts[: len(own)] = [r.n for r in own]
    counts[shape.own :] = n
    return Model(Vocabulary([r.word for r in own], shape), shares, np.log(RAISE / total), Network.of_counts(shape, counts))


def _of_class(values: np.ndarray, place: Column) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])[place]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Two kinds of rows for each batch of documents, a `chunk`. Of each document: doc (its place in the chunk), _d (doc_id) and ids
    (classes of its tokens as little-endian integers of 16 bits). Of each distinct word that has no class of its own: word (its
    hash) and docs (the places of the documents that hold it, as often as they do)."""
    small_batches(docs.sparkSession, 8)
    shipped = docs.sparkSession.sparkContext.broadcast((list(vocabulary.own), vocabulary.shape))

    def work(batches):
        known = Vocabulary(*shipped.value)
        for i, b in enumerate(batches):
            chunk = (TaskContext.get().partitionId() << 24) + i
            words, sizes = known.numbers(b.column("_t").to_pylist())
            ids, edges = np.array(known.classes, "<i2")[words], np.cumsum([0, *sizes])
            raw, n = memoryview(ids.tobytes()), len(sizes)
            yield {"chunk": np.full(n, chunk), "doc": np.arange(n), "_d": b.column("_d"), "ids": [bytes(raw[2 * s : 2 * e]) for s, e in zip(edges, edges[1:])], "word": [None] * n, "docs": [None] * n}
            shared = np.flatnonzero(ids >= known.shape.own)
            if len(shared):
                shared = shared[np.argsort(words[shared], kind="stable")]
                word = words[shared]
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                holders = pa.ListArray.from_arrays(pa.array(np.append(first, len(word)), pa.int32()), pa.array(np.repeat(np.arange(n), sizes)[shared], pa.int32()))
                n = len(first)
                yield {"chunk": np.full(n, chunk), "doc": [None] * n, "_d": [None] * n, "ids": [None] * n, "word": np.array(known.hashes, np.int64)[word[first]], "docs": holders}

    return map_rows(texts(docs), work, "chunk long, doc int, _d long, ids binary, word long, docs array<int>")


def _kept(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded() as a table in the shared folder: the numbers of chunks depend on how rows are dealt to tasks."""
    path = folder(docs.sparkSession, "ids")
    encoded(docs, vocabulary).write.parquet(path, compression="zstd")
    return docs.sparkSession.read.parquet(path)


def train(docs: DataFrame, shape: Shape = Shape()) -> Model:
    """Counts the words of all documents and fits the network to them; over the rounds every token of every document is a
    target. Null and empty texts have no tokens; repeated rows count as often as they occur, and null ids like any other.
    Without any token the network stays as it began. Which documents share a replica follows the splits of the input, so
    that the same rows in other files give slightly different scores."""
    model = start(docs, shape)
    model.network = fit(_kept(docs, model.vocabulary), model.network)
    return model


def train_and_score(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """score() of the documents under a model trained on them. Their ids are made once and kept in the shared folder."""
    model = start(docs, shape)
    rows = _kept(docs, model.vocabulary)
    model.network = fit(rows, model.network)
    return score_encoded(rows, model)


def fit(rows: DataFrame, network: Network) -> Network:
    """Trains the network on the rows of encoded()."""
    spark, shape = rows.sparkSession, network.shape
    rows = rows.filter("ids is not null").select("ids")
    for turn in range(shape.rounds):
        shipped = spark.sparkContext.broadcast((shape, network.vector))

        def work(batches, turn=turn, shipped=shipped):
            shape, vector = shipped.value
            own = Network(shape, vector)
            held, size, total = [], 0, 0

            def learn():
                around, target = np.concatenate([x[0] for x in held], axis=1), np.concatenate([x[1] for x in held])
                mixed = np.random.default_rng(len(target)).permutation(len(target))
                for i in range(0, len(mixed), STEP):
                    own.learn(around.take(mixed[i : i + STEP], axis=1), target[mixed[i : i + STEP]])

            for b in batches:
                ids, sizes = _joined(b.column("ids").to_pylist())
                edges = np.cumsum([0, *sizes])
                at = [s + targets(ids[s:e].tobytes(), e - s, turn, shape.share) for s, e in zip(edges, edges[1:])]
                at = np.concatenate(at) if at else edges[:0]
                padded, place = own.padded(ids, sizes)
                for i in range(0, len(at), 8 * STEP):
                    part = at[i : i + 8 * STEP]
                    held.append((own.around(padded, place[part]), ids[part]))
                    size += len(part)
                    total += len(part)
                    if size >= 8 * STEP:
                        learn()
                        held, size = [], 0
            if held:
                learn()
            if total:
                for i in range(0, len(own.vector), CHUNK):
                    yield {"chunk": [i // CHUNK], "part": [TaskContext.get().partitionId() % 16], "weight": [total], "v": [own.vector[i : i + CHUNK]]}

        def mean(key, batch):
            import pandas as pd

            w = batch["weight"].to_numpy(np.float64)
            total = sum(x * v.astype(np.float64) for x, v in zip(w, batch["v"])) / w.sum()
            return pd.DataFrame({"chunk": [key[0]], "part": [key[1] if len(key) > 1 else 0], "weight": [w.sum()], "v": [total]})

        # averaged in two steps, so that no task gathers the chunks of all others
        replicas = map_rows(rows, work, "chunk int, part int, weight double, v array<float>")
        some = replicas.groupBy("chunk", "part").applyInPandas(mean, "chunk int, part int, weight double, v array<double>")
        chunks = some.groupBy("chunk").applyInPandas(mean, "chunk int, part int, weight double, v array<double>").collect()  # one model
        if not chunks:
            break
        network = Network(shape, np.concatenate([np.asarray(r.v, np.float32) for r in sorted(chunks, key=lambda r: r.chunk)]))
    return network


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of some documents, one after the other, and how many each has."""
    return np.frombuffer(b"".join(rows), "<i2"), np.fromiter((len(x) // 2 for x in rows), np.int64, len(rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per input row: doc_id, n_tokens, pseudo_log_likelihood (sum over the whole text), mean_log_probability (null without
    tokens). Null and empty texts have no tokens and sum to 0; repeated rows come out alike, as often as they came; null
    ids need no care; other columns are not read; an empty table gives an empty result."""
    return score_encoded(_kept(docs, model.vocabulary), model)


def score_encoded(rows: DataFrame, model: Model) -> DataFrame:
    """score() of the rows of encoded() as they were written."""
    shape = model.network.shape
    shipped = rows.sparkSession.sparkContext.broadcast((shape, model.network.vector))

    def work(batches):
        net = Network(*shipped.value)
        for b in batches:
            raw = b.column("ids").to_pylist()
            sums, lo = np.zeros(len(raw)), 0
            size = np.fromiter((len(x) // 2 for x in raw), np.int64, len(raw))
            while lo < len(raw):  # documents are scored together, each in its own context, in blocks of bounded size
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), 1 << 17, "right")) + lo)
                ids, sizes = _joined(raw[lo:hi])
                total = np.concatenate(([0.0], np.cumsum(net.log_probabilities(ids, sizes))))
                edges = np.cumsum([0, *sizes])
                sums[lo:hi] = total[edges[1:]] - total[edges[:-1]]
                lo = hi
            yield {"chunk": b.column("chunk"), "doc": b.column("doc"), "doc_id": b.column("_d"), "n_tokens": size, "classes": sums}

    of_classes = map_rows(rows.filter("ids is not null").select("chunk", "doc", "_d", "ids"), work, "chunk long, doc int, doc_id long, n_tokens long, classes double")
    asked = rows.filter("word is not null").select("chunk", "word", "docs")
    unseen = _of_class(model.unseen, F.pmod("word", F.lit(shape.others)).cast("int"))
    known = asked.join(model.shares, F.col("word") == F.col("_w"), "left").select("chunk", "docs", F.coalesce("log_share", unseen).alias("log_share"))
    within = known.repartition("chunk").select("chunk", F.explode("docs").alias("doc"), "log_share").groupBy("chunk", "doc").agg(F.sum("log_share").alias("words"))
    total = F.col("classes") + F.coalesce("words", F.lit(0.0))
    found = of_classes.join(within, ["chunk", "doc"], "left").withColumn("pseudo_log_likelihood", total)
    return found.select("doc_id", "n_tokens", "pseudo_log_likelihood", F.expr("pseudo_log_likelihood / nullif(n_tokens, 0)").alias("mean_log_probability"))
