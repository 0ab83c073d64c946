"""SentencePiece models on the tokenizers library.

The model protobuf is read by its wire format, and normaliser, metaspace marker, vocabulary with scores (or merges by
score) and byte fallback are rebuilt for the library. Where no piece goes on past a marker, words are independent of each
other, so that each task encodes a word once, in multithreaded batches of those that it hasn't met; otherwise whole
texts are encoded. Each new word's ids are held against those of the sentencepiece library, each text's against its decoded form.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktlens.llm.common import kept, map_rows, small_batches

MARK = "▁"
#: Words that a worker remembers between texts; when full they are forgotten and encoded anew.
MEMO = 700_000
#: Characters of texts that are encoded together.
TOGETHER = 1 << 20
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> dict:
    """pieces (text, score, kind), model type and the normaliser's settings of a serialised model."""
    out = {"pieces": [], "type": UNIGRAM, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True, "suffix": False, "unk": 0}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            out["pieces"].append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            out["type"], out["suffix"] = spec.get(3, UNIGRAM), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out |= {"charsmap": spec.get(2, b""), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    out["unk"] = next((i for i, p in enumerate(out["pieces"]) if p[2] == UNKNOWN), 0)
    return out


def build(data: bytes):
    """The library's tokenizer for a serialised model; whether words are independent of each other in it; whether texts get
    a marker in front; ids of bytes that Encoder has to put for unknown characters."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    m = parse(data)
    if m["suffix"]:
        raise ValueError("models with the marker at the end of words are not supported")
    ids = {p: i for i, (p, _, _) in enumerate(m["pieces"])}
    has_bytes = any(k == BYTE for _, _, k in m["pieces"])
    if m["type"] == UNIGRAM:
        # only ordinary pieces may match; the others keep their ids under names that no text spells. Byte fallback is done by
        # Encoder, as the library would take texts such as <0x41> for bytes
        model = models.Unigram([(p, s) if k in (NORMAL, USER) else (f"\U0010fffd{i}", 0.0) for i, (p, s, k) in enumerate(m["pieces"])], unk_id=m["unk"], byte_fallback=False)
    elif m["type"] == BPE:
        joined = {p for p, _, k in m["pieces"] if k in (NORMAL, USER)}
        merges = []
        for p, score, k in m["pieces"]:
            if k == NORMAL:
                parts = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in joined and p[i:] in joined]
                merges += [(-score, x) for x in sorted(parts, key=lambda x: (ids[x[0]], ids[x[1]]))]
        merges.sort(key=lambda x: x[0])
        model = models.BPE(vocab=ids, merges=[x for _, x in merges], unk_token=m["pieces"][m["unk"]][0], fuse_unk=True, byte_fallback=has_bytes)
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = []
    if m["charsmap"]:
        steps.append(normalizers.Precompiled(m["charsmap"]))
    if m["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m["prefix"]:
        steps.append(normalizers.Prepend(MARK))
    if m["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    t = Tokenizer(model)
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m["prefix"] else [])])
    apart = m["escape"] and not any(MARK in p.lstrip(MARK) for p, _, k in m["pieces"] if k in (NORMAL, USER))
    own_bytes = [ids[f"<0x{i:02X}>"] for i in range(256)] if has_bytes and m["type"] == UNIGRAM else []
    return t, apart, m["prefix"], own_bytes, m["unk"], ids


class Encoder:
    """Ids of texts as little-endian 32-bit integers, by words where the model allows it."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        from tokenizers import Tokenizer, models, normalizers

        self.words, self.by_words, self.prefix, self.bytes, self.unk, ids = build(data)
        self.normalizer = self.words.normalizer
        self.words.normalizer = normalizers.Sequence([])
        self.names = Tokenizer(models.BPE(vocab=ids, merges=[], unk_token=None))  # to decode: ids to pieces
        self.names.decoder = self.words.decoder
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec = parse(data)
        self.plain = not spec["charsmap"] and not spec["squeeze"] and spec["prefix"] and spec["escape"]
        self.memo: dict[str, bytes] = {}
        self.differ, self.lossy = set(), set()
        self.stop = self.other.encode(".")
        self.stop_text = self.decode([self.stop])[0]

    def _ids(self, tokenizer, texts: list[str]) -> list[list[int]]:
        if not self.bytes:
            return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids = []
            for i, (a, b) in zip(e.ids, e.offsets):
                ids += [self.bytes[x] for x in text[a:b].encode()] if i == self.unk else [i]
            out.append(ids)
        return out

    def _learn(self, words: list[str]) -> None:
        mine = self._ids(self.words, words)
        plain = [(w[1:] if self.prefix and w[0] == MARK else w).replace(MARK, " ") for w in words]
        # a blank before the first word is the prefix's, which decoding strips: ids of its other words stand behind a full stop
        back = self.decode([[*self.stop, *ids] for ids in mine])
        for w, p, a, b, t in zip(words, plain, mine, self.other.encode(plain, num_threads=1), back):
            self.memo[w] = np.array(a, "<i4").tobytes()
            # a lone marker is an empty text there; its only spelling is the piece itself
            if a != (b if p else [self.other.piece_to_id(w)]):
                self.differ.add(w)
            if t != self.stop_text + w.replace(MARK, " "):
                self.lossy.add(w)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.normalizer.normalize_str(text)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Ids of each text, whether the sentencepiece library gives the same ones, and whether they decode to the text."""
        if not self.by_words:
            mine = self._ids(self.words, [self.normalise(t) for t in texts])
            return [(np.array(a, "<i4").tobytes(), a == b, t == back) for a, b, t, back in zip(mine, self.other.encode(texts, num_threads=1), texts, self.decode(mine))]
        out, at = [], 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and (not lists or size + len(texts[at]) <= TOGETHER):
                lists.append(_WORDS.findall(self.normalise(texts[at])))
                size += len(texts[at])
                at += 1
            new = set().union(*lists).difference(self.memo)
            if len(self.memo) + len(new) > MEMO:
                for known in (self.memo, self.differ, self.lossy):
                    known.clear()
                new = set().union(*lists)
            new = sorted(new)
            for lo in range(0, len(new), 4096):  # what the libraries make of words takes far more memory than what is kept
                self._learn(new[lo : lo + 4096])
            for text, words in zip(texts[at - len(lists) : at], lists):
                same = self.differ.isdisjoint(words)
                trip = MARK not in text and self.plain and self.lossy.isdisjoint(words)
                ids = b"".join(map(self.memo.__getitem__, words))
                if not self.plain:
                    trip = self.decode([np.frombuffer(ids, "<i4").tolist()])[0] == text
                out.append((ids, same, trip))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.names.decode_batch(ids, skip_special_tokens=False)


def load(spark: SparkSession, path: str) -> bytes:
    """A model file, local to the driver or in a store that Spark reads; models are some megabytes at most."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first().content)
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, threads: int = 2, column: str = "text") -> DataFrame:
    """The rows of `docs` with ids (array of int), parity (the sentencepiece library gives the same ids) and round_trip
    (decoding gives the text again; not so for texts that hold the marker itself, which decodes as a blank).

    A null text has null ids, parity and round_trip; an empty one no ids. Columns with the new names are replaced."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))
    new = ("ids", "parity", "round_trip")
    rest = [f for f in docs.schema if f.name not in new]

    def work(batches):
        coder = kept(Encoder, shipped.value, threads)
        for b in batches:
            texts = b.column(column).to_pylist()
            for lo in range(0, len(texts), 512):
                part = texts[lo : lo + 512]
                found = iter(coder.encode([t for t in part if t is not None]))
                found = [None if t is None else next(found) for t in part]
                out = {f.name: b.column(f.name).slice(lo, len(part)) for f in rest}
                out["ids"] = [None if x is None else np.frombuffer(x[0], "<i4") for x in found]
                yield out | {c: [None if x is None else x[i] for x in found] for i, c in ((1, "parity"), (2, "round_trip"))}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return map_rows(docs.select(*[f.name for f in rest]), work, f"{fields}, ids array<int>, parity boolean, round_trip boolean")


def decode(rows: DataFrame, path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with their ids decoded into a text column; null ids give null. Ids outside the vocabulary are left out."""
    small_batches(rows.sparkSession)
    shipped = rows.sparkSession.sparkContext.broadcast(load(rows.sparkSession, path))
    rest = [f for f in rows.schema if f.name != into]

    def work(batches):
        coder = kept(Encoder, shipped.value, 2)
        for b in batches:
            ids = b.column(column).to_pylist()
            texts = coder.decode([x or [] for x in ids])
            yield {f.name: b.column(f.name) for f in rest} | {into: [None if x is None else t for x, t in zip(ids, texts)]}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return map_rows(rows.select(*[f.name for f in rest]), work, f"{fields}, `{into}` string")


def digest(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """encode() with a digest in place of the ids: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers), parity, round_trip."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))

    def work(batches):
        coder = kept(Encoder, shipped.value, threads)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = iter(coder.encode([t for t in texts if t is not None]))
            found = [None if t is None else next(found) for t in texts]
            yield {
                "doc_id": b.column("doc_id"),
                "n_tokens": [None if x is None else len(x[0]) // 4 for x in found],
                "ids_sha256": [None if x is None else hashlib.sha256(x[0]).hexdigest() for x in found],
                "parity": [None if x is None else x[1] for x in found],
                "round_trip": [None if x is None else x[2] for x in found],
            }

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_tokens long, ids_sha256 string, parity boolean, round_trip boolean")
