"""Token ids of documents as flat binary files, for readers that map them into memory.

A folder holds shards in ascending order of doc_id. Shard k is three files, all little-endian: `ids-k.bin` (the ids of its documents
one after another, each document closed by an end id; unsigned 16 bits where the vocabulary fits, else 32), `starts-k.bin`
(unsigned 64 bits: where each document begins among the ids of the whole folder, and where the last one ends) and `docs-k.bin` (signed
64 bits: doc_id). The table `shards` names them with their counts and bases. A range shuffle orders the rows, each task writes its
shard and returns its counts, and prefix sums over the shards' counts give the bases. Files are written under another name and then
moved, and a task that runs again writes the same bytes, so that lost executors do no harm.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marktlens.llm.common import dealt, map_rows, small_batches

#: Words whose ids a worker remembers, characters of those, words laid out at once, and documents that one task reads.
WORDS, CHARS, SLICE, BLOCK = 1 << 19, 1 << 23, 1 << 18, 1 << 13
SHARD = "shard int, n_docs long, n_null long, n_ids long, width int, first long, last long"

# What a tokenizer has to do for words apart to have the ids that they have together.
NORMALIZERS = {"NFC", "Lowercase", "Replace"}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that end words: a run of symbols after a letter or a digit is a piece of its own.
MARKS = ".,;:!?)"
#: Words of these letters alone are one piece, which the normalizers only lower; the model gets it with its bytes written as characters:
#: printable ones of Latin-1 as themselves, the others in order from U+0100 on.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in SHOWN)}


def parts_words(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer cuts texts at white space, and letters, digits and symbols from each other, whatever stands around them."""
    made = json.loads(tokenizer.to_str())
    steps = [n for x in [made["normalizer"] or {"type": "Sequence", "normalizers": []}] for n in x.get("normalizers", [x])]
    first, *then = [p for x in [made["pre_tokenizer"] or {}] for p in x.get("pretokenizers", [x])]
    plain = [p["type"] for p in then] == ["ByteLevel"] and not then[0]["add_prefix_space"] and not then[0]["use_regex"] and made["model"]["type"] == "BPE" and any(n["type"] == "Lowercase" for n in steps)
    plain &= all(n["type"] in NORMALIZERS and (n["type"] != "Replace" or (n["pattern"], n["content"]) == ({"Regex": "\\s+"}, " ")) for n in steps)
    return plain and first.get("type") == "Split" and (first["pattern"], first["behavior"], first["invert"]) == ({"Regex": PATTERN}, "Removed", True) and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) and t["content"][-1] not in MARKS for t in made["added_tokens"])


class Encoder:
    """Ids of texts. Where a tokenizer parts words (parts_words), texts are cut at ASCII white space and each new word is encoded once, without
    the marks that end it, which are encoded apart; words of letters alone go straight to the tokenizer's model. Other tokenizers get
    whole texts. What wasn't met again by the time that so many new words came is forgotten."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.apart = parts_words(self.tokenizer)
        self.young, self.old, self.chars = {}, {}, 0

    def learn(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self.young) > WORDS or self.chars > CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        odd = {}
        for t in texts:
            if t not in self.young:
                self.chars += len(t)
                held = self.old.get(t)
                if held is None:
                    held = self._word(t) if self.apart else None
                if held is None:
                    odd[t] = None
                else:
                    self.young[t] = held
        odd = list(odd)
        for at in range(0, len(odd), 1024):
            some = odd[at : at + 1024]
            for t, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.young[t] = array("I", e.ids).tobytes()
        return [self.young[t] for t in texts]

    def _word(self, word: str) -> bytes | None:
        """The ids of a word, but for odd ones."""
        stem = word.rstrip(MARKS)
        if not PLAIN.fullmatch(stem):
            return b"" if not word else None
        low, marks = stem.lower(), word[len(stem) :]
        ids = self.young.get(low) or self.old.get(low)
        if ids is None:
            ids = array("I", [x.id for x in self.tokenizer.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(BYTES))]).tobytes()
        self.young[low] = ids
        if marks:
            if marks not in self.young:
                self.young[marks] = array("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
            ids += self.young[marks]
        return ids

    def ids(self, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of all texts, each closed by `end`, in slices: (ids, how many of them each text has)."""
        parts = _words(texts) if self.apart else pa.array([[t] for t in texts.to_pylist()], pa.list_(pa.string()))
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        made = [*self.learn(coded.dictionary.to_pylist()), array("I", [end]).tobytes()]
        flat = np.frombuffer(b"".join(made), np.uint32)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts = np.cumsum(sizes) - sizes
        order = np.insert(coded.indices.to_numpy().astype(np.int32), bounds[1:], len(made) - 1)
        of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds) + 1)
        for at in range(0, len(order), SLICE):
            o = order[at : at + SLICE]
            yield _gather(flat, starts[o], sizes[o]), np.bincount(of[at : at + SLICE], weights=sizes[o], minlength=len(texts)).astype(np.int64)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    return Encoder(path)


def _words(texts: pa.Array) -> pa.Array:
    return pc.ascii_split_whitespace(texts)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def _name(kind: str, shard: int) -> str:
    return f"{kind}-{shard:06d}.bin"


class _File:
    """A file that gets its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, at = _open(folder)
        self.path, self.part = f"{at}/{name}", f"{at}/_{name}.{uuid.uuid4().hex}"
        self.to = self.fs.open_output_stream(self.part)

    def write(self, values: np.ndarray) -> None:
        self.to.write(np.ascontiguousarray(values).tobytes())

    def close(self) -> None:
        self.to.close()
        if not isinstance(self.fs, fs.LocalFileSystem) and self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)  # elsewhere a move doesn't replace
        self.fs.move(self.part, self.path)


def _values(folder: str, name: str, kind: str, at: int, n: int) -> np.ndarray:
    """n values from the at-th on: mapped where the folder is a local or mounted one, read by position elsewhere."""
    system, root = _open(folder)
    size = np.dtype(kind).itemsize
    if n == 0:
        return np.empty(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", kind, "r", offset=at * size, shape=(n,))
    with system.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read_at(n * size, at * size), kind)


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 1, parts: int | None = None) -> DataFrame:
    """Encodes doc_id and text of all rows into a new folder and returns its table of shards.

    Rows come in ascending order of doc_id, null ids last; those with one id in the order of a hash of their texts, so that an id with
    many rows spreads over shards. Repeated rows count as often as they come. A null text is an empty one: its document is the end id
    alone. Other columns are not read. An empty table gives no shards. parts: how many shards to cut; else as many as the shuffle has
    partitions of rows, by their size."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), F.coalesce("text", F.lit("")).alias("_t")).withColumn("_k", F.xxhash64("_t"))
    order = [F.col("_d").asc_nulls_last(), F.col("_k").asc()]
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard, encoder, files = TaskContext.get().partitionId(), None, None
        n_docs = n_null = n_ids = 0
        first = last = None
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                encoder = _encoder(tokenizer)
                kind = "<u2" if max(end, encoder.tokenizer.get_vocab_size() - 1) < 1 << 16 else "<u4"
                files = [_File(folder, _name(x, shard)) for x in ("ids", "sizes", "docs")]
            sizes = np.zeros(b.num_rows, np.int64)
            for ids, n in encoder.ids(b["_t"], end):
                files[0].write(ids.astype(kind))
                sizes += n
            files[1].write(sizes.astype("<u8"))
            files[2].write(b["_d"].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            here = pc.min_max(b["_d"]).as_py()
            first, last = here["min"] if first is None else first, last if here["max"] is None else here["max"]
            n_docs, n_null, n_ids = n_docs + b.num_rows, n_null + b["_d"].null_count, n_ids + int(sizes.sum())
        if files:
            for f in files:
                f.close()
            yield {"shard": [shard], "n_docs": [n_docs], "n_null": [n_null], "n_ids": [n_ids], "width": [int(kind[2])], "first": [first], "last": [last]}

    made = rows.repartitionByRange(*[parts] * bool(parts), *order).sortWithinPartitions(*order).drop("_k")
    map_rows(made, work, SHARD).write.parquet(f"{folder}/counts")
    # some numbers for each shard: one task sums them up
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = spark.read.parquet(f"{folder}/counts").select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("n_docs", "base_docs"), ("n_ids", "base_ids"))], F.max("last").over(before).alias("_before"))
    if not bases.filter("first < _before").isEmpty():
        raise RuntimeError("shards overlap")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                f = _File(folder, _name("starts", r["shard"]))
                f.write(np.concatenate([[r["base_ids"]], r["base_ids"] + np.cumsum(_values(folder, _name("sizes", r["shard"]), "<u8", 0, r["n_docs"]).astype(np.int64))]).astype("<u8"))
                f.close()
            yield {c: b[c] for c in b.schema.names}

    schema = SHARD + ", base_docs long, base_ids long"
    placed = map_rows(dealt(bases.drop("_before"), "shard"), place, schema)
    placed.write.parquet(f"{folder}/shards")
    return shards(spark, folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens (with the end id), ids_crc32 (of the ids as unsigned 32-bit
    integers) and, if asked for, ids. Documents are dealt out in blocks."""
    pieces = shards(spark, folder).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(BLOCK).cast("long"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                shard, at, n = r["shard"], r["_from"], min(BLOCK, r["n_docs"] - r["_from"])
                starts = _values(folder, _name("starts", shard), "<u8", at, n + 1).astype(np.int64)
                docs = _values(folder, _name("docs", shard), "<i8", at, n)
                base, kind = r["base_ids"], f"<u{r['width']}"
                ids = _values(folder, _name("ids", shard), kind, int(starts[0]) - base, int(starts[-1] - starts[0]))
                cut = [ids[a:z].astype("<u4") for a, z in zip(starts[:-1] - starts[0], starts[1:] - starts[0])] if with_ids else None
                sums = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(starts[:-1] - starts[0], starts[1:] - starts[0])]
                null = np.arange(at, at + n) >= r["n_docs"] - r["n_null"]
                yield {"doc_id": pa.array(docs, mask=null), "start": starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": sums} | ({"ids": cut} if with_ids else {})

    return map_rows(dealt(pieces, "shard", "_from"), work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


class Reader:
    """Random access for a trainer: ids by their place among all ids of a folder. Holds the table of shards alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self.shards = shards(spark, folder).orderBy("shard").collect()
        self.bases = [r.base_ids for r in self.shards]

    def window(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on, over the bounds of documents and shards; fewer at the end."""
        out, k = [], max(0, bisect.bisect_right(self.bases, start) - 1)
        while n > 0 and k < len(self.shards):
            r = self.shards[k]
            some = min(n, r.base_ids + r.n_ids - start)
            if some > 0:
                out.append(np.asarray(_values(self.folder, _name("ids", r.shard), f"<u{r.width}", start - r.base_ids, some)).astype(np.uint32))
                start, n = start + some, n - some
            k += 1
        return np.concatenate(out) if out else np.empty(0, np.uint32)
