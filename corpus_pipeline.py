"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated lines and passages are cut,
sources are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on the rows that its predecessor kept; all but the last return the
columns of documents. Columns beyond those are not read. No stage drops a row for a null or an empty text, and an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktlens.llm import common, mixing, pieces, shingles, substrings, toxicity
from marktlens.llm.queries import TOKENIZERS, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labels of these documents, those held out aside; what it predicts toxic goes. Equal texts are
    judged alike; null and empty ones have the least score."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup of five-word shingles at a Jaccard similarity of 0.8 and more; the smallest doc_id of each component
    stays. Null and blank texts are copies of each other; rows equal in doc_id and text stay or go together, and a null doc_id
    stays only in a component without others."""
    return shingles.keep_one(docs.select(*COLUMNS), words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of lines and passages are cut out, the first by doc_id (nulls last) stays; documents stay, if need be
    with an empty text. n_chars is that of what is left, null for a null text. Rows equal in doc_id and text come out alike."""
    found = substrings.dedup_substrings(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is drawn at least once; those of small sources up to twice as often as those of the largest. Rows come, and
    are written, in the order of the mixture's blocks. A null source is one of its own; rows without tokens come once, and equal
    rows have draws of their own."""
    return mixing.mix(docs.select(*COLUMNS), max_repeats=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, parity and round_trip of every row, as often as it comes. A null text has null ids, n_tokens, parity and
    round_trip, an empty one no ids."""
    return pieces.encode(docs.select("doc_id", "text", "source"), f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "parity", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_similar),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against slow twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each but the last keeps is written to the shared folder and read again."""
    folder = common.folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
