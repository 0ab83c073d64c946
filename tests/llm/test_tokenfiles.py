import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marktlens.llm import common, queries, tokenfiles

PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"
PLAIN = Tokenizer.from_file(PATH)


def brute(rows):
    """Rows in order with their ids, one after another."""
    out, start = [], 0
    for d, t in rows:
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def texts():
    r = random.Random(5)
    parts = ["Haus", "don't", "ÄÖ", "é", "́", " ", " ", "\x1c", "\x85", "<|endoftext|>", "12a", "世界", "!?", " ", "\n\t", "İ", "Σς", "\r\n", "　", "Haus.", "x\u0301.", "\u0130.", "a)", "'S!", "é?!", "1;", "\u0958.", "ÄrGER", "ÿß,", "×÷", "ªº"]
    return ["".join(r.choice(parts) + r.choice([" ", "", "  ", "\n"]) for _ in range(r.randrange(40))) for _ in range(60)] + ["", "   ", "x" * 5000, "wort " * 30_000]


def test_words_apart_give_the_ids_of_the_whole():
    encoder = tokenfiles.Encoder(PATH)
    assert encoder.apart
    made = texts()
    got, sizes = [], np.zeros(len(made), np.int64)
    for ids, n in encoder.ids(pa.array(made), 1):
        got.extend(ids.tolist())
        sizes += n
    want = [[*PLAIN.encode(t, add_special_tokens=False).ids, 1] for t in made]
    assert got == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    got = np.concatenate([ids for ids, _ in tokenfiles.Encoder.ids(ENCODER, pa.array([text]), 1)])
    assert got.tolist() == [*PLAIN.encode(text, add_special_tokens=False).ids, 1]


ENCODER = tokenfiles.Encoder(PATH)


def test_little_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr(tokenfiles, "WORDS", 3)
    monkeypatch.setattr(tokenfiles, "SLICE", 5)
    test_words_apart_give_the_ids_of_the_whole()
    encoder = tokenfiles.Encoder(PATH)
    for t in texts() * 2:  # forgets and meets words again
        got = np.concatenate([ids for ids, _ in encoder.ids(pa.array([t]), 1)])
        assert got.tolist() == [*PLAIN.encode(t, add_special_tokens=False).ids, 1]


def test_a_tokenizer_that_joins_words_takes_whole_texts():
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    encoder = tokenfiles.Encoder(path)
    assert not encoder.apart
    got = np.concatenate([ids for ids, _ in encoder.ids(pa.array(["a  b c", ""]), 7)])
    assert got.tolist() == [*Tokenizer.from_file(path).encode("a  b c", add_special_tokens=False).ids, 7, 7]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK", 3)
    rows = [(5, "b a"), (-3, None), (None, "null id"), (5, "b a"), (2**40, ""), (7, "lang " * 20_000), (None, None), (0, "x")] + [(100 + i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "ids", 1) for r in rows], "doc_id long, text string, ids string, start int").repartition(5)
    folder = common.folder(spark, "ids")
    tokenfiles.write(df, PATH, folder, parts=6)
    got = sorted((tuple(r) for r in tokenfiles.read(spark, folder).collect()), key=lambda r: r[1])
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    assert got[: len(ordered)] == brute(ordered)  # rows that share an id are equal
    assert sorted(r[2:] for r in got[len(ordered) :]) == sorted(r[2:] for r in brute([(None, None), (None, "null id")])) and all(r[0] is None for r in got[len(ordered) :])
    held = tokenfiles.shards(spark, folder).orderBy("shard").collect()
    assert len(held) > 1 and [r.base_ids for r in held] == np.cumsum([0, *(r.n_ids for r in held[:-1])]).tolist()
    assert {tuple(r.ids) for r in tokenfiles.read(spark, folder, with_ids=True).filter("doc_id = 5").collect()} == {(*PLAIN.encode("b a").ids, 1)}
    reader = tokenfiles.Reader(spark, folder)
    flat = [i for d, t in ordered for i in [*PLAIN.encode(t or "", add_special_tokens=False).ids, 1]]
    for start, n in ((0, 10), (len(flat) - 30, 20), (held[1].base_ids - 2, 5), (0, len(flat))):
        assert reader.window(start, n).tolist() == flat[start : start + n]
    assert len(reader.window(got[-1][1] + got[-1][2], 5)) == 0


def test_empty(spark):
    folder = common.folder(spark, "ids")
    assert tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), PATH, folder).count() == 0
    assert tokenfiles.read(spark, folder).collect() == [] and len(tokenfiles.Reader(spark, folder).window(0, 4)) == 0


def test_a_second_attempt_changes_nothing(spark, tmp_path):
    for _ in range(2):
        f = tokenfiles._File(str(tmp_path), "ids-000001.bin")
        f.write(np.arange(5, dtype="<u2"))
        f.close()
    assert [p.name for p in tmp_path.iterdir()] == ["ids-000001.bin"] and tokenfiles._values(str(tmp_path), "ids-000001.bin", "<u2", 2, 3).tolist() == [2, 3, 4]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    got = sorted(tuple(r) for r in queries.op13_token_files(spark, sf).collect())
    docs = sorted((r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect())
    assert got == brute(docs)
