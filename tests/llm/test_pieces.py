import hashlib

import numpy as np
import pytest
import sentencepiece

from marktlens.llm import pieces, queries

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
ODD = ["", " ", "   ", "a  b", "\n\n x\t y ", "日本語 🙂 é", "a\x00b", "<s> hi </s> <unk> <0x41>", " lead", "trail  ", "x" * 5000, "ab " * 40000, None]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + np.float32(value).tobytes()
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram():
    """A small unigram model with byte fallback, written by hand."""
    words = ["▁", "▁the", "▁th", "e", "▁cat", "c", "a", "t", "s", "at", "h", "▁s", "é"]
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(w, -1.0 - i / 7, 1) for i, w in enumerate(words)]
    made = [(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in rows]
    return message(*made, (2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


def same(got, text, sp):
    ids = sp.encode(text)
    return got == ids


@pytest.mark.parametrize("data", [open(MODEL, "rb").read(), unigram()], ids=["bpe", "unigram"])
def test_parity(data):
    sp, coder = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Encoder(data)
    texts = [t for t in ODD if t is not None] + ["the cats sat at the cat", "that  théâtre"]
    if sp.vocab_size() < 1000:
        texts = [t for t in texts if len(t) < 100]
    for text, (ids, parity, trip) in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(text) and parity and trip == (sp.decode(sp.encode(text)) == text), text[:30]
    assert coder.decode([sp.encode(t) for t in texts]) == [sp.decode(sp.encode(t)) for t in texts]


def test_whole_texts_where_words_are_not_apart(monkeypatch):
    data = open(MODEL, "rb").read()
    coder = pieces.Encoder(data)
    whole = pieces.Encoder(data)
    whole.by_words = False
    texts = [t for t in ODD if t is not None]
    assert coder.encode(texts) == whole.encode(texts)


def test_memo_that_overflows(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 6)
    data = open(MODEL, "rb").read()
    text = " ".join(f"word{i % 9} x{i}" for i in range(60))
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert np.frombuffer(pieces.Encoder(data).encode([text])[0][0], "<i4").tolist() == sp.encode(text)


def test_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(ODD)], "doc_id long, text string, ids double")
    back = {r.doc_id: r for r in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()}
    assert len(back) == len(ODD)
    for i, t in enumerate(ODD):
        r = back[i]
        if t is None:
            assert r.ids is None and r.decoded is None and r.parity is None
        else:
            assert r.ids == sp.encode(t) and r.parity and r.round_trip and r.decoded == t


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()) and r.parity and r.round_trip


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.digest(docs, MODEL).collect() == []


def test_workers_keep_no_encoder_beyond_its_stage(spark):
    """Python workers outlive stages; a later stage's tasks must not carry the words and models of an earlier one."""
    import gc

    from marktlens.llm.common import map_rows

    docs = spark.range(8).selectExpr("id as doc_id", "concat('some words ', id) as text").repartition(4)
    assert pieces.digest(docs, f"{queries.TOKENIZERS}/piece_bpe_32k.model").filter("parity").count() == 8

    def work(batches):
        from marktlens.llm.pieces import Encoder

        for b in batches:
            yield {"held": [sum(isinstance(x, Encoder) for x in gc.get_objects())] * b.num_rows}

    assert map_rows(docs.select("doc_id"), work, "held int").agg({"held": "max"}).first()[0] == 0
