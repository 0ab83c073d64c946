import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marktlens.llm import pieces, queries, wordpiece

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


def greedy(word, first, further):
    """Longest match first; 0 if stuck."""
    at = n = 0
    while at < len(word):
        vocabulary = further if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


strings = st.text("abcd", min_size=1, max_size=5)


@settings(max_examples=400, deadline=None)
@given(st.sets(strings, max_size=12), st.sets(strings, max_size=12), st.lists(st.text("abcde", min_size=1, max_size=14), max_size=12))
def test_automaton(first, further, words):
    a = wordpiece.Automaton(first, further)
    for w in words:
        assert a.count(w) == greedy(w, first, further), w


def test_model_vocabulary():
    first, further = wordpiece.vocabulary(open(MODEL, "rb").read())
    a, r = wordpiece.Automaton(first, further), random.Random(1)
    letters = "".join({c for p in list(further)[:3000] for c in p}) + "etaoin" * 200
    for _ in range(2000):
        w = "".join(r.choice(letters) for _ in range(r.randint(1, 15)))
        assert a.count(w) == greedy(w, first, further), w


def test_rows(spark, monkeypatch):
    first, further = wordpiece.vocabulary(open(MODEL, "rb").read())
    texts = ["", None, " \n", "The cats, sat.", "日本語 x", "\U00012000", "word " * 60000, "a" * 3000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")], "doc_id long, text string, n_words string")
    rows = wordpiece.count_tokens(docs, MODEL).collect()
    assert len(rows) == 9
    for r in rows:
        words = wordpiece._WORD.findall(texts[r.doc_id] or "")
        each = [greedy(w, first, further) for w in words] if len(words) < 1000 else [greedy(words[0], first, further)] * len(words)
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(max(1, n) for n in each), each.count(0))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    first, further = wordpiece.vocabulary(open(MODEL, "rb").read())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        each = [greedy(w, first, further) for w in wordpiece._WORD.findall(texts[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(max(1, n) for n in each), each.count(0))
    assert pieces.MARK not in "".join(first | further)
