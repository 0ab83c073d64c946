import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from marktlens.llm import substrings, toxicity
from tests.llm.test_shingles import brute as all_pairs

SF = "/root/testdata/sf0.001"


def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_against_slow_twins(spark):
    docs = table(spark)
    rows = {r.doc_id: r for r in docs.collect()}

    # toxicity: whatever the one-document scan says
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == cp.COLUMNS
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = []
    for d, r in rows.items():
        n, found, _ = model.scan(r.text, {})
        if model.score(n, max((x[2] for x in found), default=0.0)) < 0.3:
            clean.append(d)
    kept = kept.orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == sorted(clean) and all(r == rows[r.doc_id] for r in kept)

    # near-duplicates: all pairs by Jaccard, the smallest of each component
    kept = spark.createDataFrame(kept, docs.schema)
    got = cp.drop_similar(spark, kept, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == all_pairs([(d, rows[d].text) for d in sorted(clean)]) and all(r == rows[r.doc_id] for r in got)

    # repeats: documents in order, units seen before are cut
    kept = spark.createDataFrame(got, docs.schema)
    cut = {r.doc_id: r for r in cp.cut_repeats(spark, kept, SF).collect()}
    assert sorted(cut) == [r.doc_id for r in got]
    seen = set()
    for r in got:
        gone = []
        for s, e, form in substrings.units(r.text, 8, 5):
            if form in seen:
                gone.append((s, e))
            seen.add(form)
        want = substrings.cut(r.text, substrings.merge(gone))[0]
        assert cut[r.doc_id].text == want and cut[r.doc_id].n_chars == len(want)

    # mixing: every row at least once, none changed
    kept = spark.createDataFrame(list(cut.values()), docs.schema)
    mixed = cp.mix_sources(spark, kept, SF).collect()
    assert {tuple(r) for r in mixed} == {tuple(r) for r in cut.values()} and len(mixed) > len(cut)

    # tokens: the other library's
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{cp.TOKENIZERS}/piece_bpe_32k.model")
    coded = cp.encode(spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    assert len(coded) == len(mixed)
    for r in coded:
        assert r.ids == sp.encode(cut[r.doc_id].text) and r.n_tokens == len(r.ids) and r.parity and r.round_trip


def test_run(spark):
    rows = cp.run(spark, SF).collect()
    ids = [r.doc_id for r in rows]
    assert len(rows) > 150 and len(set(ids)) <= table(spark).count() and np.all([r.round_trip for r in rows])


def test_odd_tables(spark):
    docs = table(spark).filter("false")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, None, None), (2, "a b c", "en", "s", 5)], docs.schema)
    stages = dict(cp.STAGES)
    by = lambda df: sorted(map(tuple, df.collect()), key=str)
    for name, stage in list(stages.items())[:4]:
        assert by(stage(spark, docs, SF)) == [], name
    assert stages["sentencepiece"](spark, docs, SF).collect() == []
    toxic = stages["toxicity"](spark, odd, SF)
    assert by(toxic) == by(odd)  # nothing to learn from, nothing toxic
    near = stages["simhash_near_dedup"](spark, toxic, SF)
    blank = (1, None, None, None, None)
    assert by(near) == sorted([blank, blank, (2, "a b c", "en", "s", 5)], key=str)  # blank texts are copies; equal rows stay together
    cut = stages["substring_dedup"](spark, near, SF)
    assert by(cut) == by(near)
    mixed = stages["source_mixing"](spark, cut, SF)
    assert by(mixed) == by(cut)
    coded = stages["sentencepiece"](spark, mixed, SF)
    assert sorted((r.doc_id, r.source, r.n_tokens, r.ids and len(r.ids), r.parity, r.round_trip) for r in coded.select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), "n_tokens", "ids", "parity", "round_trip").collect()) == [(1, "-", None, None, None, None)] * 2 + [(2, "s", 3, 3, True, True)]
