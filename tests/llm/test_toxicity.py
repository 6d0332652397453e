import zlib

import pytest

from tapeframe.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.CharacterModel.of(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("tr@@@sh", "trash"), ("$cum", "scum"),
                                         ("stuuuuupid", "stupid"), ("l0$er", "loser"), ("wor-th-less", "worthless")])
def test_restores_disguised_words(model, token, word):
    assert toxicity.token_words(token, model)[-1] == word


def test_plain_tokens_pass(model):
    assert toxicity.token_words("word,", model) == ["word"]
    assert toxicity.token_words("one,two", model) == ["one", "two", "onetwo"]
    assert toxicity.token_words("***", model) == [] and toxicity.token_words("", model) == []


def test_held_out_accuracy(spark):
    from tapeframe.llm.queries import op5_toxicity
    got = {r.doc_id: r for r in op5_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_disguised_texts_score_like_plain_ones(spark, model):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "what a stupid thing that is" if i % 2 else "what a fine thing that is", "x") for i in range(400)],
                                 "doc_id long, text string, label string")
    scorer = toxicity.fit(docs, labels, model, allowed=~toxicity.held_out(), per_class=150)
    rows = [(1, "you 5tup1d man", 0.0), (2, "you s t u p i d man", 0.0), (3, "a fine day", 0.0), (4, None, 0.0), (5, "", 0.0), (5, "", 0.0),
            (6, "fine " * 50000 + "stup1d", 0.0), (None, "stupid", 0.0)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), scorer, model).collect()
    high = sorted(str(r.doc_id) for r in got if r.score >= 0.5)
    assert len(got) == len(rows) and high == ["1", "2", "6", "None"]
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1


def test_without_both_labels(spark, model):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for labels, share in (([], 0.0), ([(1, 1), (2, 1)], 1.0)):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        scorer = toxicity.fit(docs, frame, model, allowed=toxicity.F.lit(True))
        assert all(abs(r.score - share) < 1e-6 for r in toxicity.score(docs, scorer, model).collect())
    assert toxicity.score(docs.limit(0), scorer, model).collect() == []
    assert toxicity.character_counts(docs.limit(0)).collect() == []
