"""Models whose trigrams are counted when they are asked for, against counts of everything."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ngram


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("the a cat dog sat ran. on mat! big U.S. x".split()) for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", "..."]
    return spark.createDataFrame([(t,) for t in texts], "text string")


def found(df):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in df.collect())


def test_model_counts_as_count_does(docs):
    whole, own = ngram.count(docs), ngram.model(docs)
    for name in ("uni", "bi", "tri"):
        assert found(getattr(own, name).select(*getattr(whole, name).columns)) == found(getattr(whole, name))
    assert found(own.word_table()) == found(whole.word_table().select(*own.word_table().columns))
    assert found(own.totals()) == found(whole.totals())


@pytest.mark.parametrize("few", [10, 1_000_000])
@pytest.mark.parametrize("continuation", [False, True])
def test_log_prob_is_the_same_from_what_is_asked(spark, docs, monkeypatch, few, continuation):
    monkeypatch.setattr(ngram, "FEW", few)
    words = [None, "cat", "dog", "the", "a", "zebra", "<s>"]
    asked = spark.createDataFrame([(a, b, c) for a in words for b in words for c in words[1:6]], "w2 string, w1 string, w string")
    rounded = lambda df: found(df.select("w2", "w1", "w", F.round("log_prob", 9)))
    assert rounded(ngram.log_prob(ngram.model(docs), asked, continuation)) == rounded(ngram.log_prob(ngram.count(docs), asked, continuation))


def test_a_model_writes_no_trigram_that_nobody_asks_for(spark, docs):
    asked = spark.createDataFrame([("the", "cat")], "w2 string, w1 string")
    own = ngram.model(docs).asked_for(asked).tri
    assert {(r["w2"], r["w1"]) for r in own.collect()} == {("the", "cat")}


def test_a_mask_keeps_every_asked_row_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(ngram, "FEW", 10)
    df = spark.range(20_000).select(F.col("id").cast("string").alias("w"))
    kept = {int(r["w"]) for r in ngram.narrowed(df, df.where("w < 1000"), ["w"]).collect()}
    assert set(range(1000)) <= kept and len(kept) < 6000


def test_sizes_in_one_pass(spark, docs):
    assert found(ngram.sizes(docs)) == found(ngram.count(docs).sizes())
    assert found(ngram.sizes(docs.where("text is null"))) == [("1", "0", "0")]
    plan = ngram.sizes(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_questions_of_words_write_no_model(spark, tmp_path):
    from corpusloom.queries import language, spelling

    spark.createDataFrame([("the cat sat on the mat. thecat",)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the cat sat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(language._MODELS)
    assert {r["prefix"]: r["w"] for r in spelling.prefix_completions(spark, str(tmp_path)).collect()} == {"the": "thecat"}
    assert {r["typed"]: r["words"] for r in spelling.segments_of_joined(spark, str(tmp_path)).collect()} == {"thecat": "thecat", "catsat": "cat sat"}
    assert {k[2] for k in set(language._MODELS) - before} == {"words"}
