"""Counts by blocks are those of rows, and questions scored under several models at once those under each alone."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import blocks, ngram


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_blocks_count_what_rows_count(spark, monkeypatch):
    rng = random.Random(3)
    texts = [[rng.choice(["a", "b", "café", "d中", "e" * 40]) for _ in range(rng.randint(0, 6))] for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "s array<string>").repartition(3)
    monkeypatch.setattr(blocks, "FILL", 50)
    monkeypatch.setattr(blocks, "PARTS", 5)
    assert rows(blocks.pairs(df)) == rows(ngram.from_sentences(df).bi)
    assert blocks.pairs(df.where("false")).count() == 0
    tri = ngram.occurrences(df, ["w2", "w1", "w"])
    want = tri.groupBy("w2", "w1", "w").agg(F.count("*").alias("c"), F.sum(F.lit(2)).alias("d"))
    got = blocks.summed(tri.select("*", F.lit(1).alias("c"), F.lit(2).alias("d")), ["w2", "w1", "w"], ["c", "d"], ["w2", "w1"])
    assert rows(got.drop("part")) == rows(want)
    assert got.select("part", "w2", "w1").distinct().count() == want.select("w2", "w1").distinct().count()


def test_scored_at_once_as_alone(spark):
    own = ngram.model(spark.createDataFrame([("The cat sat on the mat. A cat ate the rat. The cat sat.",), (None,), ("On the mat sat a dog.",)], "text string"))
    other = ngram.model(spark.createDataFrame([("A dog sat on a cat. The zebra ate.",)], "text string"))
    asked = [(1, None, None, "the"), (1, "the", "cat", "sat"), (2, "the", "cat", "sat"), (2, "no", "cat", "sat"), (3, "the", "no", "sat"), (3, "on", "the", "zebra"), (4, None, "a", None), (4, "", "the", "cat"), (5, "the cat", "a\nb", "x y"), (5, "<s>", "<s>", "the"), (6, None, "<s>", "<s>")]
    df = spark.createDataFrame(asked, "id int, w2 string, w1 string, w string")
    for continuation in (False, True):
        both = ngram.scored([own, other], df, ["g", "p"], continuation)
        assert both.count() == len(asked)
        for counts, name in ((own, "g"), (other, "p")):
            rest = ngram.Counts(counts.uni, counts.bi, counts.tri)  # without sentences, so by joins with whole tables
            alone = ngram.log_prob(rest, df, continuation, name)
            cut = lambda x: rows(x.select("id", "w2", "w1", "w", F.round(name, 9)))  # noqa: B023, E731
            assert cut(both) == cut(alone) == cut(ngram.log_prob(counts, df, continuation, name))
