"""Queries over the recurrent word model. No trained weights are published, so these are drawn; the words are the most frequent ones of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import neural as N
from corpusloom.operators import ngram
from corpusloom.operators import wordvectors as W
from corpusloom.queries.language import _docs
from corpusloom.queries.typing import _places

WORDS = 5000  # the model's vocabulary, a parameter of the model


def _network(spark, sf_dir):
    top = W.ranked(ngram.count(_docs(spark, sf_dir)).uni).where(F.col("id") < WORDS).orderBy("id").select("w").collect()
    return N.drawn([N.UNKNOWN, *(r["w"] for r in top)])


def _asked(spark, sf_dir):
    """Every benchmark word after the two before it."""
    context = F.filter(F.array("w2", "w1"), lambda w: w.isNotNull())
    return _places(spark, sf_dir).select(F.col("word_id").alias("query_id"), context.alias("context"), "w", F.col("w").alias("seed"))


def neural_scores(spark, sf_dir):
    found = N.scored(_network(spark, sf_dir), _asked(spark, sf_dir))
    return found.select("query_id", "w", F.round("log_prob", 5).alias("log_prob"), "shown", "corrected", F.array_join("variants", " ").alias("variants"))


def neural_predictions(spark, sf_dir):
    return N.predicted(_network(spark, sf_dir), _asked(spark, sf_dir), 5).select("query_id", "w", F.round("log_prob", 5).alias("log_prob"), "rank")


def neural_phrases(spark, sf_dir):
    return N.phrased(_network(spark, sf_dir), _asked(spark, sf_dir), 3, 2).select("query_id", "phrase", F.round("log_prob", 5).alias("log_prob"))


def neural_alternatives(spark, sf_dir):
    return N.word_alternatives(_network(spark, sf_dir), _asked(spark, sf_dir)).select("query_id", "other", F.round("cosine", 5).alias("cosine"), F.round("gain", 5).alias("gain"), "rank")


QUERIES = {"neural_scores": neural_scores, "neural_predictions": neural_predictions, "neural_phrases": neural_phrases, "neural_alternatives": neural_alternatives}
SQL: dict[str, str] = {}
