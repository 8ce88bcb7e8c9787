"""Queries over spelling: fuzzy joins, decisions, splits and learned confusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import channel as C
from corpusloom.operators import correct as K
from corpusloom.operators import ngram
from corpusloom.queries import sql as S
from corpusloom.queries.language import model_of, table, words_of


def _model(spark, sf_dir):
    """The model of documents; the benchmark only asks."""
    return model_of(spark, sf_dir)


def _vocabulary(spark, sf_dir):
    return words_of(spark, sf_dir)


def _typed(spark, sf_dir):
    """Each benchmark word with one typo."""
    return ngram.count(table(spark, sf_dir, "benchmark")).uni.select(F.col("w").alias("intended"), C.corrupt_udf("w").alias("typed"))


def _queries(spark, sf_dir):
    """Corrupted benchmark words in their places."""
    s = ngram.sentences(table(spark, sf_dir, "benchmark")).select("item_id", F.posexplode("sentences").alias("no", "s"))
    rows = s.select("item_id", "no", F.posexplode(F.transform("s", lambda w, i: F.struct(F.when(i >= 2, F.get(F.col("s"), i - 2)).alias("w2"), F.when(i >= 1, F.get(F.col("s"), i - 1)).alias("w1"), w.alias("w")))).alias("pos", "x"))
    return rows.select(F.concat_ws("/", F.col("item_id"), F.col("no"), F.col("pos")).alias("query_id"), "x.*")


def fuzzy_neighbours(spark, sf_dir):
    return K.neighbours(_typed(spark, sf_dir), _vocabulary(spark, sf_dir).select("w")).select("typed", "w", F.round("cost", 6).alias("cost"))


def bucket_neighbours(spark, sf_dir):
    """The older index by first letter, over the benchmark's own words: it meets a share of all pairs, which the fuzzy join spares."""
    return K.first_letter_neighbours(_typed(spark, sf_dir).select("typed").distinct(), ngram.count(table(spark, sf_dir, "benchmark")).uni.select("w"))


def prefix_completions(spark, sf_dir):
    vocab = _vocabulary(spark, sf_dir).select("w")
    prefixes = ngram.count(table(spark, sf_dir, "benchmark")).uni.select(F.substring("w", 1, 3).alias("prefix")).where(F.length("prefix") == 3).distinct()
    return K.completions(prefixes, vocab, 8).select("prefix", "w", F.col("rank").cast("long").alias("rank"))


COMPLETIONS = f"""WITH {S.tokens('documents', 'doc_id')}, {S.tokens('benchmark', 'item_id', 'q')}, v AS (SELECT DISTINCT w FROM words), p AS (SELECT DISTINCT left(w, 3) AS prefix FROM qwords WHERE length(w) >= 3),
f AS (SELECT prefix, w, row_number() OVER (PARTITION BY prefix ORDER BY w) AS r FROM p JOIN v ON starts_with(w, prefix) AND w <> prefix), g AS (SELECT prefix, w, row_number() OVER (PARTITION BY prefix ORDER BY length(w), w) AS rank FROM f WHERE r <= 32)
SELECT * FROM g WHERE rank <= 8"""


def edit_costs(spark, sf_dir):
    """Costs of each typo; null where a cost is over the limit."""

    def finite(c):
        return F.when(c < float("inf"), F.round(c, 6))

    t = _typed(spark, sf_dir)
    return t.select("typed", "intended", finite(C.weighted_udf("typed", "intended")).alias("weighted"), finite(C.prefix_udf("typed", "intended")).alias("prefix"), C.structural_udf("typed", "intended").alias("edits"), C.phonetic_udf("intended").alias("sound"), C.fold_udf("intended").alias("folded"))


def corrections(spark, sf_dir):
    asked = _queries(spark, sf_dir).select("query_id", C.corrupt_udf("w").alias("token"), "w2", "w1")
    return K.decide(_model(spark, sf_dir), asked)


def respaced(spark, sf_dir):
    """Words of the benchmark cut in two, and whether they are joined again."""
    q = _queries(spark, sf_dir).where(F.length("w") >= 4)
    half = (F.length("w") / 2).cast("int")
    asked = q.select("query_id", F.col("w").substr(F.lit(1), half).alias("prev"), F.col("w").substr(half + 1, F.length("w")).alias("cur"), "w2", "w1")
    return K.respace(_model(spark, sf_dir), asked)


def segments_of_joined(spark, sf_dir):
    """Pairs of neighbouring benchmark words run together and cut again."""
    asked = _queries(spark, sf_dir).where("w1 is not null").select(F.concat("w1", "w").alias("typed"))
    found = K.segmented(ngram.Counts(_vocabulary(spark, sf_dir), None, None), asked)
    return found.select("typed", F.array_join("words", " ").alias("words"), F.round("log_prob", 6).alias("log_prob"))


def evaluation(spark, sf_dir):
    return K.evaluated(_model(spark, sf_dir), _queries(spark, sf_dir))


def confusion_learned(spark, sf_dir):
    return K.confusion(_typed(spark, sf_dir))


def information_gain(spark, sf_dir):
    asked = _queries(spark, sf_dir).select("query_id", C.corrupt_udf("w").alias("typed"), "w2", "w1")
    pool = K.candidates(_model(spark, sf_dir), asked).select("query_id", "w", "post", "typed", F.lit(K.OOV).alias("typed_post"))
    found = K.information(pool)
    return found.select("query_id", "best", *(F.round(c, 6).alias(c) for c in ("delta", "p_best", "p_typed", "entropy")))


QUERIES = {
    "fuzzy_neighbours": fuzzy_neighbours,
    "bucket_neighbours": bucket_neighbours,
    "prefix_completions": prefix_completions,
    "edit_costs": edit_costs,
    "corrections": corrections,
    "respaced": respaced,
    "segments_of_joined": segments_of_joined,
    "evaluation": evaluation,
    "confusion_learned": confusion_learned,
    "information_gain": information_gain,
}

SQL = {"prefix_completions": COMPLETIONS}
