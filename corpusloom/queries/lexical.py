"""Queries over word vectors. Words take the vector whose id is their rank's remainder, as no weights are published."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.operators import ngram
from corpusloom.operators import wordvectors as W
from corpusloom.queries import sql as S
from corpusloom.queries.language import table
from corpusloom.session import staged


def _words(spark, sf_dir):
    ids = W.ranked(ngram.count(table(spark, sf_dir, "documents")).uni)
    v = table(spark, sf_dir, "embeddings")
    n = v.agg(F.count("*").alias("vectors"))
    placed = ids.join(F.broadcast(n)).select("w", "id", (F.col("id") % F.col("vectors")).alias("vec_id"))
    return staged(placed.join(v.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("w", "id", "vec"), "words")


def word_rarity(spark, sf_dir):
    ids = W.ranked(ngram.count(table(spark, sf_dir, "documents")).uni)
    size = ids.agg((F.count("*") + 1).alias("size"))
    asked = ngram.count(table(spark, sf_dir, "benchmark")).uni.select("w")
    return asked.join(ids, "w", "left").join(F.broadcast(size)).select("w", "id", F.round(W.rarity(F.col("id"), F.col("size")), 6).alias("rarity"))


IDS = f"""{S.tokens('documents', 'doc_id')}, {S.tokens('benchmark', 'item_id', 'q')}, u AS (SELECT w, count(*) AS c FROM words GROUP BY w), ids AS (SELECT w, row_number() OVER (ORDER BY c DESC, substr(md5(w), 1, 2), w) AS id FROM u), sz AS (SELECT count(*) + 1 AS size FROM ids)"""
RARITY = f"WITH {IDS} SELECT q.w, id, round(coalesce(ln(id + 1) / ln(size + 1), 0.9), 6) AS rarity FROM (SELECT DISTINCT w FROM qwords) q LEFT JOIN ids ON ids.w = q.w, sz"


def text_embedding(spark, sf_dir):
    found = W.embedded(table(spark, sf_dir, "benchmark"), _words(spark, sf_dir), "item_id")
    return found.select("item_id", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.array_max("vec"), 6).alias("most"))


_TERMS = f"list_filter(list_transform(regexp_extract_all(text, {S.text(L.TERM)}), lambda x: regexp_replace(lower(x), '^[''-]+|[''-]+$', '', 'g')), lambda x: length(x) >= 3 AND x NOT IN {S.words(L.STOP_WORDS)})"
EMBED = f"""WITH {IDS}, t AS (SELECT item_id, unnest({_TERMS}) AS w FROM benchmark), n AS (SELECT count(*) AS n FROM embeddings),
k AS (SELECT item_id, ln(id + 1) / ln(size + 1) AS k, embedding FROM t JOIN ids USING (w), sz, n JOIN embeddings e ON e.vec_id = id % n.n),
x AS (SELECT item_id, k, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM k), s AS (SELECT item_id, d, sum(k * v) AS s FROM x GROUP BY ALL),
un AS (SELECT item_id, d, s / sqrt(sum(s * s) OVER (PARTITION BY item_id)) AS s FROM s)
SELECT item_id, round(max(CASE WHEN d = 1 THEN s END), 6) AS first, round(max(s), 6) AS most FROM un GROUP BY item_id"""


def word_alternatives(spark, sf_dir):
    """Alternatives of the benchmark's first words, with directions from two pairs of frequent words each."""
    words = _words(spark, sf_dir)
    pairs = spark.createDataFrame([("the", "and"), ("that", "this")], "pos string, neg string")
    anti = spark.createDataFrame([("is", "was"), ("in", "on")], "pos string, neg string")
    asked = table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "([A-Za-z]{3,})", 1)).alias("w")).where("w <> ''").distinct()
    found = W.alternatives(W.pool(asked, words, W.direction(words, pairs)), W.direction(words, anti))
    return found.select("w", "other", F.round("score", 6).alias("score"), "rank")


QUERIES = {"word_rarity": word_rarity, "text_embedding": text_embedding, "word_alternatives": word_alternatives}
SQL = {"word_rarity": RARITY, "text_embedding": EMBED}
