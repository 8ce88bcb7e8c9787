"""Word vectors: rarity by rank, text embeddings, directions between word pairs and alternatives.

Words are rows (w, id, vec); id is the frequency rank from 1, 0 being the
unknown word. Any table of vectors will do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import vectors as V

# fixed values: limits and weights of alternatives
UNKNOWN_RARITY = 0.9
COMMON, POOL_COSINE, KEEP_COSINE, DROP = 0.66, 0.36, 0.42, 0.22
CONTEXT, RARER, FORMAL, MIRROR, MIRROR_GATE = 0.55, 0.08, 0.10, 16.0, 0.008
POOL_RARER, POOL_FORMAL = 0.1, 0.12

ASKED = 20_000  # words asked for in one broadcast


def ranked(uni: DataFrame) -> DataFrame:
    """(w, id): words by falling count. Ranks come from counts per count and letter, so no task sorts all words."""
    keyed = uni.select("w", "c", F.substring(F.md5("w"), 1, 2).alias("part"))
    sizes = keyed.groupBy("c").agg(F.count("*").alias("n"))
    before = sizes.select("c", (F.sum("n").over(Window.orderBy(F.desc("c"))) - F.col("n")).alias("before"))  # one row per distinct count
    within = keyed.groupBy("c", "part").agg(F.count("*").alias("m")).select("c", "part", (F.sum("m").over(Window.partitionBy("c").orderBy("part")) - F.col("m")).alias("inside"))
    place = F.row_number().over(Window.partitionBy("c", "part").orderBy("w"))
    return keyed.withColumn("r", place).join(before, "c").join(within, ["c", "part"]).select("w", (F.col("before") + F.col("inside") + F.col("r")).alias("id"))


def rarity(id_: Column, size: Column) -> Column:
    """ln(id + 1) / ln(size + 1); 0.9 for words outside the vocabulary (null)."""
    return F.when(id_.isNull(), UNKNOWN_RARITY).when(id_ == 0, 0.0).otherwise(F.log(id_ + 1) / F.log(size + 1))


def embedded(docs: DataFrame, words: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, vec): the unit sum of a text's word vectors, each weighted by its rarity; texts without known words have none."""
    size = words.agg((F.count("*") + 1).alias("size"))
    tf = V.term_frequency(docs, id_col, text_col)
    parts = tf.join(words.withColumnRenamed("w", "term"), "term").where("id > 0").join(F.broadcast(size))
    weighted = parts.select(id_col, (F.col("tf") * rarity(F.col("id"), F.col("size"))).alias("k"), F.posexplode("vec").alias("d", "x"))
    sums = weighted.groupBy(id_col, "d").agg(F.sum(F.col("k") * F.col("x").cast("double")).alias("s"))
    whole = sums.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("v"))
    return V.with_unit(whole, "vec", F.col("v")).select(id_col, "vec")


def direction(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row dir: the unit sum of unit(pos) - unit(neg) over the pairs(pos, neg) of known words."""
    unit = V.with_unit(words, "u", F.col("vec").cast("array<double>")).select("w", "u")
    both = pairs.join(unit.withColumnsRenamed({"w": "pos", "u": "p"}), "pos").join(unit.withColumnsRenamed({"w": "neg", "u": "q"}), "neg")
    parts = both.select(F.posexplode(F.zip_with("p", "q", lambda a, b: a - b)).alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s"))
    whole = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("v"))
    return V.with_unit(whole, "dir", F.col("v")).select("dir")


def pool(queries: DataFrame, words: DataFrame, formal: DataFrame, keep: int = 40) -> DataFrame:
    """(w, other, cosine, rarer, formal, rank): words near each asked word w that are no form or negation of it.

    All words are scanned once against a block of asked words, as many as a
    broadcast may hold; more are asked in several blocks.
    """
    unit = V.with_unit(words, "u", F.col("vec").cast("array<double>")).select("w", "id", "u")
    size = words.agg((F.count("*") + 1).alias("size"))
    asked = unit.join(queries, "w").withColumnsRenamed({"id": "q_id", "u": "q_u"})
    blocks = -(-asked.count() // ASKED)
    if blocks > 1:
        parts = [queries.where(F.pmod(F.xxhash64("w"), F.lit(2 * blocks)) == k) for k in range(2 * blocks)]
        return reduce(DataFrame.unionByName, (pool(part, words, formal, keep) for part in parts))
    other = unit.withColumnsRenamed({"w": "other", "id": "o_id", "u": "o_u"}).where(F.col("other").rlike(r"^[a-z]{3,}\z")).join(F.broadcast(size)).where(F.col("o_id") <= COMMON * F.col("size"))
    pairs = other.join(F.broadcast(asked), F.col("other") != F.col("w")).withColumn("cosine", V.dot(F.col("q_u"), F.col("o_u"))).where(F.col("cosine") >= POOL_COSINE)
    pairs = pairs.where((X.inflection_class("other") == X.inflection_class("w")) & ~X.same_lemma(F.col("w"), F.col("other")) & ~X.is_negation_of(F.col("w"), F.col("other")))
    rarer = F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.log((F.col("o_id") + 60) / (F.col("q_id") + 60))))
    shift = F.greatest(F.lit(0.0), V.dot(F.col("o_u"), F.col("dir")) - V.dot(F.col("q_u"), F.col("dir")))
    scored = pairs.join(F.broadcast(formal)).select("w", "other", "cosine", rarer.alias("rarer"), shift.alias("formal"), "q_u", "o_u")
    order = Window.partitionBy("w").orderBy(F.desc(F.round(F.col("cosine") + POOL_RARER * F.col("rarer") + POOL_FORMAL * F.col("formal"), 9)), "other")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def alternatives(found: DataFrame, antonyms: DataFrame, gain: Column | None = None, limit: int = 6) -> DataFrame:
    """(w, other, score, rank): the pool's words by cosine, fit in context, rarity and register, less mirrored meanings.

    `gain` is how much better the other word fits its context than w does, in
    nats; without it context plays no part.
    """
    df = found.join(F.broadcast(antonyms.withColumnRenamed("dir", "anti")))
    df = df.withColumn("mirror", F.greatest(F.lit(0.0), -V.dot(F.col("q_u"), F.col("anti")) * V.dot(F.col("o_u"), F.col("anti"))))
    fit = F.lit(0.0) if gain is None else F.when(F.col("mirror") > MIRROR_GATE, 0.0).otherwise(F.tanh(gain / 4))
    df = df.withColumn("score", F.col("cosine") + CONTEXT * fit + RARER * F.col("rarer") + FORMAL * F.col("formal") - MIRROR * F.col("mirror"))
    best = F.max("score").over(Window.partitionBy("w"))
    order = Window.partitionBy("w").orderBy(F.desc(F.round("score", 9)), "other")
    kept = df.withColumn("best", best).where((F.col("cosine") >= KEEP_COSINE) & (F.col("score") >= F.col("best") - DROP))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("w", "other", "score", "rank")
