"""Spelling: fuzzy joins, correction decisions, splits, joins and evaluation, for batches of questions.

Candidates come from equi-joins: on words with a few letters left out, which
all words within the cost share (channel.Signature), on the sound, and from the
language model's own predictions. The cost UDF runs on those pairs only.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import channel as C
from corpusloom.functions import lists as L
from corpusloom.functions import text as X
from corpusloom.operators import ngram
from corpusloom.session import staged

MOST = 4.0
KEEP = 64
KEYS = 50_000  # confusion counts that a task is given
BETA = 1.5
GAIN, NONWORD = 2.5, 0.6
MERGE, LONGEST = 8.0, 24
OOV = -20.72326583694641  # fixed value: ln(1e-9)


def near(typed: DataFrame, vocab: DataFrame, most: float = MOST, costs: C.Confusion | None = None, sound: bool = True) -> DataFrame:
    """(typed, w, cost): every vocabulary word whose key cost, or with `sound` else its sound cost, is `most` or less, by the keyboard's or by learned costs."""
    asked = staged(typed.select("typed").distinct(), "near-asked")
    own = asked.select("typed", C.forms_by(costs, most)("typed").alias("forms"))
    own = staged(own.select("typed", F.length(F.get("forms", F.lit(0))).alias("typed_n"), F.explode("forms").alias("form")), "near-forms")
    lengths = {r[0] for r in own.select("typed_n").distinct().collect()}
    # of the vocabulary's forms, many times its words, only those go on that a bit mask of the asked ones knows
    forms = C.asked_forms_by(costs, most, C.mask_of(own, "form"), lengths)
    listed = vocab.select("w", forms("w").alias("x")).where("x.n is not null").select("w", F.col("x.n").alias("w_n"), F.explode("x.forms").alias("form"))
    pairs = own.join(listed, "form").where(F.abs(F.col("typed_n") - F.col("w_n")) <= C.Signature(costs, most).shift).select("typed", "w")
    cost = C.cost_by(costs, most)("typed", "w")
    if sound:
        by_sound = asked.withColumn("key", C.phonetic_udf("typed")).join(vocab.withColumn("key", C.phonetic_udf("w")), "key").where("key <> ''").select("typed", "w")
        pairs, cost = pairs.unionByName(by_sound), F.least(cost, C.phonetic_cost_udf("typed", "w"))
    return pairs.distinct().withColumn("cost", F.round(cost, 9)).where(F.col("cost") <= most)


def neighbours(typed: DataFrame, vocab: DataFrame, most: float = MOST, limit: int = KEEP, costs: C.Confusion | None = None) -> DataFrame:
    """The cheapest `limit` of near() for each typed word."""
    order = Window.partitionBy("typed").orderBy("cost", "w")
    return near(typed, vocab, most, costs).withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")


def learned_costs(rows: DataFrame, keys: int = KEYS) -> C.Confusion:
    """Costs from confusion counts (kind, key, n), for a closure of bounded size: the `keys` counts that were seen most."""
    top = rows.select("kind", "key", "n").orderBy(F.desc("n"), "kind", "key").limit(keys)
    return C.Confusion(Counter({(r["kind"], r["key"]): r["n"] for r in top.collect()}))


def completions(prefixes: DataFrame, vocab: DataFrame, limit: int = 400) -> DataFrame:
    """(prefix, w, rank): words that begin so, shortest first among the first 4 * limit in order."""
    from corpusloom.operators.predict import begun

    pairs = begun(prefixes.select("prefix"), vocab.select("w"), "prefix").where(F.col("w") != F.col("prefix"))
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("prefix").orderBy("w"))).where(F.col("r") <= 4 * limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.length("w"), "w")))
    return ranked.where(F.col("rank") <= limit).select("prefix", "w", "rank")


def first_letter_neighbours(typed: DataFrame, vocab: DataFrame, most: float = MOST) -> DataFrame:
    """(typed, w, cost) among words whose first letter is the typed one or a key next to it."""
    letters = [(a, b) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" if a == b or C.key_distance(a, b) <= 1.2]
    near = typed.sparkSession.createDataFrame(letters, "a string, b string")  # 26 letters' neighbours
    fits = F.abs(F.length("typed") - F.length("w")) <= int(most / C.Channel().delete)
    pairs = typed.withColumn("a", F.substring("typed", 1, 1)).join(F.broadcast(near), "a").join(vocab.withColumn("b", F.substring("w", 1, 1)), "b").where(fits)
    return pairs.select("typed", "w", F.round(C.weighted_udf("typed", "w"), 9).alias("cost")).where(F.col("cost") <= most)


def _lm(counts: ngram.Counts, rows: DataFrame, word: str, name: str, context: bool = True) -> DataFrame:
    """rows with ln P of a column's word after (w2, w1), or alone."""
    empty = F.lit(None).cast("string")
    w2, w1 = (F.col("w2"), F.col("w1")) if context else (empty, empty)
    asked = rows.select(w2.alias("lm_2"), w1.alias("lm_1"), F.col(word).alias("lm_w")).distinct()
    scored = ngram.log_prob(counts, asked.select(F.col("lm_2").alias("w2"), F.col("lm_1").alias("w1"), F.col("lm_w").alias("w")), name=name)
    found = scored.select(F.col("w2").alias("lm_2"), F.col("w1").alias("lm_1"), F.col("w").alias("lm_w"), name)
    same = F.col(word).eqNullSafe(F.col("lm_w"))
    same = same & w2.eqNullSafe(F.col("lm_2")) & w1.eqNullSafe(F.col("lm_1"))
    return rows.join(found, same, "left").drop("lm_2", "lm_1", "lm_w")


def candidates(counts: ngram.Counts, asked: DataFrame, k: int = 32, beta: float = BETA, costs: C.Confusion | None = None) -> DataFrame:
    """(query_id, w, cost, lm, post, rank) for asked(query_id, typed, w2, w1): the k best by ln P - beta * cost."""
    vocab = counts.uni.select("w")
    near = asked.join(neighbours(asked, vocab, costs=costs).select("typed", "w"), "typed").select("query_id", "w")
    told = ngram.predict(counts, asked, max(4 * k, 40)).select("w2", "w1", "w")
    told = asked.alias("q").join(told.alias("t"), F.expr("q.w2 <=> t.w2 and q.w1 <=> t.w1")).select("query_id", "t.w")
    pairs = near.unionByName(told).distinct().join(asked, "query_id").withColumn("cost", F.round(C.cost_by(costs, MOST, True)("typed", "w"), 9)).where(F.col("cost") <= MOST)
    scored = _lm(counts, staged(pairs, "candidates"), "w", "lm").withColumn("post", F.col("lm") - beta * F.col("cost"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("post", 9)), "w")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def peers(counts: ngram.Counts, asked: DataFrame) -> DataFrame:
    """(query_id, w, post): for real words, the best other word that sounds alike or is in a set of confused words."""
    vocab = counts.uni.select("w")
    pairs = [(a, b) for group in L.CONFUSED for a in group for b in group if a != b]
    known = asked.sparkSession.createDataFrame(pairs, "typed string, w string").join(vocab, "w", "left_semi")
    sound = asked.select("typed").distinct().withColumn("key", C.phonetic_udf("typed")).join(vocab.withColumn("key", C.phonetic_udf("w")), "key").where("key <> '' and w <> typed").select("typed", "w")
    found = asked.join(known.unionByName(sound).distinct(), "typed")
    scored = _lm(counts, found, "w", "lm").withColumn("cost", C.phonetic_cost_udf("typed", "w")).withColumn("post", F.col("lm") - F.col("cost")).where("cost < double('Infinity')")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("post", 9)), "w")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").select("query_id", "typed", "w2", "w1", "w", "cost", "lm")


def decide(counts: ngram.Counts, asked: DataFrame, learned: list[str] = (), beta: float = BETA, threshold: float = GAIN, lexicon: DataFrame | None = None, split: bool = True, costs: C.Confusion | None = None) -> DataFrame:
    """(query_id, correct, from, to, reason) for asked(query_id, token, w2, w1); the first rule that fits decides.

    lexicon(w) holds real words that the model may lack; those, and words with a
    stem that model or lexicon has, are left as they are. costs are those learned
    from the typist's own corrections.
    """
    from corpusloom.operators.predict import suggest_split

    counts = counts.stored()  # they are read many times over
    vocab = counts.uni.select("w")
    asked = staged(asked.withColumn("typed", F.lower("token")), "asked")
    real = asked.join(vocab.select(F.col("w").alias("typed"), F.lit(True).alias("real")), "typed", "left").withColumn("real", F.coalesce("real", F.lit(False)))
    base = _lm(counts, real, "typed", "lm_typed").withColumn("typed_post", F.when(F.col("real"), F.col("lm_typed")).otherwise(F.lit(OOV)))
    base = staged(base, "decide-base")
    pool = candidates(counts, asked.select("query_id", "typed", "w2", "w1"), beta=beta, costs=costs).select("query_id", "w", "post")
    others = peers(counts, base.where("real").select("query_id", "typed", "w2", "w1")).select("query_id", "w", (F.col("lm") - beta * F.col("cost")).alias("post"))
    pool = pool.unionByName(others).groupBy("query_id", "w").agg(F.max("post").alias("post")).join(base.select("query_id", "typed", "real", "typed_post"), "query_id")
    close = F.col("real") | (F.col("w") == F.col("typed")) | (C.structural_udf("typed", "w") <= X.edit_budget(F.length("typed")))
    any_ = pool.groupBy("query_id").agg(F.lit(True).alias("any"))
    pool = pool.where(close)
    best = pool.groupBy("query_id").agg(F.max_by("w", F.struct(F.round("post", 9), F.expr("transform(split(w, ''), c -> -ascii(c))"))).alias("best"), F.max("post").alias("best_post"))
    df = base.join(any_, "query_id", "left").join(best, "query_id", "left")
    words = vocab if lexicon is None else vocab.unionByName(lexicon.select("w")).distinct()
    unknown = base.where("not real").select("typed").distinct()
    stems = unknown.select("typed", F.explode(X.stem_candidates("typed")).alias("w")).join(words, "w", "left_semi").select("typed")
    rare = stems if lexicon is None else stems.unionByName(unknown.join(lexicon.select(F.col("w").alias("typed")), "typed", "left_semi"))
    df = df.join(rare.distinct().withColumn("rare", F.lit(True)), "typed", "left")
    if split:
        df = df.join(suggest_split(counts, asked.select("query_id", "typed", "w2", "w1")).select("query_id", F.array_join("pieces", " ").alias("split")), "query_id", "left")
    else:
        df = df.withColumn("split", F.lit(None).cast("string"))
    alone = _lm(counts, _lm(counts, _lm(counts, df, "best", "lm_best"), "best", "u_best", False), "typed", "u_typed", False)
    evidence = (F.col("lm_best") - F.col("lm_typed")) - (F.col("u_best") - F.col("u_typed"))
    bar = F.when(~F.col("real") & ~F.col("token").rlike("[A-Z]"), threshold * NONWORD).otherwise(threshold)
    contraction = X.fix_contraction("typed")
    reason = (
        F.when(F.length("typed") < 2, "too-short")
        .when(F.col("typed").isin(list(learned)), "learn-listed")
        .when(X.is_acronym("token"), "acronym")
        .when(contraction.isNotNull(), "contraction")
        .when(F.col("rare"), "real-word-rare")
        .when(F.col("split").isNotNull(), "split")
        .when(F.col("any").isNull(), "no-candidate")
        .when(F.col("best").isNull() | (F.col("best") == F.col("typed")), "already-best")
        .when(F.col("best_post") - F.col("typed_post") < bar, "insufficient-info-gain")
        .when(F.col("real") & (evidence <= 0), "no-contextual-evidence")
        .otherwise("corrected")
    )
    df = alone.withColumn("reason", reason)
    correct = F.col("reason").isin("contraction", "split", "corrected")
    to = F.when(F.col("reason") == "contraction", contraction).when(F.col("reason") == "split", F.col("split")).otherwise(F.col("best"))
    return df.select("query_id", correct.alias("correct"), F.col("token").alias("from"), F.when(correct, X.match_case(F.col("token"), to)).otherwise(F.col("token")).alias("to"), "reason")


def information(pool: DataFrame) -> DataFrame:
    """(query_id, best, delta, p_best, p_typed, entropy) of pool(query_id, w, post, typed, typed_post)."""
    own = pool.select("query_id", "w", "post").unionByName(pool.select("query_id", F.col("typed").alias("w"), F.col("typed_post").alias("post")).distinct()).groupBy("query_id", "w").agg(F.max("post").alias("post"))
    top = Window.partitionBy("query_id")
    z = own.withColumn("e", F.exp(F.col("post") - F.max("post").over(top))).withColumn("p", F.col("e") / F.sum("e").over(top))
    stats = z.groupBy("query_id").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0))).alias("entropy"))
    best = pool.groupBy("query_id").agg(F.max_by("w", F.struct(F.round("post", 9), "w")).alias("best"), F.max("post").alias("best_post"), F.first("typed").alias("typed"), F.first("typed_post").alias("typed_post"))
    p = z.select("query_id", "w", "p")
    df = best.join(stats, "query_id").join(p.withColumnsRenamed({"w": "best", "p": "p_best"}), ["query_id", "best"]).join(p.withColumnsRenamed({"w": "typed", "p": "p_typed"}), ["query_id", "typed"])
    return df.select("query_id", "best", (F.col("best_post") - F.col("typed_post")).alias("delta"), "p_best", "p_typed", "entropy")


def _sequence(counts: ngram.Counts, rows: DataFrame) -> DataFrame:
    """rows(…, w2, w1, pieces) with `score`: ln P of one or two pieces after the context."""
    one = F.element_at("pieces", 1)
    df = _lm(counts, rows.withColumn("p1", one).withColumn("p2", F.get("pieces", F.lit(1))), "p1", "s1")
    two = df.withColumnsRenamed({"w2": "c2", "w1": "c1"}).withColumn("w2", F.col("c1")).withColumn("w1", F.col("p1"))
    two = _lm(counts, two, "p2", "s2").drop("w2", "w1").withColumnsRenamed({"c2": "w2", "c1": "w1"})
    return two.withColumn("score", F.col("s1") + F.when(F.col("p2").isNotNull(), F.col("s2")).otherwise(0.0)).drop("s1", "s2")


def respace(counts: ngram.Counts, asked: DataFrame, margin: float = MERGE) -> DataFrame:
    """(query_id, to) for asked(query_id, prev, cur, w2, w1): two words joined or cut elsewhere, if far likelier."""
    df = asked.select("query_id", F.lower("prev").alias("a"), F.lower("cur").alias("b"), "w2", "w1").where((F.length("a") > 0) & (F.length("b") > 0) & (F.length("a") + F.length("b") <= LONGEST))
    df = staged(df.withColumn("joined", F.concat("a", "b")), "respace")
    cuts = F.transform(F.sequence(F.lit(1), F.length("joined")), lambda k: F.when(k == F.length("joined"), F.array("joined")).otherwise(F.array(F.col("joined").substr(F.lit(1), k), F.col("joined").substr(k + 1, F.length("joined")))))
    options = df.select("*", F.posexplode(cuts).alias("k", "pieces")).withColumn("typed", F.col("k") + 1 == F.length("a"))
    bad = options.select("query_id", "k", F.explode("pieces").alias("w")).join(counts.uni.select("w", F.lit(True).alias("known")), "w", "left")
    bad = bad.where(X.is_fragment("w") | F.col("known").isNull()).select("query_id", "k").distinct().withColumn("bad", F.lit(True))
    scored = _sequence(counts, options.join(bad, ["query_id", "k"], "left").where(F.col("typed") | F.col("bad").isNull()))
    base = scored.where("typed").select("query_id", F.col("score").alias("base"))
    best = scored.where("not typed").groupBy("query_id").agg(F.max_by("pieces", F.struct(F.round("score", 9), -F.col("k"))).alias("pieces"), F.max("score").alias("score"))
    told = df.select("query_id", X.fix_contraction("joined").alias("contraction"))
    out = told.join(best.join(base, "query_id").where(F.col("score") > F.col("base") + margin), "query_id", "left")
    return out.select("query_id", F.coalesce("contraction", F.array_join("pieces", " ")).alias("to")).where("to is not null")


def segmented(counts: ngram.Counts, asked: DataFrame, unknown: float = 6.0, longest: int = 20) -> DataFrame:
    """(typed, words, log_prob): the likeliest cut of each token into words, by unigrams.

    A token's parts are looked up by a join; the dynamic program sees one
    token's parts at a time.
    """
    tokens = asked.select("typed").distinct()
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.length("typed") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("typed") - i)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.col("typed").substr(i + 1, n).alias("w")))))
    rows = tokens.where(F.length("typed") > 0).select("typed", F.explode(parts).alias("p")).select("typed", "p.*")
    rows = staged(rows, "parts")
    total = counts.total.withColumnRenamed("n", "n_all")
    lp = F.when(F.col("c").isNull(), F.lit(OOV - unknown)).otherwise(F.log(F.col("c") / F.col("n_all")))
    scored = rows.join(ngram.narrowed(counts.uni, rows, ["w"]), "w", "left").join(F.broadcast(total)).select("typed", "at", "n", "w", lp.alias("lp"))

    def best(pdf):
        import pandas as pd

        size = len(pdf["typed"].iloc[0])
        top, back = [0.0] + [float("-inf")] * size, [0] * (size + 1)
        for end in range(1, size + 1):
            for row in pdf[pdf["at"] + pdf["n"] == end].sort_values("at").itertuples():
                if top[row.at] + row.lp > top[end]:
                    top[end], back[end] = top[row.at] + row.lp, row.at
        words, at, own = [], size, pdf["typed"].iloc[0]
        while at:
            words.insert(0, own[back[at] : at])
            at = back[at]
        return pd.DataFrame({"typed": [own], "words": [words], "log_prob": [top[size]]})

    return scored.groupBy("typed").applyInPandas(best, "typed string, words array<string>, log_prob double")


def evaluated(counts: ngram.Counts, words: DataFrame, k: int = 5) -> DataFrame:
    """One row for words(query_id, w, w2, w1): how often a corrupted word is put right, or found among k, and the share of keys saved."""
    from corpusloom.operators.predict import keys_saved

    own = staged(words.where(F.length("w") >= 2), "eval-words")
    asked = own.select("query_id", F.col("w").alias("intended"), C.corrupt_udf("w").alias("typed"), "w2", "w1").where("typed <> intended")
    asked = staged(asked, "eval")
    found = candidates(counts, asked.select("query_id", "typed", "w2", "w1"), k)
    hits = found.join(asked.select("query_id", "intended"), "query_id").groupBy("query_id").agg(F.max((F.col("w") == F.col("intended")).cast("int")).alias("hit"), F.max(((F.col("w") == F.col("intended")) & (F.col("rank") == 1)).cast("int")).alias("top"))
    rates = asked.join(hits, "query_id", "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("top", F.lit(0))), 6).alias("accuracy"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
    keys = keys_saved(counts, own.withColumnRenamed("query_id", "word_id")).agg(F.round(F.sum("saved") / F.sum("length"), 6).alias("saved"))
    return rates.join(keys)


def confusion(pairs: DataFrame) -> DataFrame:
    """(kind, key, n) learned from pairs(typed, intended); merging models is a union and a sum."""
    return pairs.select(F.explode(C.confusion_udf("typed", "intended")).alias("x")).groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))


def reranked(weights: list[float], features: Column) -> Column:
    """The score of a feature array under the reranker's weights."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(w, features, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def learn_weights(weights: list[float], shown: list[list[float]], accepted: int, rate: float = 0.05) -> list[float]:
    """One perceptron step towards the accepted item, if another was ranked first."""
    if not 0 <= accepted < len(shown):
        return weights
    scores = [sum(a * b for a, b in zip(weights, f)) for f in shown]
    top = scores.index(max(scores))
    return weights if top == accepted else [w + rate * (a - b) for w, a, b in zip(weights, shown[accepted], shown[top])]
