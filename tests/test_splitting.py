"""Sentences of a batch of texts against the rules that work on a token at a time."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.functions import text as X
from corpusloom.operators import ngram


def by_columns(docs, kernel):
    raw = docs.select("id", F.posexplode(X.raw_tokens("text")).alias("pos", "t")).collect()
    texts = {}
    for r in raw:
        texts.setdefault(r["id"], []).append((r["pos"], r["t"]))
    rows = [(i, p, t, after) for i, own in texts.items() for (p, t), after in zip(sorted(own), [x for _, x in sorted(own)][1:] + [None])]
    df = docs.sparkSession.createDataFrame(rows, "id long, pos int, t string, n string")
    rule = X.is_kernel_terminator("t") if kernel else X.is_sentence_terminator("t", F.col("n"))
    found = {}
    for r in df.select("id", "pos", X.normalize_word("t").alias("w"), rule.alias("end")).orderBy("id", "pos").collect():
        own = found.setdefault(r["id"], [[]])
        if r["w"]:
            own[-1].append(r["w"])
        if r["end"]:
            own.append([])
    return {r["id"]: [s for s in found.get(r["id"], []) if s] for r in docs.select("id").collect()}


def test_sentences_follow_the_columns_rules(spark):
    rng = random.Random(5)
    bits = ["a", "B", "é", "Σ", "ΑΣ", "İ", "9", ".", "..", "!", "?", "…", '"', "'", ")", "]", "-", "U.S.", "e.g.", "A.b", "Mr.", "etc.", "x\u0131", "ſ", "\u212a", "\x1c", "\U0001f600"]
    spaces = [" ", "\n", "\t", "\x0b", "\u00a0", "\ufeff", "\u3000", "  ", "\u2009", "\x85"]
    late = ["a\ua7dcb", "\u1c89", "B\U00010d50c.", "\ua7cb9"]  # apart: a final sigma before one of these is not settled
    short = late + [x + "." for x in (*L.ABBREVIATIONS, *L.KERNEL_ABBREVIATIONS)]
    token = lambda: rng.choice(short) if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))
    texts = ["".join(token() + rng.choice(spaces) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for kernel in (False, True):
        found = {r["id"]: [list(s) for s in r["sentences"]] for r in ngram.sentences(docs, kernel=kernel).collect()}
        assert found == by_columns(docs, kernel)


def test_a_text_is_cut_without_a_lambda_per_token(spark):
    plan = ngram.sentences(spark.createDataFrame([("a b.",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
