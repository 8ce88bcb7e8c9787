"""Queries over tokens, sentences and n-gram models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.functions import text as X
from corpusloom.operators import ngram
from corpusloom.queries import sql as S
from corpusloom.session import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; text of a single file, which may be one row group and so one task, is dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages") and len(df.inputFiles()) == 1:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _talk(spark, sf_dir):
    """Conversations as documents of a personal corpus: one per turn."""
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(key.alias("path"), "text")


_MODELS: dict[tuple, ngram.Counts | DataFrame] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, kind: str, make: Callable):
    """What make() gives, once per session and state of a table's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    own = [files.getFileStatus(path), *(files.listStatus(path) if files.getFileStatus(path).isDirectory() else [])]
    key = (spark.sparkContext.applicationId, name, kind, *((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in own))
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def model_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> ngram.Counts:
    """The model of a table's texts, written once: models are artefacts that many questions share."""
    return _kept(spark, sf_dir, name, "model", lambda: ngram.model(table(spark, sf_dir, name).select("text")))


def words_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """The words (w, c) of a table's texts, written once, for questions that need no more of its model."""
    return _kept(spark, sf_dir, name, "words", lambda: staged(ngram.count(table(spark, sf_dir, name).select("text")).uni, "uni"))


def tokenize_words(spark, sf_dir):
    found = X.tokenize_words("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("tokens"))


def tokenize_cased(spark, sf_dir):
    found = X.tokenize_words_cased("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("tokens"))


def _split(kernel: bool):
    def run(spark, sf_dir):
        rows = ngram.sentences(_docs(spark, sf_dir), kernel=kernel).select("doc_id", F.posexplode("sentences").alias("sentence_no", "words"))
        return rows.select("doc_id", F.col("sentence_no").cast("long").alias("sentence_no"), F.size("words").cast("long").alias("n"), F.array_join("words", " ").alias("sentence"))

    return run


def _split_sql(kernel: bool) -> str:
    return f"""WITH {S.tokens('documents', 'doc_id', kernel=kernel)}, s AS (SELECT id AS doc_id, sent, count(*) AS n, string_agg(w, ' ' ORDER BY pos) AS sentence FROM words GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent) - 1 AS sentence_no, n, sentence FROM s"""


def _gram(name: str, kernel: bool = False):
    def run(spark, sf_dir):
        return getattr(ngram.count(_docs(spark, sf_dir), kernel=kernel), name)

    return run


def _gram_sql(columns: str, name: str, kernel: bool = False) -> str:
    return f"WITH {S.tokens('documents', 'doc_id', kernel=kernel)}, {S.counts()} SELECT {columns}, c FROM {name}"


def continuation_counts(spark, sf_dir):
    return ngram.count(_docs(spark, sf_dir)).continuation()


def model_size(spark, sf_dir):
    return ngram.sizes(_docs(spark, sf_dir))


def corpus_document_frequency(spark, sf_dir):
    return ngram.document_frequency(_docs(spark, sf_dir))


def document_frequency_batch(spark, sf_dir):
    """Document frequency of the benchmark's words; 0 where a word is unknown, null were there no corpus."""
    asked = ngram.count(table(spark, sf_dir, "benchmark")).uni.select("w")
    df = ngram.document_frequency(_docs(spark, sf_dir))
    any_ = _docs(spark, sf_dir).agg((F.count("*") > 0).alias("any"))
    return asked.join(df, "w", "left").join(F.broadcast(any_)).select("w", F.when(F.col("any"), F.coalesce("df", F.lit(0))).alias("df"))


def unigram_lookup(spark, sf_dir):
    asked = ngram.count(table(spark, sf_dir, "benchmark")).uni.select("w")
    return asked.join(ngram.count(_docs(spark, sf_dir)).uni, "w", "left").select("w", F.coalesce("c", F.lit(0)).alias("c"))


def _asked(spark, sf_dir):
    """Each word of the conversations with the two before it in its sentence."""
    rows = ngram.sentences(_talk(spark, sf_dir)).select("path", F.posexplode("sentences").alias("sent", "s"))
    own = rows.select("path", "sent", F.posexplode(F.transform("s", lambda w, i: F.struct(F.when(i >= 2, F.get(F.col("s"), i - 2)).alias("w2"), F.when(i >= 1, F.get(F.col("s"), i - 1)).alias("w1"), w.alias("w")))).alias("pos", "x"))
    return own.select("path", "sent", "pos", "x.*")


ASKED = f"""{S.tokens('(SELECT conv_id || chr(47) || turn AS path, text FROM conversations)', 'path', 'q')},
    asked AS (SELECT id AS path, sent, pos, w, lag(w) OVER s AS w1, lag(w, 2) OVER s AS w2 FROM qwords WINDOW s AS (PARTITION BY id, sent ORDER BY pos))"""


def _log_prob(continuation: bool):
    def run(spark, sf_dir):
        counts = model_of(spark, sf_dir)
        scored = ngram.log_prob(counts, _asked(spark, sf_dir), continuation)
        return scored.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum("log_prob"), 4).alias("log_prob"))

    return run


def _log_prob_sql(continuation: bool) -> str:
    return f"""WITH {S.tokens('documents', 'doc_id')}, {S.counts()}, {S.model(continuation=continuation)}, {ASKED}, scored AS ({S.log_prob('asked', 'a.path')})
    SELECT path, count(*) AS n, round(sum(log_prob), 4) AS log_prob FROM scored GROUP BY path"""


def _contexts(spark, sf_dir):
    """The last two words of each benchmark item's sentences."""
    s = ngram.sentences(table(spark, sf_dir, "benchmark")).select(F.explode("sentences").alias("s"))
    return s.select(F.when(F.size("s") >= 2, F.element_at("s", -2)).alias("w2"), F.element_at("s", -1).alias("w1")).distinct()


CONTEXTS = f"""{S.tokens('benchmark', 'item_id', 'q')}, qs AS (SELECT list(w ORDER BY pos) AS s FROM qwords GROUP BY id, sent),
    contexts AS (SELECT DISTINCT CASE WHEN len(s) >= 2 THEN s[-2] END AS w2, s[-1] AS w1 FROM qs)"""


def predict_next(spark, sf_dir):
    found = ngram.predict(model_of(spark, sf_dir), _contexts(spark, sf_dir), 5)
    return found.select("w2", "w1", F.col("rank").cast("long").alias("rank"), "w", F.round("log_prob", 5).alias("log_prob"))


PREDICT = f"""WITH {S.tokens('documents', 'doc_id')}, {S.counts()}, {S.model()}, {CONTEXTS},
    seen AS (SELECT c.w2, c.w1, tri.w FROM contexts c JOIN tri ON tri.w2 = c.w2 AND tri.w1 = c.w1 UNION SELECT c.w2, c.w1, bi.w FROM contexts c JOIN bi ON bi.w1 = c.w1),
    cands AS (SELECT * FROM seen WHERE w <> '<s>'),
    top AS (SELECT w FROM uni ORDER BY c DESC, w LIMIT 8),
    asked AS (SELECT * FROM cands UNION ALL SELECT c.w2, c.w1, top.w FROM contexts c, top WHERE NOT EXISTS (SELECT 1 FROM cands s WHERE s.w1 = c.w1 AND s.w2 IS NOT DISTINCT FROM c.w2)),
    scored AS ({S.log_prob('asked', 'a.w2, a.w1, a.w')}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY w2, w1 ORDER BY round(log_prob, 9) DESC, w) AS rank FROM scored)
    SELECT w2, w1, rank, w, round(log_prob, 5) AS log_prob FROM ranked WHERE rank <= 5"""


def mixture(spark, sf_dir):
    """Next words of the conversations under the mixture of a global and a personal model."""
    asked = _asked(spark, sf_dir).select("path", "w2", "w1", "w")
    both = ngram.scored([model_of(spark, sf_dir), model_of(spark, sf_dir, "conversations")], asked, ["g", "p"])
    return both.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum(ngram.mixed(F.col("g"), F.col("p"))), 4).alias("log_prob"))


MIXTURE = f"""WITH {S.tokens('documents', 'doc_id')}, {S.counts()}, {S.model()}, {ASKED}, {S.counts('q')}, {S.model('q')},
    g AS ({S.log_prob('asked', 'a.path, a.sent, a.pos')}), p AS ({S.log_prob('asked', 'a.path, a.sent, a.pos', 'q')})
    SELECT g.path, count(*) AS n, round(sum(ln(0.85 * exp(g.log_prob) + 0.15 * exp(p.log_prob))), 4) AS log_prob FROM g JOIN p ON g.path = p.path AND g.sent = p.sent AND g.pos = p.pos GROUP BY g.path"""


def document_cache(spark, sf_dir):
    """Words of the conversations, lifted by how often their own turn uses them."""
    asked = _asked(spark, sf_dir)
    counts = model_of(spark, sf_dir)
    base = ngram.log_prob(counts, asked, name="b")
    empty = F.lit(None).cast("string")
    words = asked.select("w").distinct().select(empty.alias("w2"), empty.alias("w1"), "w")
    alone = ngram.log_prob(counts, words, name="u").select("w", "u")
    own = asked.groupBy("path", "w").agg(F.count("*").alias("c"))
    total = asked.groupBy("path").agg(F.count("*").alias("total"))
    df = base.join(alone, "w").join(own, ["path", "w"]).join(total, "path").join(counts.uni.select("w", F.lit(True).alias("known")), "w", "left")
    lifted = ngram.cached(F.col("b"), F.col("u"), F.col("c"), F.col("total"), F.coalesce("known", F.lit(False)))
    return df.groupBy("path").agg(F.round(F.sum("b"), 4).alias("base"), F.round(F.sum(lifted), 4).alias("cached"))


CACHE = f"""WITH {S.tokens('documents', 'doc_id')}, {S.counts()}, {S.model()}, {ASKED}, based AS ({S.log_prob('asked', 'a.path, a.w')}),
    o AS (SELECT path, w, count(*) AS c FROM asked GROUP BY ALL), n AS (SELECT path, count(*) AS total FROM asked GROUP BY ALL),
    x AS (SELECT b.path, b.log_prob AS base_lp, o.c, n.total, u.w IS NOT NULL AS known, ln(coalesce(p1.p, 1e-9)) AS u FROM based b JOIN o ON o.path = b.path AND o.w = b.w JOIN n ON n.path = b.path LEFT JOIN uni u ON u.w = b.w LEFT JOIN p1 ON p1.w = b.w)
    SELECT path, round(sum(base_lp), 4) AS base, round(sum(CASE WHEN known AND c >= 2 THEN least(0, base_lp + least(0.15 * (ln(c / total) - u), 1.0)) ELSE base_lp END), 4) AS cached FROM x GROUP BY path"""


def packed_model(spark, sf_dir):
    """The benchmark's model, packed to 8 bits."""
    found = ngram.packed(model_of(spark, sf_dir, "benchmark"))
    return found.select("w2", "w1", "w", F.col("q").cast("long").alias("q"), F.col("rank").cast("long").alias("rank"))


PACKED = f"""WITH {S.tokens('benchmark', 'item_id')}, {S.counts()}, {S.model()},
    asked AS (SELECT NULL::VARCHAR AS w2, w1, w, 1 AS kind FROM bi WHERE w <> '<s>' UNION ALL SELECT w2, w1, w, 1 FROM tri WHERE w <> '<s>' UNION ALL SELECT NULL, NULL, w, 0 FROM voc),
    scored AS ({S.log_prob('asked', 'a.w2, a.w1, a.w, a.kind')}), lim AS (SELECT min(log_prob) AS lo, max(log_prob) AS hi FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY w2, w1 ORDER BY round(log_prob, 9) DESC, w) AS rank FROM scored WHERE kind = 1)
    SELECT w2, w1, w, greatest(0, least(255, floor(round((log_prob - lo) / (hi - lo) * 255, 6) + 0.5)))::BIGINT AS q, rank FROM ranked, lim WHERE rank <= 16"""


def packed_predictions(spark, sf_dir):
    """The five first words of the packed lists for the conversations' contexts; no list is mixed with another."""
    counts = model_of(spark, sf_dir, "benchmark")
    low, high = ngram.packed_range(counts)
    contexts = _asked(spark, sf_dir).select("w2", "w1").distinct()
    found = ngram.packed_predict(ngram.packed(counts), ngram.packed_uni(counts), low, high, contexts, 5)
    return found.select("w2", "w1", "w", F.round("log_prob", 5).alias("log_prob"), F.col("rank").cast("long").alias("rank"))


PACKED_PREDICT = f"""{PACKED.split('SELECT w2, w1, w, greatest')[0]}, quant AS (SELECT w2, w1, w, greatest(0, least(255, floor(round((log_prob - lo) / (hi - lo) * 255, 6) + 0.5))) AS q, rank FROM ranked, lim WHERE rank <= 16),
    ones AS (SELECT w, greatest(0, least(255, floor(round((log_prob - lo) / (hi - lo) * 255, 6) + 0.5))) AS q, row_number() OVER (ORDER BY round(log_prob, 9) DESC, w) AS rank FROM scored, lim WHERE kind = 0 AND w <> '<s>'),
    {ASKED.replace('asked AS (', 'asked2 AS (')}, ctx AS (SELECT DISTINCT w2, w1 FROM asked2),
    lists AS (SELECT c.w2, c.w1, q.w, q.q, q.rank, 0 AS choice FROM ctx c JOIN quant q ON q.w2 = c.w2 AND q.w1 = c.w1 UNION ALL SELECT c.w2, c.w1, q.w, q.q, q.rank, 1 FROM ctx c JOIN quant q ON q.w2 IS NULL AND q.w1 = c.w1
      UNION ALL SELECT c.w2, c.w1, o.w, o.q, o.rank, 2 FROM ctx c, ones o WHERE o.rank <= 6),
    best AS (SELECT *, min(choice) OVER (PARTITION BY w2, w1) AS least FROM lists), r AS (SELECT w2, w1, w, q, row_number() OVER (PARTITION BY w2, w1 ORDER BY rank) AS rank FROM best WHERE choice = least)
    SELECT w2, w1, w, round(lo + q / 255 * (hi - lo), 5) AS log_prob, rank FROM r, lim WHERE rank <= 5"""


def vocabulary_after_removal(spark, sf_dir):
    """Unigrams of documents once a third of these are out again: words that fall to zero stay in the vocabulary."""
    docs = _docs(spark, sf_dir)
    return ngram.merged(ngram.count(docs).uni, ngram.count(docs.where("doc_id % 3 = 0")).uni, -1, keep=True)


REMOVAL = f"WITH {S.tokens('documents', 'doc_id')} SELECT w, count(*) FILTER (id % 3 <> 0) AS c FROM words GROUP BY w"


def _pruned(name: str):
    def run(spark, sf_dir):
        # its words are read for every place in an n-gram
        text = staged(ngram.sentences(_docs(spark, sf_dir)).select(F.explode("sentences").alias("s")), "sentences")
        counts = ngram.from_sentences(text)
        return getattr(ngram.prune(ngram.Counts(staged(counts.uni, "uni"), counts.bi, counts.tri), 3, 2), name)

    return run


KEPT = f"WITH {S.tokens('documents', 'doc_id')}, {S.counts()}, kept AS MATERIALIZED (SELECT w FROM uni WHERE c >= 3 UNION ALL SELECT '<s>')"


def delta_merge(spark, sf_dir):
    """Bigrams of documents after the conversations came in and the benchmark's text went out."""
    old = ngram.count(_docs(spark, sf_dir)).bi
    return ngram.merged(ngram.merged(old, ngram.count(_talk(spark, sf_dir)).bi), ngram.count(table(spark, sf_dir, "benchmark")).bi, -1)


DELTA = f"""WITH {S.tokens('documents', 'doc_id')}, {S.counts()}, {ASKED}, {S.counts('q')}, {S.tokens('benchmark', 'item_id', 'k')}, {S.counts('k')},
    plus AS (SELECT w1, w, sum(c) AS c FROM (SELECT * FROM bi UNION ALL SELECT * FROM qbi) GROUP BY ALL)
    SELECT p.w1, p.w, (p.c - coalesce(k.c, 0))::BIGINT AS c FROM plus p LEFT JOIN kbi k ON k.w1 = p.w1 AND k.w = p.w WHERE p.c - coalesce(k.c, 0) > 0"""


def phrase_beams(spark, sf_dir):
    """Phrases of up to three words after each benchmark context, by beam search."""
    contexts = _contexts(spark, sf_dir).withColumn("query_id", F.concat_ws(" ", "w2", "w1"))
    found = ngram.beam_phrases(model_of(spark, sf_dir, "benchmark"), contexts, words=3)
    return found.where("rank <= 5").select("query_id", "phrase", "n", F.round("score", 6).alias("score"), "rank")


QUERIES = {
    "tokenize_words": tokenize_words,
    "tokenize_cased": tokenize_cased,
    "sentence_split": _split(False),
    "sentence_split_kernel": _split(True),
    "ngram_uni": _gram("uni"),
    "ngram_bi": _gram("bi"),
    "ngram_tri": _gram("tri"),
    "ngram_bi_kernel": _gram("bi", True),
    "continuation_counts": continuation_counts,
    "model_size": model_size,
    "corpus_document_frequency": corpus_document_frequency,
    "document_frequency_batch": document_frequency_batch,
    "unigram_lookup": unigram_lookup,
    "log_prob": _log_prob(False),
    "log_prob_continuation": _log_prob(True),
    "predict_next": predict_next,
    "mixture": mixture,
    "document_cache": document_cache,
    "packed_model": packed_model,
    "packed_predictions": packed_predictions,
    "vocabulary_after_removal": vocabulary_after_removal,
    "pruned_uni": _pruned("uni"),
    "pruned_bi": _pruned("bi"),
    "pruned_tri": _pruned("tri"),
    "delta_merge": delta_merge,
    "phrase_beams": phrase_beams,
}

SQL = {
    "tokenize_words": f"SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {S.text(L.WORD)}), lambda x: {S.norm('x')}), lambda x: x <> '') AS t FROM documents)",
    "tokenize_cased": f"SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[‘’]', '''', 'g'), {S.text(L.CASED)}) AS t FROM documents)",
    "sentence_split": _split_sql(False),
    "sentence_split_kernel": _split_sql(True),
    "ngram_uni": _gram_sql("w", "uni"),
    "ngram_bi": _gram_sql("w1, w", "bi"),
    "ngram_tri": _gram_sql("w2, w1, w", "tri"),
    "ngram_bi_kernel": _gram_sql("w1, w", "bi", True),
    "continuation_counts": f"WITH {S.tokens('documents', 'doc_id')}, {S.counts()} SELECT w, count(*) AS cont FROM bi GROUP BY w",
    "model_size": f"WITH {S.tokens('documents', 'doc_id')}, {S.counts()} SELECT (SELECT count(*) + 1 FROM uni) AS vocab, (SELECT count(*) FROM bi) AS bigrams, (SELECT count(*) FROM tri) AS trigrams",
    "corpus_document_frequency": f"WITH {S.tokens('documents', 'doc_id')} SELECT w, count(DISTINCT id) AS df FROM words GROUP BY w",
    "document_frequency_batch": f"WITH {S.tokens('documents', 'doc_id')}, {S.tokens('benchmark', 'item_id', 'q')} SELECT w, (SELECT count(DISTINCT id) FROM words x WHERE x.w = q.w) AS df FROM (SELECT DISTINCT w FROM qwords) q",
    "unigram_lookup": f"WITH {S.tokens('documents', 'doc_id')}, {S.tokens('benchmark', 'item_id', 'q')} SELECT q.w, count(x.w) AS c FROM (SELECT DISTINCT w FROM qwords) q LEFT JOIN words x ON x.w = q.w GROUP BY q.w",
    "log_prob": _log_prob_sql(False),
    "log_prob_continuation": _log_prob_sql(True),
    "predict_next": PREDICT,
    "mixture": MIXTURE,
    "document_cache": CACHE,
    "packed_model": PACKED,
    "packed_predictions": PACKED_PREDICT,
    "vocabulary_after_removal": REMOVAL,
    "pruned_uni": f"{KEPT} SELECT w, c FROM uni WHERE c >= 3",
    "pruned_bi": f"{KEPT} SELECT w1, bi.w, c FROM bi JOIN kept a ON a.w = w1 JOIN kept b ON b.w = bi.w WHERE c >= 2",
    "pruned_tri": f"{KEPT} SELECT w2, w1, tri.w, c FROM tri JOIN kept a ON a.w = w2 JOIN kept b ON b.w = w1 JOIN kept d ON d.w = tri.w WHERE c >= 2",
    "delta_merge": DELTA,
}
