"""Queries over vectors, related sections and engagement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.operators import engagement as E
from corpusloom.operators import vectors as V
from corpusloom.queries import sql as S
from corpusloom.queries.language import table
from corpusloom.session import staged


def _tf(spark, sf_dir):
    return V.term_frequency(table(spark, sf_dir, "documents"), "doc_id")


TERMS = f"list_filter(list_transform(regexp_extract_all(text, {S.text(L.TERM)}), lambda x: regexp_replace(lower(x), '^[''-]+|[''-]+$', '', 'g')), lambda x: length(x) >= 3 AND x NOT IN {S.words(L.STOP_WORDS)})"
TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL)"
WEIGHTS = f"""{TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), nd AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
    qtf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
    w AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), nd),
    weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w),
    qw AS (SELECT item_id, term, tf * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM qtf LEFT JOIN df USING (term), nd),
    qweights AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM qw)"""


def _weights(spark, sf_dir, only=None):
    """Weights of documents, or of those whose id is in only(doc_id), and of benchmark items; frequencies are those of all documents."""
    tf = staged(_tf(spark, sf_dir), "tf")
    df, n = staged(V.chunk_frequency(tf), "df"), tf.agg(F.countDistinct("doc_id").alias("n"))
    asked = V.term_frequency(table(spark, sf_dir, "benchmark"), "item_id")
    own = tf if only is None else tf.join(only, "doc_id", "left_semi")
    return V.tfidf(own, df, n, "doc_id"), V.tfidf(asked, df, n, "item_id")


def _terms(spark, sf_dir, vectors):
    """(doc_id, terms): the weights of the documents that have a vector."""
    own = _weights(spark, sf_dir, vectors.select(F.col("vec_id").alias("doc_id")))[0]
    return own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("terms"))


def tfidf(spark, sf_dir):
    return _weights(spark, sf_dir)[0].select("doc_id", "term", F.round("weight", 6).alias("weight"))


def sparse_cosine(spark, sf_dir):
    docs, asked = _weights(spark, sf_dir)
    return V.sparse_cosine(asked, docs, "item_id", "doc_id").select("item_id", "doc_id", F.round("cosine", 6).alias("cosine"))


def sparse_nearest(spark, sf_dir):
    """The five documents whose words are most like those of each benchmark item."""
    docs, asked = _weights(spark, sf_dir)
    return V.sparse_nearest(asked, docs, "item_id", "doc_id", 5).select("item_id", "doc_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def nearest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = V.nearest(v.where("vec_id % 100 = 0"), v, 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 5).alias("cosine"), F.col("rank").cast("long").alias("rank"))


NEAREST = """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(c, 5) AS cosine, rank FROM r WHERE rank <= 10"""

LONG = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)"


def centred(spark, sf_dir):
    """Each vector less the mean, at unit length: two numbers of it."""
    c = V.centred(_vectors(spark, sf_dir), "vec_id", "embedding")
    return c.select("vec_id", F.round(F.element_at("cen", 1), 5).alias("first"), F.round(F.array_max("cen"), 5).alias("most"))


CENTRED = f"""WITH {LONG}, m AS (SELECT d, avg(v) AS m FROM x GROUP BY d), c AS (SELECT vec_id, d, v - m AS c FROM x JOIN m USING (d)),
u AS (SELECT vec_id, d, c / sqrt(sum(c * c) OVER (PARTITION BY vec_id)) AS c FROM c)
SELECT vec_id, round(max(CASE WHEN d = 1 THEN c END), 5) AS first, round(max(c), 5) AS most FROM u GROUP BY vec_id"""


def group_vectors(spark, sf_dir):
    g = V.group_vectors(_vectors(spark, sf_dir), "label", "embedding").select("label", F.posexplode("vec").alias("d", "x"))
    return g.select("label", (F.col("d") + 1).cast("long").alias("d"), F.round("x", 6).alias("x"))


GROUPS = f"""WITH {LONG}, s AS (SELECT label, d, sum(v) AS s FROM x GROUP BY ALL)
SELECT label, d::BIGINT AS d, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS x FROM s"""


def background_floors(spark, sf_dir):
    v = V.with_unit(_vectors(spark, sf_dir), "u", F.col("embedding").cast("array<double>")).select("vec_id", "u")
    return V.floors(V.background(v, "vec_id", "u")).select("sensitivity", F.round("floor", 6).alias("floor"))


FLOORS = """WITH o AS (SELECT embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS k FROM embeddings), a AS (SELECT * FROM o WHERE k < 8000),
s AS (SELECT list_cosine_similarity(x.e, y.e) AS s FROM a x JOIN a y ON y.k = x.k + 1 WHERE x.k % 2 = 0), r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS n FROM s),
l(sensitivity, p) AS (VALUES (1, 0.99::DOUBLE), (2, 0.98), (3, 0.96), (4, 0.93), (5, 0.9))
SELECT sensitivity, round(s, 6) AS floor FROM l JOIN r ON r.k = least(n - 1, floor(round(p * n, 9)))"""


def related_sections(spark, sf_dir):
    """Sections (vectors with the words of the document of their id) related to every hundredth one.

    The id's remainder by 20 is the note and that by 7 the heading.
    """
    v = _vectors(spark, sf_dir)
    cen = V.centred(v, "vec_id", "embedding")
    parts = V.principal_components(cen, "vec_id", "cen")
    cen = staged(V.without_components(cen, "cen", parts).select("vec_id", "cen"), "related-cen")
    levels = {r[0]: r[1] for r in V.floors(V.background(cen, "vec_id", "cen")).collect()}
    weights = _terms(spark, sf_dir, v)
    sections = v.select("vec_id", "label").join(cen, "vec_id").join(weights, F.col("vec_id") == F.col("doc_id"))
    sections = sections.select((F.col("vec_id") % 20).alias("path"), (F.col("vec_id") % 7).cast("string").alias("heading"), F.col("vec_id").alias("sec_id"), "cen", "terms")
    sections = staged(sections, "related-sections")
    asked = sections.where("sec_id % 100 = 0").select(F.col("sec_id").alias("query_id"), F.col("path").alias("q_path"), F.col("cen").alias("q_cen"), F.col("terms").alias("q_terms"))
    found = V.related(asked, sections, levels[5], levels[1], 12)
    return found.select("query_id", "rank", "path", "sec_id", F.round("score", 6).alias("score"), F.round("keyword", 6).alias("keyword"))


def suggested_links(spark, sf_dir):
    """The twelve sections to link each hundredth one to: vectors with the words of the document of their id, notes and headings by remainders."""
    v = _vectors(spark, sf_dir)
    cen = staged(V.centred(v, "vec_id", "embedding"), "links-cen")
    levels = {r[0]: r[1] for r in V.floors(V.background(cen, "vec_id", "cen")).collect()}
    weights = _terms(spark, sf_dir, v)
    sections = cen.join(weights, F.col("vec_id") == F.col("doc_id")).select((F.col("vec_id") % 20).alias("path"), (F.col("vec_id") % 7).cast("string").alias("heading"), F.col("vec_id").alias("sec_id"), "cen", "terms")
    sections = staged(sections, "links-sections")
    asked = sections.where("sec_id % 100 = 0").select(F.col("sec_id").alias("query_id"), F.col("path").alias("q_path"), F.col("cen").alias("q_cen"), F.col("terms").alias("q_terms"))
    found = V.suggest_links(asked, sections, levels)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "path", "sec_id", F.round("score", 6).alias("score"))


# there are 20 notes, fewer than a shortlist holds, so all sections are looked at
LINKS = f"""WITH {WEIGHTS}, {LONG}, m AS (SELECT d, avg(v) AS m FROM x GROUP BY d), c AS (SELECT vec_id, d, v - m AS c FROM x JOIN m USING (d)),
u AS (SELECT vec_id, list(c ORDER BY d) AS e FROM (SELECT vec_id, d, c / sqrt(sum(c * c) OVER (PARTITION BY vec_id)) AS c FROM c) GROUP BY vec_id),
o AS (SELECT e, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS k FROM u), b AS (SELECT * FROM o WHERE k < 8000),
sims AS (SELECT list_dot_product(p.e, q.e) AS s FROM b p JOIN b q ON q.k = p.k + 1 WHERE p.k % 2 = 0), rs AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS n FROM sims),
bar AS (SELECT s AS bar FROM rs WHERE k = least(n - 1, floor(round({L.PERCENTILES[3]}::DOUBLE * n, 9)))),
sec AS (SELECT vec_id AS sec_id, vec_id % 20 AS path, vec_id % 7 AS heading, e FROM u WHERE vec_id IN (SELECT doc_id FROM weights)),
sem AS (SELECT q.sec_id AS query_id, s.sec_id, s.path, s.heading, list_dot_product(q.e, s.e) AS sem FROM sec q JOIN sec s ON s.path <> q.path, bar WHERE q.sec_id % 100 = 0 AND list_dot_product(q.e, s.e) >= bar),
kw AS (SELECT p.query_id, p.sec_id, sum(a.weight * b.weight) AS kw FROM sem p JOIN weights a ON a.doc_id = p.query_id JOIN weights b ON b.doc_id = p.sec_id AND b.term = a.term GROUP BY ALL),
f AS (SELECT p.*, {L.SEMANTIC_WEIGHT} * sem + {L.KEYWORD_WEIGHT} * coalesce(kw, 0) AS score FROM sem p LEFT JOIN kw ON kw.query_id = p.query_id AND kw.sec_id = p.sec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, path, heading ORDER BY round(score, 9) DESC, sec_id) AS r FROM f), n AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY query_id, path ORDER BY round(score, 9) DESC, sec_id) AS r FROM h WHERE r = 1),
z AS (SELECT query_id, path, sec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, sec_id) AS rank FROM n WHERE r <= 2)
SELECT query_id, rank, path, sec_id, round(score, 6) AS score FROM z WHERE rank <= 12"""


def streaks(spark, sf_dir):
    return E.streaks(E.saved(table(spark, sf_dir, "events")))


STREAKS = """WITH d AS (SELECT user_id, ts::DATE AS day, sum(floor(value)::BIGINT) AS saved FROM events WHERE floor(value) > 0 GROUP BY ALL),
i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM d),
l AS (SELECT user_id, island, count(*) AS n, max(day) AS last, arg_max(saved, day) AS today, sum(saved) AS s FROM i GROUP BY ALL)
SELECT user_id, max(last) AS last_day, arg_max(n, last) AS streak, max(n) AS best_streak, arg_max(today, last)::BIGINT AS today_saved, sum(s)::BIGINT AS total_saved, round(sum(s) / 200, 4) AS minutes FROM l GROUP BY user_id"""


def milestones(spark, sf_dir):
    return E.milestones(E.saved(table(spark, sf_dir, "events")))


MILESTONES = f"""WITH r AS (SELECT user_id, event_id, floor(value)::BIGINT AS saved, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events WHERE floor(value) > 0),
m AS (SELECT unnest({list(L.MILESTONES)})::BIGINT AS milestone) SELECT user_id, milestone, event_id FROM r JOIN m ON total >= milestone AND total - saved < milestone"""


def counters(spark, sf_dir):
    return E.counters(table(spark, sf_dir, "events"))


COUNTERS = """SELECT user_id, count(*) FILTER (event_type = 'click') AS accepts, count(*) FILTER (event_type = 'purchase') AS corrections, count(*) FILTER (event_type = 'error') AS reverts,
sum(greatest(0, floor(value)))::BIGINT AS chars_saved FROM events GROUP BY user_id"""


def stats_snapshot(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return E.snapshot(E.saved(ev), ev).select("user_id", "streak", "best_streak", "total_saved", "accepts", "corrections", "reverts", "next_milestone")


SNAPSHOT = f"""WITH s AS ({STREAKS}), c AS ({COUNTERS})
SELECT c.user_id, streak, best_streak, total_saved, accepts, corrections, reverts, (SELECT min(m) FROM (SELECT unnest({list(L.MILESTONES)})::BIGINT AS m) WHERE m > coalesce(total_saved, 0)) AS next_milestone FROM c LEFT JOIN s ON s.user_id = c.user_id"""


def latest_answers(spark, sf_dir):
    """The latest event of each user and type: older answers are dropped."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("value"))


LATEST = "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


def case_discount(spark, sf_dir):
    """Spellings of one word share its weight: the first has it in full, the others 0.45 of it."""
    t = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(F.lower("form")).orderBy(F.desc("n"), "form"))
    return t.select("form", "n", F.round(F.col("n") * F.when(rank == 1, 1.0).otherwise(0.45), 4).alias("weight"))


DISCOUNT = "WITH t AS (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS form FROM documents) GROUP BY form) SELECT form, n, round(n * CASE WHEN row_number() OVER (PARTITION BY lower(form) ORDER BY n DESC, form) = 1 THEN 1.0::DOUBLE ELSE 0.45 END, 4) AS weight FROM t"


QUERIES = {
    "term_frequency": _tf,
    "chunk_frequency": lambda spark, sf_dir: V.chunk_frequency(_tf(spark, sf_dir)),
    "tfidf": tfidf,
    "sparse_cosine": sparse_cosine,
    "sparse_nearest": sparse_nearest,
    "nearest": nearest,
    "centred": centred,
    "group_vectors": group_vectors,
    "background_floors": background_floors,
    "related_sections": related_sections,
    "suggested_links": suggested_links,
    "streaks": streaks,
    "milestones": milestones,
    "counters": counters,
    "stats_snapshot": stats_snapshot,
    "latest_answers": latest_answers,
    "case_discount": case_discount,
}

SQL = {
    "term_frequency": f"WITH {TF} SELECT * FROM tf",
    "chunk_frequency": f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "tfidf": f"WITH {WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
    "sparse_cosine": f"WITH {WEIGHTS} SELECT item_id, doc_id, round(sum(a.weight * b.weight), 6) AS cosine FROM qweights a JOIN weights b USING (term) GROUP BY ALL",
    "sparse_nearest": f"WITH {WEIGHTS}, p AS (SELECT item_id, doc_id, sum(a.weight * b.weight) AS c FROM qweights a JOIN weights b USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(c, 9) DESC, doc_id) AS rank FROM p) SELECT item_id, doc_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 5",
    "nearest": NEAREST,
    "centred": CENTRED,
    "group_vectors": GROUPS,
    "background_floors": FLOORS,
    "suggested_links": LINKS,
    "streaks": STREAKS,
    "milestones": MILESTONES,
    "counters": COUNTERS,
    "stats_snapshot": SNAPSHOT,
    "latest_answers": LATEST,
    "case_discount": DISCOUNT,
}
