"""Queries over sections, titles, links, tags, dictionaries and currency."""

from __future__ import annotations

import pandas as pd

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import currency as C
from corpusloom.functions import markup as M
from corpusloom.functions import text as X
from corpusloom.operators import intervals
from corpusloom.operators import links as K
from corpusloom.operators import ngram
from corpusloom.operators import vectors as V
from corpusloom.queries import sql as S
from corpusloom.queries.language import table
from corpusloom.queries.retrieval import TF
from corpusloom.session import staged


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def note_sections(spark, sf_dir):
    return K.sections(_docs(spark, sf_dir), "doc_id").select("doc_id", F.col("from").alias("begin"), F.col("to").alias("stop"), "kind", X.segment_key("text").alias("seg_key"))


def _titles(spark, sf_dir):
    """Titles of notes: the first three tokens of each benchmark item and each source's name."""
    first = F.array_join(F.slice(X.tokenize_words("text"), 1, 3), " ")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), first.alias("title"))
    more = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100_000).alias("id"), F.initcap(F.element_at(X.tokenize_words("text"), 4)).alias("title"))
    return items.unionByName(more).where("title is not null")


def title_index(spark, sf_dir):
    return K.titles(_titles(spark, sf_dir), "id", "title").select("phrase", "target")


def alias_index(spark, sf_dir):
    """Benchmark items as notes: the first three tokens are the title, the fifth and sixth an alias and the seventh another."""
    words = X.tokenize_words("text")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words, 1, 3), " ").alias("title"), F.array(F.array_join(F.slice(words, 5, 2), " "), F.initcap(F.get(words, F.lit(6)))).alias("aliases"))
    return K.titles(rows, "item_id", "title", "aliases")


_TOKS = S.text(r"[A-Za-z][A-Za-z'’.-]*[A-Za-z]|[A-Za-z]")
TITLES = f"""tt AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, {_TOKS}), lambda x: {S.norm('x')}), lambda x: x <> '') AS ts FROM benchmark),
    titles AS (SELECT item_id AS id, array_to_string(ts[1:3], ' ') AS title FROM tt UNION ALL SELECT item_id + 100000, upper(ts[4][1]) || lower(substr(ts[4], 2)) FROM tt WHERE len(ts) >= 4),
    idx AS (SELECT lower(title) AS phrase, arg_min(title, id) AS target FROM titles WHERE length(title) >= 3 AND NOT regexp_full_match(title, '[0-9]+([.\\-/][0-9]+)*') GROUP BY 1)"""


ALIASES = f"""WITH {TITLES.split(",\n    titles AS")[0]}, n AS (SELECT item_id, 0 AS place, array_to_string(ts[1:3], ' ') AS target, array_to_string(ts[1:3], ' ') AS display FROM tt
    UNION ALL SELECT item_id, 1, array_to_string(ts[1:3], ' '), array_to_string(ts[5:6], ' ') FROM tt UNION ALL SELECT item_id, 2, array_to_string(ts[1:3], ' '), upper(ts[7][1]) || lower(substr(ts[7], 2)) FROM tt),
    r AS (SELECT lower(display) AS phrase, target, display, row_number() OVER (PARTITION BY lower(display) ORDER BY item_id, place, target) AS r FROM n WHERE length(display) >= 3 AND NOT (place = 0 AND regexp_full_match(display, '[0-9]+([.\\-/][0-9]+)*')))
    SELECT phrase, target, display FROM r WHERE r = 1"""


def search_titles(spark, sf_dir):
    asked = spark.createDataFrame([("th",), ("on",), ("E",), ("qu",)], "query string")
    found = K.search_titles(title_index(spark, sf_dir), asked, 10)
    return found.select("query", "target", F.col("rank").cast("long").alias("rank"))


SEARCH = f"""WITH {TITLES}, q(query) AS (VALUES ('th'), ('on'), ('E'), ('qu')), p AS (SELECT DISTINCT query, target FROM q JOIN idx ON contains(phrase, lower(query))),
r AS (SELECT query, target, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN starts_with(lower(target), lower(query)) THEN 0 ELSE 1 END, lower(target), target) AS rank FROM p) SELECT * FROM r WHERE rank <= 10"""


def span_choice(spark, sf_dir):
    """Of pairs of words that begin with a vowel, the leftmost longest ones clear of the ten characters from each word with an s."""
    rows = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "tok"))
    order = Window.partitionBy("doc_id").orderBy("k")
    low = F.sum(F.length("tok") + 1).over(order) - F.length("tok") - 1
    own = rows.select("doc_id", "tok", low.alias("from"), F.lead("tok").over(order).alias("next"))
    end = F.col("from") + F.length("tok")
    pairs = own.where(F.col("tok").rlike("^[aeiou]")).select("doc_id", "from", (end + F.coalesce(F.length("next") + 1, F.lit(0))).alias("to"))
    kept_off = own.where(F.col("tok").startswith("s")).select("doc_id", "from", (F.col("from") + 10).alias("to"))
    found = intervals.chosen(intervals.clear(pairs, kept_off, "doc_id"), "doc_id")
    return found.select("doc_id", F.col("from").alias("begin"), F.col("to").alias("stop"))


SPANS = """WITH RECURSIVE t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents),
    o AS (SELECT doc_id, tok, (sum(length(tok) + 1) OVER w - length(tok) - 1)::BIGINT AS lo, lead(tok) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT doc_id, lo, lo + length(tok) + coalesce(length(nxt) + 1, 0) AS hi FROM o WHERE regexp_matches(tok, '^[aeiou]')), b AS (SELECT doc_id, lo, lo + 10 AS hi FROM o WHERE starts_with(tok, 's')),
    c AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND a.lo < b.hi AND b.lo < a.hi)),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lo, hi DESC) AS n FROM c),
    w AS (SELECT doc_id, n, lo, hi, hi AS fin, true AS took FROM n WHERE n = 1 UNION ALL SELECT n.doc_id, n.n, n.lo, n.hi, CASE WHEN n.lo >= w.fin THEN n.hi ELSE w.fin END, n.lo >= w.fin FROM w JOIN n ON n.doc_id = w.doc_id AND n.n = w.n + 1)
    SELECT doc_id, lo AS begin, hi AS stop FROM w WHERE took"""


def note_links(spark, sf_dir):
    found = K.links(_docs(spark, sf_dir), title_index(spark, sf_dir), "doc_id")
    return found.select("doc_id", F.col("from").alias("begin"), F.col("to").alias("stop"), "target")


def _tags(spark, sf_dir):
    """Tags of documents: a frequent term, and the language with a term as a leaf."""
    tf = staged(V.term_frequency(_docs(spark, sf_dir), "doc_id"), "tag-terms")
    tops = tf.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term"))).where("r <= 2")
    leaf = tops.join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id").where("r = 2").select("doc_id", F.concat_ws("/", "lang", "term").alias("tag"))
    return tf, staged(tops.where("r = 1").select("doc_id", F.col("term").alias("tag")).unionByName(leaf), "tags-applied")


TAGS = f"""{TF}, tops AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r FROM tf),
    tags AS (SELECT doc_id, term AS tag FROM tops WHERE r = 1 UNION ALL SELECT doc_id, lang || '/' || term FROM tops JOIN documents USING (doc_id) WHERE r = 2),
    counts AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag)"""


def tag_counts(spark, sf_dir):
    return K.tag_counts(_tags(spark, sf_dir)[1])


def suggest_tags(spark, sf_dir):
    tf, tags = _tags(spark, sf_dir)
    found = K.suggest_tags(tf, K.raw_counts(_docs(spark, sf_dir), "doc_id"), K.tag_counts(tags), tags, "doc_id")
    return found.select("doc_id", "tag", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SUGGEST = f"""WITH {TAGS}, keys AS (SELECT tag, n, tag AS term FROM counts UNION ALL SELECT tag, n, string_split(tag, '/')[-1] FROM counts),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]{{2,}}')) AS term FROM documents), every AS (SELECT doc_id, term, tf FROM tf UNION ALL SELECT doc_id, term, count(*) FROM w GROUP BY ALL),
h AS (SELECT doc_id, tag, n, sum(tf) AS hits FROM every JOIN keys USING (term) GROUP BY ALL), s AS (SELECT doc_id, tag, hits * ln(n + 1) AS score FROM h WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.doc_id = h.doc_id AND t.tag = h.tag)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, tag) AS rank FROM s) SELECT doc_id, tag, round(score, 6) AS score, rank FROM r WHERE rank <= 8"""


def new_tags(spark, sf_dir):
    tf, tags = _tags(spark, sf_dir)
    return K.new_tags(tf, K.tag_counts(tags), "doc_id").select("doc_id", "term", "tf", F.col("rank").cast("long").alias("rank"))


NEW = f"""WITH {TAGS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank FROM tf WHERE tf >= 2 AND length(term) >= 4 AND term NOT IN (SELECT tag FROM counts))
SELECT doc_id, term, tf, rank FROM f WHERE rank <= 3"""


def tag_changes(spark, sf_dir):
    """Tags that an edit adds and removes: the two most frequent terms before, the second and third after."""
    tf = V.term_frequency(_docs(spark, sf_dir), "doc_id")
    ranked = tf.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term"))).where("r <= 3")
    sets = ranked.groupBy("doc_id").agg(F.collect_list(F.when(F.col("r") <= 2, F.col("term"))).alias("before"), F.collect_list(F.when(F.col("r") >= 2, F.col("term"))).alias("after"))
    added, removed = K.tag_diff("before", "after")
    return sets.select("doc_id", F.array_join(added, " ").alias("added"), F.array_join(removed, " ").alias("removed"))


CHANGES = f"""WITH {TF}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r FROM tf)
SELECT doc_id, coalesce(string_agg(term, ' ') FILTER (r = 3), '') AS added, coalesce(string_agg(term, ' ') FILTER (r = 1), '') AS removed FROM t WHERE r <= 3 GROUP BY doc_id"""


def dictionary_kept(spark, sf_dir):
    """Benchmark words as a dictionary, held against the conversations' vocabulary and the documents' frequencies."""
    words = ngram.count(table(spark, sf_dir, "benchmark")).uni.select("w")
    return K.dictionary_kept(words, ngram.count(table(spark, sf_dir, "conversations")).uni.select("w"), ngram.document_frequency(_docs(spark, sf_dir)))


DICTIONARY = f"""WITH {S.tokens('documents', 'doc_id', 'd')}, {S.tokens('benchmark', 'item_id', 'q')}, {S.tokens('conversations', 'conv_id', 'c')}
SELECT DISTINCT w FROM qwords WHERE w NOT IN (SELECT w FROM cwords) AND w IN (SELECT w FROM dwords)"""


def tag_popup(spark, sf_dir):
    """What is offered once a tag's first letter, that of the note's language, is typed."""
    tf, tags = _tags(spark, sf_dir)
    asked = _docs(spark, sf_dir).select("doc_id", F.substring("lang", 1, 1).alias("query")).where("query is not null")
    rarity = staged(ngram.document_frequency(_docs(spark, sf_dir)).select("w", (1 / F.sqrt("df")).alias("rarity")), "rarity")
    found = K.tag_popup(tf, K.tag_counts(tags), tags, rarity, asked, "doc_id")
    return found.select("doc_id", "tag", "is_new", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


POPUP = f"""WITH {TAGS}, {S.tokens('documents', 'doc_id')}, rar AS (SELECT w, 1 / sqrt(count(DISTINCT id)) AS rarity FROM words GROUP BY w),
asked AS (SELECT doc_id, left(lang, 1) AS q FROM documents WHERE lang IS NOT NULL),
named AS (SELECT tag, n, string_split(tag, '/')[-1] AS leaf FROM counts WHERE regexp_full_match(tag, '[\\p{{L}}\\p{{N}}_/-]+') AND regexp_matches(tag, '[^\\p{{N}}/_-]')), nr AS (SELECT named.*, coalesce(rarity, 0.5) AS rarity FROM named LEFT JOIN rar ON rar.w = leaf),
k AS (SELECT a.doc_id, nr.tag, CASE WHEN starts_with(tag, q) OR starts_with(leaf, q) THEN 2 ELSE 1 END * (0.5 + coalesce(t1.tf, 0) + coalesce(t2.tf, 0)) * rarity * ln(n + 2) AS score
    FROM asked a JOIN nr ON contains(tag, q) OR contains(leaf, q) LEFT JOIN tf t1 ON t1.doc_id = a.doc_id AND t1.term = nr.tag LEFT JOIN tf t2 ON t2.doc_id = a.doc_id AND t2.term = nr.leaf
    WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.doc_id = a.doc_id AND t.tag = nr.tag)),
kr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, tag) AS rank FROM k), known AS (SELECT * FROM kr WHERE rank <= 5),
f AS (SELECT a.doc_id, term AS tag, tf * coalesce(rarity, 0.5) * CASE WHEN starts_with(term, q) THEN 1.4 ELSE 1 END * 0.8 AS score FROM asked a JOIN tf ON tf.doc_id = a.doc_id LEFT JOIN rar ON rar.w = term
    WHERE contains(term, q) AND length(term) >= 4 AND coalesce(rarity, 0.5) >= 0.4 AND regexp_full_match(term, '[\\p{{L}}\\p{{N}}_/-]+') AND regexp_matches(term, '[^\\p{{N}}/_-]') AND term NOT IN (SELECT tag FROM counts)),
fr AS (SELECT f.*, coalesce(s.n, 0) AS shown, row_number() OVER (PARTITION BY f.doc_id ORDER BY round(score, 9) DESC, tag) AS r FROM f LEFT JOIN (SELECT doc_id, count(*) AS n FROM known GROUP BY ALL) s ON s.doc_id = f.doc_id)
SELECT doc_id, tag, false AS is_new, round(score, 6) AS score, rank FROM known UNION ALL SELECT doc_id, tag, true, round(score, 6), r + shown FROM fr WHERE r <= greatest(3, 8 - shown)"""


def picker_list(spark, sf_dir):
    """Notes to link each benchmark item to: documents whose second language tag matches, then the newest of all."""
    notes = table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), "doc_id").alias("path"), F.concat(F.lit("N"), (F.col("doc_id") % 700).cast("string")).alias("target"), F.col("n_chars").alias("mtime"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("n"), "item_id").alias("path"))
    near = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).withColumn("target", F.concat(F.lit("n"), ((F.col("query_id") * 7 + F.col("rank")) % 700).cast("string")))
    found = K.picker(near, notes, asked, 50)
    return found.select("query_id", "target", "related", F.col("rank").cast("long").alias("rank"))


PICKER = """WITH notes AS (SELECT 'n' || doc_id AS path, 'N' || doc_id % 700 AS target, n_chars AS mtime FROM documents), asked AS (SELECT item_id AS query_id, 'n' || item_id AS path FROM benchmark),
rec AS (SELECT query_id, rank, 'n' || (query_id * 7 + rank) % 700 AS target FROM asked, (SELECT unnest([1, 2, 3]) AS rank)), first AS (SELECT query_id, lower(target) AS low, arg_min(target, rank) AS target, min(rank) AS rank FROM rec GROUP BY ALL),
age AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, path) AS age FROM notes), rest AS (SELECT a.query_id, lower(target) AS low, arg_min(target, age) AS target, min(age) AS age FROM asked a JOIN age n ON n.path <> a.path
    WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.query_id = a.query_id AND f.low = lower(n.target)) GROUP BY ALL),
every AS (SELECT query_id, target, true AS related, rank AS pos FROM first UNION ALL SELECT query_id, target, false, age FROM rest),
r AS (SELECT query_id, target, related, row_number() OVER (PARTITION BY query_id ORDER BY related DESC, pos, target) AS rank FROM every) SELECT * FROM r WHERE related OR rank <= 50"""


def dictionary_listing(spark, sf_dir):
    forms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()
    return K.listed(forms.withColumn("added", F.length("w") % 3 == 0)).withColumn("rank", F.col("rank").cast("long"))


LISTING = "SELECT w, length(w) % 3 = 0 AS added, row_number() OVER (ORDER BY length(w) % 3 = 0 DESC, lower(w), w) AS rank FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)"


def pinned_forms(spark, sf_dir):
    """Raw tokens that a dictionary of the benchmark's spellings pins to one form."""
    forms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()
    tokens = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).distinct()
    return K.pinned(tokens, forms)


PINNED = """WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark), t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents),
o AS (SELECT lower(w) AS low, count(*) AS n, min(w) AS sole, list(w) AS forms FROM d GROUP BY 1),
p AS (SELECT token, CASE WHEN list_contains(forms, token) THEN token WHEN list_contains(forms, upper(token[1]) || substr(token, 2)) THEN upper(token[1]) || substr(token, 2) WHEN list_contains(forms, upper(token)) THEN upper(token) WHEN n = 1 THEN sole END AS pinned FROM t JOIN o ON o.low = lower(token))
SELECT token, pinned FROM p WHERE pinned IS NOT NULL"""


def currency_amounts(spark, sf_dir):
    """Document lengths as amounts with currency words, formatted in three styles."""
    words = F.array(*(F.lit(w) for w in ("dollars", "euro", "zloty", "yen", "kr")))

    before = F.concat(F.lit("for "), F.col("n_chars").cast("string"), F.lit(".5 "), F.element_at(words, (F.col("doc_id") % 5 + 1).cast("int")))
    df = table(spark, sf_dir, "documents").select("doc_id", before.alias("before"))
    return df.select("doc_id", "before", *(F.coalesce(C.detected(F.col("before"), own)["text"], F.col("before")).alias(name) for name, own in (("comma", C.style("comma")), ("code", C.style("comma", use_code=True)))))


AMOUNTS = """WITH a AS (SELECT doc_id, 'for ' || n_chars || '.5 ' || ['dollars', 'euro', 'zloty', 'yen', 'kr'][doc_id % 5 + 1] AS before, format('{:,}', n_chars) || '.50' AS n, doc_id % 5 AS k FROM documents)
SELECT doc_id, before, CASE k WHEN 0 THEN '$' || n WHEN 1 THEN '€' || n WHEN 2 THEN n || ' zł' WHEN 3 THEN '¥' || n ELSE before END AS comma,
CASE k WHEN 0 THEN n || ' USD' WHEN 1 THEN n || ' EUR' WHEN 2 THEN n || ' PLN' WHEN 3 THEN n || ' JPY' ELSE before END AS code FROM a"""


@F.pandas_udf(T.StringType())
def _anchors(text: pd.Series, words: pd.Series) -> pd.Series:
    out = []
    for t, w in zip(text, words):
        found = M.anchor_span(t or "", set(w))
        out.append(t[found[0] : found[1]] if found else None)
    return pd.Series(out, dtype="object")


def anchor_spans(spark, sf_dir):
    """Where a document would link to the benchmark item that shares most of its terms."""
    tf = V.term_frequency(_docs(spark, sf_dir), "doc_id")
    items = V.term_frequency(table(spark, sf_dir, "benchmark"), "item_id")
    shared = tf.join(items.select("item_id", "term"), "term").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))
    best = shared.groupBy("doc_id").agg(F.max_by("item_id", F.struct("n", -F.col("item_id"))).alias("item_id"))
    words = items.groupBy("item_id").agg(F.collect_set("term").alias("words"))
    df = best.join(words, "item_id").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return df.select("doc_id", "item_id", _anchors("text", "words").alias("anchor"))


ANCHORS = f"""WITH {TF}, {TF.replace('documents', 'benchmark').replace('doc_id', 'item_id').replace('tf AS (', 'itf AS (')},
n AS (SELECT doc_id, item_id, count(*) AS n FROM tf JOIN itf USING (term) GROUP BY ALL), best AS (SELECT doc_id, arg_max(item_id, (n, -item_id)) AS item_id FROM n GROUP BY doc_id),
p AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*|[^A-Za-z]+') AS parts FROM documents), t AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM p),
w AS (SELECT t.doc_id, part, pos, row_number() OVER (PARTITION BY t.doc_id ORDER BY pos) AS k FROM t WHERE regexp_matches(part, '^[A-Za-z]')),
s AS (SELECT w.*, k - row_number() OVER (PARTITION BY w.doc_id ORDER BY k) AS island FROM w JOIN best b ON b.doc_id = w.doc_id JOIN itf ON itf.item_id = b.item_id AND itf.term = lower(w.part)),
r AS (SELECT doc_id, island, count(*) AS n, min(pos) AS low, max(pos) AS high FROM s GROUP BY ALL HAVING count(*) > 1 OR max(length(part)) >= 4),
one AS (SELECT doc_id, arg_max(struct_pack(low := low, high := high), (n, -low)) AS x FROM r GROUP BY doc_id),
a AS (SELECT t.doc_id, string_agg(part, '' ORDER BY pos) AS anchor FROM t JOIN one ON one.doc_id = t.doc_id AND pos BETWEEN x.low AND x.high GROUP BY t.doc_id)
SELECT b.doc_id, item_id, anchor FROM best b LEFT JOIN a ON a.doc_id = b.doc_id"""

QUERIES = {
    "note_sections": note_sections,
    "title_index": title_index,
    "alias_index": alias_index,
    "span_choice": span_choice,
    "search_titles": search_titles,
    "note_links": note_links,
    "tag_counts": tag_counts,
    "suggest_tags": suggest_tags,
    "new_tags": new_tags,
    "tag_changes": tag_changes,
    "dictionary_kept": dictionary_kept,
    "tag_popup": tag_popup,
    "picker_list": picker_list,
    "dictionary_listing": dictionary_listing,
    "pinned_forms": pinned_forms,
    "currency_amounts": currency_amounts,
    "anchor_spans": anchor_spans,
}

SQL = {
    "title_index": f"WITH {TITLES} SELECT phrase, target FROM idx",
    "alias_index": ALIASES,
    "span_choice": SPANS,
    "search_titles": SEARCH,
    "tag_counts": f"WITH {TAGS} SELECT tag, n FROM counts",
    "suggest_tags": SUGGEST,
    "new_tags": NEW,
    "tag_changes": CHANGES,
    "dictionary_kept": DICTIONARY,
    "tag_popup": POPUP,
    "picker_list": PICKER,
    "dictionary_listing": LISTING,
    "pinned_forms": PINNED,
    "currency_amounts": AMOUNTS,
    "anchor_spans": ANCHORS,
}
