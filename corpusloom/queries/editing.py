"""Queries over insertions and edits, on every token, token pair or document."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import editing as E
from corpusloom.functions import lists as L
from corpusloom.queries import sql as S
from corpusloom.queries.language import table
from corpusloom.queries.scalar import RAW, places, raw_words


def typed_completions(spark, sf_dir):
    """Each raw token in lower case as a completion of its first two characters."""
    t, top, query = F.col("token"), F.lower("token"), F.substring("token", 1, 2)
    suffix = E.completion_suffix(top, query)
    return raw_words(spark, sf_dir).select(
        "token",
        suffix.alias("suffix"),
        E.ghost_after(suffix, F.substring("token", 3, 1)).alias("ghost"),
        E.phrase_left(F.concat(top, F.lit(" and more")), F.substring("token", 1, 1), F.substring("token", 2, 1)).alias("phrase"),
        E.raised_like(query, top).alias("shown"),
        E.saving(t, query).cast("long").alias("saved"),
    )


TYPED = f"""WITH {RAW}, r AS (SELECT token, lower(token) AS top, left(token, 2) AS q FROM raw_words)
SELECT token, substr(top, 3) AS suffix, CASE WHEN length(token) > 3 THEN substr(top, 4) END AS ghost, substr(top, 2) || ' and more' AS phrase,
    CASE WHEN left(q, 1) = upper(left(q, 1)) THEN upper(left(top, 1)) || substr(top, 2) ELSE top END AS shown,
    greatest(length(token) - 2, 0) + CASE WHEN length(token) > 2 AND regexp_matches(token, '[.,!?;:]$') THEN 1 ELSE 0 END AS saved FROM r"""


def insertion_spacing(spark, sf_dir):
    """Each token as inserted after the one before it, with one, two or no spaces."""
    pairs = places(spark, sf_dir).where("previous is not null").select("previous", "token").distinct()
    p, t, n = F.col("previous"), F.col("token"), F.length("previous")
    return pairs.select(
        "previous",
        "token",
        E.spaced_before(p, n, t).alias("before"),
        E.spaced_after(F.concat(p, t), F.length(F.concat(p, t)), t).alias("after"),
        E.start_over_space(F.concat(p, F.lit(" ")), n + 1, t).cast("long").alias("single"),
        E.start_over_double(F.concat(p, F.lit("  ")), n + 2, t).cast("long").alias("double"),
    )


SPACING = f"""WITH raw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{L.SPACE}+'), lambda x: x <> '') AS toks FROM documents),
u AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM raw), l AS (SELECT token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS previous FROM u),
p AS (SELECT DISTINCT previous, token, regexp_matches(token, '^[.,!?;:]') AS tight FROM l WHERE previous IS NOT NULL)
SELECT previous, token, CASE WHEN tight OR regexp_matches(previous, '[(\\[{{"''“‘]$') THEN token ELSE ' ' || token END AS before,
    CASE WHEN regexp_matches(token, '[.,!?;:]$') THEN token || ' ' ELSE token END AS after,
    length(previous) + CASE WHEN tight THEN 0 ELSE 1 END AS single, length(previous) + 1 AS double FROM p"""


def caret_context(spark, sf_dir):
    """The word and the paragraph in the middle of every document."""
    at = F.floor(F.length("text") / 2).cast("int")
    before, after = E.line_at(F.col("text"), at)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", E.word_at(before, after).alias("word"), F.md5(E.paragraph_at(F.col("text"), at)).alias("paragraph"))


CARET = f"""WITH d AS (SELECT doc_id, text, length(text) // 2 AS mid FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(regexp_extract(left(text, mid), '[^\\n]*$'), '[A-Za-z''.-]*$') || regexp_extract(substr(text, mid + 1), '^[A-Za-z''.-]*'), '^[''.-]+', ''), '^[''-]+|[''-]+$', '', 'g') AS w,
    string_split(text, chr(10)) AS lines, len(string_split(left(text, mid), chr(10))) AS no FROM d),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k, no FROM w),
b AS (SELECT doc_id, coalesce(max(k) FILTER (k < no AND trim(regexp_replace(line, '\\s+', ' ', 'g')) = ''), 0) AS low, coalesce(min(k) FILTER (k > no AND trim(regexp_replace(line, '\\s+', ' ', 'g')) = ''), max(k) + 1) AS high FROM l GROUP BY doc_id),
p AS (SELECT l.doc_id, string_agg(line, ' ' ORDER BY k) AS para FROM l JOIN b ON b.doc_id = l.doc_id AND k > low AND k < high GROUP BY l.doc_id)
SELECT w.doc_id, CASE WHEN regexp_full_match(w, '[A-Za-z][A-Za-z''-]*(\\.[A-Za-z''-]+)*\\.?') THEN w END AS word,
    md5(regexp_replace(regexp_replace(para, '\\[\\[[^\\]]*$', ''), '^\\s+|\\s+$', '', 'g')) AS paragraph FROM w JOIN p USING (doc_id)"""


def edit_guards(spark, sf_dir):
    """Edits made of tokens: a link around every second one, blanks before every third; and how a pinned one is cased."""
    n = F.length("token")
    link = F.concat(F.lit("see [["), F.col("token"), F.lit("]]"))
    line = F.concat(F.when(n % 2 == 0, F.col("token")).otherwise(""), F.repeat(F.lit(" "), n % 3))
    return raw_words(spark, sf_dir).select(
        "token",
        E.removes_link(F.when(n % 2 == 0, link).otherwise(F.col("token")), F.col("token")).alias("link_removed"),
        E.is_indent_edit(line, F.when(n % 5 == 0, F.col("token")).otherwise(" ")).alias("indent"),
        E.pinned_case(F.col("token"), F.concat(F.lit("mc"), F.lower("token")), n % 2 == 1).alias("pinned"),
        F.array_join(E.with_tag(F.array(F.lower("token"), F.lit("#news")), F.concat(F.lit("#"), F.substring("token", 1, 4))), " ").alias("tags"),
        F.array_join(E.finished_tags(F.array(F.struct(F.concat(F.lit("#"), F.col("token")).alias("tag"), n.alias("end")), F.struct(F.lit("#done").alias("tag"), F.lit(3).alias("end"))), F.lit(3)), " ").alias("finished"),
    )


GUARDS = f"""WITH {RAW}, r AS (SELECT *, length(token) AS n, trim(regexp_replace('#' || left(token, 4), '^#', '')) AS four, regexp_matches(token, '\\[\\[|\\]\\]|\\]\\(') AS linked FROM raw_words)
SELECT token, n % 2 = 0 AND NOT linked AS link_removed, n % 2 = 1 AND n % 5 <> 0 AS indent,
    CASE WHEN n > 1 AND token = upper(token) AND token <> lower(token) THEN upper('mc' || lower(token)) WHEN n % 2 = 1 THEN 'Mc' || lower(token) ELSE 'mc' || lower(token) END AS pinned,
    regexp_replace(lower(token), '^#', '') || ' news' || CASE WHEN four = '' OR lower(four) = regexp_replace(lower(token), '^#', '') OR lower(four) = 'news' THEN '' ELSE ' ' || four END AS tags,
    CASE WHEN n = 3 THEN '' ELSE token END AS finished FROM r"""

QUERIES = {"typed_completions": typed_completions, "insertion_spacing": insertion_spacing, "caret_context": caret_context, "edit_guards": edit_guards}
SQL = {"typed_completions": TYPED, "insertion_spacing": SPACING, "caret_context": CARET, "edit_guards": GUARDS}
