"""Queries over filters and scalar text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.functions import text as X
from corpusloom.operators import ngram
from corpusloom.queries import sql as S
from corpusloom.queries.language import table
from corpusloom.session import bound_batches

PATTERNS = ["site1.example/blog", "*.example/a*/**", "**/p?ge*", "archive/**"]


def raw_words(spark, sf_dir):
    """(token): distinct raw tokens of documents."""
    return table(spark, sf_dir, "documents").select(F.explode(X.raw_tokens("text")).alias("token")).distinct()


RAW = f"raw_words AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '{L.SPACE}+'), lambda x: x <> '')) AS token FROM documents)"


def places(spark, sf_dir):
    """(doc_id, pos, token, previous): raw tokens in place; the one before comes from the same row."""
    df = ngram.held(table(spark, sf_dir, "documents").select("doc_id", "text"), toks=X.raw_tokens("text"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("toks"))
    return df.select("doc_id", F.posexplode(F.arrays_zip(F.col("toks").alias("token"), F.slice(before, F.lit(1), F.size("toks")).alias("previous"))).alias("pos", "x")).select("doc_id", "pos", "x.*")


def normalize_tokens(spark, sf_dir):
    return raw_words(spark, sf_dir).select("token", X.normalize_word("token").alias("word"))


def token_guards(spark, sf_dir):
    """Predicates on raw tokens: punctuation, acronyms, fragments, digits, initials, abbreviations, tags."""
    t = F.col("token")
    return raw_words(spark, sf_dir).select(
        "token",
        X.starts_tight(t).alias("starts_tight"),
        X.ends_tight(t).alias("ends_tight"),
        X.is_acronym(t).alias("acronym"),
        X.is_fragment(t).alias("fragment"),
        X.digit_glued(t).alias("digit_glued"),
        t.rlike(r"^[A-Za-z]\.\z|^\.[A-Za-z]\z").alias("dotted_initial"),
        t.contains(".").alias("abbreviation_token"),
        X.is_valid_tag(t).alias("valid_tag"),
        X.inflection_class(t).alias("inflection"),
    )


GUARDS = f"""WITH {RAW}, c AS (SELECT token, regexp_replace(token, 's$', '') AS core FROM raw_words)
SELECT token, regexp_matches(token, '^[.,!?;:]') AS starts_tight, regexp_matches(token, '[.,!?;:]$') AS ends_tight,
    length(core) >= 2 AND core = upper(core) AND regexp_matches(core, '[A-Z]') AS acronym,
    length(token) = 1 AND token NOT IN ('a', 'i') AS fragment, regexp_matches(token, '[0-9][A-Za-z]+$') AS digit_glued,
    regexp_matches(token, '^[A-Za-z]\\.$|^\\.[A-Za-z]$') AS dotted_initial, contains(token, '.') AS abbreviation_token,
    regexp_full_match(token, '[\\p{{L}}\\p{{N}}_/-]+') AND regexp_matches(token, '[^\\p{{N}}/_-]') AS valid_tag,
    CASE WHEN length(token) >= 5 AND suffix(token, 'ing') THEN 'ing' WHEN length(token) >= 4 AND suffix(token, 'ed') THEN 'ed' WHEN length(token) >= 4 AND suffix(token, 's') AND NOT suffix(token, 'ss') THEN 's' ELSE '' END AS inflection FROM c"""


def doubled_words(spark, sf_dir):
    found = places(spark, sf_dir).where(X.is_doubled_word(F.col("previous"), F.col("token")))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


DOUBLED = f"""WITH {S.tokens('documents', 'doc_id')}, p AS (SELECT id AS doc_id, pos - 1 AS pos, tok AS token, lag(tok) OVER (PARTITION BY id ORDER BY pos) AS previous FROM tok)
SELECT doc_id, pos, token FROM p WHERE lower(previous) = lower(token) AND lower(token) IN {S.words(L.NEVER_DOUBLED)}"""


def profanity(spark, sf_dir):
    """Blocked words of each document, and whether any of its tokens is blocked."""
    df = ngram.held(table(spark, sf_dir, "documents").select("doc_id", "text"), toks=X.tokenize_words("text"))
    return df.select("doc_id", F.size(F.filter("toks", lambda w: X.is_profane(w))).cast("long").alias("n"), X.blocked_surface(F.col("toks")).alias("blocked"))


PROFANE = f"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {S.text(L.WORD)}), lambda x: {S.norm('x')}), lambda x: x IN {S.words(L.PROFANITY)}) AS b FROM documents)
SELECT doc_id, len(b) AS n, len(b) > 0 AS blocked FROM t"""


def path_filter(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), X.path_excluded(path, PATTERNS).alias("excluded"))


PATHS = """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, path, lower(ltrim(path, '/')) = 'site1.example/blog' OR starts_with(lower(ltrim(path, '/')), 'site1.example/blog/')
    OR regexp_full_match(ltrim(path, '/'), '[^/]*\\.example/a[^/]*/.*', 'i') OR regexp_full_match(ltrim(path, '/'), '.*p[^/]ge[^/]*', 'i') OR regexp_full_match(ltrim(path, '/'), 'archive/.*', 'i') AS excluded FROM p"""


def exclude_list(spark, sf_dir):
    found = X.parse_exclude_list("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("items"))


EXCLUDES = f"""WITH e AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n,]'), lambda x: regexp_replace(x, '^{L.SPACE}+|{L.SPACE}+$', '', 'g')), lambda x: x <> '') AS i FROM documents)
SELECT doc_id, len(i) AS n, array_to_string(i, '|') AS items FROM e"""


def sanitized_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sanitize_for_model("html").alias("clean"))


def _sanitize_sql(x: str) -> str:
    steps = (("```[\\s\\S]*?```", " "), ("```[\\s\\S]*$", " "), ("`[^`\\n]*`", " "), ("`[^`\\n]*$", " "), ("\\$\\$[\\s\\S]*?\\$\\$", " "), ("\\$[^$\\n]*\\$", " "), ("\\$[^$\\n]*$", " "), ("<!--[\\s\\S]*?-->", " "), ("</?[A-Za-z][^>\\n]*>", " "), ("!\\[([^\\]]*)\\]\\([^)\\n]*\\)", " "), ("\\[([^\\]]*)\\]\\([^)\\n]*\\)", "\\1"), ("\\[\\[(?:[^\\]|\\n]*\\|)?([^\\]\\n]*)\\]\\]", "\\1"), (f"(?i)\\b(?:https?://|www\\.){L.NOT_SPACE}+", " "))
    for pattern, by in steps:
        x = f"regexp_replace({x}, {S.text(pattern)}, {S.text(by)}, 'g')"
    return x


def model_context(spark, sf_dir):
    """Context tokens of pages, and the words since the last sentence end."""
    df = ngram.held(table(spark, sf_dir, "pages").select("page_id", "html"), toks=X.context_words("html"))
    since = F.size("toks") - F.coalesce(F.array_max(F.transform("toks", lambda t, i: F.when(t.isin(".", "!", "?"), i + 1))), F.lit(0))
    own = F.filter(F.transform(F.slice("toks", F.size("toks") - since + 1, since), X.normalize_word), lambda w: w != "")
    return df.select("page_id", F.size("toks").cast("long").alias("n"), F.array_join(own, " ").alias("since_end"))


CONTEXT = f"""WITH c AS (SELECT page_id, regexp_extract_all(regexp_replace({_sanitize_sql('html')}, '[‘’]', '''', 'g'), {S.text(L.CASED)}) AS t FROM pages),
u AS (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM c),
e AS (SELECT page_id, max(CASE WHEN tok IN ('.', '!', '?') THEN pos ELSE 0 END) AS fin FROM u GROUP BY page_id)
SELECT c.page_id, len(t) AS n, coalesce((SELECT string_agg({S.norm('tok')}, ' ' ORDER BY pos) FROM u JOIN e USING (page_id) WHERE u.page_id = c.page_id AND pos > fin AND {S.norm('tok')} <> ''), '') AS since_end FROM c"""


def blocks_and_links(spark, sf_dir):
    """Lines of documents with their word counts, and whether they are long enough and carry a link."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    n = X.block_words("line").cast("long")
    terms = F.regexp_count("line", F.lit(L.TERM)).cast("long")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), n.alias("n_words"), (n >= 12).alias("long_enough"), (terms >= 3).alias("wordish"), X.has_link("line").alias("has_link"), X.segment_key("line").alias("seg_key"), X.double_space_start("line").cast("long").alias("space_start"))


BLOCKS = f"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM a)
SELECT doc_id, line_no, len(regexp_extract_all(line, {S.text(L.BLOCK_WORD)})) AS n_words, len(regexp_extract_all(line, {S.text(L.BLOCK_WORD)})) >= 12 AS long_enough,
    len(regexp_extract_all(line, {S.text(L.TERM)})) >= 3 AS wordish, regexp_matches(line, '\\[\\[[^\\]]*\\]\\]|\\[[^\\]]*\\]\\([^)]*\\)') AS has_link,
    substr(lower(regexp_replace(line, '^{L.SPACE}+|{L.SPACE}+$', '', 'g')), 1, 80) AS seg_key,
    CASE WHEN length(line) >= 2 AND line[-1] = ' ' AND line[-2] = ' ' AND (length(line) < 3 OR line[-3] <> ' ') AND trim(line) <> '' THEN length(line) - 1 ELSE length(line) END AS space_start FROM l"""


def case_rules(spark, sf_dir):
    """Case repairs of every raw token, with the token before as what precedes it.

    What depends on one of both alone is worked out once per distinct token.
    """
    t, p = F.col("token"), F.coalesce("previous", F.lit(""))
    pairs = places(spark, sf_dir).select("token", p.alias("previous")).distinct()
    tokens = pairs.select("token").distinct().select(
        "token",
        X.fix_double_capital(t).alias("double_capital"),
        X.capitalize_first(t).alias("capitalized"),
        X.fix_contraction(t).alias("contraction"),
        X.ordinal_suffix(F.length(t).cast("string")).alias("ordinal"),
        X.edit_budget(F.length(t)).cast("long").alias("budget"),
    )
    before = F.col("previous")
    befores = pairs.select("previous").distinct().select("previous", X.should_capitalize_next("previous").alias("starts"), X.suggestion_case(before, F.lit(False)).alias("case"))
    auto = X.auto_capitalized(t, before, F.lit(None).cast("string"), begins=F.col("starts")).alias("auto")
    suggested = X.apply_suggestion_case(t, F.col("case")).alias("suggested")
    df = pairs.join(befores, "previous").join(tokens, "token")
    return df.select("token", "previous", "double_capital", "capitalized", "contraction", "starts", auto, suggested, X.match_case(before, F.lower(t)).alias("matched"), "ordinal", "budget")


def _case_sql() -> str:
    dc = "CASE WHEN regexp_full_match(token, '[A-Z][A-Z][a-z]+') THEN token[1] || lower(token[2]) || substr(token, 3) ELSE token END"

    def cap(x: str) -> str:
        lead = f"regexp_extract({x}, '^([^A-Za-z]*)', 1)"
        return f"({lead} || upper(substr({x}, length({lead}) + 1, 1)) || substr({x}, length({lead}) + 2))"

    auto = f"CASE WHEN ({dc}) = 'i' THEN 'I' ELSE ({dc}) END"
    pairs = " ".join(f"WHEN '{k}' THEN {S.text(v)}" for k, v in L.CONTRACTIONS.items())
    ends = S.token_ends().replace("tok", "previous").replace("nxt", "NULL::VARCHAR")
    starts = f"(previous = '' OR regexp_full_match(previous, '(?:(?:[-*+]|[0-9]+[.)])[ \\t]+(?:\\[[ xX]\\][ \\t]+)?|>[ \\t]?)+') OR regexp_full_match(previous, '[.!?…]+') OR ({ends}))"
    return f"""WITH {S.tokens('documents', 'doc_id')}, d AS (SELECT DISTINCT tok AS token, coalesce(lag(tok) OVER (PARTITION BY id ORDER BY pos), '') AS previous FROM tok),
    s AS (SELECT *, {starts} AS starts FROM d)
    SELECT token, previous, {dc} AS double_capital, {cap('token')} AS capitalized, CASE lower(token) {pairs} END AS contraction, starts,
      CASE WHEN starts THEN {cap('(' + auto + ')')} ELSE {auto} END AS auto, CASE WHEN starts THEN {cap('token')} ELSE token END AS suggested,
      CASE WHEN previous = '' THEN lower(token) WHEN previous = upper(replace(previous, 'ß', 'ss')) AND length(previous) > 1 THEN upper(replace(token, 'ß', 'ss')) WHEN previous[1] = upper(replace(previous[1], 'ß', 'ss')) THEN upper(replace(lower(token)[1], 'ß', 'ss')) || substr(lower(token), 2) ELSE lower(token) END AS matched,
      CASE WHEN length(token) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN length(token) % 10 = 1 THEN 'st' WHEN length(token) % 10 = 2 THEN 'nd' WHEN length(token) % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
      greatest(1, floor(length(token) / 4 + 0.5))::BIGINT AS budget FROM s"""


def stems(spark, sf_dir):
    """Stems of the corpus's words (already a-z and 0-9 at the ends), and the bases that would make each known."""
    return ngram.count(table(spark, sf_dir, "documents")).uni.select("w", X.stem("w").alias("stem"), F.array_join(F.array_sort(X.stem_candidates("w")), " ").alias("bases"))


def _stem_sql() -> str:
    def und(x: str) -> str:
        return f"CASE WHEN length({x}) >= 3 AND ({x})[-1] = ({x})[-2] AND ({x})[-1] NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({x}, length({x}) - 1) ELSE {x} END"

    bases = []
    for s in L.SUFFIXES:
        base = f"left(w, length(w) - {len(s)})"
        ok = f"length(w) >= 4 AND suffix(w, '{s}') AND length(w) - {len(s)} >= 3"
        bases.append(f"CASE WHEN {ok} THEN {base} END")
        if s in ("ing", "ed"):
            bases += [f"CASE WHEN {ok} THEN {base} || 'e' END", f"CASE WHEN {ok} AND ({base})[-1] = ({base})[-2] THEN left(w, length(w) - {len(s) + 1}) END"]
        if s in ("ies", "ied", "ier", "iest"):
            bases.append(f"CASE WHEN {ok} THEN {base} || 'y' END")
    c3, c2, c1, c4 = (f"left(w, length(w) - {k})" for k in (3, 2, 1, 4))
    return f"""WITH {S.tokens('documents', 'doc_id')}, u AS (SELECT DISTINCT w FROM words)
    SELECT w, CASE WHEN length(w) <= 3 THEN w WHEN suffix(w, 'ies') AND length(w) > 4 THEN {c3} || 'y' WHEN suffix(w, 'sses') THEN {c2} WHEN suffix(w, 'ing') AND length(w) > 5 THEN {und(c3)}
      WHEN suffix(w, 'edly') THEN {und(c4)} WHEN suffix(w, 'ed') AND length(w) > 4 THEN {und(c2)} WHEN suffix(w, 'ly') AND length(w) > 4 THEN {c2} WHEN suffix(w, 'es') AND length(w) > 4 THEN {c2}
      WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {c1} ELSE w END AS stem,
      array_to_string(list_sort(list_distinct(list_filter([{', '.join(bases)}], lambda x: x IS NOT NULL))), ' ') AS bases FROM u"""


def known_words(spark, sf_dir):
    """Benchmark words tested against lexicons: vocabulary, document frequency of 2 or more, and known stems."""
    uni = ngram.count(table(spark, sf_dir, "documents")).uni
    asked = ngram.count(table(spark, sf_dir, "benchmark")).uni.select("w")
    often = ngram.document_frequency(table(spark, sf_dir, "documents")).where("df >= 2").select("w", F.lit(True).alias("often"))
    bases = asked.select("w", F.explode(X.stem_candidates("w")).alias("base")).join(uni.select(F.col("w").alias("base")), "base", "left_semi").select("w", F.lit(True).alias("by_stem")).distinct()
    df = asked.join(uni.select("w", F.lit(True).alias("in_vocab")), "w", "left").join(often, "w", "left").join(bases, "w", "left")
    flags = [F.coalesce(c, F.lit(False)) for c in ("in_vocab", "often", "by_stem")]
    return df.select("w", flags[0].alias("in_vocab"), flags[1].alias("often"), flags[2].alias("by_stem"), (flags[1] | flags[2]).alias("real_word"))


def _known_sql() -> str:
    inner = _stem_sql().split("AS stem,")[1].split(" AS bases")[0].strip()
    bases = inner[len("array_to_string(list_sort(") : inner.rindex("), ' ')")]
    return f"""WITH {S.tokens('documents', 'doc_id')}, {S.tokens('benchmark', 'item_id', 'q')}, u AS (SELECT w, count(DISTINCT id) AS df FROM words GROUP BY w),
    q AS (SELECT DISTINCT w FROM qwords), s AS (SELECT DISTINCT w FROM (SELECT w, unnest({bases}) AS base FROM q) x WHERE base IN (SELECT w FROM u))
    SELECT q.w, u.w IS NOT NULL AS in_vocab, coalesce(df >= 2, false) AS often, s.w IS NOT NULL AS by_stem, coalesce(df >= 2, false) OR s.w IS NOT NULL AS real_word FROM q LEFT JOIN u ON u.w = q.w LEFT JOIN s ON s.w = q.w"""


def phrase_surface(spark, sf_dir):
    """The first six words of every sentence as a phrase."""
    s = ngram.sentences(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode("sentences").alias("no", "s"))
    return s.select("doc_id", F.col("no").cast("long").alias("no"), X.join_phrase(F.slice("s", 1, 6)).alias("phrase"))


PHRASES = f"""WITH {S.tokens('documents', 'doc_id')}, r AS (SELECT id AS doc_id, sent, w, row_number() OVER (PARTITION BY id, sent ORDER BY pos) AS k FROM words),
p AS (SELECT doc_id, sent, string_agg(CASE WHEN k = 1 THEN w WHEN w IN {S.words(L.CLITICS)} THEN '''' || w ELSE ' ' || w END, '' ORDER BY k) AS phrase FROM r WHERE k <= 6 GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent) - 1 AS no, phrase FROM p"""


def snippets(spark, sf_dir):
    clean = X.snippet_of(F.col("text"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("snippet"), X.link_text(F.col("source"), F.col("lang"), F.lit(None).cast("string")).alias("link"))


SNIPPETS = f"""WITH a AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^{L.SPACE}*(?:[-*+]|[0-9]+[.)]){L.SPACE}+', ''), '[#>*_`]', '', 'g'), '^{L.SPACE}+|{L.SPACE}+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
f AS (SELECT *, coalesce(ls[1], '') AS one FROM a)
SELECT doc_id, CASE WHEN length(one) > 100 THEN regexp_replace(left(one, 100), '{L.SPACE}+$', '') ELSE one END || CASE WHEN len(ls) > 1 OR length(one) > 100 THEN ' …' ELSE '' END AS snippet, '[[' || source || '#' || lang || ']]' AS link FROM f"""


def markdown_zones(spark, sf_dir):
    """The zone at the end of every page and of every document."""
    bound_batches(spark)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("html").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    return pages.unionByName(docs).select("id", X.markdown_zone("text").alias("zone"), X.upper_from_text("text").alias("upper"))


def grouped_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.group_thousands(F.col("n_chars").cast("string"), ",").alias("grouped"))


QUERIES = {
    "normalize_tokens": normalize_tokens,
    "token_guards": token_guards,
    "doubled_words": doubled_words,
    "profanity": profanity,
    "path_filter": path_filter,
    "exclude_list": exclude_list,
    "sanitized_pages": sanitized_pages,
    "model_context": model_context,
    "blocks_and_links": blocks_and_links,
    "case_rules": case_rules,
    "stems": stems,
    "known_words": known_words,
    "phrase_surface": phrase_surface,
    "snippets": snippets,
    "markdown_zones": markdown_zones,
    "grouped_numbers": grouped_numbers,
}

SQL = {
    "normalize_tokens": f"WITH {RAW} SELECT token, {S.norm('token')} AS word FROM raw_words",
    "token_guards": GUARDS,
    "doubled_words": DOUBLED,
    "profanity": PROFANE,
    "path_filter": PATHS,
    "exclude_list": EXCLUDES,
    "sanitized_pages": f"SELECT page_id, {_sanitize_sql('html')} AS clean FROM pages",
    "model_context": CONTEXT,
    "blocks_and_links": BLOCKS,
    "case_rules": _case_sql(),
    "stems": _stem_sql(),
    "known_words": _known_sql(),
    "phrase_surface": PHRASES,
    "snippets": SNIPPETS,
    "grouped_numbers": "SELECT doc_id, format('{:,}', n_chars) AS grouped FROM documents",
}
