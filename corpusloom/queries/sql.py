"""Pieces of DuckDB SQL that the oracles share; they follow other routes than the DataFrame code."""

from __future__ import annotations

from corpusloom.functions import lists as L


def words(items) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(items)) + ")"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '^[^a-z0-9]+', ''), '[^a-z0-9]+$', '')"


def token_ends(kernel: bool = False) -> str:
    """Whether `tok` ends a sentence, given `nxt`."""
    core = """regexp_replace(tok, '["'')\\]]+$', '')"""
    stem = f"regexp_replace({core}, '\\.$', '')"
    end = """regexp_matches(tok, '[.!?…]["'')\\]]?$')"""
    if kernel:
        return f"({end} AND (regexp_matches(tok, '[!?…]') OR (lower({stem}) NOT IN {words(L.KERNEL_ABBREVIATIONS)} AND NOT regexp_matches({stem}, '[0-9]$') AND NOT regexp_matches({core}, '^([A-Za-z]\\.)+[A-Za-z]?$'))))"
    return f"""CASE WHEN NOT {end} THEN false WHEN regexp_matches(tok, '[!?…]["'')\\]]?$') THEN true
        WHEN regexp_matches({stem}, '[0-9]$') THEN false WHEN lower({stem}) IN {words(L.ABBREVIATIONS)} THEN false
        WHEN regexp_matches({core}, '^([A-Za-z]\\.)+[A-Za-z]?$') THEN nxt IS NULL OR regexp_matches(nxt, '^[A-Z]') ELSE true END"""


def tokens(table: str, key: str, prefix: str = "", kernel: bool = False) -> str:
    """CTEs {prefix}words(id, sent, pos, w): normalised words by sentence."""
    p = prefix
    return f"""{p}raw AS (SELECT {key} AS id, list_filter(regexp_split_to_array(text, '{L.SPACE}+'), lambda x: x <> '') AS toks FROM {table}),
    {p}tok AS (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM {p}raw),
    {p}nxt AS (SELECT *, lead(tok) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM {p}tok),
    {p}ended AS (SELECT *, {token_ends(kernel)} AS fin FROM {p}nxt),
    {p}placed AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM {p}ended),
    {p}words AS (SELECT id, sent, pos, {norm('tok')} AS w FROM {p}placed WHERE {norm('tok')} <> '')"""


def counts(prefix: str = "") -> str:
    """CTEs {prefix}uni, {prefix}bi, {prefix}tri from {prefix}words."""
    p = prefix
    return f"""{p}padded AS (SELECT id, sent, pos, w FROM {p}words UNION ALL SELECT DISTINCT id, sent, -1, '<s>' FROM {p}words UNION ALL SELECT DISTINCT id, sent, -2, '<s>' FROM {p}words),
    {p}lagged AS (SELECT w, lag(w) OVER s AS w1, lag(w, 2) OVER s AS w2 FROM {p}padded WINDOW s AS (PARTITION BY id, sent ORDER BY pos)),
    {p}uni AS (SELECT w, count(*) AS c FROM {p}words GROUP BY w),
    {p}bi AS (SELECT w1, w, count(*) AS c FROM {p}lagged WHERE w1 IS NOT NULL GROUP BY ALL),
    {p}tri AS (SELECT w2, w1, w, count(*) AS c FROM {p}lagged WHERE w2 IS NOT NULL GROUP BY ALL)"""


def model(prefix: str = "", continuation: bool = False) -> str:
    """CTEs with what probabilities need: {prefix}voc, {prefix}p1, {prefix}b, {prefix}t."""
    p = prefix
    one = f"SELECT w, count(*) / (SELECT count(*) FROM {p}bi)::DOUBLE AS p FROM {p}bi GROUP BY w" if continuation else f"SELECT w, c / (SELECT sum(c) FROM {p}uni)::DOUBLE AS p FROM {p}uni"
    return f"""{p}voc AS (SELECT w FROM {p}uni UNION ALL SELECT '<s>'), {p}p1 AS ({one}),
    {p}b AS (SELECT w1, sum(c)::DOUBLE AS n, count(*) AS k FROM {p}bi GROUP BY w1),
    {p}t AS (SELECT w2, w1, sum(c)::DOUBLE AS n, count(*) AS k FROM {p}tri GROUP BY ALL)"""


def log_prob(asked: str, columns: str, prefix: str = "") -> str:
    """SELECT of columns and log_prob for rows of `asked` (w2, w1, w)."""
    p = prefix
    return f"""SELECT {columns}, ln(CASE WHEN v0.w IS NULL THEN 1e-9 WHEN v1.w IS NULL THEN q1 WHEN v2.w IS NULL THEN q2 ELSE q3 END) AS log_prob FROM (
      SELECT *, CASE WHEN t_n IS NULL THEN q2 ELSE t_n / (t_n + t_k + 1e-9) * (coalesce(t_c, 0) / t_n) + (1 - t_n / (t_n + t_k + 1e-9)) * q2 END AS q3 FROM (
      SELECT *, CASE WHEN b_n IS NULL THEN q1 ELSE b_n / (b_n + b_k + 1e-9) * (coalesce(b_c, 0) / b_n) + (1 - b_n / (b_n + b_k + 1e-9)) * q1 END AS q2 FROM (
      SELECT a.*, coalesce(o.p, 1e-9) AS q1, b.n AS b_n, b.k AS b_k, bi.c AS b_c, t.n AS t_n, t.k AS t_k, tri.c AS t_c FROM {asked} a
      LEFT JOIN {p}p1 o ON o.w = a.w LEFT JOIN {p}b b ON b.w1 = a.w1 LEFT JOIN {p}bi bi ON bi.w1 = a.w1 AND bi.w = a.w
      LEFT JOIN {p}t t ON t.w2 = a.w2 AND t.w1 = a.w1 LEFT JOIN {p}tri tri ON tri.w2 = a.w2 AND tri.w1 = a.w1 AND tri.w = a.w))) a
      LEFT JOIN {p}voc v0 ON v0.w = a.w LEFT JOIN {p}voc v1 ON v1.w = a.w1 LEFT JOIN {p}voc v2 ON v2.w = a.w2"""
