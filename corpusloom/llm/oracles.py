r"""DuckDB SQL for the queries that SQL can express; it follows other routes than the operators."""

from __future__ import annotations

from corpusloom.llm import chat, mixing

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _escaped(x: str) -> str:
    """Characters of a text once escaped: one more for each backslash and each control string."""
    controls = "|".join("".join("\\" + c if c in "[]/" else c for c in m) for m in sorted(chat.MARKERS, key=len, reverse=True))
    doubled = f"replace({x}, '\\', '\\\\')"
    return f"(length({doubled}) + len(regexp_extract_all({doubled}, '{controls}')))"


CHAT = f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, {_escaped('text')} + CASE role WHEN 'user' THEN {len('[INST][/INST]')} WHEN 'system' THEN {len('<<SYS>><</SYS>>')} WHEN 'assistant' THEN {len('</s>')} ELSE {len('[ROLE][/ROLE]</s>')} + {_escaped('role')} END AS shown FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(shown)::BIGINT + {len('<s>')} AS formatted_chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

PHRASES = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS pos, ws FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 34], ' ') AS key FROM s),
f AS (SELECT doc_id, pos FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)),
m AS (SELECT u.doc_id, u.pos, word, max(f.pos) OVER (PARTITION BY u.doc_id ORDER BY u.pos) AS last FROM u LEFT JOIN f ON f.doc_id = u.doc_id AND f.pos = u.pos),
g AS (SELECT doc_id, count(*) FILTER (last IS NOT NULL AND pos - last < 35) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (last IS NULL OR pos - last >= 35) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id"""

_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE {_COSINE} >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, component_id = e.vec_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

MIXING = f"""WITH RECURSIVE rows AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS src, coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, ''))) AS id, text, (len({_WORDS}) + 1)::BIGINT AS n_tokens FROM documents),
src AS (SELECT src, count(*) AS docs, sum(n_tokens)::DOUBLE AS t FROM rows GROUP BY src), shares AS (SELECT src, t, t / (SELECT sum(t) FROM src) AS p FROM src),
bisect(k, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
    SELECT k + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END FROM (SELECT k, low, high, (low + high) / 2 AS mid,
      (SELECT max(pow(p, (low + high) / 2) / t) * max(t / pow(p, (low + high) / 2)) FROM shares) <= {mixing.MAX_REPEAT} AS fits FROM bisect WHERE k < {mixing.BISECTIONS})),
alpha AS (SELECT CASE WHEN (SELECT max(1 / t) * max(t) FROM shares) <= {mixing.MAX_REPEAT} THEN 0.0 ELSE (SELECT high FROM bisect WHERE k = {mixing.BISECTIONS}) END AS a),
w AS (SELECT s.src, s.docs, s.t, pow(t / (SELECT sum(t) FROM src), a) / (SELECT sum(pow(p, a)) FROM shares) AS w FROM src s, alpha),
q AS (SELECT src, greatest(1, ceil(docs / {mixing.BLOCK}))::BIGINT AS blocks, t::BIGINT AS t, greatest(floor(w * (SELECT max(t / w) FROM w) + 0.5), t)::BIGINT AS quota FROM w),
plan AS (SELECT *, quota // t AS passes, quota % t AS rest FROM q),
placed AS (SELECT rows.*, passes, rest, ('0x' || substr(md5(id), 1, 8))::BIGINT % blocks AS block FROM rows JOIN plan USING (src)),
sums AS (SELECT src, block, sum(n_tokens) AS tokens, any_value(passes) AS passes, any_value(rest) AS rest FROM placed GROUP BY ALL),
turns AS (SELECT *, unnest(range(0, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM sums),
hashed AS (SELECT *, md5('{mixing.SEED}|' || epoch || '|' || src || '|' || block) AS turn FROM turns),
left_ AS (SELECT src, block, epoch, CASE WHEN epoch < passes THEN tokens ELSE rest - (sum(tokens) OVER (PARTITION BY src, epoch ORDER BY turn, block) - tokens) END AS room FROM hashed),
read AS (SELECT p.*, l.epoch, l.room, md5('{mixing.SEED}|' || l.epoch || '|' || p.id) AS key FROM placed p JOIN left_ l ON l.src = p.src AND l.block = p.block WHERE room > 0),
inside AS (SELECT *, row_number() OVER i AS place, sum(n_tokens) OVER (i ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM read WINDOW i AS (PARTITION BY src, block, epoch ORDER BY key, id, text))
SELECT doc_id, source, n_tokens, epoch, block, place FROM inside WHERE before < room"""

_SPACE = r"[\x20\x09-\x0D]"
_TEXT = "coalesce(text, ' ')"
REPAIR = rf"""WITH RECURSIVE bits(i, c, k) AS (SELECT range::UINTEGER, range::UINTEGER, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, {_TEXT} AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT k.*, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::UINTEGER), lambda h, b: xor(t[xor(h, b) % 256 + 1], h >> 8), 4294967295::UINTEGER), 4294967295::UINTEGER) % 20 AS d FROM keyed k, tab),
broken AS (SELECT conv, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE d <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '{_SPACE}+$', '') AS bare FROM broken),
f AS (SELECT *, role[1] AS ini, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS dup, bare[-1] NOT IN ('.', '!', '?') AS cut, lag(role[1]) OVER (PARTITION BY conv ORDER BY i) AS before FROM r),
sums AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (NOT blank AND NOT dup AND cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
put(p, q, letters, price, lines) AS (VALUES ('e', 'e', '', 0, ''), ('s', 's', '', 0, ''), ('u', 'u', '', 0, ''), ('a', 'a', '', 0, ''), ('e', 'u', 'I', 5, chr(10) || 'user:'), ('s', 'u', 'I', 5, chr(10) || 'user:'), ('a', 'u', 'I', 5, chr(10) || 'user:'),
    ('u', 'a', 'I', 5, chr(10) || 'assistant:'), ('e', 'a', 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')),
op(q, nxt, letter, ini, price, role) AS (VALUES ('e', 'e', 'D', NULL, 2, NULL), ('s', 's', 'D', NULL, 2, NULL), ('u', 'u', 'D', NULL, 2, NULL), ('a', 'a', 'D', NULL, 2, NULL), ('e', 's', 'K', 's', 0, NULL), ('e', 'u', 'K', 'u', 0, NULL), ('s', 'u', 'K', 'u', 0, NULL), ('a', 'u', 'K', 'u', 0, NULL), ('u', 'a', 'K', 'a', 0, NULL),
    ('e', 'u', 'R', NULL, 1, 'user'), ('s', 'u', 'R', NULL, 1, 'user'), ('a', 'u', 'R', NULL, 1, 'user'), ('u', 'a', 'R', NULL, 1, 'assistant')),
w(conv, i, st, best) AS (SELECT conv, 0::BIGINT, 'e', {{'cost': 0::BIGINT, 'audit': '', 'out': ''}} FROM sums UNION ALL
    SELECT w.conv, w.i + 1, op.nxt, min({{'cost': best.cost + put.price + op.price + CASE WHEN letter <> 'D' AND cut THEN 5 ELSE 0 END, 'audit': best.audit || letters || letter, 'out': best.out || lines || CASE letter WHEN 'D' THEN '' ELSE chr(10) || coalesce(op.role, f.role) || ':' || f.text END}})
    FROM w JOIN f ON f.conv = w.conv AND f.i = w.i + 1 JOIN put ON put.p = w.st JOIN op ON op.q = put.q AND (letter = 'D' OR NOT (blank OR dup)) AND (op.ini IS NULL OR op.ini = f.ini) GROUP BY w.conv, w.i, op.nxt),
done AS (SELECT w.conv, min({{'cost': best.cost + price, 'audit': best.audit || letters, 'out': best.out || lines}}) AS best FROM w JOIN sums ON sums.conv = w.conv AND w.i = n JOIN put ON p = st WHERE q IN ('e', 'a') GROUP BY w.conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.out, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM keyed) k LEFT JOIN sums ON sums.conv = k.conv LEFT JOIN done ON done.conv = k.conv"""



def _clusters(rounds: int) -> str:
    """Assignments and means, a pair of tables a round."""
    squares = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = f"SELECT vec_id, v.x, arg_min(n, {{'d': {squares}, 'n': n}}) AS n, min({squares}) AS d FROM v, SEEDS c GROUP BY vec_id, v.x"
    floor = "((s - ((s % k) + k) % k) // k)::BIGINT"
    text = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS n, x FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16))"""
    for k in range(rounds):
        text += f""",
a{k} AS ({near.replace('SEEDS', f'c{k}')}), u{k} AS (SELECT n, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}), s{k} AS (SELECT n, i, sum(y) AS s, count(*) AS k FROM u{k} GROUP BY n, i),
c{k + 1} AS (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT n, list({floor} ORDER BY i) AS x FROM s{k} GROUP BY n) m ON m.n = c.n)"""
    return text + f""", a AS ({near.replace('SEEDS', f'c{rounds}')})
SELECT vec_id, a.n::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.n = a.n"""


CENTROIDS = _clusters(3)

SQL = {"op2_chat": CHAT, "op13_centroids": CENTROIDS, "op11_repair": REPAIR, "op5_mixing": MIXING, "op6_phrases": PHRASES, "op8_pstable": VECTORS}
