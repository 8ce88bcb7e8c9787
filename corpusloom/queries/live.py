"""Queries over the change feed and live counters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.queries import sql as S
from corpusloom.queries.language import table
from corpusloom.session import shared_dir, staged
from corpusloom.streaming import changes, learning, livecache, maintained, personal, timers


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"


def _talk(spark, sf_dir):
    """State of the conversations' turns as notes, then up to four changes of each, by conversation.

    By the remainder of the conversation's number: 0 set anew and then renamed; 1 removed, or first renamed and
    then removed; 2 the first turn renamed twice and its old path set again; 3 the first turn renamed over the second.
    """
    talk = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("path"), "conv_id", "turn", "text")
    state = changes.path_counts(talk.select("path", "text"))
    kind, path, moved = F.col("conv_id") % 4, F.col("path"), F.concat(F.lit("r/"), "path")

    def change(op: str, at, text, seq: int):
        return F.struct(F.lit(op).alias("op"), at.alias("path"), text.cast("string").alias("text"), F.lit(seq).cast("long").alias("seq"))

    new, none = F.concat(F.lit("new words here. "), "text"), F.lit(None)
    first = F.col("turn") == 0
    steps = (
        F.when(kind == 0, F.array(change("set", path, F.lit("gone at once"), 1), change("set", path, new, 2), change("rename", path, moved, 3)))
        .when((kind == 1) & first, F.array(change("remove", path, none, 1)))
        .when(kind == 1, F.array(change("rename", path, moved, 1), change("remove", moved, none, 2)))
        .when((kind == 2) & first, F.array(change("rename", path, moved, 1), change("rename", moved, F.concat(F.lit("s/"), "path"), 2), change("set", path, F.lit("set again"), 3)))
        .when((kind == 3) & first, F.array(change("rename", path, F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("/1")), 1)))
    )
    return talk, state, talk.select(F.explode(steps).alias("x")).select("x.*")


def _feed(spark, sf_dir):
    _, state, feed = _talk(spark, sf_dir)
    return changes.applied(state, feed)


def change_feed(spark, sf_dir):
    """Bigrams of the corpus after a batch of changes, several of one path among them."""
    return changes.totals(_feed(spark, sf_dir)).bi


_AFTER = """(SELECT 'c/' || conv_id || '/' || turn AS path, CASE WHEN conv_id % 4 = 0 THEN 'new words here. ' || text ELSE text END AS text FROM conversations t
    WHERE conv_id % 4 <> 1 AND NOT (conv_id % 4 = 3 AND turn = 1 AND EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = t.conv_id AND o.turn = 0))
    UNION ALL SELECT 'again/' || conv_id, 'set again' FROM conversations WHERE conv_id % 4 = 2 AND turn = 0)"""
FEED = f"""WITH {S.tokens(_AFTER, 'path')}, {S.counts()} SELECT w1, w, c FROM bi"""


def change_feed_frequency(spark, sf_dir):
    return changes.document_frequency(_feed(spark, sf_dir))


def live_counters(spark, sf_dir):
    return changes.live_counters(table(spark, sf_dir, "events"))


COUNTERS = "SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, sum(floor(value))::BIGINT AS saved FROM events GROUP BY ALL"

def _actions(spark, sf_dir):
    """The events table as interactions: purchases are corrections, errors are undos, clicks are accepted items."""
    kind = F.when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "click", "accept").otherwise("edit")
    source, target = (F.concat(F.lit(x), (F.floor("value") % 3).cast("string")) for x in "st")
    shown = F.array(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("event_id") % (i + 1)).cast("double")), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("event_id") % (i + 3)).cast("double")))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), source.alias("source"), target.alias("target"), (F.col("event_id") % 4 != 0).alias("kept"), shown.alias("shown"), (F.col("event_id") % 2).cast("int").alias("accepted"))


def one_shot_reverts(spark, sf_dir):
    return learning.one_shot_reverts(_actions(spark, sf_dir))


REVERTS = """WITH l AS (SELECT user_id::VARCHAR AS user, event_id AS seq, event_type, lag(event_type) OVER o AS last, lag(floor(value)) OVER o AS v FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user, seq, 's' || (v % 3)::BIGINT AS source, 't' || (v % 3)::BIGINT AS target FROM l WHERE event_type = 'error' AND last = 'purchase'"""


def deferred_learning(spark, sf_dir):
    return learning.folded(_actions(spark, sf_dir), learning.deferred_step, learning.deferred_idle)


def ranking_weights(spark, sf_dir):
    return learning.folded(_actions(spark, sf_dir), learning.weights_step)


def accept_streaks(spark, sf_dir):
    """The run of days with an accepted item after each one, events taken in the order of time."""
    df = _actions(spark, sf_dir).withColumn("seq", F.unix_micros("at") * 1000 + F.col("seq") % 1000)
    found = learning.folded(df, learning.streak_step)
    return found.groupBy("user").agg(F.max(F.col("word").cast("long")).alias("longest"), F.count("*").alias("accepts"))


STREAKS = """WITH d AS (SELECT user_id::VARCHAR AS user, ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL), i AS (SELECT *, day - (row_number() OVER (PARTITION BY user ORDER BY day))::INTEGER AS island FROM d),
r AS (SELECT user, island, count(*) AS days, sum(n) AS n FROM i GROUP BY ALL) SELECT user, max(days) AS longest, sum(n)::BIGINT AS accepts FROM r GROUP BY user"""

HOURS = {"click": 48, "view": 24, "purchase": 96, "signup": 0, "error": 12}


def _debounced(spark, sf_dir, reset):
    """The events of each user and type as changes; the table's hours stand for a typist's seconds."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.floor("value").cast("string").alias("value"), F.col("ts").alias("at"))
    found = timers.replayed(rows, {k: h * 3_600_000 for k, h in HOURS.items()}, reset)
    return found.select("kind", "key", "seq", "value", F.unix_micros("fired").alias("fired"))


def debounced_changes(spark, sf_dir):
    """What goes out when a timer runs from the first change on."""
    return _debounced(spark, sf_dir, False)


def debounced_pauses(spark, sf_dir):
    """What goes out when every change sets the timer back."""
    return _debounced(spark, sf_dir, True)


def _debounced_sql(reset: bool) -> str:
    due = "e.since + e.wait" if reset else "CASE WHEN e.since >= w.due THEN e.since + e.wait ELSE w.due END"
    waits = ", ".join(f"('{k}', INTERVAL {h} HOUR)" for k, h in HOURS.items())
    return f"""WITH RECURSIVE waits(kind, wait) AS (VALUES {waits}),
    e AS (SELECT event_type AS kind, user_id::VARCHAR AS key, event_id AS seq, floor(value)::BIGINT::VARCHAR AS value, ts AS since, wait, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events JOIN waits ON waits.kind = event_type),
    w AS (SELECT kind, key, n, since + wait AS due, 0 AS run FROM e WHERE n = 1 UNION ALL SELECT e.kind, e.key, e.n, {due}, run + (e.since >= w.due)::INTEGER FROM w JOIN e ON e.kind = w.kind AND e.key = w.key AND e.n = w.n + 1)
    SELECT kind, key, max(seq) AS seq, arg_max(value, seq) AS value, epoch_us(max(due)) AS fired FROM w JOIN e USING (kind, key, n) GROUP BY kind, key, run"""


def live_document_cache(spark, sf_dir):
    """Conversations as documents: an assistant's turn is a version, a user's turn is accepted text."""
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), "role", "text")
    return livecache.rebuilt(talk.where("role = 'assistant'"), talk.where("role = 'user'"))


DOCUMENT_CACHE = f"""WITH t AS (SELECT conv_id::VARCHAR AS doc, turn AS seq, role = 'assistant' AS version, array_to_string(list_filter(list_transform(regexp_extract_all(text, {S.text(L.WORD)}), lambda x: {S.norm('x')}), lambda x: x <> ''), ' ') AS said FROM conversations WHERE role IN ('assistant', 'user')),
    v AS (SELECT doc, max(seq) AS seq FROM t WHERE version GROUP BY doc), o AS (SELECT t.doc, t.seq, max(said) AS said FROM t JOIN v ON v.doc = t.doc AND v.seq = t.seq WHERE version GROUP BY ALL),
    a AS (SELECT DISTINCT t.doc, t.seq, said FROM t LEFT JOIN v ON v.doc = t.doc WHERE NOT version AND (v.seq IS NULL OR t.seq > v.seq)),
    w AS (SELECT doc, unnest(string_split(said, ' ')) AS w FROM (SELECT * FROM o UNION ALL SELECT * FROM a)) SELECT doc, w, count(*) AS c FROM w WHERE w <> '' GROUP BY ALL"""


def learned_state(spark, sf_dir):
    """What the events teach of each user, taken in as three batches."""
    own = personal.Personal(spark, _folder(spark, "personal"), fan=2)
    rows = personal.learned(_actions(spark, sf_dir))
    for batch in range(3):
        own.learn(rows.where(F.col("seq") % 3 == batch), batch)
    return own.view().select("user", "part", "kind", "key", "n")


LEARNED = """WITH e AS (SELECT user_id::VARCHAR AS user, event_type, (floor(value)::BIGINT % 3)::VARCHAR AS d FROM events),
    x AS (SELECT user, 'stats' AS part, '' AS kind, CASE event_type WHEN 'click' THEN 'accepts' WHEN 'purchase' THEN 'corrections' ELSE 'reverts' END AS key FROM e WHERE event_type IN ('click', 'purchase', 'error')
    UNION ALL SELECT user, 'confusion', unnest(['observations', 'seen', 'seen', 'sub']), unnest(['', 't', d, 't>s']) FROM e WHERE event_type = 'purchase')
    SELECT user, part, kind, key, count(*)::DOUBLE AS n FROM x GROUP BY ALL UNION ALL SELECT DISTINCT user, 'learn', '', 's' || d, 1.0::DOUBLE FROM e WHERE event_type = 'error'"""


def _maintained(spark, sf_dir, table):
    """A table of the conversations' turns, then followed through the changes of _talk."""
    _, state, feed = _talk(spark, sf_dir)
    state = staged(state, "state")
    own = maintained.Maintained(spark, _folder(spark, "maintained"), k=4, reserve=2, tables=(table,))
    own.apply(state, 0)
    own.apply(maintained.difference(state, feed), 1)
    return own


def maintained_lists(spark, sf_dir):
    """The four most frequent words of each context after a batch of changes."""
    return _maintained(spark, sf_dir, "lists").lists()


def maintained_continuation(spark, sf_dir):
    """In how many left contexts each word occurs after a batch of changes."""
    return _maintained(spark, sf_dir, "continuation").continuation()


_LISTED = """SELECT 1 AS n, '' AS w2, '' AS w1, w, c FROM uni UNION ALL SELECT 2, '', w1, w, c FROM bi UNION ALL SELECT 3, w2, w1, w, c FROM tri"""
_BEFORE = FEED.split(" SELECT w1, w, c FROM bi")[0]
LISTS = f"{_BEFORE}, g AS ({_LISTED}), r AS (SELECT *, row_number() OVER (PARTITION BY n, w2, w1 ORDER BY c DESC, w) AS rank FROM g) SELECT n, w2, w1, w, c, rank::INTEGER AS rank FROM r WHERE rank <= 4"

QUERIES = {f.__name__: f for f in (one_shot_reverts, deferred_learning, ranking_weights, accept_streaks, change_feed, change_feed_frequency, live_counters, debounced_changes, debounced_pauses, live_document_cache, learned_state, maintained_lists, maintained_continuation)}

SQL = {
    "one_shot_reverts": REVERTS,
    "accept_streaks": STREAKS,
    "change_feed": FEED,
    "change_feed_frequency": FEED.split(f", {S.counts()}")[0] + " SELECT w, count(DISTINCT id) AS df FROM words GROUP BY w",
    "live_counters": COUNTERS,
    "debounced_changes": _debounced_sql(False),
    "debounced_pauses": _debounced_sql(True),
    "live_document_cache": DOCUMENT_CACHE,
    "learned_state": LEARNED,
    "maintained_lists": LISTS,
    "maintained_continuation": f"{_BEFORE} SELECT w, count(*) AS cont FROM bi GROUP BY w",
}
