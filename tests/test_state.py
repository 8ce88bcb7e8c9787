"""Keyed timers, live document caches and learned state kept as runs."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import channel as C
from corpusloom.sources import files
from corpusloom.streaming import livecache, personal, timers
from corpusloom.streaming.runs import RunLog


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def feed(spark, path, batch, schema):
    spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)


def taken(spark, name):
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


def test_timers_of_keys_do_not_wait_for_one_another(spark, tmp_path):
    path = str(tmp_path / "feed")
    feed(spark, path, [("slow", "b", 1, "b1"), ("now", "c", 1, "c1")], timers.CHANGE)
    stream = spark.readStream.schema(timers.CHANGE).parquet(path)
    found = timers.debounced(stream, {"quick": 6000, "slow": 120_000, "now": 0})
    query = found.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        for k in range(10):
            feed(spark, path, [("quick", "a", k, f"a{k}")], timers.CHANGE)
        end = time.time() + 60
        while time.time() < end and not any(r[1] == "a" for r in taken(spark, "debounced")):
            time.sleep(0.3)
    finally:
        query.stop()
    got = taken(spark, "debounced")
    assert ("now", "c", 1, "c1") in got and not [r for r in got if r[0] == "slow"]
    own = [r for r in got if r[1] == "a"]
    assert len(own) <= 2 and own[-1][3] in {f"a{k}" for k in range(10)}  # a pause of ten edits gives one change, or two if writing them took longer than the timer


def fired(events, delays, reset):
    out, held = [], {}
    for at, kind, key, seq, value in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[3] is not None, e[3] or 0, e[4] is not None, e[4] or "")):
        own, delay = (kind, key), delays.get(kind, 0)
        if own in held and (at is None or at >= held[own][0]):
            out.append((*own, *held[own][1], held.pop(own)[0]))
        if own not in held:
            if at is None or not delay:
                out.append((*own, seq, value, at))
                continue
            held[own] = (at + delay, (seq, value))
            continue
        due, best = held[own]
        held[own] = (at + delay if reset else due, max(best, (seq, value), key=lambda v: timers.rank(*v)))
    return sorted(out + [(*own, *best, due) for own, (due, best) in held.items()], key=str)


@pytest.mark.parametrize("reset", [False, True])
def test_replayed_timers(spark, reset):
    rng = random.Random(9)
    events = [(rng.choice([None, *range(60)]) if rng.random() < 0.1 else rng.randint(0, 60), rng.choice(["x", "y", "z", None]), rng.choice(["k", "l", None]), rng.choice([None, *range(9)]), rng.choice(["v", "w", None])) for _ in range(400)]
    df = spark.createDataFrame(events, "s long, kind string, key string, seq long, value string").withColumn("at", F.timestamp_seconds("s"))
    delays = {"x": 5000, "y": 17_000, "z": 0}
    got = timers.replayed(df, delays, reset).select(*timers.COLUMNS, F.unix_seconds("fired"))
    assert rows(got) == fired(events, {k: v // 1000 for k, v in delays.items()}, reset)
    assert timers.replayed(df.where("false"), delays).count() == 0


def cache_of(versions, accepted):
    last = max(((s, " ".join(t.split())) for s, t in versions), default=None)
    words = Counter(last[1].split() if last else [])
    for seq, text in set(accepted):
        if last is None or seq > last[0]:
            words.update(text.split())
    return words


def test_live_cache_equals_a_rebuild_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    log = [(rng.choice("ab"), rng.randint(1, 30), rng.random() < 0.3, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 4)))) for _ in range(60)]
    log += rng.sample(log, 10)
    versions, accepted = str(tmp_path / "v"), str(tmp_path / "a")
    schema = "doc string, seq long, text string"
    spark.createDataFrame([], schema).write.parquet(versions)
    spark.createDataFrame([], schema).write.parquet(accepted)
    shown = {}
    for low in range(0, len(log), 20):
        part = log[low : low + 20]
        feed(spark, versions, [(d, s, t) for d, s, v, t in part if v], schema)
        feed(spark, accepted, [(d, s, t) for d, s, v, t in part if not v], schema)
        found = livecache.live(*(spark.readStream.schema(schema).parquet(p) for p in (versions, accepted)))
        seen = []
        query = found.writeStream.foreachBatch(lambda df, k: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        shown |= {r["doc"]: dict(zip(r["words"], r["counts"])) for r in seen}
        so_far = log[: low + 20]
        for doc in {d for d, *_ in so_far}:
            want = cache_of([(s, t) for d, s, v, t in so_far if d == doc and v], [(s, t) for d, s, v, t in so_far if d == doc and not v])
            assert shown[doc] == want
    whole = livecache.rebuilt(spark.read.parquet(versions), spark.read.parquet(accepted))
    assert rows(whole) == sorted(((d, w, c) for d, own in shown.items() for w, c in own.items()), key=str)


def test_cache_of_odd_rows(spark):
    schema = "doc string, seq long, text string, said string"
    versions = spark.createDataFrame([("a", 1, "one", "x"), ("a", 2, None, "x"), (None, 1, "two", "x"), ("b", None, "two", "x")], schema)
    accepted = spark.createDataFrame([("a", 1, "gone", "x"), ("a", 3, "Kept kept", "x"), ("a", 3, "Kept kept", "x"), ("c", 1, "", "x"), ("d", 1, "new", "x")], schema)
    assert rows(livecache.rebuilt(versions, accepted)) == [("a", "kept", 2), ("d", "new", 1)]
    assert rows(livecache.lifted(livecache.rebuilt(versions, accepted))) == [("a", "kept", 1.0)]
    assert livecache.rebuilt(versions.where("false"), accepted.where("false")).count() == 0


def test_runs_stay_few_and_a_batch_counts_once(spark, tmp_path):
    def merge(found, whole):
        return found.groupBy("k").agg(F.sum("n").alias("n"))

    log = RunLog(spark, str(tmp_path / "log"), "k string, n long", merge, fan=3)
    assert log.read().count() == 0 and log.batch is None
    for k in range(30):
        batch = spark.createDataFrame([(f"w{k % 4}", 1)], "k string, n long").coalesce(1)
        assert log.append(batch, k) and not log.append(batch, k)
    log = RunLog(spark, str(tmp_path / "log"), "k string, n long", merge, fan=3)  # as after a restart
    assert rows(log.read()) == [("w0", 8), ("w1", 8), ("w2", 7), ("w3", 7)] and log.batch == 29
    assert len(log.runs()) <= 2 * 4 and len(log._names("runs")) <= 2 * 4 + 4 * 4 and len(log._manifests()) <= 4
    log.compact()
    assert [(r.low, r.high) for r in log.runs()] == [(0, 29)] and log.read().count() == 4


EVENTS = [
    ("u", 1, "correct", "teh", "the"),
    ("u", 2, "correct", "teh", "the"),
    ("u", 3, "accept", None, None),
    ("u", 4, "undo", "Obsid", "obsidian"),
    ("v", 5, "correct", None, "x"),
    (None, 6, "undo", None, None),
    ("u", 7, "edit", "a", "b"),
]
EVENT = "user string, seq long, kind string, source string, target string"


def test_learned_state(spark, tmp_path):
    own = personal.Personal(spark, str(tmp_path / "p"), fan=2)
    for k, batch in enumerate([EVENTS[:2], EVENTS[2:5], EVENTS[5:]]):
        own.learn(personal.learned(spark.createDataFrame(batch, EVENT)), k)
    at_once = personal.batch_rows(personal.learned(spark.createDataFrame(EVENTS, EVENT)))
    assert rows(own.view().drop("seq")) == rows(at_once.drop("seq"))
    want = Counter(C.confusion_counts("teh", "the") * 2)
    assert {(r["kind"], r["key"]): r["n"] for r in own.view().where("part = 'confusion'").collect()} == want
    assert own.view(enabled=False).count() == 0 and own.view().count() > 0
    saved = {r["user"]: json.loads(r["json"]) for r in own.export().collect()}
    assert saved["u"]["learnList"] == ["obsid"] and saved["u"]["stats"] == {"corrections": 2, "accepts": 1, "reverts": 1, "charsSaved": 0}
    assert saved["u"]["confusion"]["observations"] == 2 and saved["u"]["confusion"]["sub"] == {} and saved["v"]["stats"]["corrections"] == 1
    assert saved["u"]["reranker"]["weights"] == list(personal.FIRST_WEIGHTS)

    other = personal.Personal(spark, str(tmp_path / "q"))
    other.take_in(own.export(), 0, merged=False)
    assert {r["user"]: json.loads(r["json"]) for r in other.export().collect()} == saved  # a round trip
    other.take_in(own.export(), 1)
    twice = {r["user"]: json.loads(r["json"]) for r in other.export().collect()}
    assert twice["u"]["stats"]["corrections"] == 4 and twice["u"]["learnList"] == ["obsid"] and twice["u"]["reranker"] == saved["u"]["reranker"]
    other.take_in(own.export(), 2, merged=False)
    assert {r["user"]: json.loads(r["json"]) for r in other.export().collect()} == saved
    bad = spark.createDataFrame([("w", "{garbage:true}"), ("x", None), ("y", '{"learnList": ["A", null, "a"], "stats": {"accepts": 2}}')], "user string, json string")
    assert rows(personal.loaded(bad).select("user", "part", "key", "n")) == [("y", "learn", "a", 1.0), ("y", "stats", "accepts", 2.0)]


def test_resets(spark, tmp_path):
    own = personal.Personal(spark, str(tmp_path / "p"), fan=2)
    batches = [
        [("u", 1, "correct", "ab", "ba"), ("v", 1, "accept", None, None)],
        [("u", 2, "accept", None, None), ("u", 3, "reset", None, None), ("u", 4, "undo", "kept", "x")],
        [("v", 5, "undo", "word", "x"), ("v", 6, "reset-stats", None, None), ("u", 7, "accept", None, None)],
        [("u", 8, "accept", None, None)],
    ]
    for k, batch in enumerate(batches):
        own.learn(personal.learned(spark.createDataFrame(batch, EVENT)), k)
    assert rows(own.view().select("user", "part", "key", "n")) == [("u", "learn", "kept", 1.0), ("u", "stats", "accepts", 2.0), ("u", "stats", "reverts", 1.0), ("v", "learn", "word", 1.0)]
    assert own.view().where("part = 'reset'").count() == 0


def test_learned_stream_and_weights(spark, tmp_path):
    path = str(tmp_path / "feed")
    own = personal.Personal(spark, str(tmp_path / "p"))
    for batch in (EVENTS[:4], EVENTS[4:]):
        feed(spark, path, batch, EVENT)
        own.follow(spark.readStream.schema(EVENT).parquet(path), str(tmp_path / "check")).awaitTermination()
    assert rows(own.view().drop("seq")) == rows(personal.batch_rows(personal.learned(spark.createDataFrame(EVENTS, EVENT))).drop("seq"))
    steps = spark.createDataFrame([("u", 1, "weights", "[1.0, 2.0]"), ("u", 3, "weights", "[5.0, 6.0]"), ("u", 2, "learn", "x")], "user string, seq long, action string, word string")
    own.learn(personal.weight_rows(steps), 10)
    assert json.loads(own.export().where("user = 'u'").first()["json"])["reranker"]["weights"] == [5.0, 6.0]
    saved = own.export().where("user = 'u'").select("json")
    saved.write.text(str(tmp_path / "file"))
    back = files.learned_state(spark, str(tmp_path / "file")).first()
    assert back["learn_list"] == ["obsid"] and back["stats"]["corrections"] == 2.0 and back["confusion"]["seen"] == {"t": 2.0, "h": 2.0, "e": 2.0}
