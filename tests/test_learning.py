"""Steps over interactions, over a table and over a stream."""

import json
from datetime import datetime, timedelta

from corpusloom.streaming import learning as G

T = datetime(2024, 1, 1, 10)


def event(user, seq, kind, source=None, target=None, kept=None, shown=None, accepted=None, at=None):
    return (user, seq, at or T + timedelta(seconds=0.1 * seq), kind, source, target, kept, shown, accepted)


EVENTS = [
    event("a", 1, "correct", "teh", "the"), event("a", 2, "undo", "teh", "the"), event("a", 3, "edit"),
    event("a", 4, "correct", "adn", "and"), event("a", 5, "undo", "adn", "and"), event("a", 6, "undo", kept=False),
    event("a", 7, "undo", "xx", "yy"), event("b", 1, "correct", "foo", "for"), event("b", 2, "edit"), event("b", 3, "undo", "foo", "for"),
]
WANT = [("a", 2, "revert", "teh"), ("a", 3, "learn", "teh"), ("a", 5, "revert", "adn"), ("b", 3, "revert", "foo"), ("b", 3, "learn", "foo")]


def test_deferred_learning_over_a_table(spark):
    got = G.folded(spark.createDataFrame(EVENTS, G.EVENT), G.deferred_step, G.deferred_idle)
    assert sorted(map(tuple, got.collect())) == sorted(WANT)
    late = [event("c", 1, "correct", "p", "q"), event("c", 2, "undo", "p", "q"), event("c", 3, "edit", kept=False, at=T + timedelta(seconds=9))]
    assert [r["action"] for r in G.folded(spark.createDataFrame(late, G.EVENT), G.deferred_step, G.deferred_idle).collect()] == ["revert", "learn"]
    assert G.folded(spark.createDataFrame([], G.EVENT), G.deferred_step, G.deferred_idle).count() == 0


def test_only_24_corrections_are_remembered():
    state = {}
    for k in range(30):
        state, _ = G.deferred_step(state, {"kind": "correct", "source": f"s{k}", "target": f"t{k}", "at": T, "kept": None})
    old = G.deferred_step(state, {"kind": "undo", "source": "s5", "target": "t5", "at": T, "kept": None})
    new = G.deferred_step(state, {"kind": "undo", "source": "s6", "target": "t6", "at": T, "kept": None})
    assert old[1] == [] and new[1] == [("revert", "s6")]


def test_one_shot_reverts(spark):
    got = G.one_shot_reverts(spark.createDataFrame(EVENTS, G.EVENT))
    assert sorted(map(tuple, got.collect())) == [("a", 2, "teh", "the"), ("a", 5, "adn", "and")]


def test_weights_and_streaks_in_order(spark):
    shown = [[1.0] * 8, [0.0] * 7 + [3.0]]
    days = [T + timedelta(days=d) for d in (0, 0, 1, 3, 4)]
    rows = [event("u", k, "accept", shown=shown, accepted=1, at=t) for k, t in enumerate(days)]
    df = spark.createDataFrame(rows, G.EVENT)
    assert [r["word"] for r in sorted(G.folded(df, G.streak_step).collect(), key=lambda r: r["seq"])] == ["1", "1", "2", "1", "2"]
    weights = [json.loads(r["word"]) for r in sorted(G.folded(df, G.weights_step).collect(), key=lambda r: r["seq"])]
    assert weights[0][7] > 0 and weights[0][0] < 1 and weights[-1][7] >= weights[0][7]


def test_stream_equals_the_table(spark, tmp_path):
    spark.createDataFrame(EVENTS, G.EVENT).coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(G.EVENT).parquet(str(tmp_path / "ev"))
    q = G.followed(stream, G.deferred_step).writeStream.format("memory").queryName("learned").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = [w for w in WANT if w != ("b", 3, "learn", "foo")]  # that one waits for the user's silence
    assert sorted(map(tuple, spark.sql("select * from learned").collect())) == sorted(want)


def test_events_without_a_time():
    empty = {"kept": None, "shown": None, "accepted": None, "at": None}
    state, _ = G.deferred_step({}, {"kind": "correct", "source": "a", "target": "b", **empty})
    state, rows = G.deferred_step(state, {"kind": "undo", "source": "a", "target": "b", **empty})
    assert rows == [("revert", "a")]
    assert G.deferred_step(state, {"kind": "edit", "source": None, "target": None, **empty, "kept": False, "at": T})[1] == []
    assert G.deferred_step(state, {"kind": "edit", "source": None, "target": None, **empty})[1] == [("learn", "a")]
    assert G.streak_step({"last": "2024-01-01", "run": 2}, {"kind": "accept", **empty}) == ({"last": "2024-01-01", "run": 2}, [])
