"""Maintained tables equal those made anew, and a batch writes the lists of touched contexts alone."""

import random
from collections import Counter

from corpusloom.streaming import changes, maintained


def grams(text):
    """(n, w2, w1, w) of one sentence of plain words."""
    words = text.split()
    if not words:
        return []
    padded = ["<s>", "<s>", *words]
    out = [(1, "", "", w) for w in words]
    out += [(2, "", a, b) for a, b in zip(padded, padded[1:])]
    return out + [(3, *t) for t in zip(padded, padded[1:], padded[2:])]


def lists_of(texts, k):
    counts = Counter(g for t in texts.values() for g in grams(t))
    by = {}
    for (n, w2, w1, w), c in counts.items():
        by.setdefault((n, w2, w1), []).append((-c, w))
    return {(*ctx, w, -c, r + 1) for ctx, own in by.items() for r, (c, w) in enumerate(sorted(own)[:k])}, counts


def test_maintained_equals_made_anew(spark, tmp_path):
    rng, texts, words = random.Random(6), {}, [f"w{k}" for k in range(12)]
    state = spark.createDataFrame([], changes.STATE)
    for batch in range(5):
        feed = []
        for seq in range(14 if batch else 40):
            path, op = f"p{rng.randint(0, 15)}", rng.choice(["set", "set", "remove", "rename"]) if batch else "set"
            to = f"p{rng.randint(0, 15)}" if op == "rename" else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) if op == "set" else None
            feed.append((op, path, to, seq))
            if op == "set":
                texts[path] = to
            elif op == "remove":
                texts.pop(path, None)
            elif path in texts and to != path:
                texts[to] = texts.pop(path)
        change = spark.createDataFrame(feed, changes.CHANGE)
        own = maintained.Maintained(spark, str(tmp_path / "m"), k=2, reserve=1, fan=3)  # anew each time, as after a restart
        found = maintained.difference(state, change)
        touched = {tuple(r) for r in maintained.grams(found).select(*maintained.CONTEXT).distinct().collect()}
        for _ in range(2):  # a batch may be replayed
            own.apply(found, batch)
        state = changes.staged(changes.applied(state, change), "test-state")
        want, counts = lists_of(texts, 2)
        assert {tuple(r) for r in own.lists().collect()} == want
        assert {tuple(r)[:4]: r["c"] for r in own.counts().collect()} == counts
        assert {r["w"]: r["df"] for r in own.document_frequency().collect()} == Counter(w for t in texts.values() for w in set(t.split()))
        assert {r["w"]: r["cont"] for r in own.continuation().collect()} == Counter(g[3] for g in counts if g[0] == 2)
        run = own._tops.runs()[-1]
        if run.level == 0:  # not yet merged with others
            written = {tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/m/lists/runs/{run.name}").collect()}
            assert written == touched


def test_no_change_touches_nothing(spark, tmp_path):
    own = maintained.Maintained(spark, str(tmp_path / "m"))
    state = changes.path_counts(spark.createDataFrame([("a", "one two")], "path string, text string"))
    own.apply(maintained.difference(spark.createDataFrame([], changes.STATE), spark.createDataFrame([("set", "a", "one two", 1)], changes.CHANGE)), 0)
    same = maintained.difference(state, spark.createDataFrame([("set", "a", "one two", 1), ("remove", "b", None, 2), ("rename", "x", "y", 3)], changes.CHANGE))
    assert maintained.grams(same).count() == maintained.frequencies(same).count() == 0
    own.apply(same, 1)
    assert own.lists().count() == 7


def test_only_the_named_tables_are_kept(spark, tmp_path):
    state = changes.path_counts(spark.createDataFrame([("a", "One two one two. One three."), ("b", "two three"), ("a", "three")], "path string, text string"))
    assert state.select("path", "n", "w2", "w1", "w").distinct().count() == state.count()  # a path that comes twice adds up
    own = maintained.Maintained(spark, str(tmp_path / "m"), tables=("continuation",))
    own.apply(state, 0)
    own.apply(maintained.difference(state, spark.createDataFrame([("remove", "a", None, 1)], changes.CHANGE)), 1)
    assert sorted(map(tuple, own.continuation().collect())) == [("<s>", 1), ("three", 1), ("two", 1)]
    assert own.lists().count() == own.document_frequency().count() == 0


def test_groups_of_renames_in_one_task(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a group goes over batches
    try:
        feed = [x for i in range(20) for x in (("rename", f"p{i}", f"q{i}", 1), ("set", f"p{i}", "new", 2), ("rename", f"q{i}", f"r{i}", 3))]
        df = spark.createDataFrame(feed, changes.CHANGE)
        paths = spark.createDataFrame([(f"p{i}",) for i in range(0, 20, 2)], "path string")
        got = {r["path"]: (r["kind"], r["source"], r["at"]) for r in changes.resolved(df, paths).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    want = {}
    for i in range(20):
        want |= changes.folded([(1, "rename", f"p{i}", f"q{i}"), (2, "set", f"p{i}", "new"), (3, "rename", f"q{i}", f"r{i}")], {f"p{i}"} if i % 2 == 0 else set())
    assert got == want
