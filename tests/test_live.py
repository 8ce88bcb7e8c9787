"""Change feeds, sources and the façade."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import currency as C
from corpusloom.functions import markup as M
from corpusloom.operators import ngram
from corpusloom.plans.engine import Engine, Settings
from corpusloom.sources import files
from corpusloom.streaming import changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stream_equals_a_rebuild(spark, tmp_path):
    batches = [
        [("set", "a.md", "one two. three", 1), ("set", "b.md", "one four", 2)],
        [("set", "a.md", "five two", 3), ("set", "a.md", "five six", 4), ("rename", "b.md", "c.md", 5)],
        [("remove", "a.md", None, 6), ("set", "d.md", "one", 7)],
    ]
    state = changes.CorpusState(spark, str(tmp_path / "state"))
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, changes.CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        feed = spark.readStream.schema(changes.CHANGE).parquet(str(tmp_path / "feed"))
        changes.follow(feed, state, str(tmp_path / "check")).awaitTermination()
    got = changes.totals(state.read())
    want = ngram.count(spark.createDataFrame([("c.md", "one four"), ("d.md", "one")], "path string, text string"))
    assert rows(got.uni) == rows(want.uni) and rows(got.tri) == rows(want.tri)
    again = rows(state.read())
    state.apply(spark.createDataFrame(batches[2], changes.CHANGE), 2)
    assert rows(state.read()) == again


def rebuilt(spark, texts):
    return rows(changes.totals(changes.path_counts(spark.createDataFrame(sorted(texts.items()), "path string, text string"))).tri)


@pytest.mark.parametrize("batch", [[("rename", "a", "b", 1), ("set", "b", "new b", 2)], [("set", "a", "new a", 1), ("rename", "a", "b", 2)], [("rename", "a", "b", 1), ("rename", "b", "c", 2)], [("rename", "x", "a", 1), ("set", "x", "late", 2)], [("rename", "a", "a", 1), ("remove", "b", None, 2)], [("rename", "a", "b", 1), ("rename", "c", "a", 2), ("rename", "b", "c", 3)]])
def test_changes_of_one_path_in_a_batch(spark, batch):
    texts = {"a": "one two", "b": "three four five", "c": "six"}
    state = changes.path_counts(spark.createDataFrame(sorted(texts.items()), "path string, text string"))
    got = changes.applied(state, spark.createDataFrame(batch, changes.CHANGE))
    for op, path, text, _ in batch:
        if op == "set":
            texts[path] = text
        elif op == "remove":
            texts.pop(path, None)
        elif path in texts and text != path:
            texts[text] = texts.pop(path)
    assert rows(changes.totals(got).tri) == rebuilt(spark, texts)


def test_random_changes_equal_a_rebuild_across_a_restart(spark, tmp_path):
    rng, texts = random.Random(3), {}
    for batch in range(4):
        feed = []
        for seq in range(40):
            path, op = f"p{rng.randint(0, 9)}", rng.choice(["set", "set", "remove", "rename"])
            to = f"p{rng.randint(0, 9)}" if op == "rename" else f"text {rng.randint(0, 99)} of {path}" if op == "set" else None
            feed.append((op, path, to, seq))
            if op == "set":
                texts[path] = to
            elif op == "remove":
                texts.pop(path, None)
            elif path in texts and to != path:
                texts[to] = texts.pop(path)
        state = changes.CorpusState(spark, str(tmp_path / "s"), buckets=3)  # anew for each batch, as after a restart
        assert state.version == batch
        for _ in range(2):  # a batch may be replayed
            state.apply(spark.createDataFrame(feed, changes.CHANGE), batch)
        assert rows(changes.totals(state.read()).tri) == rebuilt(spark, texts)


def test_corpus_state_is_compacted(spark, tmp_path):
    state = changes.CorpusState(spark, str(tmp_path / "s"), buckets=2)
    state.log.fan = 2
    for batch in range(5):
        op = ("remove", "a", None, 1) if batch == 3 else ("set", f"{'ab'[batch % 2]}", f"text {batch}", 1)
        state.apply(spark.createDataFrame([op], changes.CHANGE), batch)
    assert len(state.log.runs()) <= 3 and state.version == 5
    assert rows(changes.totals(state.read()).tri) == rebuilt(spark, {"a": "text 4", "b": "text 1"})
    state.log.compact()
    assert rows(changes.totals(state.read()).tri) == rebuilt(spark, {"a": "text 4", "b": "text 1"})


def test_live_counters_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 10:05:00", "view", 2.5), (1, "2024-01-01 10:05:00", "view", 2.5), (2, "2024-01-01 10:50:00", "view", 1.0)], "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = changes.live_counters(stream).writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["saved"]) for r in spark.sql("select * from live").collect()] == [(2, 3)]


def test_files(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "Note.md").write_text("---\ntags: [Alpha, beta]\naliases:\n  - Nick\n---\nBody text")
    (tmp_path / "n" / "skip.txt").write_text("x")
    (tmp_path / "w.bin").write_bytes(files.word_list_bytes(["Beta", "alpha"]))
    (tmp_path / "bad.bin").write_bytes(b"nope")
    (tmp_path / "s.json").write_text('{"version": 2, "learnList": ["a", null], "confusion": {"sub": {"a>b": 2}}, "stats": {"accepts": 3}}')
    (tmp_path / "g.json").write_text("{garbage:true}")
    note = files.note_parts(files.notes(spark, str(tmp_path / "n"))).first()
    assert (note["title"], note["text"], note["tags"], note["aliases"]) == ("Note", "Body text", ["Alpha", "beta"], ["Nick"])
    assert rows(files.word_list(spark, str(tmp_path / "w.bin"))) == [("alpha",), ("beta",)]
    assert files.word_list(spark, str(tmp_path / "bad.bin")).count() == 0
    good, bad = files.learned_state(spark, str(tmp_path / "s.json")), files.learned_state(spark, str(tmp_path / "g.json")).first()
    assert good.first()["learn_list"] == ["a"] and bad["learn_list"] == [] and bad["stats"] == {}
    kinds, words, stats = files.merge_states(good.unionByName(good))
    assert rows(kinds) == [("sub", "a>b", 4.0)] and rows(words) == [("a",)] and rows(stats) == [("accepts", 6.0)]
    counts = ngram.count(spark.createDataFrame([("x", "one two")], "path string, text string"))
    files.write_counts(counts, str(tmp_path / "c"))
    assert rows(files.read_counts(spark, str(tmp_path / "c")).bi) == rows(counts.bi)
    assert files.read_global(spark, packed=str(tmp_path / "none"))[0] == "none"


def test_engine(spark):
    engine = Engine(spark, Settings(min_count=1))
    with pytest.raises(ValueError):
        engine.model
    engine.load_global_text(spark.createDataFrame([("the bank rose. the bank fell. the bank rose",)], "text string"))
    words = spark.createDataFrame([("bank",), ("zzz",)], "w string")
    assert rows(engine.document_frequencies(words)) == [("bank", None), ("zzz", None)]
    engine.rebuild_personal(spark.createDataFrame([("p", "the tank rose. the tank")], "path string, text string"))
    contexts = spark.createDataFrame([(None, "the")], "w2 string, w1 string")
    assert [r["w"] for r in engine.predict(contexts, 2).orderBy("rank").collect()] == ["bank", "tank"]
    engine.change(spark.createDataFrame([("remove", "p", None, 1)], changes.CHANGE))
    assert rows(engine.document_frequencies(words)) == [("bank", 0), ("zzz", 0)]
    assert rows(engine.known_words(words)) == [("bank",)]


def test_engine_learns_and_forgets(spark, tmp_path):
    from dataclasses import replace

    from corpusloom.streaming import personal

    words = "the cob rose. the lob fell. the cob fell. the job"
    engine = Engine(spark, Settings(min_count=1), user="u", own=personal.Personal(spark, str(tmp_path / "p")))
    engine.load_global_text(spark.createDataFrame([(words,)], "text string"))
    slips = [("u", k, "correct", "kat", "cat") for k in range(400)] + [("u", 500, "undo", "lobb", "lob"), ("v", 1, "undo", "cobb", "cob")]
    events = spark.createDataFrame(slips, "user string, seq long, kind string, source string, target string")
    asked = spark.createDataFrame([(1, "kob", "kob", None, "the"), (2, "lobb", "lobb", None, "the")], "query_id long, typed string, token string, w2 string, w1 string")
    cost = lambda: {r["w"]: r["cost"] for r in engine.candidates(asked).where("query_id = 1").collect()}
    reason = lambda: {r["query_id"]: r["reason"] for r in engine.decide(asked).collect()}
    assert engine.costs() is None and "cob" not in cost() and reason()[2] != "learn-listed"
    assert engine.record(events, 0) and not engine.record(events, 0)
    assert cost()["cob"] < 2 and reason()[2] == "learn-listed"
    assert "learnList" in engine.personalization_state().first()["json"]
    engine.settings = replace(engine.settings, personalized=False)
    assert engine.costs() is None and reason()[2] != "learn-listed" and not engine.record(events, 1)
    engine.settings = replace(engine.settings, personalized=True)
    assert engine.costs() is not None  # what is stored stays
    engine.lexicon = spark.createDataFrame([("kob",)], "w string")
    assert reason()[1] == "real-word-rare"
    log = "doc string, seq long, text string"
    engine.set_active_documents(spark.createDataFrame([("d", 1, "lob lob lob")], log), spark.createDataFrame([("d", 2, "lob")], log))
    rows_ = spark.createDataFrame([("d", None, "the", "lob"), ("e", None, "the", "lob")], "doc string, w2 string, w1 string, w string")
    lifted = {r["doc"]: r["log_prob"] for r in engine.log_prob_in(rows_).collect()}
    assert lifted["d"] > lifted["e"]
    menu = engine.suggestions(spark.createDataFrame([(1, "co", None, "the")], "query_id long, typed string, w2 string, w1 string"))
    assert [r["insert"] for r in menu.orderBy("position").collect()][0] == "cob"
    assert engine.rarities(spark.createDataFrame([("the",), ("zzz",)], "w string").coalesce(1)).where("w = 'zzz'").first()["rarity"] == 0.9


def test_sections():
    text = "# Top\n\nOne paragraph about red foxes.\n\nShopping list\n- apples and pears\n- three more things\n\n> quoted words stand right here\n\n| a b c | words there |\n|---|---|\n| more words here | and |\n\n```\ncode not kept here at all\n```\n\nUnder line\n---\nlast paragraph with several words"
    got = [(s[4], s[5], text[s[0] : s[1]].split("\n")[0]) for s in M.segments(text)]
    assert got == [("paragraph", "Top", "One paragraph about red foxes."), ("list", "Top", "Shopping list"), ("quote", "Top", "> quoted words stand right here"), ("table", "Top", "| a b c | words there |"), ("paragraph", "Under line", "last paragraph with several words")]
    assert M.segments(None) == M.segments("") == []


def test_links():
    targets = {"red fox": ("Red Fox", ""), "fox": ("Fox", ""), "the": ("The", ""), "red fox den": ("Den", "")}
    assert [x[2:] for x in M.link_spans("The red fox den, a red fox and [[fox]] `fox` fox", targets)] == [("red fox den", "Den"), ("red fox", "Red Fox"), ("fox", "Fox")]
    assert M.link_spans("a fox", targets, exclude="FOX") == []
    assert M.anchor_span("the big red fox runs", {"red", "fox", "runs"}) == (8, 20)
    assert M.anchor_span("a cat", {"cat"}) is None


def test_currency(spark):
    cases = [("pay 1000 dollars", C.style(), (4, "$1,000")), ("pay 1000.5 euro", C.style("period"), (4, "€10.005")), ("-20 eur", C.style(euro_after=True), (0, "-20 €")), ("$1000", C.style(), (0, "$1,000")), ("$5", C.style(), None), ("1000 zł", C.style(), None), ("5 pounds", C.style(use_code=True), (0, "5 GBP")), ("x5 usd", C.style(), None), ("5 apples", C.style(), None), ("1,5 kr", C.style("none"), None), ("1,5 sek", C.style("none"), (0, "1,50 kr")), ("-$1234.5", C.style(), (0, "-$1,234.50")), ("5 R$", C.style(), (0, "R$5")), ("1.5 usd", C.style("none"), (0, "$1.50")), ("", C.style(), None)]
    for before, own, expected in cases:
        got = spark.createDataFrame([(before,)], "b string").select(C.detected(F.col("b"), own).alias("x")).first()["x"]
        assert (tuple(got) if got else None) == expected, before


def test_currency_prefix(spark):
    row = spark.createDataFrame([("20 doll", "eu", "")], "b string, p string, e string").select(C.proposed(F.col("b")).alias("x"), C.is_prefix(F.col("p")).alias("p"), C.is_prefix(F.col("e")).alias("e")).first()
    assert tuple(row["x"]) == (0, "$20", "$") and row["p"] and not row["e"]
