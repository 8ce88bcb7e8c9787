"""The folder of notes as a source, a stream and a sink."""

import os
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ngram
from corpusloom.sources.vault import Vault, as_changes, removed, with_tags
from corpusloom.streaming import changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(Vault)
    (tmp_path / "vault" / "sub").mkdir(parents=True)
    (tmp_path / "vault" / "a.md").write_text("one two")
    (tmp_path / "vault" / "sub" / "b.md").write_text("three")
    (tmp_path / "vault" / "c.txt").write_text("no note")
    (tmp_path / "vault" / "bad.md").write_bytes(b"x \xff y")
    return tmp_path / "vault"


def test_read(spark, folder):
    got = spark.read.format("vault").load(str(folder))
    assert rows(got.select("path", "text")) == [("a.md", "one two"), ("bad.md", "x � y"), ("sub/b.md", "three")]
    (folder / "empty").mkdir()
    assert spark.read.format("vault").load(str(folder / "empty")).count() == 0


def test_a_stream_neither_loses_nor_repeats_across_restarts(spark, folder, tmp_path):
    seen = []

    def run():
        stream = spark.readStream.format("vault").load(str(folder))
        query = stream.writeStream.foreachBatch(lambda df, k: seen.extend(tuple(r) for r in df.select("path", "text").collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        out = sorted(seen)
        seen.clear()
        return out

    assert run() == [("a.md", "one two"), ("bad.md", "x � y"), ("sub/b.md", "three")]
    assert run() == []
    time.sleep(0.01)
    (folder / "a.md").write_text("one two again")
    (folder / "d.md").write_text("new")
    os.utime(folder / "d.md", (1, 1))  # moved in with an old date
    assert run() == [("a.md", "one two again"), ("d.md", "new")]
    (folder / "d.md").unlink()
    assert run() == []


def test_offsets_of_one_tick(tmp_path):
    from corpusloom.sources import vault

    stream = vault.VaultStream(str(tmp_path))
    names = lambda start, end: [n for p in stream.partitions(start, end) for n in p.value]
    found = [(5, "a.md"), (7, "b.md")]
    vault_notes, vault._notes = vault._notes, lambda folder: iter(found)
    try:
        first = stream.latestOffset()
        assert names(stream.initialOffset(), first) == ["a.md", "b.md"]
        found.append((7, "late.md"))  # the same tick
        second = stream.latestOffset()
        assert names(first, second) == ["late.md"] and names(second, second) == []
        found[0] = (9, "a.md")
        assert names(second, stream.latestOffset()) == ["a.md"]
    finally:
        vault._notes = vault_notes


def test_the_corpus_follows_a_vault(spark, folder, tmp_path):
    state = changes.CorpusState(spark, str(tmp_path / "state"), buckets=2)
    stream = as_changes(spark.readStream.format("vault").load(str(folder)))
    changes.follow(stream, state, str(tmp_path / "check")).awaitTermination()
    (folder / "sub" / "b.md").unlink()
    notes = spark.read.format("vault").load(str(folder))
    state.apply(removed(notes, state.read().select("path"), 1), 5)
    want = ngram.count(notes.select("path", "text"))
    assert rows(changes.totals(state.read()).uni) == rows(want.uni)


@pytest.mark.parametrize(
    "note,tags,want",
    [
        (b"body", ["b", "a"], b"---\ntags:\n  - a\n  - b\n---\nbody"),
        (b"body", [], b"body"),
        (b"", ["a"], b"---\ntags:\n  - a\n---\n"),
        (b"---\ntitle: x\ntags: [old, b]\nz: 1\n---\nbody --- \n", ["n"], b"---\ntitle: x\ntags:\n  - n\nz: 1\n---\nbody --- \n"),
        (b"---\ntags:\n  - old\n- older\nz: 1\n---\n\nbody", ["n", "n"], b"---\ntags:\n  - n\nz: 1\n---\n\nbody"),
        (b"---\r\ntags: old\r\nz: 1\r\n---\r\nbody\r\n", ["n"], b"---\r\ntags:\r\n  - n\r\nz: 1\r\n---\r\nbody\r\n"),
        (b"---\ntags: old\n---\nbody", [], b"---\n---\nbody"),
        (b"---\nz: 1\n---", ["n"], b"---\nz: 1\ntags:\n  - n\n---"),
        (b"---\nno end", ["n"], b"---\ntags:\n  - n\n---\n---\nno end"),
        (b"\xef\xbb\xbfbody\xff", ["n"], b"\xef\xbb\xbf---\ntags:\n  - n\n---\nbody\xff"),
    ],
)
def test_only_tags_change(note, tags, want):
    assert with_tags(note, tags) == want
    assert with_tags(want, tags) == want


def test_write(spark, folder):
    (folder / "a.md").write_bytes(b"---\r\nkeep: 1\r\n---\r\nbody \xff bytes\r\n")
    before = {f: (folder / f).read_bytes() for f in ("bad.md", "sub/b.md")}
    found = spark.read.format("vault").load(str(folder)).select("path", "mtime")
    tags = spark.createDataFrame([("a.md", ["x", None]), ("bad.md", None), ("gone.md", ["x"])], "path string, tags array<string>")
    plan = tags.join(found, "path", "left")
    plan.write.format("vault").mode("append").save(str(folder))
    assert (folder / "a.md").read_bytes() == b"---\r\nkeep: 1\r\ntags:\r\n  - x\r\n---\r\nbody \xff bytes\r\n"
    assert {f: (folder / f).read_bytes() for f in before} == before and not (folder / "gone.md").exists()
    assert not [f for f in os.listdir(folder) if f.endswith(".tmp")]
    late = spark.createDataFrame([("a.md", ["late"])], "path string, tags array<string>").withColumn("mtime", F.timestamp_seconds(F.lit(5)))
    late.write.format("vault").mode("append").save(str(folder))
    assert b"late" not in (folder / "a.md").read_bytes()
