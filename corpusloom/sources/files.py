"""Readers and writers: notes, word lists, counts, packed models and learned state."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ngram import Counts

# fixed values: the magic number of a word-list file
WORD_LIST = 0x57444C31

# fixed values: the maps of a saved confusion model, beside its number of observations
CONFUSION = ("sub", "del", "ins", "trans", "seen", "subCtx", "seenCtx")
STATE = f"version int, confusion struct<{', '.join(f'{k}: map<string,double>' for k in CONFUSION)}, observations: double>, reranker struct<weights:array<double>,updates:int>, learnList array<string>, stats map<string,double>, updatedAt double"


def notes(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(path, mtime, text) of all notes below a folder; unreadable files are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def note_parts(rows: DataFrame) -> DataFrame:
    """notes with their title (the file's name) and front matter, its tags and aliases as arrays."""
    title = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.md\z", "")
    front = F.regexp_extract("text", r"(?s)^\x{FEFF}?---\r?\n(.*?)\r?\n---", 1)

    def listed(name: str):
        inline = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[?([^\]\n]*)\]?[ \t]*$", 1)
        block = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[^\n]*\n?)*)", 1)
        both = F.concat(F.split(inline, r"[,\s]+"), F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-[ \t]*", "")))
        return F.filter(F.transform(both, lambda x: F.regexp_replace(x, r"""^["'#]+|["']+\z""", "")), lambda x: x != "")

    return rows.select("path", "mtime", title.alias("title"), X.strip_frontmatter("text").alias("text"), listed("tags").alias("tags"), listed("aliases").alias("aliases"))


def write_counts(counts: Counts, path: str) -> None:
    for name in ("uni", "bi", "tri"):
        getattr(counts, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_counts(spark: SparkSession, path: str) -> Counts:
    return Counts(*(spark.read.parquet(f"{path}/{name}") for name in ("uni", "bi", "tri")))


def write_packed(packed: DataFrame, path: str) -> None:
    """A packed model, clustered by context so that a lookup reads few row groups."""
    packed.repartitionByRange("w1", "w2").sortWithinPartitions("w1", "w2", "rank").write.mode("overwrite").parquet(path)


def read_global(spark: SparkSession, packed: str | None = None, text: str | None = None) -> tuple[str, DataFrame | None]:
    """("packed" | "text" | "none", table): a packed model before a text corpus before nothing."""
    for kind, path, reader in (("packed", packed, spark.read.parquet), ("text", text, spark.read.text)):
        if path:
            try:
                return kind, reader(path)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
    return "none", None


def word_list_bytes(words: list[str]) -> bytes:
    own = sorted({w.lower() for w in words})
    blob = "\n".join(own).encode()
    return struct.pack("<III", WORD_LIST, len(own), len(blob)) + blob


def parse_word_list(data: bytes) -> list[str]:
    """The words of a word-list file; none where the header does not fit."""
    if len(data) < 12:
        return []
    magic, _, size = struct.unpack("<III", data[:12])
    if magic != WORD_LIST or 12 + size > len(data):
        return []
    return [w for w in data[12 : 12 + size].decode("utf-8", "replace").split("\n") if w]


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of word-list files; files with a wrong header give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(parse_word_list(data), pa.string())], ["word"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string")


def learned_state(spark: SparkSession, path: str) -> DataFrame:
    """Personalisation state, put right: a malformed file counts as empty, non-strings leave the learn list."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", STATE, {"mode": "PERMISSIVE"}).alias("s")).select("s.*")
    seen = F.when(F.col("confusion.observations").isNotNull(), F.create_map(F.lit(""), F.col("confusion.observations")))
    kinds = F.map_from_arrays(F.array(*map(F.lit, (*CONFUSION, "observations"))), F.array(*(F.col(f"confusion.{k}") for k in CONFUSION), seen))
    return parsed.select(
        F.coalesce("version", F.lit(1)).alias("version"),
        F.map_filter(kinds, lambda _, v: v.isNotNull()).alias("confusion"),
        "reranker",
        F.coalesce(F.filter("learnList", lambda w: w.isNotNull()), F.array().cast("array<string>")).alias("learn_list"),
        F.coalesce("stats", F.create_map().cast("map<string,double>")).alias("stats"),
        F.timestamp_millis(F.coalesce("updatedAt", F.lit(0.0)).cast("long")).alias("updated_at"),
    )


def merge_states(states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(confusion(kind, key, n), learn list(word), stats(name, n)): counts add up, lists unite."""
    kinds = states.select(F.explode("confusion").alias("kind", "counts")).select("kind", F.explode("counts").alias("key", "n"))
    words = states.select(F.explode("learn_list").alias("word")).distinct()
    stats = states.select(F.explode("stats").alias("name", "n"))
    return kinds.groupBy("kind", "key").agg(F.sum("n").alias("n")), words, stats.groupBy("name").agg(F.sum("n").alias("n"))
