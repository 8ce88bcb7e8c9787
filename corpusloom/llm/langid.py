"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; characters that are no letters count as spaces. Every
n-gram of 1 to ORDER characters is hashed to one of FEATURES; n-grams of
spaces alone are skipped. The log-probability matrix (FEATURES x languages) is
broadcast; a text's scores are sums of its rows, gathered by numpy for a block
of texts at a time. The score is the posterior of the language predicted.

Languages are dealt to blocks of about LANGUAGES by a hash, and only one block's
matrix is loaded at a time. Where there are several, texts pass through the
blocks one after the other with the best language so far and the sum of all.

The model learns from text and language of rows whose crc32 remainder by 4 is
not 2: about EXAMPLES of each language at most, chosen by a hash of their id.
All else covers whole texts of all rows. A null language teaches nothing.

A null or empty text and one without a letter get `und` and score 0. Without
anything learned every text does. On equal scores the first language in
alphabetic order wins. Repeated rows are predicted each, and rows with a null
id too. Texts of any length are read whole. Extra columns are ignored; an empty
table gives an empty result. A task's counts take FEATURES numbers for each of
at most FLUSH languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.texts import blocks
from corpusloom.llm.toxicity import remainder
from corpusloom.session import staged

FEATURES = 1 << 15
ORDER = 3
EXAMPLES = 2000
SMOOTHING = 0.5
LANGUAGES = 400  # to a block, about; its matrix has 52 MB
FLUSH = 64
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each n-gram, where each text's begin, whether each text has a letter); every text has one n-gram at least."""
    gap = " " * ORDER
    lowered = [(t or "").lower() + gap for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters()[codes]
    codes = np.where(known, codes, 32).astype(np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(codes)
    features, hashed = np.zeros((n, ORDER), np.int32), np.zeros(n, np.uint32)
    blank = np.ones(n, bool)
    for k in range(ORDER):
        part = np.full(n, 32, np.uint32)
        part[: n - k] = codes[k:]
        hashed = (hashed ^ part * np.uint32(_MULTIPLIERS[k % 3])) * np.uint32(0x27D4EB2F) + np.uint32(k)
        blank &= part == 32
        mixed = hashed ^ (hashed >> np.uint32(15))
        features[:, k] = np.where(blank, FEATURES, (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15))
    counts = np.concatenate([np.zeros(1, np.int64), np.cumsum(known)])
    return features, starts, counts[ends] > counts[starts]


@dataclass
class Block:
    languages: list[str]
    table: np.ndarray  # (FEATURES + 1, languages), the last row zero
    prior: np.ndarray

    def best(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, its log-probability, sum of all against it, whether it has a letter) of each text."""
        features, starts, lettered = grams(texts)
        total = np.tile(self.prior, (len(texts), 1))
        for low in range(0, len(self.languages), 8):  # memory stays the same however many languages
            part = self.table[:, low : low + 8]
            for k in range(ORDER):
                total[:, low : low + 8] += np.add.reduceat(part[features[:, k]], starts, axis=0)
        best = total.argmax(axis=1)
        top = total.max(axis=1)
        return [self.languages[b] for b in best.tolist()], top, np.exp(total - top[:, None]).sum(axis=1), lettered


Found = tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]


def joined(one: Found, two: Found) -> Found:
    """What two blocks found together; of equal languages the first in the alphabet."""
    langs, top, mass, lettered = one
    others, top_two, mass_two, also = two
    later = np.array([b > a or (b == a and (x is None or y < x)) for x, y, a, b in zip(langs, others, top.tolist(), top_two.tolist())], bool)
    high = np.maximum(top, top_two)
    mass = mass * np.exp(top - high) + mass_two * np.exp(top_two - high)
    return [y if z else x for x, y, z in zip(langs, others, later.tolist())], high, mass, lettered | also


def nothing(n: int) -> Found:
    return [None] * n, np.full(n, -1e300), np.zeros(n), np.zeros(n, bool)


def named(found: Found) -> tuple[list[str], np.ndarray]:
    """(language, posterior) of each text."""
    langs, _, mass, lettered = found
    known = [x is not None and y for x, y in zip(langs, lettered.tolist())]
    return [x if y else UNKNOWN for x, y in zip(langs, known)], np.where(known, 1 / np.maximum(mass, 1), 0.0)


@dataclass
class Model:
    """Counts of n-grams by language: counts(block, lang, n, counts)."""

    counts: DataFrame
    blocks: int

    @cached_property
    def examples(self) -> int:
        return self.counts.agg(F.sum("n")).first()[0] or 0

    @property
    def languages(self) -> list[str]:
        return sorted(r["lang"] for r in self.counts.select("lang").collect())

    def block(self, k: int) -> Block:
        rows = sorted(self.counts.where(F.col("block") == k).collect(), key=lambda r: r["lang"])
        table = np.zeros((FEATURES + 1, len(rows)), np.float32)
        for c, r in enumerate(rows):
            counts = np.frombuffer(r["counts"], np.int64)[:FEATURES] + SMOOTHING
            table[:FEATURES, c] = np.log(counts / counts.sum())
        return Block([r["lang"] for r in rows], table, np.array([np.log(r["n"] / self.examples) for r in rows]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = nothing(len(texts))
        for k in range(self.blocks):
            if (own := self.block(k)).languages and texts:
                found = joined(found, own.best(texts))
        return named(found)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count n-grams of the sample by language; a language's counts are FEATURES numbers a task."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, 4) != 2))
    usable = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shares = staged(usable.groupBy("lang").count().select(F.col("lang").alias("l"), (F.least(F.lit(1.0), EXAMPLES / F.col("count")) * (1 << 20)).alias("most")), "languages")
    number = -(-shares.count() // LANGUAGES)
    rows = usable.join(shares, usable["lang"] == shares["l"]).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, found in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([seen[lang]], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["lang", "n", "counts"])
            totals.clear()
            seen.clear()

        for block in blocks(batches):
            features, starts, _ = grams(block["text"])
            for lang, low, high in zip(block["lang"], starts, [*starts[1:], len(features)]):
                if lang not in totals and len(totals) == FLUSH:
                    yield from given()
                totals.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
                totals[lang] += np.bincount(features[low:high].ravel(), minlength=FEATURES + 1)
                seen[lang] = seen.get(lang, 0) + 1
        yield from given()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"lang": table.column("lang").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "lang string, n long, counts binary"
    # sorted by language, so a task's table is given out once a language, not once a change of language
    found = rows.select("text", "lang").repartition(8).sortWithinPartitions("lang").mapInArrow(count, kind).groupBy("lang").applyInArrow(add, kind)
    return Model(staged(found.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(max(1, number)))), "language-counts"), number)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    spark = docs.sparkSession
    kind = "id long, text string, lang string, top double, mass double, lettered boolean"
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.select("*", F.lit(None).cast("string").alias("lang"), F.lit(-1e300).alias("top"), F.lit(0.0).alias("mass"), F.lit(False).alias("lettered"))

    def through(shared, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, most=1 << 20):
                found = block["lang"], np.array(block["top"]), np.array(block["mass"]), np.array(block["lettered"], bool)
                if shared is not None and shared.value.languages:
                    found = joined(found, shared.value.best(block["text"]))
                ids = pa.array(block["id"], pa.int64())
                if last:
                    langs, scores = named(found)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(block["text"], pa.string()), pa.array(found[0], pa.string()), *map(pa.array, found[1:])], ["id", "text", "lang", "top", "mass", "lettered"])

        return run

    for k in range(model.blocks - 1):
        shared = spark.sparkContext.broadcast(model.block(k))
        own = staged(own.mapInArrow(through(shared, False), kind), "languages-so-far")
        shared.unpersist()
    last = spark.sparkContext.broadcast(model.block(model.blocks - 1)) if model.blocks else None
    return own.mapInArrow(through(last, True), "doc_id long, lang_pred string, score double")
