"""Counts of n-grams whose partial sums are shuffled as sorted blocks of lines, a third of the bytes of a row for each.

A task adds up what it meets, FILL rows at a time, and writes a row for each of
PARTS hash parts: a line per n-gram, its words and sums parted by spaces. Words
hold no white space, as that is what texts are cut at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lists as L
from corpusloom.session import bound_batches

PARTS = 4096  # of one hash each, so that none holds more than its share whatever the words
FILL = 1_000_000
BLOCK = "part int, grams string"


def part_of(*names: str) -> Column:
    return F.pmod(F.crc32(F.concat_ws(" ", *names)), F.lit(PARTS)).cast("int")


def _packed(names: list[str], sums: list[str]):
    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(batches).group_by(["part", *names], use_threads=False).aggregate([(s, "sum") for s in sums])
        own = own.sort_by([(n, "ascending") for n in ("part", *names)])
        line = pc.binary_join_element_wise(*(own[n] for n in names), *(own[f"{s}_sum"].cast(pa.string()) for s in sums), " ")
        return _lines(own["part"].to_numpy(), line.combine_chunks())

    return _filled(block, lambda batch: batch.num_rows)


def _filled(block, size):
    """Blocks of as many batches as come to FILL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += size(batch)
            if n >= FILL:
                yield from block(held).to_batches()
                held, n = [], 0
        if held:
            yield from block(held).to_batches()

    return run


def _lines(part: np.ndarray, line: pa.Array) -> pa.Table:
    """A block of lines in the order of their parts."""
    own, first = np.unique(part, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(part)), pa.int32()), line)
    return pa.table({"part": pa.array(own, pa.int32()), "grams": pc.binary_join(lists, "\n")})


def _pairs(batches: list[pa.RecordBatch]) -> pa.Table:
    """The pairs of words of sentences, of which two markers begin each."""
    texts = pa.chunked_array([b.column(0) for b in batches]).combine_chunks()
    coded = texts.flatten().dictionary_encode()
    words = pa.concat_arrays([pa.array([L.SOS]), coded.dictionary.cast(pa.string())])
    ids = coded.indices.to_numpy().astype(np.int64) + 1
    sizes = texts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.append(0, ids[:-1])[: len(ids)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    keys, n = np.unique(np.append(before * len(words) + ids, np.zeros(len(texts), np.int64)), return_counts=True)
    one, two = np.divmod(keys, len(words))
    hashes = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], dtype=np.int64)
    part = (hashes[one] * 31 + hashes[two]) % PARTS
    order = np.argsort(part, kind="stable")  # a word's pairs stay together
    line = pc.binary_join_element_wise(words.take(pa.array(one[order])), words.take(pa.array(two[order])), pa.array(n[order]).cast(pa.string()), " ")
    return _lines(part[order], line)


def _opened(blocks: DataFrame, names: list[str], sums: list[str]) -> DataFrame:
    """(part, names, sums) of blocks, added up where they meet."""
    each = blocks.repartition("part").select("part", F.explode(F.split("grams", "\n")).alias("g"))
    field = lambda i: F.substring_index(F.substring_index("g", " ", i + 1), " ", -1)  # noqa: E731  # of bytes, where split() makes strings of Java
    columns = [field(i).alias(n) for i, n in enumerate(names)] + [field(len(names) + i).cast("long").alias(s) for i, s in enumerate(sums)]
    return each.select("part", *columns).groupBy("part", *names).agg(*(F.sum(s).alias(s) for s in sums))


def pairs(rows: DataFrame) -> DataFrame:
    """(w1, w, c) of rows with a sentence s."""
    bound_batches(rows.sparkSession)
    found = rows.where("s is not null").select("s").mapInArrow(_filled(_pairs, lambda batch: len(batch.column(0).flatten())), BLOCK)
    return _opened(found, ["w1", "w"], ["c"]).select("w1", "w", "c")


def summed(rows: DataFrame, names: list[str], sums: list[str], by: list[str] | None = None) -> DataFrame:
    """(part, names, sums) of rows(names, sums), whole numbers added up; rows with the same words `by`, or all names, are in one part and one task."""
    bound_batches(rows.sparkSession)
    own = rows.select(part_of(*(by or names)).alias("part"), *names, *(F.col(s).cast("long").alias(s) for s in sums))
    return _opened(own.mapInArrow(_packed(names, sums), BLOCK), names, sums)
