"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents are tokenised where they lie; only (id, piece, start, length, crc)
goes on. Lengths are whole numbers up to the capacity, so the range-sorted
order of all documents is described in full by its runs: (length, count). The
same holds for open gaps. Rounds work on these runs, which the capacity bounds
and the data do not: every document seeks its successor, the least gap that
holds it; longer documents rank first, and among equals the rank in the sorted
order decides which takes which gap; then gaps shrink and the next round
begins. Where no document finds a gap, new sequences open. A piece then finds
its sequence by its rank among pieces of its length. Ranks come from counts by
(length, bucket) and a row number within each, so a length that a third of all
pieces share is spread over many tasks.

Null and empty texts give one piece of the end token alone. Repeated rows are
packed each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.texts import blocks, release
from corpusloom.session import staged

CAPACITY = 2048
END = 0
BUCKET = 4096  # pieces to a rank bucket, about
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


SPECIAL, SPECIAL_ID = "<|endoftext|>", 50_256
LONG_SPACE = re.compile(r"\s{4096}")  # its pattern makes tiktoken backtrack without bound


class Encoder:
    """A byte-level BPE vocabulary, read from its ranks and, for white space that those can't take, its JSON file."""

    def __init__(self, ranks: str, json: str, pattern: str):
        with open(ranks, "rb") as f:
            own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=own, special_tokens={SPECIAL: SPECIAL_ID})
        self.json = json

    @cache
    def slow(self, special: bool) -> Tokenizer:
        out = Tokenizer.from_file(self.json)
        out.encode_special_tokens = not special
        return out

    def ids(self, text: str, special: bool) -> np.ndarray:
        """The ids of the JSON file; `special`: whether the special token's string is that token or ordinary text."""
        if len(text) >= 4096 and LONG_SPACE.search(text):
            return np.array(self.slow(special).encode(text, add_special_tokens=False).ids, "<u4")
        return self.code.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=()).astype("<u4")

    def text(self, ids: list[int]) -> str:
        return self.code.decode_bytes(ids).decode("utf-8")


@cache
def encoder(ranks: str, json: str, pattern: str) -> Encoder:
    return Encoder(ranks, json, pattern)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, place: tuple[str, str, str], capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; texts that exceed the capacity are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(*place)
        for block in blocks(batches):
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(block["id"], block["text"]):
                ids = np.append(code.ids(text, True), np.uint32(END)) if text else np.array([END], "<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    for column, value in zip(out, (key, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(out)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset) that place all of counts[length].

    A run of documents meets a run of gaps; both are sorted. One sweep from
    the longest documents down gives every document of the round its own gap.
    """
    todo = {n: [0, c] for n, c in counts.items() if c}  # length: [next rank, how many are left]
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, count), sorted
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(n: int, seq: int, take: int, offset: int) -> tuple[int, int, int]:
        placed.append((n, todo[n][0], take, seq, offset))
        todo[n][0] += take
        todo[n][1] -= take
        return capacity - offset - n, seq, take

    while todo:
        left = [c for _, _, c in gaps]
        up = list(range(len(gaps) + 1))  # up[k]: at or above k, the next run that has gaps left

        def successor(k: int, up: list[int] = up) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        shrunk = []
        for n in sorted(todo, reverse=True):
            k = successor(bisect_left(gaps, (n,)))
            while k < len(gaps) and todo[n][1]:
                gap, seq, count = gaps[k]
                take = min(left[k], todo[n][1])
                shrunk.append(place(n, seq + count - left[k], take, capacity - gap))
                left[k] -= take
                up[k] += not left[k]
                k = successor(k)
        rest = [(gap, seq + count - k, k) for (gap, seq, count), k in zip(gaps, left) if k]
        todo = {n: x for n, x in todo.items() if x[1]}
        if not shrunk:
            need = sum(x[1] for n, x in todo.items() if 2 * n > capacity) or -(-sum(n * x[1] for n, x in todo.items()) // capacity)
            for n in sorted(todo, reverse=True):
                if take := min(need, todo[n][1]):
                    shrunk.append(place(n, opened, take, 0))
                    opened += take
                    need -= take
            todo = {n: x for n, x in todo.items() if x[1]}
        least = min(todo, default=capacity + 1)
        gaps = sorted(g for g in rest + shrunk if g[0] >= least)
    return np.array(sorted(placed), dtype=np.int64).reshape(-1, 5)


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; `found` should be a written table, as it is read three times."""
    spark = found.sparkSession
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # as many rows as the capacity at most
    plan = best_fit_runs(counts, capacity)
    key = (plan[:, 0] << 44) + plan[:, 1]
    shared = spark.sparkContext.broadcast((key, plan))
    buckets = max(1, sum(counts.values()) // BUCKET)
    ranked = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    before = ranked.groupBy("length", "bucket").count().select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))).join(before, ["length", "bucket"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, plan = shared.value
        for batch in batches:
            rank = np.asarray(batch.column(5))
            run = plan[np.searchsorted(key, (np.asarray(batch.column(3)) << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, (F.col("rank") - 1 + F.col("before")).cast("long").alias("rank")).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, place: tuple[str, str, str], capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: one row per piece. place: a vocabulary's ranks, its JSON file and the pattern."""
    return packed(staged(pieces(docs, place, capacity, id_col, text_col), "pieces"), capacity)
