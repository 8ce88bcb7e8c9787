"""Words, blocks of rows and hashes that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import BATCH_BYTES, BATCH_ROWS, bound_batches  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release() -> None:
    """Give freed memory back to the system; workers are reused and would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def words_of(text: str | None) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ of a text as UTF-8; bytes.split() cuts at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[dict[str, list]]:
    """Rows as lists by column, in blocks of about `most` characters of text.

    Keeps memory bounded by the block and one text, whatever the batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column.cast(pa.string())), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + most
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(start, stop - start).to_pydict()
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (np.uint64(0x9E3779B97F4A7C13), np.uint64(0xC2B2AE3D27D4EB4B))  # odd, so they have inverses modulo 2**64
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        found = np.ones(1 << max(10, int(n - 1).bit_length()), np.uint64)
        found[1:] = base
        found = np.multiply.accumulate(found)
        _powers[int(base)] = found
    return found[:n]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of values[starts[i]:ends[i]], whatever their place."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASES[k], len(values)), out=total[1:])
    return (total[ends] - total[starts]) * _power(_INVERSES[k], int(starts.max()) + 1)[starts]


class Words:
    """The words of a list of texts, as places in one buffer, with a 64-bit hash each.

    first[d]:first[d + 1] are the words of text d. Equal words have equal
    hashes in every process.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, step: int = 1 << 20):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.raw = b"\n".join(parts) + b"\n"
        self.buffer = np.frombuffer(self.raw, np.uint8)
        if lower:
            self.buffer = _LOWER[self.buffer]
        space = _SPACE[self.buffer]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self._step = step

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + self._step, side="right")))
            part = self.buffer[low : self.ends[to - 1]]
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mix64(_ranges(_BYTE_VALUES[0][part], s, e, 0) ^ mix64(_ranges(_BYTE_VALUES[1][part], s, e, 1) + np.uint64(1)))
            at = to
        return out

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start word, hash, second hash) of every run of `size` words within one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            none = np.zeros(0, np.uint64)
            return np.zeros(0, np.int64), none, none
        starts = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        if not len(starts):
            return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        one, two = _ranges(hashes, starts, starts + size, 0), _ranges(mix64(hashes), starts, starts + size, 1)
        return starts, mix64(one ^ mix64(two)), mix64(two + np.uint64(7))


def confirm(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk's hashes, which of them another chunk has too."""
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    found = np.zeros(len(every), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return np.split(found, np.cumsum([len(p) for p in parts])[:-1])
