"""Clustering of whole-number vectors by centroids, screened by block norms.

A vector x is compressed to a whole number from -LEVELS to LEVELS, four bits, for each
component, times a step of its own: y. Of what that leaves out, x - y, the norm of
each of SEGMENTS equal segments is kept, and all are worked out once. With the
norms of a centroid's segments, the Cauchy-Schwarz inequality gives

    |x - c|**2 >= |x|**2 + |c|**2 - 2 * (y * c + sum of norm(x - y) * norm(c) over segments)

and these bounds come for all centroids from two products of small matrices. The
centroid with the least bound is measured first; of the others only those whose
bound is not above that distance are measured, in whole numbers. Bounds are
lowered by more than floating point can err, so no nearest centroid, and no tie,
is lost by them.

The only things that leave the tasks are a count and a sum of components for each
cluster: as many rows as centroids from each task. Centroids, of which the
parameter k sets the number, are broadcast.

Vectors that are null, of another length, or hold a null or non-finite component
are left out, as are those with a component of 2**27 or more once scaled: a
squared distance between such vectors need not fit a long. Null ids are kept and
seeded as the text "null". Rows with equal ids are clustered each; equal seeds are
taken by components. Fewer than k vectors make fewer centroids. Sums that no long
can hold are null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import staged

DIMENSIONS, SCALE, K, ROUNDS, SEGMENTS, LEVELS = 64, 64, 16, 3, 16, 7
LIMIT = 1 << 27
ROWS = 4096  # vectors to a block of bounds


def norms(vectors: np.ndarray, segments: int) -> np.ndarray:
    parts = vectors.reshape(len(vectors), segments, -1).astype(np.float64)
    return np.sqrt((parts * parts).sum(axis=2))


@dataclass
class Compressed:
    """Vectors as code * step, with the norms of each segment of what that leaves out, and the squares' sums."""

    code: np.ndarray  # int8, a row a vector
    step: np.ndarray
    rest: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, segments: int) -> Compressed:
        step = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1) / LEVELS
        code = np.rint(vectors / step[:, None]).astype(np.int8)
        wide = vectors.astype(np.float64)
        return Compressed(code, step, norms(wide - code * step[:, None], segments), (wide * wide).sum(axis=1))

    def columns(self) -> list[pa.Array]:
        code = pa.array([row.tobytes() for row in self.code], pa.binary())
        rest = pa.ListArray.from_arrays(pa.array(np.arange(len(self.rest) + 1) * self.rest.shape[1], pa.int32()), pa.array(self.rest.ravel()))
        return [code, pa.array(self.step), rest, pa.array(self.size)]

    @staticmethod
    def read(columns: list[pa.Array], width: int, segments: int) -> Compressed:
        code = np.frombuffer(b"".join(columns[0].to_pylist()), np.int8).reshape(-1, width)
        return Compressed(code, np.asarray(columns[1]), _matrix(columns[2], segments), np.asarray(columns[3]))

    def part(self, low: int, high: int) -> Compressed:
        return Compressed(*(x[low:high] for x in (self.code, self.step, self.rest, self.size)))


COMPRESSED = "code binary, step double, rest array<double>, size double"
STORED = ["v", "code", "step", "rest", "size"]


def whole(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, segments: int = SEGMENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, code, step, rest, size): floor(scale * x) of each component x, and its compressed form; written once."""
    if dimensions % segments:
        raise ValueError("segments must be of equal length")
    x = F.col("x")
    finite = F.size(x) == F.size(F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < LIMIT)))
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where((F.size(x) == dimensions) & finite)
    ints = rows.select("id", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Compressed.of(_matrix(batch.column(1), dimensions), segments)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found.columns()], ["id", *STORED])

    kind = ints.schema["id"].dataType.simpleString()
    return staged(ints.mapInArrow(run, f"id {kind}, v array<int>, {COMPRESSED}"), "vectors")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


@dataclass
class Screen:
    """Finds the nearest of some centroids; `measured` counts the exact distances and `asked` the vectors."""

    centroids: np.ndarray
    segments: int
    measured: int = 0
    asked: int = 0

    def nearest(self, vectors: np.ndarray, short: Compressed) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; the smaller number of equally near ones."""
        numbers, distances = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
        for low in range(0, len(vectors), ROWS):
            part = slice(low, low + ROWS)
            numbers[part], distances[part] = self._block(vectors[part].astype(np.int64), short.part(low, low + ROWS))
        return numbers, distances

    def _block(self, v: np.ndarray, short: Compressed) -> tuple[np.ndarray, np.ndarray]:
        wide = self.centroids.astype(np.float64)
        sizes = short.size[:, None] + (wide * wide).sum(axis=1)[None, :]
        most = (short.code @ wide.T) * short.step[:, None] + short.rest @ norms(wide, self.segments).T
        bound = sizes - 2 * most
        bound -= 1e-9 * sizes + 1e-6  # far more than the rounding of the lines above
        first = bound.argmin(axis=1)
        best = ((v - self.centroids[first]) ** 2).sum(axis=1)
        number = first.copy()
        self.asked += len(v)
        self.measured += len(v)
        for k in range(len(self.centroids)):
            open_ = np.flatnonzero((bound[:, k] <= best) & (first != k))
            if not len(open_):
                continue
            self.measured += len(open_)
            found = ((v[open_] - self.centroids[k]) ** 2).sum(axis=1)
            nearer = (found < best[open_]) | ((found == best[open_]) & (k < number[open_]))
            best[open_[nearer]] = found[nearer]
            number[open_[nearer]] = k
        return number, best


def seeds(vectors: DataFrame, k: int = K, salt: int = 1) -> np.ndarray:
    """The k vectors whose ids have the least sha256 of salt:id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    return np.array([r["v"] for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The centroids after one round: each the floor of its vectors' mean, those without a vector as they were."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(shared.value, segments)
        counts, sums = np.zeros(len(shared.value), np.int64), np.zeros(shared.value.shape, np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), width).astype(np.int64)
            number, _ = screen.nearest(v, Compressed.read(batch.columns[1:], width, segments))
            counts += np.bincount(number, minlength=len(counts))
            np.add.at(sums, number, v)
        used = np.flatnonzero(counts)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), rows], ["cluster", "n", "sums"])

    found = vectors.select(*STORED).mapInArrow(run, "cluster long, n long, sums array<long>")
    exact = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[d].cast("decimal(20,0)")) for d in range(width))).alias("sums"))
    out = centroids.copy()
    for cluster, n, sums in exact.collect():  # at most k rows
        out[cluster] = [int(x) // n for x in sums]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(shared.value, segments)
        for batch in batches:
            width = shared.value.shape[1]
            number, distance = screen.nearest(_matrix(batch.column(1), width), Compressed.read(batch.columns[2:], width, segments))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return vectors.select("id", *STORED).mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


@dataclass
class Clustering:
    """Vectors dealt to centroids: rows has (id, cluster, distance)."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, segments: int = SEGMENTS, salt: int = 1) -> Clustering:
    """Centroids moved `rounds` times from k seeds, and every vector of whole() dealt to the nearest; rows are written once."""
    centroids = seeds(vectors, k, salt)
    if not len(centroids):
        return Clustering(vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, 0), np.int64))
    for _ in range(rounds):
        centroids = moved(vectors, centroids, segments)
    return Clustering(staged(assigned(vectors, centroids, segments), "clusters"), centroids)


def report(found: Clustering, id_col: str = "vec_id") -> DataFrame:
    """A row a vector: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = found.rows.sparkSession
    exact = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum"))
    sums = {r["cluster"]: int(r["sum"]) for r in exact.collect()}  # at most as many rows as centroids
    held = lambda x: x if x < 1 << 63 else None
    facts = [(n, held(sums[n]), held(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(found.centroids.tolist()) if n in sums]
    names = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.rows.join(F.broadcast(names), "cluster")  # no more rows than centroids
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
