"""Nearest vectors by cells: exact, whatever the cells, and with queries spread over all tasks.

Centres are fitted on a sample of at most SAMPLE vectors, and every vector belongs
to its nearest one. A cell is known by its number of vectors and its radius. Of
unit vectors the distance is sqrt(2 - 2 * cosine), so by the triangle inequality
nothing in a cell is nearer to a query than its centre's distance less the radius.

1. A query looks into its nearest cells until they hold k vectors. The k-th best
   there is its bar.
2. It goes to the other cells that the bound doesn't rule out. In a cell, vectors
   whose own distance from the centre differs from the query's by more than the
   bar are passed over.

Cells are cut into parts of PART vectors by a hash, and where queries are many
these too, so no group is large and none is left out. Centres (at most CELLS) are
broadcast with their counts; queries and vectors meet in joins.

Vectors that are null, not of the most frequent length or hold a null or
non-finite component have no neighbours and are none. Zero vectors have the
cosine 0 with all. Rows with a query's own id are not its neighbours. Equal
cosines, to nine digits, go by id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import staged

SAMPLE, CELLS, ROUNDS = 20_000, 1024, 6
PART = 16_384  # vectors to a part of a cell
ASKED = 65_536  # queries to a part
SLACK = 4e-9  # of squared distances: cosines are rounded


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _usable(df: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(fine & F.col("id").isNotNull())


@dataclass
class Index:
    members: DataFrame  # (id, v, cell, far): unit vectors and their distance from the centre, written once
    centres: np.ndarray
    counts: np.ndarray
    radius: np.ndarray
    size: int

    def parts(self) -> Column:
        """How many parts a row's cell has."""
        return F.get(F.array(*(F.lit(int(max(1, -(-n // PART)))) for n in self.counts)), F.col("cell"))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> Index | None:
    """An index of vectors, or None where there are none."""
    sizes = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("size")).count()
    first = sizes.where("size > 0").orderBy(F.desc("count"), "size").first()
    if first is None:
        return None
    own = _usable(vectors, first["size"], id_col, vector_col)
    sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return None
    x = _unit(np.array([r["v"] for r in sample], np.float64))
    number = cells or min(CELLS, len(x), int(first["count"] ** 0.5) + 1)
    centres = x[:number].copy()
    for _ in range(ROUNDS):
        near = _distances(x, centres).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=number)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = _unit(_matrix(part.column(1)))
                d = _distances(v, shared.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), _list(v), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(v)), cell])], ["id", "v", "cell", "far"])

    members = staged(own.mapInArrow(run, "id long, v array<double>, cell int, far double"), "cells")
    counts, radius = np.zeros(number, np.int64), np.zeros(number)
    for r in members.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    return Index(members, centres, counts, radius, first["size"])


ASK = "query_id long, q array<double>, cell int, off double, bar double"


def _first_cells(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """ASK rows of the nearest cells of each query that hold more than k vectors together."""
    shared = asked.sparkSession.sparkContext.broadcast((index.centres, index.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q = _unit(_matrix(part.column(1)))
                d = _distances(q, centres)
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                row, place = np.nonzero((before <= k) & (counts[order] > 0))
                cell = order[row, place]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), _list(q[row]), pa.array(cell, pa.int32()), pa.array(d[row, cell]), pa.array(np.full(len(row), np.inf))], ["query_id", "q", "cell", "off", "bar"])

    return asked.select("id", "v").mapInArrow(run, ASK)


def _other_cells(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """ASK rows of the cells that the bar of asked(id, v, bar) doesn't rule out and that _first_cells didn't give."""
    shared = asked.sparkSession.sparkContext.broadcast((index.centres, index.counts, index.radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, counts, radius = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q, bar = _unit(_matrix(part.column(1))), np.asarray(part.column(2))
                d = _distances(q, centres)
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                open_ = np.zeros(d.shape, bool)
                np.put_along_axis(open_, order, before > k, 1)
                row, cell = np.nonzero(open_ & (counts > 0)[None, :] & (d - radius[None, :] - 1e-9 <= bar[:, None]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), _list(q[row]), pa.array(cell, pa.int32()), pa.array(d[row, cell]), pa.array(bar[row])], ["query_id", "q", "cell", "off", "bar"])

    return asked.select("id", "v", "bar").mapInArrow(run, ASK)


def _compared(index: Index, pairs: DataFrame, queries: int, k: int) -> DataFrame:
    """(query_id, id, cosine): the k best of each query in each part of the cells that it is sent to."""
    shares = max(1, -(-queries // ASKED))
    asked = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), index.parts() - 1))).withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    members = index.members.withColumn("part", F.pmod(F.xxhash64("id"), index.parts()).cast("int"))
    members = members.withColumn("share", F.explode(F.array(*map(F.lit, range(shares)))))
    keys = ["cell", "part", "share"]

    def run(key: tuple, asked: pa.Table, members: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if asked.num_rows and members.num_rows:
            members = members.combine_chunks()
            ids, far = np.asarray(members.column("id")), np.asarray(members.column("far"))
            x = _matrix(members.column("v"))
            order = np.argsort(far, kind="stable")
            ids, far, x = ids[order], far[order], x[order]
            asked = asked.combine_chunks()
            names, off, bar = (np.asarray(asked.column(c)) for c in ("query_id", "off", "bar"))
            q = _matrix(asked.column("q"))
            for at in range(0, len(names), 256):
                part = slice(at, at + 256)
                low = np.searchsorted(far, (off[part] - bar[part]).min() - 1e-9)
                high = np.searchsorted(far, (off[part] + bar[part]).max() + 1e-9, side="right")
                s = np.round(q[part] @ x[low:high].T, 9)
                s[names[part][:, None] == ids[None, low:high]] = -np.inf
                own = np.broadcast_to(ids[low:high], s.shape)
                top = np.lexsort((own, -s), axis=1)[:, :k]
                s, own = np.take_along_axis(s, top, 1), np.take_along_axis(own, top, 1)
                fine = np.isfinite(s)
                for column, value in zip(out, (np.repeat(names[part], fine.sum(axis=1)), own[fine], s[fine])):
                    column.append(value)
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "id", "cosine"), out)})

    return asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(run, "query_id long, id long, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", index: Index | None = None) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest vectors of each query but the row itself."""
    index = index or fit(vectors, id_col, vector_col)
    if index is None or k < 1:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, cosine double, rank int")
    asked = staged(_usable(queries, index.size, id_col, vector_col), "asked")
    number = asked.count()
    first = staged(_best(_compared(index, _first_cells(index, asked, k), number, k), k), "first")
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0)) + SLACK).alias("bar"))
    barred = asked.join(full, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("inf"))))
    rest = _compared(index, _other_cells(index, barred, k), number, k)
    return _best(first.drop("rank").unionByName(rest), k)
