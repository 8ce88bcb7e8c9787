"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosines.

Vectors of one label whose cosine is `threshold` or more are linked. Unit
vectors with cosine c are sqrt(2 - 2c) apart, so each table quantises random
Gaussian projections of the unit vector in steps of WIDTH, and vectors that
agree in all of a table's numbers share a bucket. How many projections a table
has and how many tables there are follows from the number of vectors, by the
collision probability of p-stable hashing: so many that an unrelated vector
meets one other a table by chance, and that a pair at the threshold shares a
bucket with probability RECALL; tests measure both.

Equal vectors of one label are one row with a count, so copies cost nothing.
Only (bucket, row) is dealt out; rows that share their bucket with others get
their vectors afterwards. Buckets over BLOCK rows are split into blocks by a
hash, and each pair of blocks is a unit of its own: every pair is compared,
memory stays bounded. Units are gathered to groups of about ROWS rows. A pair
that shares several buckets counts in the first of them only. Groups return
sums and a forest of links, never pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and
those without a label, link with nothing. Vectors of different lengths do not
link. Repeated rows are copies of each other. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import connected, merge, settle
from corpusloom.llm.texts import mix64
from corpusloom.session import staged

WIDTH, RECALL = 2.0, 0.999
BLOCK, SMALL, ROWS = 4096, 64, 40_000


def collision(distance: float, width: float) -> float:
    """The probability that vectors so far apart share a projection's step."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def planned(n: int, threshold: float, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(tables, projections a table) for n vectors."""
    near = collision(math.sqrt(max(2 - 2 * threshold, 1e-9)), width)
    hashes = max(4, math.ceil(math.log(max(n, 2)) / -math.log(collision(math.sqrt(2), width))))
    return math.ceil(math.log(1 - recall) / math.log1p(-(near**hashes))), hashes


def keys(unit: np.ndarray, label: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """(n, tables): each row's bucket in each table."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, dim])
    directions, shift = rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)
    steps = np.floor((unit @ directions + shift) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, hashes)
    out = mix64(label.astype(np.int64).view(np.uint64)[:, None] * np.uint64(1 << 20) + np.uint64(dim * 1024) + np.arange(tables, dtype=np.uint64)[None, :])
    for k in range(hashes):
        out = mix64(out * np.uint64(31) + steps[:, :, k])
    return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of doubles, the largest component of each at 1; this keeps squares finite."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)
    return x / np.abs(x).max(axis=1, keepdims=True)


def candidates(unit: np.ndarray, side: np.ndarray, cross: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same unit, a sorted column; between sides only, where cross is set."""
    begins = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
    sizes = np.diff(np.append(begins, len(unit)))
    after = np.repeat(begins + sizes, sizes) - np.arange(len(unit)) - 1  # rows of the unit that follow
    small = np.repeat(sizes <= SMALL, sizes)
    rows = np.flatnonzero(small & (after > 0))
    total = np.cumsum(after[rows])
    low = 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, side="right")))
        own, n = rows[low:high], after[rows[low:high]]
        a = np.repeat(own, n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        keep = ~cross[a] | (side[a] != side[b])
        yield a[keep], b[keep]
        low = high
    for begin, size in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = np.arange(begin, begin + size)
        for at in range(0, size, max(1, most // size)):
            part = own[at : at + max(1, most // size)]
            keep = part[:, None] < own[None, :]
            if cross[begin]:
                keep &= side[part][:, None] != side[own][None, :]
            i, j = np.nonzero(keep)
            yield part[i], own[j]


def links(vectors: np.ndarray, tables: np.ndarray, row: np.ndarray, unit: np.ndarray, table: np.ndarray, side: np.ndarray, cross: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector: how many rows it is newly linked to, by copies, and the least vector of its component.

    vectors, tables (their buckets) and copies go by vector; row, unit, table, side and cross by member of a unit.
    """
    scale = np.sqrt((vectors * vectors).sum(axis=1))
    total, parent = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    for a, b in candidates(unit, side, cross):
        x, y, own = row[a], row[b], table[a]
        close = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (scale[x] * scale[y]) >= threshold
        x, y, own = x[close], y[close], own[close]
        first = (tables[x] == tables[y]).argmax(axis=1) == own
        x, y = x[first], y[first]
        np.add.at(total, x, copies[y])
        np.add.at(total, y, copies[x])
        parent = merge(parent, x, y)
    return total, settle(parent)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, width: float = WIDTH, recall: float = RECALL, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vec"), F.col(label_col).cast("long").alias("label"))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("hash", F.when(F.col("usable"), F.xxhash64("vec", "label")))
    distinct = rows.where("usable").groupBy("hash", "label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    distinct = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "pstable-distinct")
    tables, hashes = planned(distinct.count(), threshold, width, recall)

    def buckets(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        return keys(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), label, tables, hashes, width, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.asarray(pc.list_value_length(whole.column(2)))
            for size in np.unique(sizes):
                same = whole.filter(pa.array(sizes == size))
                for at in range(0, same.num_rows, 2048):
                    batch = same.slice(at, 2048)
                    found = buckets(_matrix(batch.column(2), size), np.asarray(batch.column(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(np.repeat(np.asarray(batch.column(0)), tables))], ["bucket", "tab", "node"])

    dealt = distinct.select("node", "label", "vec").mapInArrow(deal, "bucket long, tab int, node long")
    shared = dealt.withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).where("size > 1")
    shared = staged(shared, "pstable-buckets").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    groups = max(1, round((shared.agg(F.sum("blocks")).first()[0] or 0) / ROWS))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks").cast("long")).cast("int")
    paired = shared.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    unit = F.xxhash64("bucket", "i", "j")
    paired = paired.select(F.pmod(unit, F.lit(groups)).alias("group"), unit.alias("unit"), "tab", "node", "own", (F.col("i") != F.col("j")).alias("cross"))
    members = paired.join(distinct.select("node", "label", "copies", "vec"), "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        sizes = np.asarray(pc.list_value_length(table.column("vec")))
        for size in np.unique(sizes):
            same = table.filter(pa.array(sizes == size)).sort_by([("unit", "ascending"), ("node", "ascending")]).combine_chunks()
            column = {n: same.column(n).combine_chunks() for n in same.column_names}
            nodes, first, row = np.unique(np.asarray(column["node"]), return_index=True, return_inverse=True)
            x = _matrix(column["vec"].take(pa.array(first)), size)
            own = buckets(x, np.asarray(column["label"])[first])
            total, root = links(x, own, row, np.asarray(column["unit"]), np.asarray(column["tab"]), np.asarray(column["own"]), column["cross"].to_numpy(zero_copy_only=False), np.asarray(column["copies"])[first], threshold)
            linked = np.flatnonzero(total)
            for part, values in zip(out, (nodes[linked], total[linked], nodes[root[linked]])):
                part.append(values)
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *x]) for n, x in zip(("node", "n", "root"), out)})

    found = staged(members.groupBy("group").applyInArrow(compare, "node long, n long, root long"), "pstable-links")
    totals = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    known = distinct.join(totals, "node", "left").join(labels, distinct["node"] == labels["id"], "left").withColumn("class", F.coalesce("component", "node"))
    least = known.groupBy("class").agg(F.min("rep").alias("least"))
    known = known.join(least, "class").select(F.col("hash").alias("h"), F.col("label").alias("l"), F.col("vec").alias("v"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least")
    out = rows.join(known, (rows["hash"] == known["h"]) & (rows["label"] == known["l"]) & (rows["vec"] == known["v"]), "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
