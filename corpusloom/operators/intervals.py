"""Ranges of texts: which overlap, which lie in others, and the leftmost longest choice, without a loop over pairs.

A range [from, to) of a text is dealt to the bins of WIDTH characters that it
touches, and ranges meet in bins. Two that overlap share the bin in which the
later one begins, so each pair is found once, in that bin. Empty ranges overlap
nothing and lie in any range that holds their place.

The choice takes, of ranges sorted by where they begin and then by length, each
that begins no sooner than the last one taken ends. No range crosses a place where
all before have ended, so texts fall into clusters there; the largest end so far is
found by bins first and within a bin then, and each cluster is chosen from by
itself, streaming. One huge text is thus spread over many tasks.

Rows with a null text, from or to, or that end before they begin, are left out.
Repeated ranges count once in a choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def _fine(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull() & (F.col("to") >= F.col("from")))


def _bin(place: Column) -> Column:
    return F.floor(place / WIDTH)


def _binned(df: DataFrame, by: str) -> DataFrame:
    last = F.greatest(F.col("from"), F.col("to") - 1)
    return _fine(df, by).withColumn("bin", F.explode(F.sequence(_bin(F.col("from")), _bin(last))))


def _other(b: DataFrame, by: str) -> DataFrame:
    return _binned(b.select(by, "from", "to"), by).withColumnsRenamed({"from": "b_from", "to": "b_to"})


def overlaps(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """a's rows with b_from and b_to of each range of b that shares a character with them; both have (by, from, to)."""
    both = _binned(a, by).join(_other(b, by), [by, "bin"])
    shared = (F.col("from") < F.col("b_to")) & (F.col("b_from") < F.col("to")) & (F.col("from") < F.col("to")) & (F.col("b_from") < F.col("b_to"))
    return both.where(shared & (F.col("bin") == _bin(F.greatest("from", "b_from")))).drop("bin")


def inside(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """a's rows with b_from and b_to of each range of b that holds them whole."""
    both = _binned(a, by).join(_other(b, by), [by, "bin"])
    return both.where((F.col("b_from") <= F.col("from")) & (F.col("to") <= F.col("b_to")) & (F.col("bin") == _bin(F.col("from")))).drop("bin")


def clear(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """a's rows that share no character with b."""
    hit = overlaps(a.select(by, "from", "to").distinct(), b, by).select(by, "from", "to").distinct()
    return _fine(a, by).join(hit, [by, "from", "to"], "left_anti")


def clusters(df: DataFrame, by: str) -> DataFrame:
    """df with `cluster`, the place where its cluster of linked ranges begins; touching ranges are not linked."""
    own = _fine(df, by).withColumn("bin", _bin(F.col("from")))
    ends = own.groupBy(by, "bin").agg(F.max("to").alias("end"))
    before = ends.select(by, "bin", F.max("end").over(Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row a bin
    inner = Window.partitionBy(by, "bin").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.greatest(F.max("to").over(inner), F.col("before"))
    begun = own.join(before, [by, "bin"]).withColumn("begins", F.when(so_far.isNull() | (so_far <= F.col("from")), F.col("from")))
    marks = begun.groupBy(by, "bin").agg(F.max("begins").alias("mark"))
    carried = marks.select(by, "bin", F.max("mark").over(Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    upto = Window.partitionBy(by, "bin").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, 0)
    return begun.join(carried, [by, "bin"]).withColumn("cluster", F.coalesce(F.max("begins").over(upto), "carried")).drop("bin", "before", "begins", "carried")


def chosen(df: DataFrame, by: str) -> DataFrame:
    """(by, from, to): the leftmost longest choice of df's ranges in each text; empty ranges are never taken."""
    own = clusters(df.where(F.col("from") < F.col("to")).select(by, F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to")).distinct(), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, end = None, 0
        for batch in batches:
            keep = []
            for key, cluster, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, cluster) != at:
                    at, end = (key, cluster), cluster
                if keep_ := low >= end:
                    end = high
                keep.append(keep_)
            taken = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(2), taken.column(3)], [by, "from", "to"])

    rows = own.select(by, "cluster", "from", "to").repartition(by, "cluster").sortWithinPartitions(by, "cluster", "from", F.desc("to"))
    return rows.mapInArrow(run, f"`{by}` {dict(df.dtypes)[by]}, `from` long, `to` long")
