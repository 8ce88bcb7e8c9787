"""Substring search by inverted lists of letter runs, in place of a nested loop.

A text that contains a query contains all runs of the query's letters. Each text
is listed under its runs of one to three letters, each once, and a query asks the
list of the rarest of its own runs, of three letters where it has so many. What is
in that list is checked in full. A list longer than LIST is cut into parts by a
hash of its texts, and a query of it goes to every part.

An empty query is in every text and asks no list; callers rank all texts for it.
Null texts and queries match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import staged

LIST = 100_000


def runs(text: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct runs of some sizes of a text's letters."""

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
        return F.when(F.length(text) >= size, F.transform(starts, lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def lists(texts: DataFrame, text_col: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """texts with `run`, a row for each of their runs; written once."""
    return staged(texts.where(F.col(text_col).isNotNull()).withColumn("run", F.explode(runs(F.col(text_col), sizes))), "runs")


def containing(listed: DataFrame, text_col: str, queries: DataFrame, query_col: str, sizes: tuple[int, ...] = (1, 2, 3), fits: Column | None = None) -> DataFrame:
    """Rows of lists(), without `run`, with each distinct query that they contain; or of which `fits` holds, which must need the query's runs."""
    found = F.col(text_col).contains(F.col(query_col)) if fits is None else fits
    own = queries.where(F.length(query_col) > 0)
    # the largest runs that a query has; they are the rarest
    size = F.least(F.length(query_col), F.lit(max(sizes)))
    each = F.filter(runs(F.col(query_col), sizes), lambda r: F.length(r) == size)
    counts = listed.groupBy("run").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy(query_col).orderBy("n", "run")
    # a run that no text has is the rarest, and its list is empty
    asked = own.select(query_col, F.explode(each).alias("run")).distinct().join(counts, "run", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    asked = asked.withColumn("r", F.row_number().over(rarest)).where("r = 1 and n > 0").drop("r")
    cut = asked.withColumn("parts", F.ceil(F.col("n") / LIST).cast("int")).select(query_col, "run", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    parts = cut.select("run", "parts").distinct()
    kept = listed.join(parts, "run").withColumn("part", F.pmod(F.xxhash64(text_col), F.col("parts")).cast("int")).drop("parts")
    pairs = kept.join(cut.select("run", "part", F.col(query_col)), ["run", "part"])
    return pairs.where(found).drop("run", "part")
