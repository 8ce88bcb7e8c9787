"""Tables of a corpus's model that follow its changes: counts, document frequency, continuation counts and top-k lists.

A batch of changes comes as differences of counts: what the touched documents say
now less what they said before. Counts, document frequencies and continuation
counts (in how many left contexts a word occurs) add up, so a batch writes its
differences alone. A continuation changes where a pair's count leaves or reaches 0.

A context's list holds its K most frequent words and up to RESERVE more, and a
floor: no word outside the list ranked above it when the list was made. Words of
the list and of the batch have exact counts; those at or above the floor are the
context's first ones, and they are enough as long as there are K of them. Only where
the reserve has run dry are the context's counts read again. A batch writes the
lists of the contexts that it touches and no others.

Lists rank by count and then by word. A rank by probability would change in
contexts that no document touches, as lower orders change; readers score a list's
words when they ask. A context is (n, w2, w1), with the empty string for no word;
n of 1 has one context, the vocabulary's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import ngram
from corpusloom.session import staged
from corpusloom.streaming import changes
from corpusloom.streaming.runs import FAN, RunLog

K, RESERVE = 16, 16
TABLES = ("frequency", "continuation", "lists")
CONTEXT = ["n", "w2", "w1"]
GRAM = [*CONTEXT, "w"]
COUNT = "n int, w2 string, w1 string, w string, c long"
LIST = "n int, w2 string, w1 string, words array<struct<c:long,w:string>>, floor_c long, floor_w string"


def difference(state: DataFrame, batch: DataFrame) -> DataFrame:
    """STATE rows of the paths that a batch of changes touches, old ones negative: changes.applied(state, batch) less state."""
    batch = staged(batch.where("op in ('set', 'remove', 'rename') and path is not null"), "changes")
    paths = batch.select("path").unionByName(batch.where("op = 'rename'").select(F.col("text").alias("path"))).distinct()
    before = staged(state.join(paths, "path", "left_semi"), "before")
    after = changes.applied(before, batch)
    return staged(after.unionByName(before.withColumn("c", -F.col("c"))), "difference")


def grams(found: DataFrame) -> DataFrame:
    """(n, w2, w1, w, c) of difference() without what cancels out."""
    own = found.select("n", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("w2", "w1")), "w", "c")
    return own.groupBy(*GRAM).agg(F.sum("c").alias("c")).where("c <> 0")


def frequencies(found: DataFrame) -> DataFrame:
    """(w, c): in how many more documents each word occurs."""
    return found.where("n = 1").groupBy("w").agg(F.sum(F.signum("c")).cast("long").alias("c")).where("c <> 0")


def _sums(keys: list[str]):
    def merge(rows: DataFrame, whole: bool) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.sum("c").alias("c"))
        return found.where("c <> 0")

    return merge


def _latest(rows: DataFrame, whole: bool) -> DataFrame:
    """The last list of each context; empty ones stay while older runs are left."""
    values = [c for c in rows.columns if c not in (*CONTEXT, "run")]
    found = rows.groupBy(*CONTEXT).agg(F.max_by(F.struct(*values), "run").alias("x")).select(*CONTEXT, "x.*")
    return found.where(F.size("words") > 0) if whole else found


def _above(c: Column, w: Column) -> Column:
    """At or above the floor, or without one."""
    return F.col("floor_c").isNull() | (c > F.col("floor_c")) | ((c == F.col("floor_c")) & (w <= F.col("floor_w")))


def _lists(rows: DataFrame, size: int) -> DataFrame:
    """LIST rows of counts (context, w, c, floor_c, floor_w): the first `size`; what is cut off sets the floor."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*CONTEXT).orderBy(F.desc("c"), "w"))).where(F.col("r") <= size + 1)
    cut = F.max("r") > size
    last = F.max_by(F.struct("c", "w"), F.when(F.col("r") <= size, F.col("r")))
    words = F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= size, F.struct("r", "c", "w")))), lambda x: F.struct(x["c"].alias("c"), x["w"].alias("w")))
    return ranked.groupBy(*CONTEXT).agg(words.alias("words"), F.when(cut, last["c"]).otherwise(F.first("floor_c")).alias("floor_c"), F.when(cut, last["w"]).otherwise(F.first("floor_w")).alias("floor_w"))


def _no_floor() -> list[Column]:
    return [F.lit(None).cast("long").alias("floor_c"), F.lit(None).cast("string").alias("floor_w")]


class Maintained:
    """The tables below a folder that all executors share; a batch counts once, however often it comes."""

    def __init__(self, spark: SparkSession, folder: str, k: int = K, reserve: int = RESERVE, fan: int = FAN, tables: tuple[str, ...] = TABLES):
        """Of the tables beside counts, those that are not named are not kept; one folder is always given the same."""
        folder = folder.rstrip("/")
        self.spark, self.k, self.size, self.tables = spark, k, k + reserve, tables
        self._counts = RunLog(spark, f"{folder}/counts", COUNT, _sums(GRAM), fan)
        self._frequency = RunLog(spark, f"{folder}/frequency", "w string, c long", _sums(["w"]), fan)
        self._continuation = RunLog(spark, f"{folder}/continuation", "w string, c long", _sums(["w"]), fan)
        self._tops = RunLog(spark, f"{folder}/lists", LIST, _latest, fan)

    def apply(self, found: DataFrame, batch: int) -> None:
        """Take in difference() rows of a batch, which are read more than once."""
        delta = staged(grams(found), "delta")
        self._counts.append(delta, batch)
        if "frequency" in self.tables:
            self._frequency.append(frequencies(found), batch)
        # counts have the batch by now, also where it comes a second time
        now = delta.withColumn("d", F.col("c")) if self._counts.runs()[0].low == batch else staged(self._since(delta), "now")
        if "continuation" in self.tables:
            crossed = (F.col("c") > 0).cast("long") - (F.col("c") > F.col("d")).cast("long")
            pairs = now.where("n = 2").groupBy("w").agg(F.sum(crossed).alias("c")).where("c <> 0")
            self._continuation.append(pairs, batch)
        if "lists" in self.tables and (self._tops.batch is None or self._tops.batch < batch):
            self._tops.append(self.relisted(now) if self._tops.runs() else self.listed(now), batch)

    def _since(self, delta: DataFrame) -> DataFrame:
        """(context, w, d, c): a batch's differences and the counts they led to."""
        counts = self._counts.read(lambda rows: ngram.narrowed(rows, delta, GRAM))
        both = counts.select(*GRAM, "c", F.lit(None).cast("long").alias("d")).unionByName(delta.select(*GRAM, F.lit(0).cast("long").alias("c"), F.col("c").alias("d")))
        return both.groupBy(*GRAM).agg(F.sum("c").alias("c"), F.max("d").alias("d")).where("d is not null")

    def listed(self, now: DataFrame) -> DataFrame:
        """The lists where there are none yet."""
        return _lists(now.where("c > 0").select(*GRAM, "c", *_no_floor()), self.size)

    def relisted(self, now: DataFrame) -> DataFrame:
        """The new lists of the contexts of `now`: (context, w, d, c), differences and the counts they led to."""
        touched = staged(now.select(*CONTEXT).distinct(), "touched")
        old = staged(self._tops.read(lambda rows: ngram.narrowed(rows, touched, CONTEXT)).join(touched, CONTEXT, "left_semi"), "old-lists")
        listed = old.select(*CONTEXT, F.explode("words").alias("x")).select(*CONTEXT, "x.*")
        kept = listed.join(now.select(*GRAM), GRAM, "left_anti").select(*GRAM, "c")
        floors = old.select(*CONTEXT, "floor_c", "floor_w")
        sure = kept.unionByName(now.where("c > 0").select(*GRAM, "c")).join(floors, CONTEXT, "left").where(_above(F.col("c"), F.col("w")))
        sure = staged(sure, "sure")
        enough = sure.groupBy(*CONTEXT).agg(F.count("*").alias("sure"))
        dry = floors.where("floor_c is not null").join(enough, CONTEXT, "left").where(F.coalesce("sure", F.lit(0)) < self.k).select(*CONTEXT)
        dry = staged(dry, "dry")
        none = _no_floor()
        refilled = self._counts.read(lambda rows: ngram.narrowed(rows, dry, CONTEXT)).join(dry, CONTEXT, "left_semi").where("c > 0").select(*GRAM, "c", *none)
        fresh = _lists(sure.join(dry, CONTEXT, "left_anti").select(*GRAM, "c", "floor_c", "floor_w").unionByName(refilled), self.size)
        empty = touched.join(fresh.select(*CONTEXT), CONTEXT, "left_anti")
        return staged(fresh, "fresh").unionByName(empty.select(*CONTEXT, F.array().cast("array<struct<c:long,w:string>>").alias("words"), *none))

    def counts(self) -> DataFrame:
        return self._counts.read()

    def document_frequency(self) -> DataFrame:
        """(w, df)."""
        return self._frequency.read().withColumnRenamed("c", "df")

    def continuation(self) -> DataFrame:
        """(w, cont)."""
        return self._continuation.read().withColumnRenamed("c", "cont")

    def lists(self) -> DataFrame:
        """(n, w2, w1, w, c, rank): the k most frequent words of each context."""
        top = self._tops.read().select(*CONTEXT, F.posexplode(F.slice("words", 1, self.k)).alias("r", "x"))
        return top.select(*CONTEXT, "x.w", "x.c", (F.col("r") + 1).alias("rank"))
