"""What is learned of each user, as a log of runs: merged, exported, imported and switched off.

A row is (user, part, kind, key, n, seq):

    confusion   kind and key of an edit, and how often it was seen
    stats       key of a counter, and its value
    learn       key: a word that is not to be corrected
    weights     key: the place of a weight of the ranking, n: the weight; the largest seq counts
    reset       kind "all" or "stats": what was learned before it is gone

Counts add up, words unite, weights are the last ones, so a batch adds its own
rows only and runs merge in any grouping. A reset takes out what runs before its
own hold; in its own batch it takes out what has a smaller seq.

Null users are a user; a null kind or key counts as the empty string, a null n
as 0 and a null seq as 0. An undo or correction without its words counts in the
stats and teaches nothing. A log without runs gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import channel as C
from corpusloom.streaming.learning import FIRST_WEIGHTS
from corpusloom.streaming.runs import FAN, RunLog

ROW = "user string, part string, kind string, key string, n double, seq long"
NAMES = ["user", "part", "kind", "key", "n", "seq"]
# fixed values: the parts of a saved state
KINDS = ("sub", "del", "ins", "trans", "seen", "subCtx", "seenCtx")
STATS = ("corrections", "accepts", "reverts", "charsSaved")
VERSION = 1

CONFUSION = ", ".join(f"{k}: map<string,double>" for k in KINDS)
SAVED = f"version int, confusion struct<version: int, {CONFUSION}, observations: double>, reranker struct<version: int, weights: array<double>, updates: int>, learnList array<string>, stats map<string,double>, updatedAt double"


def plain(rows: DataFrame) -> DataFrame:
    """Rows with their nulls put right."""
    return rows.select("user", "part", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("kind", "key")), F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce(F.col("seq"), F.lit(0)).cast("long").alias("seq"))


def summed(rows: DataFrame) -> DataFrame:
    """One row for each thing that is known, the larger of equal seqs' weights."""
    n = F.when(F.col("part") == "weights", F.max_by("n", F.struct("seq", "n"))).when(F.col("part").isin("learn", "reset"), F.lit(1.0)).otherwise(F.sum("n"))
    return rows.groupBy("user", "part", "kind", "key").agg(n.alias("n"), F.max("seq").alias("seq")).select(*NAMES)


def _after_resets(rows: DataFrame, at: str) -> DataFrame:
    """Rows that no reset with a larger `at` takes out; there are at most two resets' places for each user."""
    marks = rows.where("part = 'reset'").groupBy("user").agg(F.max(at).alias("any"), F.max(F.when(F.col("kind") == "all", F.col(at))).alias("all"))
    joined = rows.join(marks.withColumnRenamed("user", "owner"), F.expr("user <=> owner"), "left")
    bar = F.when(F.col("part").isin("stats", "reset"), F.col("any")).otherwise(F.col("all"))
    bar = F.when((F.col("part") == "reset") & (F.col("kind") == "all"), F.col("all")).otherwise(bar)
    return joined.where(bar.isNull() | (F.col(at) >= bar)).select(*rows.columns)


def batch_rows(rows: DataFrame) -> DataFrame:
    """A batch's rows as a run holds them: what a reset of the batch left, summed."""
    return summed(_after_resets(plain(rows), "seq"))


def merge(rows: DataFrame, whole: bool) -> DataFrame:
    """Rows of several runs as one; marks of resets stay while older runs are left."""
    found = summed(_after_resets(rows, "run").drop("run"))
    return found.where("part <> 'reset'") if whole else found


def learned(events: DataFrame) -> DataFrame:
    """Rows that interactions teach: events(user, seq, kind, source, target), with kind accept, correct, undo, reset or reset-stats.

    A correction of source to target is an observed slip; an undo that put
    source back keeps that word from being corrected again.
    """
    fine = F.col("source").isNotNull() & F.col("target").isNotNull()
    slips = F.when((F.col("kind") == "correct") & fine, C.confusion_udf(F.coalesce("source", F.lit("")), F.coalesce("target", F.lit("")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))

    def row(part: str, kind: Column | str, key: Column | str) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(part).alias("part"), lit(kind).alias("kind"), lit(key).alias("key"), F.lit(1.0).alias("n"))

    counter = F.when(F.col("kind") == "accept", "accepts").when(F.col("kind") == "correct", "corrections").when(F.col("kind") == "undo", "reverts")
    stats = F.when(counter.isNotNull(), F.array(row("stats", "", counter)))
    words = F.when((F.col("kind") == "undo") & F.col("source").isNotNull(), F.array(row("learn", "", F.lower("source"))))
    resets = F.when(F.col("kind").isin("reset", "reset-stats"), F.array(row("reset", F.when(F.col("kind") == "reset", "all").otherwise("stats"), "")))
    none = F.array().cast("array<struct<part:string,kind:string,key:string,n:double>>")
    every = F.concat(F.transform(slips, lambda x: row("confusion", x["kind"], x["key"])), *(F.coalesce(x, none) for x in (stats, words, resets)))
    return events.select("user", "seq", F.explode(every).alias("x")).select("user", "x.*", "seq").select(*NAMES)


def weight_rows(steps: DataFrame) -> DataFrame:
    """Rows of learning.weights_step's output (user, seq, action, word): the ranking's weights after each step."""
    weights = F.from_json("word", "array<double>")
    own = steps.where("action = 'weights'").select("user", "seq", F.posexplode(weights).alias("k", "n"))
    return own.select("user", F.lit("weights").alias("part"), F.lit("").alias("kind"), F.col("k").cast("string").alias("key"), "n", "seq")


def saved(rows: DataFrame) -> DataFrame:
    """(user, json): each user's state as a file holds it."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n"))))
    by_kind = rows.where("part = 'confusion'").groupBy("user", "kind").agg(pairs.alias("own"))
    empty = F.create_map().cast("map<string,double>")
    kinds = by_kind.groupBy("user").agg(*(F.coalesce(F.first(F.when(F.col("kind") == k, F.col("own")), ignorenulls=True), empty).alias(k) for k in KINDS), F.coalesce(F.first(F.when(F.col("kind") == "observations", F.element_at("own", "")), ignorenulls=True), F.lit(0.0)).alias("observations"))
    confusion = kinds.select("user", F.struct(F.lit(VERSION).alias("version"), *KINDS, "observations").alias("confusion"))

    def listed(part: str, value: Column, name: str) -> DataFrame:
        return rows.where(F.col("part") == part).groupBy("user").agg(value.alias(name))

    weights = listed("weights", F.transform(F.sort_array(F.collect_list(F.struct(F.col("key").cast("int").alias("k"), "n"))), lambda x: x["n"]), "weights")
    words = listed("learn", F.sort_array(F.collect_list("key")), "words")
    stats = listed("stats", pairs, "counted")
    users = rows.select("user").distinct()
    for own in (confusion, weights, words, stats):
        users = users.join(own.withColumnRenamed("user", "owner"), F.expr("user <=> owner"), "left").drop("owner")
    none = F.struct(F.lit(VERSION).alias("version"), *(empty.alias(k) for k in KINDS), F.lit(0.0).alias("observations"))
    ranking = F.struct(F.lit(1).alias("version"), F.coalesce("weights", F.array(*map(F.lit, FIRST_WEIGHTS))).alias("weights"), F.lit(0).alias("updates"))
    counted = F.map_from_arrays(F.array(*map(F.lit, STATS)), F.array(*(F.coalesce(F.try_element_at("counted", F.lit(k)), F.lit(0.0)) for k in STATS)))
    whole = F.struct(F.lit(VERSION).alias("version"), F.coalesce("confusion", none).alias("confusion"), ranking.alias("reranker"), F.coalesce("words", F.array().cast("array<string>")).alias("learnList"), counted.alias("stats"))
    return users.select("user", F.to_json(whole).alias("json"))


def loaded(files: DataFrame) -> DataFrame:
    """Rows of (user, json); what is malformed counts as empty, words are lower-cased."""
    s = F.from_json("json", SAVED, {"mode": "PERMISSIVE"})
    own = files.select("user", s.alias("s"))

    def counts(part: str, kind: str, pairs: Column) -> DataFrame:
        return own.select("user", F.explode(pairs).alias("key", "n")).select("user", F.lit(part).alias("part"), F.lit(kind).alias("kind"), "key", "n", F.lit(0).cast("long").alias("seq"))

    found = counts("stats", "", F.col("s.stats"))
    for kind in KINDS:
        found = found.unionByName(counts("confusion", kind, F.col(f"s.confusion.{kind}")))
    found = found.unionByName(counts("confusion", "observations", F.create_map(F.lit(""), F.col("s.confusion.observations"))))
    words = own.select("user", F.explode(F.array_distinct(F.transform("s.learnList", F.lower))).alias("key")).where("key is not null")
    found = found.unionByName(words.select("user", F.lit("learn").alias("part"), F.lit("").alias("kind"), "key", F.lit(1.0).alias("n"), F.lit(0).cast("long").alias("seq")))
    weights = own.select("user", F.posexplode("s.reranker.weights").alias("k", "n"))
    found = found.unionByName(weights.select("user", F.lit("weights").alias("part"), F.lit("").alias("kind"), F.col("k").cast("string").alias("key"), "n", F.lit(0).cast("long").alias("seq")))
    return found.where("n is not null and (n <> 0 or part in ('learn', 'weights'))")


class Personal:
    """The learned state below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.log = spark, RunLog(spark, folder, ROW, merge, fan)

    def view(self, enabled: bool = True) -> DataFrame:
        """What the engine may use: the state, or nothing while learning is off; what is stored stays."""
        return self.log.read() if enabled else self.spark.createDataFrame([], ROW)

    def learn(self, rows: DataFrame, batch: int) -> bool:
        """Add ROWs of a batch, such as learned() gives; once, however often the batch comes."""
        return self.log.append(batch_rows(rows), batch)

    def take_in(self, files: DataFrame, batch: int, merged: bool = True) -> bool:
        """Import (user, json): added to what users have, all but the weights, or in place of it."""
        rows = loaded(files)
        if merged:
            return self.learn(rows.where("part <> 'weights'"), batch)
        marks = files.select("user").distinct().select("user", F.lit("reset").alias("part"), F.lit("all").alias("kind"), F.lit("").alias("key"), F.lit(1.0).alias("n"), F.lit(0).cast("long").alias("seq"))
        return self.learn(rows.unionByName(marks), batch)

    def export(self) -> DataFrame:
        return saved(self.log.read())

    def follow(self, events: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Learn from a stream of interactions, each batch once; without `every`, take what is there and stop."""

        def take(rows: DataFrame, batch: int) -> None:
            self.learn(learned(rows), batch)

        writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
