"""Change feeds: counts that follow a corpus with retraction, and live counters over events.

A change is (op, path, text, seq): op is set, remove or rename (text then holds
the new path). Changes of a batch apply in the order of seq; a rename carries
what its path holds at that point, and one of a path that holds nothing does
nothing. State is counts per path, in Parquet by run and bucket of paths,
so replacing a document takes its old counts out with the new ones in, and
replaying a batch gives the same state.
"""

from __future__ import annotations

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import lists as L
from corpusloom.operators import ngram
from corpusloom.operators.graph import connected
from corpusloom.session import staged
from corpusloom.streaming.runs import RunLog

KEYS = ("n", "w2", "w1", "w")
STATE = "path string, n int, w2 string, w1 string, w string, c long"
CHANGE = "op string, path string, text string, seq long"


SET, STATE_OF, GONE = "set", "state", "gone"


def folded(changes: list[tuple], present: set[str]) -> dict[str, tuple[str, str | None, int | None]]:
    """What each touched path holds in the end: (set, path, seq) of a change, (state, path, None), or (gone, None, None)."""
    holds: dict[str, tuple] = {p: (STATE_OF, p, None) for p in present}
    touched: dict[str, None] = {}
    for seq, op, path, to in sorted(changes, key=lambda c: c[:3]):
        touched[path] = None
        if op == "set":
            holds[path] = (SET, path, seq)
        elif op == "remove":
            holds.pop(path, None)
        elif to != path and path in holds:
            touched[to] = None
            holds[to] = holds.pop(path)
    return {p: holds.get(p, (GONE, None, None)) for p in touched}


def resolved(changes: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, kind, source, at): what every touched path holds after changes, given the paths that hold something now.

    A path that no rename touches holds what its last change says, by a window.
    The others are grouped with those that renames join them to; a group's
    changes, without texts, are folded in order.
    """
    renames = changes.where("op = 'rename' and path <> text").select(F.col("path").alias("a"), F.col("text").alias("b"))
    groups = connected(renames)
    placed = changes.join(groups, changes["path"] == groups["id"], "left")
    order = Window.partitionBy("path").orderBy(F.desc("seq"), F.desc("op"))
    alone = placed.where("component is null and not (op = 'rename')").withColumn("r", F.row_number().over(order)).where("r = 1")
    alone = alone.select("path", F.when(F.col("op") == "set", SET).otherwise(GONE).alias("kind"), F.when(F.col("op") == "set", F.col("path")).alias("source"), F.when(F.col("op") == "set", F.col("seq")).alias("at"))
    own = paths.join(groups, paths["path"] == groups["id"]).select("component", paths["path"], F.lit(None).cast("long").alias("seq"), F.lit("has").alias("op"), F.lit(None).cast("string").alias("to"))
    mixed = own.unionByName(placed.where("component is not null").select("component", "path", "seq", "op", F.when(F.col("op") == "rename", F.col("text")).alias("to")))

    def told(rows: list[tuple]) -> pa.RecordBatch:
        found = folded([r for r in rows if r[1] != "has"], {r[2] for r in rows if r[1] == "has"})
        columns = list(zip(*((p, *x) for p, x in found.items()))) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["path", "kind", "source", "at"])

    def fold(batches):
        last, held = None, []
        for batch in batches:
            for component, *row in zip(*(batch[c].to_pylist() for c in ("component", "seq", "op", "path", "to"))):
                if held and component != last:
                    yield told(held)
                    held = []
                last = component
                held.append(tuple(row))
        if held:
            yield told(held)

    # groups one after another in a task, as a call for each would cost more than its few changes
    dealt = mixed.repartition("component").sortWithinPartitions("component")
    return alone.unionByName(dealt.mapInArrow(fold, "path string, kind string, source string, at long"))


def path_counts(docs: DataFrame) -> DataFrame:
    """STATE rows of documents (path, text)."""
    rows = ngram.sentences(docs).select("path", F.explode("sentences").alias("s"))
    none = F.lit(None).cast("string")

    def gram(n: int, w2: Column, w1: Column, w: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), w2.alias("w2"), w1.alias("w1"), w.alias("w"))

    # every word ends a trigram, and the first of a sentence comes after the pair of two markers
    w2, w1, w, mark = F.col("w2"), F.col("w1"), F.col("w"), F.lit(L.SOS)
    own = [gram(1, none, none, w), gram(2, none, w1, w), gram(3, w2, w1, w)]
    each = F.when((w2 == L.SOS) & (w1 == L.SOS), F.array(*own, gram(2, none, mark, mark))).otherwise(F.array(*own))
    found = ngram.occurrences(rows, ["w2", "w1", "w"], ("path",)).select("path", F.explode(each).alias("g")).select("path", "g.*")
    return found.groupBy("path", *KEYS).agg(F.count("*").alias("c"))


def applied(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after a batch of changes."""
    changes = changes.where("op in ('set', 'remove', 'rename') and path is not null")
    plan = staged(resolved(changes, state.select("path").distinct()), "plan")
    moved = plan.where(F.col("kind") == STATE_OF).select(F.col("source").alias("path"), F.col("path").alias("to"))
    fresh = plan.where(F.col("kind") == SET).select(F.col("source").alias("from"), F.col("at").alias("seq"), F.col("path").alias("to"))
    texts = changes.where("op = 'set'").select(F.col("path").alias("from"), "seq", "text").dropDuplicates(["from", "seq"])
    kept = state.join(plan.select("path"), "path", "left_anti")
    carried = state.join(moved, "path").drop("path").withColumnRenamed("to", "path").select(*state.columns)
    return kept.unionByName(carried).unionByName(path_counts(texts.join(fresh, ["from", "seq"]).select(F.col("to").alias("path"), "text")))


def totals(state: DataFrame) -> ngram.Counts:
    """The corpus's counts from counts per path."""
    own = state.groupBy(*KEYS).agg(F.sum("c").alias("c"))
    return ngram.Counts(own.where("n = 1").select("w", "c"), own.where("n = 2").select("w1", "w", "c"), own.where("n = 3").select("w2", "w1", "w", "c"))


def document_frequency(state: DataFrame) -> DataFrame:
    return state.where("n = 1").groupBy("w").agg(F.count("*").alias("df"))


def _newest(rows: DataFrame, whole: bool) -> DataFrame:
    """The rows of each bucket's last run; a bucket's mark, a row without a path, stays while older runs are left."""
    last = rows.groupBy("bucket").agg(F.max("run").alias("last"))
    found = rows.join(last, "bucket").where("run = last").drop("run", "last")
    return found.where("path is not null") if whole else found


class CorpusState:
    """The state below a folder that all executors share, as a log of runs; version b + 1 is the state after batch b.

    A batch reads and writes the buckets of paths that it touches; a bucket in
    a later run stands for that in earlier ones, and merging keeps the last.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.log = RunLog(spark, folder, f"{STATE}, bucket int", _newest, by=("bucket",))

    @property
    def version(self) -> int:
        last = self.log.batch
        return 0 if last is None else last + 1

    def read(self) -> DataFrame:
        return self.log.read().drop("bucket")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """For foreachBatch: a batch that comes again changes nothing."""
        if self.version > batch:
            return
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        changes = staged(changes, "changes")
        paths = changes.select("path").unionByName(changes.where("op = 'rename'").select(F.col("text").alias("path")))
        touched = [r[0] for r in paths.select(bucket.alias("b")).distinct().collect()]  # a number for each bucket
        old = self.log.read().where(F.col("bucket").isin(touched)).drop("bucket")
        marks = self.spark.createDataFrame([(None, 0, None, None, None, 0, b) for b in touched], f"{STATE}, bucket int")
        self.log.append(applied(old, changes).withColumn("bucket", bucket).unionByName(marks), batch)


def follow(changes: DataFrame, state: CorpusState, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Follow a stream of changes; without `every`, take what is there and stop."""
    writer = changes.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def live_counters(events: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Events by window and type, each event once, for batch or stream; late ones are dropped by the watermark."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("saved")).select(F.col("w.start").alias("begin"), "event_type", "n", "saved")
