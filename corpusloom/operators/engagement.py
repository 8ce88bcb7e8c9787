"""Engagement over interaction events: streaks, milestones, counters and menus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import lists as L

# fixed values: what event types stand for
ACCEPT, CORRECT, REVERT = "click", "purchase", "error"


def saved(events: DataFrame) -> DataFrame:
    """(user_id, event_id, ts, day, saved): positive savings with their UTC day."""
    return events.where(F.floor("value") > 0).select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), F.floor("value").cast("long").alias("saved"))


def streaks(rows: DataFrame) -> DataFrame:
    """(user_id, last_day, streak, best_streak, today_saved, total_saved, minutes): runs of days as islands."""
    days = rows.groupBy("user_id", "day").agg(F.sum("saved").alias("saved"))
    order = Window.partitionBy("user_id").orderBy("day")
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(order)))
    lengths = runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last"), F.max_by("saved", "day").alias("today"), F.sum("saved").alias("sum"))
    return lengths.groupBy("user_id").agg(
        F.max("last").alias("last_day"), F.max_by("n", "last").alias("streak"), F.max("n").alias("best_streak"), F.max_by("today", "last").alias("today_saved"), F.sum("sum").alias("total_saved"), F.round(F.sum("sum") / L.CHARS_PER_MINUTE, 4).alias("minutes")
    )


def milestones(rows: DataFrame) -> DataFrame:
    """(user_id, milestone, event_id): the event at which a running total first reaches each milestone."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("total", F.sum("saved").over(order))
    marks = F.explode(F.array(*(F.lit(m) for m in L.MILESTONES)))
    crossed = run.withColumn("milestone", marks).where((F.col("total") >= F.col("milestone")) & (F.col("total") - F.col("saved") < F.col("milestone")))
    return crossed.select("user_id", F.col("milestone").cast("long").alias("milestone"), "event_id")


def counters(events: DataFrame) -> DataFrame:
    """(user_id, accepts, corrections, reverts, chars_saved)."""
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(F.count_if(kind == ACCEPT).alias("accepts"), F.count_if(kind == CORRECT).alias("corrections"), F.count_if(kind == REVERT).alias("reverts"), F.sum(F.greatest(F.lit(0), F.floor("value"))).cast("long").alias("chars_saved"))


def snapshot(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Streaks and counters of each user with the next milestone (null beyond the last)."""
    wide = streaks(rows).join(counters(events), "user_id", "full")
    nexts = F.array_min(F.filter(F.array(*(F.lit(m) for m in L.MILESTONES)), lambda m: m > F.coalesce("total_saved", F.lit(0))))
    return wide.withColumn("next_milestone", nexts.cast("long"))


def best_menu(items: list[tuple[float, float, str]], k: int | None = None) -> list[str]:
    """The menu of k items at most that saves most: items (p, saved, name) in order of p, each slot above costing one unit.

    Taking the i-th item at slot s earns p * (saved - s); gain[i][s] is what the
    items from i on can earn when s are shown.
    """
    ranked = sorted((x for x in items if x[1] > 0), key=lambda x: (-round(x[0], 12), x[2]))  # equal but for rounding: by name
    n = len(ranked)
    most = n if k is None else min(k, n)
    gain = [[0.0] * (most + 2) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        p, own, _ = ranked[i]
        for s in range(min(i, most), -1, -1):
            gain[i][s] = gain[i + 1][s] if s >= most else max(gain[i + 1][s], p * (own - s) + gain[i + 1][s + 1])
    out, s = [], 0
    for i, (p, own, name) in enumerate(ranked):
        if s < most and p * (own - s) + gain[i + 1][s + 1] > gain[i + 1][s] + 1e-10:
            out.append(name)
            s += 1
    return out
