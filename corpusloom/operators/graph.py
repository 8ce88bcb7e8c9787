"""Connected components of a graph, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import staged


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges(a, b): component is the least id reachable.

    Each round every root points to the least root next to it. Such pointers
    have cycles of two only; there the lesser becomes the root, so every root
    with a link joins another and their number halves at least. Pointer jumping
    then shortens the trees, which takes as many steps as the logarithm of
    their depth, and the links are drawn anew between the roots that are left.
    Minima are aggregated before the shuffle. Links stay distributed; only
    whether any link or change is left reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = staged(both.distinct(), "links")
    labels = links.groupBy("a").agg(F.first("a").alias("root")).withColumnRenamed("a", "id")
    links = links.where("a <> b")
    while not links.isEmpty():
        near = staged(links.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "id"), "near")
        back = near.select(F.col("id").alias("via"), F.col("up").alias("top"))
        own = (F.col("top") == F.col("id")) & (F.col("id") < F.col("up"))
        parents = staged(near.join(back, near["up"] == back["via"]).select("id", F.when(own, F.col("id")).otherwise(F.col("up")).alias("up")), "parents")
        while True:
            above = parents.select(F.col("id").alias("via"), F.col("up").alias("top"))
            jumped = staged(parents.join(above, parents["up"] == above["via"]).select("id", "up", "top"), "parents")
            parents = jumped.select("id", F.col("top").alias("up"))
            if jumped.where("up <> top").isEmpty():
                break
        top = parents.select(F.col("id").alias("via"), F.col("up").alias("top"))
        labels = staged(labels.join(top, labels["root"] == top["via"], "left").select("id", F.coalesce("top", "root").alias("root")), "labels")
        one = links.join(top, links["a"] == top["via"]).select(F.col("top").alias("a"), "b")
        links = staged(one.join(top, one["b"] == top["via"]).select("a", F.col("top").alias("b")).where("a <> b").distinct(), "links")
    least = labels.groupBy("root").agg(F.min("id").alias("component")).withColumnRenamed("root", "via")
    return staged(labels.join(least, labels["root"] == least["via"]).select("id", "component"), "labels")
