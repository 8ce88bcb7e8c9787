"""The cache of a document's own words, kept live from two streams: its versions and the words accepted in it.

A version (doc, seq, text) resets the cache to its words; an accepted text
(doc, seq, text) adds its words. Whatever the order of arrival, the cache holds
the words of the version of the largest seq and of all accepted texts of a larger
seq: a version that comes late changes nothing, an accepted text that is older
than the version is dropped, and one that comes twice counts once. Of equal seqs
the version with the larger words wins.

live() keeps one state per document: its version, and the accepted texts after
it, each by its seq, so that a later version can drop those it holds. rebuilt()
gives the same from the whole log, with Spark's own aggregates.

Null and empty texts are versions without words. Rows without a doc or a seq are
left out, as they have no place in the order. An empty log gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions import text as X
from corpusloom.streaming.timers import with_state_store

CACHE = "doc string, seq long, words array<string>, counts array<long>"
COLUMNS = ["doc", "seq", "words", "counts"]


def _log(versions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc, seq, version, said): both streams as one, their words joined by a space."""

    def own(rows: DataFrame, version: bool) -> DataFrame:
        said = F.array_join(X.tokenize_words("text"), " ")
        return rows.where("doc is not null and seq is not null").select(F.col("doc").cast("string").alias("doc"), F.col("seq").cast("long").alias("seq"), F.lit(version).alias("version"), said.alias("said"))

    return own(versions, True).unionByName(own(accepted, False))


class Cache(StatefulProcessor):
    """A document's version, and the accepted texts after it by (seq, words)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "seq long, said string")
        self.accepted = handle.getMapState("accepted", "seq long, said string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = tuple(self.version.get()) if self.version.exists() else None
        best, texts = had, set()
        for pdf in rows:
            for seq, version, said in zip(pdf["seq"].tolist(), pdf["version"].tolist(), pdf["said"].tolist()):
                if not version:
                    texts.add((int(seq), said))
                elif best is None or (int(seq), said) > best:
                    best = (int(seq), said)
        if best != had:
            self.version.update(best)
            for old in [tuple(k) for k in self.accepted.keys() if best is not None and k[0] <= best[0]]:
                self.accepted.removeKey(old)
        for text in texts:
            if best is None or text[0] > best[0]:
                self.accepted.updateValue(text, (1,))
        found = Counter(best[1].split() if best else [])
        for text in self.accepted.keys():
            found.update(text[1].split())
        names = sorted(found)
        yield pd.DataFrame({"doc": [key[0]], "seq": pd.array([best[0] if best else None], "Int64"), "words": [names], "counts": [[found[w] for w in names]]})

    def close(self) -> None:
        pass


def live(versions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc, seq, words, counts): the whole cache of each document that a batch touched; seq is its version's."""
    both = _log(versions, accepted)
    with_state_store(both.sparkSession)
    return both.groupBy("doc").transformWithStateInPandas(Cache(), CACHE, "Update", "None")


def rebuilt(versions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc, w, c) from the whole log."""
    log = _log(versions, accepted)
    last = log.where("version").groupBy("doc").agg(F.max(F.struct("seq", "said")).alias("last")).select("doc", "last.*")
    after = log.where("not version").distinct().select("doc", F.col("seq").alias("at"), "said")
    # an accepted text needs its document's version alone, one row a document
    newer = after.join(last.select("doc", "seq"), "doc", "left").where("seq is null or at > seq").select("doc", "said")
    words = last.select("doc", "said").unionByName(newer).select("doc", F.explode(F.split("said", " ")).alias("w")).where("w <> ''")
    return words.groupBy("doc", "w").agg(F.count("*").alias("c"))


def lifted(cache: DataFrame, least: int = 2) -> DataFrame:
    """(doc, w, p): the share of each word that a cache (doc, w, c) holds often enough to lift it."""
    whole = Window.partitionBy("doc")
    return cache.withColumn("p", F.col("c") / F.sum("c").over(whole)).where(F.col("c") >= least).select("doc", "w", "p")
