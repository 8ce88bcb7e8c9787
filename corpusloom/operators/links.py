"""Titles, links, tags and sections over notes."""

from __future__ import annotations

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import lists as L
from corpusloom.functions import markup as M
from corpusloom.functions import text as X
from corpusloom.operators import grams
from corpusloom.session import staged

SEGMENT = T.StructType([T.StructField(n, k) for n, k in (("from", T.IntegerType()), ("to", T.IntegerType()), ("anchor", T.IntegerType()), ("text", T.StringType()), ("kind", T.StringType()), ("heading", T.StringType()))])
SPAN = T.StructType([T.StructField(n, k) for n, k in (("from", T.IntegerType()), ("to", T.IntegerType()), ("text", T.StringType()), ("target", T.StringType()))])


@F.pandas_udf(T.ArrayType(SEGMENT))
def segments_udf(text: pd.Series) -> pd.Series:
    names = [f.name for f in SEGMENT]
    return text.map(lambda t: [dict(zip(names, s)) for s in M.segments(t)])


def sections(notes: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, from, to, anchor, text, kind, heading): the blocks of every note."""
    return notes.select(id_col, F.explode(segments_udf(text_col)).alias("s")).select(id_col, "s.*")


def titles(notes: DataFrame, id_col: str, title_col: str, alias_col: str | None = None) -> DataFrame:
    """(phrase, target, display): what names a note, in lower case: its title, unless that is a number, and its aliases.

    Names have three characters or more. Notes claim them in the order of their
    ids, title first; target is the note's title and display the name itself. A note
    without a title has no names.
    """
    own = [F.struct(F.lit(0).alias("place"), F.col(title_col).alias("display"))]
    names = F.filter(F.array(*own), lambda x: ~x["display"].rlike(r"^\d+([.\-/]\d+)*\z"))
    if alias_col:
        names = F.concat(F.coalesce(names, F.array().cast("array<struct<place:int,display:string>>")), F.coalesce(F.transform(alias_col, lambda x, k: F.struct((k + 1).alias("place"), x.alias("display"))), F.array().cast("array<struct<place:int,display:string>>")))
    listed = notes.select(F.col(id_col).alias("id"), F.col(title_col).alias("target"), F.explode(names).alias("x")).where((F.length("x.display") >= 3) & F.col("target").isNotNull())
    order = Window.partitionBy("phrase").orderBy("id", "place", "target")
    first = listed.select("id", "x.place", F.lower("x.display").alias("phrase"), "target", "x.display").withColumn("r", F.row_number().over(order)).where("r = 1")
    return first.select("phrase", "target", "display")


def search_titles(index: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query, target, rank): titles that contain a query; those that begin with it first. An empty query is in all titles."""
    own = queries.where("query is not null").select("query", F.lower("query").alias("sought")).distinct()
    found = grams.containing(grams.lists(index, "phrase"), "phrase", own.select("sought").distinct(), "sought")
    any_ = index.select("target").distinct().orderBy(F.lower("target"), "target").limit(limit).join(own.where("sought = ''").select("query"))  # one query at most
    one = found.join(own, "sought").select("query", "target").unionByName(any_.select("query", "target")).distinct()
    order = Window.partitionBy("query").orderBy(F.when(F.lower("target").startswith(F.lower("query")), 0).otherwise(1), F.lower("target"), "target")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "target", "rank")


def links(notes: DataFrame, index: DataFrame, id_col: str, text_col: str = "text", longest: int = 6) -> DataFrame:
    """(id, from, to, text, target): link spans of every note.

    A note meets only the titles among its own word runs, by a join on the
    phrase; the greedy choice then sees one note's titles.
    """
    words = F.transform(F.regexp_extract_all(text_col, F.lit(M.LINK_WORD.pattern), F.lit(0)), F.lower)
    firsts = notes.select(id_col, F.explode(F.array_distinct(words)).alias("first"))
    heads = index.withColumn("first", F.regexp_extract("phrase", M.LINK_WORD.pattern, 0)).where("first <> ''")
    own = firsts.join(heads, "first").groupBy(id_col).agg(F.collect_list(F.struct("phrase", "target")).alias("known"))

    @F.pandas_udf(T.ArrayType(SPAN))
    def spans(text: pd.Series, known: pd.Series) -> pd.Series:
        names = [f.name for f in SPAN]
        return pd.Series([[dict(zip(names, s)) for s in M.link_spans(t or "", {x["phrase"]: (x["target"], "") for x in k}, longest=longest)] for t, k in zip(text, known)])

    return notes.join(own, id_col).select(id_col, F.explode(spans(F.col(text_col), F.col("known"))).alias("s")).select(id_col, "s.*")


def inline_tags(notes: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, tag): valid inline tags in lower case, once per occurrence."""
    found = F.regexp_extract_all(text_col, F.lit(r"(?:^|\s)#([\p{L}\p{N}_/-]+)"), F.lit(1))
    return notes.select(id_col, F.explode(found).alias("tag")).where(X.is_valid_tag("tag")).withColumn("tag", F.lower("tag"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def raw_counts(notes: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, tf): how often a note has each lower-case run of three letters, digits and hyphens or more; terms leave hyphens out."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9][a-z0-9-]{2,}"), F.lit(0))
    return notes.select(id_col, F.explode(words).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def suggest_tags(tf: DataFrame, raw: DataFrame, counts: DataFrame, applied: DataFrame, id_col: str, limit: int = 8) -> DataFrame:
    """(id, tag, score, rank): hits * ln(1 + n), hits being terms and raw words that are the tag or its leaf.

    A tag without a slash is its own leaf and counts twice.
    """
    named = counts.withColumn("leaf", F.regexp_extract("tag", r"([^/]*)\z", 1))
    keys = named.select("tag", "n", F.explode(F.array("tag", "leaf")).alias("term"))
    applied = staged(applied.select(id_col, "tag").distinct(), "applied")
    most = limit + (applied.groupBy(id_col).count().agg(F.max("count")).first()[0] or 0)
    # a note's rows meet in one task, and of its hits no more leave it than can be shown once its applied tags are out
    every = tf.select(id_col, "term", "tf").unionByName(raw.select(id_col, "term", "tf")).where(F.col(id_col).isNotNull()).repartition(id_col)
    hits = every.join(keys, "term").groupBy(id_col, "tag", "n").agg(F.sum("tf").alias("hits")).withColumn("score", F.col("hits") * F.log(F.col("n") + 1))
    order = Window.partitionBy(id_col).orderBy(F.desc(F.round("score", 9)), "tag")
    scored = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).join(applied, [id_col, "tag"], "left_anti")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(id_col, "tag", "score", "rank")


def tag_popup(tf: DataFrame, counts: DataFrame, applied: DataFrame, rarity: DataFrame, asked: DataFrame, id_col: str, existing: int = 5, total: int = 8, least_new: int = 3) -> DataFrame:
    """(id, tag, is_new, score, rank) for asked(id, query): known tags that match what is typed, then a note's own words.

    A known tag scores match * (0.5 + hits) * rarity * ln(2 + n), match being 2
    where it or its leaf begins with the query; a word that is no tag scores
    0.8 * tf * rarity, 1.4 times as much if it begins so, and needs a rarity of
    0.4. Words without a rarity(w, rarity) have 0.5. A query matches what has
    its letters in order. Notes meet only tags that they have a hit for, and
    the best tags of their query besides: as many as can be shown or applied.
    """
    in_order = lambda q: F.array_join(F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), ".*")
    letters = in_order(F.lower("query"))
    named = counts.where(X.is_valid_tag("tag")).withColumn("leaf", F.regexp_extract("tag", r"([^/]*)\z", 1))
    named = named.join(rarity.select(F.col("w").alias("leaf"), "rarity"), "leaf", "left").withColumn("rarity", F.coalesce("rarity", F.lit(0.5)))
    begins = lambda c: F.col(c).startswith(F.lower("query"))
    match = F.when((F.col("query") != "") & (begins("tag") | begins("leaf")), 2).otherwise(1)
    fits = F.expr("tag rlike letters") | F.expr("leaf rlike letters")
    own = asked.withColumn("letters", letters)
    most = existing + (applied.groupBy(id_col).count().agg(F.max("count")).first()[0] or 0)
    queries = own.where("query is not null").select("query", F.lower("query").alias("sought")).distinct()
    named = staged(named, "tags")
    alike = F.regexp_like("tag", in_order(F.col("sought"))) | F.regexp_like("leaf", in_order(F.col("sought")))
    general = grams.containing(grams.lists(named, "tag", (1,)), "tag", queries.select("sought").distinct(), "sought", (1,), alike).join(queries, "sought").drop("sought")
    score = match * 0.5 * F.col("rarity") * F.log(F.col("n") + 2)
    first = named.withColumn("query", F.lit("")).orderBy(F.desc(F.round(score, 9)), "tag").limit(most)
    general = general.unionByName(first.join(queries.where("sought = ''").select("query"), "query"), allowMissingColumns=True).withColumn("score", score)
    general = general.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "tag"))).where(F.col("r") <= most).select("query", "tag", "leaf", "n", "rarity")
    # a note's rows meet in one task; of its hits and its own words no more stay than can be shown once its applied tags are out
    best = Window.partitionBy(id_col, "query").orderBy(F.desc(F.round("score", 9)), "tag")
    base = tf.select(id_col, "term", "tf").join(own, id_col).repartition(id_col)
    same = F.col("tag") == F.col("leaf")
    keys = named.select("tag", "leaf", "n", "rarity", F.col("tag").alias("term"), F.when(same, 2).otherwise(1).alias("times"))
    keys = keys.unionByName(named.where(~same).select("tag", "leaf", "n", "rarity", F.col("leaf").alias("term"), F.lit(1).alias("times")))
    hit = base.join(keys, "term").where(fits).groupBy(id_col, "query", "tag", "leaf", "n", "rarity").agg(F.sum(F.col("tf") * F.col("times")).alias("hits"))
    hit = hit.withColumn("score", match * (0.5 + F.col("hits")) * F.col("rarity") * F.log(F.col("n") + 2)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    hit = staged(hit.select(id_col, "query", "tag", "leaf", "n", "rarity", "hits"), "tag-hits")
    rest = own.join(general, "query").select(id_col, "query", "tag", "leaf", "n", "rarity", F.lit(0).cast("long").alias("hits")).join(hit.select(id_col, "tag"), [id_col, "tag"], "left_anti")
    known = hit.unionByName(rest).join(applied.select(id_col, "tag").distinct(), [id_col, "tag"], "left_anti")
    known = known.withColumn("score", match * (0.5 + F.col("hits")) * F.col("rarity") * F.log(F.col("n") + 2))
    known = known.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.round("score", 9)), "tag"))).where(F.col("r") <= existing).select(id_col, "tag", F.lit(False).alias("is_new"), "score", "r")
    fresh = base.withColumnRenamed("term", "tag").where((F.length("tag") >= 4) & X.is_valid_tag("tag") & F.expr("tag rlike letters"))
    fresh = fresh.join(counts.select("tag"), "tag", "left_anti")
    fresh = fresh.join(rarity.select(F.col("w").alias("tag"), "rarity"), "tag", "left").withColumn("rarity", F.coalesce("rarity", F.lit(0.5))).where("rarity >= 0.4")
    lift = F.when((F.col("query") != "") & begins("tag"), 1.4).otherwise(1.0)
    fresh = fresh.withColumn("score", F.col("tf") * F.col("rarity") * lift * 0.8).withColumn("r", F.row_number().over(best)).where(F.col("r") <= most - existing + max(total, least_new))
    fresh = fresh.select(id_col, "tag", "score").join(applied.select(id_col, "tag").distinct(), [id_col, "tag"], "left_anti")
    shown = known.groupBy(id_col).agg(F.count("*").alias("shown"))
    fresh = fresh.join(shown, id_col, "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    fresh = fresh.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.round("score", 9)), "tag"))).where(F.col("r") <= F.greatest(F.lit(least_new), total - F.col("shown")))
    return known.unionByName(fresh.select(id_col, "tag", F.lit(True).alias("is_new"), "score", (F.col("r") + F.col("shown")).cast("int").alias("r"))).withColumnRenamed("r", "rank")


def picker(recommended: DataFrame, notes: DataFrame, asked: DataFrame, cap: int = 500) -> DataFrame:
    """(query_id, target, related, rank) for asked(query_id, path): recommended(query_id, target, rank) first, then notes(path, target, mtime), the newest first.

    Only the `cap` newest notes, and as many more as recommendations may repeat, are dealt to every question.
    """
    first = recommended.withColumn("r", F.row_number().over(Window.partitionBy("query_id", F.lower("target")).orderBy("rank"))).where("r = 1").drop("r")
    most = first.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    newest = notes.withColumn("age", F.row_number().over(Window.orderBy(F.desc("mtime"), "path"))).where(F.col("age") <= cap + most + 1)
    rest = asked.join(F.broadcast(newest), asked["path"] != newest["path"]).select("query_id", "target", "age")
    rest = rest.withColumn("low", F.lower("target")).join(first.select("query_id", F.lower("target").alias("low")), ["query_id", "low"], "left_anti")
    rest = rest.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "low").orderBy("age"))).where("r = 1")
    every = first.select("query_id", "target", F.lit(True).alias("related"), F.col("rank").alias("at")).unionByName(rest.select("query_id", "target", F.lit(False).alias("related"), F.col("age").alias("at")))
    order = Window.partitionBy("query_id").orderBy(F.desc("related"), "at", "target")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("related") | (F.col("rank") <= cap)).select("query_id", "target", "related", "rank")


def listed(dictionary: DataFrame) -> DataFrame:
    """(w, added, rank) of dictionary(w, added): the words that the user added, then those learned, each in alphabetical order."""
    return dictionary.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("added"), F.lower("w"), "w")))


def new_tags(tf: DataFrame, counts: DataFrame, id_col: str, limit: int = 3) -> DataFrame:
    """(id, term, tf, rank): frequent words of four letters or more that are no tag yet."""
    fresh = tf.where((F.col("tf") >= 2) & (F.length("term") >= 4)).join(counts.select(F.col("tag").alias("term")), "term", "left_anti")
    order = Window.partitionBy(id_col).orderBy(F.desc("tf"), "term")
    return fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(id_col, "term", "tf", "rank")


def tag_diff(before: str, after: str) -> tuple:
    """Columns (added, removed) between two arrays of tags."""
    return F.array_sort(F.array_except(after, before)).alias("added"), F.array_sort(F.array_except(before, after)).alias("removed")


def dictionary_kept(dictionary: DataFrame, vocab: DataFrame, df: DataFrame | None) -> DataFrame:
    """Entries that the engine does not know and the corpus still uses, in any case; without a corpus (None) unknown ones stay."""
    out = dictionary.withColumn("low", F.lower("w")).join(vocab.select(F.col("w").alias("low")), "low", "left_anti")
    if df is not None:
        out = out.join(df.where("df > 0").select(F.col("w").alias("low")), "low", "left_semi")
    return out.select("w")


def pinned(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, pinned): the entry as typed, capitalised or in capitals, or else the only spelling of that word."""
    entries = dictionary.select(F.col("w").alias("pinned"), F.lower("w").alias("low"))
    only = entries.groupBy("low").agg(F.count("*").alias("n"), F.min("pinned").alias("only"), F.collect_set("pinned").alias("forms"))
    t = F.col("token")
    cap = F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))
    exact = F.when(F.array_contains("forms", t), t).when(F.array_contains("forms", cap), cap).when(F.array_contains("forms", F.upper(t)), F.upper(t)).when(F.col("n") == 1, F.col("only"))
    return tokens.withColumn("low", F.lower("token")).join(only, "low").select("token", exact.alias("pinned")).where("pinned is not null")


STOP = L.STOP_WORDS
