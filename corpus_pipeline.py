"""A training-data pipeline over `documents`, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir); run() writes what a stage returns as
Parquet in the shared folder and reads it back for the next. All but the last
return the columns of documents; extra columns are dropped at the first. An empty
table gives an empty result of the same columns. Rows with a null id, and rows that
repeat, are documents like others; where one of equals is to stay, ties are said
below. Texts of any length are read whole by one task.
"""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, packing, phrases, simhash, toxicity
from corpusloom.llm.texts import bound_batches
from corpusloom.session import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PLACE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SHINGLE, SIMILARITY = 5, 0.8  # words to a shingle, and the Jaccard similarity of near duplicates


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for toxic go.

    Null and empty texts have a score like any text; without a label to learn from all have the same one.
    """
    bound_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the least id; rows without an id all stay.

    Of rows with one id and text one stays. Texts without words are copies of one another.
    """
    bound_batches(spark)
    return simhash.distinct_rows(docs.select(*COLUMNS), SHINGLE, SIMILARITY)


def phrases_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of recurring passages go; texts left without a word go with them.

    Texts that had none, null ones among them, stay. A text that loses words is joined by single spaces.
    """
    bound_batches(spark)
    found = phrases.without_recurring(docs, carry=("lang", "source", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = found.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0)).withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; small sources are read again up to the repetition limit.

    A null source is a source; a null text counts as a token. Copies are equal rows.
    """
    bound_batches(spark)
    return mixing.mixed(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    A null or empty text is a piece of its end alone; a row with a null id has pieces of that id.
    """
    bound_batches(spark)
    return packing.pack(docs, PLACE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("substring", phrases_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express a trained network, fingerprints or a tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
