"""The queries opN_<name> and pipeline, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from corpusloom.llm import brown, centroids, chat, fertility, langid, mixing, oracles, orcids, packing, phrases, pstable, repair, simhash, toxicity
from corpusloom.llm.texts import bound_batches, documents
from corpusloom.session import shared_dir

PLACE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
FERTILITY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.formatted(rows, PLACE), PLACE)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), PLACE)


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scored(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(documents(spark, sf_dir))
    return found.select("doc_id", "source", "n_tokens", "epoch", "block", "place")


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.without_recurring(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(fertility.measured(documents(spark, sf_dir), *FERTILITY))


def op8_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(toxicity.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predicted(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damaged(rows), rows)


def op12_orcids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/staged/token-ids-{uuid.uuid4().hex}"
    orcids.write(documents(spark, sf_dir), PLACE, path)
    return orcids.digests(orcids.read(spark, path))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    vectors = centroids.whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return centroids.report(centroids.cluster(vectors))


def queries() -> dict:
    found = {f.__name__: f for f in (op1_simhash, op2_chat, op3_packing, op4_brown, op5_mixing, op6_phrases, op7_fertility, op8_pstable, op9_toxicity, op10_langid, op11_repair, op12_orcids, op13_centroids)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
