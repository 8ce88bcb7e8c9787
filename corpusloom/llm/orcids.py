"""Token ids in ORC files, sorted by document id.

Documents are range-sorted by id, then tokenised where they lie, so a token is
never shuffled. A part file holds (doc_id, part, start, n_tokens, ids): ORC packs
the numbers by run-length encoding, keeps least and largest values of every
stripe and of every STRIDE rows, and a Bloom filter over the ids of documents.
`start` counts the ids before the document within its part; a manifest with a
row a part file gives each part's own start. Readers split the files by stripes,
and filters on doc_id, part or start skip stripes and row groups that can't match.

Null and empty texts have the end id alone. Null ids come first. Equal ids are
sorted by a hash of the text; rows that are equal in both share a part. One text
is held whole by one task, however long. An empty table gives files without rows.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.packing import encoder
from corpusloom.llm.texts import blocks, release

END = 2
STRIPE, STRIDE = 16 << 20, 1000  # bytes to a stripe, and documents to an entry of the row index
PART, LEAST_PART = 32_000_000, 1_000_000  # characters of text to a part file, and at least where cores would be idle
READ = 256  # documents to a batch that the reader holds
OPTIONS = {
    "orc.stripe.size": STRIPE,
    "orc.row.index.stride": STRIDE,
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.rows.between.memory.checks": "100",  # long documents fill a stripe within few rows
    "compression": "zstd",
}


def encoded(docs: DataFrame, place: tuple[str, str, str], end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, start, n_tokens, ids) in ascending order of doc_id within and between partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, start = encoder(*place), 0
        for block in blocks(batches):
            found = [np.append(code.ids(text, True), np.uint32(end)) if text else np.array([end], "<u4") for text in block["text"]]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.concatenate(found).view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(block["id"], pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), ids], ["doc_id", "start", "n_tokens", "ids"])
            start += int(ends[-1])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, total // PART, min(docs.sparkSession.sparkContext.defaultParallelism, total // LEAST_PART))
    order = [F.col("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>").select("doc_id", F.spark_partition_id().alias("part"), "start", "n_tokens", "ids")


def write(docs: DataFrame, place: tuple[str, str, str], path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes path/ids, the documents, and path/manifest: (part, least, largest, docs, tokens, base) of each file."""
    spark = docs.sparkSession
    encoded(docs, place, end, id_col, text_col).write.options(**OPTIONS).orc(f"{path}/ids")
    found = spark.read.orc(f"{path}/ids").groupBy("part").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    base = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")  # a row a file
    found.withColumn("base", base).coalesce(1).write.orc(f"{path}/manifest")


def _placed(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    parts = spark.read.orc(f"{path}/manifest").select("part", "base")
    return found.join(parts, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def _ids(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.orc.columnarReaderBatchSize", str(READ))
    return spark.read.orc(f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before. Filters on doc_id reach the files."""
    return _placed(spark, path, _ids(spark, path))


def between(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """read()'s rows of the documents that hold an id at low <= place < high; skips parts and row groups that don't."""
    held = spark.read.orc(f"{path}/manifest").where((F.col("base") < high) & (F.col("base") + F.col("tokens") > low))
    first, last, first_base, last_base = held.agg(F.min("part"), F.max("part"), F.min("base"), F.max("base")).first()
    part, start = F.col("part"), F.col("start")
    found = _ids(spark, path).where(part.between(first, last) if first is not None else F.lit(False))
    if first is not None:
        found = found.where(((part < last) | (start < high - last_base)) & ((part > first) | (start + F.col("n_tokens") > low - first_base)))
    return _placed(spark, path, found)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read() gives, worked out from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            flat, ends = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
