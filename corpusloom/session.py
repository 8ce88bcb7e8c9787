"""Sessions and shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "corpusloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where it is unset and the session is a local one (tests) does it fall
    back to a local temporary folder, and it sets that for checkpoint() too. On
    a cluster it is a ValueError: executors could not read each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            return found
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext.getCheckpointDir()
    return path


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between the JVM and Python by rows and by bytes, so long texts cannot swell them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage like checkpoint(), but computes df only once, and the
    files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
