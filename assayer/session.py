"""Session defaults: UTC, adaptive execution, as many shuffle partitions as cores."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str = "4g", **more: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(master).config(map=conf | more).getOrCreate()


#: Bytes of an Arrow batch that Spark sends to a worker, where a job asks for small ones.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have about BATCH_BYTES. By default they may have 64 MB, which every worker holds in several forms."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
