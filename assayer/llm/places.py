"""Where operators put what executors must share: below the folder in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's folder with its scheme; one without a scheme is on the default file system.

    Only where none is set, and Spark runs on one machine, a temporary one is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
    else:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='assayer-')}"
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    path, files = _hadoop(spark, root)
    root = files.makeQualified(path).toString()
    return "file://" + root[5:] if root.startswith("file:/") and not root.startswith("file://") else root


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_folder(spark: SparkSession) -> str:
    """The folder of everything that this application keeps."""
    return f"{shared_root(spark).rstrip('/')}/assayer-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name; Spark's writers and pyarrow both make it when first written to."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def clear(spark: SparkSession) -> None:
    """Delete all that this application kept. For the end of a job, once its results are written elsewhere: they are read from here."""
    path, files = _hadoop(spark, run_folder(spark))
    files.delete(path, True)
