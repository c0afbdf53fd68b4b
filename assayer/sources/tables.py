"""Typed tables in the usual formats: reads with declared schemas, append-only writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer import schemas


def read(spark: SparkSession, name: str, path: str, form: str = "parquet", **options: str) -> DataFrame:
    """A table of the model from parquet, orc, csv or json; quotes in csv values are doubled, as ``export_csv`` writes them."""
    options = ({"header": "true", "escape": '"'} if form == "csv" else {}) | options
    return spark.read.schema(schemas.TABLES[name]).options(**options).format(form).load(path)


def read_jdbc(spark: SparkSession, name: str, url: str, column: str, bounds: tuple[int, int], partitions: int = 16, **options: str) -> DataFrame:
    """A table of the model from a database, in ranges of a numeric column."""
    lower, upper = bounds
    return spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


def append(df: DataFrame, name: str, path: str) -> None:
    """Add rows in the model's columns; files are partitioned by tenant, and nothing is overwritten."""
    names = schemas.TABLES[name].fieldNames()
    key = schemas.SCOPED.get(name)
    writer = df.select(*names).write.mode("append")
    (writer.partitionBy(key) if key == "tenant_id" else writer).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """With a header, quotes in values doubled; an existing folder is an error."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
