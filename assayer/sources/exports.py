"""Exports of results: chosen columns under the receiver's names, a scope, a preview, files in the usual formats, and an audit row.

Spreadsheet files, annotated PDFs and webhooks are no table formats; a spreadsheet reads the CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "parquet", "orc")
ACTION = "results.export"
PREVIEW = 5


def chosen(df: DataFrame, columns: dict[str, str], scope: Column | None = None) -> DataFrame:
    """The scope's rows with ``columns``: the receiver's name for each of ours, in their order."""
    rows = df if scope is None else df.filter(scope)
    return rows.select(*(F.col(ours).alias(theirs) for theirs, ours in columns.items()))


def preview(df: DataFrame, columns: dict[str, str], order: list[str], scope: Column | None = None) -> DataFrame:
    """The first rows of what would be exported."""
    rows = df if scope is None else df.filter(scope)
    return chosen(rows.orderBy(*order).limit(PREVIEW), columns)


def export(df: DataFrame, path: str, columns: dict[str, str], actor: str, form: str = "csv", scope: Column | None = None) -> DataFrame:
    """Write the files, an existing folder being an error, and return (action, actor_id, entity_type, entity_id, after): who exported what, and where to.

    ``after`` is JSON in the audit log's canonical form. Nobody's export is refused.
    """
    if form not in FORMATS:
        raise ValueError(f"{form} is none of {', '.join(FORMATS)}")
    if not actor:
        raise ValueError("an export needs an actor")
    writer = chosen(df, columns, scope).write.mode("errorifexists").format(form)
    (writer.options(header="true", escape='"') if form == "csv" else writer).save(path)
    spark = df.sparkSession
    n = spark.read.format(form).options(**({"header": "true", "escape": '"', "multiLine": "true"} if form == "csv" else {})).load(path).count()
    after = F.to_json(F.struct(F.array(*map(F.lit, columns)).alias("columns"), F.lit(form).alias("format"), F.lit(n).alias("rows")))
    return spark.range(1).select(F.lit(ACTION).alias("action"), F.lit(actor).alias("actor_id"), F.lit("results").alias("entity_type"), F.lit(path).alias("entity_id"), after.alias("after"))
