"""Golden sets and predictions: JSON lines with comments, JSON maps, and the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from assayer import schemas
from assayer.functions import text
from assayer.operators import evaluation


class MalformedGoldenSet(ValueError):
    """A file of the golden set can't be read as it should; names the file and the line."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of a text file, without blank and // lines; none where there is no file.

    Files of any size: a split counts its own lines, and a line's number is its place in the split after the lines of the splits before.
    """
    try:
        raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file string, line int, text string")
    # Ids of a partition follow its rows, and a split's rows follow one another there.
    splits = raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = raw.join(splits.select("file", "start", (before - F.col("first") + 1).alias("shift")), ["file", "start"])
    return numbered.select("file", (F.col("at") + F.col("shift")).cast("int").alias("line"), F.col("value").alias("text")).filter((F.trim("text") != "") & ~F.ltrim("text").startswith("//"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Rows of a schema; raises MalformedGoldenSet for JSON that isn't, a wrong type or a missing key."""
    wider = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = read_lines(spark, path).withColumn("row", F.from_json("text", wider, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row._corrupt").isNotNull()
    for name in required:
        bad = bad | F.col(f"row.{name}").isNull()
    if first := rows.filter(bad).orderBy("file", "line").select("file", "line").take(1):
        raise MalformedGoldenSet(f"{first[0].file}:{first[0].line}")
    return rows.select("row.*").drop("_corrupt")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Transcriptions and marks of a folder; keys of transcriptions must be unique and marks in range."""
    lines = read_jsonl(spark, f"{folder}/transcriptions.jsonl", schemas.TRANSCRIPTION, ["booklet_id", "page_no", "line_index", "text"])
    lines = lines.withColumn("illegible", F.coalesce("illegible", F.lit(False)))
    marks = read_jsonl(spark, f"{folder}/marks.jsonl", schemas.MARK, ["booklet_id", "question_number", "max_marks", "marker_a", "marker_b"])
    for what, found in (("twice: ", evaluation.duplicate_keys(lines, ["booklet_id", "page_no", "line_index"])), ("out of range: ", evaluation.mark_violations(marks))):
        if rows := found.take(1):
            raise MalformedGoldenSet(f"{what}{rows[0].asDict()}")
    return lines, marks


def load_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(booklet_id, page_no, line_index, text) and (booklet_id, question_number, mark) of one JSON object."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "transcriptions map<string,string>, marks map<string,double>", {"mode": "FAILFAST"}).alias("p"))
    lines = raw.select(F.explode("p.transcriptions").alias("key", "text")).withColumn("k", F.split("key", ":"))
    marks = raw.select(F.explode("p.marks").alias("key", "mark")).withColumn("k", F.split("key", ":", 2))
    part = lambda i, kind: F.try_element_at("k", F.lit(i)).try_cast(kind)
    return lines.select(part(1, "string").alias("booklet_id"), part(2, "int").alias("page_no"), part(3, "int").alias("line_index"), "text"), marks.select(part(1, "string").alias("booklet_id"), part(2, "string").alias("question_number"), "mark")


def report(lines: DataFrame, marks: DataFrame, predicted_lines: DataFrame, predicted_marks: DataFrame) -> tuple[str, int]:
    """Plain text of both scores and an exit status: 1 if nothing was measured or a gate fails, else 0."""
    summary = evaluation.golden_summary(lines, marks).first()
    t = evaluation.score_transcriptions(lines, predicted_lines, ["booklet_id", "page_no", "line_index"]).first()
    m = evaluation.score_marks(marks, predicted_marks, ["booklet_id", "question_number"]).first()
    out = [
        f"text {text.describe()}",
        f"golden set: {summary.booklets} booklets, {summary.lines} lines ({summary.illegible} illegible), {summary.marks} marks ({summary.disagreements} disputed)",
        f"transcription: measured {t.measured}, skipped {t.skipped}, missing {t.missing}; CER {t.cer:.4f} {t.tier1}/{t.tier2}; WER {t.wer:.4f}",
        f"marking: matched {m.matched}; kappa {m.kappa_system} against {m.kappa_markers} between markers; {m.verdict}",
    ]
    failed = not t.measured or t.tier1 == "FAIL" or (m.matched and m.verdict == "FAIL")
    return "\n".join(out), int(bool(failed))


def main(arguments: list[str] | None = None) -> int:
    """``python -m assayer.sources.golden --golden DIR --predictions FILE [--strict]``: 2 for malformed input."""
    import argparse

    from assayer.session import session

    parser = argparse.ArgumentParser()
    parser.add_argument("--golden", required=True)
    parser.add_argument("--predictions", required=True)
    parser.add_argument("--strict", action="store_true")
    chosen = parser.parse_args(arguments)
    spark = session()
    try:
        text, status = report(*load(spark, chosen.golden), *load_predictions(spark, chosen.predictions))
    except MalformedGoldenSet as e:
        print(e)
        return 2
    print(text)
    return status if chosen.strict else 0


if __name__ == "__main__":
    raise SystemExit(main())
