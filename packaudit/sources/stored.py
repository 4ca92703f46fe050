"""Stored reports, records, models and truth rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit import dims, schemas
from packaudit.functions import text as tx


# ------------------------------------------------------------------ reports, records
def parse_reports(rows: DataFrame, column: str = "report_json") -> DataFrame:
    """Report JSON to typed columns."""
    return rows.select(F.from_json(column, schemas.REPORT).alias("r")).select("r.*")


def read_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schemas.REPORT).json(path, multiLine=multi_line)


def explode_records(cases: DataFrame) -> DataFrame:
    """One row per (case, field); cases that failed drop out."""
    keep = [c for c in cases.columns if c != "fields"]
    return (cases.where(F.col("error").isNull())
            .select(*keep, F.explode("fields").alias("field", "f")).select(*keep, "field", "f.*"))


def parse_eval_records(rows: DataFrame, column: str = "value") -> DataFrame:
    return explode_records(rows.select(F.from_json(column, schemas.EVAL_RECORD_JSON).alias("c")).select("c.*"))


def read_eval_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Stored evaluation records; one JSON object per line splits, a single array does not."""
    return explode_records(spark.read.schema(schemas.EVAL_RECORD_JSON).json(path, multiLine=multi_line))


# ------------------------------------------------------------------------ band model
def with_model_defaults(partial: DataFrame) -> DataFrame:
    """A band model with every missing key at its default."""
    have = set(partial.columns)
    return partial.select(*[
        F.coalesce(F.col(f.name) if f.name in have else F.lit(None),
                   F.lit(dims.DEFAULT_BAND_MODEL[f.name])).cast(f.dataType).alias(f.name)
        for f in schemas.BAND_MODEL.fields])


def load_band_model(spark: SparkSession, path: str) -> DataFrame:
    """One-row model from JSON; all defaults when there is no file."""
    try:
        stored = spark.read.schema(schemas.BAND_MODEL).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return dims.band_model(spark, {})
    return with_model_defaults(stored)


def save_band_model(model: DataFrame, path: str) -> None:
    """The model is one row, so one file is right."""
    model.coalesce(1).write.mode("overwrite").json(path)


def model_from_fit(gates: DataFrame, slopes: DataFrame | None = None, k: float = 4.0) -> DataFrame:
    """A band model from derived gates, ready to save (E11, E12 -> S7)."""
    base = gates.select(
        tx.round_to("bias_mm", 5).alias("bias_mm"), tx.round_to("sigma_mm", 5).alias("sigma_mm"), F.lit(k).alias("k"),
        tx.round_to("band_mm", 5).alias("band_override_mm"), F.col("floor").alias("min_px_per_mm"),
        F.format_string("fitted on %d measurements at or above %.0f px/mm", "n", "floor").alias("source"))
    if slopes is not None:
        base = base.crossJoin(F.broadcast(slopes))
    return with_model_defaults(base)


def read_height_truth(spark: SparkSession, path: str) -> DataFrame:
    """Known-height rows in printed order."""
    rows = spark.read.schema("rows_top_to_bottom array<struct<target_mm:double,true_height_mm:double>>").json(
        path, multiLine=True)
    return rows.select(F.posexplode("rows_top_to_bottom").alias("pos", "r")).select(
        (F.col("pos") + 1).alias("row_no"), "r.target_mm", "r.true_height_mm")


# --------------------------------------------------------------------------- sinks
def write_text_reports(lines: DataFrame, path: str, per_scan: bool = False) -> None:
    """Report lines as text.

    By default lines of one scan stay together in shared files, led by the scan's id.
    ``per_scan`` makes one folder per scan, for small exports only.
    """
    ordered = lines.repartition("scan_id").sortWithinPartitions("scan_id", "section", "ord")
    if per_scan:
        ordered.select("scan_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy(
            "scan_id").text(path)
    else:
        ordered.select(F.concat_ws("\t", "scan_id", "text").alias("value")).write.mode("overwrite").text(path)


def write_eval_report(report: DataFrame, path: str) -> None:
    """Evaluation metrics as JSON rows."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)
