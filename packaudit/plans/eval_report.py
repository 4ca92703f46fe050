"""The evaluation report as long metric rows, and its summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.functions import skew
from packaudit.operators import evaluation as ev
from packaudit.session import stage


def melt(df: DataFrame, section: str, keys: list[str]) -> DataFrame:
    """Numeric columns of a small result to (section, key, metric, value) rows."""
    values = [f.name for f in df.schema.fields
              if f.name not in keys and f.dataType.simpleString() in ("double", "bigint", "int", "boolean")]
    cells = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.explode(cells).alias("c")).select(
        "section", "key", "c.metric", "c.value").where(F.col("value").isNotNull())


def run_facts(records: DataFrame) -> DataFrame:
    """Legible rate, number of cases and median time."""
    cases = ev.case_rows(records)
    fine = cases.where(F.col("error").isNull())
    base = fine.agg(F.count(F.lit(1)).alias("n_cases"),
                    F.avg(F.coalesce("legible", F.lit(False)).cast("double")).alias("legible_rate"))
    return base.crossJoin(F.broadcast(skew.selected_percentiles(fine, [], "elapsed_ms", {"median_elapsed_ms": 0.5})))


def eval_report(records: DataFrame, model: DataFrame, k: float = 4.0) -> DataFrame:
    """Every statistic of E2-E12 as (section, key, metric, value).

    All sections read the same records, which are written once, and so are their cases.
    """
    records = stage(records, "records")
    cases = stage(ev.case_rows(records), "cases")
    sections = [
        melt(run_facts(records), "run", []),
        melt(ev.field_stats(records), "fields", ["population", "field"]),
        melt(ev.height_stats(records), "height", []),
        melt(ev.height_stats(records, require_correct=True), "height_right_field", []),
        melt(ev.height_stats(records, ["tier"]), "height_by_tier", ["tier"]),
        melt(ev.height_stats(records, ["field"]), "height_by_field", ["field"]),
        melt(ev.error_by_resolution(records), "resolution", ["bin"]),
        melt(ev.error_by_tilt(records), "tilt", ["bin"]),
        melt(ev.planarity_null(cases), "planarity_null", ["statistic"]),
        melt(ev.verdict_stats(records), "verdicts", ["field"]),
        melt(ev.overall_stats(records), "overall", ["mode"]),
        melt(ev.band_validation(records, model), "band", []),
        melt(ev.gate_stats(records), "gates", ["key"]),
        melt(ev.derive_gates(records, k), "derived_gates", []),
        melt(ev.derive_slope_gate(cases), "derived_slopes", []),
    ]
    return reduce(lambda a, b: a.unionByName(b), sections)


SUMMARY = {
    "fields": ["n_adjudicated", "recall", "precision", "value_exact_match"],
    "height_by_field": ["n", "bias_mm", "sigma_mm", "mae_mm", "p95_abs_mm"],
    "height_by_tier": ["n", "bias_mm", "sigma_mm", "mae_mm", "p95_abs_mm"],
    "verdicts": ["n", "decisive_rate", "accuracy_on_decisive", "false_clear", "false_violation"],
    "overall": ["n_packs", "decided_rate", "accuracy_when_decided", "cleared_rate", "accused_rate"],
}


def eval_summary(report: DataFrame, section: str) -> DataFrame:
    """One summary table of the report, a row per key."""
    return (report.where(F.col("section") == section).groupBy("key")
            .pivot("metric", SUMMARY[section]).agg(F.first("value")))
