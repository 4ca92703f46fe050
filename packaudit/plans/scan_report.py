"""From recogniser tables to reports (Q11): the whole single-scan path as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit import dims, schemas
from packaudit.functions import text as tx
from packaudit.session import stage
from packaudit.operators import adjudication, capture, extraction, gates, glyphs, layout, rules


@dataclass
class Inputs:
    """captures (one row per scan), words of all passes, characters and glyph candidates per field.

    Glyphs and characters are in rectified pixels; ``chars`` holds the primary pass.
    """
    captures: DataFrame
    words: DataFrame
    chars: DataFrame
    glyphs: DataFrame


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``stage`` of a table that grows with the scans. Its files are far smaller than its rows, so that a join might broadcast it through the driver; it is merged instead."""
    return stage(df, name).hint("merge")


def measure_fields(glyph_rows: DataFrame, chars: DataFrame, rois: DataFrame, scale: DataFrame) -> DataFrame:
    """Glyph candidates to heights or a refusal per field (M1-M5)."""
    rel = layout.chars_in_roi(chars, rois).join(
        rois.select("scan_id", "field", F.col("x").alias("_rx")), ["scan_id", "field"]).select(
        "scan_id", "field", "c", (F.col("x") - F.col("_rx")).alias("x"), "w")
    shaped = _kept(glyphs.digit_restrict(glyphs.shape_filter(glyph_rows), rel), "shaped")
    kept = _kept(glyphs.height_consistent(shaped), "glyphs")
    fields = rois.select("scan_id", "field", F.col("w").alias("roi_w"), F.col("h").alias("roi_h"))
    why = glyphs.glyph_refusals(fields, shaped, kept)
    heights = glyphs.field_heights(kept, scale)
    out = why.join(heights, ["scan_id", "field"], "left")
    ok = F.col("meas_reason").isNull()
    return out.select("scan_id", "field", "meas_reason", F.when(ok, F.col("height_mm")).alias("measured_mm"),
                      F.when(ok, F.col("median_width_mm")).alias("median_width_mm"),
                      F.when(ok, F.col("n_glyphs")).alias("n_glyphs"))


def frame_facts(cal: DataFrame, plan: DataFrame, legible: DataFrame, model: DataFrame) -> DataFrame:
    """Calibration, planarity, legibility and uncertainty of each scan, as the structs of a report."""
    usable = F.col("metric_ok") & (F.coalesce("severity", F.lit("ok")) != "gross")
    method = F.when(F.col("known_px_per_mm") > 0, "known scale").when(F.col("calib_ok"), "marker")
    band = F.coalesce("band_override_mm", F.abs("bias_mm") + F.col("k") * F.col("sigma_mm"))
    parts = {
        "calibration": F.struct(usable.alias("usable"), method.alias("method"), "marker_id", "px_per_mm", "tilt_deg", "taper",
                                F.col("calib_reason").alias("reason")),
        "planarity": F.struct("n_baselines", "median_slope_deg", "slope_spread_deg", "severity", "band_penalty_mm"),
        "legibility": F.struct("legible", "reason_codes", "reasons", "n_words", "mean_conf", "median_word_px", "label_ppmm"),
        "uncertainty": F.struct("bias_mm", "sigma_mm", "k", band.alias("band_mm"), "min_px_per_mm", "source")}
    marker = F.col("marker_id") if "marker_id" in cal.columns else F.lit(None).cast("int")
    known = cal.select("scan_id", "metric_ok", "calib_ok", "known_px_per_mm", marker.alias("marker_id"), "px_per_mm", "tilt_deg", "taper",
                       "calib_reason")
    fitted = model.select("bias_mm", "sigma_mm", "k", "band_override_mm", "min_px_per_mm", "source")
    return (known.join(plan, "scan_id", "left").join(legible, "scan_id", "left").crossJoin(F.broadcast(fitted))
            .select("scan_id", *[parts[name].cast(kind).alias(name) for name, kind in schemas.FRAME.items()]))


def build_declarations(src: Inputs, model: DataFrame, use_fuzzy: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judged declarations (six per scan), the gate log and the facts of each frame.

    Lines, hits, value boxes and verdicts each feed several later steps, so they are
    written once and read back instead of being computed again by every reader.
    """
    spark = src.captures.sparkSession
    rule_rows, decl_rows = dims.rule_table(spark), dims.declarations(spark)
    scans = src.captures.select("scan_id")

    cal = capture.metric_scale(src.captures)
    cal_gate = gates.calibration_gate(cal, model)
    cal = _kept(cal.join(cal_gate.select("scan_id", F.lit(False).alias("_ok")), "scan_id", "left").withColumn(
        "metric_ok", F.coalesce("_ok", F.col("calib_ok"))).drop("_ok"), "captures")

    lines = _kept(layout.rebuild_lines(layout.merge_passes(src.words)), "lines")
    line_words = lines.select("scan_id", "line_no", F.posexplode("words").alias("word_no", "v")).select(
        "scan_id", "line_no", "word_no", "v.text", "v.x", "v.y", "v.w", "v.h", "v.conf")
    hits = _kept(extraction.extract_fields(lines, scans, decl_rows, use_fuzzy), "hits")

    legible = _kept(gates.legibility(scans, line_words, cal, model), "legible")
    plan = _kept(gates.planarity(scans, line_words, model), "plan")
    plane_gate = gates.planarity_gate(plan, cal)
    frame_gates = gates.gate_log(cal_gate, gates.legibility_gate(legible), plane_gate)
    reason = gates.scale_reason(frame_gates)

    rois = _kept(extraction.value_boxes(hits, lines), "rois")
    res = gates.local_resolution(rois, cal).select("scan_id", "field", "src_ppmm")
    measured = measure_fields(src.glyphs, src.chars, rois,
                              cal.select("scan_id", F.col("rect_px_per_mm").alias("px_per_mm")))

    qty = hits.where(F.col("field") == "net_quantity").select(
        "scan_id", F.col("quantity.kind").alias("quantity_kind"), F.col("quantity.base_value").alias("quantity_base"))
    per_scan = (cal.select("scan_id", "metric_ok", "print_style", "panel_area_cm2")
                .join(reason, "scan_id", "left")
                .join(plan.select("scan_id", "severity", F.col("band_penalty_mm").alias("_penalty")), "scan_id", "left")
                .join(legible.select("scan_id", "legible", "reasons"), "scan_id", "left")
                .join(qty, "scan_id", "left")
                .withColumn("metric_ok", F.col("metric_ok") & (F.coalesce("severity", F.lit("ok")) != "gross"))
                .withColumn("band_penalty_mm", F.when(F.col("metric_ok"), F.col("_penalty")).otherwise(F.lit(0.0)))
                .withColumn("print_style", F.coalesce("print_style", F.lit("normal")))
                .drop("_penalty", "severity"))
    fields = (hits.join(per_scan, "scan_id")
              .join(rois.select("scan_id", "field", F.lit(True).alias("_boxed")), ["scan_id", "field"], "left")
              .join(res, ["scan_id", "field"], "left").join(measured, ["scan_id", "field"], "left")
              .withColumn("has_box", F.coalesce("_boxed", F.lit(False))).drop("_boxed")
              .withColumn("expected_digits", tx.digit_count(F.col("value_text"))))
    fields = rules.required_height(fields, rule_rows, decl_rows)
    judged = _kept(adjudication.adjudicate(gates.presence_verdict(fields), model)
                   .withColumn("has_height", F.col("present")), "judged")
    low = gates.resolution_gate(
        judged.where(F.col("present") & (F.col("reason_code") == "resolution")), model)
    return judged, gates.gate_log(frame_gates, low), frame_facts(cal, plan, legible, model)


def assemble(captures: DataFrame, judged: DataFrame, gate_rows: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Nest declarations, gates and ``frame_facts`` into one report per scan (Q10, Q11).

    Six declarations and at most nine gates per scan. Without ``frames`` those columns are null.
    """
    height = F.struct(
        "informational", "required_mm", "advisory_required_mm", "measured_mm", "median_width_mm", "error_band_mm",
        F.col("src_ppmm").alias("source_px_per_mm"), "width_to_height_ratio", "band_inflation",
        F.col("rule_table").alias("rule"), "rule_row", "verdict", "advisory_verdict", "width_verdict", "reason", "reason_code",
        F.when(F.col("reason_code") == "scale", F.col("scale_gate")).alias("scale_gate"),
        F.col("n_glyphs").alias("n_numerals_measured"), F.col("expected_digits"), "glyph_count_matches_ocr")
    decl = F.struct("ord", F.struct(
        "field", "requirement", "presence_verdict", "present", "assessable", "value_text",
        "raw_text", tx.round_to("match_confidence", 2).alias("match_confidence"),
        "notes", F.when(F.col("has_height"), height).alias("height")).alias("d"))
    nested = judged.groupBy("scan_id").agg(F.sort_array(F.collect_list(decl)).alias("_d")).select(
        "scan_id", F.transform("_d", lambda v: v["d"]).cast(
            f"array<{schemas.DECLARATION}>").alias("declarations"))
    logged = gate_rows.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct(
        "seq", "gate", "blocking_height", "field", "detail"))).alias("gates"))
    summary = adjudication.rollup(judged)
    if frames is None:
        frames = captures.select("scan_id", *[F.lit(None).cast(kind).alias(name) for name, kind in schemas.FRAME.items()])
    return (captures.select("scan_id", "ts").join(frames, "scan_id").join(summary, "scan_id").join(nested, "scan_id")
            .join(logged, "scan_id", "left")
            .select("scan_id", "ts", "overall", "violations", "borderline", "not_assessed", "declarations",
                    F.coalesce("gates", F.array().cast(f"array<{schemas.GATE}>")).alias("gates"), *schemas.FRAME))


def build_reports(src: Inputs, model: DataFrame, use_fuzzy: bool = True) -> DataFrame:
    """Reports for every capture (Q11)."""
    judged, gate_rows, frames = build_declarations(src, model, use_fuzzy)
    return assemble(src.captures, judged, gate_rows, frames)
