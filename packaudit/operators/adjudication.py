"""Height verdicts and the per-scan roll-up (Q6-Q8, Q10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import text as tx
from packaudit.functions import rules as ru, skew
from packaudit.functions.rules import BORDERLINE, FAIL, NOT_ASSESSED, PASS


def band_inflation() -> Column:
    """Readings from one or two glyphs get a wider band (Q6)."""
    return F.when(F.col("n_glyphs").between(1, 2), F.lit(dims.LOW_GLYPH_INFLATION)).otherwise(F.lit(1.0))


def effective_band() -> Column:
    """Inflate the model first, then add the plane penalty (Q6)."""
    return ru.model_band(band_inflation(), F.coalesce(F.col("band_penalty_mm"), F.lit(0.0)))


REASON_TEXT = {
    "box": "numerals could not be boxed",
    "informational": "lettering, not numerals; for information",
    "confidence": "identified only by a value pattern",
}


def reason_text() -> Column:
    """Text of ``reason_code``, built only for the rows that carry one."""
    code, none = F.col("reason_code"), F.lit("")
    return (F.when(code.isNull(), none)
            .when(code == "lookup", F.coalesce(F.col("lookup_reason"), none))
            .when(code == "scale", F.coalesce(F.col("scale_reason"), F.lit("no usable physical scale")))
            .when(code == "measurement", F.coalesce(F.col("meas_reason"), F.lit("no numeral height")))
            .when(code == "resolution", F.format_string("%.1f px/mm is below the %.0f px/mm floor",
                                                        "src_ppmm", "min_px_per_mm"))
            .when(code == "count", F.concat(
                F.lit("measured "), F.col("n_glyphs").cast("string"), F.lit(" numeral(s) but the recogniser read "),
                F.col("_expected").cast("string")))
            .otherwise(F.try_element_at(dims.literal_map(REASON_TEXT), code)))


def adjudicate(fields: DataFrame, model: DataFrame) -> DataFrame:
    """One verdict per declaration, refusing for the first reason that applies (Q7, Q8).

    Needs field, informational, required_mm, advisory_required_mm, lookup_ok,
    lookup_reason, metric_ok, scale_gate, scale_reason, has_box, src_ppmm, meas_reason,
    measured_mm, median_width_mm, n_glyphs, expected_digits, match_confidence,
    value_text, band_penalty_mm. The order of refusals is part of the contract.

    The code of the reason and a few flags are columns of their own, so that no later
    expression repeats the chain and the generated method stays small enough to compile.
    """
    keep = [c for c in fields.columns if c not in ("measured_mm", "median_width_mm")]
    df = fields.crossJoin(F.broadcast(model.select(
        "bias_mm", "sigma_mm", "k", "band_override_mm", "min_px_per_mm", "apply_bias_correction")))
    low = F.coalesce((F.col("src_ppmm") > 0) & (F.col("src_ppmm") < F.col("min_px_per_mm")), F.lit(False))
    df = df.withColumns({
        "_expected": F.when(F.col("informational"), F.lit(0)).otherwise(F.coalesce("expected_digits", F.lit(0))),
        "_band": effective_band(), "_inflation": band_inflation(),
        "_refusal": F.when(~F.col("lookup_ok"), "lookup").when(~F.col("metric_ok"), "scale")
        .when(~F.col("has_box"), "box").when(low, "resolution").when(F.col("measured_mm").isNull(), "measurement")})
    df = df.withColumns({
        "_ok": F.col("_refusal").isNull(),
        "_match": ru.count_matches(F.col("n_glyphs"), F.col("_expected")),
        "_width": F.when((F.col("median_width_mm") > 0) & (F.col("measured_mm") > 0),
                         F.col("median_width_mm") / F.col("measured_mm"))})
    df = df.withColumns({
        "reason_code": F.coalesce("_refusal", F.when(F.col("informational"), "informational")
                                  .when(~F.col("_match"), "count")
                                  .when(F.col("match_confidence") < dims.MIN_JUDGE_CONF, "confidence")),
        "_judged": F.col("_ok") & ~F.col("informational")})

    def tier(required: str) -> Column:
        return ru.verdict(F.col("measured_mm"), F.col(required), F.col("_band"), F.col("bias_mm"),
                          F.col("apply_bias_correction"))

    ok, judged = F.col("_ok"), F.col("_judged")
    return df.select(
        *keep, F.when(ok, F.col("measured_mm")).alias("measured_mm"),
        F.when(ok, F.col("median_width_mm")).alias("median_width_mm"), F.when(ok, F.col("_band")).alias("error_band_mm"),
        F.when(ok, F.col("_inflation")).alias("band_inflation"),
        F.when(ok, F.col("_match")).alias("glyph_count_matches_ocr"), "reason_code", reason_text().alias("reason"),
        F.when(F.col("reason_code").isNotNull(), NOT_ASSESSED).otherwise(tier("required_mm")).alias("verdict"),
        F.when(judged & F.col("advisory_required_mm").isNotNull(), tier("advisory_required_mm"))
        .alias("advisory_verdict"),
        F.when(judged, F.col("_width")).alias("width_to_height_ratio"),
        F.when(judged, ru.width_verdict(F.col("_width"), F.col("value_text"))).alias("width_verdict"))


def overall(violations: Column, borderline: Column, not_assessed: Column) -> Column:
    """Any violation, else anything open, else compliant."""
    return (F.when(F.size(violations) > 0, "NON_COMPLIANT")
            .when((F.size(borderline) > 0) | (F.size(not_assessed) > 0), "REVIEW_REQUIRED")
            .otherwise("COMPLIANT"))


def mm_text(c: Column) -> Column:
    """Millimetres as a report shows them: three places, trailing zeros dropped to one."""
    return F.coalesce(tx.round_to(c, 3).cast("string"), F.lit("None"))


def messages(consensus: bool = False) -> Column:
    """The messages of one declaration as array<struct<kind,text>>.

    Needs field, presence_verdict, has_height, informational, verdict, reason,
    measured_mm, required_mm, width_verdict, and (for a single scan) assessable,
    legible, width_to_height_ratio. The consensus form skips a borderline width.
    """
    def msg(when: Column, kind: str, *text) -> Column:
        body = F.concat(F.col("field"), F.lit(": "), *[F.lit(t) if isinstance(t, str) else t for t in text])
        return F.when(when, F.struct(F.lit(kind).alias("kind"), body.alias("text")))

    height = F.col("has_height") & ~F.col("informational")
    size = ("numeral height ", mm_text(F.col("measured_mm")), " mm vs required ", mm_text(F.col("required_mm")), " mm")
    v, pv, wv = F.col("verdict"), F.col("presence_verdict"), F.col("width_verdict")
    if consensus:
        why = (F.lit("presence not machine-assessable"),)
        width = ("glyph width below one third of its height",)
    else:
        why = (F.lit("presence not machine-assessable"),
               F.when(F.col("assessable"), "").otherwise(" by rule"),
               F.when(F.col("legible"), "").otherwise(" in an illegible frame"))
        width = ("glyph width is ", mm_text(F.col("width_to_height_ratio")), " of its height, below one third")
    rows = [
        msg(pv == FAIL, "violation", "declaration not found"),
        msg(pv == NOT_ASSESSED, "open", *why),
        msg(height & (v == FAIL), "violation", *size),
        msg(height & (v == BORDERLINE), "borderline", *size, " (within measurement error)"),
        msg(height & (v == NOT_ASSESSED), "open", F.coalesce(F.col("reason"), F.lit(""))),
        msg(height & (wv == FAIL), "violation", *width),
    ]
    if not consensus:
        rows.append(msg(height & (wv == BORDERLINE), "borderline", *width, " (within measurement error)"))
    return F.array_compact(F.array(*rows))


def rollup(declarations: DataFrame, keys: list[str] | None = None, consensus: bool = False) -> DataFrame:
    """Messages and overall verdict of each scan, or of each pack.

    A key has at most six declarations, so the collected lists are small.
    """
    keys = keys or ["scan_id"]
    rows = declarations.select(*keys, "ord", messages(consensus).alias("m"))
    per = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "m"))).alias("_all"))
    flat = F.flatten(F.transform("_all", lambda r: r["m"]))

    def of(kind: str) -> Column:
        return F.transform(F.filter(flat, lambda m: m["kind"] == kind), lambda m: m["text"])

    out = per.select(*keys, of("violation").alias("violations"), of("borderline").alias("borderline"),
                     of("open").alias("not_assessed"))
    return out.withColumn("overall", overall(F.col("violations"), F.col("borderline"), F.col("not_assessed")))


def one_per_field(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each (scan, field)."""
    return skew.first_by(rows, ["scan_id", "field"], [F.col(order)])
