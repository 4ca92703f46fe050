"""Accuracy and calibration statistics.

Records are long: one row per (case_id, field). Percentiles are exact; over few large
groups they come from ``selected_percentiles``, which never gathers a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import text as tx
from packaudit.functions import quantity, rules as ru, skew
from packaudit.functions.rules import ADJUDICATED, BORDERLINE, FAIL, NOT_ASSESSED, PASS
from packaudit.session import stage

CASE_COLS = ["tier", "overall", "legible", "calib_ok", "tilt_deg", "planarity_slope", "planarity_spread",
             "elapsed_ms", "error", "omitted"]


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def sigma(c: Column) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def rate(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1))


def _with_percentiles(agg: DataFrame, src: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    p = skew.selected_percentiles(src, by, value, probs)
    return agg.join(p, by) if by else agg.crossJoin(F.broadcast(p))


# -------------------------------------------------------------------------- records
def eval_records(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions joined with truth, with value correctness.

    ``truth`` has case_id, field, present, height_mm, value (double), unit, text. A field
    without a truth row counts as printed.
    """
    t = truth.select("case_id", "field", F.col("present").alias("_present"), F.col("height_mm").alias("gt_mm"),
                     F.col("value").alias("_value"), F.col("unit").alias("_unit"), F.col("text").alias("_text"))
    df = pred.join(t, ["case_id", "field"], "left")
    text = F.coalesce("value_text", F.lit(""))
    q = quantity.parse_net_quantity(text, True)
    stem = F.rtrim(q["unit"], F.lit("s"))
    right_quantity = F.coalesce((F.abs(q["value"] - F.col("_value")) < 1e-6)
                                & F.lower("_unit").contains(stem), F.lit(False))
    amount = quantity.decimal_text(F.when(text == "", "0").otherwise(text))
    right_price = F.coalesce(F.abs(amount - F.col("_value")) < 1e-6, F.lit(False))
    right_date = F.trim(F.replace(text, F.lit("-"), F.lit("/"))) == F.col("_text")
    correct = (F.when(~F.coalesce("_present", F.lit(False)), F.lit(None).cast("boolean"))
               .when(F.col("field") == "net_quantity", right_quantity)
               .when(F.col("field") == "mrp", right_price)
               .when(F.col("field") == "mfg_date", right_date))
    return (df.withColumn("present_gt", F.coalesce("_present", F.lit(True)))
            .withColumn("value_correct", correct).drop("_present", "_value", "_unit", "_text"))


def case_rows(records: DataFrame) -> DataFrame:
    """One row per case with the case-level columns."""
    cols = [c for c in CASE_COLS if c in records.columns]
    return records.groupBy("case_id").agg(*[F.any_value(c).alias(c) for c in cols])


def valid(records: DataFrame) -> DataFrame:
    return records.where(F.col("error").isNull())


def measured(records: DataFrame, require_correct: bool = False, adjudicated: bool = False) -> DataFrame:
    """Judged fields with both heights, as error rows ``e`` (and ``ae``)."""
    df = valid(records).where(F.col("field").isin(*dims.JUDGED_FIELDS) & F.col("gt_mm").isNotNull()
                              & F.col("measured_mm").isNotNull())
    if require_correct:
        df = df.where(F.coalesce("value_correct", F.lit(True)))
    if adjudicated:
        df = df.where(F.col("verdict").isin(*ADJUDICATED))
    return df.withColumn("e", F.col("measured_mm") - F.col("gt_mm")).withColumn("ae", F.abs("e"))


# ----------------------------------------------------------------------- statistics
def height_stats(records: DataFrame, by: list[str] | None = None, require_correct: bool = False) -> DataFrame:
    """Height error with two yields (E2). Groups without a measurement are left out."""
    by = by or []
    df = valid(records).where(F.col("field").isin(*dims.JUDGED_FIELDS) & F.coalesce("present_gt", F.lit(True)))
    if require_correct:
        df = df.where(F.coalesce("value_correct", F.lit(True)))
    found = F.col("gt_mm").isNotNull()
    df = df.withColumn("e", F.when(found, F.col("measured_mm") - F.col("gt_mm"))).withColumn("ae", F.abs("e"))
    rel = F.try_divide("e", "gt_mm")
    agg = df.groupBy(*by).agg(
        F.count("e").alias("n"), F.count(F.lit(1)).alias("n_printed"), count_if(found).alias("n_found"),
        F.avg("e").alias("bias_mm"), sigma(F.col("e")).alias("sigma_mm"), F.avg("ae").alias("mae_mm"),
        F.max("ae").alias("max_abs_mm"), (F.avg(rel) * 100).alias("mean_rel_pct"),
        (F.avg(F.abs(rel)) * 100).alias("mae_rel_pct"))
    agg = agg.where(F.col("n") > 0).withColumns({
        "yield_given_found": rate(F.col("n"), F.col("n_found")),
        "yield_end_to_end": rate(F.col("n"), F.col("n_printed"))})
    return _with_percentiles(agg, df, by, "ae", {"p95_abs_mm": 0.95})


def bucket(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin; null counts as 0."""
    v = F.coalesce(value, F.lit(0.0))
    return reduce(lambda acc, e: acc + (v >= e).cast("int"), edges, F.lit(0))


def error_by_bin(records: DataFrame, column: str, edges: list[float], labels: list[str],
                 require_correct: bool = True, p95: bool = True) -> DataFrame:
    """Height error by bins of a column (E3, E4); empty bins are absent."""
    df = measured(records, require_correct).withColumn("bin_no", bucket(F.col(column), edges))
    agg = df.groupBy("bin_no").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("bias_mm"),
                                   sigma(F.col("e")).alias("sigma_mm"), F.avg("ae").alias("mae_mm"))
    if p95:
        agg = _with_percentiles(agg, df, ["bin_no"], "ae", {"p95_abs_mm": 0.95})
    return agg.withColumn("bin", F.get(F.array(*[F.lit(v) for v in labels]), F.col("bin_no")))


def error_by_resolution(records: DataFrame, require_correct: bool = True) -> DataFrame:
    """Error by capture resolution."""
    return error_by_bin(records, "src_ppmm", dims.RESOLUTION_EDGES, dims.RESOLUTION_LABELS, require_correct, False)


def error_by_tilt(records: DataFrame, require_correct: bool = True) -> DataFrame:
    """Error by marker tilt."""
    return error_by_bin(records, "tilt_deg", dims.TILT_EDGES, dims.TILT_LABELS, require_correct).drop("mae_mm")


def band_validation(records: DataFrame, model: DataFrame) -> DataFrame:
    """Does the band cover the measurements it is used on? (E5)"""
    band = F.coalesce(F.col("band_override_mm"), F.lit(0.0))
    df = measured(records, adjudicated=True).crossJoin(F.broadcast(model.select(band.alias("band_mm"))))
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.first("band_mm").alias("band_mm"), F.max("ae").alias("max_abs_mm"),
                 F.avg((F.col("ae") > F.col("band_mm")).cast("double")).alias("fraction_outside"))
    out = _with_percentiles(agg, df, [], "ae", {"p95_abs_mm": 0.95, "p99_abs_mm": 0.99})
    return out.withColumn("band_covers_p95", F.col("p95_abs_mm") <= F.col("band_mm"))


def planarity_null(cases: DataFrame) -> DataFrame:
    """Quantiles of the plane statistics over frames known to be flat (E6). Long: one row per statistic."""
    df = valid(cases)
    long = df.select(F.explode(F.array(
        F.struct(F.lit("abs_median_slope_deg").alias("statistic"), F.abs("planarity_slope").alias("v")),
        F.struct(F.lit("slope_spread_deg").alias("statistic"), F.col("planarity_spread").alias("v")))).alias("s")
    ).select("s.*").where(F.col("v").isNotNull())
    agg = long.groupBy("statistic").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max"))
    return _with_percentiles(agg, long, ["statistic"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def field_stats(records: DataFrame) -> DataFrame:
    """Presence and value accuracy per field for all, legible and illegible frames.

    The three populations come from one pass over grouping sets.
    """
    assessable = F.coalesce("assessable", F.lit(True))
    pred, gt = F.coalesce("present_pred", F.lit(False)), F.coalesce("present_gt", F.lit(True))
    abstained = assessable & ~pred & F.coalesce(F.col("presence_verdict") == NOT_ASSESSED, F.lit(False))
    scored = assessable & ~abstained
    df = valid(records).select(
        "field", F.coalesce("legible", F.lit(False)).alias("legible"), assessable.alias("assessable"),
        abstained.alias("abstained"), scored.alias("scored"), pred.alias("p"), gt.alias("g"), "value_correct")
    s, p, g = F.col("scored"), F.col("p"), F.col("g")
    agg = df.groupingSets([[F.col("field")], [F.col("field"), F.col("legible")]],
                          F.col("field"), F.col("legible")).agg(
        F.grouping("legible").alias("_all"),
        count_if(s & p & g).alias("tp"), count_if(s & p & ~g).alias("fp"), count_if(s & ~p & g).alias("fn"),
        count_if(s & ~p & ~g).alias("tn"), count_if(F.col("abstained")).alias("n_abstained"),
        count_if(~F.col("assessable")).alias("n_excluded"),
        count_if(s & F.col("value_correct").isNotNull()).alias("value_n"),
        count_if(s & F.col("value_correct")).alias("value_right"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    tp = F.col("tp")
    excluded = (F.col("n_excluded") > 0) & (n + F.col("n_abstained") == 0)
    return agg.select(
        F.when(F.col("_all") == 1, "all").when(F.col("legible"), "legible").otherwise("illegible").alias("population"),
        "field", "tp", "fp", "fn", "tn", n.alias("n_adjudicated"), "n_abstained", "n_excluded",
        excluded.alias("excluded_by_rule"),
        F.try_divide(F.col("n_abstained"), n + F.col("n_abstained")).alias("abstention_rate"),
        F.try_divide(tp + F.col("tn"), n).alias("presence_accuracy"),
        F.when(~excluded, rate(tp, tp + F.col("fn"))).alias("recall"),
        F.when(~excluded, rate(tp, tp + F.col("fp"))).alias("precision"),
        "value_n", F.try_divide("value_right", "value_n").alias("value_exact_match"))


def verdict_stats(records: DataFrame) -> DataFrame:
    """Height verdicts against truth per field, near and clear of the threshold."""
    df = valid(records).where(
        F.col("field").isin(*dims.JUDGED_FIELDS) & F.col("gt_mm").isNotNull() & F.col("required_mm").isNotNull()
        & F.coalesce("present_gt", F.lit(True))).select(
        "field", F.when(F.col("gt_mm") >= F.col("required_mm"), PASS).otherwise(FAIL).alias("t"),
        F.coalesce("verdict", F.lit(NOT_ASSESSED)).alias("p"),
        (F.abs(F.col("gt_mm") - F.col("required_mm")) <= dims.NEAR_MM).alias("near"))
    t, p, near = F.col("t"), F.col("p"), F.col("near")
    decisive = p.isin(PASS, FAIL)
    agg = df.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), count_if(decisive).alias("decisive"), count_if(p == t).alias("correct"),
        count_if((t == FAIL) & (p == PASS)).alias("false_clear"),
        count_if((t == PASS) & (p == FAIL)).alias("false_violation"),
        count_if(p == BORDERLINE).alias("borderline"), count_if(p == NOT_ASSESSED).alias("not_assessed"),
        count_if(near).alias("near_n"), count_if(near & (p == BORDERLINE)).alias("near_borderline"),
        count_if(near & decisive & (p != t)).alias("near_wrong"),
        count_if(~near).alias("clear_n"), count_if(~near & decisive).alias("clear_decisive"),
        count_if(~near & (p == t)).alias("clear_correct"),
        count_if(~near & decisive & (p != t)).alias("clear_wrong"))
    n = F.col("n")
    return agg.withColumns({
        "decisive_rate": F.col("decisive") / n,
        "accuracy_on_decisive": rate(F.col("correct"), F.col("decisive")),
        "false_clear_rate": F.col("false_clear") / n, "false_violation_rate": F.col("false_violation") / n,
        "borderline_rate": F.col("borderline") / n, "not_assessed_rate": F.col("not_assessed") / n,
        "near_borderline_rate": rate(F.col("near_borderline"), F.col("near_n")),
        "clear_accuracy": rate(F.col("clear_correct"), F.col("clear_decisive"))})


def pack_truth(records: DataFrame, gt_required: Column | None = None) -> DataFrame:
    """True state of each case in both modes, beside the verdict given.

    ``gt_required`` is the height the printed text had to reach (the default panel's).
    """
    req = F.col("required_mm") if gt_required is None else gt_required
    short = (F.col("field").isin(*dims.JUDGED_FIELDS) & F.coalesce("present_gt", F.lit(False))
             & F.coalesce(F.col("gt_mm") < req, F.lit(False)))
    per = valid(records).groupBy("case_id").agg(
        F.any_value("overall").alias("overall"), F.bool_or(short).alias("short"),
        F.any_value(F.coalesce("omitted", F.array().cast("array<string>"))).alias("omitted"))
    modes = per.withColumn("mode", F.explode(F.array(F.lit("strict"), F.lit("assessable"))))
    gone = F.when(F.col("mode") == "strict", F.col("omitted")).otherwise(
        F.array_remove("omitted", "commodity_name"))
    bad = F.col("short") | (F.size(gone) > 0)
    return modes.select("case_id", "mode", "overall",
                        F.when(bad, "NON_COMPLIANT").otherwise("COMPLIANT").alias("truth"))


def overall_stats(records: DataFrame, gt_required: Column | None = None) -> DataFrame:
    """Accuracy of the verdict a user sees."""
    t, p = F.col("truth"), F.coalesce("overall", F.lit(""))
    decided = p != "REVIEW_REQUIRED"
    agg = pack_truth(records, gt_required).groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_packs"), count_if(t == "NON_COMPLIANT").alias("truth_non_compliant"),
        count_if(~decided).alias("review_required"), count_if(decided).alias("decided"),
        count_if(decided & (p == t)).alias("correct"),
        count_if((t == "NON_COMPLIANT") & (p == "COMPLIANT")).alias("violating_pack_cleared"),
        count_if((t == "COMPLIANT") & (p == "NON_COMPLIANT")).alias("compliant_pack_accused"))
    n = F.col("n_packs")
    return agg.withColumns({
        "review_required_rate": F.col("review_required") / n, "decided_rate": F.col("decided") / n,
        "accuracy_when_decided": rate(F.col("correct"), F.col("decided")),
        "cleared_rate": F.col("violating_pack_cleared") / n, "accused_rate": F.col("compliant_pack_accused") / n})


def overall_confusion(records: DataFrame, gt_required: Column | None = None) -> DataFrame:
    """Truth by verdict counts for both modes."""
    return pack_truth(records, gt_required).groupBy("mode", "truth", "overall").agg(F.count(F.lit(1)).alias("n"))


def gate_stats(records: DataFrame) -> DataFrame:
    """Cases, failures and reasons for missing heights by ``reason_code`` (E10). Long: key, n."""
    cases = case_rows(records).select(F.explode(F.array_compact(F.array(
        F.when(F.col("error").isNotNull(), "exception"), F.when(F.col("error").isNull(), "total"),
        F.when(F.col("error").isNull() & F.col("calib_ok"), "calibrated")))).alias("key"))
    code = F.col("reason_code")
    why = (F.when(code == "resolution", "abstain_INSUFFICIENT_RESOLUTION").when(code == "scale", "abstain_NO_SCALE")
           .when(code.isin("measurement", "box", "count", "informational"), "abstain_NO_GLYPHS").otherwise("abstain_OTHER"))
    missing = valid(records).where(
        F.col("field").isin(*dims.JUDGED_FIELDS) & F.col("measured_mm").isNull()
        & F.coalesce("present_gt", F.lit(True)) & F.col("gt_mm").isNotNull()).select(why.alias("key"))
    return cases.groupBy("key").agg(F.count(F.lit(1)).alias("n")).unionByName(
        missing.groupBy("key").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------- calibration
def floor_sweep(records: DataFrame) -> DataFrame:
    """Error statistics at and above each candidate resolution floor.

    A measurement falls into one bin, the number of floors it reaches. Count, mean and squared deviation of a bin merge into those
    of every floor at or below it, so no measurement is copied per floor. Floors that none reaches have no row.
    """
    reached = F.size(F.filter(F.array(*[F.lit(f) for f in dims.FLOOR_SWEEP]), lambda f: F.coalesce("src_ppmm", F.lit(0.0)) >= f))
    df = stage(measured(records, True, True).select("e", "ae", reached.alias("level")).where("level > 0"), "errors")
    bins = df.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("m"), F.var_pop("e").alias("v"), F.avg("ae").alias("a"))
    upward = bins.select(F.explode(F.sequence(F.lit(1), "level")).alias("level"), "n", "m", "v", "a")
    whole = upward.groupBy("level").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("bias_mm"),
                                        (F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("mae_mm"),
                                        F.collect_list(F.struct("n", "m", "v")).alias("parts"))
    squares = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["n"] * (x["v"] + F.pow(x["m"] - F.col("bias_mm"), 2)))
    p = skew.suffix_percentiles(df, "level", len(dims.FLOOR_SWEEP), "ae", {"p95_abs_mm": 0.95, "p99_abs_mm": 0.99})
    floor = F.element_at(F.array(*[F.lit(f) for f in dims.FLOOR_SWEEP]), F.col("level"))
    return whole.join(p, "level").select(
        floor.alias("floor"), "n", "bias_mm", F.sqrt(F.try_divide(squares, F.col("n") - 1)).alias("sigma_mm"), "mae_mm", "p95_abs_mm", "p99_abs_mm")


def derive_gates(records: DataFrame, k: float = 4.0) -> DataFrame:
    """Resolution floor and error band from calibration records (E11). One row.

    The first floor with at least 20 samples, p95 and sigma within tolerance wins (both
    compared at four decimals); 12 otherwise. The band covers the 99th percentile.
    """
    sweep = floor_sweep(records)
    passes = ((F.col("n") >= dims.FLOOR_MIN_SAMPLES) & (tx.round_to("p95_abs_mm", 4) <= dims.FLOOR_MAX_P95)
              & (tx.round_to("sigma_mm", 4) <= dims.FLOOR_MAX_SIGMA))
    # The sweep has at most one row a floor, so its rows fit in one.
    one = sweep.agg(F.coalesce(F.min(F.when(passes, F.col("floor"))), F.lit(dims.FLOOR_FALLBACK)).alias("chosen"),
                    F.collect_list(F.struct(*sweep.columns)).alias("rows"))
    out = one.select("chosen", F.inline("rows")).where("floor = chosen").drop("chosen")
    return out.withColumn("k", F.lit(float(k))).withColumn(
        "band_mm", F.greatest(F.abs("bias_mm") + F.lit(float(k)) * F.col("sigma_mm"), F.col("p99_abs_mm")))


def derive_slope_gate(cases: DataFrame, min_deg: float = 0.25, factor: float = 1.5) -> DataFrame:
    """Clean limits for slope and spread from the flat-frame distribution (E12). One row."""
    null = planarity_null(cases)
    s = F.max(F.when(F.col("statistic") == "abs_median_slope_deg", F.col("p99")))
    d = F.max(F.when(F.col("statistic") == "slope_spread_deg", F.col("p99")))
    limit = null.agg(s.alias("s"), d.alias("d"))
    return limit.select(
        tx.round_to(F.greatest(F.lit(min_deg), F.coalesce(F.col("s") * factor, F.lit(0.0))), 3)
        .alias("max_baseline_slope_deg"),
        tx.round_to(F.greatest(F.lit(min_deg * 2), F.coalesce(F.col("d") * factor, F.lit(0.0))), 3)
        .alias("max_baseline_spread_deg"))


def fit_physical(pairs: DataFrame, k: float = 2.0) -> DataFrame:
    """Error band from rows of known height (E13). One row; ``usable`` needs ten pairs.

    ``pairs`` holds scan_id, height_mm, true_height_mm.
    """
    df = pairs.where(F.col("height_mm").isNotNull()).withColumn(
        "e", F.col("height_mm") - F.col("true_height_mm")).withColumn("ae", F.abs("e"))
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("scan_id").alias("n_scans"),
                 F.avg("e").alias("bias_mm"), F.stddev_samp("e").alias("sigma_mm"))
    out = _with_percentiles(agg, df, [], "ae", {"p95_abs_mm": 0.95})
    band = F.greatest(F.abs("bias_mm") + F.lit(float(k)) * F.col("sigma_mm"), F.col("p95_abs_mm"))
    return out.select(
        "n", "n_scans", "bias_mm", "sigma_mm", "p95_abs_mm", F.lit(float(k)).alias("k"),
        band.alias("band_override_mm"), (F.col("n") >= dims.PHYSICAL_MIN_SAMPLES).alias("usable"),
        F.format_string("physical calibration: %d numeral measurements from %d scans", "n", "n_scans")
        .alias("source"))


def band_sweep(records: DataFrame, model: DataFrame) -> DataFrame:
    """Replay adjudicated measurements at a range of bands and the fitted one.

    ``safest`` marks the smallest band without a wrong decisive verdict. As a band grows, a measurement is decisive, always with
    the same verdict, up to some band and borderline beyond. So each is counted once, by the number of bands at which it is decisive,
    and what is decisive at a band is the sum over those that hold out longer, a running sum over as many rows as there are bands.
    """
    bands = F.array_sort(F.array_distinct(F.concat(
        F.array(*[F.lit(b) for b in dims.BAND_SWEEP]),
        F.array_compact(F.array(tx.round_to("band_override_mm", 4))))))
    m, req = F.col("measured_mm"), F.col("required_mm")
    holds = F.size(F.filter("bands", lambda b: (m >= req + b) | (m <= req - b)))
    wrong = (m >= req) != (F.col("gt_mm") >= req)
    rows = (measured(records, adjudicated=True).where(req.isNotNull())
            .crossJoin(F.broadcast(model.select(bands.alias("bands"))))
            .select(holds.alias("i"), wrong.alias("wrong"), (F.abs(F.col("gt_mm") - req) <= dims.NEAR_MM).alias("near")))
    counts = rows.groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("wrong")).alias("wrong"), count_if(F.col("near")).alias("near"),
        count_if(F.col("near") & F.col("wrong")).alias("near_wrong"))
    listed = model.select(F.posexplode(bands).alias("i", "band")).select(
        "band", (F.col("i") + 1).alias("i"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "wrong", "near", "near_wrong")])
    both = listed.unionByName(counts.withColumn("band", F.lit(None).cast("double")))
    all_, longer = W.partitionBy(), W.orderBy(F.desc("i")).rangeBetween(W.unboundedPreceding, 0)
    per = both.select(
        "band", F.sum("n").over(all_).alias("n"), F.sum("n").over(longer).alias("decisive"), F.sum("wrong").over(longer).alias("wrong"),
        F.sum("near").over(all_).alias("near_n"), F.sum("near").over(longer).alias("near_decisive"),
        F.sum("near_wrong").over(longer).alias("near_wrong")).where("band is not null and n > 0")
    safe = per.agg(F.min(F.when(F.col("wrong") == 0, F.col("band"))).alias("_safe"))
    return per.crossJoin(F.broadcast(safe)).select(
        "band", "n", "decisive", "wrong", "near_n", "near_decisive", "near_wrong",
        (F.col("decisive") / F.col("n")).alias("decisive_rate"),
        F.coalesce(F.col("band") == F.col("_safe"), F.lit(False)).alias("safest"))


def assign_split(cases: DataFrame, tiers: list[str] | None = None, calibration_share: float = 0.5,
                 id_col: str = "case_id") -> DataFrame:
    """Tier by position in the list, split by a stable hash of the case."""
    names = tiers or dims.TIERS
    tier = F.get(F.array(*[F.lit(t) for t in names]), F.pmod(F.col(id_col), F.lit(len(names))).cast("int"))
    part = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 6), 16, 10).cast("bigint") / F.lit(2 ** 24)
    return cases.withColumn("tier", tier).withColumn(
        "split", F.when(part < calibration_share, "calibration").otherwise("validation"))
