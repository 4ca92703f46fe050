"""Capture geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import geometry, skew


def quad_geometry(captures: DataFrame) -> DataFrame:
    """Side, tilt and taper of the marker; null without a marker (G1).

    The sides become columns first, so each square root is taken once.
    """
    named = captures.withColumns({f"_s{i}": s for i, s in enumerate(geometry.sides(F.col("corners")))})
    return (named.withColumns(geometry.quad_columns([F.col(f"_s{i}") for i in range(4)]))
            .drop(*[f"_s{i}" for i in range(4)]))


def with_homography(captures: DataFrame) -> DataFrame:
    """Add ``h_mm_to_px``: marker map (G3), or the diagonal map of a known scale."""
    k = F.col("known_px_per_mm")
    zero, one = F.lit(0.0), F.lit(1.0)
    diagonal = F.array(k, zero, zero, zero, k, zero, zero, zero, one)
    return captures.withColumn("h_mm_to_px", F.when(k > 0, diagonal).otherwise(
        geometry.square_homography(F.col("corners"), F.col("marker_length_mm"))))


def _to_mm(u: Column, v: Column) -> Column:
    """Pixel to mm point by the inverse of ``h_mm_to_px``; null on the horizon."""
    a, b, c, d, e, f, g, h, i = (F.get("h_mm_to_px", F.lit(n)) for n in range(9))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    x = (e * i - f * h) * u + (c * h - b * i) * v + (b * f - c * e)
    y = (f * g - d * i) * u + (a * i - c * g) * v + (c * d - a * f)
    w = (d * h - e * g) * u + (b * g - a * h) * v + (a * e - b * d)
    off = F.abs(F.try_divide(w, det)) > 1e-9
    return F.when(off, F.struct(F.try_divide(x, w).alias("x"), F.try_divide(y, w).alias("y")))


def metric_scale(captures: DataFrame) -> DataFrame:
    """Pixel scale, rectified canvas and usability of each capture.

    Adds px_per_mm, rect_px_per_mm, origin_x_mm, origin_y_mm, out_w, out_h, calib_ok and
    calib_reason (null when usable).
    """
    known = F.coalesce(F.col("known_px_per_mm") > 0, F.lit(False))
    df = with_homography(quad_geometry(captures))
    df = df.withColumns({
        "side_px": F.when(~known, F.col("side_px")),
        "tilt_deg": F.when(known, F.lit(0.0)).otherwise(F.col("tilt_deg")),
        "taper": F.when(known, F.lit(1.0)).otherwise(F.col("taper")),
        "px_per_mm": F.when(known, F.col("known_px_per_mm")).otherwise(
            F.try_divide(F.col("side_px"), F.col("marker_length_mm")))})
    w, h, zero = F.col("img_w").cast("double"), F.col("img_h").cast("double"), F.lit(0.0)
    pts = F.array_compact(F.array(_to_mm(zero, zero), _to_mm(w, zero), _to_mm(w, h), _to_mm(zero, h)))
    df = df.withColumn("_pts", F.when(~known & F.col("h_mm_to_px").isNotNull(), pts))
    lim = dims.MAX_EXTENT_MM

    def low(axis: str) -> Column:
        return F.greatest(F.array_min(F.transform("_pts", lambda p: p[axis])), F.lit(-lim))

    def high(axis: str) -> Column:
        return F.least(F.array_max(F.transform("_pts", lambda p: p[axis])), F.lit(lim))

    df = df.withColumns({"_x0": low("x"), "_y0": low("y"), "_x1": high("x"), "_y1": high("y"),
                         "_sc": F.least(F.greatest(F.col("px_per_mm"), F.lit(2.0)), F.lit(60.0))})
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    df = df.withColumns({"_w": F.rint(dx * F.col("_sc")), "_h": F.rint(dy * F.col("_sc"))})
    longest = F.greatest("_w", "_h")
    df = df.withColumn("_k", F.when(longest > dims.MAX_CANVAS_PX, dims.MAX_CANVAS_PX / longest).otherwise(F.lit(1.0)))
    reason = (F.when(known, F.lit(None).cast("string"))
              .when(F.col("corners").isNull(), "no marker found")
              .when(F.col("h_mm_to_px").isNull() | (F.size("_pts") < 3), "degenerate marker geometry")
              .when((dx < F.col("marker_length_mm")) | (dy < F.col("marker_length_mm")), "metric extent collapsed"))
    df = df.withColumn("calib_reason", reason)
    ok = F.col("calib_reason").isNull()
    return df.withColumns({
        "calib_ok": ok,
        "rect_px_per_mm": F.when(ok, F.when(known, F.col("px_per_mm")).otherwise(F.col("_sc") * F.col("_k"))),
        "origin_x_mm": F.when(ok, F.when(known, zero).otherwise(F.col("_x0"))),
        "origin_y_mm": F.when(ok, F.when(known, zero).otherwise(F.col("_y0"))),
        "out_w": F.when(ok & ~known, F.floor(F.col("_w") * F.col("_k")).cast("int")),
        "out_h": F.when(ok & ~known, F.floor(F.col("_h") * F.col("_k")).cast("int")),
    }).drop("_pts", "_x0", "_y0", "_x1", "_y1", "_sc", "_w", "_h", "_k")


def local_scale(x_px: Column, y_px: Column) -> Column:
    """Source px/mm at a rectified pixel, over joined ``metric_scale`` columns."""
    return geometry.local_px_per_mm(
        F.col("h_mm_to_px"), F.col("origin_x_mm") + F.try_divide(x_px, F.col("rect_px_per_mm")),
        F.col("origin_y_mm") + F.try_divide(y_px, F.col("rect_px_per_mm")))


CALIBRATION_COLS = ["scan_id", "calib_ok", "h_mm_to_px", "origin_x_mm", "origin_y_mm", "rect_px_per_mm"]


def pick_marker(scans: DataFrame, detections: DataFrame) -> DataFrame:
    """First detection, or the first with the requested id.

    Without a match ``calib_reason`` lists the ids that were seen. Ids come from a fixed
    printed dictionary, so the set per scan is small.
    """
    asked = detections.join(scans.select("scan_id", "requested_marker_id"), "scan_id")
    fits = asked.where(F.col("requested_marker_id").isNull() | (F.col("marker_id") == F.col("requested_marker_id")))
    first = skew.first_by(fits.select("scan_id", "det_no", "marker_id", "corners"), ["scan_id"], [F.col("det_no")])
    seen = detections.groupBy("scan_id").agg(F.array_sort(F.collect_set("marker_id")).alias("ids"))
    joined = scans.select("scan_id", "requested_marker_id").join(first, "scan_id", "left").join(
        seen, "scan_id", "left")
    reason = (F.when(F.col("marker_id").isNotNull(), F.lit(None).cast("string"))
              .when(F.col("ids").isNull(), "no marker found")
              .otherwise(F.concat(F.lit("marker "), F.col("requested_marker_id").cast("string"),
                                  F.lit(" not present; saw "), F.array_join("ids", ","))))
    return joined.select("scan_id", "marker_id", "corners", reason.alias("calib_reason"))
