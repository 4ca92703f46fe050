"""Glyph selection and field heights (M1-M5, M7, M8).

Per-group medians and counts are aggregates joined back to the rows, not windows over
the group, so they combine before the shuffle and a hot field can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import scan, skew

KEYS = ["scan_id", "field"]
MIN_AREA, MIN_HEIGHT = 5, 3
ASPECT, FILL = (0.12, 1.7), (0.12, 0.97)
HEIGHT_SLACK, HEIGHT_SLACK_PX = 0.25, 1.0


def shape_filter(glyphs: DataFrame) -> DataFrame:
    """Components shaped like a numeral that do not touch the crop's edge (M1)."""
    x, y, w, h, area = (F.col(c) for c in ("x", "y", "w", "h", "area"))
    aspect = w / F.greatest(F.lit(1.0), h)
    fill = area / F.greatest(F.lit(1.0), w * h)
    return glyphs.where(
        (area >= MIN_AREA) & (h >= MIN_HEIGHT) & (x > 0) & (y > 0)
        & (x + w < F.col("crop_w")) & (y + h < F.col("crop_h"))
        & aspect.between(*ASPECT) & fill.between(*FILL))


def digit_restrict(glyphs: DataFrame, chars: DataFrame) -> DataFrame:
    """Keep glyphs centred on a recognised digit, if that leaves a usable set (M2).

    ``chars`` holds (scan_id, field, c, x, w) in crop coordinates. The restriction holds
    when two or more survive, or one of at most two. Adds ``used_char_boxes``. A sweep finds the centres inside a digit, so a
    field of many glyphs and digits costs no pairs and spreads over tasks.
    """
    digits = chars.where(F.col("c").rlike("^[0-9]$")).select(
        *KEYS, F.greatest(F.col("x"), F.lit(0)).alias("a"), (F.col("x") + F.col("w")).alias("b")).where("a < b")
    edge = F.explode(F.array(F.struct(F.col("a").cast("double").alias("at"), F.lit(1).alias("step")),
                             F.struct(F.col("b").cast("double").alias("at"), F.lit(-1).alias("step")))).alias("e")
    none = F.lit(None).cast(glyphs.select(F.struct("*").alias("g")).schema["g"].dataType)
    edges = digits.select(*KEYS, edge).select(*KEYS, "e.at", F.lit(0).alias("turn"), "e.step", none.alias("g"))
    centre = F.floor(F.col("x") + F.col("w") / 2.0)
    inside = (centre >= 0) & (centre < F.col("crop_w"))
    points = glyphs.select(*KEYS, centre.cast("double").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("step"),
                           F.struct("*").alias("g"), inside.alias("inside"))
    # Along a field, from left to right: how many digit boxes are open where a glyph's centre lies. Edges come before centres at the same place.
    laid = scan.laid_by_key(points.unionByName(edges.withColumn("inside", F.lit(False))), KEYS, ["at", "turn"])
    swept = scan.running(laid, KEYS, {"open": F.col("step")}).where("turn = 1")
    flagged = swept.select("g.*", F.when(F.col("inside") & (F.col("open") > 0), True).alias("_hit"))
    counts = flagged.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.count("_hit").alias("_k"))
    usable = (F.col("_k") >= 2) | ((F.col("_k") == 1) & (F.col("_n") <= 2))
    return (flagged.join(counts.select(*KEYS, usable.alias("used_char_boxes")), KEYS)
            .where(~F.col("used_char_boxes") | F.col("_hit")).drop("_hit"))


def height_consistent(glyphs: DataFrame) -> DataFrame:
    """Drop glyphs far from the field's median height (M3).

    Heights here are whole pixel rows, so a field has few distinct values to count.
    """
    med = glyphs.groupBy(*KEYS).agg(F.percentile("h", 0.5).alias("_med"))
    return (glyphs.join(med, KEYS)
            .where(F.abs(F.col("h") - F.col("_med")) <= HEIGHT_SLACK * F.col("_med") + HEIGHT_SLACK_PX)
            .drop("_med"))


def glyph_refusals(fields: DataFrame, candidates: DataFrame, kept: DataFrame, min_glyphs: int = 1) -> DataFrame:
    """Why a field yields no height; null when it does (M4).

    ``fields`` holds (scan_id, field, roi_w, roi_h), ``candidates`` the glyphs before and
    ``kept`` those after the height check, both with used_char_boxes.
    """
    n = candidates.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.bool_or("used_char_boxes").alias("_used"))
    k = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_k"))
    got = F.coalesce("_k", F.lit(0))
    reason = (F.when((F.col("roi_w") < 3) | (F.col("roi_h") < 3), "field region too small to measure")
              .when(F.col("_n").isNull(), "no numeral-like glyph in the field")
              .when(got < max(1, min_glyphs), "too few height-consistent numerals")
              .when((got == 1) & ~F.coalesce("_used", F.lit(False)), "single numeral without character confirmation"))
    return fields.join(n, KEYS, "left").join(k, KEYS, "left").select(
        *fields.columns, F.coalesce("_n", F.lit(0)).alias("n_candidates"), got.alias("n_kept"),
        reason.alias("meas_reason"))


def field_heights(glyphs: DataFrame, px_per_mm: DataFrame | None = None) -> DataFrame:
    """Median height, quartile spread, median width and count per field (M5).

    ``px_per_mm`` holds (scan_id, px_per_mm); without it values stay in pixels.
    """
    hs = skew.percentiles(glyphs, KEYS, "h_subpx", {"q1": 0.25, "h_px": 0.5, "q3": 0.75})
    ws = glyphs.groupBy(*KEYS).agg(F.percentile("w", 0.5).alias("w_px"), F.count(F.lit(1)).alias("n_glyphs"))
    out = hs.join(ws, KEYS)
    scale: Column = F.lit(1.0)
    if px_per_mm is not None:
        out, scale = out.join(px_per_mm.select("scan_id", "px_per_mm"), "scan_id"), F.col("px_per_mm")
    return out.select(
        *KEYS, (F.col("h_px") / scale).alias("height_mm"), F.col("h_px").alias("height_px"),
        ((F.col("q3") - F.col("q1")) / scale).alias("spread_mm"), (F.col("w_px") / scale).alias("median_width_mm"),
        "n_glyphs", (F.col("n_glyphs") < 3).alias("low_glyph_count"))


def mid_level(samples: DataFrame) -> DataFrame:
    """Midpoint of the 5th and 95th percentile of a series (M8)."""
    p = skew.percentiles(samples, ["series_id"], "v", {"lo": 0.05, "hi": 0.95})
    return p.select("series_id", ((F.col("lo") + F.col("hi")) / 2.0).alias("level"))


def level_crossing_extent(samples: DataFrame) -> DataFrame:
    """First and last crossing of zero over the columns of a series, between samples (M7).

    ``samples`` holds (series_id, col, pos, v): v above zero is ink, pos is dense from 0.
    """
    col = ["series_id", "col"]
    near = skew.in_blocks(samples, col, "pos", 1, 1, {
        "_prev": lambda w: F.lag("v").over(w), "_next": lambda w: F.lead("v").over(w)})
    ink = near.where(F.col("v") > 0)
    edges = ink.groupBy(*col).agg(
        F.min_by(F.struct("pos", "v", "_prev"), "pos").alias("i"),
        F.max_by(F.struct("pos", "v", "_next"), "pos").alias("j"))
    i, j = F.col("i"), F.col("j")
    top = F.when(i["_prev"].isNull(), F.lit(0.0)).otherwise(
        i["pos"] - 1 + F.coalesce(F.try_divide(-i["_prev"], i["v"] - i["_prev"]), F.lit(1.0)))
    bot = F.when(j["_next"].isNull(), j["pos"].cast("double")).otherwise(
        j["pos"] + F.coalesce(F.try_divide(j["v"], j["v"] - j["_next"]), F.lit(0.0)))
    return edges.groupBy("series_id").agg(F.min(top).alias("top"), F.max(bot).alias("bottom"))
