"""Scalar rules as column expressions (R4, R5, R6, R7, M6, H-less helpers)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from packaudit import dims

PASS, FAIL, BORDERLINE, NOT_ASSESSED = "PASS", "FAIL", "BORDERLINE", "NOT_ASSESSED"
ADJUDICATED = [PASS, FAIL, BORDERLINE]


def band_mm(bias: Column, sigma: Column, k: Column, override: Column, extra: Column | float = 0.0,
            inflation: Column | float = 1.0) -> Column:
    """Error band. Inflation acts on sigma and on the override, never on ``extra``."""
    return F.coalesce(override * inflation, F.abs(bias) + k * sigma * inflation) + extra


def model_band(inflation: Column | float = 1.0, extra: Column | float = 0.0) -> Column:
    """``band_mm`` over the columns of a joined band model."""
    return band_mm(F.col("bias_mm"), F.col("sigma_mm"), F.col("k"), F.col("band_override_mm"), extra, inflation)


def verdict(measured: Column, required: Column, band: Column, bias: Column | None = None,
            apply_bias: Column | None = None) -> Column:
    """Three tiers, inclusive at the band edges; null inputs give NOT_ASSESSED."""
    value = measured if bias is None else F.when(apply_bias, measured - bias).otherwise(measured)
    return (F.when(value.isNull() | required.isNull() | band.isNull(), NOT_ASSESSED)
            .when(value >= required + band, PASS)
            .when(value <= required - band, FAIL)
            .otherwise(BORDERLINE))


def width_verdict(ratio: Column, text: Column) -> Column:
    """Width over height against one third with a 12 % band; all-exempt text is not judged."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "")
    return (F.when(ratio.isNull() | (ratio <= 0), NOT_ASSESSED)
            .when(kept.rlike(f"^[{dims.WIDTH_EXEMPT}]+$"), NOT_ASSESSED)
            .when(ratio >= dims.MIN_WIDTH_RATIO * (1.0 + dims.WIDTH_RATIO_BAND), PASS)
            .when(ratio <= dims.MIN_WIDTH_RATIO * (1.0 - dims.WIDTH_RATIO_BAND), FAIL)
            .otherwise(BORDERLINE))


def panel_area(shape: Column, height: Column, width: Column, circumference: Column, diameter: Column,
               surface: Column) -> Column:
    """Display-panel area in cm2 for a flat side, a cylinder, or any other shape."""
    round_ = F.coalesce(circumference, F.lit(math.pi) * diameter)
    return (F.when(shape == "rectangular", height * width)
            .when(shape == "cylindrical", F.lit(0.40) * height * round_)
            .when(shape == "other", F.lit(0.40) * surface))


def parse_panel_size(text: Column) -> Column:
    """Area from ``HxW`` text; null when it does not read as two numbers."""
    parts = F.split(F.lower(text), "x", 2)
    return (F.get(parts, F.lit(0)).try_cast("double") * F.get(parts, F.lit(1)).try_cast("double"))


def count_matches(n_glyphs: Column, expected: Column) -> Column:
    """Measured glyphs equal the digits read; an expectation of 0 switches the check off."""
    return (expected == 0) | (n_glyphs == expected)
