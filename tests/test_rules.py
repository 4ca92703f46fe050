"""Threshold, band, verdict and panel cases."""

import pytest
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import rules as ru
from packaudit.operators import rules


def heights(spark, rows):
    df = spark.createDataFrame(rows, "n int, panel_area_cm2 double, print_style string")
    out = rules.table_height(df, dims.rule_table(spark)).collect()
    return {r.n: r for r in out}


def test_table_bounds(spark):
    normal = [(10.0, 1.0), (49.9, 1.0), (50.0, 1.0), (50.1, 1.5), (100.0, 1.5), (100.1, 2.5), (500.0, 2.5),
              (500.1, 4.0), (2500.0, 4.0), (2500.1, 6.0), (10000.0, 6.0)]
    moulded = [(10.0, 1.5), (75.0, 3.0), (250.0, 4.0), (1000.0, 6.0), (5000.0, 6.0)]
    cases = [(a, "normal", mm) for a, mm in normal] + [(a, "embossed", mm) for a, mm in moulded]
    got = heights(spark, [(i, a, s) for i, (a, s, _) in enumerate(cases)])
    assert [got[i].required_mm for i in range(len(cases))] == [c[2] for c in cases]


def test_refused_without_area(spark):
    got = heights(spark, [(0, None, "normal"), (1, 0.0, "normal"), (2, -5.0, "normal")])
    assert not any(r.lookup_ok for r in got.values())
    assert "principal display panel" in got[0].lookup_reason and got[0].required_mm is None


def test_every_field_uses_the_table_and_advisory_is_disclosed(spark):
    df = spark.createDataFrame(
        [(f, 623.7, "normal", None, None) for f in dims.FIELDS] + [("mrp", 250.0, "normal", "weight_or_volume", 1000.0)],
        "field string, panel_area_cm2 double, print_style string, quantity_kind string, quantity_base double")
    out = rules.required_height(df, dims.rule_table(spark), dims.declarations(spark)).collect()
    assert {r.required_mm for r in out if r.panel_area_cm2 == 623.7} == {4.0}
    one = [r for r in out if r.quantity_base == 1000.0][0]
    assert (one.required_mm, one.advisory_required_mm) == (2.5, 4.0) and "pre-2017" in one.advisory_table


@pytest.mark.parametrize("ratio,text,want", [
    (0.55, "24", "PASS"), (0.20, "24", "FAIL"), (0.33, "24", "BORDERLINE"), (0.10, "111", "NOT_ASSESSED"),
    (None, "24", "NOT_ASSESSED")])
def test_width(spark, ratio, text, want):
    c = F.lit(ratio).cast("double")
    assert spark.range(1).select(ru.width_verdict(c, F.lit(text))).head()[0] == want


def test_panel_area(spark):
    n = F.lit(None).cast("double")
    area = lambda *a: spark.range(1).select(ru.panel_area(*a)).head()[0]
    assert area(F.lit("rectangular"), F.lit(29.7), F.lit(21.0), n, n, n) == pytest.approx(623.7)
    assert area(F.lit("cylindrical"), F.lit(12.0), n, F.lit(25.0), n, n) == pytest.approx(120.0)
    assert area(F.lit("cylindrical"), F.lit(12.0), n, n, n, n) is None
    assert area(F.lit("other"), n, n, n, n, F.lit(1000.0)) == pytest.approx(400.0)
    assert spark.range(1).select(ru.parse_panel_size(F.lit("29.7x21"))).head()[0] == pytest.approx(623.7)


@pytest.mark.parametrize("mm,bias,sigma,override,want", [
    (2.50, 0.0, 0.05, None, "PASS"), (1.50, 0.0, 0.05, None, "FAIL"), (2.05, 0.0, 0.05, None, "BORDERLINE"),
    (1.95, 0.0, 0.05, None, "BORDERLINE"), (2.00, 0.0, 0.05, None, "BORDERLINE"), (2.30, 0.5, 0.01, None, "BORDERLINE"),
    (2.30, 0.0, 0.01, 0.5, "BORDERLINE")])
def test_three_tiers(spark, mm, bias, sigma, override, want):
    band = ru.band_mm(F.lit(bias), F.lit(sigma), F.lit(2.0), F.lit(override).cast("double"))
    assert spark.range(1).select(ru.verdict(F.lit(mm), F.lit(2.0), band)).head()[0] == want


def test_wider_band_never_decides_more(spark):
    df = spark.range(400).select((F.col("id") / 100.0).alias("mm"))
    v = lambda b: ru.verdict(F.col("mm"), F.lit(2.0), F.lit(b))
    bad = df.where((v(0.1) == "BORDERLINE") & (v(0.3) != "BORDERLINE")).count()
    assert bad == 0


def test_disclosure_lists_every_table(spark):
    out = rules.rules_disclosure(spark).collect()
    assert {r.name for r in out if r.section == "height_table"} == set(dims.HEIGHT_TABLES)
    assert len([r for r in out if r.section == "declaration"]) == 6
