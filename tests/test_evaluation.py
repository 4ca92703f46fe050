"""Statistics over suffixes of bins against numpy."""

import numpy as np
import pytest

from packaudit import dims
from packaudit.functions import skew
from packaudit.operators import evaluation as ev

DDL = ("case_id string, field string, error string, gt_mm double, measured_mm double, value_correct boolean, verdict string, src_ppmm double")


def sweep_by_numpy(rows):
    out = {}
    for floor in dims.FLOOR_SWEEP:
        e = np.array([r[4] - r[3] for r in rows if r[4] is not None and (r[7] or 0.0) >= floor])
        if len(e):
            out[floor] = (len(e), e.mean(), e.std(ddof=1) if len(e) > 1 else None, np.abs(e).mean(),
                          np.quantile(np.abs(e), 0.95), np.quantile(np.abs(e), 0.99))
    return out


def records(n, top, ties):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        e = float(rng.choice([0.0, 0.1, -0.1])) if ties else float(rng.normal(0.02, 0.06))
        out.append((str(i), "mrp", None, 2.0, None if i % 29 == 3 else 2.0 + e, True, "PASS", None if i % 31 == 0 else float(rng.uniform(2, top))))
    return out


@pytest.mark.parametrize("n, top, ties", [(2500, 25.0, False), (600, 25.0, True), (300, 9.0, False), (0, 9.0, False)])
def test_floor_sweep(spark, n, top, ties):
    rows = records(n, top, ties)
    if n == 2500:
        rows += [("one", "mrp", None, 2.0, 2.5, True, "PASS", 18.0), ("hot", "mrp", None, 2.0, 2.01, True, "FAIL", 1e6)] * 2
    want = sweep_by_numpy(rows)
    df = spark.createDataFrame(rows, DDL)
    got = {r.floor: tuple(r)[1:] for r in ev.floor_sweep(df).collect()}
    assert set(got) == set(want)
    for floor, w in want.items():
        assert got[floor] == pytest.approx(w, abs=1e-9)
    gates = ev.derive_gates(df).collect()
    good = [f for f, w in want.items() if w[0] >= dims.FLOOR_MIN_SAMPLES and round(w[4], 4) <= dims.FLOOR_MAX_P95 and round(w[2], 4) <= dims.FLOOR_MAX_SIGMA]
    chosen = min(good, default=dims.FLOOR_FALLBACK)
    assert [g.floor for g in gates] == ([chosen] if chosen in want else [])


def test_a_single_measurement_has_no_sigma(spark):
    r, = ev.floor_sweep(spark.createDataFrame([("a", "mrp", None, 2.0, 2.25, True, "PASS", 7.0)], DDL)).collect()
    assert (r.floor, r.n, r.bias_mm, r.sigma_mm, r.p95_abs_mm) == (6.0, 1, 0.25, None, 0.25)


def test_suffix_percentiles_of_one_crowded_bin(spark):
    rng = np.random.default_rng(1)
    rows = [(3, float(x)) for x in rng.exponential(size=3000)] + [(1, float(x)) for x in rng.integers(0, 3, 500)] + [(2, None), (9, 0.5)]
    got = {r.b: (r.lo, r.mid) for r in skew.suffix_percentiles(
        spark.createDataFrame(rows, "b int, v double"), "b", 4, "v", {"lo": 0.0, "mid": 0.5}).collect()}
    for b in (1, 2, 3, 4):
        v = [x for k, x in rows if k >= b and x is not None]
        assert got[b] == pytest.approx((np.min(v), np.median(v)))


def test_declarations_are_judged_once_for_records(spark):
    """One aggregate picks the declarations; their scan's verdict needs neither a second one nor a join of them with themselves."""
    from verification import views as v
    plan = v.records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Window") == 1


def test_the_report_computes_its_records_once(spark):
    from pyspark.sql import functions as F
    from packaudit.plans import eval_report as er
    from verification import views as v
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = v.records(spark, "/root/testdata/sf0.001")
    rows = rows.mapInArrow(count, rows.schema)
    n = rows.count()
    seen.value = 0
    report = er.eval_report(rows, dims.band_model(spark))
    assert report.where(F.col("section") == "run").count() > 0 and report.count() > 50
    assert seen.value == n
