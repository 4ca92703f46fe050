"""Votes, medians and bands over several frames."""

import pytest
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.operators import consensus as cs
from packaudit.plans import pack_consensus

DDL = ("pack_id string, frame_no int, field string, ord int, informational boolean, present boolean, presence_verdict string, "
       "value_text string, match_confidence double, measured_mm double, required_mm double, verdict string, "
       "width_verdict string, reason string, label_ppmm double")


def row(frame, text="249.00", conf=1.0, mm=None, verdict="NOT_ASSESSED", ppmm=10.0, pack="p", present=True, pv="PASS"):
    return (pack, frame, "mrp", 4, False, present, pv, text, conf, mm, 2.5, verdict, None, "", ppmm)


def merge(spark, *rows):
    df = spark.createDataFrame(list(rows), DDL)
    frames = df.select("pack_id", "frame_no", "label_ppmm").distinct()
    return cs.consensus(df, frames, dims.band_model(spark)).collect()


def test_weak_lone_reading_is_dropped(spark):
    r, = merge(spark, row(1, "7", 0.45), row(2, "", 0.0, present=False, pv="FAIL"), row(3, "", 0.0, present=False, pv="FAIL"))
    assert r.value_text == "" and not r.present and r.presence_verdict == "NOT_ASSESSED"


def test_majority_wins_and_first_spelling_is_kept(spark):
    r, = merge(spark, row(1, "Rs  249"), row(2, "rs 249"), row(3, "199", 1.0))
    assert r.value_text == "Rs  249" and r.values_disagreed


def test_measurement_survives_a_blind_base_frame(spark):
    r, = merge(spark, row(1, "", 0.0, ppmm=20.0, present=False, pv="FAIL"), row(2, mm=2.77, verdict="PASS"),
               row(3, mm=2.66, verdict="PASS"))
    assert r.base_frame == 1 and r.measured_mm == pytest.approx(2.715) and r.frames_measured == 2 and r.present


def test_band_only_widens(spark):
    tight, = merge(spark, row(1, mm=3.0, verdict="PASS"), row(2, mm=3.01, verdict="PASS"))
    loose, = merge(spark, row(1, mm=2.2, verdict="FAIL"), row(2, mm=3.4, verdict="PASS"))
    assert tight.band_mm == pytest.approx(0.15645) and loose.band_mm == pytest.approx(0.6)
    assert tight.verdict == "PASS" and loose.verdict == "BORDERLINE"


def test_single_frame_passes_through(spark):
    r, = merge(spark, row(1, "7", 0.3, mm=2.0, verdict="FAIL"))
    assert r.note and r.verdict == "FAIL" and r.present


def test_refused_readings_count_only_alone(spark):
    r, = merge(spark, row(1, mm=9.0, verdict="NOT_ASSESSED"), row(2, mm=2.0, verdict="FAIL"))
    assert r.frames_measured == 1 and r.measured_mm == 2.0 and r.measurement_trusted


def report(spark, rows, facts=()):
    df = spark.createDataFrame(rows, DDL)
    frames = df.select("pack_id", "frame_no", "label_ppmm").distinct()
    return pack_consensus.pack_report(df, frames, dims.band_model(spark),
                                      spark.createDataFrame(list(facts), "pack_id string, frame_no int, tilt_deg double"))


def test_pack_report_parts(spark):
    many = [row(i, mm=2.0 + i / 100, verdict="PASS", ppmm=10.0 + i) for i in range(30)]
    weak = [row(1, mm=9.0, pack="w"), row(2, mm=0.0, verdict="PASS", pack="w"), row(3, mm=None, pack="w", ppmm=12.0)]
    one = [row(1, mm=2.0, verdict="FAIL", pack="solo")]
    r = report(spark, many + [row(40, mm=8.0)] + weak + one, [("p", 29, 3.5), ("w", 1, 7.0)])
    packs = {x.pack_id: x for x in r.packs.collect()}
    assert (packs["p"].base_frame, packs["p"].tilt_deg, packs["p"].n_frames) == (29, 3.5, 31)
    assert (packs["w"].base_frame, packs["w"].tilt_deg, packs["w"].n_frames) == (3, None, 3)
    values = sorted((x.frame_no, x.measured_mm) for x in r.readings.where("pack_id = 'p' AND trusted").collect())
    assert values == [(i, pytest.approx(2.0 + i / 100)) for i in range(30)]
    assert [tuple(x) for x in r.readings.where("NOT trusted").collect()] == [("w", "mrp", 1, 9.0, False)]
    d = {x.pack_id: x for x in r.declarations.collect()}
    assert (d["p"].measured_mm, d["p"].spread_mm, d["p"].frames_measured) == (2.145, 0.29, 30)
    assert (d["w"].measured_mm, d["w"].spread_mm, d["w"].measurement_trusted) == (9.0, None, False)
    text = [x.text for x in r.lines.where("pack_id = 'p'").orderBy("section", "ord", "part").collect()]
    assert text[0].startswith("mrp") and "30/31" in text[0] and text[0].endswith("2.14 mm  0.29 mm")
    assert [len(t.split(", ")) for t in text[1:4]] == [12, 12, 6] and text[1].startswith("2.00, 2.01") and text[3].endswith("2.29")
    assert text[4] == "widest spread between photos: 0.290 mm"
    assert [x.text for x in r.lines.where("pack_id = 'w' AND section > 1").collect()] == ["no second opinion, measured in one photo only: mrp"]
    assert r.lines.where("pack_id = 'solo'").count() == 0


def test_pack_report_of_nothing(spark):
    r = report(spark, [])
    assert [x.count() for x in (r.packs, r.declarations, r.readings, r.lines)] == [0, 0, 0, 0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_declarations_are_chosen_where_they_lie(spark):
    """The choice per scan and field shuffles no row: none is dealt out by scan."""
    from verification import views as v
    d = v.declarations(spark, "/root/testdata/sf0.001")
    moved = [line for line in _plan(d.select("scan_id", "field", "verdict")).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("scan_id" in line for line in moved)


def test_pack_rows_are_judged_once(spark):
    """Merging reads staged rows, and never the line items again."""
    from verification import core_queries as q
    assert "lineitem" not in _plan(q.QUERIES["c3_consensus_presence"](spark, "/root/testdata/sf0.001"))
