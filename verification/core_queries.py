"""Queries and SQL for rules, capture geometry, glyphs, gates, verdicts, consensus and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit import dims, session
from packaudit.functions import geometry, rules as ru, text as tx
from packaudit.operators import adjudication, capture, consensus as cs, gates, glyphs, history as hs, rules
from packaudit.plans import pack_consensus
from verification import views as v
from verification.sql import ORD, advisory, r6, table_i, tier, with_

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def joined(c: str) -> Column:
    return F.array_join(c, " | ").alias(c)


# --------------------------------------------------------------------------- rules
@query("r1_table_height", with_("meas", f"""SELECT meas_id, {table_i('panel_area_cm2', 'print_style')} AS required_mm,
  CASE WHEN panel_area_cm2<=50 THEN 'panel area up to 50 cm2' WHEN panel_area_cm2<=100 THEN 'panel area up to 100 cm2'
    WHEN panel_area_cm2<=500 THEN 'panel area up to 500 cm2' WHEN panel_area_cm2<=2500 THEN 'panel area up to 2500 cm2'
    WHEN panel_area_cm2>2500 THEN 'panel area above 2500 cm2' END AS rule_row,
  coalesce(panel_area_cm2>0, false) AS lookup_ok FROM meas"""))
def r1(spark, sf):
    return rules.table_height(v.measurements(spark, sf), dims.rule_table(spark)).select(
        "meas_id", "required_mm", "rule_row", "lookup_ok")


@query("r2_advisory_height", with_("meas", f"""SELECT meas_id,
  {advisory('quantity_kind', 'quantity_base', 'panel_area_cm2', 'print_style')} AS advisory_required_mm,
  CASE WHEN panel_area_cm2 IS NULL THEN NULL WHEN quantity_kind='weight_or_volume' THEN 'I (pre-2017, quantity-keyed)'
  ELSE 'II (pre-2017)' END AS advisory_table FROM meas"""))
def r2(spark, sf):
    return rules.advisory_height(v.measurements(spark, sf), dims.rule_table(spark)).select(
        "meas_id", "advisory_required_mm", "advisory_table")


@query("r3_required_height", with_("meas", f"""SELECT meas_id,
  CASE WHEN field='mrp' THEN CASE WHEN print_style='normal' THEN 1.0 ELSE 2.0 END::DOUBLE
    ELSE {table_i('panel_area_cm2', 'print_style')} END AS required_mm,
  CASE WHEN field='mrp' THEN {table_i('panel_area_cm2', 'print_style')}
    ELSE {advisory('quantity_kind', 'quantity_base', 'panel_area_cm2', 'print_style')} END AS advisory_required_mm,
  field='mrp' OR coalesce(panel_area_cm2>0, false) AS lookup_ok FROM meas"""))
def r3(spark, sf):
    # The price is mapped to the historical floor here, so that both branches are used.
    decl = dims.declarations(spark).where(F.col("field") != "mfg_date").withColumn(
        "basis", F.when(F.col("field") == "mrp", dims.FLOOR_BASIS).otherwise(F.col("basis")))
    return rules.required_height(v.measurements(spark, sf), dims.rule_table(spark), decl).select(
        "meas_id", "required_mm", "advisory_required_mm", "lookup_ok")


@query("r4_width_verdict", with_("meas", f"""SELECT meas_id, CASE WHEN l_suppkey%11=0 OR width_ratio<=0 THEN 'NOT_ASSESSED'
  WHEN regexp_full_match(value_text,'[1ilI]+') THEN 'NOT_ASSESSED'
  WHEN width_ratio>=1.12::DOUBLE/3 THEN 'PASS' WHEN width_ratio<=0.88::DOUBLE/3 THEN 'FAIL' ELSE 'BORDERLINE' END AS width_verdict
  FROM meas"""))
def r4(spark, sf):
    ratio = F.when(F.col("l_suppkey") % 11 != 0, F.col("width_ratio"))
    return v.measurements(spark, sf).select("meas_id", ru.width_verdict(ratio, F.col("value_text")).alias("width_verdict"))


@query("r5_panel_area", f"""SELECT p_partkey, {r6('''CASE p_partkey%3 WHEN 0 THEN p_size*(p_size+2.5::DOUBLE)
  WHEN 1 THEN 0.4::DOUBLE*p_size*CASE WHEN p_partkey%2=0 THEN p_size*3.0::DOUBLE ELSE pi()*p_size END
  ELSE 0.4::DOUBLE*p_retailprice END''')} AS area, {r6("CASE WHEN p_partkey%5<>0 THEN p_size*(p_size+0.5::DOUBLE) END")} AS parsed
  FROM part""")
def r5(spark, sf):
    p, k, size = v.table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size").cast("double")
    shape = F.when(k % 3 == 0, "rectangular").when(k % 3 == 1, "cylindrical").otherwise("other")
    area = ru.panel_area(shape, size, size + 2.5, F.when(k % 2 == 0, size * 3.0), F.when(k % 2 != 0, size),
                         F.col("p_retailprice"))
    text = F.when(k % 5 == 0, "12 by 3").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("X"),
                                                            (size + 0.5).cast("string")))
    return p.select("p_partkey", v.r6(area).alias("area"), v.r6(ru.parse_panel_size(text)).alias("parsed"))


@query("r6_band", with_("meas", f"""SELECT meas_id, {r6('''coalesce(CASE WHEN l_suppkey%2=0 THEN 0.15645::DOUBLE*1.5 END,
  abs(-0.01::DOUBLE*n_glyphs)+k*sigma*1.5)+band_penalty_mm''')} AS band FROM (SELECT *, (n_glyphs+1)::DOUBLE AS k,
  0.03::DOUBLE AS sigma FROM meas)"""))
def r6q(spark, sf):
    n = F.col("n_glyphs").cast("double")
    band = ru.band_mm(n * -0.01, F.lit(0.03), n + 1.0, F.when(F.col("l_suppkey") % 2 == 0, 0.15645),
                      F.col("band_penalty_mm"), F.lit(1.5))
    return v.measurements(spark, sf).select("meas_id", v.r6(band).alias("band"))


@query("r7_verdict", with_("meas", f"""SELECT meas_id, {tier('raw_mm', 'gt_mm*0.9::DOUBLE', '0.15645::DOUBLE')} AS verdict,
  {tier('(raw_mm-0.5::DOUBLE)', 'gt_mm', '0.1::DOUBLE')} AS verdict_bias FROM meas"""))
def r7(spark, sf):
    mm, gt = F.col("measured_mm"), F.col("gt_mm")
    return v.measurements(spark, sf).select(
        "meas_id", ru.verdict(mm, gt * 0.9, F.lit(0.15645)).alias("verdict"),
        ru.verdict(mm, gt, F.lit(0.1), F.lit(0.5), F.lit(True)).alias("verdict_bias"))


@query("r8_rule_usage", with_("judged0", """SELECT 'panel area '||CASE WHEN panel_area_cm2<=50 THEN 'up to 50'
  WHEN panel_area_cm2<=100 THEN 'up to 100' WHEN panel_area_cm2<=500 THEN 'up to 500' WHEN panel_area_cm2<=2500 THEN 'up to 2500'
  ELSE 'above 2500' END||' cm2' AS rule_row, print_style, count(*) AS n, any_value(required_mm) AS required_mm
  FROM judged0 WHERE panel_area_cm2>0 GROUP BY 1, 2"""))
def r8(spark, sf):
    return rules.rule_usage(v.measurements(spark, sf), dims.rule_table(spark))


# ------------------------------------------------------------------------ geometry
@query("g1_quad_geometry", with_("quadgeo", f"""SELECT scan_id, {r6('side_px')} AS side_px, {r6('tilt_deg')} AS tilt_deg,
  {r6('taper')} AS taper FROM quadgeo"""))
def g1(spark, sf):
    return v.flat(capture.quad_geometry(v.captures(spark, sf)).select("scan_id", "side_px", "tilt_deg", "taper"))


_CORNERS = " UNION ALL ".join(
    f"SELECT *, {u} AS u, {w} AS vv FROM homo" for u, w in (("0::DOUBLE", "0::DOUBLE"), ("img_w", "0::DOUBLE"),
                                                            ("img_w", "img_h"), ("0::DOUBLE", "img_h")))
_G2 = with_("homo", f""", det0 AS (SELECT *, m0*(m4-m5*m7)-m1*(m3-m5*m6)+m2*(m3*m7-m4*m6) AS det,
  ((m4-m5*m7)*u+(m2*m7-m1)*vv+(m1*m5-m2*m4)) AS px, ((m5*m6-m3)*u+(m0-m2*m6)*vv+(m2*m3-m0*m5)) AS py,
  ((m3*m7-m4*m6)*u+(m1*m6-m0*m7)*vv+(m0*m4-m1*m3)) AS pw FROM ({_CORNERS}) WHERE has_h AND known IS NULL),
box AS (SELECT scan_id, count(*) AS n, greatest(min(px/pw),-400) AS bx0, greatest(min(py/pw),-400) AS by0,
  least(max(px/pw),400) AS bx1, least(max(py/pw),400) AS by1 FROM det0 WHERE abs(pw/det)>1e-9 GROUP BY scan_id),
st AS (SELECT h.*, b.*, CASE WHEN known>0 THEN NULL WHEN x0 IS NULL THEN 'no marker found'
  WHEN NOT has_h OR coalesce(n,0)<3 THEN 'degenerate marker geometry'
  WHEN bx1-bx0<mm OR by1-by0<mm THEN 'metric extent collapsed' END AS calib_reason,
  CASE WHEN known>0 THEN known ELSE side_px/mm END AS ppmm FROM homo h LEFT JOIN box b ON h.scan_id=b.scan_id),
sc AS (SELECT *, least(greatest(ppmm,2.0::DOUBLE),60.0::DOUBLE) AS sc FROM st),
wh AS (SELECT *, greatest(round_even((bx1-bx0)*sc,0), round_even((by1-by0)*sc,0)) AS longest FROM sc)
SELECT scan_id::VARCHAR AS scan_id, {r6('ppmm')} AS px_per_mm, calib_reason, {r6('''CASE WHEN calib_reason IS NOT NULL THEN NULL
  WHEN known>0 THEN known WHEN longest>5000 THEN sc*(5000/longest) ELSE sc END''')} AS rect_px_per_mm,
  {r6("CASE WHEN calib_reason IS NOT NULL THEN NULL WHEN known>0 THEN 0 ELSE bx0 END")} AS origin_x_mm,
  {r6("CASE WHEN calib_reason IS NOT NULL THEN NULL WHEN known>0 THEN 0 ELSE by0 END")} AS origin_y_mm FROM wh""").replace(
    "\n, det0 AS", ",\n det0 AS")


@query("g2_metric_scale", _G2)
def g2(spark, sf):
    return v.flat(capture.metric_scale(v.captures(spark, sf)).select(
        "scan_id", "px_per_mm", "calib_reason", "rect_px_per_mm", "origin_x_mm", "origin_y_mm"))


@query("g3_square_homography", with_("homo", "SELECT scan_id, " + ", ".join(
    f"{r6(f'CASE WHEN has_h THEN m{i} END')} AS m{i}" for i in range(8)) + " FROM homo"))
def g3(spark, sf):
    h = capture.with_homography(v.captures(spark, sf))
    return h.select("scan_id", *[v.r6(F.get("h_mm_to_px", F.lit(i))).alias(f"m{i}") for i in range(8)])


@query("g4_local_px_per_mm", with_("homo", f"""SELECT scan_id, p.x AS at_mm, {r6('''coalesce(sqrt(abs(
  ((a1/w1-a0/w0)*(b2/w2-b0/w0)-(b1/w1-b0/w0)*(a2/w2-a0/w0))/0.25)),0)''')} AS ppmm FROM (SELECT *,
  m0*x+m1*y+m2 AS a0, m3*x+m4*y+m5 AS b0, m6*x+m7*y+1 AS w0, m0*(x+0.5)+m1*y+m2 AS a1, m3*(x+0.5)+m4*y+m5 AS b1,
  m6*(x+0.5)+m7*y+1 AS w1, m0*x+m1*(y+0.5)+m2 AS a2, m3*x+m4*(y+0.5)+m5 AS b2, m6*x+m7*(y+0.5)+1 AS w2
  FROM homo, (SELECT i::DOUBLE AS x, (i*2+1)::DOUBLE AS y FROM range(0,4) t(i))) p"""))
def g4(spark, sf):
    pts = F.explode(F.sequence(F.lit(0), F.lit(3)))
    df = capture.with_homography(v.captures(spark, sf)).withColumn("i", pts)
    x = F.col("i").cast("double")
    return df.select("scan_id", x.alias("at_mm"),
                     v.r6(geometry.local_px_per_mm(F.col("h_mm_to_px"), x, x * 2 + 1)).alias("ppmm"))


@query("g5_known_scale", with_("quadgeo", f"""SELECT scan_id, known AS px_per_mm, 0.0::DOUBLE AS tilt_deg, 1.0::DOUBLE AS taper,
  known AS m0, 0.0::DOUBLE AS m1 FROM quadgeo WHERE known>0"""))
def g5(spark, sf):
    return capture.metric_scale(v.captures(spark, sf)).where(F.col("known_px_per_mm") > 0).select(
        "scan_id", "px_per_mm", "tilt_deg", "taper", F.get("h_mm_to_px", F.lit(0)).alias("m0"),
        F.get("h_mm_to_px", F.lit(1)).alias("m1"))


@query("g6_pick_marker", """WITH d AS (SELECT o_orderkey AS k, i::INTEGER AS det_no, ((o_orderkey*3+i*5)%7)::INTEGER AS marker_id,
  CASE WHEN o_orderkey%3<>0 THEN (o_orderkey%5)::INTEGER END AS asked FROM orders, range(0,3) r(i) WHERE i<o_orderkey%4),
f AS (SELECT k, arg_min(marker_id, det_no) AS marker_id FROM d WHERE asked IS NULL OR marker_id=asked GROUP BY k),
s AS (SELECT k, string_agg(DISTINCT marker_id::VARCHAR, ',' ORDER BY marker_id::VARCHAR) AS ids, any_value(asked) AS asked FROM d GROUP BY k)
SELECT o_orderkey::VARCHAR AS scan_id, f.marker_id, CASE WHEN f.marker_id IS NOT NULL THEN NULL WHEN ids IS NULL THEN 'no marker found'
  ELSE 'marker '||asked||' not present; saw '||ids END AS calib_reason
FROM orders LEFT JOIN f ON f.k=o_orderkey LEFT JOIN s ON s.k=o_orderkey""")
def g6(spark, sf):
    return capture.pick_marker(v.asked_scans(spark, sf), v.detections(spark, sf)).drop("corners")


# -------------------------------------------------------------------------- glyphs
@query("m1_shape_filter", with_("shaped", "SELECT glyph_no, scan_id, w, h, area FROM shaped"))
def m1(spark, sf):
    return glyphs.shape_filter(v.glyphs(spark, sf)).select("glyph_no", "scan_id", "w", "h", "area")


def _restricted(spark, sf) -> DataFrame:
    return glyphs.digit_restrict(glyphs.shape_filter(v.glyphs(spark, sf)), v.glyph_chars(spark, sf))


@query("m2_digit_restrict", with_("restricted", "SELECT glyph_no, used_char_boxes FROM restricted"))
def m2(spark, sf):
    return _restricted(spark, sf).select("glyph_no", "used_char_boxes")


@query("m3_height_consistent", with_("kept", "SELECT glyph_no, h FROM kept"))
def m3(spark, sf):
    return glyphs.height_consistent(_restricted(spark, sf)).select("glyph_no", "h")


@query("m4_glyph_refusals", with_("restricted kept", """, c AS (SELECT scan_id, field, count(*) AS n, bool_or(used_char_boxes) AS used
  FROM restricted GROUP BY ALL), k AS (SELECT scan_id, field, count(*) AS n FROM kept GROUP BY ALL),
f AS (SELECT o_orderkey::VARCHAR AS scan_id, (o_orderkey%50)::INTEGER AS roi_w FROM orders)
SELECT f.scan_id, coalesce(c.n,0) AS n_candidates, coalesce(k.n,0) AS n_kept, CASE WHEN roi_w<3 THEN 'field region too small to measure'
  WHEN c.n IS NULL THEN 'no numeral-like glyph in the field' WHEN coalesce(k.n,0)<1 THEN 'too few height-consistent numerals'
  WHEN k.n=1 AND NOT used THEN 'single numeral without character confirmation' END AS meas_reason
FROM f LEFT JOIN c ON f.scan_id=c.scan_id LEFT JOIN k ON f.scan_id=k.scan_id""").replace("\n, c AS", ",\n c AS"))
def m4(spark, sf):
    c = _restricted(spark, sf)
    return glyphs.glyph_refusals(v.glyph_fields(spark, sf), c, glyphs.height_consistent(c)).select(
        "scan_id", "n_candidates", "n_kept", "meas_reason")


@query("m5_field_heights", with_("kept", f"""SELECT scan_id, {r6('quantile_cont(h_subpx,0.5)/5.0')} AS height_mm,
  {r6('(quantile_cont(h_subpx,0.75)-quantile_cont(h_subpx,0.25))/5.0')} AS spread_mm,
  {r6('quantile_cont(w::DOUBLE,0.5)/5.0')} AS median_width_mm, count(*) AS n_glyphs, count(*)<3 AS low_glyph_count
  FROM kept GROUP BY scan_id, field"""))
def m5(spark, sf):
    k = glyphs.height_consistent(_restricted(spark, sf))
    scale = v.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("scan_id"),
                                                F.lit(5.0).alias("px_per_mm"))
    return v.flat(glyphs.field_heights(k, scale).select(
        "scan_id", "height_mm", "spread_mm", "median_width_mm", "n_glyphs", "low_glyph_count"))


@query("m6_count_matches", with_("meas", """SELECT meas_id, len(regexp_extract_all(value_text,'[0-9]')) AS digits,
  len(regexp_extract_all(value_text,'[0-9]'))=0 OR n_glyphs=len(regexp_extract_all(value_text,'[0-9]')) AS matches FROM meas"""))
def m6(spark, sf):
    d = tx.digit_count(F.col("value_text"))
    return v.measurements(spark, sf).select("meas_id", d.cast("bigint").alias("digits"),
                                            ru.count_matches(F.col("n_glyphs"), d).alias("matches"))


@query("m7_level_crossing", with_("samples", f""", n AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM samples
  WINDOW w AS (PARTITION BY series_id, col ORDER BY pos)), e AS (SELECT series_id, col,
  min(CASE WHEN v>0 THEN pos END) AS i, max(CASE WHEN v>0 THEN pos END) AS j FROM n GROUP BY ALL),
x AS (SELECT e.series_id, CASE WHEN a.pv IS NULL THEN 0.0::DOUBLE ELSE i-1+(-a.pv)/(a.v-a.pv) END AS top,
  CASE WHEN b.nv IS NULL THEN j::DOUBLE ELSE j+b.v/(b.v-b.nv) END AS bottom FROM e
  JOIN n a ON a.series_id=e.series_id AND a.col=e.col AND a.pos=e.i JOIN n b ON b.series_id=e.series_id AND b.col=e.col AND b.pos=e.j)
SELECT series_id, {r6('min(top)')} AS top, {r6('max(bottom)')} AS bottom FROM x GROUP BY series_id""").replace("\n, n AS", ",\n n AS"))
def m7(spark, sf):
    return v.flat(glyphs.level_crossing_extent(v.samples(spark, sf)))


@query("m8_mid_level", with_("samples", f"""SELECT series_id, {r6('(quantile_cont(v,0.05)+quantile_cont(v,0.95))/2.0')} AS level
  FROM samples GROUP BY series_id"""))
def m8(spark, sf):
    return v.flat(glyphs.mid_level(v.samples(spark, sf)))


# --------------------------------------------------------------------------- gates
@query("q1_calibration_gate", _G2.replace("SELECT scan_id::VARCHAR AS scan_id", """, g AS (SELECT scan_id, CASE
  WHEN calib_reason='no marker found' THEN 'NO_REFERENCE_MARKER' WHEN calib_reason IS NOT NULL THEN 'UNUSABLE_REFERENCE_MARKER'
  WHEN known IS NULL AND (tilt_deg>35 OR taper>1.35) THEN 'EXCESSIVE_TILT' END AS gate FROM wh), zz AS (SELECT scan_id::VARCHAR AS scan_id""")
    .replace("FROM wh), zz", "FROM wh), zz") + ") SELECT scan_id, gate, true AS blocking_height FROM g WHERE gate IS NOT NULL")
def q1(spark, sf):
    cal = capture.metric_scale(v.captures(spark, sf))
    return gates.calibration_gate(cal, dims.band_model(spark)).select("scan_id", "gate", "blocking_height")


def _doc_captures(spark, sf) -> DataFrame:
    """A known scale of 3 to 9 px/mm per document, sometimes unusable."""
    d = v.doc_scans(spark, sf)
    k = F.col("doc_id")
    scale = ((k % 7) + 3).cast("double")
    zero = F.lit(0.0)
    return d.select(
        "scan_id", F.lit(True).alias("calib_ok"),
        F.array(scale, zero, zero, zero, scale, zero, (k % 3).cast("double") * 1e-4, zero, F.lit(1.0)).alias("h_mm_to_px"),
        zero.alias("origin_x_mm"), zero.alias("origin_y_mm"), scale.alias("rect_px_per_mm"), (k % 10 != 0).alias("metric_ok"))


_LOCAL = """coalesce(sqrt(abs(((s*(mx+0.5)/(p*(mx+0.5)+1)-s*mx/(p*mx+1))*(s*(my+0.5)/(p*mx+1)-s*my/(p*mx+1))
  -(s*my/(p*(mx+0.5)+1)-s*my/(p*mx+1))*(s*mx/(p*mx+1)-s*mx/(p*mx+1)))/0.25)),0)"""


@query("q2_legibility", with_("words", f""", smp AS (SELECT *, (doc_id%7+3)::DOUBLE AS s, (doc_id%3)::DOUBLE*1e-4::DOUBLE AS p FROM words),
loc AS (SELECT scan_id, {_LOCAL} AS l FROM (SELECT *, (x+w/2.0::DOUBLE)/s AS mx, (y+h/2.0::DOUBLE)/s AS my FROM smp WHERE doc_id%10<>0)),
lab AS (SELECT scan_id, quantile_cont(l,0.5) AS label_ppmm FROM loc WHERE l>0 GROUP BY scan_id),
st AS (SELECT scan_id, count(*) AS n_words, avg(conf) AS mc, quantile_cont(h::DOUBLE,0.5) AS mh FROM words GROUP BY scan_id),
r AS (SELECT doc_id::VARCHAR AS scan_id, coalesce(n_words,0) AS n_words, coalesce(mc,0) AS mc, coalesce(mh,0) AS mh, label_ppmm,
  (n_words IS NULL)::INT AS a, (coalesce(mc,0)<60)::INT AS b, (coalesce(mh>0 AND mh<11,false))::INT AS c,
  (coalesce(label_ppmm>0 AND label_ppmm<6,false))::INT AS d
  FROM documents LEFT JOIN st ON st.scan_id=doc_id::VARCHAR LEFT JOIN lab ON lab.scan_id=doc_id::VARCHAR)
SELECT scan_id, n_words, {r6('mc')} AS mean_conf, mh AS median_word_px, {r6('label_ppmm')} AS label_ppmm,
  (a+b+c+d)::BIGINT AS n_reasons, a+b+c+d=0 AS legible FROM r""").replace("\n, smp AS", ",\n smp AS"))
def q2(spark, sf):
    out = gates.legibility(v.doc_scans(spark, sf), v.words(spark, sf), _doc_captures(spark, sf), dims.band_model(spark))
    return v.flat(out.withColumn("n_reasons", F.size("reasons").cast("bigint")).drop("reasons", "reason_codes"))


_SLOPES = """, ln AS (SELECT scan_id, line_no, degrees(atan(regr_slope(y+h/2.0::DOUBLE, x+w/2.0::DOUBLE))) AS sl FROM words
  GROUP BY ALL HAVING count(*)>=4 AND max(x+w/2.0::DOUBLE)-min(x+w/2.0::DOUBLE)>=8*quantile_cont(h::DOUBLE,0.5))"""


@query("q3_planarity", with_("words", _SLOPES + f""", sc AS (SELECT scan_id, count(*) AS n, quantile_cont(sl,0.5) AS md,
  quantile_cont(sl,0.9)-quantile_cont(sl,0.1) AS sp FROM ln GROUP BY scan_id),
z AS (SELECT doc_id::VARCHAR AS scan_id, coalesce(n,0) AS n, CASE WHEN n>=3 THEN md END AS md, CASE WHEN n>=3 THEN sp END AS sp
  FROM documents LEFT JOIN sc ON sc.scan_id=doc_id::VARCHAR),
y AS (SELECT *, CASE WHEN md IS NULL THEN NULL WHEN abs(md)>5 OR sp>15 THEN 'gross'
  WHEN abs(md)>0.63::DOUBLE OR sp>5.212::DOUBLE THEN 'degraded' ELSE 'ok' END AS severity FROM z)
SELECT scan_id, n AS n_baselines, {r6('md')} AS median_slope_deg, {r6('sp')} AS slope_spread_deg, severity,
  {r6('''CASE WHEN severity='degraded' THEN round_even(0.035::DOUBLE*(greatest(0,abs(md)-0.63::DOUBLE)+0.25::DOUBLE*greatest(0,sp-5.212::DOUBLE))*10000.0::DOUBLE,0)/10000.0::DOUBLE
  ELSE 0 END''')} AS band_penalty_mm FROM y""").replace("\n, ln AS", ",\n ln AS"))
def q3(spark, sf):
    return v.flat(gates.planarity(v.doc_scans(spark, sf), v.words(spark, sf), dims.band_model(spark)))


@query("q4_resolution_gate", with_("meas", """SELECT meas_id, scan_id, field, 'INSUFFICIENT_RESOLUTION' AS gate,
  printf('%.1f px/mm is below the 6 px/mm floor', src_ppmm) AS detail FROM meas WHERE src_ppmm>0 AND src_ppmm<6"""))
def q4(spark, sf):
    m = v.measurements(spark, sf).withColumns({"field0": F.col("field"), "scan0": F.col("scan_id")})
    g = gates.resolution_gate(m.withColumn("scan_id", F.concat_ws("#", "meas_id", "scan_id")), dims.band_model(spark))
    return g.select(F.split_part("scan_id", F.lit("#"), F.lit(1)).alias("meas_id"),
                    F.split_part("scan_id", F.lit("#"), F.lit(2)).alias("scan_id"), "field", "gate", "detail")


def _gates(spark, sf) -> DataFrame:
    """Some orders trip one or more gates."""
    k = F.col("o_orderkey")
    def gate(when, seq, name, blocking):
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("gate"), F.lit(blocking).alias("b")))

    g = F.array_compact(F.array(
        gate(k % 5 == 0, 1, "EXCESSIVE_TILT", True), gate(k % 3 == 0, 2, "LOW_LEGIBILITY", False),
        gate(k % 7 == 0, 3, "PANEL_NOT_COPLANAR", True), gate(k % 4 == 0, 3, "PANEL_TILT_PENALTY", False),
        gate(k % 2 == 0, 4, "INSUFFICIENT_RESOLUTION", True)))
    return v.table(spark, sf, "orders").select(k.cast("string").alias("scan_id"), F.explode(g).alias("g")).select(
        "scan_id", "g.seq", "g.gate", F.col("g.b").alias("blocking_height"),
        F.when(F.col("g.seq") == 4, "mrp").alias("field"), F.lit("").alias("detail"))


_GATES = """WITH k AS (SELECT o_orderkey AS k FROM orders), g AS (
SELECT k, 1 AS seq, 'EXCESSIVE_TILT' AS gate, true AS b FROM k WHERE k%5=0 UNION ALL
SELECT k, 2, 'LOW_LEGIBILITY', false FROM k WHERE k%3=0 UNION ALL SELECT k, 3, 'PANEL_NOT_COPLANAR', true FROM k WHERE k%7=0 UNION ALL
SELECT k, 3, 'PANEL_TILT_PENALTY', false FROM k WHERE k%4=0 UNION ALL SELECT k, 4, 'INSUFFICIENT_RESOLUTION', true FROM k WHERE k%2=0) """


@query("q5_scale_reason", _GATES + """SELECT k::VARCHAR AS scan_id, arg_min(gate, seq) AS scale_gate,
  CASE arg_min(gate, seq) WHEN 'EXCESSIVE_TILT' THEN 'frame too oblique for the marker''s physical scale'
  ELSE 'panel not coplanar with the marker, so its physical scale does not apply' END AS scale_reason
  FROM g WHERE b AND seq<4 GROUP BY k""")
def q5(spark, sf):
    return gates.scale_reason(_gates(spark, sf))


@query("q6_effective_band", with_("judged0", f"""SELECT meas_id, inflation AS band_inflation,
  {r6('0.15645::DOUBLE*inflation+band_penalty_mm')} AS band FROM judged0"""))
def q6(spark, sf):
    df = v.measurements(spark, sf).crossJoin(F.broadcast(dims.band_model(spark)))
    return v.flat(df.select("meas_id", adjudication.band_inflation().alias("band_inflation"),
                            adjudication.effective_band().alias("band")))


@query("q7_adjudicate", with_("judged", f"""SELECT meas_id, verdict, reason_code, advisory_verdict, width_verdict,
  {r6('error_band_mm')} AS error_band_mm, {r6('measured_mm')} AS measured_mm, {r6('ratio')} AS ratio FROM judged"""))
def q7(spark, sf):
    return v.flat(v.judged(spark, sf).select(
        "meas_id", "verdict", "reason_code", "advisory_verdict", "width_verdict", "error_band_mm", "measured_mm",
        F.col("width_to_height_ratio").alias("ratio")))


@query("q7_verdicts_by_field", with_("judged", "SELECT field, verdict, count(*) AS n FROM judged GROUP BY ALL"))
def q7b(spark, sf):
    return v.judged(spark, sf).groupBy("field", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("q8_informational", with_("judged", """SELECT verdict, reason_code, count(*) AS n, count(measured_mm) AS n_measured
  FROM judged WHERE informational GROUP BY ALL"""))
def q8(spark, sf):
    return v.judged(spark, sf).where("informational").groupBy("verdict", "reason_code").agg(
        F.count(F.lit(1)).alias("n"), F.count("measured_mm").alias("n_measured"))


@query("q9_presence_verdict", with_("meas", """SELECT meas_id, CASE WHEN raw_mm IS NOT NULL THEN 'PASS'
  WHEN l_suppkey%9=0 THEN 'NOT_ASSESSED' WHEN src_ppmm>=6 THEN 'FAIL' ELSE 'NOT_ASSESSED' END AS presence_verdict,
  (CASE WHEN l_partkey%2=0 THEN 1 ELSE 0 END+CASE WHEN raw_mm IS NULL AND l_suppkey%9<>0 AND src_ppmm<6 THEN 1 ELSE 0 END)::BIGINT AS n_notes
  FROM meas"""))
def q9(spark, sf):
    df = v.measurements(spark, sf).withColumns({
        "present": F.col("measured_mm").isNotNull(), "assessable": F.col("l_suppkey") % 9 != 0,
        "legible": F.col("src_ppmm") >= 6, "note": F.when(F.col("l_partkey") % 2 == 0, "n").otherwise(""),
        "reasons": F.array(F.lit("small"))})
    return gates.presence_verdict(df).select("meas_id", "presence_verdict", F.size("notes").cast("bigint").alias("n_notes"))


def _messages(consensus: bool) -> str:
    height = "has_height AND NOT informational"
    mm = "coalesce((round_even(measured_mm*1000.0::DOUBLE,0)/1000.0::DOUBLE)::VARCHAR,'None')"
    req = "coalesce((round_even(required_mm*1000.0::DOUBLE,0)/1000.0::DOUBLE)::VARCHAR,'None')"
    size = f"field||': numeral height '||{mm}||' mm vs required '||{req}||' mm'"
    if consensus:
        why = "field||': presence not machine-assessable'"
        width = "field||': glyph width below one third of its height'"
    else:
        why = ("field||': presence not machine-assessable'||CASE WHEN assessable THEN '' ELSE ' by rule' END||"
               "CASE WHEN legible THEN '' ELSE ' in an illegible frame' END")
        width = "field||': glyph width is '||coalesce((round_even(ratio*1000.0::DOUBLE,0)/1000.0::DOUBLE)::VARCHAR,'None')||' of its height, below one third'"
    rows = [("presence_verdict='FAIL'", "violation", "field||': declaration not found'"),
            ("presence_verdict='NOT_ASSESSED'", "open", why),
            (f"{height} AND verdict='FAIL'", "violation", size),
            (f"{height} AND verdict='BORDERLINE'", "borderline", size + "||' (within measurement error)'"),
            (f"{height} AND verdict='NOT_ASSESSED'", "open", "field||': '||reason"),
            (f"{height} AND width_verdict='FAIL'", "violation", width)]
    if not consensus:
        rows.append((f"{height} AND width_verdict='BORDERLINE'", "borderline", width + "||' (within measurement error)'"))
    return " UNION ALL ".join(f"SELECT key, ord, {i} AS part, '{k}' AS kind, {t} AS text FROM src WHERE {c}"
                              for i, (c, k, t) in enumerate(rows))


REASON = """CASE reason_code WHEN 'lookup' THEN 'principal display panel area not given'
  WHEN 'scale' THEN 'frame too oblique for the marker''s physical scale' WHEN 'box' THEN 'numerals could not be boxed'
  WHEN 'resolution' THEN printf('%.1f px/mm is below the 6 px/mm floor', src_ppmm) WHEN 'measurement' THEN 'no numeral height'
  WHEN 'informational' THEN 'lettering, not numerals; for information'
  WHEN 'count' THEN 'measured '||n_glyphs||' numeral(s) but the recogniser read '||expected_digits
  WHEN 'confidence' THEN 'identified only by a value pattern' ELSE '' END"""


@query("q10_rollup", with_("decl", f""", src AS (SELECT *, scan_id AS key, {REASON} AS reason FROM decl), msg AS ({_messages(False)}),
a AS (SELECT key, string_agg(text, ' | ' ORDER BY ord, part) FILTER (WHERE kind='violation') AS violations,
  string_agg(text, ' | ' ORDER BY ord, part) FILTER (WHERE kind='borderline') AS borderline,
  string_agg(text, ' | ' ORDER BY ord, part) FILTER (WHERE kind='open') AS not_assessed FROM msg GROUP BY key)
SELECT s.key AS scan_id, coalesce(violations,'') AS violations, coalesce(borderline,'') AS borderline, coalesce(not_assessed,'') AS not_assessed,
  CASE WHEN violations IS NOT NULL THEN 'NON_COMPLIANT' WHEN borderline IS NOT NULL OR not_assessed IS NOT NULL THEN 'REVIEW_REQUIRED'
  ELSE 'COMPLIANT' END AS overall FROM (SELECT DISTINCT key FROM src) s LEFT JOIN a ON a.key=s.key""").replace("\n, src AS", ",\n src AS"))
def q10(spark, sf):
    out = adjudication.rollup(v.declarations(spark, sf))
    return out.select("scan_id", joined("violations"), joined("borderline"), joined("not_assessed"), "overall")


@query("q12_gate_log", _GATES + """SELECT gate, b AS blocking_height, seq, count(*) AS n FROM g GROUP BY ALL""")
def q12(spark, sf):
    g = _gates(spark, sf)
    parts = [g.where(F.col("seq") == i) for i in (1, 2, 3, 4)]
    return gates.gate_log(*parts).groupBy("gate", "blocking_height", "seq").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------- consensus
@query("c1_base_frame", with_("frames", """SELECT pack_id, arg_min(frame_no, (-label_ppmm, frame_no)) AS base_frame, count(*) AS n_frames
  FROM (SELECT pack_id, frame_no, CASE WHEN frame_no%4<>0 THEN label_ppmm ELSE 0 END AS label_ppmm FROM frames) GROUP BY pack_id""")
       .replace("arg_min(frame_no, (-label_ppmm, frame_no))", "arg_min(frame_no, struct_pack(a := -label_ppmm, b := frame_no))"))
def c1(spark, sf):
    f = v.frames_of(v.pack_rows(spark, sf)).withColumn(
        "label_ppmm", F.when(F.col("frame_no") % 4 != 0, F.col("label_ppmm")))
    return cs.base_frame(f)


_VOTE = """, n AS (SELECT pack_id, count(*) AS n_frames FROM frames GROUP BY pack_id),
vr AS (SELECT *, lower(trim(regexp_replace(value_text,'\\s+',' ','g'))) AS f FROM packrows),
cnt AS (SELECT pack_id, field, f, count(*) AS c, min(frame_no) AS fn, arg_min(value_text, frame_no) AS raw, max(match_confidence) AS conf
  FROM vr WHERE f<>'' GROUP BY ALL),
top AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY pack_id, field ORDER BY c DESC, fn)=1),
sure AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY pack_id, field ORDER BY conf DESC, fn)=1),
nv AS (SELECT pack_id, field, count(*) AS nv FROM cnt GROUP BY ALL),
vote AS (SELECT t.pack_id, t.field, CASE WHEN t.c=1 AND n_frames>=2 AND s.conf<0.5 THEN NULL WHEN t.c=1 THEN s.raw ELSE t.raw END AS value,
  (t.c=1 AND n_frames>=2 AND s.conf<0.5) OR nv>1 AS disagreed, t.c AS votes FROM top t JOIN sure s USING (pack_id, field)
  JOIN nv USING (pack_id, field) JOIN n USING (pack_id))"""


@query("c2_vote_value", with_("packrows frames", _VOTE + " SELECT * FROM vote").replace("\n, n AS", ",\n n AS"))
def c2(spark, sf):
    rows = v.staged_rows(spark, sf)
    return cs.vote_value(rows, cs.base_frame(v.frames_of(rows)))


_MERGED = _VOTE + """, b AS (SELECT *, (round_even(measured_mm*1000.0::DOUBLE,0)/1000.0::DOUBLE) AS mm, coalesce((round_even(measured_mm*1000.0::DOUBLE,0)/1000.0::DOUBLE)<>0,false) AS has,
  coalesce((round_even(measured_mm*1000.0::DOUBLE,0)/1000.0::DOUBLE)<>0,false) AND verdict IN ('PASS','FAIL','BORDERLINE') AS good FROM packrows),
u AS (SELECT *, bool_or(good) OVER p AS trusted FROM b WINDOW p AS (PARTITION BY pack_id, field)),
us AS (SELECT pack_id, field, count(*) AS used, quantile_cont(mm,0.5) AS med, max(mm)-min(mm) AS spread,
  arg_min(required_mm, frame_no) FILTER (WHERE required_mm IS NOT NULL) AS req, first(width_verdict ORDER BY frame_no) AS wv1,
  first(verdict ORDER BY frame_no) AS v1, first(reason_code ORDER BY frame_no) AS rc1, first(src_ppmm ORDER BY frame_no) AS src1,
  first(n_glyphs ORDER BY frame_no) AS ng1, first(expected_digits ORDER BY frame_no) AS ed1
  FROM u WHERE CASE WHEN trusted THEN good ELSE has END GROUP BY ALL),
bs AS (SELECT * FROM packrows QUALIFY row_number() OVER (PARTITION BY pack_id, field ORDER BY label_ppmm DESC, frame_no)=1),
fp AS (SELECT pack_id, field, any_value(ord) AS ord, count(*) FILTER (WHERE present) AS frames_present, bool_or(length(value_text)>0) AS any_text,
  bool_or(informational) AS info, bool_or(good) AS trusted, bool_or(has OR coalesce(required_mm<>0,false)) AS listed,
  round_even(max(match_confidence)*100.0::DOUBLE,0)/100.0::DOUBLE AS match_confidence FROM u GROUP BY ALL),
bf AS (SELECT pack_id, any_value(frame_no ORDER BY label_ppmm DESC, frame_no) AS x FROM frames GROUP BY pack_id),
mg0 AS (SELECT fp.*, n_frames, used, med, spread, req, wv1, v1, rc1, src1, ng1, ed1, vote.value, coalesce(disagreed,false) AS values_disagreed,
  bs.presence_verdict AS bpv, bs.verdict AS bv, bs.width_verdict AS bwv, bs.required_mm AS breq, bs.reason_code AS brc, bs.src_ppmm AS bsrc,
  bs.n_glyphs AS bng, bs.expected_digits AS bed, vote.value IS NULL AND any_text AS weak,
  0.15645::DOUBLE+greatest(0,spread/2-0.15645::DOUBLE) AS band, trusted AND req IS NOT NULL AND NOT info AS decided
  FROM fp JOIN n USING (pack_id) JOIN bs USING (pack_id, field) LEFT JOIN us USING (pack_id, field) LEFT JOIN vote USING (pack_id, field)),
mg AS (SELECT *, coalesce(used,0) AS frames_measured, CASE WHEN n_frames=1 THEN frames_present>0 ELSE NOT weak AND frames_present>0 END AS present,
  CASE WHEN n_frames=1 THEN bpv WHEN NOT weak AND frames_present>0 THEN 'PASS' WHEN weak THEN 'NOT_ASSESSED' ELSE bpv END AS presence_verdict,
  CASE WHEN used>0 THEN req ELSE breq END AS required_mm,
  CASE WHEN n_frames=1 THEN bv WHEN used>0 AND decided THEN CASE WHEN med>=req+band THEN 'PASS' WHEN med<=req-band THEN 'FAIL' ELSE 'BORDERLINE' END
    WHEN used>0 AND info THEN 'NOT_ASSESSED' WHEN used>0 THEN v1 ELSE bv END AS verdict,
  CASE WHEN used>0 THEN wv1 ELSE bwv END AS width_verdict FROM mg0)"""


def _merged(spark, sf) -> DataFrame:
    rows = v.staged_rows(spark, sf)
    return cs.consensus(rows, v.frames_of(rows), dims.band_model(spark))


@query("c3_consensus_presence", with_("packrows frames", _MERGED + """ SELECT pack_id, field, present, presence_verdict, frames_present,
  match_confidence, coalesce(value,'') AS value_text FROM mg""").replace("\n, n AS", ",\n n AS"))
def c3(spark, sf):
    return _merged(spark, sf).select("pack_id", "field", "present", "presence_verdict", "frames_present",
                                     "match_confidence", "value_text")


@query("c4_consensus_height", with_("packrows frames", _MERGED + f""" SELECT pack_id, field, verdict, frames_measured, trusted AS measurement_trusted,
  {r6('med')} AS measured_mm, {r6('spread')} AS spread_mm, required_mm, width_verdict FROM mg""").replace("\n, n AS", ",\n n AS"))
def c4(spark, sf):
    return v.flat(_merged(spark, sf).select("pack_id", "field", "verdict", "frames_measured", "measurement_trusted",
                                            "measured_mm", "spread_mm", "required_mm", "width_verdict"))


@query("c5_consensus_band", with_("packrows frames", _MERGED + f""" SELECT pack_id, field,
  {r6('CASE WHEN used>0 AND decided AND n_frames>1 THEN band END')} AS band_mm FROM mg""").replace("\n, n AS", ",\n n AS"))
def c5(spark, sf):
    return v.flat(_merged(spark, sf).select("pack_id", "field", "band_mm"))


_AGREE = """ , ag AS (SELECT pack_id, field, frames_present, frames_measured, values_disagreed,
  CASE WHEN frames_measured>1 THEN spread END AS spread_mm FROM mg WHERE listed AND n_frames>1) """


@query("c6_frame_agreement", with_("packrows frames", _MERGED + _AGREE + f"""SELECT pack_id, field, frames_present, frames_measured,
  values_disagreed, {r6('spread_mm')} AS spread_mm FROM ag""").replace("\n, n AS", ",\n n AS"))
def c6(spark, sf):
    return v.flat(cs.frame_agreement(_merged(spark, sf)))


_CREASON = """CASE WHEN used>0 AND decided THEN '' ELSE CASE WHEN used>0 AND NOT trusted THEN 'no frame gave an adjudicated height; ' ELSE '' END||
 CASE CASE WHEN used>0 THEN rc1 ELSE brc END WHEN 'lookup' THEN 'principal display panel area not given'
  WHEN 'scale' THEN 'frame too oblique for the marker''s physical scale' WHEN 'box' THEN 'numerals could not be boxed'
  WHEN 'resolution' THEN printf('%.1f px/mm is below the 6 px/mm floor', CASE WHEN used>0 THEN src1 ELSE bsrc END)
  WHEN 'measurement' THEN 'no numeral height' WHEN 'informational' THEN 'lettering, not numerals; for information'
  WHEN 'count' THEN 'measured '||CASE WHEN used>0 THEN ng1 ELSE bng END||' numeral(s) but the recogniser read '||CASE WHEN used>0 THEN ed1 ELSE bed END
  WHEN 'confidence' THEN 'identified only by a value pattern' ELSE '' END END"""


@query("c7_consensus_rollup", with_("packrows frames", _MERGED + f""", src AS (SELECT pack_id AS key, ord, field, presence_verdict, info AS informational,
  listed AS has_height, verdict, width_verdict, required_mm, CASE WHEN used>0 THEN med END AS measured_mm, {_CREASON} AS reason FROM mg),
msg AS ({_messages(True)}),
a AS (SELECT key, string_agg(text, ' | ' ORDER BY ord, part) FILTER (WHERE kind='violation') AS violations,
  string_agg(text, ' | ' ORDER BY ord, part) FILTER (WHERE kind='borderline') AS borderline,
  string_agg(text, ' | ' ORDER BY ord, part) FILTER (WHERE kind='open') AS not_assessed FROM msg GROUP BY key)
SELECT s.key AS pack_id, coalesce(violations,'') AS violations, coalesce(borderline,'') AS borderline, coalesce(not_assessed,'') AS not_assessed,
  CASE WHEN violations IS NOT NULL THEN 'NON_COMPLIANT' WHEN borderline IS NOT NULL OR not_assessed IS NOT NULL THEN 'REVIEW_REQUIRED'
  ELSE 'COMPLIANT' END AS overall FROM (SELECT DISTINCT key FROM src) s LEFT JOIN a ON a.key=s.key""").replace("\n, n AS", ",\n n AS"))
def c7(spark, sf):
    return cs.consensus_rollup(_merged(spark, sf)).select(
        "pack_id", joined("violations"), joined("borderline"), joined("not_assessed"), "overall")


@query("c8_agreement_summary", with_("packrows frames", _MERGED + _AGREE + f"""SELECT pack_id, {r6('max(spread_mm)')} AS widest_spread_mm,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE frames_measured=1),'') AS single_frame_fields,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE values_disagreed),'') AS disputed_fields FROM ag GROUP BY pack_id""")
       .replace("\n, n AS", ",\n n AS"))
def c8(spark, sf):
    out = cs.agreement_summary(cs.frame_agreement(_merged(spark, sf)))
    return v.flat(out.select("pack_id", "widest_spread_mm", F.array_join("single_frame_fields", ",").alias("single_frame_fields"),
                             F.array_join("disputed_fields", ",").alias("disputed_fields")))


@query("c4_frame_values", with_("packrows frames", _MERGED + f""" SELECT pack_id, field, frame_no, {r6('mm')} AS measured_mm, good AS trusted
  FROM u WHERE CASE WHEN trusted THEN good ELSE has END""").replace("\n, n AS", ",\n n AS"))
def c4_values(spark, sf):
    return v.flat(cs.frame_values(v.staged_rows(spark, sf)))


def _places(e: str, digits: int) -> str:
    one = f"1{'0' * digits}.0::DOUBLE"
    return f"(round_even((round_even(({e})*1000000.0::DOUBLE,0)/1000000.0::DOUBLE)*{one},0)/{one})"


def _shown(e: str, digits: int = 2) -> str:
    return f"printf('%.{digits}f', {_places(e, digits)})"


def _pack_report(spark, sf) -> pack_consensus.PackReport:
    rows = v.staged_rows(spark, sf)
    facts = rows.groupBy("pack_id", "frame_no").agg(F.max("tilt_deg").alias("tilt_deg"), F.min("src_ppmm").alias("src_ppmm"))
    return pack_consensus.pack_report(rows, v.frames_of(rows), dims.band_model(spark), facts)


@query("c_pack_declarations", with_("packrows frames", _MERGED + f""" SELECT pack_id, field, ord, present, presence_verdict, coalesce(value,'') AS value_text,
  match_confidence, values_disagreed, info AS informational, frames_present, frames_measured, trusted AS measurement_trusted,
  CASE WHEN used>0 THEN {_places('med', 3)} END AS measured_mm, CASE WHEN used>1 THEN {_places('spread', 3)} END AS spread_mm, required_mm, verdict,
  CASE WHEN used>0 AND decided AND n_frames>1 THEN {_places('band', 4)} END AS band_mm, width_verdict, {_CREASON} AS reason
  FROM mg""").replace("\n, n AS", ",\n n AS"))
def c_declarations(spark, sf):
    return _pack_report(spark, sf).declarations


@query("c_pack_report", f"""SELECT a.pack_id, a.overall, a.violations, b.widest_spread_mm, coalesce(b.single_frame_fields,'') AS single_frame_fields,
  coalesce(b.disputed_fields,'') AS disputed_fields, c.n_frames, c.base_frame, f.tilt_deg, {r6('f.src_ppmm')} AS src_ppmm
FROM ({ORACLE['c7_consensus_rollup']}) a LEFT JOIN ({ORACLE['c8_agreement_summary']}) b ON a.pack_id=b.pack_id JOIN (""" + with_("frames", """SELECT pack_id,
  arg_min(frame_no, struct_pack(a := -label_ppmm, b := frame_no)) AS base_frame, count(*) AS n_frames FROM frames GROUP BY pack_id""") + """) c
  ON c.pack_id=a.pack_id LEFT JOIN (""" + with_("packrows", """SELECT pack_id, frame_no, max(tilt_deg) AS tilt_deg, min(src_ppmm) AS src_ppmm
  FROM packrows GROUP BY ALL""") + ") f ON f.pack_id=c.pack_id AND f.frame_no=c.base_frame")
def c_report(spark, sf):
    out = _pack_report(spark, sf).packs
    return v.flat(out.select("pack_id", "overall", joined("violations"), "widest_spread_mm",
                             *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("single_frame_fields", "disputed_fields")],
                             "n_frames", "base_frame", "tilt_deg", "src_ppmm"))


@query("c_agreement_lines", with_("packrows frames", _MERGED + _AGREE + f""", rd AS (SELECT pack_id, field, ord, frame_no, mm,
  row_number() OVER (PARTITION BY pack_id, field ORDER BY frame_no)-1 AS k FROM u WHERE CASE WHEN trusted THEN good ELSE has END),
ap AS (SELECT pack_id, max(spread_mm) AS widest, string_agg(field, ', ' ORDER BY field) FILTER (WHERE frames_measured=1) AS lone,
  string_agg(field, ', ' ORDER BY field) FILTER (WHERE values_disagreed) AS dis FROM ag GROUP BY pack_id)
SELECT pack_id, 1 AS section, ord, 0::BIGINT AS part, rpad(field,22,' ')||' '||lpad(used::VARCHAR,greatest(4,length(used::VARCHAR))::INTEGER,' ')||'/'||n_frames||' '||
  lpad({_shown('med')},greatest(7,length({_shown('med')}))::INTEGER,' ')||' mm  '||CASE WHEN used>1 THEN {_shown('spread')}||' mm' ELSE 'one frame' END AS text
  FROM mg WHERE n_frames>1 AND used>0
UNION ALL SELECT pack_id, 1, ord, k//12+1, string_agg({_shown('mm')}, ', ' ORDER BY frame_no) FROM rd JOIN n USING (pack_id) WHERE n_frames>1 GROUP BY pack_id, ord, k//12
UNION ALL SELECT pack_id, 2, 0, 0, 'photos disagree on the text of: '||dis||'; the majority reading counts' FROM ap WHERE dis IS NOT NULL
UNION ALL SELECT pack_id, 3, 0, 0, 'no second opinion, measured in one photo only: '||lone FROM ap WHERE lone IS NOT NULL
UNION ALL SELECT pack_id, 4, 0, 0, 'widest spread between photos: '||{_shown('widest', 3)}||' mm' FROM ap WHERE widest IS NOT NULL""").replace("\n, n AS", ",\n n AS"))
def c_lines(spark, sf):
    return _pack_report(spark, sf).lines


@query("c_audit_packs", f"""SELECT a.pack_id, a.overall, b.widest_spread_mm FROM ({ORACLE['c7_consensus_rollup']}) a
  LEFT JOIN ({ORACLE['c8_agreement_summary']}) b ON a.pack_id=b.pack_id""")
def c_audit(spark, sf):
    rows = v.staged_rows(spark, sf)
    out = pack_consensus.audit_packs(rows, v.frames_of(rows), dims.band_model(spark))
    return v.flat(out.select("pack_id", "overall", "widest_spread_mm"))


@query("c9_single_frame", with_("packrows frames", _MERGED + """ SELECT pack_id, field, verdict, presence_verdict,
  'single frame; no agreement available' AS note FROM mg WHERE n_frames=1""").replace("\n, n AS", ",\n n AS"))
def c9(spark, sf):
    return _merged(spark, sf).where("n_frames = 1").select("pack_id", "field", "verdict", "presence_verdict", "note")


# ------------------------------------------------------------------------- history
@query("h2_get_scan", with_("hist", "SELECT scan_id, overall, mrp FROM hist WHERE scan_id='77'"))
def h2(spark, sf):
    return hs.get_scan(v.history(spark, sf), "77").select("scan_id", "overall", "mrp")


def _stored_history(spark, sf) -> str:
    path = session.shared_path(spark, "history-table")
    hs.upsert_table(v.history(spark, sf), path, 16)
    return path


@query("h2_get_scan_stored", with_("hist", "SELECT scan_id, overall, mrp FROM hist WHERE scan_id='77'"))
def h2_stored(spark, sf):
    return hs.get_scan(spark.read.parquet(_stored_history(spark, sf)), "77", 16).select("scan_id", "overall", "mrp")


@query("h3_list_scans", with_("hist", """SELECT scan_id, overall, n_violations, net_quantity, mrp, manufacturer FROM hist
  WHERE overall='NON_COMPLIANT' AND (manufacturer ILIKE '%hIgh%' OR mrp ILIKE '%hIgh%' OR net_quantity ILIKE '%hIgh%' OR scan_id ILIKE '%hIgh%')
  ORDER BY ts DESC, scan_id LIMIT 50 OFFSET 20"""))
def h3(spark, sf):
    return hs.list_scans(v.history(spark, sf), 50, 20, "NON_COMPLIANT", "hIgh").select(
        "scan_id", "overall", "n_violations", "net_quantity", "mrp", "manufacturer")


@query("h4_verdict_counts", with_("hist", """SELECT overall, count(*) AS n FROM hist GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM hist"""))
def h4(spark, sf):
    return hs.verdict_counts(v.history(spark, sf))


@query("h5_top_violated", with_("hist hviol", """, r AS (SELECT scan_id FROM hist WHERE overall='NON_COMPLIANT' ORDER BY ts DESC, scan_id LIMIT 500)
SELECT field, count(*) AS n FROM hviol WHERE scan_id IN (SELECT scan_id FROM r) GROUP BY field ORDER BY n DESC, field LIMIT 10""")
       .replace("\n, r AS", ",\n r AS"))
def h5(spark, sf):
    return hs.top_violated(v.history(spark, sf), 500)


@query("h5_top_violated_all", with_("hist hviol", """SELECT field, count(*) AS n FROM hviol
  WHERE scan_id IN (SELECT scan_id FROM hist WHERE overall='NON_COMPLIANT') GROUP BY field ORDER BY n DESC, field LIMIT 10"""))
def h5_all(spark, sf):
    return hs.top_violated(v.history(spark, sf), None)


@query("s6_upsert_history", with_("hist", """SELECT scan_id, CASE WHEN k%10=0 THEN 'COMPLIANT' ELSE overall END AS overall,
  CASE WHEN k%10=0 THEN 0 ELSE n_violations END AS n_violations, (CASE WHEN k%10=0 THEN 2 ELSE 1 END)::BIGINT AS batch_seq FROM hist"""))
def s6(spark, sf):
    return hs.upsert_history(v.history_updates(spark, sf), v.history(spark, sf)).select(
        "scan_id", "overall", "n_violations", "batch_seq")


@query("s6_upsert_table", with_("hist", """SELECT scan_id, CASE WHEN k%10=0 THEN 'COMPLIANT' ELSE overall END AS overall,
  CASE WHEN k%10=0 THEN 0 ELSE n_violations END AS n_violations, (CASE WHEN k%10=0 THEN 2 ELSE 1 END)::BIGINT AS batch_seq FROM hist"""))
def s6_stored(spark, sf):
    path = _stored_history(spark, sf)
    hs.upsert_table(v.history_updates(spark, sf), path, 16)
    return spark.read.parquet(path).select("scan_id", "overall", "n_violations", "batch_seq")
