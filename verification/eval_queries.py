"""Queries and SQL for evaluation, presentation, sources and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit import dims, schemas, session
from packaudit.operators import capture, evaluation as ev, gates, glyphs, history as hs, layout, presentation as pr
from packaudit.plans import eval_report as er
from packaudit.sources import ocr, stored
from packaudit.streaming import history as sh
from verification import views as v
from verification.sql import add, r6, with_

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def _model(spark) -> DataFrame:
    return dims.band_model(spark)


# ---------------------------------------------------------------------- evaluation
@query("e1_eval_records", """WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey%3 WHEN 0 THEN 'net_quantity' WHEN 1 THEN 'mrp' ELSE 'mfg_date' END AS field,
  o_custkey%90+1 AS n, month(o_orderdate) AS m, year(o_orderdate)+20 AS y FROM orders)
SELECT k AS case_id, field, k%7=0 OR k%10<>0 AS present_gt, CASE WHEN k%10=0 THEN NULL WHEN k%7=0 THEN NULL ELSE n/8.0::DOUBLE END AS gt_mm,
  CASE WHEN k%7=0 OR k%10=0 THEN NULL WHEN field='net_quantity' THEN k%2=0 WHEN field='mrp' THEN k%5<>0 AND k%11<>0 ELSE k%4=0 END AS value_correct
FROM p WHERE true""".replace("k%7=0 OR k%10<>0 AS present_gt", "(k%7=0 OR k%10<>0) AS present_gt")
       .replace("CASE WHEN k%10=0 THEN NULL WHEN k%7=0 THEN NULL ELSE n/8.0::DOUBLE END", "CASE WHEN k%7=0 THEN NULL ELSE n/8.0::DOUBLE END"))
def e1(spark, sf):
    o = v.table(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 90 + 1
    field = v._by(k % 3, dims.JUDGED_FIELDS)
    m, y = F.month("o_orderdate"), F.year("o_orderdate") + 20
    date = F.format_string("%02d/%d", m, y)
    pred = o.select(k.alias("case_id"), field.alias("field"), F.when(field == "net_quantity", F.concat(
        n.cast("string"), F.lit(" "), F.when(k % 2 == 0, "kgs").otherwise("ml")))
        .when(field == "mrp", F.when(k % 5 == 0, "9999").when(k % 11 == 0, "Rs x").otherwise(
            F.concat(n.cast("string"), F.lit(",50"))))
        .otherwise(F.when(k % 4 == 0, F.format_string(" %02d-%d", m, y)).otherwise("01.1999")).alias("value_text"))
    truth = o.where(k % 7 != 0).select(
        k.alias("case_id"), field.alias("field"), (k % 10 != 0).alias("present"), (n / F.lit(8.0)).alias("height_mm"),
        F.when(field == "mrp", n + F.lit(0.5)).otherwise(n.cast("double")).alias("value"), F.lit("KG").alias("unit"),
        date.alias("text"))
    return ev.eval_records(pred, truth).select("case_id", "field", "present_gt", "gt_mm", "value_correct")


_HS = """count(e) FILTER (WHERE present_gt) AS n, count(*) FILTER (WHERE present_gt) AS n_printed"""


def _height_sql(by: str, extra: str = "") -> str:
    key = f"{by}, " if by else ""
    return with_("ok", f"""SELECT {key}count(e) AS n, count(*) AS n_printed, {r6('avg(e)')} AS bias_mm,
  {r6('coalesce(stddev_samp(e),0)')} AS sigma_mm, {r6('avg(ae)')} AS mae_mm, {r6('max(ae)')} AS max_abs_mm,
  {r6('quantile_cont(ae,0.95)')} AS p95_abs_mm, {r6('avg(e/gt_mm)*100')} AS mean_rel_pct, {r6('avg(abs(e/gt_mm))*100')} AS mae_rel_pct,
  {r6('count(e)/greatest(count(*),1)')} AS yield_end_to_end FROM ok WHERE present_gt {extra} {'GROUP BY '+by if by else ''}
  HAVING count(e)>0""")


_HCOLS = ["n", "n_printed", "bias_mm", "sigma_mm", "mae_mm", "max_abs_mm", "p95_abs_mm", "mean_rel_pct", "mae_rel_pct",
          "yield_end_to_end"]


@query("e2_height_stats", _height_sql(""))
def e2(spark, sf):
    return v.flat(ev.height_stats(v.records(spark, sf)).select(*_HCOLS))


@query("e2_height_stats_by_field", _height_sql("field"))
def e2f(spark, sf):
    return v.flat(ev.height_stats(v.records(spark, sf), ["field"]).select("field", *_HCOLS))


@query("e2_height_stats_by_tier", _height_sql("tier", "AND coalesce(value_correct,true)"))
def e2t(spark, sf):
    return v.flat(ev.height_stats(v.records(spark, sf), ["tier"], True).select("tier", *_HCOLS))


@query("e3_error_by_resolution", with_("ok", f"""SELECT CASE WHEN src_ppmm<6 THEN '<6' WHEN src_ppmm<9 THEN '6-9' WHEN src_ppmm<12 THEN '9-12'
  WHEN src_ppmm<16 THEN '12-16' WHEN src_ppmm<22 THEN '16-22' ELSE '>=22' END AS bin, count(*) AS n, {r6('avg(e)')} AS bias_mm,
  {r6('coalesce(stddev_samp(e),0)')} AS sigma_mm, {r6('avg(ae)')} AS mae_mm FROM ok WHERE e IS NOT NULL AND coalesce(value_correct,true) GROUP BY 1"""))
def e3(spark, sf):
    return v.flat(ev.error_by_resolution(v.records(spark, sf)).drop("bin_no"))


@query("e4_error_by_tilt", with_("ok", f"""SELECT CASE WHEN case_tilt>=30 THEN '>=30' ELSE (case_tilt::INT//5*5)||'-'||(case_tilt::INT//5*5+5) END AS bin,
  count(*) AS n, {r6('avg(e)')} AS bias_mm, {r6('coalesce(stddev_samp(e),0)')} AS sigma_mm, {r6('quantile_cont(ae,0.95)')} AS p95_abs_mm
  FROM ok WHERE e IS NOT NULL AND coalesce(value_correct,true) GROUP BY 1"""))
def e4(spark, sf):
    return v.flat(ev.error_by_tilt(v.records(spark, sf)).drop("bin_no"))


_ADJ = "e IS NOT NULL AND verdict IN ('PASS','FAIL','BORDERLINE')"


@query("e5_band_validation", with_("ok", f"""SELECT count(*) AS n, 0.15645::DOUBLE AS band_mm, {r6('max(ae)')} AS max_abs_mm,
  {r6('avg((ae>0.15645::DOUBLE)::INT)')} AS fraction_outside, {r6('quantile_cont(ae,0.95)')} AS p95_abs_mm,
  {r6('quantile_cont(ae,0.99)')} AS p99_abs_mm, quantile_cont(ae,0.95)<=0.15645::DOUBLE AS band_covers_p95 FROM ok WHERE {_ADJ}"""))
def e5(spark, sf):
    return v.flat(ev.band_validation(v.records(spark, sf), _model(spark)))


add("nulls", ["cases"], """SELECT 'abs_median_slope_deg' AS statistic, abs(planarity_slope) AS v FROM cases WHERE NOT failed AND planarity_slope IS NOT NULL
UNION ALL SELECT 'slope_spread_deg', planarity_spread FROM cases WHERE NOT failed AND planarity_spread IS NOT NULL""")


@query("e6_planarity_null", with_("nulls", f"""SELECT statistic, count(*) AS n, {r6('max(v)')} AS max, {r6('quantile_cont(v,0.5)')} AS p50,
  {r6('quantile_cont(v,0.95)')} AS p95, {r6('quantile_cont(v,0.99)')} AS p99 FROM nulls GROUP BY statistic"""))
def e6(spark, sf):
    return v.flat(ev.planarity_null(ev.case_rows(v.records(spark, sf))))


_SL = """SELECT scan_id, line_no, degrees(atan(regr_slope(y+h/2.0::DOUBLE, x+w/2.0::DOUBLE))) AS sl FROM words GROUP BY ALL
  HAVING count(*)>=4 AND max(x+w/2.0::DOUBLE)-min(x+w/2.0::DOUBLE)>=8*quantile_cont(h::DOUBLE,0.5)"""
add("docslopes", ["words"], _SL)
add("docplan", ["docslopes"], """SELECT scan_id, quantile_cont(sl,0.5) AS md, quantile_cont(sl,0.9)-quantile_cont(sl,0.1) AS sp
  FROM docslopes GROUP BY scan_id HAVING count(*)>=3""")


def _doc_cases(spark, sf) -> DataFrame:
    plan = gates.planarity(v.doc_scans(spark, sf), v.words(spark, sf), _model(spark))
    return plan.select(F.col("median_slope_deg").alias("planarity_slope"),
                       F.col("slope_spread_deg").alias("planarity_spread"), F.lit(None).cast("string").alias("error"))


@query("e6_planarity_null_documents", with_("docplan", f"""SELECT 'abs_median_slope_deg' AS statistic, count(md) AS n, {r6('max(abs(md))')} AS max,
  {r6('quantile_cont(abs(md),0.5)')} AS p50, {r6('quantile_cont(abs(md),0.95)')} AS p95, {r6('quantile_cont(abs(md),0.99)')} AS p99 FROM docplan
  UNION ALL SELECT 'slope_spread_deg', count(sp), {r6('max(sp)')}, {r6('quantile_cont(sp,0.5)')}, {r6('quantile_cont(sp,0.95)')},
  {r6('quantile_cont(sp,0.99)')} FROM docplan"""))
def e6d(spark, sf):
    return v.flat(ev.planarity_null(_doc_cases(spark, sf)))


def _field_sql(src: str, names: str) -> str:
    return with_(names, f""", f AS (SELECT field, legible, assessable, present_pred AS p, present_gt AS g, value_correct,
  assessable AND NOT present_pred AND presence_verdict='NOT_ASSESSED' AS ab FROM {src}),
pop AS (SELECT 'all' AS population, * FROM f UNION ALL SELECT CASE WHEN legible THEN 'legible' ELSE 'illegible' END, * FROM f),
c AS (SELECT population, field, count(*) FILTER (WHERE assessable AND NOT ab AND p AND g) AS tp,
  count(*) FILTER (WHERE assessable AND NOT ab AND p AND NOT g) AS fp, count(*) FILTER (WHERE assessable AND NOT ab AND NOT p AND g) AS fn,
  count(*) FILTER (WHERE assessable AND NOT ab AND NOT p AND NOT g) AS tn, count(*) FILTER (WHERE ab) AS n_abstained,
  count(*) FILTER (WHERE NOT assessable) AS n_excluded, count(value_correct) FILTER (WHERE assessable AND NOT ab) AS value_n,
  count(*) FILTER (WHERE assessable AND NOT ab AND value_correct) AS vr FROM pop GROUP BY ALL)
SELECT population, field, tp, fp, fn, tn, tp+fp+fn+tn AS n_adjudicated, n_abstained, n_excluded,
  n_excluded>0 AND tp+fp+fn+tn+n_abstained=0 AS excluded_by_rule,
  {r6('CASE WHEN tp+fp+fn+tn+n_abstained>0 THEN n_abstained/(tp+fp+fn+tn+n_abstained) END')} AS abstention_rate,
  {r6('CASE WHEN tp+fp+fn+tn>0 THEN (tp+tn)/(tp+fp+fn+tn) END')} AS presence_accuracy,
  {r6('CASE WHEN NOT (n_excluded>0 AND tp+fp+fn+tn+n_abstained=0) THEN tp/greatest(1,tp+fn) END')} AS recall,
  {r6('CASE WHEN NOT (n_excluded>0 AND tp+fp+fn+tn+n_abstained=0) THEN tp/greatest(1,tp+fp) END')} AS precision, value_n,
  {r6('CASE WHEN value_n>0 THEN vr/value_n END')} AS value_exact_match FROM c""").replace("\n, f AS", ",\n f AS")


@query("e7_field_stats", _field_sql("(SELECT *, case_legible AS legible FROM ok)", "ok"))
def e7(spark, sf):
    return v.flat(ev.field_stats(v.records(spark, sf)))


add("presence", [], """SELECT lang AS field, quality=1 AS present_gt, n_chars>500 AS present_pred, lang<>'fr' AS assessable, toxic=0 AS legible,
  CASE WHEN n_chars%3=0 THEN 'NOT_ASSESSED' ELSE 'FAIL' END AS presence_verdict, CASE WHEN n_chars%5<>0 THEN n_chars%2=0 END AS value_correct
  FROM labels JOIN documents USING (doc_id)""")


@query("e7_field_stats_documents", _field_sql("presence", "presence"))
def e7d(spark, sf):
    return v.flat(ev.field_stats(v.presence_records(spark, sf)))


@query("e8_verdict_stats", with_("ok", f""", t AS (SELECT field, CASE WHEN gt_mm>=required_mm THEN 'PASS' ELSE 'FAIL' END AS t, verdict AS p,
  abs(gt_mm-required_mm)<=0.3::DOUBLE AS near FROM ok WHERE required_mm IS NOT NULL AND present_gt)
SELECT field, count(*) AS n, count(*) FILTER (WHERE p IN ('PASS','FAIL')) AS decisive, count(*) FILTER (WHERE p=t) AS correct,
  count(*) FILTER (WHERE t='FAIL' AND p='PASS') AS false_clear, count(*) FILTER (WHERE t='PASS' AND p='FAIL') AS false_violation,
  count(*) FILTER (WHERE p='BORDERLINE') AS borderline, count(*) FILTER (WHERE p='NOT_ASSESSED') AS not_assessed,
  count(*) FILTER (WHERE near) AS near_n, count(*) FILTER (WHERE near AND p IN ('PASS','FAIL') AND p<>t) AS near_wrong,
  count(*) FILTER (WHERE NOT near AND p IN ('PASS','FAIL') AND p<>t) AS clear_wrong,
  {r6("count(*) FILTER (WHERE p=t)/greatest(1,count(*) FILTER (WHERE p IN ('PASS','FAIL')))")} AS accuracy_on_decisive,
  {r6("count(*) FILTER (WHERE near AND p='BORDERLINE')/greatest(1,count(*) FILTER (WHERE near))")} AS near_borderline_rate,
  {r6("count(*) FILTER (WHERE NOT near AND p=t)/greatest(1,count(*) FILTER (WHERE NOT near AND p IN ('PASS','FAIL')))")} AS clear_accuracy
  FROM t GROUP BY field""").replace("\n, t AS", ",\n t AS"))
def e8(spark, sf):
    return v.flat(ev.verdict_stats(v.records(spark, sf)).select(
        "field", "n", "decisive", "correct", "false_clear", "false_violation", "borderline", "not_assessed", "near_n",
        "near_wrong", "clear_wrong", "accuracy_on_decisive", "near_borderline_rate", "clear_accuracy"))


add("truths", ["ok"], """SELECT case_id, mode, any_value(overall) AS overall, CASE WHEN bool_or(coalesce(present_gt AND gt_mm<2.5,false))
  OR bool_or(CASE WHEN mode='strict' THEN om_name OR om_mrp ELSE om_mrp END) THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS truth
  FROM ok, (VALUES ('strict'),('assessable')) m(mode) GROUP BY ALL""")


@query("e9_overall_stats", with_("truths", f"""SELECT mode, count(*) AS n_packs, count(*) FILTER (WHERE truth='NON_COMPLIANT') AS truth_non_compliant,
  count(*) FILTER (WHERE overall<>'REVIEW_REQUIRED') AS decided, count(*) FILTER (WHERE overall=truth) AS correct,
  count(*) FILTER (WHERE truth='NON_COMPLIANT' AND overall='COMPLIANT') AS violating_pack_cleared,
  count(*) FILTER (WHERE truth='COMPLIANT' AND overall='NON_COMPLIANT') AS compliant_pack_accused,
  {r6("count(*) FILTER (WHERE overall=truth)/greatest(1,count(*) FILTER (WHERE overall<>'REVIEW_REQUIRED'))")} AS accuracy_when_decided,
  {r6("count(*) FILTER (WHERE overall='REVIEW_REQUIRED')/count(*)")} AS review_required_rate FROM truths GROUP BY mode"""))
def e9(spark, sf):
    return v.flat(ev.overall_stats(v.records(spark, sf), F.lit(2.5)).select(
        "mode", "n_packs", "truth_non_compliant", "decided", "correct", "violating_pack_cleared", "compliant_pack_accused",
        "accuracy_when_decided", "review_required_rate"))


@query("e9_overall_confusion", with_("truths", "SELECT mode, truth, overall, count(*) AS n FROM truths GROUP BY ALL"))
def e9c(spark, sf):
    return ev.overall_confusion(v.records(spark, sf), F.lit(2.5))


@query("e10_gate_stats", with_("recs cases", """SELECT 'exception' AS key, count(*) AS n FROM cases WHERE failed UNION ALL
SELECT 'total', count(*) FROM cases WHERE NOT failed UNION ALL SELECT 'calibrated', count(*) FROM cases WHERE NOT failed AND calib_ok UNION ALL
SELECT 'abstain_'||CASE reason_code WHEN 'resolution' THEN 'INSUFFICIENT_RESOLUTION' WHEN 'scale' THEN 'NO_SCALE' WHEN 'measurement' THEN 'NO_GLYPHS'
  WHEN 'box' THEN 'NO_GLYPHS' WHEN 'count' THEN 'NO_GLYPHS' WHEN 'informational' THEN 'NO_GLYPHS' ELSE 'OTHER' END, count(*)
  FROM recs WHERE NOT failed AND measured_mm IS NULL AND present_gt GROUP BY 1"""))
def e10(spark, sf):
    return ev.gate_stats(v.records(spark, sf))


_SWEEP = f""", sw AS (SELECT f::DOUBLE AS floor, e, ae FROM ok, (VALUES (6),(8),(10),(12),(14),(16),(18)) t(f) WHERE {_ADJ}
  AND coalesce(value_correct,true) AND src_ppmm>=f)"""


@query("e11_floor_sweep", with_("ok", _SWEEP + f""" SELECT floor, count(*) AS n, {r6('avg(e)')} AS bias_mm, {r6('stddev_samp(e)')} AS sigma_mm,
  {r6('avg(ae)')} AS mae_mm, {r6('quantile_cont(ae,0.95)')} AS p95_abs_mm, {r6('quantile_cont(ae,0.99)')} AS p99_abs_mm FROM sw GROUP BY floor""")
       .replace("\n, sw AS", ",\n sw AS"))
def e11s(spark, sf):
    return v.flat(ev.floor_sweep(v.records(spark, sf)))


@query("e11_derive_gates", with_("ok", _SWEEP + f""", st AS (SELECT floor, count(*) AS n, avg(e) AS b, stddev_samp(e) AS s,
  quantile_cont(ae,0.95) AS p95, quantile_cont(ae,0.99) AS p99 FROM sw GROUP BY floor),
ch AS (SELECT coalesce(min(floor) FILTER (WHERE n>=20 AND p95<=0.09005::DOUBLE AND s<=0.05005::DOUBLE),12) AS floor FROM st)
SELECT floor, n, {r6('b')} AS bias_mm, {r6('s')} AS sigma_mm, {r6('greatest(abs(b)+4*s,p99)')} AS band_mm FROM st JOIN ch USING (floor)""")
       .replace("\n, sw AS", ",\n sw AS"))
def e11(spark, sf):
    return v.flat(ev.derive_gates(v.records(spark, sf), 4.0).select("floor", "n", "bias_mm", "sigma_mm", "band_mm"))


@query("e12_derive_slope_gate", with_("docplan", """SELECT round_even(greatest(0.25::DOUBLE,1.5::DOUBLE*quantile_cont(abs(md),0.99))*1000,0)/1000 AS max_baseline_slope_deg,
  round_even(greatest(0.5::DOUBLE,1.5::DOUBLE*quantile_cont(sp,0.99))*1000,0)/1000 AS max_baseline_spread_deg FROM docplan"""))
def e12(spark, sf):
    return ev.derive_slope_gate(_doc_cases(spark, sf))


add("sheet", [], """SELECT o_orderkey::VARCHAR AS scan_id, i::INTEGER AS line_no, (i*30+o_orderkey%7)::INTEGER AS y,
  CASE WHEN (o_orderkey+i)%11=0 THEN 'row '||i ELSE '0123456789 '||i END AS text,
  i*0.7::DOUBLE+(o_orderkey%13)*0.01::DOUBLE AS height_mm FROM orders, range(1,10) r(i) WHERE i<=o_orderkey%3+7""")
add("sheetrows", ["sheet"], "SELECT * FROM sheet WHERE text LIKE '0123%'")
add("truth8", [], "SELECT * FROM (VALUES (1,1.016::DOUBLE),(2,1.48167::DOUBLE),(3,1.98967::DOUBLE),(4,2.49767::DOUBLE),(5,3.00567::DOUBLE),"
                  "(6,3.97933::DOUBLE),(7,4.99533::DOUBLE),(8,6.01133::DOUBLE)) t(row_no, true_height_mm)")
add("paired", ["sheetrows", "truth8"], """SELECT s.*, true_height_mm FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY y, line_no) AS row_no,
  count(*) OVER (PARTITION BY scan_id) AS n FROM sheetrows) s JOIN truth8 USING (row_no) WHERE n=8""")


def _sheet(spark, sf) -> DataFrame:
    """Photographs of the known-height sheet: seven to nine rows, some not digits."""
    k = F.col("o_orderkey")
    o = v.table(spark, sf, "orders").select(k, F.explode(F.sequence(F.lit(1), (k % 3 + 7).cast("int"))).alias("i"))
    i = F.col("i")
    return o.select(
        k.cast("string").alias("scan_id"), i.alias("line_no"), (i * 30 + k % 7).cast("int").alias("y"),
        F.when((k + i) % 11 == 0, F.concat(F.lit("row "), i.cast("string")))
        .otherwise(F.concat(F.lit("0123456789 "), i.cast("string"))).alias("text"),
        (i * F.lit(0.7) + (k % 13) * F.lit(0.01)).alias("height_mm"))


@query("p15_digit_rows", with_("sheetrows", "SELECT scan_id, line_no, text FROM sheetrows"))
def p15(spark, sf):
    return layout.digit_rows(_sheet(spark, sf)).select("scan_id", "line_no", "text")


@query("p16_pair_with_truth", with_("paired", f"SELECT scan_id, line_no, row_no::INTEGER AS row_no, {r6('true_height_mm')} AS true_height_mm FROM paired"))
def p16(spark, sf):
    pairs, _ = layout.pair_with_truth(layout.digit_rows(_sheet(spark, sf)), dims.height_truth(spark))
    return v.flat(pairs.select("scan_id", "line_no", "row_no", "true_height_mm"))


@query("p16_skipped_scans", with_("sheetrows", "SELECT scan_id, count(*) AS found, 8::BIGINT AS wanted FROM sheetrows GROUP BY scan_id HAVING count(*)<>8"))
def p16s(spark, sf):
    return layout.pair_with_truth(layout.digit_rows(_sheet(spark, sf)), dims.height_truth(spark))[1]


@query("e13_fit_physical", with_("paired", f"""SELECT count(*) AS n, count(DISTINCT scan_id) AS n_scans, {r6('avg(height_mm-true_height_mm)')} AS bias_mm,
  {r6('stddev_samp(height_mm-true_height_mm)')} AS sigma_mm, {r6('quantile_cont(abs(height_mm-true_height_mm),0.95)')} AS p95_abs_mm, 2.0::DOUBLE AS k,
  {r6('greatest(abs(avg(height_mm-true_height_mm))+2*stddev_samp(height_mm-true_height_mm), quantile_cont(abs(height_mm-true_height_mm),0.95))')} AS band_override_mm,
  count(*)>=10 AS usable, 'physical calibration: '||count(*)||' numeral measurements from '||count(DISTINCT scan_id)||' scans' AS source FROM paired"""))
def e13(spark, sf):
    pairs, _ = layout.pair_with_truth(layout.digit_rows(_sheet(spark, sf)), dims.height_truth(spark))
    return v.flat(ev.fit_physical(pairs))


_BANDS = ",".join(f"({b}::DOUBLE)" for b in sorted([*dims.BAND_SWEEP, 0.1564]))


@query("e14_band_sweep", with_("ok", f""", sw AS (SELECT band, abs(gt_mm-required_mm)<=0.3::DOUBLE AS near, CASE WHEN gt_mm>=required_mm THEN 'PASS' ELSE 'FAIL' END AS t,
  CASE WHEN measured_mm>=required_mm+band THEN 'PASS' WHEN measured_mm<=required_mm-band THEN 'FAIL' ELSE 'B' END AS p
  FROM ok, (VALUES {_BANDS}) b(band) WHERE {_ADJ} AND required_mm IS NOT NULL),
a AS (SELECT band, count(*) AS n, count(*) FILTER (WHERE p<>'B') AS decisive, count(*) FILTER (WHERE p<>'B' AND p<>t) AS wrong,
  count(*) FILTER (WHERE near) AS near_n, count(*) FILTER (WHERE near AND p<>'B') AS near_decisive,
  count(*) FILTER (WHERE near AND p<>'B' AND p<>t) AS near_wrong FROM sw GROUP BY band)
SELECT *, {r6('decisive/n')} AS decisive_rate, coalesce(band=(SELECT min(band) FROM a WHERE wrong=0),false) AS safest FROM a""").replace("\n, sw AS", ",\n sw AS"))
def e14(spark, sf):
    return v.flat(ev.band_sweep(v.records(spark, sf), _model(spark)))


@query("e15_eval_report")
def e15(spark, sf):
    return v.flat(er.eval_report(v.records(spark, sf), _model(spark)))


@query("e15_run_facts", with_("cases", f"""SELECT count(*) AS n_cases, {r6('avg(legible::INT)')} AS legible_rate,
  {r6('quantile_cont(elapsed_ms,0.5)')} AS median_elapsed_ms FROM cases WHERE NOT failed"""))
def e15r(spark, sf):
    return v.flat(er.run_facts(v.records(spark, sf)))


@query("e16_eval_summary", with_("ok", f"""SELECT field AS key, count(e)::DOUBLE AS n, {r6('avg(e)')} AS bias_mm, {r6('coalesce(stddev_samp(e),0)')} AS sigma_mm,
  {r6('avg(ae)')} AS mae_mm, {r6('quantile_cont(ae,0.95)')} AS p95_abs_mm FROM ok WHERE present_gt GROUP BY field HAVING count(e)>0"""))
def e16(spark, sf):
    long = er.melt(ev.height_stats(v.records(spark, sf), ["field"]), "height_by_field", ["field"])
    return v.flat(er.eval_summary(long, "height_by_field"))


@query("e17_assign_split", """SELECT o_orderkey AS case_id, ['clean','realistic','realistic','harsh'][o_orderkey%4+1] AS tier,
  CASE WHEN ('0x'||substr(md5(o_orderkey::VARCHAR),1,6))::BIGINT < 8388608 THEN 'calibration' ELSE 'validation' END AS split FROM orders""")
def e17(spark, sf):
    return ev.assign_split(v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id")))


# -------------------------------------------------------------------- presentation
@query("x1_headline", with_("recs decl", """, o AS (SELECT case_id::VARCHAR AS scan_id, any_value(overall) AS overall FROM recs GROUP BY 1)
SELECT o.scan_id, overall, CASE overall WHEN 'COMPLIANT' THEN 'OK' WHEN 'NON_COMPLIANT' THEN '!!' ELSE '??' END AS badge,
  CASE overall WHEN 'COMPLIANT' THEN 'no problem found' WHEN 'NON_COMPLIANT' THEN 'problem found' ELSE 'needs a human check' END AS headline,
  (SELECT count(*) FROM decl d WHERE d.scan_id=o.scan_id AND (presence_verdict='FAIL' OR verdict='FAIL')) AS n_bad FROM o""").replace("\n, o AS", ",\n o AS"))
def x1(spark, sf):
    d = session.stage(v.declarations(spark, sf).select("scan_id", "frame_no", "presence_verdict", "verdict"), "declarations")
    overall = v.with_overall(d).groupBy("scan_id").agg(F.any_value("overall").alias("overall"))
    return pr.headline(overall, d)


_TIPS = {"EXCESSIVE_TILT": 5, "LOW_LEGIBILITY": 3, "PANEL_NOT_COPLANAR": 7, "INSUFFICIENT_RESOLUTION": 2}
_SEQ = {"EXCESSIVE_TILT": 1, "LOW_LEGIBILITY": 2, "PANEL_NOT_COPLANAR": 3, "INSUFFICIENT_RESOLUTION": 4}
_TIP_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey::VARCHAR AS scan_id, {_SEQ[g]} AS seq, '{dims.GATE_ADVICE[g]}' AS text FROM orders WHERE o_orderkey%{m}=0"
    for g, m in _TIPS.items())


def _gates(spark, sf) -> DataFrame:
    from verification.core_queries import _gates as g
    return g(spark, sf)


@query("x2_gate_advice", f"SELECT scan_id, seq, text AS advice FROM ({_TIP_SQL})")
def x2(spark, sf):
    doubled = _gates(spark, sf).unionByName(_gates(spark, sf))
    return pr.gate_advice(doubled, dims.gate_advice(spark))


@query("x3_capture_quality", with_("homo", """SELECT scan_id, CASE WHEN NOT ok THEN NULL WHEN p>=16 THEN 'ideal' WHEN p>=10 THEN 'fine' WHEN p>=6 THEN 'near the limit'
  ELSE 'too far' END AS closeness, CASE WHEN NOT ok THEN NULL WHEN t<=15 THEN 'good' WHEN t<=25 THEN 'slightly tilted' ELSE 'too angled' END AS angle
  FROM (SELECT scan_id, has_h AS ok, CASE WHEN known>0 THEN known ELSE side_px/mm END AS p, CASE WHEN known>0 THEN 0 ELSE tilt_deg END AS t FROM homo)"""))
def x3(spark, sf):
    return pr.capture_quality(capture.metric_scale(v.captures(spark, sf)), _model(spark))


@query("x4_reason_class", with_("judged", """SELECT CASE reason_code WHEN 'resolution' THEN 'too_far' WHEN 'scale' THEN 'card_angled' WHEN 'count' THEN 'digits_merged'
  WHEN 'confidence' THEN 'uncertain_field' WHEN 'informational' THEN 'lettering' WHEN 'box' THEN 'unboxed' WHEN 'lookup' THEN 'unreliable'
  WHEN 'measurement' THEN 'unreliable' ELSE 'unmeasured' END AS class, count(*) AS n FROM judged GROUP BY 1"""))
def x4(spark, sf):
    return v.judged(spark, sf).groupBy(pr.reason_class(F.col("reason_code"), F.col("scale_gate")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("x4_legibility_phrase", with_("words", """SELECT doc_id::VARCHAR AS scan_id, CASE WHEN n IS NULL THEN 'no_text' WHEN mc<60 THEN 'too_blurry' ELSE 'not_clear' END AS phrase
  FROM documents LEFT JOIN (SELECT scan_id, count(*) AS n, avg(conf) AS mc FROM words GROUP BY scan_id) ON scan_id=doc_id::VARCHAR"""))
def x4l(spark, sf):
    leg = gates.legibility(v.doc_scans(spark, sf), v.words(spark, sf), None, _model(spark))
    return leg.select("scan_id", pr.legibility_phrase(F.col("reason_codes")).alias("phrase"))


@query("x5_todo_items", with_("decl", f"""SELECT scan_id, -1 AS ord, seq AS part, text FROM ({_TIP_SQL}) UNION ALL
SELECT scan_id, ord, 0, 'missing: '||CASE field WHEN 'net_quantity' THEN 'How much the pack holds' WHEN 'mrp' THEN 'Highest retail price, taxes included'
  ELSE 'When it was made, packed or imported, by month and year' END FROM decl WHERE presence_verdict='FAIL' UNION ALL
SELECT scan_id, ord, 1, CASE verdict WHEN 'FAIL' THEN 'too small: ' ELSE 'too close to call: ' END||field||' is '||printf('%.2f mm against a minimum of %.1f mm', round_even(measured_mm*100,0)/100, round_even(required_mm*10,0)/10) FROM decl WHERE verdict IN ('FAIL','BORDERLINE')"""))
def x5(spark, sf):
    req = dims.literal_map(dict(dims.DECLARATIONS))
    d = v.declarations(spark, sf).withColumn("requirement", F.try_element_at(req, F.col("field")))
    return pr.todo_items(d, _gates(spark, sf), dims.gate_advice(spark))


@query("x6_size_rows", with_("decl", """SELECT scan_id, field, CASE WHEN NOT has_height OR (informational AND measured_mm IS NULL) THEN '-' WHEN informational THEN 'i'
  WHEN verdict='PASS' THEN 'OK' WHEN verdict='FAIL' THEN 'NO' WHEN verdict='BORDERLINE' THEN '~' ELSE '?' END AS mark,
  CASE WHEN measured_mm IS NULL THEN '-' ELSE printf('%.2f mm', round_even(measured_mm*100,0)/100) END AS printed,
  CASE WHEN required_mm IS NULL THEN '-' ELSE printf('%.1f mm', required_mm) END AS minimum,
  CASE WHEN NOT has_height THEN 'not found' WHEN informational AND measured_mm IS NOT NULL THEN 'lettering'
    WHEN NOT informational AND verdict='PASS' AND advisory_verdict IN ('FAIL','BORDERLINE') THEN 'stricter reading fails'
    WHEN NOT informational AND verdict='PASS' THEN '' WHEN verdict='FAIL' THEN 'too small' WHEN verdict='BORDERLINE' THEN 'too close to call'
    WHEN reason_code='resolution' THEN 'too_far' WHEN reason_code='scale' THEN 'card_angled' WHEN reason_code='count' THEN 'digits_merged'
    WHEN reason_code='confidence' THEN 'uncertain_field' WHEN reason_code='informational' THEN 'lettering' WHEN reason_code='box' THEN 'unboxed'
    WHEN reason_code IS NULL THEN 'unmeasured' ELSE 'unreliable' END AS note FROM decl"""))
def x6s(spark, sf):
    return pr.size_rows(v.declarations(spark, sf)).drop("ord")


# ------------------------------------------------------------------------- sources
@query("s3_clean_words", with_("words", """SELECT scan_id, count(*) AS n, sum(round_even((x*2+1)/3.0::DOUBLE,0))::BIGINT AS sx, sum(round_even((w*2)/3.0::DOUBLE,0))::BIGINT AS sw,
  sum(length(text))::BIGINT AS chars FROM words WHERE conf-20>=0 GROUP BY scan_id"""))
def s3(spark, sf):
    raw = v.words(spark, sf).select(
        "scan_id", (F.col("x") * 2 + 1).alias("left"), (F.col("y") * 2).alias("top"), (F.col("w") * 2).alias("width"),
        (F.col("h") * 2).alias("height"), (F.col("conf") - 20).alias("conf"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    blank = raw.withColumn("text", F.lit("   "))
    return ocr.clean_ocr_words(raw.unionByName(blank), F.lit(3.0)).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("w").alias("sw"), F.sum(F.length("text")).alias("chars"))


@query("s4_parse_chars", with_("chars", """SELECT scan_id, count(*) AS n, sum(round_even(x/2.0::DOUBLE,0))::BIGINT AS sx,
  sum(round_even((2000-(1000-i%50))/2.0::DOUBLE,0))::BIGINT AS sy, sum(round_even(9/2.0::DOUBLE,0))::BIGINT AS sw FROM chars GROUP BY scan_id"""))
def s4(spark, sf):
    c, i = v.chars(spark, sf), F.col("i") % 50
    text = F.concat_ws(" ", "c", F.col("x"), F.lit(980) - i, F.col("x") + 9, F.lit(1000) - i, F.lit(0))
    rows = c.select("scan_id", text.alias("value")).unionByName(c.where("i = 0").select("scan_id", F.lit("~ 1 2").alias("value")))
    return ocr.parse_ocr_chars(rows, F.lit(2000), F.lit(2.0)).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("w").alias("sw"))


def _case_json(spark, sf) -> DataFrame:
    """Records nested per case as JSON, the way they are stored."""
    r = v.records(spark, sf).withColumn("n_glyphs", F.col("n_glyphs").cast("int"))
    body = F.struct("present_pred", "present_gt", "assessable", "value_correct", "presence_verdict", "verdict", "value_text",
                    "reason", "reason_code", "measured_mm", "required_mm", "gt_mm", "src_ppmm", "n_glyphs")
    return r.groupBy("case_id", *ev.CASE_COLS).agg(
        F.map_from_entries(F.collect_list(F.struct("field", body))).alias("fields")).select(
        F.to_json(F.struct("case_id", *ev.CASE_COLS, "fields")).alias("value"))


@query("s5_eval_records", with_("ok", f"""SELECT case_id, field, tier, verdict, {r6('measured_mm')} AS measured_mm, {r6('gt_mm')} AS gt_mm, value_correct FROM ok"""))
def s5(spark, sf):
    return v.flat(stored.parse_eval_records(_case_json(spark, sf)).select(
        "case_id", "field", "tier", "verdict", "measured_mm", "gt_mm", "value_correct"))


@query("s7_band_model", with_("ok", _SWEEP + """, st AS (SELECT floor, count(*) AS n, avg(e) AS b, stddev_samp(e) AS s,
  quantile_cont(ae,0.95) AS p95, quantile_cont(ae,0.99) AS p99 FROM sw GROUP BY floor),
ch AS (SELECT coalesce(min(floor) FILTER (WHERE n>=20 AND p95<=0.09005::DOUBLE AND s<=0.05005::DOUBLE),12) AS floor FROM st)
SELECT round_even(b*100000,0)/100000 AS bias_mm, round_even(s*100000,0)/100000 AS sigma_mm, 4.0::DOUBLE AS k,
  round_even(greatest(abs(b)+4*s,p99)*100000,0)/100000 AS band_override_mm, floor AS min_px_per_mm, 35.0::DOUBLE AS max_tilt_deg,
  0.2::DOUBLE AS max_baseline_slope_deg, 5.0::DOUBLE AS hard_baseline_slope_deg FROM st JOIN ch USING (floor)""").replace("\n, sw AS", ",\n sw AS"))
def s7(spark, sf):
    path = session.shared_path(spark, "band-model")
    stored.save_band_model(stored.model_from_fit(ev.derive_gates(v.records(spark, sf), 4.0)), path)
    return stored.load_band_model(spark, path).select(
        "bias_mm", "sigma_mm", "k", "band_override_mm", "min_px_per_mm", "max_tilt_deg", "max_baseline_slope_deg",
        "hard_baseline_slope_deg")


@query("s9_batch_summary", with_("hist", "SELECT scan_id, overall, n_violations, 0 AS n_borderline FROM hist"))
def s9(spark, sf):
    return pr.batch_summary(v.history(spark, sf).withColumn("borderline", F.array().cast("array<string>")))


@query("s9_batch_total", "SELECT count(*) AS scanned FROM orders")
def s9t(spark, sf):
    return pr.batch_total(v.history(spark, sf))


# ----------------------------------------------------------------------- streaming
def _event_stream(spark, sf) -> DataFrame:
    schema = v.table(spark, sf, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@query("t2_stream_history", """SELECT (user_id%500)::VARCHAR AS scan_id, arg_max(event_type, event_id) AS overall, max(event_id) AS last_event
  FROM events GROUP BY 1""")
def t2(spark, sf):
    rows = _event_stream(spark, sf).select(
        (F.col("user_id") % 500).cast("string").alias("scan_id"), "ts", F.col("event_type").alias("overall"),
        F.col("event_id").alias("last_event"))
    path, mark = session.shared_path(spark, "history"), session.shared_path(spark, "history-mark")
    q = sh.stream_history(rows, path, mark, order="last_event").trigger(availableNow=True).start()
    q.awaitTermination()
    return sh.read_history(spark, path).select("scan_id", "overall", "last_event")


@query("t3_stream_verdict_counts", "SELECT event_type AS overall, count(*) AS n FROM events GROUP BY 1")
def t3(spark, sf):
    rows = _event_stream(spark, sf).select(F.col("event_type").alias("overall"))
    path, mark = session.shared_path(spark, "counts"), session.shared_path(spark, "counts-mark")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = (sh.stream_verdict_counts(rows).writeStream.outputMode("complete").foreachBatch(keep)
         .option("checkpointLocation", mark).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(path)
