"""Fixed schemas of the domain tables (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T



BOX = "struct<x:int,y:int,w:int,h:int>"

CAPTURES = ("scan_id string, pack_id string, frame_no int, path string, ts timestamp, officer string, "
            "marker_id int, requested_marker_id int, marker_length_mm double, "
            "corners array<struct<x:double,y:double>>, img_w int, img_h int, known_px_per_mm double, "
            "print_style string, panel_area_cm2 double")
OCR_WORDS = ("scan_id string, pass_no int, variant string, psm int, word_no int, text string, x int, y int, "
             "w int, h int, conf double")
OCR_CHARS = "scan_id string, pass_no int, c string, x int, y int, w int, h int"
# Word table as the recogniser writes it (tab separated).
RAW_WORDS = ("level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, "
             "top int, width int, height int, conf double, text string")
GLYPHS = ("scan_id string, field string, glyph_no int, x int, y int, w int, h double, area int, crop_w int, "
          "crop_h int, h_subpx double")
BAND_MODEL_DDL = (
    "bias_mm double, sigma_mm double, k double, band_override_mm double, min_px_per_mm double, "
    "max_tilt_deg double, max_baseline_slope_deg double, max_baseline_spread_deg double, "
    "hard_baseline_slope_deg double, hard_baseline_spread_deg double, coplanarity_mm_per_deg double, "
    "apply_bias_correction boolean, source string")
HEIGHT = (
    "struct<informational:boolean,required_mm:double,advisory_required_mm:double,measured_mm:double,"
    "median_width_mm:double,error_band_mm:double,source_px_per_mm:double,width_to_height_ratio:double,"
    "band_inflation:double,rule:string,rule_row:string,verdict:string,advisory_verdict:string,"
    "width_verdict:string,reason:string,reason_code:string,scale_gate:string,n_numerals_measured:bigint,"
    "expected_digits:int,glyph_count_matches_ocr:boolean>")
DECLARATION = (
    "struct<field:string,requirement:string,presence_verdict:string,present:boolean,assessable:boolean,"
    f"value_text:string,raw_text:string,match_confidence:double,notes:array<string>,height:{HEIGHT}>")
GATE = "struct<seq:int,gate:string,blocking_height:boolean,field:string,detail:string>"
# What a report says of its frame, besides the declarations.
FRAME = {
    "calibration": "struct<usable:boolean,method:string,marker_id:int,px_per_mm:double,tilt_deg:double,taper:double,reason:string>",
    "planarity": "struct<n_baselines:bigint,median_slope_deg:double,slope_spread_deg:double,severity:string,band_penalty_mm:double>",
    "legibility": ("struct<legible:boolean,reason_codes:array<string>,reasons:array<string>,n_words:bigint,mean_conf:double,"
                   "median_word_px:double,label_ppmm:double>"),
    "uncertainty": "struct<bias_mm:double,sigma_mm:double,k:double,band_mm:double,min_px_per_mm:double,source:string>",
}
REPORT = (f"scan_id string, ts timestamp, overall string, violations array<string>, borderline array<string>, "
          f"not_assessed array<string>, declarations array<{DECLARATION}>, gates array<{GATE}>, "
          + ", ".join(f"{name} {kind}" for name, kind in FRAME.items()))
HISTORY = ("scan_id string, ts timestamp, overall string, n_violations int, n_borderline int, "
           "net_quantity string, mrp string, manufacturer string, image_path string, officer string, "
           "report_json string, batch_seq bigint")
# One evaluation record as stored: fields is a map keyed by declaration.
EVAL_FIELD = ("struct<present_pred:boolean,present_gt:boolean,assessable:boolean,value_correct:boolean,"
              "presence_verdict:string,verdict:string,value_text:string,reason:string,reason_code:string,measured_mm:double,"
              "required_mm:double,gt_mm:double,src_ppmm:double,n_glyphs:int>")
EVAL_RECORD_JSON = (f"case_id bigint, tier string, overall string, legible boolean, calib_ok boolean, "
                    f"tilt_deg double, planarity_slope double, planarity_spread double, elapsed_ms double, "
                    f"error string, omitted array<string>, fields map<string,{EVAL_FIELD}>")

BAND_MODEL = T.StructType([
    T.StructField(n, {"double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}[t])
    for n, t in (part.split() for part in BAND_MODEL_DDL.split(", "))])
