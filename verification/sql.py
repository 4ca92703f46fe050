"""DuckDB twins of the views: CTE bodies by name, written on their own, joined by ``with_``."""

from __future__ import annotations

from packaudit import dims

HI = repr(dims.MIN_WIDTH_RATIO * (1.0 + dims.WIDTH_RATIO_BAND))
LO = repr(dims.MIN_WIDTH_RATIO * (1.0 - dims.WIDTH_RATIO_BAND))


def r6(e: str) -> str:
    return f"floor(({e})*1e6::DOUBLE+0.5::DOUBLE)/1e6::DOUBLE"


KEY5 = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice*100+0.5)::BIGINT)"
FIELD3 = "CASE {}%3 WHEN 0 THEN 'net_quantity' WHEN 1 THEN 'mrp' ELSE 'mfg_date' END"


def table_i(area: str, style: str) -> str:
    return f"""CASE WHEN {area} IS NULL OR {area}<=0 THEN NULL
      WHEN {area}<=50 THEN CASE WHEN {style}='normal' THEN 1.0 ELSE 1.5 END
      WHEN {area}<=100 THEN CASE WHEN {style}='normal' THEN 1.5 ELSE 3.0 END
      WHEN {area}<=500 THEN CASE WHEN {style}='normal' THEN 2.5 ELSE 4.0 END
      WHEN {area}<=2500 THEN CASE WHEN {style}='normal' THEN 4.0 ELSE 6.0 END
      ELSE 6.0 END::DOUBLE"""


def advisory(kind: str, base: str, area: str, style: str) -> str:
    return f"""CASE WHEN {area} IS NULL OR {area}<=0 THEN NULL
      WHEN {kind}='weight_or_volume' THEN CASE
        WHEN {base}<=200 THEN CASE WHEN {style}='normal' THEN 1.0 ELSE 2.0 END
        WHEN {base}<=500 THEN CASE WHEN {style}='normal' THEN 2.0 ELSE 4.0 END
        ELSE CASE WHEN {style}='normal' THEN 4.0 ELSE 6.0 END END
      WHEN {area}<=100 THEN CASE WHEN {style}='normal' THEN 1.0 ELSE 2.0 END
      WHEN {area}<=500 THEN CASE WHEN {style}='normal' THEN 2.0 ELSE 4.0 END
      WHEN {area}<=2500 THEN CASE WHEN {style}='normal' THEN 4.0 ELSE 6.0 END
      ELSE 6.0 END::DOUBLE"""


def tier(mm: str, req: str, band: str) -> str:
    return (f"CASE WHEN {mm} IS NULL OR {req} IS NULL THEN 'NOT_ASSESSED' WHEN {mm}>={req}+({band}) THEN 'PASS' "
            f"WHEN {mm}<={req}-({band}) THEN 'FAIL' ELSE 'BORDERLINE' END")


CTE: dict[str, str] = {}

CTE["meas"] = f"""SELECT {KEY5} AS meas_id, l_orderkey::VARCHAR AS scan_id, o_custkey::VARCHAR AS pack_id,
  o_orderkey AS frame_no, {FIELD3.format('l_partkey')} AS field,
  CASE WHEN p_size<>13 THEN p_size*p_size*1.1::DOUBLE END AS panel_area_cm2,
  CASE WHEN l_returnflag='A' THEN 'embossed' ELSE 'normal' END AS print_style,
  l_quantity/8.0::DOUBLE AS gt_mm,
  CASE WHEN l_suppkey%11<>0 THEN l_quantity/8.0::DOUBLE+(l_discount-0.05::DOUBLE)*4.0::DOUBLE END AS raw_mm,
  4.0::DOUBLE+(l_partkey%200)/10.0::DOUBLE AS src_ppmm, (l_suppkey%40)::DOUBLE AS tilt_deg,
  (l_linenumber%5+1)::BIGINT AS n_glyphs,
  (l_linenumber%5+1+CASE WHEN l_quantity%7=0 THEN 1 ELSE 0 END)::INTEGER AS expected_digits,
  [1.0::DOUBLE,0.75::DOUBLE,0.6::DOUBLE,0.5::DOUBLE,0.45::DOUBLE,0.35::DOUBLE][l_suppkey%6+1] AS match_confidence,
  l_extendedprice/200000.0::DOUBLE AS width_ratio,
  CASE l_partkey%4 WHEN 0 THEN 'weight_or_volume' WHEN 1 THEN 'length_area_number' END AS quantity_kind,
  CASE WHEN l_partkey%4<2 THEN l_quantity*20.0::DOUBLE END AS quantity_base,
  (l_orderkey%3)::DOUBLE*0.01::DOUBLE AS band_penalty_mm,
  CASE WHEN l_suppkey%7=0 THEN '1l1' ELSE l_quantity::INTEGER::VARCHAR END AS value_text,
  l_tax, l_linenumber, l_suppkey, l_partkey, l_quantity
FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey"""

CTE["judged0"] = f"""SELECT *, l_linenumber=7 AS informational, width_ratio*raw_mm AS raw_width,
  {table_i('panel_area_cm2', 'print_style')} AS required_mm,
  {advisory('quantity_kind', 'quantity_base', 'panel_area_cm2', 'print_style')} AS advisory_required_mm,
  CASE WHEN n_glyphs<=2 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS inflation,
  CASE WHEN panel_area_cm2 IS NULL OR panel_area_cm2<=0 THEN 'lookup' WHEN tilt_deg>35 THEN 'scale'
       WHEN l_partkey%17=0 THEN 'box' WHEN src_ppmm>0 AND src_ppmm<6 THEN 'resolution'
       WHEN raw_mm IS NULL THEN 'measurement' END AS refusal,
  CASE WHEN l_linenumber=7 THEN 'informational' WHEN expected_digits<>0 AND n_glyphs<>expected_digits THEN 'count'
       WHEN match_confidence<0.5 THEN 'confidence' END AS doubt
FROM meas"""

CTE["judged1"] = """SELECT *, CASE WHEN refusal IS NULL THEN raw_mm END AS measured_mm,
  CASE WHEN refusal IS NULL THEN raw_width END AS median_width_mm,
  0.15645::DOUBLE*inflation+band_penalty_mm AS band, coalesce(refusal, doubt) AS reason_code,
  refusal IS NULL AND NOT informational AS is_judged,
  CASE WHEN refusal IS NULL AND NOT informational AND raw_width>0 AND raw_mm>0 THEN raw_width/raw_mm END AS ratio
FROM judged0"""

CTE["judged"] = f"""SELECT *, CASE WHEN refusal IS NULL THEN band END AS error_band_mm,
  CASE WHEN reason_code IS NOT NULL THEN 'NOT_ASSESSED' ELSE {tier('measured_mm', 'required_mm', 'band')} END AS verdict,
  CASE WHEN is_judged AND advisory_required_mm IS NOT NULL THEN {tier('measured_mm', 'advisory_required_mm', 'band')} END
    AS advisory_verdict,
  CASE WHEN NOT is_judged THEN NULL WHEN ratio IS NULL OR ratio<=0 THEN 'NOT_ASSESSED'
       WHEN regexp_full_match(value_text, '[1ilI]+') THEN 'NOT_ASSESSED'
       WHEN ratio>={HI}::DOUBLE THEN 'PASS' WHEN ratio<={LO}::DOUBLE THEN 'FAIL' ELSE 'BORDERLINE' END AS width_verdict
FROM judged1"""

ORD = ("CASE field WHEN 'manufacturer' THEN 0 WHEN 'commodity_name' THEN 1 WHEN 'net_quantity' THEN 2 "
       "WHEN 'mfg_date' THEN 3 WHEN 'mrp' THEN 4 ELSE 5 END")

CTE["decl"] = f"""SELECT *, {ORD} AS ord, value_text<>'7' AS present, l_suppkey%9<>0 AS assessable, src_ppmm>=6 AS legible,
  CASE WHEN value_text<>'7' THEN 'PASS' WHEN l_suppkey%9=0 THEN 'NOT_ASSESSED' WHEN src_ppmm>=6 THEN 'FAIL'
       ELSE 'NOT_ASSESSED' END AS presence_verdict, value_text<>'7' AS has_height
FROM judged QUALIFY row_number() OVER (PARTITION BY scan_id, field ORDER BY meas_id)=1"""

CTE["packrows"] = "SELECT *, (frame_no%17)::DOUBLE+4.0::DOUBLE AS label_ppmm FROM decl"
CTE["frames"] = ("SELECT DISTINCT pack_id, frame_no, label_ppmm FROM packrows")

CENTS = "floor(p_retailprice*100+0.5)::BIGINT"
CTE["labels0"] = f"""SELECT {KEY5} AS scan_id, l_quantity::INTEGER AS q, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln,
  p_name, p_type, p_size, {CENTS}//100 AS rs, lpad(({CENTS}%100)::VARCHAR,2,'0') AS ps, {CENTS} AS cents,
  lpad(month(l_shipdate)::VARCHAR,2,'0') AS mo, year(l_shipdate)+8 AS yr
FROM lineitem JOIN part ON l_partkey=p_partkey"""
_slots = [
    ("p_name", "true"),
    ("'Common name: '||p_type", "sk%5<>0"),
    ("CASE WHEN pk%6=5 THEN '' ELSE ['Net Qty.','Net Quantity','Net Wt.','Net Weight','NetQuantlty'][pk%6+1]||': ' END"
     "||p_size||' '||['g','kg','ml','L','N','c'][sk%6+1]", "q%9<>0"),
    ("CASE WHEN ln%4=3 THEN '' ELSE ['MRP','M.R.P.','Maximum Retail Price'][ln%4+1]||': ' END||'Rs. '||rs||'.'||ps||"
     "CASE WHEN q%4<>0 THEN ' (inclusive of all taxes)' ELSE '' END", "q%8<>0"),
    ("CASE WHEN pk%5=4 THEN '' ELSE ['Mfg. Date','Packed on','Month & Year of Manufacture','MED'][pk%5+1]||': ' END"
     "||mo||'/'||yr", "q%7<>0"),
    ("'Best Before: '||mo||'/'||(yr+1)", "q%2=0"),
    ("'Special introductory price Rs. '||(rs-100)||'.00 | Rs. 49.80 per 100 g'", "q%3=0"),
    ("'Manufactured by: '||p_name||' Pvt. Ltd.'", "q%6<>0"),
    ("'Plot 14, Industrial Area - '||(pk+400000)", "q%6<>0"),
    ("'Customer Care: 1800 266 '||(1000+pk%8999)", "q%10<>0"),
]
CTE["slots"] = " UNION ALL ".join(f"SELECT scan_id, {i} AS slot, {t} AS text FROM labels0 WHERE {c}"
                                  for i, (t, c) in enumerate(_slots))
CTE["lines"] = """SELECT scan_id, (row_number() OVER (PARTITION BY scan_id ORDER BY slot)-1)::INTEGER AS line_no, text,
  0 AS x, slot*40 AS y, length(text)*10 AS w, 20 AS h FROM slots"""

CTE["legend0"] = """SELECT o_orderkey AS k, floor(o_totalprice*100+0.5)::BIGINT//100 AS price FROM orders"""
CTE["legend1"] = """
SELECT k, 0 AS slot, CASE k%5 WHEN 0 THEN '*MRP Rs (INCL. OF ALL TAXES), USP, B. NO.: SEE BELOW.' WHEN 1 THEN 'MRP: BELOW'
  WHEN 2 THEN 'price overleaf' WHEN 3 THEN 'M.R.P. see overleaf' ELSE 'brand' END AS text FROM legend0
UNION ALL SELECT k, i::INTEGER, 'lot '||i FROM legend0, range(1,9) r(i) WHERE k%3=0 AND i<=k%8+1
UNION ALL SELECT k, 1, 'batch A' FROM legend0 WHERE k%3<>0
UNION ALL SELECT k, 50, CASE k%7 WHEN 0 THEN 'Rs '||price||'/ml' WHEN 1 THEN 'Save '||price||'/-'
  ELSE 'AA * = '||price||'/-, Rs 2.73/ml' END FROM legend0
UNION ALL SELECT k, 60, 'Rs '||price FROM legend0 WHERE k%4=0"""
CTE["legend"] = """SELECT k::VARCHAR AS scan_id, (row_number() OVER (PARTITION BY k ORDER BY slot)-1)::INTEGER AS line_no,
  text FROM legend1"""

CTE["docline"] = """SELECT doc_id, (i-1)::INTEGER AS line_no, ls[i] AS line FROM
  (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls)+1)) u(i)"""
CTE["toks"] = """SELECT doc_id, line_no, (i-1)::INTEGER AS pos, ws[i] AS text FROM
  (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM docline), unnest(range(1, len(ws)+1)) u(i)"""
CTE["words"] = """SELECT * FROM (SELECT doc_id::VARCHAR AS scan_id, doc_id, line_no, pos, line_no*100000+pos AS word_no, text,
  coalesce(sum(length(text)*10+10) OVER (PARTITION BY doc_id, line_no ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS x,
  line_no*40+(pos*(doc_id%5)*(doc_id%5))::DOUBLE*0.5::DOUBLE AS y, length(text)*10 AS w, 20 AS h,
  ((length(text)*7+pos*13+doc_id)%101)::DOUBLE AS conf FROM toks) WHERE text<>''"""
CTE["passes"] = """SELECT scan_id, doc_id, p.pass_no, word_no, text, x+p.pass_no*3 AS x, y+p.pass_no*3 AS y, w, h,
  CASE WHEN p.again=1 THEN (conf+37)%101 ELSE conf END AS conf
FROM (SELECT *, ((pos+doc_id)%4)::INTEGER AS a FROM words), LATERAL (SELECT a AS pass_no, 0 AS again
  UNION ALL SELECT ((a+1)%4)::INTEGER, 1) p"""
CTE["chars"] = """SELECT scan_id, word_no, (i-1)::INTEGER AS i, substr(text, i::INTEGER, 1) AS c, x+(i-1)::INTEGER*10 AS x, y,
  9 AS w, 20 AS h FROM words, unnest(range(1, length(text)+1)) u(i)"""
CTE["rois"] = f"""SELECT doc_id::VARCHAR AS scan_id, f.field, (doc_id*37%500+f.i*100)::INTEGER AS x,
  (doc_id%7*40)::INTEGER AS y, 200 AS w, 30 AS h FROM documents,
  (VALUES (0,'net_quantity'),(1,'mrp'),(2,'mfg_date')) f(i, field)"""

CTE["glyphs"] = f"""SELECT l_orderkey::VARCHAR AS scan_id, {FIELD3.format('l_orderkey')} AS field, {KEY5} AS glyph_no,
  l_linenumber*15 AS x, 5 AS y, (l_suppkey%9+4)::INTEGER AS w,
  (l_linenumber+10+CASE WHEN l_quantity=50 THEN 20 ELSE 0 END)::DOUBLE AS h,
  floor((l_suppkey%9+4)*(l_linenumber+10+CASE WHEN l_quantity=50 THEN 20 ELSE 0 END)::DOUBLE*l_discount*8.0::DOUBLE)::INTEGER
    AS area, 115 AS crop_w, 60 AS crop_h,
  (l_linenumber+10+CASE WHEN l_quantity=50 THEN 20 ELSE 0 END)::DOUBLE+l_tax AS h_subpx FROM lineitem"""
CTE["shaped"] = """SELECT * FROM glyphs WHERE area>=5 AND h>=3 AND x>0 AND y>0 AND x+w<crop_w AND y+h<crop_h
  AND w/greatest(1.0::DOUBLE,h) BETWEEN 0.12::DOUBLE AND 1.7::DOUBLE
  AND area/greatest(1.0::DOUBLE,w*h) BETWEEN 0.12::DOUBLE AND 0.97::DOUBLE"""
CTE["gchars"] = f"""SELECT o_orderkey::VARCHAR AS scan_id, {FIELD3.format('o_orderkey')} AS field,
  CASE WHEN o_orderkey%4=0 THEN 'x' ELSE (i%10)::VARCHAR END AS c, (i*15)::INTEGER AS x, (o_orderkey%9+3)::INTEGER AS w
FROM orders, range(1,8) r(i) WHERE (o_orderkey+i)%3<>0"""
CTE["flagged"] = """SELECT g.*, EXISTS (SELECT 1 FROM gchars d WHERE d.scan_id=g.scan_id AND d.field=g.field
  AND d.c IN ('0','1','2','3','4','5','6','7','8','9') AND floor(g.x+g.w/2.0::DOUBLE)>=d.x
  AND floor(g.x+g.w/2.0::DOUBLE)<d.x+d.w) AS hit FROM shaped g"""
CTE["restricted"] = """SELECT * FROM (SELECT *, (k>=2 OR (k=1 AND n<=2)) AS used_char_boxes FROM (SELECT *,
  count(*) OVER (PARTITION BY scan_id, field) AS n, count(*) FILTER (WHERE hit) OVER (PARTITION BY scan_id, field) AS k
  FROM flagged)) WHERE NOT used_char_boxes OR hit"""
CTE["medians"] = "SELECT scan_id, field, quantile_cont(h, 0.5) AS med FROM restricted GROUP BY ALL"
CTE["kept"] = """SELECT r.* FROM restricted r JOIN medians m ON r.scan_id=m.scan_id AND r.field=m.field
  WHERE abs(r.h-m.med)<=0.25::DOUBLE*m.med+1"""
CTE["samples"] = """SELECT vec_id::VARCHAR AS series_id, ((i-1)//16)::INTEGER AS col, ((i-1)%16)::INTEGER AS pos,
  embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, len(embedding)+1)) u(i)"""

CTE["quads"] = """SELECT *, CASE WHEN k%13=0 THEN NULL ELSE 100.0::DOUBLE END AS x0, 100.0::DOUBLE AS y0,
  CASE WHEN k%31=3 THEN 110.0::DOUBLE ELSE 100.0::DOUBLE+s END AS x1, CASE WHEN k%31=3 THEN 110.0::DOUBLE ELSE 100.0::DOUBLE+a END AS y1,
  CASE WHEN k%31=3 THEN 120.0::DOUBLE ELSE 100.0::DOUBLE+s+b END AS x2, CASE WHEN k%31=3 THEN 120.0::DOUBLE ELSE 100.0::DOUBLE+s END AS y2,
  CASE WHEN k%31=3 THEN 130.0::DOUBLE ELSE 100.0::DOUBLE END AS x3, CASE WHEN k%31=3 THEN 130.0::DOUBLE ELSE 100.0::DOUBLE+s-a END AS y3
FROM (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS scan_id, (s_suppkey%300+200)::DOUBLE AS s, (s_nationkey*2)::DOUBLE AS a,
  (s_suppkey%17)::DOUBLE AS b, CASE WHEN s_suppkey%2=0 THEN 10.0::DOUBLE ELSE 40.0::DOUBLE END AS mm,
  (s_suppkey%11*100+800)::DOUBLE AS img_w, (s_suppkey%7*100+600)::DOUBLE AS img_h,
  CASE WHEN s_suppkey%19=5 THEN (s_suppkey%7+4)::DOUBLE END AS known FROM supplier)"""
CTE["sides"] = """SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS s0, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS s1,
  sqrt((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)) AS s2, sqrt((x0-x3)*(x0-x3)+(y0-y3)*(y0-y3)) AS s3 FROM quads"""
CTE["quadgeo"] = """SELECT *, CASE WHEN x0 IS NOT NULL THEN (s0+s1+s2+s3)/4.0::DOUBLE END AS side_px,
  CASE WHEN x0 IS NOT NULL THEN degrees(acos(least(1.0::DOUBLE, least(s0,s1,s2,s3)/greatest(s0,s1,s2,s3)))) END AS tilt_deg,
  CASE WHEN x0 IS NOT NULL THEN greatest(greatest(s0,s2)/greatest(1e-6::DOUBLE,least(s0,s2)),
    greatest(s1,s3)/greatest(1e-6::DOUBLE,least(s1,s3))) END AS taper FROM sides"""
CTE["homo0"] = """SELECT *, (x1-x2)*(y3-y2)-(x3-x2)*(y1-y2) AS den,
  (x0-x1+x2-x3)*(y3-y2)-(x3-x2)*(y0-y1+y2-y3) AS gn, (x1-x2)*(y0-y1+y2-y3)-(x0-x1+x2-x3)*(y1-y2) AS hn FROM quadgeo"""
CTE["homo"] = """SELECT *, CASE WHEN known>0 THEN known ELSE (x1-x0+g*x1)/mm END AS m0, CASE WHEN known>0 THEN 0 ELSE (x3-x0+hh*x3)/mm END AS m1,
  CASE WHEN known>0 THEN 0 ELSE x0 END AS m2, CASE WHEN known>0 THEN 0 ELSE (y1-y0+g*y1)/mm END AS m3,
  CASE WHEN known>0 THEN known ELSE (y3-y0+hh*y3)/mm END AS m4, CASE WHEN known>0 THEN 0 ELSE y0 END AS m5,
  CASE WHEN known>0 THEN 0 ELSE g/mm END AS m6, CASE WHEN known>0 THEN 0 ELSE hh/mm END AS m7,
  (known>0 OR (x0 IS NOT NULL AND den<>0)) IS TRUE AS has_h
FROM (SELECT *, CASE WHEN den<>0 AND x0 IS NOT NULL THEN gn/den END AS g, CASE WHEN den<>0 AND x0 IS NOT NULL THEN hn/den END AS hh FROM homo0)"""

CTE["hist"] = """SELECT o_orderkey AS k, o_orderkey::VARCHAR AS scan_id, o_orderdate AS ts, CASE o_orderstatus WHEN 'F' THEN 'NON_COMPLIANT'
  WHEN 'O' THEN 'COMPLIANT' ELSE 'REVIEW_REQUIRED' END AS overall, o_custkey%3+1 AS nv,
  CASE WHEN o_orderstatus='F' THEN o_custkey%3+1 ELSE 0 END::INTEGER AS n_violations, 0 AS n_borderline,
  (o_custkey%900)||' g' AS net_quantity, printf('%.2f', o_totalprice) AS mrp, o_orderpriority AS manufacturer,
  NULL::VARCHAR AS officer FROM orders"""
CTE["hviol"] = """SELECT scan_id, ts, ['manufacturer','commodity_name','net_quantity','mfg_date','mrp','consumer_care'][(k+i*2)%6+1]
  AS field FROM hist, range(0,3) r(i) WHERE overall='NON_COMPLIANT' AND i<nv"""

CTE["worst"] = """SELECT scan_id, max(CASE verdict WHEN 'FAIL' THEN 2 WHEN 'PASS' THEN 0 ELSE 1 END) AS wst FROM decl GROUP BY ALL"""
CTE["recs"] = """SELECT d.scan_id::BIGINT AS case_id, ['clean','realistic','realistic','harsh'][d.scan_id::BIGINT%4+1] AS tier,
  ['COMPLIANT','REVIEW_REQUIRED','NON_COMPLIANT'][wst+1] AS overall, d.scan_id::BIGINT%6<>0 AS case_legible,
  d.scan_id::BIGINT%9<>0 AS calib_ok, (d.scan_id::BIGINT%37)::DOUBLE AS case_tilt,
  CASE WHEN d.scan_id::BIGINT%8<>0 THEN (d.scan_id::BIGINT%100-50)::DOUBLE/80.0::DOUBLE END AS planarity_slope,
  CASE WHEN d.scan_id::BIGINT%8<>0 THEN (d.scan_id::BIGINT%73)::DOUBLE/20.0::DOUBLE END AS planarity_spread,
  (d.scan_id::BIGINT*7919%5000)::DOUBLE AS elapsed_ms, d.scan_id::BIGINT%50=7 AS failed,
  d.scan_id::BIGINT%12=0 AS om_name, d.scan_id::BIGINT%12=5 AS om_mrp, field, measured_mm IS NOT NULL AS present_pred,
  gt_mm>0.5 AS present_gt, assessable, CASE WHEN l_linenumber<>3 THEN l_tax<0.06::DOUBLE END AS value_correct,
  presence_verdict, verdict, value_text, reason_code, measured_mm, required_mm, gt_mm, src_ppmm, n_glyphs
FROM decl d JOIN worst w ON d.scan_id=w.scan_id"""
CTE["ok"] = "SELECT *, measured_mm-gt_mm AS e, abs(measured_mm-gt_mm) AS ae FROM recs WHERE NOT failed"
CTE["cases"] = """SELECT case_id, any_value(overall) AS overall, any_value(case_legible) AS legible, any_value(calib_ok) AS calib_ok,
  any_value(planarity_slope) AS planarity_slope, any_value(planarity_spread) AS planarity_spread,
  any_value(elapsed_ms) AS elapsed_ms, any_value(failed) AS failed, any_value(om_name) AS om_name,
  any_value(om_mrp) AS om_mrp FROM recs GROUP BY case_id"""

DEPS = {
    "meas": [], "judged0": ["meas"], "judged1": ["judged0"], "judged": ["judged1"], "decl": ["judged"],
    "packrows": ["decl"], "frames": ["packrows"], "labels0": [], "slots": ["labels0"], "lines": ["slots"],
    "legend0": [], "legend1": ["legend0"], "legend": ["legend1"], "docline": [], "toks": ["docline"],
    "words": ["toks"], "passes": ["words"], "chars": ["words"], "rois": [], "glyphs": [], "shaped": ["glyphs"],
    "gchars": [], "flagged": ["shaped", "gchars"], "restricted": ["flagged"], "medians": ["restricted"],
    "kept": ["restricted", "medians"], "samples": [], "quads": [], "sides": ["quads"], "quadgeo": ["sides"],
    "homo0": ["quadgeo"], "homo": ["homo0"], "hist": [], "hviol": ["hist"], "worst": ["decl"],
    "recs": ["decl", "worst"], "ok": ["recs"], "cases": ["recs"],
}


def add(name: str, deps: list[str], body: str) -> None:
    CTE[name], DEPS[name] = body, deps


def with_(names: str, body: str) -> str:
    """``body`` preceded by the CTEs it needs, in order. Shared ones are computed once."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in order) + "\n" + body
