"""Queries and SQL for layout, declaration extraction and whole reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import fuzzy, geometry, quantity, text as tx
from packaudit.operators import extraction as ex, history as hs, layout
from packaudit.plans import scan_report
from packaudit.operators import presentation as pr
from verification import views as v
from verification.core_queries import REASON, _messages
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


def digest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """One row per key with a hash over its rows in order, so whole results stay checkable."""
    text = F.concat_ws("~", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("_t")))),
                                       lambda r: r["_t"]), "|")).alias("hash"))


def digest_sql(keys: str, order: str, cols: list[str], src: str) -> str:
    text = "concat_ws('~', " + ", ".join(f"coalesce(({c})::VARCHAR,'-')" for c in cols) + ")"
    return f"SELECT {keys}, count(*) AS n, md5(string_agg({text}, '|' ORDER BY {order})) AS hash FROM {src} GROUP BY {keys}"


# -------------------------------------------------------------------------- layout
@query("p1_normalize_key", """SELECT doc_id, md5(replace(upper(regexp_replace(text,'[^\\p{L}\\p{N}]+','','g')),'ẞ','SS')) AS norm_md5,
  length(regexp_replace(text,'[^\\p{L}\\p{N}]+','','g')) AS n_kept FROM documents""")
def p1(spark, sf):
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(tx.normalize_key(F.col("text"))).alias("norm_md5"),
                    F.size(tx.norm_positions(F.col("text"))).cast("bigint").alias("n_kept"))


@query("p1_norm_positions", """SELECT doc_id, sum(CASE WHEN regexp_matches(cs[i],'[\\p{L}\\p{N}]') THEN i-1 ELSE 0 END)::BIGINT AS pos_sum,
  max(CASE WHEN regexp_matches(cs[i],'[\\p{L}\\p{N}]') THEN i-1 END)::INTEGER AS last_pos
  FROM (SELECT doc_id, string_split(text,'') AS cs FROM documents), unnest(range(1,len(cs)+1)) u(i) GROUP BY doc_id""")
def p1p(spark, sf):
    pos = tx.norm_positions(F.col("text"))
    return v.table(spark, sf, "documents").select("doc_id", F.explode(pos).alias("p")).groupBy("doc_id").agg(
        F.sum(F.col("p").cast("bigint")).alias("pos_sum"), F.max("p").alias("last_pos"))


# One fold per scan over its words from the top: the open line's number of words and sum of centres, and where lines began.
# All these words have one height, so the line's median is that height.
add("folded", ["words"], """SELECT scan_id, ws, list_reduce(ws[2:], lambda a, c: CASE WHEN abs(c.cy-a.t/a.n)<0.6::DOUBLE*20
    THEN {'n': a.n+1, 't': a.t+c.cy, 's': a.s} ELSE {'n': 1, 't': c.cy, 's': list_append(a.s, c.i)} END, {'n': 1, 't': ws[1].cy, 's': [1::BIGINT]}).s AS starts
  FROM (SELECT scan_id, list({'i': i, 'cy': cy, 'word_no': word_no} ORDER BY i) AS ws FROM (SELECT scan_id, word_no, y+10.0::DOUBLE AS cy,
    row_number() OVER (PARTITION BY scan_id ORDER BY y, word_no) AS i FROM words) GROUP BY scan_id)""")
add("lined", ["folded", "words"], """SELECT w.*, f.g FROM words w JOIN (SELECT scan_id, u.e.word_no AS word_no, max(u.g) AS g FROM (
  SELECT scan_id, unnest(list_transform(ws, lambda e: {'e': e, 'g': len(list_filter(starts, lambda x: x<=e.i))})) AS u FROM folded) GROUP BY ALL) f
  USING (scan_id, word_no)""")
add("linedruns", ["lined"], """SELECT *, sum(cut) OVER (PARTITION BY scan_id, g ORDER BY x, y, word_no) AS run FROM (SELECT *,
  CASE WHEN x-lag(x+w) OVER (PARTITION BY scan_id, g ORDER BY x, y, word_no) > 6*20 THEN 1 ELSE 0 END AS cut FROM lined)""")


@query("p2_rebuild_lines", with_("linedruns", f"""SELECT scan_id, (row_number() OVER (PARTITION BY scan_id ORDER BY y, x, g, run)-1)::INTEGER AS line_no, md5(text) AS text_md5,
  {r6('x')} AS x, {r6('y')} AS y, n::INTEGER AS n_words FROM (SELECT scan_id, g, run, string_agg(text, ' ' ORDER BY x, y, word_no) AS text,
  min(x) AS x, min(y) AS y, count(*) AS n FROM linedruns GROUP BY ALL)"""))
def p2(spark, sf):
    return layout.rebuild_lines(v.words(spark, sf)).select(
        "scan_id", "line_no", F.md5("text").alias("text_md5"), v.r6("x").alias("x"), v.r6("y").alias("y"), F.size("words").alias("n_words"))


add("upright", ["words"], "SELECT * FROM words WHERE doc_id%5=0")
add("runs", ["words"], """SELECT *, sum(cut) OVER (PARTITION BY scan_id, line_no ORDER BY x, pos) AS run FROM (SELECT *,
  CASE WHEN x-lag(x+w) OVER (PARTITION BY scan_id, line_no ORDER BY x, pos) > 6*20 THEN 1 ELSE 0 END AS cut
  FROM (SELECT * REPLACE (x+CASE WHEN pos>=4 THEN (doc_id%3)*100 ELSE 0 END AS x) FROM words))""")


def _grouped(spark, sf) -> DataFrame:
    """Words whose line is known, with a wide gap before the fifth word of some documents."""
    w = v.words(spark, sf)
    gap = F.when(F.col("pos") >= 4, (F.col("doc_id") % 3 * 100).cast("int")).otherwise(0)
    return w.select("scan_id", F.lit(0).alias("band"), F.col("line_no").alias("grp"), "word_no", "pos", "text",
                    (F.col("x") + gap).alias("x"), (F.col("line_no") * 40).alias("y"), "w", "h", "conf",
                    (F.col("y") + 10.0).alias("cy"))


@query("p3_split_columns", with_("runs", "SELECT scan_id, line_no AS grp, run::BIGINT AS run, count(*) AS n, min(x) AS x FROM runs GROUP BY ALL"))
def p3(spark, sf):
    return layout.split_columns(_grouped(spark, sf)).groupBy("scan_id", "grp", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x"))


@query("p4_line_spans", with_("runs", """SELECT scan_id, (row_number() OVER (PARTITION BY scan_id ORDER BY line_no, x)-1)::INTEGER AS line_no,
  md5(text) AS text_md5, x, y, w, h FROM (SELECT scan_id, line_no, run, string_agg(text,' ' ORDER BY x, pos) AS text, min(x) AS x, line_no*40 AS y,
  max(x+w)-min(x) AS w, 20 AS h FROM runs GROUP BY ALL)"""))
def p4(spark, sf):
    out = layout.line_spans(layout.split_columns(_grouped(spark, sf)))
    return out.select("scan_id", "line_no", F.md5("text").alias("text_md5"), "x", "y", "w", "h")


@query("p5_words_for_span", with_("toks", """, s AS (SELECT doc_id, line_no, text, coalesce(sum(length(text)+1) OVER (PARTITION BY doc_id, line_no ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS a FROM toks WHERE text<>'')
SELECT doc_id::VARCHAR AS scan_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM s WHERE a<30 AND a+length(text)>10 GROUP BY doc_id""").replace("\n, s AS", ",\n s AS"))
def p5(spark, sf):
    # Each line keeps its words in print order; the span is characters 10 to 30.
    w = v.words(spark, sf)
    lines = layout.line_spans(w.select(
        "scan_id", F.lit(0).alias("band"), F.col("line_no").alias("grp"), F.lit(0).alias("run"), "word_no", "text",
        F.col("pos").alias("x"), (F.col("line_no") * 40).alias("y"), F.lit(1).alias("w"), "h", "conf", F.lit(0.0).alias("cy")))
    hit = F.explode(layout.words_for_span(F.col("words"), F.lit(10), F.lit(30)))
    return lines.select("scan_id", hit.alias("v")).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("v.text")).alias("chars"))


@query("p6_bbox", with_("words", f"""SELECT scan_id, min(x) AS x, {r6('min(y)')} AS y, max(x+w)-min(x) AS w, {r6('max(y+h)-min(y)')} AS h FROM words GROUP BY scan_id"""))
def p6(spark, sf):
    return v.flat(v.words(spark, sf).groupBy("scan_id").agg(*layout.bbox_agg()))


@query("p7_offset_boxes", with_("words", f"SELECT scan_id, sum(x+17)::BIGINT AS sx, {r6('sum(y-4)')} AS sy FROM words GROUP BY scan_id"))
def p7(spark, sf):
    return v.flat(layout.offset_boxes(v.words(spark, sf), F.lit(17), F.lit(-4)).groupBy("scan_id").agg(
        F.sum("x").alias("sx"), F.sum("y").alias("sy")))


add("passrows", ["passes"], "SELECT * REPLACE (CASE WHEN doc_id%6=0 THEN conf*0.65::DOUBLE ELSE conf END AS conf) FROM passes")
add("scores", ["passrows"], """SELECT scan_id, pass_no, CASE WHEN max(hi) OVER (PARTITION BY scan_id)=0 THEN lo ELSE hi END AS score FROM (
  SELECT scan_id, pass_no, coalesce(sum(length(text)) FILTER (WHERE conf>=70 AND length(text)>=3),0) AS hi,
  coalesce(sum(length(text)) FILTER (WHERE conf>=50 AND length(text)>=3),0) AS lo FROM passrows GROUP BY ALL)""")
add("wide", ["scores"], """SELECT scan_id, max(score) FILTER (WHERE pass_no=0) AS s0, max(score) FILTER (WHERE pass_no=1) AS s1,
  max(score) FILTER (WHERE pass_no=2) AS s2, max(score) FILTER (WHERE pass_no=3) AS s3 FROM scores GROUP BY scan_id""")
add("primary1", ["wide"], """SELECT scan_id, p3.p AS primary_pass FROM wide, LATERAL (SELECT CASE WHEN s0 IS NULL THEN NULL ELSE 0 END AS p, s0 AS s) p0,
  LATERAL (SELECT CASE WHEN s1 IS NOT NULL AND (p0.s IS NULL OR s1>p0.s*1.08::DOUBLE) THEN 1 ELSE p0.p END AS p,
    CASE WHEN s1 IS NOT NULL AND (p0.s IS NULL OR s1>p0.s*1.08::DOUBLE) THEN s1 ELSE p0.s END AS s) p1,
  LATERAL (SELECT CASE WHEN s2 IS NOT NULL AND (p1.s IS NULL OR s2>p1.s*1.08::DOUBLE) THEN 2 ELSE p1.p END AS p,
    CASE WHEN s2 IS NOT NULL AND (p1.s IS NULL OR s2>p1.s*1.08::DOUBLE) THEN s2 ELSE p1.s END AS s) p2,
  LATERAL (SELECT CASE WHEN s3 IS NOT NULL AND (p2.s IS NULL OR s3>p2.s*1.08::DOUBLE) THEN 3 ELSE p2.p END AS p) p3""")


def _passes(spark, sf) -> DataFrame:
    p = v.passes(spark, sf)
    return p.withColumn("conf", F.when(F.col("scan_id").cast("bigint") % 6 == 0, F.col("conf") * 0.65).otherwise(F.col("conf")))


@query("p8_score_passes", with_("scores", "SELECT scan_id, pass_no, score::BIGINT AS score FROM scores"))
def p8(spark, sf):
    return layout.score_passes(_passes(spark, sf))


@query("p9_pick_pass", with_("primary1", "SELECT scan_id, primary_pass::INTEGER AS primary_pass FROM primary1"))
def p9(spark, sf):
    return layout.pick_pass(layout.score_passes(_passes(spark, sf))).select("scan_id", "primary_pass")


_OVER = """SELECT 1 FROM passrows b WHERE b.scan_id=c.scan_id AND b.pass_no=c.primary_pass AND least(c.x+c.w,b.x+b.w)>greatest(c.x,b.x)
 AND least(c.y+c.h,b.y+b.h)>greatest(c.y,b.y) AND ((least(c.x+c.w,b.x+b.w)-greatest(c.x,b.x))*(least(c.y+c.h,b.y+b.h)-greatest(c.y,b.y))
 >=0.6::DOUBLE*greatest(1,c.w*c.h) OR (least(c.x+c.w,b.x+b.w)-greatest(c.x,b.x))*(least(c.y+c.h,b.y+b.h)-greatest(c.y,b.y))
 /(c.w*c.h+b.w*b.h-(least(c.x+c.w,b.x+b.w)-greatest(c.x,b.x))*(least(c.y+c.h,b.y+b.h)-greatest(c.y,b.y)))>=0.3::DOUBLE)"""


@query("p10_merge_candidates", with_("passrows primary1", f""", c AS (SELECT p.*, primary_pass FROM passrows p JOIN primary1 USING (scan_id)
  WHERE p.pass_no<>primary_pass AND conf>=60)
SELECT scan_id, pass_no, count(*) AS n, sum(word_no)::BIGINT AS words FROM c WHERE NOT EXISTS ({_OVER}) GROUP BY ALL""").replace("\n, c AS", ",\n c AS"))
def p10(spark, sf):
    p = _passes(spark, sf)
    primary = layout.pick_pass(layout.score_passes(p))
    return layout.merge_candidates(p, primary).groupBy("scan_id", "pass_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum("word_no").alias("words"))


# One fold per scan over the candidates in pass and word order: those kept so far.
add("cands", ["passrows", "primary1"], f"""SELECT scan_id, pass_no, word_no, x, y, w, h FROM (SELECT p.*, primary_pass FROM passrows p JOIN primary1 USING (scan_id)
  WHERE p.pass_no<>primary_pass AND conf>=60) c WHERE NOT EXISTS ({_OVER})""")
_IW, _IH = "(least(c.x+c.w,k.x+k.w)-greatest(c.x,k.x))", "(least(c.y+c.h,k.y+k.h)-greatest(c.y,k.y))"
add("admitted", ["cands"], f"""SELECT scan_id, unnest(list_reduce(cs[2:], lambda a, c: CASE WHEN len(list_filter(a, lambda k: {_IW}>0 AND {_IH}>0
    AND ({_IW}*{_IH}>=0.6::DOUBLE*greatest(1,c.w*c.h) OR {_IW}*{_IH}/(c.w*c.h+k.w*k.h-{_IW}*{_IH})>=0.3::DOUBLE)))>0 THEN a ELSE list_append(a, c) END, cs[1:1])) AS k
  FROM (SELECT scan_id, list({{'pass_no': pass_no, 'word_no': word_no, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY pass_no, word_no) AS cs FROM cands GROUP BY scan_id)""")


@query("p10_merge_passes", with_("admitted", """SELECT scan_id, pass_no, count(*) AS n, sum(word_no)::BIGINT AS words FROM (
  SELECT scan_id, pass_no, word_no FROM passrows JOIN primary1 USING (scan_id) WHERE pass_no=primary_pass
  UNION ALL SELECT scan_id, k.pass_no, k.word_no FROM admitted) GROUP BY ALL"""))
def p10m(spark, sf):
    return layout.merge_passes(_passes(spark, sf)).groupBy("scan_id", "pass_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum("word_no").alias("words"))


@query("p11_iou", with_("words", f""", o AS (SELECT *, greatest(0,least(x+w,x2+w2)-greatest(x,x2))*greatest(0,least(y+h,y2+h2)-greatest(y,y2)) AS i FROM
  (SELECT scan_id, x, y, w, h, x+word_no%50-25 AS x2, y+word_no%9 AS y2, w+10 AS w2, 18 AS h2 FROM words))
SELECT scan_id, {r6('sum(CASE WHEN i>0 THEN i/(w*h+w2*h2-i) ELSE 0 END)')} AS iou, {r6('sum(i/greatest(1,w*h))')} AS covered FROM o GROUP BY scan_id""").replace("\n, o AS", ",\n o AS"))
def p11(spark, sf):
    w, n = v.words(spark, sf), F.col("word_no")
    a = {c: F.col(c) for c in ("x", "y", "w", "h")}
    b = {"x": F.col("x") + n % 50 - 25, "y": F.col("y") + n % 9, "w": F.col("w") + 10, "h": F.lit(18)}
    return v.flat(w.groupBy("scan_id").agg(F.sum(geometry.iou(a, b)).alias("iou"), F.sum(geometry.covered(a, b)).alias("covered")))


@query("p12_mean_conf", with_("words", f"""SELECT doc_id::VARCHAR AS scan_id, {r6('coalesce(c,0)')} AS mean_conf FROM documents
  LEFT JOIN (SELECT scan_id, avg(conf) AS c FROM words GROUP BY scan_id) ON scan_id=doc_id::VARCHAR"""))
def p12(spark, sf):
    return v.flat(layout.mean_conf(v.doc_scans(spark, sf), v.words(spark, sf)))


@query("p13_choose_scale", with_("meas", f"""SELECT meas_id, {r6('''CASE WHEN s<=0 THEN 1 WHEN least(greatest(28/s,1),5)<1.05::DOUBLE THEN 1
  ELSE least(greatest(28/s,1),5) END''')} AS scale FROM (SELECT meas_id, src_ppmm*3-15 AS s FROM meas)"""))
def p13(spark, sf):
    return v.flat(v.measurements(spark, sf).select("meas_id", geometry.choose_scale(F.col("src_ppmm") * 3 - 15).alias("scale")))


@query("p14_chars_in_roi", with_("chars rois", """SELECT c.scan_id, r.field, count(*) AS n, md5(string_agg(c.c, '' ORDER BY word_no, i)) AS hash FROM chars c JOIN rois r
  ON c.scan_id=r.scan_id AND c.x<r.x+r.w AND c.x+c.w>r.x AND c.y<r.y+r.h AND c.y+c.h>r.y GROUP BY ALL"""))
def p14(spark, sf):
    hit = layout.chars_in_roi(v.chars(spark, sf), v.rois(spark, sf))
    return hit.groupBy("scan_id", "field").agg(
        F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct("word_no", "i", "c"))), lambda r: r["c"]), "")).alias("hash"))


@query("p17_text_helpers", """SELECT doc_id, md5(trim(regexp_replace(lower(text),'[\\s]+',' ','g'))) AS folded, left(text,180) AS head,
  CASE WHEN length(t)<=34 THEN t ELSE left(t,33)||'…' END AS clipped FROM (SELECT *, trim(regexp_replace(text,'[\\s]+',' ','g')) AS t FROM documents)""")
def p17(spark, sf):
    t = F.col("text")
    return v.table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.fold_ws(t)).alias("folded"), F.left(t, F.lit(180)).alias("head"), tx.clip(t, 34).alias("clipped"))


# ---------------------------------------------------------------------- extraction
def _ctx_cte(src: str, out: str) -> None:
    add(out + "0", [src], f"""SELECT *, upper(regexp_replace(text,'[^\\p{{L}}\\p{{N}}]+','','g')) AS norm, 
  lead(text) OVER w AS t1, lead(text,2) OVER w AS t2, lead(y) OVER w AS ny1, lead(y,2) OVER w AS ny2, lead(x) OVER w AS nx1, lead(x,2) OVER w AS nx2,
  lead(w) OVER w AS nw1, lead(w,2) OVER w AS nw2, lead(h) OVER w AS nh1, lead(h,2) OVER w AS nh2,
  lag(text) OVER w AS b1, lag(text,2) OVER w AS b2, lag(text,3) OVER w AS b3, lead(text,3) OVER w AS t3 FROM {src}
  WINDOW w AS (PARTITION BY scan_id ORDER BY line_no)""")
    add(out + "1", [out + "0"], f"""SELECT *, (t1 IS NOT NULL AND ny1-(y+h)<=1.6::DOUBLE*greatest(h,nh1) AND nx1<=x+w AND nx1+nw1>=x) AS w1 FROM {out}0""")
    add(out + "2", [out + "1"], f"""SELECT *, (w1 AND t2 IS NOT NULL AND ny2-(ny1+nh1)<=1.6::DOUBLE*greatest(nh1,nh2) AND nx2<=x+w AND nx2+nw2>=x) AS w2 FROM {out}1""")
    add(out, [out + "2"], f"""SELECT *, upper(regexp_replace(wtext,'[^\\p{{L}}\\p{{N}}]+','','g')) AS wnorm FROM (SELECT scan_id, line_no, text, norm, w1, w2,
  text||CASE WHEN w1 THEN ' '||t1 ELSE '' END||CASE WHEN w2 THEN ' '||t2 ELSE '' END AS wtext,
  concat_ws(' ', b2, b1, text, t1, t2) AS near2, concat_ws(' ', b3, b2, b1, text, t1, t2, t3) AS near3 FROM {out}2)""")


_ctx_cte("lines", "ctx")
add("legendbox", ["legend"], "SELECT *, 0 AS x, line_no*40 AS y, length(text)*10 AS w, 20 AS h FROM legend")
_ctx_cte("legendbox", "lctx")


def key_end(field: str) -> str:
    parts = []
    for p in dims.KEY_PHRASES[field]:
        parts.append(f"WHEN strpos(wnorm,'{p}') BETWEEN 1 AND length(norm) THEN strpos(wnorm,'{p}')-1+{len(p)}")
    return "CASE " + " ".join(parts) + " END"


def negative(norm: str, field: str) -> str:
    parts = [f"nullif(strpos({norm},'{p}'),0)-1" for p in dims.NEGATIVE_PHRASES[field]]
    parts += [f"CASE WHEN {norm} LIKE '%{p}' THEN length({norm})-{len(p)} END" for p in dims.NEGATIVE_TAIL.get(field, [])]
    return f"least({', '.join(parts)})"


POS = "list_filter(range(1,length(wtext)+1), lambda i: regexp_matches(substr(wtext,i::INTEGER,1),'[\\p{L}\\p{N}]'))"


def _keyed_cte(ctx: str, out: str) -> None:
    ends = ", ".join(f"{key_end(f)} AS e_{f}" for f in dims.KEY_PHRASES)
    add(out, [ctx], f"""SELECT *, {ends}, {negative('wnorm', 'mrp')} AS wneg_mrp, {negative('wnorm', 'mfg_date')} AS wneg_mfg,
  {negative('norm', 'mrp')} AS neg_mrp, {negative('norm', 'mfg_date')} AS neg_mfg, {negative('norm', 'net_quantity')} AS neg_qty FROM {ctx}""")
    # Price after its key: first digits in the allowed part, re-read from the raw text.
    add(out + "_price", [out], f"""SELECT *, regexp_extract(substr(wtext, a::INTEGER, 12), '[0-9]{{1,6}}([.,][0-9]{{1,2}})?') AS val FROM (
  SELECT *, {POS}[e_mrp+strpos(region, regexp_extract(region,'[0-9]'))] AS a FROM (SELECT *, CASE WHEN wneg_mrp>=e_mrp THEN substr(wnorm, e_mrp+1, wneg_mrp-e_mrp)
  ELSE substr(wnorm, e_mrp+1) END AS region FROM {out} WHERE e_mrp IS NOT NULL AND NOT coalesce(wneg_mrp<e_mrp,false)) WHERE regexp_matches(region,'[0-9]'))""")
    add(out + "_cur", [out], f"""SELECT *, regexp_extract(wtext, '(RS|INR|R5)\\s*\\.?\\s*([0-9]{{1,6}}([.,][0-9]{{1,2}})?)', 2, 'i') AS val FROM {out}
  WHERE neg_mrp IS NULL AND regexp_matches(text, '(RS|INR|R5)\\s*\\.?\\s*[0-9]', 'i')""")
    add(out + "_slash", [out], f"""SELECT *, regexp_extract(text, '([0-9]{{1,6}}([.,][0-9]{{1,2}})?)\\s*/\\s*[-=<>~_]', 1) AS val FROM {out}
  WHERE regexp_matches(text, '[0-9]\\s*/\\s*[-=<>~_]')""")


_keyed_cte("ctx", "keyed")
_keyed_cte("lctx", "lkeyed")


def _ctx(spark, sf) -> DataFrame:
    return ex.line_context(v.lines(spark, sf))


def _keyed(spark, sf) -> DataFrame:
    return ex.match_keys(_ctx(spark, sf), use_fuzzy=False)


def _stage(spark, sf, field: str, stage: str, lines=None, use_fuzzy: bool = False) -> DataFrame:
    c = ex.candidates((lines or v.lines)(spark, sf), use_fuzzy, fields=[field], only=stage)
    return c.select("scan_id", "key_line", "hit.*")


@query("f1_line_windows", with_("ctx", digest_sql("scan_id", "line_no", ["line_no", "wtext", "wnorm"], "ctx")))
def f1(spark, sf):
    return digest(_ctx(spark, sf), ["scan_id"], ["line_no"], ["line_no", "wtext", "wnorm"])


@query("f2_neighbourhood", with_("ctx", digest_sql("scan_id", "line_no", ["near3"], "ctx")))
def f2(spark, sf):
    return digest(ex.neighbourhood(v.lines(spark, sf), 3), ["scan_id"], ["line_no"], ["around"])


@query("f3_match_key", with_("keyed", " UNION ALL ".join(
    f"SELECT '{f}' AS field, e_{f} AS key_end, count(*) AS n, sum(hash(scan_id||line_no)%1000003)::BIGINT AS s FROM keyed WHERE e_{f} IS NOT NULL GROUP BY ALL"
    for f in dims.KEY_PHRASES)).replace("sum(hash(scan_id||line_no)%1000003)::BIGINT", "sum(line_no*length(scan_id))::BIGINT"))
def f3(spark, sf):
    k = _keyed(spark, sf)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"key_{f}.end").alias("key_end")) for f in dims.KEY_PHRASES])
    return k.select("scan_id", "line_no", F.explode(rows).alias("r")).where(F.col("r.key_end").isNotNull()).groupBy(
        F.col("r.field").alias("field"), F.col("r.key_end").cast("bigint").alias("key_end")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("line_no") * F.length("scan_id")).cast("bigint").alias("s"))


@query("f3_match_key_fuzzy")
def f3z(spark, sf):
    k = ex.match_keys(_ctx(spark, sf), use_fuzzy=True)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"key_{f}.conf").alias("conf")) for f in dims.KEY_PHRASES])
    return k.select(F.explode(rows).alias("r")).where(F.col("r.conf").isNotNull()).groupBy("r.field", "r.conf").agg(
        F.count(F.lit(1)).alias("n"))


@query("f4_fuzzy_contains")
def f4(spark, sf):
    norm = tx.normalize_key(F.col("text"))
    tokens = [t for ts in dims.FUZZY_PHRASES.values() for t in ts]
    rows = v.lines(spark, sf).select("text").distinct().withColumn("norm", norm)
    flagged = rows.withColumn("fields", fuzzy.fuzzy_fields(F.when(fuzzy.may_contain(F.col("norm"), tokens), F.col("norm"))))
    return flagged.groupBy("fields").agg(F.count(F.lit(1)).alias("n"))


@query("f5_negative_cut", with_("keyed", digest_sql("scan_id", "line_no", [
    "coalesce(wneg_mrp<coalesce(e_mrp,0),false)", "CASE WHEN wneg_mrp>=coalesce(e_mrp,0) THEN wneg_mrp END",
    "coalesce(wneg_mfg<coalesce(e_mfg_date,0),false)", "CASE WHEN wneg_mfg>=coalesce(e_mfg_date,0) THEN wneg_mfg END"], "keyed")))
def f5(spark, sf):
    k = _keyed(spark, sf)
    cuts = [(f, ex.negative_cut(F.col("wnorm"), F.coalesce(F.col(f"key_{f}.end"), F.lit(0)), f)) for f in ("mrp", "mfg_date")]
    k = k.select("scan_id", "line_no", *[c.alias(f) for f, c in cuts])
    flat = k.select("scan_id", "line_no", *[F.col(f"{f}.{p}").alias(f"{f}_{p}") for f, _ in cuts for p in ("blocked", "cut")])
    return digest(flat, ["scan_id"], ["line_no"], ["mrp_blocked", "mrp_cut", "mfg_date_blocked", "mfg_date_cut"])


_PRICE = "replace(val,',','.')::DOUBLE AS price"


@query("f6_mrp_keyed", with_("keyed_price", f"SELECT scan_id, line_no AS key_line, val AS value_text, {_PRICE} FROM keyed_price"))
def f6(spark, sf):
    return _stage(spark, sf, "mrp", "keyed").select("scan_id", "key_line", "value_text", "price")


@query("f7_mrp_currency", with_("keyed_cur", f"SELECT scan_id, line_no AS key_line, val AS value_text, {_PRICE} FROM keyed_cur"))
def f7(spark, sf):
    return _stage(spark, sf, "mrp", "currency").select("scan_id", "key_line", "value_text", "price")


@query("f8_mrp_slash", with_("lkeyed_slash", f"SELECT scan_id, line_no AS key_line, val AS value_text, {_PRICE} FROM lkeyed_slash WHERE neg_mrp IS NULL"))
def f8(spark, sf):
    return _stage(spark, sf, "mrp", "slash", v.legend_lines).select("scan_id", "key_line", "value_text", "price")


add("lhits", ["lkeyed", "lkeyed_slash"], """SELECT k.scan_id, k.line_no AS key_line, s.line_no AS line_no, s.val FROM lkeyed k JOIN lkeyed_slash s
  ON k.scan_id=s.scan_id AND s.line_no BETWEEN k.line_no+1 AND k.line_no+6
  WHERE regexp_matches(k.norm,'MRP|MAXIMUMRETAILPRICE|MAXRETAILPRICE|RETAILSALEPRICE|MAXIMUMPRICE') AND regexp_matches(k.norm,'BELOW|OVERLEAF')
  QUALIFY row_number() OVER (PARTITION BY k.scan_id, k.line_no ORDER BY s.line_no)=1""")


@query("f9_mrp_legend", with_("lhits", "SELECT scan_id, key_line, line_no, val AS value_text FROM lhits"))
def f9(spark, sf):
    return _stage(spark, sf, "mrp", "legend", v.legend_lines).select("scan_id", "key_line", "line_no", "value_text")


@query("f10_tax_phrase", with_("ctx", """SELECT scan_id, count(*) FILTER (WHERE regexp_matches(wnorm,'INCLUSIVEOFALLTAXES|INCLOFALLTAXES|INCLALLTAXES|INCOFALLTAXES')) AS in_window,
  count(*) FILTER (WHERE near2 ILIKE '%inclusive of all taxes%') AS nearby FROM ctx GROUP BY scan_id"""))
def f10(spark, sf):
    c = _ctx(spark, sf)
    return c.groupBy("scan_id").agg(
        F.count(F.when(ex.has_tax_phrase(F.col("wnorm")), 1)).alias("in_window"),
        F.count(F.when(ex.has_tax_phrase(tx.normalize_key(F.col("near2"))), 1)).alias("nearby"))


def _cascade(keyed: str, legend: str) -> str:
    return f""", st AS (SELECT scan_id, 1 AS stage, line_no AS kl, val, 1.0::DOUBLE AS conf FROM {keyed}_price UNION ALL
SELECT scan_id, 2, line_no, val, 0.45::DOUBLE FROM {keyed}_cur UNION ALL SELECT scan_id, 3, line_no, val, 0.6::DOUBLE FROM {keyed}_slash WHERE neg_mrp IS NULL),
b AS (SELECT scan_id, val, conf FROM st QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY stage, kl)=1),
l AS ({legend})
SELECT coalesce(b.scan_id, l.scan_id) AS scan_id, CASE WHEN l.scan_id IS NOT NULL AND coalesce(b.conf,0)<0.5 THEN l.val ELSE b.val END AS value_text,
  CASE WHEN l.scan_id IS NOT NULL AND coalesce(b.conf,0)<0.5 THEN 0.75::DOUBLE ELSE b.conf END AS match_confidence
FROM b FULL JOIN l ON b.scan_id=l.scan_id"""


_LEG = "SELECT scan_id, val FROM lhits QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY key_line)=1"


def _best(spark, sf, field: str, lines=None) -> DataFrame:
    c = ex.candidates((lines or v.lines)(spark, sf), False, fields=[field])
    return ex.best_hit(c).select("scan_id", "hit.value_text", "hit.match_confidence", "hit.line_no", "hit.note")


@query("f11_mrp_cascade", with_("keyed_price keyed_cur keyed_slash", _cascade("keyed", "SELECT scan_id, text AS val FROM lines WHERE false"))
       .replace("\n, st AS", ",\n st AS"))
def f11(spark, sf):
    return _best(spark, sf, "mrp").select("scan_id", "value_text", "match_confidence")


@query("f11_mrp_cascade_legend", with_("lkeyed_price lkeyed_cur lkeyed_slash lhits", _cascade("lkeyed", _LEG)).replace("\n, st AS", ",\n st AS"))
def f11l(spark, sf):
    return _best(spark, sf, "mrp", v.legend_lines).select("scan_id", "value_text", "match_confidence")


_UNITS = "mg|kgs|kg|kilogram|gms|gm|grams|gram|g|mls|ml|millilitre|cl|ltrs|ltr|litre|liter|lt|l|mm|cm|m|nos|no|pcs|pieces|piece|units|u|n|pages|page|sheets|sheet|leaves|leaf"
_STRICT = f"(?:[0-9]{{1,3}}\\s*[xX×]\\s*)?[0-9]{{1,6}}(?:[.,][0-9]{{1,3}})?\\s*(?:{_UNITS})\\b"
_LOOSE = "(?:[0-9]{1,3}\\s*[xX×]\\s*)?[0-9]{1,6}(?:[.,][0-9]{1,3})?\\s*[A-Za-z¢|]{1,4}(?:[^A-Za-z]|$)"
_WV = "^(?:mg|kgs?|kilogram|gms?|grams?|g|mls?|millilitre|cl|ltrs?|litre|liter|lt|l)$"


def _qty_sql(text: str, repair: str) -> str:
    """SQL for the raw text of the preferred quantity."""
    unit = "lower(regexp_extract(m,'([A-Za-z]+)$',1))"
    lunit = "lower(regexp_extract(m,'([A-Za-z¢|]{1,4})[^A-Za-z]?$',1))"
    fixes = "|".join(k for k in dims.UNIT_CONFUSIONS if k not in ("|",))
    strict = f"regexp_extract_all({text},'{_STRICT}',0,'i')"
    loose = (f"list_filter(regexp_extract_all({text},'{_LOOSE}',0), lambda m: regexp_full_match({lunit},'{fixes}|\\|'))")
    rev = f"nullif(regexp_extract({text},'\\b(?:{'|'.join(dims.REVERSED_UNITS)})\\b\\s*[:\\-]?\\s*[0-9]{{1,6}}\\b',0,'i'),'')"
    return (f"coalesce(list_filter({strict}, lambda m: regexp_matches({unit},'{_WV}'))[1], {strict}[1], {rev}, "
            f"CASE WHEN {repair} THEN trim(regexp_extract({loose}[1],'^(.*?[A-Za-z¢|])[^A-Za-z¢|]?$',1)) END)")


@query("f12_net_quantity", with_("keyed", f"""SELECT scan_id, line_no AS key_line, q AS value_text, CASE WHEN e_net_quantity IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS match_confidence
  FROM (SELECT *, {_qty_sql('st', 'e_net_quantity IS NOT NULL')} AS q FROM (SELECT *, CASE WHEN e_net_quantity IS NOT NULL THEN wtext ELSE text END AS st FROM keyed
  WHERE e_net_quantity IS NOT NULL OR (neg_mrp IS NULL AND neg_qty IS NULL))) WHERE q IS NOT NULL"""))
def f12(spark, sf):
    return _stage(spark, sf, "net_quantity", "keyed").select("scan_id", "key_line", "value_text", "match_confidence")


add("mfgk", ["keyed"], f"""SELECT scan_id, line_no, regexp_extract(region,'(0?[1-9]|1[0-2])[/\\-.](20[0-9][0-9]|[0-9][0-9])',0) AS val FROM (
  SELECT *, CASE WHEN wneg_mfg>=e_mfg_date THEN substr(wtext,a::INTEGER,(c-a)::INTEGER) ELSE substr(wtext,a::INTEGER) END AS region FROM (SELECT *,
  coalesce(ps[e_mfg_date+1],1) AS a, ps[wneg_mfg+1] AS c FROM (SELECT *, {POS} AS ps FROM keyed WHERE e_mfg_date IS NOT NULL AND NOT coalesce(wneg_mfg<e_mfg_date,false))))""")


@query("f13_mfg_keyed", with_("mfgk", """SELECT scan_id, line_no AS key_line, val AS value_text, split_part(val,'/',1)::INTEGER AS month, split_part(val,'/',2)::INTEGER AS year
  FROM mfgk WHERE val<>''"""))
def f13(spark, sf):
    return _stage(spark, sf, "mfg_date", "keyed").select("scan_id", "key_line", "value_text", "mfg.month", "mfg.year")


@query("f14_mfg_bare")
def f14(spark, sf):
    return _stage(spark, sf, "mfg_date", "bare", use_fuzzy=True).select("scan_id", "key_line", "value_text", "match_confidence")


@query("f15_manufacturer", with_("keyed", """SELECT scan_id, line_no AS key_line, trim(near3) AS value_text,
  NOT (regexp_matches(near3,'\\b[0-9]{6}\\b') OR length(near3)>60) AS no_address FROM keyed WHERE e_manufacturer IS NOT NULL"""))
def f15(spark, sf):
    return _stage(spark, sf, "manufacturer", "keyed").select(
        "scan_id", "key_line", "value_text", F.col("note").isNotNull().alias("no_address"))


add("carec", ["keyed"], """SELECT *, regexp_extract(near3,'\\b1800[ -]?[0-9]{2,4}[ -]?[0-9]{3,4}\\b') AS phone FROM keyed""")


@query("f16_consumer_care", with_("carec", """SELECT scan_id, line_no AS key_line, phone AS value_text, CASE WHEN e_consumer_care IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS match_confidence
  FROM carec WHERE e_consumer_care IS NOT NULL OR phone<>''"""))
def f16(spark, sf):
    return _stage(spark, sf, "consumer_care", "keyed").select("scan_id", "key_line", "value_text", "match_confidence")


@query("f17_best_hit", with_("carec", """SELECT scan_id, phone AS value_text, CASE WHEN e_consumer_care IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS match_confidence, line_no
  FROM carec WHERE e_consumer_care IS NOT NULL OR phone<>'' QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY e_consumer_care IS NULL, line_no)=1"""))
def f17(spark, sf):
    return _best(spark, sf, "consumer_care").select("scan_id", "value_text", "match_confidence", "line_no")


@query("f18_parse_quantity", """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey%6 WHEN 0 THEN 'Net '||(o_custkey%90+1)||' x 200 g' WHEN 1 THEN (o_custkey%9+1)||'.5 kg pack'
  WHEN 2 THEN '10 N Net Wt '||(o_custkey%900+1)||' g' WHEN 3 THEN 'PAGES: '||(o_custkey%300+1) WHEN 4 THEN 'Net '||(o_custkey%700+1)||' c.' ELSE 'MRP Rs. '||o_custkey END AS text, o_custkey AS c FROM orders)
SELECT k, CASE k%6 WHEN 0 THEN (c%90+1)||' x 200 g' WHEN 1 THEN (c%9+1)||'.5 kg' WHEN 2 THEN (c%900+1)||' g' WHEN 3 THEN 'PAGES: '||(c%300+1) WHEN 4 THEN (c%700+1)||' c' END AS raw,
  CASE k%6 WHEN 0 THEN (c%90+1)*200 WHEN 1 THEN (c%9+1.5)*1000 WHEN 2 THEN c%900+1 WHEN 3 THEN c%300+1 WHEN 4 THEN c%700+1 END::DOUBLE AS base_value,
  CASE WHEN k%6=5 THEN NULL WHEN k%6=3 THEN 'count' ELSE 'g' END AS base_unit, CASE WHEN k%6<>5 THEN k%6=4 END AS ocr_recovered FROM t""")
def f18(spark, sf):
    o = v.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    text = v._by(k % 6, [""] * 6)
    text = (F.when(k % 6 == 0, F.concat(F.lit("Net "), s(c % 90 + 1), F.lit(" x 200 g")))
            .when(k % 6 == 1, F.concat(s(c % 9 + 1), F.lit(".5 kg pack")))
            .when(k % 6 == 2, F.concat(F.lit("10 N Net Wt "), s(c % 900 + 1), F.lit(" g")))
            .when(k % 6 == 3, F.concat(F.lit("PAGES: "), s(c % 300 + 1)))
            .when(k % 6 == 4, F.concat(F.lit("Net "), s(c % 700 + 1), F.lit(" c.")))
            .otherwise(F.concat(F.lit("MRP Rs. "), s(c))))
    q = o.select(k.alias("k"), quantity.parse_net_quantity(text, True).alias("q"))
    return q.select("k", "q.raw", "q.base_value", "q.base_unit", "q.ocr_recovered")


@query("f19_parse_month_year", """SELECT o_orderkey AS k, month(o_orderdate)::INTEGER AS month, CASE WHEN o_orderkey%4=2 THEN 2000+year(o_orderdate)%100 ELSE year(o_orderdate)+20 END::INTEGER AS year,
  CASE WHEN o_orderkey%4=0 AND day(o_orderdate)%10 BETWEEN 1 AND 9 THEN day(o_orderdate)%10 ELSE month(o_orderdate) END::INTEGER AS strict_month FROM orders""")
def f19(spark, sf):
    o = v.table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    # A day below 13 read as a month is what the strict order does; one that ends in 0 is none, and the month follows.
    text = (F.when(k % 4 == 0, F.concat(F.lit("on "), F.lit("2"), (F.dayofmonth(d) % 10).cast("string"), F.lit("/"),
                                        F.date_format(d, "MM"), F.lit("/"), (F.year(d) + 20).cast("string")))
            .when(k % 4 == 1, F.concat(F.date_format(d, "MM"), F.lit("-"), (F.year(d) + 20).cast("string")))
            .when(k % 4 == 2, F.concat(F.lit("pkd "), F.month(d).cast("string"), F.lit("."), F.date_format(d, "yy")))
            .otherwise(F.concat(F.date_format(d, "MMM"), F.lit(" "), (F.year(d) + 20).cast("string"))))
    return o.select(k.alias("k"), quantity.parse_month_year(text).alias("d"), quantity.parse_month_year(text, True).alias("s")).select(
        "k", "d.month", "d.year", F.col("s.month").alias("strict_month"))


@query("f20_common_name", with_("keyed", f"""SELECT scan_id, line_no AS key_line, trim(CASE WHEN {POS}[e_commodity_name+1] IS NULL THEN text
  ELSE substr(text, {POS}[e_commodity_name+1]::INTEGER) END, ' :-') AS value_text FROM keyed WHERE e_commodity_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY line_no)=1"""))
def f20(spark, sf):
    c = ex.candidates(v.lines(spark, sf), False, fields=["commodity_name"])
    return ex.best_hit(c).select("scan_id", F.col("hit.line_no").alias("key_line"), "hit.value_text")


@query("f21_densify_fields", f"""WITH f AS (SELECT unnest(['manufacturer','commodity_name','net_quantity','mfg_date','mrp','consumer_care']) AS field),
s AS (SELECT l_orderkey::VARCHAR||'/'||l_linenumber AS sid, l_partkey, l_quantity FROM lineitem) SELECT field, count(*) AS n, count(*) FILTER (WHERE false) AS n_absent,
  0 AS n_unassessable FROM f, s GROUP BY field""".replace("WITH f", "WITH f"))
def f21(spark, sf):
    hits = ex.best_hit(ex.candidates(v.lines(spark, sf), False))
    d = ex.densify_fields(hits, v.line_scans(spark, sf), dims.declarations(spark))
    return d.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("present"), 1)).alias("n_absent"),
                                  F.count(F.when(~F.col("assessable"), 1)).alias("n_unassessable"))


add("found", ["keyed", "keyed_price", "keyed_cur", "mfgk", "carec"], f"""SELECT scan_id, 'manufacturer' AS field FROM keyed WHERE e_manufacturer IS NOT NULL UNION
SELECT scan_id, 'commodity_name' FROM keyed WHERE e_commodity_name IS NOT NULL UNION SELECT scan_id, 'consumer_care' FROM carec WHERE e_consumer_care IS NOT NULL OR phone<>'' UNION
SELECT scan_id, 'mrp' FROM keyed_price UNION SELECT scan_id, 'mrp' FROM keyed_cur UNION SELECT scan_id, 'mfg_date' FROM mfgk WHERE val<>'' UNION
SELECT scan_id, 'mfg_date' FROM keyed WHERE neg_mfg IS NULL AND regexp_matches(text,'(0?[1-9]|1[0-2])[/\\-.](20[0-9][0-9]|[0-9][0-9])') UNION
SELECT scan_id, 'net_quantity' FROM (SELECT *, {_qty_sql('st', 'e_net_quantity IS NOT NULL')} AS q FROM (SELECT *, CASE WHEN e_net_quantity IS NOT NULL THEN wtext ELSE text END AS st FROM keyed
  WHERE e_net_quantity IS NOT NULL OR (neg_mrp IS NULL AND neg_qty IS NULL))) WHERE q IS NOT NULL""")
ORACLE["f21_densify_fields"] = with_("found", """SELECT f.field, (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM lineitem)-count(d.scan_id) AS n_absent,
  CASE WHEN f.field='commodity_name' THEN (SELECT count(*) FROM lineitem)-count(d.scan_id) ELSE 0 END AS n_unassessable
  FROM (SELECT unnest(['manufacturer','commodity_name','net_quantity','mfg_date','mrp','consumer_care']) AS field) f LEFT JOIN found d ON d.field=f.field GROUP BY f.field""")


@query("f_extract_all_fuzzy")
def fall(spark, sf):
    out = ex.extract_fields(v.lines(spark, sf), v.line_scans(spark, sf), dims.declarations(spark))
    return out.groupBy("field", "present", "match_confidence").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- whole reports
def report_inputs(spark, sf) -> scan_report.Inputs:
    """Labels of parts as recogniser tables: one capture, words, characters and glyphs each."""
    li = v.part_labels(spark, sf)
    lines = v.label_lines(li)
    words = lines.select("scan_id", "line_no", "y", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    n = F.length("text")
    before = W.partitionBy("scan_id", "line_no").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    words = words.select(
        "scan_id", F.lit(0).alias("pass_no"), (F.col("line_no") * 100 + F.col("pos")).alias("word_no"), "text",
        (F.coalesce(F.sum(n * 10 + 10).over(before), F.lit(0)) + 50).cast("int").alias("x"), (F.col("y") + 50).alias("y"),
        (n * 10).alias("w"), F.lit(20).alias("h"), F.lit(90.0).alias("conf")).where("text <> ''")
    chars = words.select("scan_id", "word_no", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "c"), "x", "y").select(
        "scan_id", "c", (F.col("x") + F.col("i") * 10).alias("x"), "y", F.lit(9).alias("w"), F.lit(20).alias("h"))
    digits = F.explode(F.sequence(F.lit(1), (F.col("l_suppkey") % 5 + 1).cast("int")))
    glyphs = li.select("scan_id", v._by(F.col("l_partkey") % 3, dims.JUDGED_FIELDS).alias("field"),
                       (F.col("l_quantity") + 5).alias("h0"), digits.alias("i")).select(
        "scan_id", "field", F.col("i").alias("glyph_no"), (F.col("i") * 10).alias("x"), F.lit(5).alias("y"), F.lit(8).alias("w"),
        F.col("h0").alias("h"), (F.col("h0") * 4).cast("int").alias("area"), F.lit(400).alias("crop_w"), F.lit(100).alias("crop_h"),
        (F.col("h0") + 0.25).alias("h_subpx"))
    captures = li.select(
        "scan_id", F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_suppkey") % 7 != 0, (F.col("l_suppkey") % 9 + 5).cast("double")).alias("known_px_per_mm"),
        F.lit(None).cast("array<struct<x:double,y:double>>").alias("corners"), F.lit(40.0).alias("marker_length_mm"),
        F.lit(2000).alias("img_w"), F.lit(1500).alias("img_h"), F.lit("normal").alias("print_style"),
        F.when(F.col("p_size") != 13, F.col("p_size") * F.col("p_size") * F.lit(1.1)).alias("panel_area_cm2"))
    return scan_report.Inputs(captures, words, chars, glyphs)


def _reports(spark, sf) -> DataFrame:
    return scan_report.build_reports(report_inputs(spark, sf), dims.band_model(spark))


@query("q11_build_reports")
def q11(spark, sf):
    r = _reports(spark, sf)
    return r.select("scan_id", "overall", F.size("violations").alias("n_violations"), F.size("declarations").alias("n_declarations"),
                    F.size("gates").alias("n_gates"), F.col("calibration.usable").alias("usable"), F.col("planarity.severity").alias("severity"),
                    F.col("legibility.legible").alias("legible"), F.col("legibility.n_words").alias("n_words"))


@query("h1_history_rows", with_("decl", """, t AS (SELECT DISTINCT scan_id FROM decl) SELECT t.scan_id, n.value_text AS net_quantity, m.value_text AS mrp, NULL::VARCHAR AS manufacturer
  FROM t LEFT JOIN decl n ON n.scan_id=t.scan_id AND n.field='net_quantity' LEFT JOIN decl m ON m.scan_id=t.scan_id AND m.field='mrp'""").replace("\n, t AS", ",\n t AS"))
def h1(spark, sf):
    d = v.declarations(spark, sf)
    nested = d.groupBy("scan_id").agg(F.collect_list(F.struct(
        "field", F.when(F.col("field") == "mrp", F.lit("")).otherwise(F.col("value_text")).alias("value_text"),
        F.col("value_text").alias("raw_text"))).alias("declarations"))
    none = F.array().cast("array<string>")
    rows = hs.history_rows(nested.select("scan_id", F.lit(None).cast("timestamp").alias("ts"), F.lit("COMPLIANT").alias("overall"),
                                         none.alias("violations"), none.alias("borderline"), "declarations"))
    return rows.select("scan_id", "net_quantity", "mrp", "manufacturer")


def _report_sections() -> str:
    """Lines of the report's sections; those of calibration and heights by their number only."""
    req = "CASE field " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in dims.DECLARATIONS) + " END"
    m = dims.SHIPPED_BAND_MODEL
    band = f"bias {m['bias_mm']:+.4f} mm, sigma {m['sigma_mm']:.4f} mm, k={m['k']}, band +/-{m['band_override_mm']:.3f} mm"
    scope = [f"{kind}: {what}".replace("'", "''") for kind, what in dims.SCOPE if kind != "in"]
    kinds = "CASE kind WHEN 'violation' THEN '4 violations' WHEN 'borderline' THEN '4 borderline' ELSE '4 not assessed' END"
    return f""", src AS (SELECT *, scan_id AS key, {REASON} AS reason FROM decl), msg AS ({_messages(False)}),
scans AS (SELECT scan_id, bool_or(has_height) AS any_height FROM decl GROUP BY 1),
lines AS (SELECT scan_id, '2 declarations' AS section, ord AS a, 0 AS b, '['||CASE presence_verdict WHEN 'PASS' THEN 'OK' WHEN 'FAIL' THEN 'MISS' ELSE '?' END||'] '
    ||{req}||': '||coalesce(value_text,'-') AS text FROM decl
  UNION ALL SELECT key, {kinds}, ord, part, text FROM msg
  UNION ALL SELECT scan_id, '5 uncertainty', 0, 0, '{band}' FROM scans
  UNION ALL SELECT scan_id, '6 scope', t.i, 0, t.s FROM scans, (VALUES {", ".join(f"({i},'{t}')" for i, t in enumerate(scope))}) t(i, s)
  UNION ALL SELECT scan_id, '3 heights', ord, 0, '' FROM decl WHERE has_height
  UNION ALL SELECT scan_id, '3 heights', 0, 0, '' FROM scans WHERE NOT any_height
  UNION ALL SELECT scan_id, '1 calibration', 0, 0, '' FROM scans
  UNION ALL SELECT scan_id, '1 calibration', 1, 0, '' FROM scans JOIN orders ON o_orderkey::VARCHAR=scan_id WHERE o_orderkey%5=0)
"""


@query("x6_report_lines", with_("decl", _report_sections() + digest_sql("scan_id, section", "a, b", ["text"], "lines")).replace("\n, src AS", ",\n src AS"))
def x6(spark, sf):
    req = dims.literal_map(dict(dims.DECLARATIONS))
    d = v.declarations(spark, sf).withColumns({
        "requirement": F.try_element_at(req, F.col("field")), "raw_text": F.col("value_text"),
        "notes": F.array().cast("array<string>")})
    k = F.col("o_orderkey")
    orders = v.table(spark, sf, "orders").select(k.cast("string").alias("scan_id"), F.col("o_orderdate").alias("ts"), k)
    gate_rows = orders.where(k % 5 == 0).select(
        "scan_id", F.lit(1).alias("seq"), F.lit("EXCESSIVE_TILT").alias("gate"), F.lit(True).alias("blocking_height"),
        F.lit(None).cast("string").alias("field"), F.lit("tilt").alias("detail"))
    lines = pr.report_lines(scan_report.assemble(orders, d, gate_rows), dims.band_model(spark))
    counted = F.col("section").isin("1 calibration", "3 heights")
    return digest(lines.withColumn("text", F.when(counted, "").otherwise(F.col("text"))), ["scan_id", "section"], ["ord"], ["text"])
