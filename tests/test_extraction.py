"""Quantity, date and declaration cases on hand-made labels."""

import random

import pytest
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import fuzzy, quantity, text as tx
from packaudit.operators import extraction as ex

LABELS = {
    "rivals": ["Net Qty.: 500 g", "MRP: Rs. 249.00 (inclusive of all taxes)", "Mfg. Date: 03/2025",
               "Best Before: 09/2025", "Batch/Lot No.: B04211 Expiry: 09/2026",
               "Special introductory price Rs. 199.00 | Rs. 49.80 per 100 g"],
    "same_line": ["Packed on: 07/2024   Best Before: 01/2025", "Net Wt.: 200 g", "Rs. 88.50"],
    "only_best_before": ["Some Brand", "Net Content 250 g", "Best Before 05/2026"],
    "wrapped": ["Month & Year of Manufacture:", "09/2023", "Net Qty.: 100 g"],
    "name": ["Common name: Toor Dal", "Net Qty.: 500 g"],
    "nothing": ["Some Brand", "Ingredients: wheat, salt"],
    "legend": ["*MRP Rs (INCL. OF ALL TAXES), USP, #MFD., B. NO. & @USE BEFORE: SEE BELOW.", "foo",
               "AA * = 545/-, Rs 2.73/ml", "MED: 11/2026"],
    "garbled": ["NetQuantlty: 250 c", "Manufactured by: X Pvt. Ltd.", "Plot 14 - 400123", "Customer Care: 1800 266 2240"],
}


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(k, i, t, 0, 40 * i, 10 * len(t), 20) for k, ts in LABELS.items() for i, t in enumerate(ts)]
    lines = spark.createDataFrame(rows, "scan_id string, line_no int, text string, x int, y int, w int, h int")
    out = ex.extract_fields(lines, lines.select("scan_id").distinct(), dims.declarations(spark)).collect()
    assert len(out) == 6 * len(LABELS)
    return {(r.scan_id, r.field): r for r in out}


def test_rival_price_and_dates(hits):
    assert hits["rivals", "mrp"].value_text == "249.00" and hits["rivals", "mrp"].note is None
    assert hits["rivals", "mfg_date"].value_text == "03/2025"
    assert hits["rivals", "net_quantity"].value_text == "500 g"


def test_rival_on_the_same_line(hits):
    assert hits["same_line", "mfg_date"].value_text == "07/2024"
    assert hits["same_line", "mrp"].match_confidence < 0.5
    assert not hits["only_best_before", "mfg_date"].present


def test_wrapped_and_named(hits):
    d = hits["wrapped", "mfg_date"]
    assert d.value_text == "09/2023" and [tuple(s) for s in d.segments] == [(1, 0, 7)]
    assert hits["name", "commodity_name"].value_text == "Toor Dal"


def test_absent(hits):
    for f in ("mrp", "net_quantity", "mfg_date", "manufacturer", "consumer_care"):
        assert not hits["nothing", f].present and hits["nothing", f].assessable
    assert not hits["nothing", "commodity_name"].assessable


def test_legend_and_recovery(hits):
    assert (hits["legend", "mrp"].value_text, hits["legend", "mrp"].match_confidence) == ("545", 0.75)
    assert (hits["legend", "mfg_date"].value_text, hits["legend", "mfg_date"].match_confidence) == ("11/2026", 0.6)
    q = hits["garbled", "net_quantity"]
    assert q.match_confidence == 0.75 and q.quantity.unit == "g" and q.quantity.ocr_recovered
    assert hits["garbled", "consumer_care"].contact.phone == "1800 266 2240"


def parse(spark, text, repair=True):
    return spark.range(1).select(quantity.parse_net_quantity(F.lit(text), repair).alias("q")).head().q


def test_quantity_cases(spark):
    assert parse(spark, "Net Qty 1.5 kg").base_value == 1500
    assert parse(spark, "3 x 200 g").base_value == 600
    assert parse(spark, "10 N Net Wt 250 g").base_unit == "g"
    assert parse(spark, "MRP Rs. 108") is None and parse(spark, "Customer Care 1800 266 2240") is None
    assert parse(spark, "Net Qty 250 ¢").unit == "g" and parse(spark, "Net Qty 250 ¢").ocr_recovered
    assert parse(spark, "Net Qty 250 ¢", False) is None
    assert parse(spark, "1,000 g").value == 1.0


def test_day_month_year(spark):
    d = lambda strict: spark.range(1).select(quantity.parse_month_year(F.lit("15/03/2025"), strict).alias("d")).head().d
    assert (d(False).month, d(False).year) == (3, 2025)
    assert (d(True).month, d(True).year) == (5, 2003)


def test_positions_follow_normalised_text(spark):
    t = "M.R.P. (₹) 12/-"
    r = spark.range(1).select(tx.normalize_key(F.lit(t)).alias("n"), tx.norm_positions(F.lit(t)).alias("p")).head()
    assert "".join(t[i] for i in r.p).upper() == r.n


def test_prefilter_never_loses_a_fuzzy_hit(spark):
    rng, tokens = random.Random(3), [t for ts in dims.FUZZY_PHRASES.values() for t in ts]
    rows = []
    for _ in range(4000):
        t = list(rng.choice(tokens))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t))
            op = rng.random()
            if op < 0.5:
                t[i] = rng.choice("ABCDEINORT01")
            elif op < 0.75:
                t.insert(i, rng.choice("ABCDEINORT01"))
            elif len(t) > 4:
                del t[i]
        rows.append(("".join(rng.choice("QXZ") for _ in range(rng.randint(0, 3))) + "".join(t),))
    df = spark.createDataFrame(rows, "norm string")
    checks = [fuzzy.may_contain(F.col("norm"), [t]).alias(t) for t in tokens]
    for r in df.select("norm", *checks).collect():
        for t in tokens:
            assert r[t] or not fuzzy.contains_fuzzy(r.norm, t), (r.norm, t)


def test_fuzzy_containment_equals_the_plain_ratio():
    import random
    from difflib import SequenceMatcher
    rng = random.Random(5)
    for token in ["NETQUANTITY", "PACKEDBY", "MAXIMUMRETAILPRICE"]:
        hits = 0
        for _ in range(300):
            word = list(token)
            for _ in range(rng.randrange(5)):
                word[rng.randrange(len(word))] = rng.choice("AEINT1")
            norm = "".join(rng.choices("ABENT", k=rng.randrange(4))) + "".join(word) + "".join(rng.choices("QUIET", k=rng.randrange(4)))
            n = len(token)
            want = any(SequenceMatcher(None, norm[i:i + n], token).ratio() >= 0.82 for i in range(len(norm) - n + 1))
            assert fuzzy.contains_fuzzy(norm, token) == want, (norm, token)
            hits += want
        assert 0 < hits < 300


def _above_lines(plan):
    """The steps of a plan, root first, down to where a label becomes lines."""
    return plan[:plan.index("Generate posexplode")]


def test_lines_of_a_label_move_once(spark):
    """A label is dealt out while it is one row; neither the neighbour windows nor the digest shuffle its lines again."""
    from verification import text_queries as t
    plan = t.QUERIES["f1_line_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in _above_lines(plan)


def test_one_stage_alone(spark):
    rows = [("a", i, t, 0, 40 * i, 10 * len(t), 20) for i, t in enumerate(["MRP: Rs. 249.00", "AA = 545/-", "Mfg. Date: 03/2025"])]
    lines = spark.createDataFrame(rows, "scan_id string, line_no int, text string, x int, y int, w int, h int")
    every = ex.candidates(lines, False, fields=["mrp", "mfg_date"])
    for stage in ("keyed", "currency", "slash", "bare"):
        want = [r.hit for r in every.where(F.col("hit.stage") == stage).orderBy("key_line", "hit.field").collect()]
        got = [r.hit for r in ex.candidates(lines, False, fields=["mrp", "mfg_date"], only=stage).orderBy("key_line", "hit.field").collect()]
        assert got == want and want


def test_contact_only_where_it_may_be(spark):
    texts = ["call 1800 266 2240", "9876543210", "+91-6987654321 x", "59876543210", "a@b.co", "18002662240", "none 12345", None]
    want = [("", "1800 266 2240"), ("", "9876543210"), ("", "+91-6987654321"), ("", ""), ("a@b.co", ""), ("", "18002662240"), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, near3 string")
    long_ = df.select("i", F.regexp_extract("near3", dims.EMAIL, 0).alias("e"), F.regexp_extract("near3", dims.PHONE, 0).alias("p"))
    assert [(r.e, r.p) for r in long_.orderBy("i").collect()] == want
    full = df.withColumns({"key_consumer_care": F.lit(None).cast("struct<conf:double,end:int>"), "line_no": F.lit(0), "len0": F.lit(1)})
    got = {r.i: r.h.contact for r in full.select("i", ex.consumer_care().alias("h")).collect() if r.h}
    assert {i: (c.email or "", c.phone or "") for i, c in got.items()} == {i: w for i, w in enumerate(want) if any(w)}
