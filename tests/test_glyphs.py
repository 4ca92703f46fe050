"""Digit columns against brute force, and one large field."""

import random

from pyspark.sql import functions as F

from packaudit.operators import glyphs

GLYPHS = "scan_id string, field string, glyph_no int, x int, w int, crop_w int"
CHARS = "scan_id string, field string, c string, x int, w int"


def brute(gs, cs):
    out = set()
    for key in {g[:2] for g in gs}:
        mine = [g for g in gs if g[:2] == key]
        digits = [(max(c[3], 0), c[3] + c[4]) for c in cs if c[:2] == key and c[2] in "0123456789"]
        hit = [g for g in mine if 0 <= (m := (2 * g[3] + g[4]) // 2) < g[5] and any(a <= m < b for a, b in digits)]
        used = len(hit) >= 2 or (len(hit) == 1 and len(mine) <= 2)
        out |= {(*g[:3], used) for g in (hit if used else mine)}
    return out


def test_digit_columns_equal_brute_force(spark):
    rng = random.Random(2)
    gs = [(f"s{i % 15}", rng.choice(["mrp", "qty"]), i, rng.randint(-5, 220), rng.randint(1, 20), 200) for i in range(200)]
    cs = [(f"s{i % 17}", rng.choice(["mrp", "qty"]), rng.choice("0123456789abX"), rng.randint(-20, 200), rng.choice([-3, 0, 1, 5, 9, 30])) for i in range(260)]
    gs += [("t", "mrp", 1000, 10, 2, 50), ("t", "mrp", 1001, 20, 2, 50), ("t", "mrp", 1002, 14, 2, 50)]
    cs += [("t", "mrp", "7", 11, 4)]  # from one centre up to another, which it does not take
    got = glyphs.digit_restrict(spark.createDataFrame(gs, GLYPHS), spark.createDataFrame(cs, CHARS))
    rows = [(r.scan_id, r.field, r.glyph_no, r.used_char_boxes) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(gs, cs)


def test_one_field_of_100000_glyphs(spark):
    n = 100_000
    gs = spark.range(n).select(F.lit("s").alias("scan_id"), F.lit("mrp").alias("field"), F.col("id").cast("int").alias("glyph_no"),
                               (F.col("id") * 10).cast("int").alias("x"), F.lit(4).alias("w"), F.lit(2_000_000).alias("crop_w"))
    cs = spark.range(n).select(F.lit("s").alias("scan_id"), F.lit("mrp").alias("field"), F.when(F.col("id") % 2 == 0, "5").otherwise("x").alias("c"),
                               (F.col("id") * 10).cast("int").alias("x"), F.lit(5).alias("w"))
    got = glyphs.digit_restrict(gs, cs).agg(F.count("*"), F.sum(F.col("glyph_no") % 2), F.bool_and("used_char_boxes")).head()
    assert tuple(got) == (n // 2, 0, True)
