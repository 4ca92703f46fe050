"""Field boxes meet characters by hashing the boxes, so that characters are not sorted."""

from pyspark.sql import functions as F

from packaudit.operators import layout


def test_regions_hash_their_boxes(spark):
    i = F.col("id")
    chars = spark.range(600).select((i % 5).cast("string").alias("scan_id"), F.lit("x").alias("c"), (i * 7).cast("int").alias("x"),
                                    F.when(i % 97 != 0, (i % 40) * 40).alias("y"), F.lit(9).alias("w"), F.lit(20).alias("h"))
    rois = spark.createDataFrame([("0", "mrp", 0, 0, 5000, 5000)], "scan_id string, field string, x int, y int, w int, h int")
    hit = layout.chars_in_roi(chars, rois)
    assert "ShuffledHashJoin" in hit._jdf.queryExecution().sparkPlan().toString()
    assert hit.count() == chars.where("scan_id = '0' and y is not null").count()
