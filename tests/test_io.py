"""Files in and out, inbox streams, model and history tables."""

import pytest
import json
import os

from pyspark.sql import functions as F

from packaudit import dims
from packaudit.operators import history as hs
from packaudit.sources import captures, ocr, stored
from packaudit.streaming import history as sh


def touch(folder, *names):
    os.makedirs(folder, exist_ok=True)
    for n in names:
        with open(os.path.join(folder, n), "w") as f:
            f.write(n)


def test_capture_listing(spark, tmp_path):
    touch(tmp_path / "in", "b.JPG", "a.png", "c.txt", ".hidden.jpg", "noext")
    assert [r.name for r in captures.read_captures(spark, str(tmp_path / "in")).orderBy("name").collect()] == ["a.png", "b.JPG"]


def test_inbox_drains_once(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    touch(inbox, "a.jpg", "b.txt")

    def drain():
        rows = captures.stream_inbox(spark, str(inbox), str(tmp_path / "done"))
        q = (rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", out)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    drain()
    touch(inbox, "c.jpg")
    drain()
    drain()
    assert sorted(r.name for r in spark.read.parquet(out).collect()) == ["a.jpg", "c.jpg"]
    assert not (inbox / "a.jpg").exists()


def test_recogniser_files(spark, tmp_path):
    touch(tmp_path / "w")
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "w" / "scan1.tsv").write_text(
        head + "5\t1\t1\t1\t1\t1\t10\t20\t31\t9\t91.5\tNet\n5\t1\t1\t1\t1\t2\t50\t20\t30\t9\t-1\tx\n5\t1\t1\t1\t1\t3\t50\t20\t30\t9\t80\t  \n")
    r = ocr.read_ocr_words(spark, str(tmp_path / "w"), 2.0).collect()
    assert [(x.scan_id, x.text, x.x, x.y, x.w, x.h) for x in r] == [("scan1", "Net", 5, 10, 16, 4)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "scan1.box").write_text("N 10 80 20 95 0\n~ 1 2\n")
    c = ocr.read_ocr_chars(spark, str(tmp_path / "c"), 100, 1.0).collect()
    assert [(x.c, x.x, x.y, x.w, x.h) for x in c] == [("N", 10, 5, 10, 15)]


def test_a_folder_of_images_is_one_read(spark, tmp_path):
    """Fifty images of their own height and scale, in one call and one plan."""
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "c").mkdir()
    sizes = {f"scan{i}": (100 + i, float(1 + i % 4)) for i in range(50)}
    for scan, (height, _) in sizes.items():
        (tmp_path / "w" / f"{scan}.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t24\t48\t36\t12\t91.5\tNet\n")
        (tmp_path / "c" / f"{scan}.box").write_text(f"N 12 {height - 60} 48 {height - 24} 0\n")
    images = spark.createDataFrame([(k, *v) for k, v in sizes.items() if k != "scan7"] + [("scan7", None, None), ("other", 9, 9.0)],
                                   "scan_id string, img_h int, scale double")
    words = ocr.read_ocr_words(spark, str(tmp_path / "w"), images=images, scale=3.0).collect()
    own = {**sizes, "scan7": (None, 3.0)}
    assert sorted((r.scan_id, r.x, r.y, r.w, r.h) for r in words) == sorted(
        (k, *[round(v / s) for v in (24, 48, 36, 12)]) for k, (_, s) in own.items())
    chars = ocr.read_ocr_chars(spark, str(tmp_path / "c"), images=images)
    assert sorted((r.scan_id, r.x, r.y, r.w, r.h) for r in chars.collect()) == sorted(
        (k, *[round(v / s) for v in (12, 24, 36, 36)]) for k, (_, s) in sizes.items() if k != "scan7")
    assert chars.columns == ["scan_id", "c", "x", "y", "w", "h"]


def test_band_model_defaults_and_missing_file(spark, tmp_path):
    path = str(tmp_path / "m.json")
    with open(path, "w") as f:
        json.dump({"sigma_mm": 0.05, "k": 4.0}, f)
    m = stored.load_band_model(spark, path).head()
    assert (m.sigma_mm, m.k, m.min_px_per_mm, m.apply_bias_correction) == (0.05, 4.0, 12.0, False)
    assert stored.load_band_model(spark, str(tmp_path / "none.json")).head().sigma_mm == 0.15
    stored.save_band_model(dims.band_model(spark), str(tmp_path / "saved"))
    assert stored.load_band_model(spark, str(tmp_path / "saved")).head().band_override_mm == 0.15645


def test_height_truth_file(spark, tmp_path):
    path = str(tmp_path / "t.json")
    with open(path, "w") as f:
        json.dump({"rows_top_to_bottom": [{"target_mm": t, "true_height_mm": h} for t, h in dims.HEIGHT_TRUTH]}, f, indent=1)
    rows = stored.read_height_truth(spark, path).orderBy("row_no").collect()
    assert [(r.row_no, r.true_height_mm) for r in rows] == [(i + 1, h) for i, (_, h) in enumerate(dims.HEIGHT_TRUTH)]


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("s1", "a", 0, "x"), ("s1", "b", 0, "y"), ("s2", "a", 0, "z")],
                                  "scan_id string, section string, ord int, text string")
    stored.write_text_reports(lines, str(tmp_path / "all"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "all")).collect()) == ["s1\tx", "s1\ty", "s2\tz"]
    stored.write_text_reports(lines, str(tmp_path / "each"), per_scan=True)
    assert sorted(d for d in os.listdir(tmp_path / "each") if "=" in d) == ["scan_id=s1", "scan_id=s2"]
    stored.write_eval_report(lines, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_stored_reports_round_trip(spark, tmp_path):
    rows = spark.range(1).select(
        F.lit("s1").alias("scan_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("NON_COMPLIANT").alias("overall"),
        F.array(F.lit("mrp: declaration not found")).alias("violations"), F.array().cast("array<string>").alias("borderline"),
        F.array().cast("array<string>").alias("not_assessed"),
        F.array(F.struct(F.lit("mrp").alias("field"), F.lit("").alias("value_text"), F.lit("raw " * 100).alias("raw_text"))).alias("declarations"))
    h = hs.history_rows(rows)
    assert h.head().mrp == "raw " * 100 and h.head().net_quantity is None and h.head().n_violations == 1
    back = stored.parse_reports(h).head()
    assert (back.scan_id, back.overall, back.violations) == ("s1", "NON_COMPLIANT", ["mrp: declaration not found"])
    assert hs.get_scan(h, "s1").count() == 1 and hs.list_scans(h, q="S1").count() == 1
    assert {(r.overall, r.n) for r in hs.verdict_counts(h).collect()} == {("NON_COMPLIANT", 1), ("TOTAL", 1)}


def test_history_log_replays_and_compacts(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    ddl = "scan_id string, ts timestamp, overall string"

    def arrive(rows):
        spark.createDataFrame(rows, "scan_id string, t string, overall string").select(
            "scan_id", F.col("t").cast("timestamp").alias("ts"), "overall").coalesce(1).write.mode("append").parquet(src)
        q = sh.stream_history(spark.readStream.schema(ddl).parquet(src), log, str(tmp_path / "mark"), "ts").trigger(
            availableNow=True).start()
        q.awaitTermination()

    arrive([("a", "2024-01-01", "COMPLIANT"), ("b", "2024-01-01", "COMPLIANT"), ("a", "2024-01-02", "NON_COMPLIANT")])
    arrive([("b", "2024-01-03", "REVIEW_REQUIRED")])
    state = {r.scan_id: r.overall for r in sh.read_history(spark, log).collect()}
    assert state == {"a": "NON_COMPLIANT", "b": "REVIEW_REQUIRED"}
    sh.compact_history(spark, log, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_readers_take_the_snapshot_and_newer_committed_batches(spark, tmp_path):
    path = str(tmp_path / "log")

    def batch(rows):
        return spark.createDataFrame(rows, "scan_id string, ts string, overall string")

    def state():
        return {r.scan_id: r.overall for r in sh.read_history(spark, path).collect()}

    def files():
        return {f.split(path)[1].split("/")[1] for f in sh.read_history(spark, path).inputFiles()}

    with pytest.raises(ValueError, match="no batch"):
        sh.read_history(spark, path)
    sh.log_batch(batch([("a", "1", "COMPLIANT"), (None, "1", "COMPLIANT"), ("b", "1", "COMPLIANT"), ("b", "2", "REVIEW_REQUIRED")]), 0, path, "ts")
    sh.log_batch(batch([("a", "3", "NON_COMPLIANT")]), 1, path, "ts")
    want = {"a": "NON_COMPLIANT", "b": "REVIEW_REQUIRED", None: "COMPLIANT"}
    assert state() == want and files() == {"log_batch=0", "log_batch=1"}
    # A batch whose writer died before its commit is not seen, and is written again by its repetition.
    batch([("a", "9", "half")]).withColumn("batch_seq", F.lit(2).cast("bigint")).write.parquet(f"{path}/log_batch=2")
    assert state() == want
    first = sh.compact_log(spark, path)
    assert first.upto == 1 and state() == want and files() == {first.table}
    # The same batch once more, after it was folded: nothing changes.
    sh.log_batch(batch([("a", "3", "NON_COMPLIANT")]), 1, path, "ts")
    assert state() == want and files() == {first.table}
    sh.log_batch(batch([("b", "4", "COMPLIANT"), ("c", "4", "COMPLIANT"), (None, "4", "NON_COMPLIANT")]), 2, path, "ts")
    want = {"a": "NON_COMPLIANT", "b": "COMPLIANT", "c": "COMPLIANT", None: "NON_COMPLIANT"}
    assert state() == want and files() == {first.table, "log_batch=2"}
    # A compaction that died before its commit leaves a table that no reader opens; the next one clears it away.
    batch([("z", "1", "half")]).write.parquet(f"{path}/_table-dead")
    assert state() == want
    second = sh.compact_log(spark, path)
    assert second.number == 2 and state() == want and files() == {second.table} and sh.compact_log(spark, path) == second
    left = {n for n in os.listdir(path) if not n.startswith(("_commits", "_snapshots"))}
    assert left == {first.table, second.table, "log_batch=2"}
    with pytest.raises(RuntimeError, match="another compaction"):
        sh.Manifest(spark, path).advance(first, "_table-late", 9)
    assert state() == want


def test_stored_history_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "table")

    def put(rows):
        hs.upsert_table(spark.createDataFrame(rows, "scan_id string, ts string, overall string, batch_seq long"), path, 8)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    put([(f"s{i}", "2024-01-01", "COMPLIANT", 1) for i in range(40)] + [(None, "2024-01-01", "COMPLIANT", 1)])
    before = files()
    put([("s3", "2024-01-02", "NON_COMPLIANT", 2)])
    assert len(before & files()) == len(before) - 1
    table = spark.read.parquet(path)
    assert table.count() == 41
    assert [(r.overall, r.batch_seq) for r in hs.get_scan(table, "s3", 8).collect()] == [("NON_COMPLIANT", 2)]
    plan = hs.get_scan(table, "s3", 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(scan_id,s3)" in plan


def test_pages_by_key(spark):
    h = spark.createDataFrame([(f"s{i}", f"2024-01-0{1 + i % 3}") for i in range(9)], "scan_id string, ts string").select(
        "scan_id", "ts", *[F.lit(None).cast("string").alias(c) for c in hs.LIST_COLS[2:]])
    whole = [(r.ts, r.scan_id) for r in hs.list_scans(h).collect()]
    page = [(r.ts, r.scan_id) for r in hs.list_scans(h, limit=4, after=whole[2]).collect()]
    assert page == whole[3:7]


def test_a_cluster_without_a_shared_folder_is_refused():
    from packaudit import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
