"""Scan history rows and queries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import skew
from packaudit.session import stage

LIST_COLS = ["scan_id", "ts", "overall", "n_violations", "n_borderline", "net_quantity", "mrp", "manufacturer",
             "officer"]
#: Parts of a stored history; one part is read and rewritten by one task.
BUCKETS = 256


def declared(declarations: Column, field: str) -> Column:
    """Value text, else raw text, of one declaration (H1)."""
    d = F.get(F.filter(declarations, lambda x: x["field"] == field), F.lit(0))
    text = F.coalesce(F.nullif(d["value_text"], F.lit("")), d["raw_text"], F.lit(""))
    return F.when(d.isNotNull(), text)


def history_rows(reports: DataFrame, batch_seq: int | Column = 0) -> DataFrame:
    """Reports to history rows, the whole report kept as JSON (H1)."""
    seq = batch_seq if isinstance(batch_seq, Column) else F.lit(batch_seq)
    extra = {c: (F.col(c) if c in reports.columns else F.lit(None).cast("string")) for c in ("image_path", "officer")}
    return reports.select(
        "scan_id", "ts", "overall", F.size("violations").alias("n_violations"),
        F.size("borderline").alias("n_borderline"),
        *[declared(F.col("declarations"), f).alias(f) for f in ("net_quantity", "mrp", "manufacturer")],
        *[c.alias(n) for n, c in extra.items()],
        F.to_json(F.struct(*[c for c in reports.columns if c not in extra])).alias("report_json"),
        seq.cast("bigint").alias("batch_seq"))


def upsert_history(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Latest row per scan; a later batch replaces the whole row."""
    return skew.last_by(existing.unionByName(new), ["scan_id"], "batch_seq").select(*existing.columns)


def bucket_of(scan_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(scan_id), F.lit(buckets)).cast("int")


def upsert_table(new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Fold ``new`` into the stored history at ``path``, split by bucket of the scan.

    Only buckets that a new row falls into are read and rewritten; their numbers, at most ``buckets``, reach the driver.
    The merged rows are staged first, so a failed write can be repeated from them.
    """
    spark = new.sparkSession
    incoming = stage(new.withColumn("bucket", bucket_of(F.col("scan_id"), buckets)), "upserts")
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = incoming.limit(0)
    touched = [r.bucket for r in incoming.select("bucket").distinct().collect()]
    merged = stage(upsert_history(incoming, stored.where(F.col("bucket").isin(touched)).select(*incoming.columns)), "history")
    (merged.repartition("bucket").sortWithinPartitions("bucket", "scan_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def get_scan(history: DataFrame, scan_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Point lookup; in a stored history it reads one bucket, and the equality reaches the file scan (H2)."""
    found = history.where(F.col("scan_id") == scan_id)
    return found.where(F.col("bucket") == bucket_of(F.lit(scan_id), buckets)) if "bucket" in history.columns else found


def list_scans(history: DataFrame, limit: int = 50, offset: int = 0, overall: str | None = None,
               q: str | None = None, after: tuple | None = None) -> DataFrame:
    """Newest scans, optionally of one verdict or containing a text (H3).

    ``q`` is matched without case, and its own % and _ stay wildcards. ``after``, the ts and scan_id of the last row seen,
    starts a later page without sorting the earlier ones again.
    """
    df = history
    if after is not None:
        ts, last = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("scan_id") > last)))
    if overall:
        df = df.where(F.col("overall") == overall)
    if q:
        pattern = "%" + q.replace("\\", "\\\\") + "%"
        hit = F.lit(False)
        for c in ("manufacturer", "mrp", "net_quantity", "scan_id"):
            hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
        df = df.where(hit)
    return df.select(*LIST_COLS).orderBy(F.desc("ts"), "scan_id").offset(offset).limit(limit)


def verdict_counts(history: DataFrame) -> DataFrame:
    """Scans per verdict, and in all under the verdict TOTAL (H4)."""
    return history.rollup("overall").agg(F.count(F.lit(1)).alias("n"), F.grouping("overall").alias("_g")).select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("overall")).alias("overall"), "n")


def top_violated(history: DataFrame, newest: int | None, k: int = 10) -> DataFrame:
    """Most violated declarations among the ``newest`` non-compliant scans, or among all of them if that is None (H5)."""
    recent = history.where(F.col("overall") == "NON_COMPLIANT")
    if newest is not None:
        recent = recent.orderBy(F.desc("ts"), "scan_id").limit(newest)
    parts = recent.select(F.explode("violations").alias("v")).select(
        F.split_part("v", F.lit(":"), F.lit(1)).alias("field"))
    return parts.groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field").limit(k)
