"""Building blocks that keep one hot key from landing in one task.

``first_by``        first row per key by an aggregate, combined before the shuffle
``ranked``          row number per key without sorting a whole key in one task
``in_blocks``       windows over neighbours, cut into blocks with a halo
``percentiles``     exact interpolated percentiles over counted values
``suffix_percentiles``  the same for every suffix of ordered bins
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packaudit.session import stage


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that sorts first. ``order`` must be unique within a key.

    ``min_by`` combines map-side, so a hot key ships one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``; among equals, the one whose hash is largest."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Row number from 1 per key, where ``bucket`` never decreases along ``order``.

    Counts per bucket give each bucket's starting rank, so only a bucket is sorted in
    one task. The bucket must be coarse enough that a key has few of them.
    """
    cut = df.withColumn("_b", bucket)
    sizes = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select(*keys, "_b", F.coalesce(
        F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    return (cut.withColumn("_rn", F.row_number().over(inside))
            .join(start, [*keys, "_b"])
            .withColumn(name, (F.col("_start") + F.col("_rn")).cast("int"))
            .drop("_b", "_rn", "_start"))


def in_blocks(df: DataFrame, keys: list[str], position: str, before: int, after: int,
              columns: dict, block: int = 4096) -> DataFrame:
    """Add window columns that look ``before`` rows back and ``after`` rows ahead.

    ``position`` numbers the rows of a key without gaps. Rows are cut into blocks of
    consecutive positions; a row near an edge is copied to the next block as context
    only, so any key spreads over many tasks. ``columns`` maps a name to a function of
    the ordered window.
    """
    p = F.col(position)
    home = F.floor(p / block)
    blocks = F.array_distinct(F.array(F.greatest(F.floor((p - after) / block), F.lit(0)), home,
                                      F.floor((p + before) / block)))
    spread = df.withColumn("_home", home).withColumn("_blk", F.explode(blocks))
    w = W.partitionBy(*keys, "_blk").orderBy(position)
    out = spread.select("*", *[fn(w).alias(name) for name, fn in columns.items()])
    return out.where(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def _interpolated(k_lo: str, k_hi: str, frac: str) -> Column:
    return F.col(k_lo) + (F.col(k_hi) - F.col(k_lo)) * F.col(frac)


def selected_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles for few, large groups of any number of different values.

    The input is evaluated once, into a staged table of counted values. A sketch over these proposes cut points, exact
    counts between cut points locate the wanted ranks, and only the cells that hold them are sorted. The sketch shapes the
    work, never the answer.
    """
    grid = [i / 128 for i in range(129)]
    anchor = keys or ["_all"]
    src = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    if not keys:
        src = src.withColumn("_all", F.lit(1))
    hist = stage(src.groupBy(*anchor, "_v").agg(F.count(F.lit(1)).alias("_c")), "histogram")
    cuts = hist.groupBy(*anchor).agg(F.percentile_approx("_v", grid, 20000).alias("_cuts"), F.sum("_c").alias("_n"))
    # One row of about a hundred numbers per group, and few groups by definition.
    celled = hist.join(F.broadcast(cuts), anchor).withColumn(
        "_cell", F.size(F.filter("_cuts", lambda s: s < F.col("_v"))))
    cells = celled.groupBy(*anchor, "_cell").agg(F.sum("_c").alias("_cc"), F.first("_n").alias("_n"))
    upto = F.sum("_cc").over(W.partitionBy(*anchor).orderBy("_cell"))
    targets = _targets(cells.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_cc")), anchor, probs)
    inside = celled.join(targets.select(*anchor, "_cell").distinct(), [*anchor, "_cell"], "left_semi")
    out = _read_off(inside, targets, anchor, probs)
    return out if keys else out.drop("_all")


def _targets(cells: DataFrame, anchor: list[str], probs: dict[str, float]) -> DataFrame:
    """The wanted ranks of each group and the cell that holds each; ``cells`` has the first and the next cell's first rank, _lo and _hi."""
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    return (
        cells.withColumn("_w", F.explode(wanted))
        .withColumn("_t", F.col("_w.p") * (F.col("_n") - 1))
        .withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_t"), F.ceil("_t")))))
        .where((F.col("_k") >= F.col("_lo")) & (F.col("_k") < F.col("_hi")))
        .select(*anchor, "_cell", "_lo", "_k", F.col("_w.name").alias("_name"), "_t"))


def _read_off(inside: DataFrame, targets: DataFrame, anchor: list[str], probs: dict[str, float]) -> DataFrame:
    """Interpolated values at the wanted ranks, from the counted values of the cells that hold them."""
    cum = F.sum("_c").over(W.partitionBy(*anchor, "_cell").orderBy("_v"))
    ranked_ = inside.withColumn("_to", cum).withColumn("_from", F.col("_to") - F.col("_c"))
    hits = (
        ranked_.join(targets, [*anchor, "_cell"])
        .where((F.col("_k") - F.col("_lo") >= F.col("_from")) & (F.col("_k") - F.col("_lo") < F.col("_to"))))
    ends = hits.groupBy(*anchor, "_name").agg(
        F.min_by("_v", "_k").alias("_vlo"), F.max_by("_v", "_k").alias("_vhi"),
        F.first(F.col("_t") - F.floor("_t")).alias("_f"))
    return ends.groupBy(*anchor).agg(*[
        F.max(F.when(F.col("_name") == n, _interpolated("_vlo", "_vhi", "_f"))).alias(n) for n in probs])


def suffix_percentiles(df: DataFrame, bin_: str, bins: int, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of all rows of bin ``b`` or higher, for every b from 1 to ``bins``.

    Rows are counted once by bin and value, never copied per bin they belong to: all suffixes share one set of cut points,
    a table of bins times cells (some thousand rows) is summed over suffixes, and only the cells that hold a wanted rank are
    read for the suffixes that want them.
    """
    grid = [i / 128 for i in range(129)]
    hist = stage(df.where(F.col(value).isNotNull()).groupBy(F.col(bin_).alias("_b"), F.col(value).cast("double").alias("_v"))
                 .agg(F.count(F.lit(1)).alias("_c")), "histogram")
    cuts = hist.agg(F.percentile_approx("_v", grid, 20000).alias("_cuts"))
    celled = hist.crossJoin(F.broadcast(cuts)).withColumn("_cell", F.size(F.filter("_cuts", lambda s: s < F.col("_v")))).drop("_cuts")
    upward = F.explode(F.sequence(F.lit(1), F.least("_b", F.lit(bins))))
    cells = stage(celled.groupBy("_b", "_cell").agg(F.sum("_c").alias("_cc"))
                  .select(upward.alias(bin_), "_cell", "_cc").groupBy(bin_, "_cell").agg(F.sum("_cc").alias("_cc")), "cells")
    w = W.partitionBy(bin_)
    upto = F.sum("_cc").over(w.orderBy("_cell"))
    targets = _targets(cells.select("*", upto.alias("_hi"), (upto - F.col("_cc")).alias("_lo"), F.sum("_cc").over(w).alias("_n")), [bin_], probs)
    # At most two cells for each bin and probability.
    wanted = targets.groupBy("_cell").agg(F.collect_set(bin_).alias("_of"))
    inside = (celled.join(F.broadcast(wanted), "_cell")
              .select("_cell", "_v", "_c", F.explode(F.filter("_of", lambda b: b <= F.col("_b"))).alias(bin_))
              .groupBy(bin_, "_cell", "_v").agg(F.sum("_c").alias("_c")))
    return _read_off(inside, targets, [bin_], probs)


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of many groups.

    Equal values are counted first, combined before the shuffle, so a group costs as much as it has different values,
    not rows; the input is evaluated once.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return (counted.groupBy(*keys).agg(F.percentile(value, [float(p) for p in probs.values()], F.col("_n")).alias("_p"))
            .select(*keys, *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(probs)]))
