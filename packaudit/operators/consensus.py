"""Several frames of one pack to one answer.

A pack may hold any number of frames, so nothing is collected per pack: votes are
counts, choices are ordered aggregates, and readings stay rows. Readings enter at the
three decimals a report carries, which bounds the distinct values a median counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import rules as ru, skew, text as tx
from packaudit.functions.rules import ADJUDICATED, NOT_ASSESSED, PASS
from packaudit.operators import adjudication

PACK_FIELD = ["pack_id", "field"]
#: Parts in which the readings of one pack and field meet a table with a row for each.
SALTS = 16


def _best_first(label: Column, frame: Column) -> Column:
    return F.struct((-F.coalesce(label, F.lit(0.0))).alias("q"), frame.alias("f"))


def base_frame(frames: DataFrame) -> DataFrame:
    """The sharpest frame of each pack, the first on ties (C1). One row per frame in."""
    return frames.groupBy("pack_id").agg(
        F.min_by("frame_no", _best_first(F.col("label_ppmm"), F.col("frame_no"))).alias("base_frame"),
        F.count(F.lit(1)).alias("n_frames"))


def vote_value(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """Majority reading per pack and field.

    Counts by folded text, first seen on ties. If nothing repeats, the most confident
    reading stands; with two or more frames it also needs confidence 0.5.
    """
    folded = tx.fold_ws(F.col("value_text"))
    counted = (rows.withColumn("_f", folded).where(F.col("_f") != "")
               .groupBy(*PACK_FIELD, "_f").agg(
                   F.count(F.lit(1)).alias("n"), F.min("frame_no").alias("first_no"),
                   F.min_by("value_text", "frame_no").alias("raw"),
                   F.max(F.coalesce("match_confidence", F.lit(0.0))).alias("conf")))
    top = F.min_by(F.struct("raw", "n"), F.struct((-F.col("n")).alias("a"), F.col("first_no").alias("b")))
    sure = F.min_by(F.struct("raw", "conf"), F.struct((-F.col("conf")).alias("a"), F.col("first_no").alias("b")))
    voted = counted.groupBy(*PACK_FIELD).agg(top.alias("top"), sure.alias("sure"),
                                             F.count(F.lit(1)).alias("n_values"))
    voted = voted.join(packs.select("pack_id", "n_frames"), "pack_id")
    lone = F.col("top.n") == 1
    dropped = lone & (F.col("n_frames") >= 2) & (F.col("sure.conf") < dims.MIN_JUDGE_CONF)
    return voted.select(
        *PACK_FIELD,
        F.when(dropped, F.lit(None)).when(lone, F.col("sure.raw")).otherwise(F.col("top.raw")).alias("value"),
        (dropped | (F.col("n_values") > 1)).alias("disagreed"), F.col("top.n").alias("votes"))


def consensus(rows: DataFrame, frames: DataFrame, model: DataFrame) -> DataFrame:
    """One row per pack and field.

    ``rows`` has one row per (pack_id, frame_no, field) with ord, informational, present,
    presence_verdict, value_text, match_confidence, measured_mm, required_mm, verdict,
    width_verdict, reason and label_ppmm; ``frames`` one row per readable frame. The band
    is the model's own, widened to half the spread when frames disagree more, never
    narrowed; a frame's plane penalty and low-count inflation do not carry over.
    """
    packs = base_frame(frames)
    mm = tx.round_to("measured_mm", 3)
    has = F.coalesce(mm != 0, F.lit(False))
    good = has & F.col("verdict").isin(*ADJUDICATED)
    frame = F.col("frame_no")
    shown = F.struct("verdict", "width_verdict", "reason", "presence_verdict", "measured_mm", "required_mm")
    flags = rows.withColumns({"_mm": mm, "_has": has, "_good": good})

    def over(flag: str, name: str) -> list[Column]:
        use, v = F.col(flag), F.col("_mm")
        return [F.count(F.when(use, 1)).alias(f"n_{name}"),
                F.percentile(F.when(use, v), F.lit(0.5)).alias(f"median_{name}"),
                (F.max(F.when(use, v)) - F.min(F.when(use, v))).alias(f"spread_{name}"),
                F.min_by(F.when(use, F.col("required_mm")),
                         F.when(use & F.col("required_mm").isNotNull(), frame)).alias(f"required_{name}"),
                F.min_by(F.when(use, shown), F.when(use, frame)).alias(f"first_{name}")]

    merged = flags.groupBy(*PACK_FIELD).agg(
        F.first("ord").alias("ord"),
        F.count(F.when(F.col("present"), 1)).alias("frames_present"),
        F.bool_or(F.coalesce(F.length("value_text") > 0, F.lit(False))).alias("_any_text"),
        tx.round_to(F.max(F.coalesce("match_confidence", F.lit(0.0))), 2).alias("match_confidence"),
        F.bool_or(F.coalesce("informational", F.lit(False))).alias("informational"),
        F.bool_or(F.col("_has") | F.coalesce(F.col("required_mm") != 0, F.lit(False))).alias("listed"),
        F.min_by(shown, _best_first(F.col("label_ppmm"), frame)).alias("base"),
        *over("_good", "good"), *over("_has", "weak"))
    df = (merged.join(packs, "pack_id").join(vote_value(rows, packs), PACK_FIELD, "left")
          .crossJoin(F.broadcast(model.select("bias_mm", "sigma_mm", "k", "band_override_mm",
                                              "apply_bias_correction"))))
    trusted, single = F.col("n_good") > 0, F.col("n_frames") == 1

    def pick(name: str) -> Column:
        return F.when(trusted, F.col(f"{name}_good")).otherwise(F.col(f"{name}_weak"))

    used, med, spread, req = pick("n"), pick("median"), pick("spread"), pick("required")
    base_band = ru.model_band()
    band = base_band + F.greatest(F.lit(0.0), spread / 2.0 - base_band)
    decided = trusted & req.isNotNull() & ~F.col("informational")
    tier = ru.verdict(med, req, band, F.col("bias_mm"), F.col("apply_bias_correction"))
    first = pick("first")
    weak_text = F.col("value").isNull() & F.col("_any_text")
    present = ~weak_text & (F.col("frames_present") > 0)
    presence = (F.when(present, PASS).when(weak_text, NOT_ASSESSED).otherwise(F.col("base.presence_verdict")))
    got = used > 0
    return df.select(
        *PACK_FIELD, "ord", "informational", "n_frames", "base_frame", "listed",
        F.when(single, F.col("frames_present") > 0).otherwise(present).alias("present"),
        F.when(single, F.col("base.presence_verdict")).otherwise(presence).alias("presence_verdict"),
        F.coalesce("value", F.lit("")).alias("value_text"), "match_confidence",
        F.coalesce("disagreed", F.lit(False)).alias("values_disagreed"),
        "frames_present", used.alias("frames_measured"), trusted.alias("measurement_trusted"),
        F.when(got, med).alias("measured_mm"), F.when(got, spread).alias("spread_mm"),
        F.when(got, req).otherwise(F.col("base.required_mm")).alias("required_mm"),
        F.when(single, F.col("base.verdict"))
        .when(got & decided, tier)
        .when(got & F.col("informational"), NOT_ASSESSED)
        .when(got, first["verdict"]).otherwise(F.col("base.verdict")).alias("verdict"),
        F.when(got & decided & ~single, band).alias("band_mm"),
        F.when(got, first["width_verdict"]).otherwise(F.col("base.width_verdict")).alias("width_verdict"),
        F.when(got & decided, "").when(got & ~trusted, F.concat(
            F.lit("no frame gave an adjudicated height; "), F.coalesce(first["reason"], F.lit(""))))
        .when(got, first["reason"]).otherwise(F.col("base.reason")).alias("reason"),
        F.when(single, "single frame; no agreement available").alias("note"))


def frame_values(rows: DataFrame) -> DataFrame:
    """The readings that a pack's height is the median of: one row per pack, field and frame (C4).

    Adjudicated readings count; where a field has none, all its readings do, and ``trusted`` is false. The fields that have
    one meet the other readings under a salt, so a pack with any share of all frames spreads out.
    """
    mm = tx.round_to("measured_mm", 3)
    read = rows.select(*PACK_FIELD, "frame_no", mm.alias("measured_mm"), F.col("verdict").isin(*ADJUDICATED).alias("trusted"),
                       F.pmod(F.xxhash64("frame_no"), F.lit(SALTS)).cast("int").alias("_s")).where(F.col("measured_mm") != 0)
    good = F.coalesce("trusted", F.lit(False))
    decided = read.where(good).select(*PACK_FIELD).distinct().withColumn("_s", F.explode(F.lit(list(range(SALTS)))))
    weak = read.where(~good).join(decided, [*PACK_FIELD, "_s"], "left_anti")
    return read.where(good).unionByName(weak).select(*PACK_FIELD, "frame_no", "measured_mm", good.alias("trusted"))


def frame_agreement(merged: DataFrame) -> DataFrame:
    """How well frames agree, for fields any frame measured or held to a height."""
    return merged.where(F.col("listed") & (F.col("n_frames") > 1)).select(
        *PACK_FIELD, "frames_present", "frames_measured", "values_disagreed",
        F.when(F.col("frames_measured") > 1, F.col("spread_mm")).alias("spread_mm"))


def consensus_rollup(merged: DataFrame) -> DataFrame:
    """Overall verdict of each pack; a borderline width does not count here."""
    rows = merged.withColumn("has_height", F.col("listed"))
    return adjudication.rollup(rows, ["pack_id"], consensus=True)


def agreement_summary(agreement: DataFrame) -> DataFrame:
    """Widest spread, single-frame fields and disputed fields of each pack.

    A pack has at most six fields here.
    """
    def names(flag: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(flag, F.col("field"))))

    return agreement.groupBy("pack_id").agg(
        F.max("spread_mm").alias("widest_spread_mm"),
        names(F.col("frames_measured") == 1).alias("single_frame_fields"),
        names(F.col("values_disagreed")).alias("disputed_fields"))
