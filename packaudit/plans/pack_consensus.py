"""Several frames of each pack to one verdict and one report (entry for multi-frame audits)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions import scan, text as tx
from packaudit.operators import consensus as cs
from packaudit.session import stage

#: Readings of a line of the agreement table.
READINGS = 12


@dataclass
class PackReport:
    """The parts of a merged report, as tables.

    ``packs``: verdict, agreement, number of frames, the best frame and its facts. ``declarations``: one row per pack and
    field. ``readings``: one row per frame that a field's median comes from. ``lines``: the agreement table as text.
    """

    packs: DataFrame
    declarations: DataFrame
    readings: DataFrame
    lines: DataFrame


def _verdicts(merged: DataFrame) -> DataFrame:
    summary = cs.agreement_summary(cs.frame_agreement(merged))
    return cs.consensus_rollup(merged).join(summary, "pack_id", "left")


def audit_packs(rows: DataFrame, frames: DataFrame, model: DataFrame) -> DataFrame:
    """Overall verdict and agreement of each pack."""
    return _verdicts(cs.consensus(rows, frames, model))


def pack_report(rows: DataFrame, frames: DataFrame, model: DataFrame, facts: DataFrame) -> PackReport:
    """The merged report of every pack.

    ``facts`` has one row per pack_id and frame_no with what was found about that capture (calibration, legibility, ...);
    the best frame's row describes the pack, as an average of several captures would describe none of them. A best frame
    without facts leaves them null; a pack without rows is not reported.
    """
    merged = stage(cs.consensus(rows, frames, model), "consensus")
    packs = cs.base_frame(frames)
    best = packs.join(facts.withColumnRenamed("frame_no", "base_frame"), ["pack_id", "base_frame"], "left")
    readings = stage(cs.frame_values(rows), "readings")
    return PackReport(
        _verdicts(merged).join(best, "pack_id"),
        merged.select("pack_id", "field", "ord", "present", "presence_verdict", "value_text", "match_confidence", "values_disagreed",
                      "informational", "frames_present", "frames_measured", "measurement_trusted", _places("measured_mm", 3).alias("measured_mm"),
                      F.when(F.col("frames_measured") > 1, _places("spread_mm", 3)).alias("spread_mm"), "required_mm", "verdict",
                      _places("band_mm", 4).alias("band_mm"), "width_verdict", "reason"),
        readings, agreement_lines(merged, readings))


def _padded(c: Column, width: int) -> Column:
    """Right-aligned, longer text whole."""
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(" "))


def _places(c: str | Column, digits: int) -> Column:
    """Half to even on the value at six decimals, so that the last bit of a median of two readings decides nothing."""
    return tx.round_to(tx.round_to(c, 6), digits)


def _mm(c: str | Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", _places(c, digits))


def agreement_lines(merged: DataFrame, readings: DataFrame) -> DataFrame:
    """The agreement table of packs with two or more frames: pack_id, section, ord, part, text.

    Section 1 has a line per measured declaration, each followed by its readings in frame order, READINGS to a line
    (``part`` counts them), so a pack of any number of frames has bounded lines. Section 2 names disputed declarations,
    section 3 those that one frame alone measured, section 4 the widest spread.
    """
    shown = merged.where((F.col("n_frames") > 1) & (F.col("frames_measured") > 0))
    n, spread = F.col("frames_measured"), F.col("spread_mm")
    head = F.concat(F.rpad("field", 22, " "), F.lit(" "), _padded(n.cast("string"), 4), F.lit("/"), F.col("n_frames").cast("string"),
                    F.lit(" "), _padded(_mm("measured_mm"), 7), F.lit(" mm  "), F.when(n > 1, F.concat(_mm(spread), F.lit(" mm"))).otherwise("one frame"))
    heads = shown.select("pack_id", F.lit(1).alias("section"), "ord", F.lit(0).cast("bigint").alias("part"), head.alias("text"))
    # A pack and field has one row here; the readings of a hot pack meet it under a salt.
    salted = shown.select("pack_id", "field", "ord", F.explode(F.lit(list(range(cs.SALTS)))).alias("_s"))
    laid = scan.laid_out(readings, cs.PACK_FIELD, ["frame_no"], settled=True)
    placed = scan.running(laid, cs.PACK_FIELD, sums={"_no": F.lit(1)}, strict=True)
    cut = placed.select("pack_id", "field", "frame_no", "measured_mm", F.floor(F.col("_no") / READINGS).alias("part"),
                        F.pmod(F.xxhash64("frame_no"), F.lit(cs.SALTS)).cast("int").alias("_s"))
    each = (cut.join(salted, [*cs.PACK_FIELD, "_s"]).groupBy("pack_id", "ord", "part")
            .agg(F.array_sort(F.collect_list(F.struct("frame_no", "measured_mm"))).alias("_r"))
            .select("pack_id", F.lit(1).alias("section"), "ord", (F.col("part") + 1).alias("part"),
                    F.array_join(F.transform("_r", lambda r: _mm(r["measured_mm"])), ", ").alias("text")))
    agreed = cs.agreement_summary(cs.frame_agreement(merged))

    def note(section: int, text: Column, when: Column) -> DataFrame:
        return agreed.where(when).select("pack_id", F.lit(section).alias("section"), F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("part"), text.alias("text"))

    disputed, single = F.array_join("disputed_fields", ", "), F.array_join("single_frame_fields", ", ")
    parts = [each,
             note(2, F.concat(F.lit("photos disagree on the text of: "), disputed, F.lit("; the majority reading counts")), F.size("disputed_fields") > 0),
             note(3, F.concat(F.lit("no second opinion, measured in one photo only: "), single), F.size("single_frame_fields") > 0),
             note(4, F.concat(F.lit("widest spread between photos: "), _mm("widest_spread_mm", 3), F.lit(" mm")), F.col("widest_spread_mm").isNotNull())]
    for p in parts:
        heads = heads.unionByName(p)
    return heads
