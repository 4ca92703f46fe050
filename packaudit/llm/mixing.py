"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Sources in order of their names (by code point, null last) weigh WEIGHTS in turn and share SHARE of all words. A target stops at MOST
times its source's words, and the excess goes to the others by weight. With sources sorted by the share at which each stops, running sums give
the one level at which the targets add up.

Rates of documents: of all rates r within 0 to MOST whose words r * size add up to the source's target, those of least sum of r ln r - r.
Its dual has one number a source: r = min(MOST, exp(tilt * size / mean size)), and convex duals of all sources are solved together by Newton
steps on the logarithm of the words that a tilt yields, kept within a bracket. A step is one aggregate over counted
(source, size) rows; no more than the yes or no of convergence reaches the driver. Sums are taken over decimals, so that they do not depend on
the order of rows, and reruns agree.

Rounding into copies: along the documents of a source by size, a document takes one copy more whenever the running sum of the rates' fractions
passes a whole number; this leaves a source within about one document of its target. What is still missing is taken as a part of a
further copy, and what is too much is cut from one, from the largest documents on, so that the words taken are the rounded target.

Defined cases: a null text has size 0 and takes 0; a source without words has target 0; null sources are one source, the last; repeated
rows are documents of their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.functions.scan import laid_out, positions, running
from packaudit.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words by which the tilted sum may miss a target, and the largest number of steps.
MISS, STEPS = 0.25, 200
#: Fractions of a rate are counted in these units.
UNIT = 1_000_000
_SUM = "decimal(38,9)"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size and the source's key of every document, staged; the key is never null and sorts like the source, null last."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    return stage(docs.select("doc_id", words.alias("size"), key.alias("key")), "sizes")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, source_size, most_size and target of every source of (key, source_size)."""
    numbered = positions(laid_out(sources, [], ["key"], settled=True), "i").select("key", "source_size", "i")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    weighed = (numbered.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
               .withColumn("full", F.col("cap") / F.col("w")))
    along = running(laid_out(weighed, [], ["full", "key"], settled=True), [], {"caps": F.col("cap"), "used": F.col("w")})
    whole = along.agg(F.sum("w").alias("w_all"), (F.sum("source_size") * share).alias("goal"))
    placed = along.crossJoin(F.broadcast(whole))  # one row
    # A source stops if, at its own level, the targets would not add up to more than the goal.
    stops = F.col("caps") - F.col("cap") + F.col("full") * (F.col("w_all") - F.col("used") + F.col("w")) <= F.col("goal")
    judged = placed.withColumn("stops", stops)
    level = judged.agg(
        F.first("goal").alias("goal"), F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))), F.lit(0.0)).alias("gone"),
        F.sum(F.when(~F.col("stops"), F.col("w"))).alias("rest"))
    each = (F.col("goal") - F.col("gone")) / F.col("rest")
    return (judged.select("key", "source_size", "w", "cap", "stops").crossJoin(F.broadcast(level))  # one row
            .select("key", "source_size", F.col("cap").alias("most_size"),
                    F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("w") * each)).alias("target")))


def _words(tilt: Column, most: float) -> tuple[Column, Column]:
    """Sums over counted sizes: words at a tilt, and their slope."""
    open_ = F.exp(F.least(tilt * F.col("z"), F.lit(1.0)))
    words = F.col("n") * F.col("size") * F.least(open_, F.lit(float(most)))
    slope = F.when(open_ < most, words * F.col("z")).otherwise(0.0)
    return (F.sum(words.cast(_SUM)).cast("double"), F.sum(slope.cast(_SUM)).cast("double"))


def tilts(counted: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """key, tilt, mean of every source with words to take that does not stop at its most, of counted sizes (key, size, n) and the targets.

    A tilt is found between 0 and the one at which every document would be at or beyond what the target asks.
    """
    counted = counted.where("size > 0")
    shape = counted.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    ratio = F.col("target") / F.col("source_size")
    far = F.when(ratio < 1, F.ln(ratio)).otherwise(F.ln(F.lit(float(most)))) * F.col("mean") / F.col("least")
    begin = (goals.where("target > 0 and target < most_size").join(shape, "key")
             .select("key", "mean", "target", F.least(far, F.lit(0.0)).alias("lo"), F.greatest(far, F.lit(0.0)).alias("hi"),
                     F.ln(ratio).alias("tilt")))
    state = stage(begin.withColumn("done", F.lit(False)), "tilts")
    for _ in range(STEPS):
        open_ = state.where("not done")
        if open_.limit(1).count() == 0:
            break
        words, slope = _words(F.col("tilt"), most)
        got = (counted.join(open_, "key").withColumn("z", F.col("size") / F.col("mean"))
               .groupBy("key").agg(words.alias("got"), slope.alias("slope")))
        step = F.col("tilt") - F.ln(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        lo = F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        near = (F.abs(F.col("got") - F.col("target")) <= MISS) | (hi - lo <= 1e-13 * F.greatest(F.abs(lo), F.abs(hi)))
        moved = (open_.join(got, "key")
                 .select("key", "mean", "target", lo.alias("lo"), hi.alias("hi"), F.col("tilt").alias("was"), near.alias("done"), step.alias("step"))
                 .select("key", "mean", "target", "lo", "hi", F.when(F.col("done"), F.col("was")).when(
                     (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step"))
                     .otherwise((F.col("lo") + F.col("hi")) / 2).alias("tilt"), "done"))
        state = stage(state.where("done").unionByName(moved), "tilts")
    return state.select("key", "tilt", "mean")


def rates(slim: DataFrame, goals: DataFrame, solved: DataFrame, most: float = MOST) -> DataFrame:
    """Documents with their source's size and target, and rate, in UNIT parts of a copy."""
    both = goals.join(solved, "key", "left")
    rate = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(1.0))), F.lit(float(most)))
    full = F.col("target") >= F.col("most_size")
    return (slim.join(both, "key")
            .withColumn("rate", F.when((F.col("size") == 0) | (F.col("target") <= 0), 0).when(full, most * UNIT)
                        .otherwise(F.round(rate * UNIT)).cast("long"))
            .select("doc_id", "key", "size", "source_size", "target", "rate"))


def copies(rated: DataFrame, most: float = MOST) -> DataFrame:
    """Documents with ``taken``: whole copies along the running sum of the rates' fractions, then the rest of each target."""
    laid = laid_out(rated.withColumn("h", F.xxhash64("doc_id")), ["key"], ["size", "h", "doc_id"], settled=True)
    part = F.col("rate") % UNIT
    along = running(laid, ["key"], {"upto": part})
    half = UNIT // 2
    whole = (F.col("rate") - part) / UNIT + F.floor((F.col("upto") + half) / UNIT) - F.floor((F.col("upto") - part + half) / UNIT)
    first = stage(along.withColumn("taken", (F.least(whole, F.lit(most)) * F.col("size")).cast("long")).drop("upto"), "copies")
    lack = first.groupBy("key").agg(F.sum("taken").alias("sum"), F.sum(F.col("size") * most - F.col("taken")).alias("rooms"), F.first("target").alias("t"))
    lack = lack.select("key", (F.round("t") - F.col("sum")).cast("long").alias("lack"), F.col("sum").alias("takens"), "rooms")
    ran = running(first, ["key"], {"room_upto": F.col("size") * most - F.col("taken"), "taken_upto": F.col("taken")})
    after = ran.join(lack, "key")
    # From the largest document on: what those after this one leave over, as far as this one goes.
    more = F.least(F.col("size") * most - F.col("taken"), F.greatest(F.col("lack") - (F.col("rooms") - F.col("room_upto")), F.lit(0)))
    less = F.least(F.col("taken"), F.greatest(-F.col("lack") - (F.col("takens") - F.col("taken_upto")), F.lit(0)))
    taken = F.col("taken") + F.when(F.col("lack") >= 0, more).otherwise(-less)
    return after.select("doc_id", "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    slim = sizes(docs)
    counted = stage(slim.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "counted")
    sources = counted.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = stage(targets(sources, weights, share, most), "targets")
    rated = rates(slim, goals, tilts(counted, goals, most), most)
    return copies(rated, most).select("doc_id", "size", "source_size", "target", "taken")
