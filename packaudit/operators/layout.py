"""Printed-line rebuild, pass choice and word merging."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions import geometry, scan, skew, text as tx
from packaudit.session import stage

BOX_COLS = ["x", "y", "w", "h"]


# ------------------------------------------------------------------ line rebuild
def vertical_bands(words: DataFrame) -> DataFrame:
    """Cut each scan where no printed line can possibly continue.

    A word joins the open line only if its centre is within 0.6 of the larger height.
    The open line's mean never lies above the previous centre, so a gap of 0.6 times
    the largest height seen so far always starts a new line. The bands between such
    gaps are independent and are what later work is spread by. Words are first reduced
    to one row per distinct centre, with their number ``n``; what runs along a scan runs
    over parts of it.
    """
    centre = F.col("y") + F.col("h") / 2.0
    rows = words.where(F.col("scan_id").isNotNull()).groupBy("scan_id", centre.alias("cy")).agg(
        F.max("h").alias("hmax"), F.count(F.lit(1)).alias("n"))
    laid = scan.laid_by_key(rows, ["scan_id"], ["cy"])
    seen = scan.previous(scan.running(laid, ["scan_id"], highs={"reach": F.col("hmax")}), ["scan_id"], {"above": F.col("cy")})
    opens = F.coalesce((F.col("cy") - F.col("above")) >= dims.LINE_TOLERANCE * F.col("reach"), F.lit(True))
    return scan.running(seen.withColumn("opens", opens.cast("int")), ["scan_id"], {"band": F.col("opens")}).select(
        "scan_id", "cy", "band", "n")


class OpenLine:
    """Running mean centre and median height of the line being filled; ``start`` is the place of its first word."""

    def __init__(self, start: int = 0) -> None:
        self.start, self.n, self.total, self.heights = start, 0, 0.0, {}

    def dump(self) -> str:
        return json.dumps([self.start, self.n, self.total, sorted(self.heights.items())])

    @staticmethod
    def load(text: str) -> OpenLine:
        line = OpenLine()
        line.start, line.n, line.total, heights = json.loads(text)
        line.heights = dict(map(tuple, heights))
        return line

    def joined(self, more: OpenLine) -> OpenLine:
        """This line with all words of another."""
        self.n, self.total = self.n + more.n, self.total + more.total
        for h, n in more.heights.items():
            self.heights[h] = self.heights.get(h, 0) + n
        return self

    def add(self, cy: float, h: float) -> None:
        self.n += 1
        self.total += cy
        self.heights[h] = self.heights.get(h, 0) + 1

    def median_height(self) -> float:
        if len(self.heights) == 1:
            return next(iter(self.heights))
        lo, hi, seen, first = (self.n - 1) // 2, self.n // 2, 0, None
        for h in sorted(self.heights):
            seen += self.heights[h]
            if first is None and seen > lo:
                first = h
            if seen > hi:
                return (first + h) / 2.0
        return 0.0

    def takes(self, cy: float, h: float) -> bool:
        return abs(cy - self.total / self.n) < dims.LINE_TOLERANCE * max(self.median_height(), h)


def number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``grp``, the line within its band, to rows sorted by scan, band, centre, word.

    Only the open line is remembered between rows, so a partition streams through.
    """
    line, grp, last = None, 0, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        scan, band = batch.column("scan_id"), batch.column("band")
        fresh = [True] + pc.or_(
            pc.not_equal(scan.slice(1), scan.slice(0, len(scan) - 1)),
            pc.not_equal(band.slice(1), band.slice(0, len(band) - 1))).to_pylist()
        fresh[0] = (scan[0].as_py(), band[0].as_py()) != last
        out = []
        for is_fresh, cy, h in zip(fresh, batch.column("cy").to_pylist(), batch.column("h").to_pylist()):
            if is_fresh:
                line, grp = OpenLine(), 0
            elif not line.takes(cy, h):
                line, grp = OpenLine(), grp + 1
            line.add(cy, h)
            out.append(grp)
        last = (scan[-1].as_py(), band[-1].as_py())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())],
                                         [*batch.schema.names, "grp"])


#: Words of a block of a band that is longer than one.
BLOCK_WORDS = 8192


def line_groups(words: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Words with (band, grp): the printed line each belongs to.

    The running mean and median are sequential, so this one step runs in Python, over
    Arrow batches and per band rather than per scan. Bands of more than ``block`` words
    are cut into blocks that run side by side (``long_bands``).
    """
    cols = ["scan_id", "word_no", "text", *BOX_COLS, "conf"]
    bands = stage(vertical_bands(words), "bands")
    placed = (words.select(*cols).withColumn("cy", F.col("y") + F.col("h") / 2.0)
              .join(bands.select("scan_id", "cy", "band").hint("merge"), ["scan_id", "cy"]).select(*cols, "cy", "band"))
    long_ = bands.groupBy("scan_id", "band").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("scan_id", "band")
    any_long = long_.limit(1).count() > 0
    short = placed.join(long_, ["scan_id", "band"], "left_anti") if any_long else placed
    dealt = short.select(*cols, "cy", "band").repartition("scan_id", "band").sortWithinPartitions("scan_id", "band", "cy", "word_no")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", grp int"
    out = dealt.mapInArrow(number_lines, ddl)
    if not any_long:
        return out
    return out.unionByName(long_bands(placed.join(long_, ["scan_id", "band"], "left_semi").select(*cols, "cy", "band"), block))


def _run_block(rows: pa.Table, line: OpenLine | None) -> tuple[list[int], OpenLine]:
    """Line of each word of a block (the place of its first word), from the line open before, or from a guessed fresh one; and the line open after."""
    out = []
    for at, cy, h in zip(*(rows.column(c).to_pylist() for c in ("pos", "cy", "h"))):
        if line is None or not line.takes(cy, h):
            line = OpenLine(at)
        line.add(cy, h)
        out.append(line.start)
    return out, line


def _entry(entries: pa.Table) -> OpenLine | None:
    line = entries.column("entry")[0].as_py() if entries.num_rows else None
    return OpenLine.load(line) if line else None


def _by_block(rows: DataFrame, entries: DataFrame):
    """Both tables by block, over as many tasks as a shuffle has: these few rows take long, so small partitions must not be put together."""
    keys, tasks = ["scan_id", "band", "blk"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).groupBy(*keys).cogroup(entries.repartition(tasks, *keys).groupBy(*keys))


_TRIED = pa.schema([("blk", pa.int64()), ("entry", pa.string()), ("exit", pa.string()), ("total", pa.string()), ("through", pa.bool_())])


def _try_blocks(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per block: the line it was entered with, the line it leaves open, all its words as one line, and whether it began no other line."""
    scan_type = rows.schema["scan_id"].dataType.simpleString()

    def run(key, words: pa.Table, entries: pa.Table) -> pa.Table:
        words = words.sort_by("pos")
        if words.num_rows == 0:
            return pa.table({"scan_id": pa.array([], words.schema.field("scan_id").type), "band": pa.array([], pa.int64())}).append_column(
                "blk", pa.array([], pa.int64()))
        line = _entry(entries)
        entered = line.dump() if line else None
        starts, line = _run_block(words, line)
        total = OpenLine(words.column("pos")[0].as_py())
        for cy, h in zip(words.column("cy").to_pylist(), words.column("h").to_pylist()):
            total.add(cy, h)
        through = starts[0] == starts[-1]
        data = {"blk": [words.column("blk")[0].as_py()], "entry": [entered], "exit": [line.dump()], "total": [total.dump()], "through": [through]}
        return pa.table({"scan_id": words.column("scan_id").slice(0, 1), "band": words.column("band").slice(0, 1),
                         **{f.name: pa.array(data[f.name], f.type) for f in _TRIED}})

    return _by_block(rows, entries).applyInArrow(
        run, f"scan_id {scan_type}, band long, blk long, entry string, exit string, total string, through boolean")


def _stitch(tried: DataFrame) -> DataFrame:
    """Entry of each block, from what the blocks before it leave open, and whether the block was entered so.

    Up to the first block that was entered otherwise, entries are final; beyond, they are the best guess: a block that began no other line passes
    the open one on with its own words added, any other leaves open what it left before.
    """
    scan_type = tried.schema["scan_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("blk")
        state, entries, settled = None, [], []
        for entered, left, total, through in zip(*(table.column(c).to_pylist() for c in ("entry", "exit", "total", "through"))):
            entries.append(state)
            settled.append(entered == state)
            if entered != state and through:
                state = OpenLine.load(state).joined(OpenLine.load(total)).dump()
            else:
                state = left
        return table.select(["scan_id", "band", "blk"]).append_column("entry", pa.array(entries, pa.string())).append_column(
            "settled", pa.array(settled, pa.bool_()))

    return tried.groupBy("scan_id", "band").applyInArrow(run, f"scan_id {scan_type}, band long, blk long, entry string, settled boolean")


def long_bands(words: DataFrame, block: int) -> DataFrame:
    """``words`` (scan_id, band, word_no, cy, h and others) with ``grp``, the same as one pass over each band would give.

    Every block first runs as if a fresh line began at its first word. The lines that blocks leave open are handed on along the band, and blocks
    that were entered with another line run again, until each was entered with what the one before it left open. Two runs over the same words
    agree from the first line start that they share, so few blocks run more than twice.
    """
    keys = ["scan_id", "band"]
    laid = scan.laid_out(words.withColumn("band", F.col("band").cast("long")), keys, ["cy", "word_no"])
    placed = scan.running(laid, keys, {"pos": F.lit(1)}, strict=True).withColumn("pos", F.col("pos").cast("long"))
    placed = stage(placed.withColumn("blk", F.floor(F.col("pos") / block)).drop("_at", "_part"), "blocks")
    rows = placed.select(*keys, "blk", "pos", "cy", "h")
    none = rows.select(*keys, "blk", F.lit(None).cast("string").alias("entry")).limit(0)
    tried = stage(_try_blocks(rows, none), "tried")
    while True:
        stitched = stage(_stitch(tried), "stitched")
        open_ = stitched.where("not settled").select(*keys, "blk", "entry")
        if open_.limit(1).count() == 0:
            break
        again = _try_blocks(rows.join(open_.select(*keys, "blk"), [*keys, "blk"], "left_semi"), open_)
        tried = stage(tried.join(open_.select(*keys, "blk"), [*keys, "blk"], "left_anti").select(*again.columns).unionByName(again), "tried")
    kept = placed.columns

    def number(key, words: pa.Table, entries: pa.Table) -> pa.Table:
        words = words.sort_by("pos")
        starts, _ = _run_block(words, _entry(entries))
        return words.select(kept).append_column("grp", pa.array(starts, pa.int32()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields) + ", grp int"
    by = [*keys, "blk"]
    out = _by_block(placed, stitched.select(*by, "entry")).applyInArrow(number, ddl)
    return out.select(*words.columns, "grp")


_GROUP = ["scan_id", "band", "grp"]
_IN_LINE = ["x", "cy", "word_no"]


def split_columns(grouped: DataFrame) -> DataFrame:
    """Start a new run at a gap wider than six median heights.

    The words of a group are laid out in parts, which ``line_spans`` goes on with (columns _at, _part), so a line of any
    length spreads over tasks.
    """
    laid = scan.laid_by_key(grouped, _GROUP, _IN_LINE)
    before = scan.previous(laid, _GROUP, {"_right": F.col("x") + F.col("w")})
    if scan.whole(laid):
        # Each group lies in one task, of KEY_ROWS words at most: its median is taken there.
        with_median = before.withColumn("_med", F.percentile("h", 0.5).over(W.partitionBy(*_GROUP)))
    else:
        # Joined part by part: a hot group's words stay where they are.
        medians = skew.percentiles(laid, _GROUP, "h", {"_med": 0.5})
        with_median = before.join(laid.select(*_GROUP, "_part").distinct().join(medians, _GROUP), [*_GROUP, "_part"])
    cut = F.coalesce((F.col("x") - F.col("_right") > dims.COLUMN_GAP * F.col("_med")).cast("int"), F.lit(0))
    marked = with_median.withColumn("_cut", cut)
    return scan.running(marked, _GROUP, {"run": F.col("_cut")}).drop("_cut", "_med", "_right")


def spanned_words(runs: DataFrame) -> DataFrame:
    """Words with their char span [s, e) in their printed line's text."""
    laid = runs if "_at" in runs.columns else scan.laid_by_key(runs, [*_GROUP, "run"], _IN_LINE)
    ran = scan.running(laid, [*_GROUP, "run"], {"s": F.length("text") + 1}, strict=True)
    return ran.withColumn("s", F.col("s").cast("int")).withColumn("e", (F.col("s") + F.length("text")).cast("int")).drop("_at", "_part")


def line_spans(runs: DataFrame) -> DataFrame:
    """One row per printed line with its text, box and words with char spans.

    Lines are numbered from 0 by top, then left. ``spanned_words`` gives the same spans with a row per word.
    """
    keys = [*_GROUP, "run"]
    spanned = spanned_words(runs)
    word = F.struct("s", "e", "text", *BOX_COLS, "conf")
    lines = (spanned.groupBy(*keys)
             .agg(F.sort_array(F.collect_list(word)).alias("words"), *bbox_agg())
             .withColumn("text", F.concat_ws(" ", F.transform("words", lambda v: v["text"]))))
    order = [F.col(c) for c in ("y", "x", "band", "grp", "run")]
    numbered = skew.ranked(lines, ["scan_id"], F.floor(F.col("y") / 256), order, "line_no")
    return numbered.select("scan_id", (F.col("line_no") - 1).alias("line_no"), "text", *BOX_COLS, "words")


def rebuild_lines(words: DataFrame) -> DataFrame:
    """Word boxes to printed lines."""
    # Grouped words are counted and then laid out: written once, the bands are not joined and numbered again for each.
    return line_spans(split_columns(stage(line_groups(words), "line-groups")))


def bbox_agg(prefix: str = "") -> list[Column]:
    """Aggregates for the box around a group of boxes."""
    x, y, w, h = (F.col(prefix + c) for c in BOX_COLS)
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + w) - F.min(x)).alias("w"),
            (F.max(y + h) - F.min(y)).alias("h")]


def words_for_span(words: Column, a: Column, b: Column) -> Column:
    """Words of a line that overlap the char span [a, b) (P5)."""
    return F.filter(words, lambda v: (v["s"] < b) & (v["e"] > a))


def offset_boxes(df: DataFrame, ox: Column, oy: Column) -> DataFrame:
    """Shift boxes by a crop offset."""
    return df.withColumns({"x": F.col("x") + ox, "y": F.col("y") + oy})


# ---------------------------------------------------------------- recognition passes
def score_passes(words: DataFrame) -> DataFrame:
    """Confident characters per pass; the lower bar for all passes when each scores 0."""
    n = F.length("text")

    def scored(bar: float) -> Column:
        return F.coalesce(F.sum(F.when((F.col("conf") >= bar) & (n >= dims.SCORE_MIN_CHARS), n)), F.lit(0))

    per = words.groupBy("scan_id", "pass_no").agg(
        scored(dims.SCORE_MIN_CONF).alias("_hi"), scored(dims.FALLBACK_MIN_CONF).alias("_lo"))
    top = F.max("_hi").over(W.partitionBy("scan_id"))
    return per.select("scan_id", "pass_no", F.when(top == 0, F.col("_lo")).otherwise(F.col("_hi")).alias("score"))


def pick_pass(scores: DataFrame, margin: float = dims.SCORE_MARGIN) -> DataFrame:
    """First pass in order unless a later one beats the holder by the margin."""
    ordered = F.sort_array(F.collect_list(F.struct("pass_no", F.col("score").cast("double").alias("score"))))
    fold = F.aggregate(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.get("_s", F.lit(0)),
                       lambda held, c: F.when(c["score"] > held["score"] * margin, c).otherwise(held))
    return (scores.groupBy("scan_id").agg(ordered.alias("_s"))
            .select("scan_id", fold.alias("_p"))
            .select("scan_id", F.col("_p.pass_no").alias("primary_pass"), F.col("_p.score").alias("score")))


def _cells(size: int) -> Column:
    """Grid cells a box touches, as one integer pair per row."""
    def steps(at: str, extent: str) -> Column:
        lo = F.floor(F.col(at) / size)
        return F.sequence(lo, F.greatest(lo, F.floor((F.ceil(F.col(at) + F.greatest(F.col(extent), F.lit(1))) - 1) / size)))
    return F.flatten(F.transform(steps("x", "w"), lambda cx: F.transform(
        steps("y", "h"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def _overlaps(a: Column, b: Column) -> Column:
    return (geometry.iou(a, b) >= dims.MERGE_IOU) | (geometry.covered(a, b) >= dims.MERGE_COVER)


_WORD = ["scan_id", "pass_no", "word_no"]


def merge_candidates(words: DataFrame, primary: DataFrame, cell: int = 64) -> DataFrame:
    """Confident words of other passes on ground the primary pass left blank (P10, stage 1).

    A word is named by scan, pass and number. Boxes meet by grid cell: a window gives each word the different boxes that the primary
    pass has in its cell. Cells and words are parts of a scan, so words that are dealt out by scan are not moved again.
    """
    tagged = words.join(primary.select("scan_id", "primary_pass").hint("shuffle_hash"), "scan_id")
    mine = F.col("pass_no") == F.col("primary_pass")
    celled = tagged.where(mine | (F.col("conf") >= dims.MERGE_MIN_CONF)).select(
        *words.columns, mine.alias("_mine"), F.explode(_cells(cell)).alias("_cell"))
    box = F.struct(*BOX_COLS)
    ground = F.collect_set(F.when(F.col("_mine"), box)).over(W.partitionBy("scan_id", "_cell"))
    met = celled.select(*words.columns, "_mine", ground.alias("_ground")).where(~F.col("_mine")).withColumn(
        "_taken", F.exists("_ground", lambda b: _overlaps({c: F.col(c) for c in BOX_COLS}, b)))
    rest = [c for c in words.columns if c not in _WORD]
    return (met.groupBy(*_WORD).agg(F.max("_taken").alias("_taken"), *[F.first(c).alias(c) for c in rest])
            .where(~F.col("_taken")).select(*words.columns))


def conflicts(candidates: DataFrame, cell: int = 64) -> DataFrame:
    """Pairs (later, earlier) of a scan's candidates, by pass and word, of which the earlier one, if kept, keeps the later one out.

    Boxes meet by grid cell; a pair counts in the cell where its intersection begins, so once.
    """
    word = F.struct(F.struct("pass_no", "word_no").alias("o"), *BOX_COLS)
    celled = candidates.select("scan_id", word.alias("a"), F.explode(_cells(cell)).alias("cell"))
    before = W.partitionBy("scan_id", "cell").orderBy("a.o").rowsBetween(W.unboundedPreceding, -1)

    def meets(b: Column) -> Column:
        begins = [F.floor(F.greatest(F.col(f"a.{c}"), b[c]) / cell) for c in ("x", "y")]
        return (F.col("cell.cx") == begins[0]) & (F.col("cell.cy") == begins[1]) & _overlaps({c: F.col(f"a.{c}") for c in BOX_COLS}, b)

    pairs = celled.withColumn("seen", F.collect_list("a").over(before)).select(
        "scan_id", F.col("a.o").alias("later"), F.explode(F.filter("seen", meets)).alias("b"))
    return pairs.select("scan_id", "later", F.col("b.o").alias("earlier"))


def admit_in_order(candidates: DataFrame) -> DataFrame:
    """Greedy choice among surviving words, in pass then word order (P10, stage 2).

    Of words with the very same box only the first can be kept. Among the others, the choice is the independent set that comes first in that
    order, found in rounds over the pairs in conflict: a word with no open conflict before it stays, what it keeps out goes, and pairs of
    words that are decided are dropped. A round decides all such words of all scans at once, however large a scan or a band of one is.
    """
    o = F.struct("pass_no", "word_no")
    solid = F.when((F.col("w") <= 0) | (F.col("h") <= 0), o)  # empty boxes overlap nothing
    rest = [c for c in candidates.columns if c not in ("scan_id", "pass_no", "word_no", *BOX_COLS)]
    first = candidates.groupBy("scan_id", *BOX_COLS, solid.alias("_solid")).agg(
        F.min(o).alias("_o"), *[F.min_by(c, o).alias(c) for c in rest]).select("scan_id", "_o.*", *BOX_COLS, *rest).select(*candidates.columns)
    first = stage(first, "candidates")
    edges = stage(conflicts(first), "conflicts")

    def words_of(pairs: DataFrame, side: str, name: str = "o") -> DataFrame:
        return pairs.select("scan_id", F.col(side).alias(name)).distinct()

    out = words_of(edges, "later").limit(0)
    while edges.limit(1).count() > 0:
        free = words_of(edges, "earlier").join(words_of(edges, "later"), ["scan_id", "o"], "left_anti")
        by_free = free.withColumnRenamed("o", "earlier")
        decided = stage(words_of(edges.join(by_free, ["scan_id", "earlier"], "left_semi"), "later"), "kept-out")
        out = out.unionByName(decided)
        edges = stage(edges.join(by_free, ["scan_id", "earlier"], "left_anti")
                      .join(decided.withColumnRenamed("o", "later"), ["scan_id", "later"], "left_anti")
                      .join(decided.withColumnRenamed("o", "earlier"), ["scan_id", "earlier"], "left_anti"), "conflicts")
    return first.join(out.select("scan_id", "o.*"), _WORD, "left_anti")


def merge_passes(words: DataFrame) -> DataFrame:
    """Primary pass plus the words only other passes found."""
    primary = pick_pass(score_passes(words))
    kept = words.join(primary.withColumnRenamed("primary_pass", "pass_no").select("scan_id", "pass_no").hint("shuffle_hash"),
                      ["scan_id", "pass_no"], "left_semi")
    return kept.unionByName(admit_in_order(merge_candidates(words, primary)).select(*kept.columns))


def mean_conf(scans: DataFrame, words: DataFrame) -> DataFrame:
    """Mean word confidence per scan, 0 for a scan without words."""
    avg = words.groupBy("scan_id").agg(F.avg("conf").alias("_c"))
    return scans.select("scan_id").join(avg, "scan_id", "left").select(
        "scan_id", F.coalesce("_c", F.lit(0.0)).alias("mean_conf"))


# ------------------------------------------------------------------- rows and regions
def chars_in_roi(chars: DataFrame, rois: DataFrame) -> DataFrame:
    """Characters that touch a field box (P14). A scan has at most six boxes, which are hashed, so that characters are not sorted."""
    r = rois.select("scan_id", "field", *[F.col(c).alias("r" + c) for c in BOX_COLS]).hint("shuffle_hash")
    return (chars.join(r, "scan_id")
            .where((F.col("x") < F.col("rx") + F.col("rw")) & (F.col("x") + F.col("w") > F.col("rx"))
                   & (F.col("y") < F.col("ry") + F.col("rh")) & (F.col("y") + F.col("h") > F.col("ry")))
            .drop("rx", "ry", "rw", "rh"))


def digit_rows(lines: DataFrame) -> DataFrame:
    """Lines that are mostly digits."""
    return lines.where(tx.is_digit_row(F.col("text")))


def pair_with_truth(rows: DataFrame, truth: DataFrame, order: list[str] | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Pair a scan's rows, top to bottom, with the truth rows.

    Returns (pairs, skipped scans with the count found and the count wanted). The truth
    table is the printed sheet, a few rows.
    """
    wanted = truth.agg(F.count(F.lit(1)).alias("wanted"))
    found = rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("found")).crossJoin(F.broadcast(wanted))
    ok = found.where(F.col("found") == F.col("wanted")).select("scan_id")
    usable = rows.join(ok, "scan_id", "left_semi")
    numbered = skew.ranked(usable, ["scan_id"], F.floor(F.col("y") / 256),
                           [F.col(c) for c in (order or ["y", "line_no"])], "row_no")
    return (numbered.join(F.broadcast(truth), "row_no"),
            found.where(F.col("found") != F.col("wanted")))
