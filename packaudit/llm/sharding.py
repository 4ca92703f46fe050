"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns VNODES points of a ring; a document belongs to the next point clockwise of its doc_id's hash. No shard takes
more than its share times 1 + SLACK in bytes: what overflows a full shard continues clockwise to the next point of a shard
with room. That law is ``bytes``.

Loads are summed by ring cell in Spark, and only these sums, CELLS numbers whatever the input, reach the driver, where the walk
around the ring fills the shards. A cell in which a shard becomes full is cut again, by the hash of the row's
content and then of its place in the staged table, so a cut is exact to about a row even if one doc_id holds a third
of all rows. Slots are gapless numbers from per-bucket counts plus a rank inside a small bucket.

Defined cases: a null text has size 1 and the checksum of the empty text; null doc_ids share a ring place and are cut like any
other overfull cell; every row gets a shard and slot of its own, repeated or not; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packaudit.session import stage

SHARDS = 16
VNODES = 128
CELLS = 1 << 14
SLACK = 0.002
#: Rows that one task ranks for slots, about.
BUCKET_ROWS = 20_000


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of the virtual nodes. A shard's points do not depend on how many shards there are."""
    def place(s: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


@dataclass
class Walk:
    """Loads of the shards while the ring is walked once, clockwise."""

    points: list[tuple[int, int]]
    capacity: float
    loads: dict[int, float] = field(default_factory=dict)

    def shards_from(self, cell: int):
        """Shards in the order in which a key of this cell meets them, each once."""
        at, seen = bisect.bisect_left(self.points, (cell, -1)), set()
        for k in range(len(self.points)):
            shard = self.points[(at + k) % len(self.points)][1]
            if shard not in seen:
                seen.add(shard)
                yield shard

    def place(self, cell: int, size: int) -> list[tuple[int, float]]:
        """(shard, bytes) parts of a cell; more than one if a shard on the way becomes full."""
        parts, left = [], float(size)
        last = None
        for shard in self.shards_from(cell):
            last = shard
            room = self.capacity - self.loads.get(shard, 0.0)
            if room <= 0:
                continue
            take = min(room, left)
            parts.append((shard, take))
            self.loads[shard] = self.loads.get(shard, 0.0) + take
            left -= take
            if left <= 0:
                break
        if left > 0:  # only by rounding
            parts.append((last, left))
        return parts


def _cut(sums: list[tuple[int, int]], parts: list[tuple[int, float]]) -> tuple[dict[int, int], dict[int, list[tuple[int, float]]]]:
    """Give sub-cells, in order, to the parts: whole ones to a shard, and those on a boundary as parts again."""
    whole, again = {}, {}
    queue = [list(p) for p in parts]
    for sub, size in sums:
        need, got = float(size), []
        while need > 1e-6 and queue:
            take = min(need, queue[0][1])
            if take > 0:
                got.append((queue[0][0], take))
            queue[0][1] -= take
            need -= take
            if queue[0][1] <= 1e-6 and len(queue) > 1:
                queue.pop(0)
            elif queue[0][1] <= 1e-6:
                got.append((queue[0][0], need))
                break
        if len(got) <= 1 or len({s for s, _ in got}) == 1:
            whole[sub] = got[0][0] if got else parts[-1][0]
        else:
            again[sub] = got
    return whole, again


def assign(slim: DataFrame, shards: int, slack: float = SLACK) -> DataFrame:
    """``slim`` with the column ``shard``. It must be staged and have size and the ring keys k1, k2, k3."""
    spark = slim.sparkSession
    sums = {r["k1"]: r["s"] for r in slim.groupBy("k1").agg(F.sum("size").alias("s")).collect()}
    walk = Walk(ring(shards), sum(sums.values()) / shards * (1 + slack))
    whole, parts = {}, {}
    for cell in sorted(sums):
        got = walk.place(cell, sums[cell])
        if len(got) == 1:
            whole[cell] = got[0][0]
        else:
            parts[(cell,)] = got
    tables = [[(cell, s) for cell, s in whole.items()]]
    for depth in (2, 3):
        keys = [f"k{i}" for i in range(1, depth + 1)]
        rows: list[tuple] = []
        again: dict[tuple, list] = {}
        if parts:
            open_ = spark.createDataFrame(list(parts), ", ".join(f"{k} int" for k in keys[:-1]))
            by: dict[tuple, list] = {}
            # At most a boundary per shard and level: a few dozen cells of CELLS numbers.
            for r in slim.join(F.broadcast(open_), keys[:-1], "left_semi").groupBy(*keys).agg(F.sum("size").alias("s")).collect():
                by.setdefault(tuple(r[k] for k in keys[:-1]), []).append((r[keys[-1]], r["s"]))
            for head, subs in by.items():
                done, more = _cut(sorted(subs), parts[head])
                rows += [(*head, sub, s) for sub, s in done.items()]
                for sub, got in more.items():
                    if depth == 3:  # rows that share the finest key go where most of them belong
                        rows.append((*head, sub, max(got, key=lambda g: g[1])[0]))
                    else:
                        again[(*head, sub)] = got
        tables.append(rows)
        parts = again
    out = slim
    for depth, rows in enumerate(tables, 1):
        keys = [f"k{i}" for i in range(1, depth + 1)]
        table = spark.createDataFrame(rows, ", ".join([f"{k} int" for k in keys] + [f"s{depth} int"]))
        out = out.join(F.broadcast(table), keys, "left")
    return out.withColumn("shard", F.coalesce("s1", "s2", "s3")).drop("s1", "s2", "s3")


def slots(placed: DataFrame) -> DataFrame:
    """``placed`` with a gapless ``slot`` from 0 in each shard, in the order of ``h`` and ``row``."""
    rows = placed.count()
    parts = max(64, rows // (BUCKET_ROWS * 4))
    cut = placed.withColumn("b", F.floor((F.col("h") / 2.0 ** 64 + 0.5) * parts).cast("int"))
    sizes = cut.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n"))
    begin = sizes.select("shard", "b", (F.sum("n").over(W.partitionBy("shard").orderBy("b")) - F.col("n")).alias("begin"))
    rank = F.row_number().over(W.partitionBy("shard", "b").orderBy("h", "row"))
    return cut.withColumn("rank", rank).join(begin, ["shard", "b"]).withColumn("slot", F.col("begin") + F.col("rank") - 1)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = stage(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                             F.monotonically_increasing_id().alias("row")), "shards")
    content = F.xxhash64("doc_id", "size", "text_crc32")
    keyed = slim.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int").alias("k1"),
                        F.pmod(content, F.lit(CELLS)).cast("int").alias("k2"),
                        F.pmod(F.xxhash64("row"), F.lit(CELLS)).cast("int").alias("k3"), F.xxhash64("row", "doc_id").alias("h"))
    out = slots(assign(keyed, shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
