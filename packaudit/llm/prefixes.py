"""Prefix trie of conversations, by union-find over the common prefixes of neighbours in sort order.

Turns are numbered by a running count over their sort, so a conversation of any length spreads over many tasks; of a turn only a digest of
role and text and the words of the text go on. A conversation is cut into segments of SEGMENT turns; a segment belongs to the group of conversations
that agree in all turns before it, named by a 128-bit hash. So the trie is made of small tries, one a group, no key is longer
than a segment, and the deepest turn costs no more rounds than the first.

Segments are sorted as whole (group, key, conv_id) and numbered without gaps. Blocks of BLOCK neighbours each build their own forest: every row
starts as a tree of its own, the edges between neighbours, whose depth is the length of their common prefix, are taken in descending depth, and
each merge of two components makes or joins a branching node; nodes between two branchings are listed as a component rises. A
node within the block is final. One that goes on in the next block is contracted to a row of partial sums, and partial rows of a node are
merged over all blocks. Everything summed is a sum over rows, given each row's common prefix with the rows before and after it
in the whole order: a row opens the nodes deeper than its common prefix with the row before; a leaf is a row that the next does not extend; saved tokens
are the words that a row shares with the row before.

A list of members that end at a node is hashed where it is whole; one that goes over several blocks is streamed, in pieces of a block, through
one hash, as SHA-256 needs; only such pieces meet in a task, one after the other.

Defined cases: turns of equal number go by the digest of role and text, so repeated rows are turns of their own; rows without conv_id
belong to no conversation and give nothing; null role or text is empty; a conversation left without turns is a member of the
root; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packaudit.functions.scan import laid_out, positions, running
from packaudit.session import stage

SEGMENT = 128
BLOCK = 2048
#: Conversations of a family share their first conversation's opening turns, LENT at most.
FAMILY, LENT = 20, 3
#: Characters of a turn's digest.
DIGEST = 32
#: Member ids in a piece of a list.
PIECE = 512


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, _part, rank, digest, words) in order, and the parts (conv_id, _part, n) that hold a conversation's turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"))
    laid = laid_out(turns, ["conv_id"], ["turn", "digest"])
    ranked = running(laid, ["conv_id"], {"rank": F.lit(1)}).withColumn("rank", F.col("rank") - 1)
    return (stage(ranked.select("conv_id", "_part", "rank", "digest", "words"), "turns"),
            laid.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("n")))


def rebuilt(conversations: DataFrame, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, digest, words) of the rebuilt conversations, at from 0, and every conversation's (conv_id, total) turns."""
    turns, parts = numbered_turns(conversations)
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("rank") < LENT)).select(F.col("conv_id").alias("base"), "rank", "digest", "words")
    lent = heads.groupBy("base").agg(F.count(F.lit(1)).alias("has"))
    h = F.crc32(F.col("conv_id").cast("string")) % (LENT + 1)
    convs = stage(own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
                  .join(lent, "base", "left").withColumn("k", F.least("h", F.coalesce("has", F.lit(0))))
                  .withColumn("total", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    # Joined by part, so that a long conversation's turns stay spread.
    known = parts.select("conv_id", "_part").join(convs, "conv_id").select("conv_id", "_part", "h", "k")
    rest = (turns.join(known, ["conv_id", "_part"]).where("rank >= h")
            .select("conv_id", (F.col("k") + F.col("rank") - F.col("h")).alias("at"), "digest", "words"))
    opening = (convs.where("k > 0").join(heads, "base").where("rank < k")
               .select("conv_id", F.col("rank").alias("at"), "digest", "words"))
    return opening.unionByName(rest), convs.select("conv_id", "total")


def segments(turns: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """seg, grp, key (digests end to end), conv_id, words (per turn) and total of each segment; the last of a conversation is never full."""
    filled = (turns.groupBy("conv_id", F.floor(F.col("at") / size).alias("seg"))
              .agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words"))).alias("t")))  # at most ``size`` turns
    filled = filled.select("conv_id", "seg", F.array_join(F.transform("t", lambda t: t["digest"]), "").alias("key"),
                           F.transform("t", lambda t: t["words"]).alias("words"))
    last = convs.where(F.col("total") % size == 0).select(
        "conv_id", (F.col("total") / size).cast("long").alias("seg"), F.lit("").alias("key"), F.array().cast("array<int>").alias("words"))
    all_ = stage(filled.unionByName(last).join(convs, "conv_id"), "segments")
    # One narrow row for each full segment.
    full = all_.where((F.col("seg") + 1) * size <= F.col("total")).select(
        "conv_id", (F.col("seg") + 1).alias("seg"), F.xxhash64("seg", "key").alias("x"), F.xxhash64(F.lit("other"), "key", "seg").alias("y"))
    upto = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, 0)
    named = full.select("conv_id", "seg", F.concat(F.hex(F.bit_xor("x").over(upto)), F.lit("."), F.hex(F.bit_xor("y").over(upto))).alias("grp"))
    columns = ["seg", "grp", "key", "conv_id", "words", "total"]
    return (all_.where("seg = 0").withColumn("grp", F.lit("")).select(*columns)
            .unionByName(all_.where("seg > 0").join(named, ["conv_id", "seg"]).select(*columns)))


def common(a: str, b: str) -> int:
    """Leading turns that two keys share."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid * DIGEST] == b[:mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """Rows by block of consecutive ``pos``; those at an edge also go to the neighbouring block."""
    home = F.floor(F.col("pos") / block)
    near = F.array_distinct(F.array(home, F.floor((F.col("pos") + 1) / block), F.greatest(F.floor((F.col("pos") - 1) / block), F.lit(0))))
    return rows.withColumn("blk", F.explode(near))


def neighbours(placed: DataFrame, block: int) -> DataFrame:
    """Rows with ``lcp`` and ``nxt``, the turns shared with the row before and after in their group; -1 where that row is of another group."""
    columns = placed.columns
    kinds = {"seg": pa.int64(), "grp": pa.string(), "key": pa.string(), "conv_id": pa.int64(), "words": pa.list_(pa.int32()),
             "total": pa.int64(), "pos": pa.int64(), "lcp": pa.int32(), "nxt": pa.int32()}
    schema = pa.schema([(c, kinds[c]) for c in [*columns, "lcp", "nxt"]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        blk = table.column("blk")[0].as_py()
        seg, grp, key, pos = (table.column(c).to_pylist() for c in ("seg", "grp", "key", "pos"))
        shared = [-1] + [common(key[i - 1], key[i]) if (seg[i - 1], grp[i - 1]) == (seg[i], grp[i]) else -1 for i in range(1, len(key))] + [-1]
        mine = [i for i in range(len(pos)) if pos[i] // block == blk]
        kept = table.select(columns).take(pa.array(mine, pa.int64()))
        return (kept.append_column("lcp", pa.array([shared[i] for i in mine], pa.int32()))
                .append_column("nxt", pa.array([shared[i + 1] for i in mine], pa.int32())).cast(schema))

    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'array<int>' if f.name == 'words' else 'int' if f.type == pa.int32() else 'long'}"
                    for f in schema)
    return _blocked(placed, block).groupBy("blk").applyInArrow(run, ddl)


def beyond(rows: DataFrame, size: int) -> DataFrame:
    """pos with leaf, later and opens: what later segments of the same conversation add to a row.

    leaf: 1 if the conversation is the one that stands for a leaf; later: words shared in later segments; opens: 1 if the next segment
    opens a node below this segment's last.
    """
    last = (F.col("seg") + 1) * size > F.col("total")
    leaf = (last & (F.col("nxt") < F.size("words"))).cast("long")
    shared = F.coalesce(F.aggregate(F.slice("words", 1, F.greatest("lcp", F.lit(0))), F.lit(0).cast("long"), lambda a, w: a + w), F.lit(0))
    long_ = rows.where(F.col("total") >= size).select("pos", "conv_id", "seg", leaf.alias("leaf"), shared.alias("shared"),
                                                      ((F.size("words") > 0) & (F.col("lcp") < 1)).cast("long").alias("first"))
    ahead = W.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy("conv_id").orderBy("seg")
    summed = long_.select("pos", F.greatest("leaf", F.coalesce(F.max("leaf").over(ahead), F.lit(0))).alias("leaf"),
                          F.coalesce(F.sum("shared").over(ahead), F.lit(0)).alias("later"), F.coalesce(F.lead("first").over(order), F.lit(0)).alias("opens"))
    short = rows.where(F.col("total") < size).withColumns({"leaf": leaf, "later": F.lit(0).cast("long"), "opens": F.lit(0).cast("long")})
    return short.unionByName(rows.where(F.col("total") >= size).join(summed, "pos").select(*short.columns))


class Forest:
    """The tries of the groups of one block: a union-find whose components rise from their rows to their roots."""

    def __init__(self, block: dict[str, list], size: int) -> None:
        self.rows, self.size = block, size
        m = len(block["pos"])
        self.root = list(range(m))
        self.lo, self.hi = list(range(m)), list(range(m))
        self.top = [len(w) for w in block["words"]]
        self.n = [1] * m
        self.least = list(block["conv_id"])
        self.leaves, self.below, self.children = list(block["leaf"]), list(block["later"]), list(block["opens"])
        self.pending: list[list[int]] = [[] for _ in range(m)]
        #: Nodes: [depth, first row, last row, least member, members, children, leaves, saved, parent]
        self.nodes: list[list] = []
        edges = [i for i in range(1, m) if block["lcp"][i] >= 0]
        for i in sorted(edges, key=lambda i: -block["lcp"][i]):
            self._merge(self._find(i - 1), self._find(i), block["lcp"][i])
        for c in range(m):
            if self.root[c] == c:
                self._rise(c, -1)

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _rise(self, c: int, depth: int) -> None:
        """List the component's nodes deeper than ``depth``; what stands at ``depth`` then is its own node or a branching to be."""
        words, opened = self.rows["words"][self.lo[c]], self.rows["lcp"][self.lo[c]]
        while self.top[c] > depth:
            t = self.top[c]
            if t:
                self.below[c] += words[t - 1] * (self.n[c] - 1 + (opened >= t))
            for child in self.pending[c]:
                self.nodes[child][8] = len(self.nodes)
            self.pending[c] = [len(self.nodes)]
            self.nodes.append([t, self.lo[c], self.hi[c], self.least[c], self.n[c], self.children[c], self.leaves[c], self.below[c], -1])
            self.top[c], self.children[c] = t - 1, int(opened < t)

    def _merge(self, a: int, b: int, depth: int) -> None:
        self._rise(a, depth)
        self._rise(b, depth)
        if len(self.pending[a]) < len(self.pending[b]):
            self.pending[a], self.pending[b] = self.pending[b], self.pending[a]
        self.pending[a] += self.pending[b]
        self.pending[b] = []
        self.root[b] = a  # b lies right of a
        self.hi[a] = self.hi[b]
        self.least[a] = min(self.least[a], self.least[b])
        for sums in (self.n, self.leaves, self.below, self.children):
            sums[a] += sums[b]

    def listed(self) -> Iterator[tuple]:
        """Rows of NODES."""
        r, m = self.rows, len(self.rows["pos"])
        ids = [self._name(v) if self._open(v) else None for v in self.nodes]
        for v, name in zip(self.nodes, ids):
            depth, lo, hi, least, n, children, leaves, saved, up = v
            seg = r["seg"][lo]
            inner = depth == 0 and seg > 0  # the last node of the segment before, listed there
            if inner and name is None:
                continue
            end = lo
            while end <= hi and len(r["words"][end]) == depth:
                end += 1
            ended = [str(r["conv_id"][i]) for i in range(lo, end) if r["total"][i] == seg * self.size + depth and not inner]
            parent = None if up < 0 or ids[up] is not None else self.nodes[up][3]
            above = ids[up] if up >= 0 else None
            common_ = (r["blk"], seg * self.size + depth, not inner)
            if name is None:
                yield (*common_, least, parent, n, children, leaves, saved, _sha(ended), None, above, r["pos"][lo], None)
                continue
            pieces = [",".join(ended[at:at + PIECE]) for at in range(0, len(ended), PIECE)] or [None]
            yield (*common_, least, None, n, children, leaves, saved, None, name, above, r["pos"][lo], pieces[0])
            for k, piece in enumerate(pieces[1:], 1):
                yield (*common_, least, None, 0, 0, 0, 0, None, name, above, r["pos"][lo] + k * PIECE, piece)

    def _open(self, v: list) -> bool:
        """Does the node have rows in another block?"""
        depth, lo, hi = v[:3]
        return (lo == 0 and self.rows["lcp"][0] >= depth) or (hi == len(self.rows["pos"]) - 1 and self.rows["nxt"][hi] >= depth)

    def _name(self, v: list) -> str:
        r, lo = self.rows, v[1]
        return hashlib.md5(f"{r['seg'][lo]}/{r['grp'][lo]}/{r['key'][lo][:v[0] * DIGEST]}".encode()).hexdigest()


def _sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


#: A node, or a block's part of one: then it has a name, and its list's piece instead of the hash. ``above`` is a parent's name.
NODES = pa.schema([("blk", pa.int64()), ("depth", pa.int64()), ("shown", pa.bool_()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
                   ("name", pa.string()), ("above", pa.string()), ("pos", pa.int64()), ("piece", pa.string())])
_DDL = ", ".join(f"{f.name} {({pa.int64(): 'long', pa.string(): 'string', pa.bool_(): 'boolean'})[f.type]}" for f in NODES)


def forests(rows: DataFrame, size: int, block: int) -> DataFrame:
    """NODES of every block."""

    def run(table: pa.Table) -> pa.Table:
        data = table.sort_by("pos").to_pydict()
        data["blk"] = data["blk"][0]
        out = list(Forest(data, size).listed())
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(NODES), NODES)], schema=NODES)

    return rows.withColumn("blk", F.floor(F.col("pos") / block)).groupBy("blk").applyInArrow(run, _DDL)


def streamed(pieces: DataFrame) -> DataFrame:
    """name and ends_sha256 of lists that come in pieces (name, pos, piece)."""
    schema = pa.schema([("name", pa.string()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"name": last, "ends_sha256": state.hexdigest()}], schema=schema)

    return (pieces.select("name", "pos", "piece").repartition("name").sortWithinPartitions("name", "pos")
            .mapInArrow(run, "name string, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame, size: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations (see RESULT), of turns (conv_id, at, digest, words) and (conv_id, total)."""
    laid = laid_out(segments(turns, convs, size), [], ["seg", "grp", "key", "conv_id"])
    placed = positions(laid, "pos").drop("_at", "_part")
    rows = stage(neighbours(placed, block), "neighbours")
    nodes = stage(forests(beyond(rows, size), size, block), "nodes")
    parts = nodes.where("name is not null")
    merged = parts.groupBy("name").agg(
        F.first("depth").alias("depth"), F.first("shown").alias("shown"), F.min("conv_id").alias("conv_id"), F.first("above").alias("above"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = stage(merged.join(streamed(parts.where("piece is not null")), "name", "left")
                   .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_sha([])))), "merged")
    least = merged.select("name", F.col("conv_id").alias("parent_least"))
    # A block's nodes look up their parents among the block's own parts, so no parent gathers its children.
    here = parts.select("blk", "name").distinct().join(least, "name").withColumnRenamed("name", "above")
    whole = nodes.where("name is null")
    below = whole.where("above is not null").join(here, ["blk", "above"]).withColumn("parent_conv_id", F.col("parent_least"))
    across = merged.where("shown").join(least.withColumnRenamed("name", "above"), "above", "left").withColumn("parent_conv_id", F.col("parent_least"))
    return whole.where("above is null").select(*RESULT).unionByName(below.select(*RESULT)).unionByName(across.select(*RESULT))


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def report(conversations: DataFrame, size: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(conversations), size=size, block=block)
