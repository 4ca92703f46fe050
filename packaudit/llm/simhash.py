"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Multi-index hashing: a fingerprint is cut into SEGMENTS, of which two that differ in at most DISTANCE bits have SEGMENTS - DISTANCE
in common. Each choice of so many segments has a table, keyed by their bits (six tables of 32-bit keys). The members of
a table's bucket are compared on the complete fingerprint, as long as there are at most BUCKET of them. Fingerprints of a
fuller bucket, which may hold any share of all, are not compared among themselves: the Hamming ball of radius 1 is enumerated
in every segment of theirs, and two that differ in at most two bits meet on an element of both balls. Such a key holds 65
fingerprints at most, and links them as a star. Either way every link is verified and none is lost.

Distinct fingerprints only enter the table, so copies cost nothing. Defined cases: null and empty texts, and texts of white
space, have fingerprint zero and are linked like any other; null doc_ids get a fingerprint and the smallest doc_id of
their component (null if it has none); every row gets its own result row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.llm.graph import components
from packaudit.session import stage

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 4
#: Members of a table's bucket that are compared with each other; fuller buckets go by balls.
BUCKET = 32
#: A full bucket meets the list of full buckets in so many parts.
SALTS = 16
_STEP = 1 << 16


def shingle_hashes(text: str, words: int = SHINGLE) -> Iterator[int]:
    """XXH64 of each shingle of the text, A-Z in lower case, words at ASCII white space."""
    tokens = text.encode("utf-8").lower().split()
    joined = b" ".join(tokens)
    if not tokens:
        return iter(())
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(tokens) - words + 1, 1)
    last = ends[words - 1:] if len(tokens) >= words else ends[-1:]
    return map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts[:n].tolist(), last.tolist())), repeat(SEED))


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; as a signed 64-bit number."""
    hashes = np.fromiter(shingle_hashes(text or "", words), np.uint64)
    if len(hashes) == 0:
        return 0
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[at:at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(0, dtype=np.int64)
    on = np.flatnonzero(2 * set_ > len(hashes))
    return int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), on.astype(np.uint64)), initial=np.uint64(0)).astype(np.int64))


def fingerprints(docs: DataFrame, keep: dict, words: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` (name to expression) and ``print`` of every row."""
    inner = docs.select(*[c.alias(n) for n, c in keep.items()], F.col("text").alias("__text"))
    names = list(keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]] + ["print long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([fingerprint(t, words) for t in batch.column(len(names)).to_pylist()], pa.int64())],
                [*names, "print"])

    return inner.mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def table_masks(segments: int = SEGMENTS) -> list[int]:
    """The bits of every choice of segments that DISTANCE flipped bits can leave untouched, one mask a table."""
    width = 64 // segments
    parts = [((1 << width) - 1) << (j * width) for j in range(segments)]
    return [_signed(sum(chosen)) for chosen in combinations(parts, segments - DISTANCE)]


def ball_masks() -> list[int]:
    """Every way to flip at most one bit of a fingerprint."""
    return [0, *[_signed(1 << bit) for bit in range(64)]]


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``print``, enough of them to connect all within DISTANCE bits."""
    masks = F.array(*[F.lit(m) for m in table_masks()])
    tables = prints.select("print", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int").alias("salt"), F.posexplode(masks).alias("t", "mask")).select(
        "print", "salt", "t", F.col("print").bitwiseAND(F.col("mask")).alias("key"))
    # A bucket's count is combined before the shuffle; its rows meet the list of full buckets under a salt.
    full = stage(tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
                 .select("t", "key", F.explode(F.lit(list(range(SALTS)))).alias("salt")), "full-buckets")
    met = (tables.join(full, ["t", "key", "salt"], "left_anti").groupBy("t", "key").agg(F.collect_list("print").alias("m"))
           .where(F.size("m") > 1).select(F.explode("m").alias("a"), "m"))
    pairs = met.select("a", F.explode(F.filter("m", lambda b: (b > F.col("a")) & near(F.col("a"), b))).alias("b"))
    crowded = tables.join(full, ["t", "key", "salt"], "left_semi").select("print").distinct()
    balls = (crowded.select("print", F.explode(F.lit(ball_masks())).alias("mask"))
             .groupBy(F.col("print").bitwiseXOR(F.col("mask")).alias("key")).agg(F.collect_list("print").alias("m")).where(F.size("m") > 1))
    stars = balls.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return pairs.unionByName(stars.where(near(F.col("a"), F.col("b")))).distinct()


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def grouped(prints: DataFrame, representative: str) -> DataFrame:
    """(print, least) for every fingerprint: the smallest ``representative`` in its component, nulls last."""
    classes = stage(prints.groupBy("print").agg(F.min(representative).alias("least")), "prints")
    found = components(links(classes.select("print")))
    rooted = (classes.join(found.withColumnRenamed("node", "print"), "print", "left")
              .select("print", "least", F.coalesce("root", "print").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("low"))
    return rooted.select("print", "root").join(smallest, "root").select("print", F.col("low").alias("least"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    prints = stage(fingerprints(docs, {"doc_id": F.col("doc_id")}), "fingerprints")
    least = grouped(prints, "doc_id")
    return (prints.join(least, "print")
            .select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, then the smallest hash of its text."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    prints = stage(fingerprints(docs, {"who": key}), "fingerprints")
    keep = grouped(prints, "who").select("least").distinct().select(
        F.coalesce(F.col("least.id").cast("string"), F.lit("")).alias("__id"), F.col("least.hash").alias("__hash"))
    named = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__hash": F.xxhash64("text")})
    return named.join(keep, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")
