"""Embedding near-duplicates by a random-projection tree forest.

Vectors are compared within a label. Exact copies form classes first; one vector of each class enters TREES trees. A tree splits
a node at the median of a random projection, level by level as a Spark aggregate, and rows within SPILL of the median go
to both children, until a node has at most LEAF rows or a split no longer makes it smaller (a dense cluster, which spilling
keeps together). Rows that share a leaf are compared in blocks of at most BLOCK x BLOCK in double precision. A pair is counted
only in the first leaf its two rows share, so blocks return sums and star edges, never pairs. Edges are united into components.

The forest is fitted on all rows, without a sample. Recall against brute force is measured in the tests; a pair is lost only
if every tree separates it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing and are their own component; vectors of different lengths never link; null and repeated vec_ids stand for
rows of their own, and a component without any vec_id has a null component_id; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm.graph import components
from packaudit.session import stage

THRESHOLD = 0.93
TREES = 4
LEAF = 1024
BLOCK = 1024
#: Half the overlap of two children, in standard deviations of the projection of a random unit vector.
SPILL = 0.24
MOST_LEVELS = 40
SEED = 11


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class ``cid`` (null if they cannot link), and one row per class."""
    v = F.col("embedding")
    whole = (F.col("label").isNotNull() & (F.size(v) > 0)
             & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
             & F.exists(v, lambda x: x.cast("double") != 0))
    rows = vectors.select("vec_id", "label", F.transform(v, lambda x: x.cast("double")).alias("v"),
                          F.coalesce(whole, F.lit(False)).alias("ok"))
    cid = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("v").cast("string")).cast("binary"))
    rows = rows.withColumn("cid", F.when(F.col("ok"), cid))
    one = (rows.where("ok").groupBy("cid").agg(F.any_value("label").cast("string").alias("label"), F.any_value("v").alias("v"),
                                               F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low")))
    return rows.select("vec_id", "cid"), stage(one, "vector-classes")


def directions(dimension: int, trees: int, levels: int) -> np.ndarray:
    """Random directions, one per tree and level, scaled so that unit vectors project to about unit deviation."""
    r = np.random.default_rng([SEED, dimension]).normal(size=(dimension, trees * levels))
    return r / np.linalg.norm(r, axis=0) * math.sqrt(dimension)


def _unit(column: pa.Array) -> list[np.ndarray]:
    found = [np.asarray(x, np.float64) for x in column.to_pylist()]
    return [x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max() for x in found]


def planted(one: DataFrame, trees: int, levels: int) -> DataFrame:
    """(cid, label, d, tree, node, p): every class at the root of every tree with its projections by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [(u @ directions(len(u), trees, levels)).astype(np.float32) for u in _unit(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int32()),
                 pa.array(p, pa.list_(pa.float32()))], ["cid", "label", "d", "all"])

    found = one.select("cid", "label", "v").mapInArrow(run, "cid string, label string, d int, all array<float>")
    return (found.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
            .select("cid", "label", "d", "tree", F.lit("").alias("node"),
                    F.slice("all", F.col("tree") * levels + 1, F.lit(levels)).alias("p")))


def grown(one: DataFrame, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """(cid, label, d, tree, node): the leaves of every class."""
    largest = one.groupBy("label", F.size("v").alias("d")).count().agg(F.max("count")).first()[0] or 0
    levels = min(MOST_LEVELS, max(1, 2 * math.ceil(math.log2(max(largest / leaf, 1)))))
    if largest <= leaf:  # every tree is its root, and one root is enough
        return one.select("cid", "label", F.size("v").alias("d"), F.lit(0).alias("tree"), F.lit("").alias("node"))
    where = ["label", "d", "tree", "node"]
    open_ = stage(planted(one, trees, levels).withColumn("above", F.lit(None).cast("long")), "trees")
    leaves = None
    for level in range(levels + 1):
        p = F.get("p", F.lit(min(level, levels - 1)))
        sizes = open_.groupBy(*where).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(p, 0.5).alias("cut"), F.max("above").alias("was"))
        done = (F.col("n") <= leaf) | (F.col("n") > 0.9 * F.col("was")) | F.lit(level == levels)
        placed = stage(open_.join(sizes.select(*where, "n", "cut", F.coalesce(done, F.lit(False)).alias("done")), where), "trees")
        ended = placed.where("done").select("cid", *where)
        leaves = ended if leaves is None else leaves.unionByName(ended)
        split = placed.where(~F.col("done"))
        if split.limit(1).count() == 0:
            break
        sides = F.array_compact(F.array(F.when(p <= F.col("cut") + spill, F.lit("0")), F.when(p > F.col("cut") - spill, F.lit("1"))))
        open_ = (split.withColumn("side", F.explode(sides))
                 .select("cid", "label", "d", "tree", F.concat("node", "side").alias("node"), "p", F.col("n").alias("above")))
    return leaves


def _roots(near: np.ndarray) -> np.ndarray:
    """Smallest index that each row reaches in a boolean adjacency matrix."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(np.where(near, label[None, :], len(near)).min(1, initial=len(near)), label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def compared(pdf: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links and star edges of one block of a leaf: rows of chunk ``bi`` against those of chunk ``bj``."""
    pdf = pdf.sort_values("cid", kind="stable", ignore_index=True)
    u = np.stack([x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max() for x in (np.asarray(v, np.float64) for v in pdf["v"])])
    n, chunk = pdf["n"].to_numpy(np.int64), pdf["chunk"].to_numpy()
    bi, bj = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
    near = u @ u.T >= threshold
    near &= (chunk[:, None] == bi) & (chunk[None, :] == bj) if bi != bj else True
    near |= near.T
    np.fill_diagonal(near, False)
    own = (int(pdf["tree"].iloc[0]), pdf["node"].iloc[0])
    earlier = [[x for x in ((int(t), s) for t, s in zip(ts, ns)) if x < own] for ts, ns in zip(pdf["trees"], pdf["nodes"])]
    index: dict[tuple, int] = {}
    for x in earlier:
        for y in x:
            index.setdefault(y, len(index))
    first = near
    if index and near.any():
        inside = np.zeros((len(pdf), len(index)), np.float32)
        for k, x in enumerate(earlier):
            inside[k, [index[y] for y in x]] = 1
        first = near & (inside @ inside.T == 0)
    root = _roots(near)
    return pd.DataFrame({"cid": pdf["cid"], "links": first @ n, "root": pdf["cid"].to_numpy()[root]})


def linked(one: DataFrame, leaves: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(cid, links, root) of every class and block that it is compared in."""
    leaf = ["label", "d", "tree", "node"]
    chunks = leaves.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    mine = leaves.groupBy("cid").agg(F.collect_list(F.struct("tree", "node")).alias("own")).select("cid", F.col("own.tree").alias("trees"), F.col("own.node").alias("nodes"))
    rows = (leaves.join(chunks, leaf).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
            .join(mine, "cid").join(one.select("cid", "v", "n"), "cid"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    spread = (rows.withColumn("other", other).withColumns({"bi": F.least("chunk", "other"), "bj": F.greatest("chunk", "other")})
              .select(*leaf, "bi", "bj", "chunk", "cid", "n", "v", "trees", "nodes"))
    return spread.groupBy(*leaf, "bi", "bj").applyInPandas(
        lambda pdf: compared(pdf, threshold), "cid string, links long, root string")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows, one = classes(vectors)
    found = stage(linked(one, grown(one, trees, leaf), threshold), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("root").alias("a"), F.col("cid").alias("b")).distinct())
    united = (one.select("cid", "n", "low").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
              .select("cid", "low", F.coalesce("root", "cid").alias("root"),
                      (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    lowest = united.groupBy("root").agg(F.min("low").alias("component_id"))
    per_class = united.join(lowest, "root").select("cid", "n_links", "component_id")
    linkable = rows.where("cid is not null").join(per_class, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle() -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.rid AS a, b.rid AS b, b.vec_id AS bv FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
          AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT rid, rid FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
comp AS (SELECT r.a AS rid, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rid = r.b GROUP BY r.a),
n AS (SELECT a AS rid, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v LEFT JOIN n USING (rid) JOIN comp USING (rid)"""
