"""Near-duplicates and the pipeline against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packaudit.llm import graph, langid, packing, registry, simhash, similar, vectors

SF = "/root/testdata/sf0.001"
HAVE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def united(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ------------------------------------------------------------------ vectors
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("cid", T.StringType()), T.StructField("tree", T.StringType())])


def brute_vectors(rows):
    n = len(rows)

    def fine(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    pairs = []
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                    pairs.append((i, j))
    root = united(n, pairs)
    low = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    links = [sum(i in p for p in pairs) for i in range(n)]
    return sorted(((rows[i][0], links[i], low.get(root[i]), rows[i][0] is not None and rows[i][0] == low.get(root[i])) for i in range(n)), key=str)


def vector_rows():
    rng = np.random.default_rng(0)
    rows = []
    for label in (0, 1):
        for c in range(60):
            base = rng.normal(size=32)
            rows += [(base + rng.normal(size=32) * s).tolist() + [label] for s in (0, .1, .2, .3)]
    base = rng.normal(size=32)
    rows += [(base + rng.normal(size=32) * 0.1).tolist() + [1] for _ in range(100)]  # a dense group
    rows = [(1000 - i, r[:-1], r[-1]) for i, r in enumerate(rows)]
    same = rows[0][1]
    return rows + [(5, same, 0), (6, same, 0), (6, same, 0), (7, same, None), (8, None, 0), (9, [], 0), (10, [0.0] * 32, 0), (11, [None] + same[1:], 0),
                   (12, [float("nan")] + same[1:], 0), (13, same[:16], 0), (None, same, 0), (14, [float("inf")] * 32, 0), (None, None, None)]


def test_forest_finds_what_brute_force_finds(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "c", "t") for r in rows], VECTORS)
    want = brute_vectors(rows)
    for leaf in (1024, 64):
        got = sorted(map(tuple, vectors.near_duplicates(df, leaf=leaf).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
        recall = sum(r[1] for r in got) / sum(r[1] for r in want)
        assert recall >= 0.99 and recall <= 1
        assert got == want if leaf == 1024 else sum(a == b for a, b in zip(got, want)) >= 0.95 * len(want)
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_blocks_of_a_large_leaf_count_each_pair_once(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "c", "t") for r in rows], VECTORS)
    _, one = vectors.classes(df)
    leaves = vectors.grown(one)
    whole = vectors.linked(one, leaves).groupBy("cid").agg(F.sum("links")).collect()
    cut = vectors.linked(one, leaves, block=50).groupBy("cid").agg(F.sum("links")).collect()
    assert dict(map(tuple, whole)) == dict(map(tuple, cut))


# ------------------------------------------------------------------ simhash
def brute_simhash(rows):
    prints = [simhash.fingerprint(t) & (2 ** 64 - 1) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = united(len(rows), pairs)
    low = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], f"{prints[i]:016x}", low.get(root[i])) for i in range(len(rows))), key=str)


def simhash_rows():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(3, None), (2, ""), (4, " \t"), (None, "one two"), (9, "ONE two"), (8, "one  two"), (8, "one  two"), (7, "x " * 70_000)]
    for i in range(60):
        text = list(rng.choice(words, 400))
        rows.append((100 + i, " ".join(text)))
        for k in range(3):
            text[int(rng.integers(0, 400))] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(text)))
    return rows


def test_simhash_components(spark):
    rows = simhash_rows()
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, print int, key string")
    got = sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    want = brute_simhash(rows)
    assert got == want and any(a != c for a, _, c in want if a is not None and a >= 1000)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len({w[2] for w in want})
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [1, 4, simhash.BUCKET])
def test_links_join_all_pairs_within_two_bits(spark, bucket):
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 20)]
    for p in prints[:10]:
        for a in rng.integers(0, 63, 6):
            prints.append(p ^ (1 << int(a)) ^ (1 << int(rng.integers(0, 63))))
    # One table bucket that is full at any of the sizes, its members near and far from each other.
    prints += [(int(x) << 32) | 12345 for x in rng.integers(-2 ** 31, 2 ** 31 - 1, 40)]
    prints += [prints[-1] ^ (3 << int(b)) for b in rng.integers(32, 61, 20)]
    prints = sorted(set(prints))
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "print long"), bucket).collect()
    assert all((e["a"] ^ e["b"]) & (2 ** 64 - 1) for e in edges)
    assert all((((e["a"] ^ e["b"]) & (2 ** 64 - 1)).bit_count()) <= 2 for e in edges)
    at = {p: i for i, p in enumerate(prints)}
    u = 2 ** 64 - 1
    want = united(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] & u) ^ (prints[j] & u)).bit_count() <= 2])
    assert united(len(prints), [(at[e["a"]], at[e["b"]]) for e in edges]) == want


def test_simhash_tables_have_one_row_a_choice_of_segments():
    masks = [m & (2 ** 64 - 1) for m in simhash.table_masks()]
    assert len(set(masks)) == 6 and all(m.bit_count() == 32 for m in masks)
    assert len(set(simhash.ball_masks())) == 65


# ------------------------------------------------------------------ pipeline
@HAVE
def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline as cp
    docs = registry.table(spark, SF, "documents")
    extra = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12 !!", "en", "s", 5), (90_003, "", None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    steps = dict(cp.STAGES)
    one = steps["language ID"](spark, docs, SF)
    known = {r["doc_id"] for r in langid.languages(docs).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r["doc_id"] for r in one.collect()} == known and not known & {90_001, 90_002, 90_003} and one.columns == docs.columns
    two = steps["SimHash near-dedup"](spark, one, SF)
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    sets = [set(similar.shingle_set(t).tolist()) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similar.SIMILAR * len(sets[i] | sets[j])]
    assert near and sorted(r["doc_id"] for r in two.collect()) == sorted({rows[i][0] for i in united(len(rows), near)})
    three = steps["benchmark decontamination"](spark, two, SF)
    items = [set(zip(*[r["text"].lower().split()[k:] for k in range(13)])) for r in registry.table(spark, SF, "benchmark").collect()]
    dirty = {r["doc_id"] for r in two.collect() if any(i & set(zip(*[r["text"].lower().split()[k:] for k in range(13)])) for i in items)}
    assert dirty and {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - dirty
    four = steps["secret scans"](spark, three, SF)
    assert four.count() == three.count() and four.columns == docs.columns
    from packaudit.llm import credentials
    assert not any(credentials.base_candidates(r["text"]) for r in four.collect())
    pieces = steps["packing"](spark, four, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in four.collect()} and packing.WINDOW == 2048


@HAVE
def test_every_stage_keeps_columns_of_any_name(spark):
    """Columns named like those that stages add for a while come out as they went in."""
    import corpus_pipeline as cp
    docs = registry.table(spark, SF, "documents").where("doc_id < 120")
    names = ["score", "fit", "lang_pred", "node", "who", "__id", "__hash", "__row", "__live", "hash", "key", "least"]
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, step in cp.STAGES[:-1]:
        out = step(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in step(spark, docs, SF).collect()}, name
    assert cp.STAGES[-1][1](spark, wide, SF).count() > 0


@HAVE
def test_registered_queries_match_their_sql(spark):
    from verification.check import compare, connect
    for name, sql in registry.ORACLE.items():
        state, _, _, _, msg = compare(spark, connect(SF), SF, registry.QUERIES[name], sql)
        assert state == "ok", (name, msg)
