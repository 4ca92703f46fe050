"""Mixing against a plain solution of the same problem."""

import math
import random
from collections import defaultdict
from fractions import Fraction

from packaudit.llm import mixing


def brute_targets(size_of):
    """Targets by giving out the excess again and again, in exact fractions."""
    names = sorted(size_of, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(size_of.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * size_of[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = Fraction(2 * size_of[s])
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def brute_rates(sizes, target):
    """Rates of a source by bisection."""
    mean = sum(sizes) / max(1, sum(1 for x in sizes if x))
    lo, hi = -1e6, 1e6
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(x * math.exp(min(mid * x / mean, math.log(2))) for x in sizes) < target:
            lo = mid
        else:
            hi = mid
    return [math.exp(min(lo * x / mean, math.log(2))) if x else 0.0 for x in sizes]


def corpus():
    rng = random.Random(3)
    rows = []
    for s, n in (("a", 300), ("b", 40), ("é", 30), ("Z", 200), (None, 50), ("big", 900), ("one", 1), ("none", 3)):
        for _ in range(n):
            size = 0 if s == "none" or rng.random() < 0.05 else int(rng.lognormvariate(3, 1)) + 1
            rows.append((len(rows), None if size == 0 and rng.random() < 0.3 else " ".join(["w"] * size), s))
    rows += [(7, "same text here", "a")] * 5 + [(None, "no id", "b"), (None, "no id", "b"), (8, " \t\n", "b"), (9, "x " * 9000, "b"), (10, " ", "b")]
    return rows


def test_mix_meets_targets_with_tilted_rates(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, got.collect()), key=str)
    words = [len([w for w in (t or "").replace(" ", "nbsp").split()]) for _, t, _ in rows]
    assert sorted(((r[0], w) for r, w in zip(rows, words)), key=str) == sorted(((g[0], g[1]) for g in got), key=str)
    size_of = defaultdict(int)
    for (_, _, s), w in zip(rows, words):
        size_of[s] += w
    want = brute_targets(size_of)
    by = defaultdict(list)
    for g in got:
        by[g[2]].append(g)
    assert len(set(size_of.values())) == len(size_of) and set(by) == set(size_of.values())
    for s, total in size_of.items():
        docs = by[total]
        assert all(abs(g[3] - float(want[s])) <= 1e-9 * max(1.0, float(want[s])) for g in docs)
        assert all(0 <= g[4] <= 2 * g[1] for g in docs)
        assert abs(sum(g[4] for g in docs) - float(want[s])) <= 1
        rates = brute_rates([g[1] for g in docs], float(want[s])) if 0 < want[s] < 2 * total else [2.0 if g[1] and want[s] else 0.0 for g in docs]
        off = [g for g, r in zip(docs, rates) if abs(g[4] - r * g[1]) >= g[1] * (1 + 1e-5) and g[1]]
        parts = [g for g in docs if g[1] and g[4] % g[1]]
        assert not off and len(parts) <= 1, (s, off, parts)
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str) == got
    assert mixing.mix(df.limit(0)).collect() == []


def test_one_source_and_nothing_to_take(spark):
    schema = "doc_id long, text string, source string"
    one = mixing.mix(spark.createDataFrame([(1, "a b c d", None)], schema)).collect()
    assert [tuple(r) for r in one] == [(1, 4, 4, 6.0, 6)]
    none = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "s")], schema)).collect()
    assert sorted(tuple(r) for r in none) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
