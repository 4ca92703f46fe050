"""The sequence ratio is computed once per key as printed, and never for text that lacks the letters."""

from difflib import SequenceMatcher

from packaudit import dims
from packaudit.functions import fuzzy


def plain(norm, token):
    n = len(token)
    return any(SequenceMatcher(None, norm[i:i + n], token).ratio() >= dims.FUZZY_RATIO for i in range(len(norm) - n + 1))


def test_repeated_keys_are_compared_once(monkeypatch):
    made = []

    def counting(*args):
        made.append(args)
        return SequenceMatcher(*args)

    monkeypatch.setattr(fuzzy, "SequenceMatcher", counting)
    texts = [f"MANUFACTURBDBY{i:04d}PVTLTD" for i in range(200)]
    assert all(fuzzy.contains_fuzzy(t, "MANUFACTUREDBY") for t in texts)
    assert len(made) < 10


def test_same_answer_as_every_stretch():
    texts = ["NETQUANTLTY5G", "XXCUSTOMERCAPE1800", "MARKETEDBV", "DATEFMANUFACTURE0103", "PLOT14INDUSTRIALAREA400001", "ETARETAILMAXIMUMPRICE", "", "NET"]
    tokens = [t for ts in dims.FUZZY_PHRASES.values() for t in ts]
    assert {(a, b): fuzzy.contains_fuzzy(a, b) for a in texts for b in tokens} == {(a, b): plain(a, b) for a in texts for b in tokens}


def test_near_misses_are_told_without_python(spark):
    import random
    from difflib import SequenceMatcher
    from pyspark.sql import functions as F
    from packaudit import dims
    rng = random.Random(5)
    heads = ["".join(rng.choice("MFDGPKBYX1É😀") for _ in range(rng.randrange(8))) for _ in range(3000)]
    near = {h: any(len(h) >= len(t) and SequenceMatcher(None, h[-len(t):], t).ratio() >= dims.NEAR_MISS_RATIO for t in dims.NEAR_MISS_TOKENS) for h in heads}
    got = spark.createDataFrame([(h,) for h in near], "h string").select("h", fuzzy.near_miss(F.col("h")).alias("n"))
    assert {r["h"]: r["n"] for r in got.collect()} == near and any(near.values())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_key_is_located_only_where_it_stands(spark):
    """What a condition shares with its result is computed for every row: the position must not stand in a condition of its own."""
    from pyspark.sql import functions as F
    from packaudit import dims
    from packaudit.operators import extraction as ex
    for field, phrases in dims.KEY_PHRASES.items():
        rows = [(a + p + b, n) for p in phrases for a in ("", "ÄX1") for b in ("", "12", phrases[0], phrases[-1]) for n in (1, 4, 60)]
        rows += [("X" + p[1:], 60) for p in phrases]
        found = spark.createDataFrame(rows, "w string, n int").select("w", "n", ex.exact_key_end(F.col("w"), F.col("n"), field).alias("e"))
        for r in found.collect():
            ends = [r["w"].index(p) + len(p) for p in phrases if p in r["w"] and r["w"].index(p) < r["n"]]
            assert r["e"] == (ends[0] if ends else None), (field, r)
        assert found._jdf.queryExecution().executedPlan().toString().count(" AND ") == 0
