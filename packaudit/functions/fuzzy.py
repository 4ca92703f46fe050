"""Fuzzy key containment (F4) and near-miss tails.

The similarity is difflib's sequence ratio, which no built-in expression gives,
so it runs in a Pandas UDF. A built-in filter that can never lose a true hit
keeps almost every row away from Python.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packaudit import dims


def seed_pieces(token: str, ratio: float = dims.FUZZY_RATIO) -> list[str]:
    """Substrings of ``token``, one of which every true hit must contain unchanged.

    For equal lengths n a ratio r needs at least ceil(r*n) matched characters, so at
    most d = n - ceil(r*n) are unmatched on either side. Cut the token in 2d+1 pieces:
    each unmatched token character spoils one piece and each inserted text character
    one more, so at least one piece survives.
    """
    n = len(token)
    spoiled = n - math.ceil(ratio * n - 1e-9)
    pieces = min(n, 2 * spoiled + 1)
    cuts = [round(i * n / pieces) for i in range(pieces + 1)]
    return [token[a:b] for a, b in zip(cuts, cuts[1:])]


_pieces = lru_cache(maxsize=1024)(seed_pieces)


def may_contain(norm: Column, tokens: list[str]) -> Column:
    """Built-in necessary condition for ``contains_fuzzy``."""
    tests = [(F.length(norm) >= len(t)) & norm.rlike("|".join(sorted(set(seed_pieces(t))))) for t in tokens]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


@lru_cache(maxsize=65536)
def _alike(stretch: str, token: str, ratio: float) -> bool:
    """Labels repeat their keys, so most stretches were compared before, whatever else is printed on their lines."""
    return SequenceMatcher(None, stretch, token).ratio() >= ratio


def contains_fuzzy(norm: str, token: str, ratio: float = dims.FUZZY_RATIO) -> bool:
    """Some stretch of ``norm`` as long as ``token`` has at least this sequence ratio with it.

    The letters in common, kept up to date while the stretch moves, bound the ratio from above.
    """
    n = len(token)
    if n < 3 or len(norm) < n or not any(piece in norm for piece in _pieces(token, ratio)):
        return False
    left, common = Counter(token), 0
    if sum(min(norm.count(c), k) for c, k in left.items()) / n < ratio:
        return False
    for i, c in enumerate(norm):
        common += left[c] > 0
        left[c] -= 1
        if i >= n:
            gone = norm[i - n]
            left[gone] += 1
            common -= left[gone] > 0
        if i >= n - 1 and common / n >= ratio:
            if _alike(norm[i - n + 1:i + 1], token, ratio):
                return True
    return False


def near_tails(token: str, ratio: float = dims.NEAR_MISS_RATIO) -> list[str]:
    """Every text as long as ``token`` that is close to it, "*" standing for the characters that it lacks."""
    return ["".join(t) for t in product(sorted({*token, "*"}), repeat=len(token))
            if SequenceMatcher(None, "".join(t), token).ratio() >= ratio]


def near_miss(head: Column) -> Column:
    """The end of ``head`` is close to a short date key. Characters that a key lacks are all alike to the ratio, so its close texts can be listed."""
    tests = [(F.length(head) >= len(t)) & F.regexp_replace(F.right(head, F.lit(len(t))), f"(?s)[^{t}]", "*").isin(near_tails(t))
             for t in dims.NEAR_MISS_TOKENS]
    return reduce(operator.or_, tests)


FUZZY_FIELDS = list(dims.FUZZY_PHRASES)


@lru_cache(maxsize=65536)
def _fields_of(norm: str) -> int:
    return sum(1 << i for i, f in enumerate(FUZZY_FIELDS) if any(contains_fuzzy(norm, t) for t in dims.FUZZY_PHRASES[f]))


@F.pandas_udf(T.IntegerType())
def fuzzy_fields(norm: pd.Series) -> pd.Series:
    """Bit per fuzzy field; null in, no hit out."""
    return pd.Series([_fields_of(v) if v else 0 for v in norm], dtype="int32")
