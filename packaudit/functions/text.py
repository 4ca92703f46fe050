"""Text helpers (P1, P17, P15 predicate)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{N}]+"
ALNUM = r"[\p{L}\p{N}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_key(text: Column) -> Column:
    """Keep letters and digits, upper-cased."""
    return F.upper(F.regexp_replace(text, NOT_ALNUM, ""))


def norm_positions(text: Column) -> Column:
    """Position (from 0) in ``text`` of every character ``normalize_key`` keeps."""
    marked = F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(ALNUM), i))
    return F.array_compact(marked)


def common_parts(phrases: list[str], least: int = 3) -> list[str]:
    """Few substrings of at least ``least`` characters, one of which every phrase holds: each time the longest that most of the others share."""
    left, parts = list(phrases), []
    while left:
        subs = {p[a:b] for p in left for a in range(len(p)) for b in range(a + least, len(p) + 1)}
        best = max(sorted(subs), key=lambda x: (sum(x in p for p in left), len(x)))
        parts.append(best)
        left = [p for p in left if best not in p]
    return parts


def fold_ws(text: Column) -> Column:
    """Lower-case, outer blanks off, inner blank runs to one space; null becomes ''."""
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    return F.trim(folded)


def clip(text: Column, n: int) -> Column:
    """Fold blanks (case kept) and cut to ``n`` characters, ending in an ellipsis when cut."""
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(folded) <= n, folded).otherwise(F.concat(F.left(folded, F.lit(n - 1)), F.lit("…")))


def digit_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\d"))


def is_digit_row(text: Column) -> Column:
    """At least six digits that make up 60 % of the non-space characters."""
    digits = digit_count(text)
    return (digits >= 6) & (digits >= 0.6 * F.length(F.replace(text, F.lit(" "), F.lit(""))))


def round_to(value: Column | str, places: int) -> Column:
    """Round half to even at ``places`` decimals, on the binary value."""
    scale = 10.0 ** places
    return F.rint((F.col(value) if isinstance(value, str) else value) * scale) / scale
