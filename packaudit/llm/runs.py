"""Periodic runs of words in whole documents, by seeds that are extended along diagonals.

A run of period q has at least max(6, 4q) words, so words q apart agree at max(6, 4q) - q places in a row: 5 for q = 1, 3q beyond.
Periods are taken by doubling ranges [m, 2m); the overlap that each of a range must have (5, then 3m) is the length k of the words' k-grams
that are indexed. As k is no less than any period of its range, the next occurrence of a k-gram inside a run lies exactly one period on
(a nearer one would give the run a shorter period), so each occurrence is paired with the next one and not with all: n pairs a range at most.
A pair at lag q is extended both ways while words q apart agree. How far each lag has been covered is kept in a table, and pairs
inside what is covered are skipped, so that no stretch is extended twice. k-grams of a range are named from those of the range before, among
places whose shorter k-gram repeats; the search ends when none does.

Documents are handled where they are read, each whole, with no shuffle.

Defined cases: a null or empty text, or one of white space, has no words and no run; a null doc_id plants nothing; repeated rows give repeated
results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Fewest words of a run, and fewest periods.
LEAST, PERIODS = 6, 4
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the repetition that the document's number plants, if it does."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers, equal where the pairs of a and b are."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _repeated(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places whose name occurs more than once, their names, and every pair (place, next place of the name)."""
    order = np.argsort(names, kind="stable")
    places, sorted_ = at[order], names[order]
    same = sorted_[1:] == sorted_[:-1]
    keep = np.zeros(len(at), bool)
    keep[order[:-1][same]] = True
    keep[order[1:][same]] = True
    return at[keep], names[keep], places[:-1][same], places[1:][same]


def _longer(at: np.ndarray, names: np.ndarray, k: int, longer: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the k-grams of ``longer`` words (k < longer <= 2k), from the repeated ones of k words."""
    table = np.full(n + 1, -1, np.int64)
    table[at] = names
    head = at[at + longer <= n]
    tail = table[head + longer - k]
    fine = tail >= 0
    head, tail = head[fine], tail[fine]
    return head, _named(table[head], tail)


def stretch(ids: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """Longest [from, to) around i in which each word equals the one q later."""
    n, step, to = len(ids) - q, 64, i
    while to < n:
        differ = np.flatnonzero(ids[to:min(to + step, n)] != ids[to + q:min(to + step, n) + q])
        if len(differ):
            to += int(differ[0])
            break
        to, step = min(to + step, n), step * 2
    first, step = i, 64
    while first > 0:
        low = max(first - step, 0)
        differ = np.flatnonzero(ids[low:first] != ids[low + q:first + q])
        if len(differ):
            first = low + int(differ[-1]) + 1
            break
        first, step = low, step * 2
    return first, to


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    found: list[tuple[int, int, int]] = []
    covered: dict[int, int] = {}
    at, names, shortest, k = np.arange(n), ids, 1, 1
    for longer in (2, 4, LEAST - 1):
        at, names, _, _ = _repeated(at, names)
        at, names = _longer(at, names, k, longer, n)
        k = longer
    while True:
        at, names, one, two = _repeated(at, names)
        lags = two - one
        seeds = np.flatnonzero((lags >= shortest) & (lags < 2 * shortest))
        for s in seeds[np.argsort(one[seeds], kind="stable")]:
            i, q = int(one[s]), int(lags[s])
            if i < covered.get(q, 0):
                continue
            first, to = stretch(ids, i, q)
            covered[q] = to
            length = to - first + q
            if length >= max(LEAST, PERIODS * q):
                found.append((first, length, q))
        shortest *= 2
        longer = 3 * shortest
        if not len(at) or longer + shortest > n:
            return sorted(found, key=lambda r: (r[0], r[2]))
        at, names = _longer(at, names, k, longer, n)
        k = longer


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run repeats."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)]


def numbered(words: list[str]) -> np.ndarray:
    """A number for each word, the same for the same word."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def digest(doc_id: int | None, text: str | None) -> tuple:
    """The query's row for a document."""
    words = planted(WORD.findall(text or ""), doc_id)
    found = runs(numbered(words))
    best = min(found, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(words, found)).encode()).hexdigest())


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def report(docs: DataFrame) -> DataFrame:
    """Runs of every document, with the planted ones: see SCHEMA."""
    schema = _schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per run of a document's text as it stands: doc_id, start, length, period (words, from 0) and unit, the words that repeat."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("unit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text or "")
                rows += [(doc_id, s, n, q, " ".join(words[s:s + q])) for s, n, q in runs(numbered(words))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, period long, unit string")
