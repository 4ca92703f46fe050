"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

from packaudit.llm import runs


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i:i + length]
            if length >= max(6, 4 * q) and not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(5)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, list("abababab"), list("abababa"), list("abcabcabcabcab") + ["x"] * 7]
    for alphabet in (1, 2, 3, 40):
        for n in (7, 30, 90, 160):
            for _ in range(25):
                words = [f"w{rng.randrange(alphabet)}" for _ in range(n)]
                for _ in range(rng.randrange(4)):  # plant repetitions, also of units that repeat inside
                    unit = [f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(1, 12))]
                    unit = unit * rng.randrange(1, 3) + unit[:1]
                    at = rng.randrange(n)
                    words[at:at] = (unit * rng.randrange(2, 9))[:rng.randrange(1, 80)]
                out.append(words)
    return out


def test_runs_equal_brute_force():
    some = 0
    for words in texts():
        want = brute_runs(words)
        some += bool(want)
        assert runs.runs(runs.numbered(words)) == want, words
    assert some > 100


def brute_row(doc_id, text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    return (doc_id, len(found), *(best[0] if best else (None,) * 3), best[0][1] * 1000 // best[0][2] if best else None,
            hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_query_rows_equal_brute_force(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts())]
    rows += [(None, "a a a a a a a"), (20, None), (30, ""), (40, " \t\n"), (50, "           \u0085"), (50, "x\fx\vx\rx x x"),
             (50, "x\fx\vx\rx x x"), (60, "one two three four " * 200 + "end")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, start int, period string")
    got = sorted(map(tuple, runs.report(df).collect()), key=str)
    assert got == sorted((brute_row(*r) for r in rows), key=str)
    assert any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)
    assert runs.report(df.limit(0)).collect() == []


def test_long_text_is_fast_and_whole(spark):
    df = spark.createDataFrame([(1, "one two three four " * 250_000 + "end")], "doc_id long, text string")
    got = runs.periodic_runs(df).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1_000_000, 4, "one two three four")]
