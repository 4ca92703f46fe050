"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib

from packaudit.llm import prefixes


def brute_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for v in turns.values():
        v.sort(key=lambda t: (t[:2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = turns.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])
        made[c] = [t[2:] for t in base[:h] + own[h:]]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        own = (len(nodes[p]) - 1) * len([w for w in p[-1][1].split(" ") if w]) if p else 0
        saved[p] = own + sum(saved[k] for k in kids)
        ends = ",".join(str(c) for c in sorted(c for c in nodes[p] if len(made[c]) == len(p)))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth int, name string, pos long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def random_rows(seed, convs, longest, alphabet):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 4 * convs), convs):
        n = rng.choice([1, 1, 2, 3, rng.randrange(1, longest)])
        rows += [(c, t, rng.choice(["user", "assistant"]) if alphabet > 2 else "user", " ".join(["w"] * rng.randrange(alphabet))) for t in range(n)]
    return rows


def test_trie_equals_the_one_built_turn_by_turn(spark):
    rows = random_rows(1, 90, 12, 2) + random_rows(2, 0, 3, 3) + random_rows(3, 60, 30, 4)
    rows += [(1000, t, "user", f"w {t % 2}") for t in range(25)] + [(1001, t, "user", f"w {t % 2}") for t in range(20)]
    rows += [(c, t, "system", "same opening") for c in range(2000, 2090) for t in range(4)]  # copies
    rows += [(5, None, None, None), (5, None, None, None), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (5, 3, "bot", None), (None, 1, "user", "no one"),
             (4001, 0, "user", "alone"), (4002, 0, "user", "alone"), (4003, 0, "", ""), (4003, 1, None, None)]
    want = brute_trie(rows)
    for size, block in ((128, 2048), (4, 16), (2, 3), (1, 1)):
        got = prefixes.report(frame(spark, rows), size=size, block=block)
        assert sorted(map(tuple, got.collect()), key=str) == want, (size, block)


def test_long_lists_are_streamed_in_pieces_and_empty_input_has_no_nodes(spark):
    rows = [(c, 0, "user", "hello") for c in range(1, 1400)]
    want = brute_trie(rows)
    for block in (4096, 700):
        assert sorted(map(tuple, prefixes.report(frame(spark, rows), block=block).collect()), key=str) == want
    assert prefixes.report(frame(spark, rows).limit(0)).collect() == []
