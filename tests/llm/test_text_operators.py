"""Operators on single texts and pages against plain Python, with the defined edge cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packaudit.llm import chars, credentials, decontaminate, langid, licenses, packing, pages, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, label string, w int, at int"
LONG = "word and another thing, " * 20_000
EN = "the cat sat on the mat and then the dog ran over the hill with the other dogs"
FR = "le chat est sur la table et puis il est parti avec les autres dans la maison"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", 1, "y", 2, 3) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts, languages and sources; empty, blank and very long texts; repeated rows."""
    return docs(spark, [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (None, "Released under the MIT License.", "en", "a"),
        (4, LONG, "en", "a"), (5, "cc by nc CC-BY-NC cc by", "fr", "b"), (5, "cc by nc CC-BY-NC cc by", "fr", "b"), (6, "12 34 !!", "en", "c")])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def by_id(df, *names):
    return sorted(((r["doc_id"], *[r[n] for n in names]) for r in df.collect()), key=str)


# ------------------------------------------------------------------ licences
def brute_licence(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if x]
    base, labels, base_labels, score = [], set(), set(), 0.0
    for t in licenses.TEMPLATES:
        own, key = t.words, t.key.split()
        for s in range(-len(own) + 1, len(w)):
            at = [s + k for k in range(len(own))]
            n = sum(0 <= a < len(w) and w[a] == x for a, x in zip(at, own))
            k = s + t.key_at
            if n >= t.need and k >= 0 and w[k:k + len(key)] == key:
                labels.add(t.label)
                score = max(score, n / len(own))
                if t.base:
                    base.append(s)
                    base_labels.add(t.label)
    return (len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


TEXTS = ["Under the MIT license under the mit-license.", "Apache License, Version 2.0", "licensed under Apache License Version 2",
         "This work is licenced under the GNU General Public License, version 3.", "under the mitİ license", "K under the mit licenſe",
         "Licensed under CC BY-NC 4.0. cc by nc", "Permission is hereby granted, free of charge, to any person getting a copy of this software "
         "and associated documentation files (the \"Software\"), to deal in the software without limit", "", "general public license version 3"]


def test_licences(spark, odd, none):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    df = docs(spark, rows).unionByName(odd)
    want = sorted(((r["doc_id"], *brute_licence(r["text"] if len(r["text"] or "") < 10_000 else "")) for r in df.collect() if len(r["text"] or "") < 10_000), key=str)
    got = [r for r in by_id(licenses.scan(df), *names) if r[1] < 10_000]
    assert got == want
    assert licenses.scan(none).collect() == []


# ------------------------------------------------------------------ language
def test_language_counts_and_scores_match_brute_force(spark):
    texts = ["Añb  c1", "", "été!", "x" * 25 + " yz"]
    logs = np.random.default_rng(1).normal(size=((1 << langid.BITS) + 1, 2))
    logs[-1] = 0
    for size in (5, 1000):
        got = np.zeros((len(texts), 2))
        for block in chars.blocks(texts, size):
            for found, begin, end in langid.buckets(block):
                np.add.at(got, block.owner, chars.segment_sums(logs[found], begin, end))
        for i, t in enumerate(texts):
            p = langid.folded(np.array([ord(c) for c in t], np.uint32)) if t else np.zeros(0, np.uint32)
            want = np.zeros(2)
            for n in (1, 2, 3):
                for e in range(n - 1, len(p)):
                    gram = p[e - n + 1:e + 1].astype(np.uint32)
                    if e and p[e] == 32 and p[e - 1] == 32:
                        continue
                    want += logs[chars.ngrams(gram, n, langid.BITS)[-1]]
            assert np.allclose(got[i], want), (size, t)


def test_language_identification(spark, odd, none):
    train = [(100 + i, f"{EN} {i}" if i % 2 else f"{FR} {i}", "en" if i % 2 else "fr", "s") for i in range(60)]
    got = langid.languages(docs(spark, train).unionByName(odd))
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t, lang, _ in train:
        assert rows[i]["lang_pred"] == lang and 0.5 < rows[i]["score"] <= 1
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    for i in (1, 2, 3, 6):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0
    assert rows[None]["held_out"] is False and rows[4]["lang_pred"] == "en" and got.count() == 68
    assert langid.languages(none).collect() == []
    assert {r["lang_pred"] for r in langid.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ------------------------------------------------------------------ sharding
def test_sharding_balances_and_moves_little(spark, odd, none):
    rng = np.random.default_rng(3)
    rows = [(int(i) if i % 3 else 7, "é" * int(rng.integers(0, 300)), "en", "a") for i in range(3000)]  # one doc_id on a third of all rows
    rows += [(None, "same", "en", "a")] * 500
    got = sharding.shard(docs(spark, rows)).collect()
    load, count = {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        count.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(load.values()) / 16
    assert len(got) == 3500 and set(load) == set(range(16))
    assert max(load.values()) < mean * 1.03 and min(load.values()) > mean * 0.93
    assert all(sorted(s) == list(range(len(s))) for s in count.values())
    edge = {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in sharding.shard(odd).collect()}
    assert (1, 1, 0, "bytes", None) in edge and (None, 32, zlib.crc32(b"Released under the MIT License."), "bytes", None) in edge
    assert sharding.shard(none).collect() == []


def test_ring_moves_only_to_the_new_shard():
    def home(points, cell):
        return next(sharding.Walk(points, 1).shards_from(cell))
    old, new = sharding.ring(16), sharding.ring(17)
    moved = [(home(old, c), home(new, c)) for c in range(0, sharding.CELLS, 7)]
    assert all(a == b or b == 16 for a, b in moved) and 0 < sum(a != b for a, b in moved) < 0.1 * len(moved)


# ------------------------------------------------------------------ secrets
def brute_secrets(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    found.sort()
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
    return (*[sum(k == j for _, k, _ in found) for j in range(3)], hashlib.sha256(spans.encode()).hexdigest())


HEX = hashlib.sha256(b"x").hexdigest()
SECRETS = ["é password = 'abcdefgh1' x", "PASSWORD:abc token=short", f"token = \"{HEX}\"", "AKIAABCDEFGHIJKL12 AKIASHORT", f"api_key={HEX[:31]} {HEX}",
           "toKen=abcdefghij", "secret==abcdefgh", "ghq_A1b2C3d4E5f6G7h8I9j0 here", "", "password" * 3]


def test_secrets(spark, odd, none):
    names = ["n_assign", "n_access", "n_hex", "base_sha256"]
    df = docs(spark, [(i, t, "en", f"s{i}") for i, t in enumerate(SECRETS)]).unionByName(odd)
    want = sorted(((r["doc_id"], *brute_secrets(r["text"] or "")) for r in df.collect()), key=str)
    assert by_id(credentials.report(df), *names) == want
    assert credentials.report(none).collect() == []


def test_widely_copied_values_are_told_from_owned_ones(spark):
    token, copied = "ghq_A1b2C3d4E5f6G7h8I9j0", "ghq_Z9y8X7w6V5u4T3s2R1q0"
    df = docs(spark, [(1, f"mine {token}", "en", "s1"), *[(10 + i, f"as in {copied}", "en", f"s{i}") for i in range(8)]])
    rows = {r["doc_id"]: r for r in credentials.report(df).collect()}
    assert rows[1]["spans"] == f"owned:5:{5 + len(token)}" and rows[1]["n_live"] == 1
    assert all(rows[10 + i]["spans"] == "" for i in range(8))
    clear = {r["doc_id"]: r for r in credentials.mask(df.unionByName(docs(spark, [(2, f"a token = \"{HEX}\" b", "en", "s1")]))).collect()}
    assert clear[1]["text"] == "mine [secret]" and clear[10]["text"] == f"as in {copied}"
    assert clear[2]["text"] == "a [secret]\" b" and clear[2]["n_chars"] == len(clear[2]["text"])


# ------------------------------------------------------------------ quality
def test_quality_learns_and_scores_held_out_rows(spark, odd, none):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(100, 500):
        words = rng.choice(vocabulary, 60)
        good = i % 4 != 0
        rows.append((i, " ".join(words) + "." if good else " ".join(np.repeat(words[:6], 10)), "en", "a"))
        labels.append((i, int(good), 0, "t"))
    marks = spark.createDataFrame([*labels, (1, None, 0, "t"), (None, 1, 0, "t"), (5, 0, 0, "t"), (5, 1, 0, "t"), (77, 9, 0, "t")],
                                  "doc_id long, quality int, toxic int, text string")
    got = {r["doc_id"]: r for r in quality.qualities(docs(spark, rows).unionByName(odd), marks).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and len(held) > 50
    assert np.mean([got[i]["predicted"] == int(i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert quality.qualities(none, marks).collect() == []
    assert {r["score"] for r in quality.qualities(odd, marks.limit(0)).collect()} == {0.5}


def test_a_repeated_doc_id_takes_one_place_in_the_sample(spark):
    rows = [(1, f"copy number {i % 7} of it", "en", "a") for i in range(60)] + [(i, f"text of {i}", "en", "a") for i in range(2, 40)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    learnt = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 4 != 2]
    for size in (4, 100):
        got = quality.sampled(docs(spark, rows).repartition(5), marks, size).collect()
        again = quality.sampled(docs(spark, rows[::-1]), marks, size).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in again]
        for y in (0, 1):
            assert sum(r["y"] == y for r in got) == min(size, sum(i % 2 == y for i in learnt))


def test_indicators_do_not_depend_on_slices():
    texts = ["abc abc abc", "", LONG[:5000]]
    whole = list(quality.indicators(texts))
    assert [list(x) for x in whole] == [list(next(quality.indicators([t]))) for t in texts]


# ------------------------------------------------------------------ packing
def test_packing_round_trip(spark, odd, none):
    spec = packing.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_str(spec)
    df = docs(spark, [(50 + i, (EN + ". " + FR + "! don't stop <|endoftext|> 3.14\n") * (i % 40), "en", "a") for i in range(80)]).unionByName(odd)
    pieces = packing.pack(df.repartition(3), spec).collect()
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, packing.END])
    for doc, all_ids in texts.items():
        own = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces if p["doc_id"] == doc)
        want = []
        for ids in all_ids:
            copies = [x for x in own if x[3] == len(ids)]
            starts = sorted({x[0] for x in copies})
            if len(all_ids) > 1:
                assert sum(x[1] for x in copies) == len(ids) * len(all_ids)
                continue
            for s, n, crc, _ in copies:
                assert crc == zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())
                want += range(s, s + n)
            assert want == list(range(len(ids))) and starts[0] == 0
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= packing.WINDOW
    total = sum(p["length"] for p in pieces)
    assert len(by) * packing.WINDOW <= total * 1.02 + 3 * packing.WINDOW
    assert packing.pack(none, spec).collect() == []


def test_encoder_gives_the_tokenizers_ids():
    spec = packing.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    tok, own = Tokenizer.from_str(spec), packing.Encoder(spec)
    rng = np.random.default_rng(6)
    parts = ["don't", "'s", "a", "été", "3.14", "x", "...", "!!", ",", "%%%", "_.", "\u00a0", "<|endoftext|>", "<|startoftext|>", "e\u0301", " ", "\n", "\t", "Σ", "½.", "|>", ")", "日本"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts, 30)) for _ in range(8)]
        for text, ids in zip(texts, own.encode(texts)):
            assert ids.tolist() == [*tok.encode(text, add_special_tokens=False).ids, packing.END], text


def test_plan_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        at = np.unique(rng.integers(1, 60, 15))
        at = np.union1d(at, np.arange(4, at[-1], 4))
        cost = rng.choice([0.0, 1.0, 5.0], len(at))
        window = 10
        best = {0: 0.0}
        for j, c in zip(at, cost):
            best[int(j)] = c + min((best[i] + window - (int(j) - i) for i in best if 0 < j - i <= window), default=math.inf)
        cuts = packing.plan(at, cost, window)
        price = dict(zip(at.tolist(), cost.tolist()))
        assert cuts[-1] == at[-1]
        assert math.isclose(sum(window - (b - a) + price[b] for a, b in zip([0, *cuts], cuts)), best[int(at[-1])])


# ------------------------------------------------------------------ decontamination
ITEM = "Then old Anna walked 5 km over the long red bridge and paid 12 dollars while poor Anna slept near the quiet river bank"


def test_templates_catch_new_parameters_but_not_mixtures(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, "too short to", "x"), (3, None, "x"), (1, ITEM, "y")], "item_id long, text string, w string")
    same = ITEM.replace("Anna", "Boris").replace("5", "77").replace("12", "3")
    changed = ITEM.replace("Anna", "Boris", 1)  # the rest stands word for word
    mixed = "Then old Anna walked 5 km while poor Boris slept near Clara and paid 12 dollars over the long red sea"
    clean = "Quite another text about boats that sail over the long red sea and never come back to the quiet river bank again"
    df = docs(spark, [(21, f"lead in words. {ITEM}", "en", "a"), (22, f"one {same} tail", "en", "a"), (23, changed, "en", "a"), (24, clean, "en", "a"),
                      (25, "odd " + " ".join(ITEM.split()[6:17]) + " even", "en", "a"), (25, f"x {ITEM}", "en", "a"), (None, ITEM, "en", "a"),
                      (26, mixed, "en", "a")]).unionByName(odd)
    for limit in (10 ** 6, 0):  # broadcast and shuffled index
        found = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.contaminated(df, bench, limit).collect()}
        assert found == {(21, 1): True, (22, 1): False, (23, 1): True, (25, 1): True, (None, 1): True}
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and left.count() == df.count() - 6
    assert decontaminate.report(none, bench).collect() == [] and decontaminate.clean(df, bench.limit(0)).count() == df.count()


def test_repeated_texts_of_the_benchmark_are_indexed_once_and_a_large_index_is_not_broadcast(spark):
    bench = spark.createDataFrame([(i, ITEM) for i in (*range(300), None)], "item_id long, text string")
    assert decontaminate.windows(bench).count() == decontaminate.windows(bench.limit(1)).count()
    df = docs(spark, [(1, f"x {ITEM}", "en", "a"), (2, "nothing of it", "en", "a")])
    for limit in (10 ** 6, 0):
        found = decontaminate.contaminated(df, bench, limit)
        assert sorted(str(r["item_id"]) for r in found.where("doc_id = 1").collect()) == sorted(str(i) for i in (*range(300), None))
        assert found.count() == 301
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


SCARCE = {
    1: "What is the capital of France", 2: "Tom has 12 kg, Ann has 15 kg, Bob has 9 kg and Eva has 7 kg of rice in the bag",
    3: "There are 3 cows and 5 goats on the green farm near the old mill by the river", 4: "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc",
    5: "Add 2 and 2 apples to the small round basket that stands behind the old kitchen door"}


def test_short_number_heavy_and_partly_changed_items_are_found(spark):
    bench = spark.createDataFrame(list(SCARCE.items()), "item_id long, text string")
    around = "some other words stand before it. {} and others after it"
    rows = {10 * i: around.format(t) for i, t in SCARCE.items()}
    rows |= {31: around.format(SCARCE[3].replace("3", "4").replace("5", "4")), 51: around.format(SCARCE[5].replace("2 and 2", "3 and 5")),
             11: around.format(SCARCE[1].lower()), 12: around.format("What is the capital of Spain"), 22: around.format("Tom has 12 kg and that is all")}
    df = docs(spark, [(i, t, "en", "a") for i, t in rows.items()])
    for limit in (10 ** 6, 0):
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, limit).collect()}
        assert found == {(10, 1), (20, 2), (30, 3), (40, 4), (50, 5), (31, 3), (51, 5), (11, 1)}


def test_planted_runs_are_found(spark):
    """Recall on items planted whole, in part and with new numbers and names; brute force says which runs there are."""
    rng = np.random.default_rng(7)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re") for b in ("lan", "sor", "tip", "der", "mun", "vek")]

    def item(n):
        return " ".join(str(rng.integers(1, 99)) if rng.random() < 0.25 else rng.choice(plain) for _ in range(n))
    items = {i: item(int(n)) for i, n in enumerate(rng.integers(4, 40, 60))}
    rows, want = [], set()
    for i, text in items.items():
        w = text.split()
        k = min(len(w), 11)
        at = int(rng.integers(0, len(w) - k + 1))
        rows += [(100 + i, f"{item(30)} {text} {item(30)}", "en", "a"), (200 + i, f"{item(20)} {' '.join(w[at:at + k])} {item(25)}", "en", "a")]
        want |= {(100 + i, i), (200 + i, i)}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert want <= found and len(found - want) <= 2


# ------------------------------------------------------------------ pages
CASES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav>"
     "<div class=\"ad\">Buy</div><article><h1>A &amp; B</h1><p><b>Bold</b>er&nbsp; text<br><p>Second\n line<!-- no --></p><aside>side</aside>"
     "<section id='comments'><p>I say</p></section></article><footer>&copy; x</footer>", "A & B Bolder text Second line"),
    ("<body><div id=menu><a href=a>One</a><a href=b>Two</a></div><div><p>" + "Plain words of a story go on. " * 8 + "</p><p>Short end.</p></div>"
     "<div class='cookie-notice'>We use " + "cookies " * 40 + "</div><form><label>Name</label></form></body>",
     " ".join(["Plain words of a story go on."] * 8) + " Short end."),
    ("", ""), (None, ""), ("<p", ""), ("just words", "just words"), ("<main><p title='a > b'>In</p><header><h2>Head</h2></header></main><p>out</p>", "In Head"),
    ("<article><form><p>ask</p></form><p hidden>no</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one two c1 c2"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "z") for i, (h, _) in enumerate(CASES)] + [(None, None, CASES[0][0], "z")] * 2,
                               "page_id long, url string, html string, text string")
    rows = pages.extract(df).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, i
    assert len(rows) == len(CASES) + 2 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert pages.extract(df.limit(0)).collect() == []


def test_shingle_hashes_follow_xxh64():
    from packaudit.llm import simhash
    assert list(simhash.shingle_hashes("A b\x0bC  dÉ")) == [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c dÉ")]
