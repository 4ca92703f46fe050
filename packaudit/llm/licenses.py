"""License scan by a positional index of rare licence words, with DataFrame functions only.

The templates' words get a document frequency over all documents. Each template is looked up by its
rarest words: where one stands in a text, the template is laid at the relative position of that word, the
words that agree there are counted, and the template's key phrase must stand in its place in full.
So many rare words are looked up that every laying with MIN_SHARE of the words agreeing is found, whatever
the frequencies are. A phrase of BASE is a template of its own whose words must all agree.

What the driver holds is one number per template word.

Defined cases: a null text counts as empty; every row gets its own result row, repeated or not, whatever doc_id is;
a text without a match has null word positions, empty labels and score 0; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is no word character once A-Z are in lower case; upper-case letters are kept by the first pattern.
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i:i + len(key)] == key)

    @property
    def need(self) -> int:
        """How many words must agree."""
        return len(self.words) if self.base else math.ceil(MIN_SHARE * len(self.words))


BASE = [
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
]
TEMPLATES = [
    *BASE,
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction",
             "hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2",
             "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             "mozilla public license v 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
             "is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
]


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def document_frequency(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """In how many texts each template word stands. One row per template word reaches the driver."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), BREAK_ANY_CASE))
    known = F.array(*[F.lit(w) for w in vocabulary(templates)])
    # The outer form keeps the planner from evaluating the words once more to filter out empty arrays.
    found = (docs.select(F.explode_outer(F.array_intersect(words, known)).alias("word")).where(F.col("word").isNotNull())
             .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    return {r["word"]: r["n"] for r in found.collect()}


def anchors(template: Template, frequency: dict[str, int]) -> list[int]:
    """Positions of the rarest words; any laying that agrees in ``need`` words agrees in one of them."""
    words = template.words
    rare = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), i))
    return sorted(rare[:len(words) - template.need + 1])


def _layings(templates: list[Template], at: dict[Template, list[int]]) -> Column:
    """Array of (template, start, agreeing words) for the words in column ``w``."""
    table = F.array(*[F.struct(F.array(*[F.lit(x) for x in t.words]).alias("words"), F.array(*[F.lit(x) for x in t.key.split()]).alias("key"),
                               F.lit(t.key_at).alias("key_at"), F.lit(t.need).alias("need")) for t in templates])
    rare = F.array(*[F.struct(F.lit(t.words[i]).alias("word"), F.lit(k).alias("t"), F.lit(i).alias("i"))
                     for k, t in enumerate(templates) for i in at[t]])
    known = sorted({t.words[i] for t in templates for i in at[t]})
    postings = F.filter(F.transform("w", lambda x, p: F.struct(x.alias("x"), p.alias("p"))), lambda s: s["x"].isin(known))
    starts = F.array_distinct(F.flatten(F.transform(postings, lambda s: F.transform(
        F.filter(rare, lambda r: r["word"] == s["x"]), lambda r: F.struct(r["t"].alias("t"), (s["p"] - r["i"]).alias("start"))))))

    def agreeing(c: Column) -> Column:
        words = F.get(table, c["t"])["words"]
        return F.aggregate(F.transform(words, lambda x, k: F.get(F.col("w"), c["start"] + k) == x), F.lit(0),
                           lambda n, hit: n + F.coalesce(hit, F.lit(False)).cast("int"))

    def has_key(c: Column) -> Column:
        own = F.get(table, c["t"])
        place = c["start"] + own["key_at"]
        return F.forall(F.transform(own["key"], lambda x, k: F.get(F.col("w"), place + k).eqNullSafe(x)), lambda hit: hit)

    laid = F.transform(F.filter(starts, has_key), lambda c: F.struct(c["t"].alias("t"), c["start"].cast("long").alias("start"), agreeing(c).alias("n")))
    return F.filter(laid, lambda z: z["n"] >= F.get(table, z["t"])["need"])


def _may_hold(key: str) -> Column:
    """A cheap test on the lower-case text ``low`` that every text with this key phrase passes."""
    long = sorted({w for w in key.split() if len(w) >= 6})
    if not long:
        return F.col("low").rlike(BREAK.join(key.split()))
    held = F.contains(F.col("low"), F.lit(long[0]))
    for word in long[1:]:
        held = held & F.contains(F.col("low"), F.lit(word))
    return held


def scan(docs: DataFrame, templates: list[Template] | None = None, frequency: dict[str, int] | None = None) -> DataFrame:
    """One row per document: words, base phrases, labels and the best share of agreeing words."""
    templates = TEMPLATES if templates is None else templates
    frequency = document_frequency(docs, templates) if frequency is None else frequency
    at = {t: anchors(t, frequency) for t in templates}
    text = F.coalesce("text", F.lit(""))
    maybe = F.lit(False)
    for key in sorted({t.key for t in templates}):
        maybe = maybe | _may_hold(key)
    parts = F.split("text", BREAK_ANY_CASE)
    sized = (docs.select("doc_id", text.alias("text"), F.lower(text).alias("low"))
             .select("doc_id", "text", maybe.alias("maybe"), parts.alias("parts"))
             .select("doc_id", (F.size("parts") - (F.get("parts", F.lit(0)) == "").cast("int")
                                - ((F.element_at("parts", -1) == "") & (F.size("parts") > 1)).cast("int"))
                     .cast("long").alias("n_words"), F.when(F.col("maybe"), F.col("text")).alias("text")))
    exact = F.filter(F.split(F.translate("text", UPPER, LOWER), BREAK), lambda x: x != "")
    words = sized.select("doc_id", "n_words", exact.alias("w"))
    laid = words.select("doc_id", "n_words", F.when(F.col("w").isNotNull(), _layings(templates, at)).alias("laid"))
    whole = laid.select("doc_id", "n_words", F.coalesce("laid", F.array().cast("array<struct<t:int,start:bigint,n:int>>")).alias("laid"))
    names, sizes = F.array(*[F.lit(t.label) for t in templates]), F.array(*[F.lit(float(len(t.words))) for t in templates])
    bases = [k for k, t in enumerate(templates) if t.base]
    base = F.filter("laid", lambda z: z["t"].isin(bases))
    start = F.transform(base, lambda z: z["start"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda z: F.get(names, z["t"])))), ",")

    share = F.array_max(F.transform("laid", lambda z: z["n"] / F.get(sizes, z["t"])))
    return whole.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"),
                        F.array_max(start).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("laid")).alias("labels"),
                        F.coalesce(share, F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same by joining every word of every text with every template word, without an index."""
    words = ", ".join(f"({i}, '{t.label}', {t.base}, {t.need}, {len(t.words)}, {t.key_at}, {len(t.key.split())}, {k}, '{w}')"
                      for i, t in enumerate(TEMPLATES) for k, w in enumerate(t.words))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(t, '{BREAK}'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
tpl(tid, label, base, need, size, key_at, key_len, k, word) AS (VALUES {words}),
laid AS (SELECT rid, tid, any_value(label) AS label, any_value(base) AS base, pos - k AS start, count(*) AS n, any_value(size) AS size
         FROM p JOIN tpl USING (word) GROUP BY rid, tid, pos - k
         HAVING count(*) >= any_value(need) AND count(*) FILTER (WHERE k >= key_at AND k < key_at + key_len) = any_value(key_len)),
per AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
               max(start) FILTER (WHERE base) AS last_word,
               array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
               array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(n / size) AS score
        FROM laid GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN per USING (rid)"""
