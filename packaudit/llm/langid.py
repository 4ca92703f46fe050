"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language come from all labelled training rows, summed by Spark; the
log-probability matrix (languages x 2^BITS, bounded by the number of languages) is broadcast and
texts are scored in numpy as sparse count vectors times that matrix.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without training
rows every text is ``und``; a null doc_id is not held out and teaches nothing; repeated rows are
scored each by themselves; equal scores go to the language that sorts first; other columns of the
table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm import chars
from packaudit.llm.columns import free

BITS = 16
SMOOTHING = 0.5
UNKNOWN = "und"
#: See bounds(); LEAST_MARGIN in nats an n-gram.
MARGIN = 30
LEAST_MARGIN = 1.5
#: Code points from here on are letters for our purpose, except general punctuation.
_TABLE = 0x250
_EMPTY = 1 << BITS


def _folding() -> np.ndarray:
    """Lower-case letter of each code point below _TABLE; a space for all that is no letter."""
    return np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 32 for c in range(_TABLE)],
                    np.uint32)


_FOLD = _folding()


def folded(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, everything else a space."""
    out = points.copy()
    low = points < _TABLE
    out[low] = _FOLD[points[low]]
    out[(points >= 0x2000) & (points < 0x2070)] = 32
    return out


def buckets(block: chars.Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the buckets and the spans of the slices; runs of spaces fall into one unused bucket."""
    points = folded(block.points)
    space = points == 32
    blank = space.copy()
    blank[1:] &= space[:-1]
    for order in range(1, chars.ORDER + 1):
        found = chars.ngrams(points, order, BITS)
        found[blank] = _EMPTY
        yield (found, *chars.spans(block, order))


def held_out(remainder: int, parts: int):
    """Column: does crc32 of the doc_id as text leave this remainder?"""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n, docs) of labelled texts; bucket -1 carries the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                table = tables.setdefault(lang, np.zeros(_EMPTY + 1, np.int64))
                docs[lang] = docs.get(lang, 0) + len(own)
                for block in chars.blocks(own):
                    for found, begin, end in buckets(block):
                        # Every position but the few between slices counts; take those back.
                        table += np.bincount(found, minlength=_EMPTY + 1)
                        for a, b in zip(np.concatenate([[0], end[:-1]]), begin):
                            if b > a:
                                np.subtract.at(table, found[a:b], 1)
        for lang, table in tables.items():
            used = np.flatnonzero(table[:_EMPTY])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1), pa.int64()),
                 pa.array(np.append(table[used], docs[lang]), pa.int64())], ["lang", "bucket", "n"])

    return (rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (bucket x language, a row of zeros last) and log-priors.

    What reaches the driver is one number per language and bucket, whatever the rows.
    """
    labelled = rows.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    table = count_ngrams(labelled).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((_EMPTY, len(langs)))
    docs = np.zeros(len(langs))
    which = table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64, na_value=0)
    bucket, n = table["bucket"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    counts[bucket[bucket >= 0], which[bucket >= 0]] = n[bucket >= 0]
    docs[which[bucket < 0]] = n[bucket < 0]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * _EMPTY) if langs else counts
    return langs, np.vstack([logs, np.zeros((1, len(langs)))]).astype(np.float64), np.log(np.maximum(docs, 1) / max(docs.sum(), 1))


def log_likelihoods(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Sum over a text's n-grams of the languages' log-probabilities, text by text."""
    out = np.zeros((len(texts), logs.shape[1]))
    for block in chars.blocks(texts):
        for found, begin, end in buckets(block):
            np.add.at(out, block.owner, chars.segment_sums(logs[found], begin, end))
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], fit: bool = False,
             names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score (the posterior); if asked, also fit: the mean log-probability of the text's
    n-grams in that language, null without one. ``names`` are theirs, for callers that keep columns of these names."""
    langs, logs, prior = model
    if fit:
        # One more column counts the n-grams.
        logs = np.hstack([logs, np.ones((len(logs), 1))])
        logs[_EMPTY:] = 0
    shared = docs.sparkSession.sparkContext.broadcast((logs, prior))
    inner = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                        F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("t"))
    schema = ", ".join([f"k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))]
                       + ["lang_pred string", "score double"] + ["fit double"] * fit)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, prior = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            lang, sure, mean = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if langs:
                sums = log_likelihoods([t or "" for t in texts], logs)
                total = sums[:, :len(langs)] + prior
                best = total.argmax(1)
                sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                sure[[t is None for t in texts]] = 0
                lang = [UNKNOWN if t is None else langs[b] for t, b in zip(texts, best)]
                if fit:
                    mean = np.where(sums[:, -1] > 0, sums[np.arange(len(texts)), best] / np.maximum(sums[:, -1], 1), np.nan)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(sure, pa.float64())]
                + [pa.array(mean, pa.float64(), from_pandas=True)] * fit,
                [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"] + ["fit"] * fit)

    out = inner.mapInArrow(score, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                      *[F.col(c).alias(n) for c, n in zip(["lang_pred", "score"] + ["fit"] * fit, names)])


def bounds(rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> dict[str, float]:
    """The least fit a text of each language may have, from labelled rows that the model was not trained on.

    It lies below the median of the language's rows by MARGIN times the distance from there to their lower quartile, and by LEAST_MARGIN
    at least; a few rows with a wrong label do not move it. A language without such rows has none. One number a language comes to the driver.
    """
    judged = identify(rows.where(F.col("lang").isNotNull()), model, ["lang"], fit=True).where("lang = lang_pred and fit is not null")
    found = judged.groupBy("lang").agg(F.percentile_approx("fit", [0.25, 0.5]).alias("q")).collect()
    return {r["lang"]: r["q"][1] - max(MARGIN * (r["q"][1] - r["q"][0]), LEAST_MARGIN) for r in found}


def recognised(docs: DataFrame, sure: float) -> DataFrame:
    """The documents, with their columns, whose language is at least ``sure`` and whose text fits it by ``bounds``."""
    model = train(docs.where(~held_out(1, 3)).where(F.col("doc_id").isNotNull()))
    least = bounds(docs.where(held_out(1, 3)), model)
    lang, score, fit = free(docs.columns, "lang_pred", "score", "fit")
    fits = F.lit(True)
    for known, bound in least.items():
        fits = fits & ((F.col(lang) != known) | (F.col(fit) >= bound))
    judged = identify(docs, model, docs.columns, fit=True, names=(lang, score, fit))
    return judged.where((F.col(lang) != UNKNOWN) & (F.col(score) >= sure) & fits).select(*docs.columns)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    model = train(docs.where(~held_out(1, 3)).where(F.col("doc_id").isNotNull()))
    return (identify(docs, model, ["doc_id"])
            .select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score"))
