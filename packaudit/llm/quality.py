"""Quality classifier: a support vector machine on naive Bayes features.

Indicators of hashed n-grams (characters, and words as shapes with a mark for repetition) are scaled by the
log-count ratio of the two classes; a linear hinge-loss model is fitted by dual coordinate descent, and its
margin is turned into a probability on labelled rows kept back from the fit.

The fit uses at most SAMPLE labelled rows of each class, those whose hashed doc_id is smallest; every document
is scored, over its whole text.

Defined cases: a null text counts as empty; an empty text has no indicator and gets the score of the bias; labels
that are null, neither 0 nor 1, or contradict each other are left out; with labels of one class only, that class
is the score, with none the score is 0.5; a null doc_id is not held out and teaches nothing; repeated rows are scored
each by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.llm import chars
from packaudit.llm.langid import held_out

BITS = 16
#: Labelled rows of each class that the fit looks at, at most.
SAMPLE = 3000
ACCEPT = 0.7
_WORDS = 1 << 12
WIDTH = (1 << BITS) + _WORDS
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def _shape(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Class of each word in 0..31: how it starts, how it ends, and whether it is short."""
    def kind(at: np.ndarray) -> np.ndarray:
        c = points[at]
        upper = ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE))
        digit = (c >= 48) & (c <= 57)
        letter = ((c >= 97) & (c <= 122)) | (c >= 0xDF)
        return np.where(upper, 0, np.where(letter, 1, np.where(digit, 2, 3)))

    return kind(first) * 8 + kind(last) * 2 + (last - first < 3)


def word_features(points: np.ndarray) -> np.ndarray:
    """Buckets of word shapes in twos, each with a mark if the word repeats the one before or the last two."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.diff(np.concatenate([[1], space, [1]]).astype(np.int8))
    first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(first) < 2:
        return np.zeros(0, np.int64)
    order = np.arange(len(points)) - np.repeat(first, np.diff(np.append(first, len(points)))) if first[0] == 0 else \
        np.concatenate([np.zeros(first[0], np.int64), np.arange(first[0], len(points)) - np.repeat(first, np.diff(np.append(first, len(points))))])
    term = np.where(space, 0, (points.astype(np.uint64) + np.uint64(7)) * _POWERS[np.minimum(order, 63)])
    word = np.add.reduceat(term, first)
    shape = _shape(points, first, stop - 1)
    same = (word[1:] == word[:-1]).astype(np.int64)
    same[1:] += same[1:] & (same[:-1] > 0)
    return (shape[:-1] * 32 + shape[1:]) * 3 + np.minimum(same, 2)


def indicators(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted buckets that occur in each text, text by text."""
    seen, at = np.zeros(WIDTH, bool), 0
    for block in chars.blocks(texts):
        hashed = [(chars.ngrams(block.points, n, BITS), *chars.spans(block, n)) for n in range(1, chars.ORDER + 1)]
        for k, owner in enumerate(block.owner):
            while at < owner:
                yield np.flatnonzero(seen)
                seen[:] = False
                at += 1
            for found, begin, end in hashed:
                seen[found[begin[k]:end[k]]] = True
            seen[(1 << BITS) + word_features(block.points[block.start[k]:block.end[k]])] = True
    while at < len(texts):
        yield np.flatnonzero(seen)
        seen[:] = False
        at += 1


@dataclass
class Model:
    """score = sigmoid(slope * (weights . indicators / norm + bias) + shift), where norm is that of the scaled indicators."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[i].sum() / np.sqrt(max(self.squares[i].sum(), 1e-12)) + self.bias for i in rows])

    def scores(self, rows: Iterator[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def constant(p: float) -> Model:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, float(np.log(p / (1 - p))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 20, smoothing: float = 1.0) -> Model:
    """Naive Bayes scaling, dual coordinate descent for the hinge loss, then a sigmoid on the rows kept back."""
    if len(rows) == 0 or labels.min() == labels.max():
        return constant(0.5 if len(rows) == 0 else float(labels[0]))
    back = np.arange(len(rows)) % 5 == 4
    if len(set(labels[back])) < 2 or len(set(labels[~back])) < 2:
        back[:] = False
    train = np.flatnonzero(~back)
    count = np.full((2, WIDTH), smoothing)
    for i in train:
        count[int(labels[i]), rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    values = {i: ratio[rows[i]] / max(np.linalg.norm(ratio[rows[i]]), 1e-6) for i in train}
    w, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    sign = np.where(labels > 0, 1.0, -1.0)
    share = {1.0: len(train) / (2 * (sign[train] > 0).sum()), -1.0: len(train) / (2 * (sign[train] < 0).sum())}
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train):
            x, y = values[i], sign[i]
            gradient = y * (w[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0), cost * share[y])
            step = (new - alpha[i]) * y
            if step:
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    model = Model(w * ratio, ratio * ratio, bias, 1.0, 0.0)
    held = np.flatnonzero(back) if back.any() else train
    margin, target = model.margins([rows[i] for i in held]), (labels[held] > 0).astype(float)
    high, low = (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2)
    model.slope, model.shift = _sigmoid(margin, np.where(target > 0, high, low))
    return model


def _sigmoid(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits ``target`` best, by Newton steps on the log loss."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(p - target) @ margin, (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[v @ margin ** 2, v @ margin], [v @ margin, v.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def sampled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Features and label of at most ``size`` labelled documents of each class that are not held out.

    A doc_id that stands on many rows is one document: the text whose hash is smallest, then the smallest, counts.
    """
    clear = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id")
             .agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").drop("y2")
             .where(~held_out(2, 4)).withColumn("h", F.xxhash64("doc_id")))
    picked = None
    for y in (0, 1):
        one = clear.where(F.col("y") == y).orderBy("h", "doc_id").limit(size)
        picked = one if picked is None else picked.unionByName(one)
    # At most 2 * size rows of three numbers, whatever the table: safe to broadcast.
    text = F.coalesce("text", F.lit(""))
    rows = (docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "h", "y")
            .agg(F.min_by("text", F.struct(F.xxhash64("text").alias("a"), F.col("text").alias("b"))).alias("text")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([x.astype(np.int32) for x in indicators(batch.column(2).to_pylist())], pa.list_(pa.int32()))],
                ["h", "y", "x"])

    found = rows.select("h", F.col("y").cast("int").alias("y"), "text").mapInArrow(extract, "h long, y int, x array<int>")
    return found.orderBy("h", "x")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sampled(docs, labels).toPandas()
    return fit([np.asarray(x, np.int64) for x in rows["x"]], rows["y"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = inner.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.scores(indicators(batch.column(1).to_pylist())), pa.float64())],
                ["doc_id", "score"])

    out = inner.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "score",
                      (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
