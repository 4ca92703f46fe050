"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a partition, in its order, are one stream of tokens. Cuts may be placed at the end of a document (free), at the
end of a sentence (SENTENCE) or, inside long sentences, at every STRIDE tokens (INSIDE). The plan minimises padding plus
cut penalties:

    best[j] = penalty[j] + min over i with 0 < at[j] - at[i] <= window of best[i] + window - (at[j] - at[i])

so the minimum of best[i] + at[i] over a sliding window is wanted, which a monotone queue gives in constant time per cut.
The stream is planned in stretches of STRETCH tokens; the last, unfinished window of a stretch starts the next one, so
only the last window of a partition is short. No row is shuffled, no task holds more than a stretch and a document.

Defined cases: a null text counts as empty; an empty text is the single end token; texts longer than a window spread over many;
null or repeated doc_ids are packed row by row like any other; an empty partition gives nothing; other columns are not
looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WINDOW = 2048
END = 1
SENTENCE, INSIDE = 1.0, 6.0
STRIDE = 32
STRETCH = 1 << 18
#: Distinct space-separated chunks whose ids a task remembers; then it starts anew.
REMEMBERED = 700_000
#: A special token of the vocabulary that is put between chunks encoded together.
BETWEEN = "<|startoftext|>"
#: Marks that may close a chunk; none of them is part of a special token.
CLOSING = ".,!?;:%&$#*)"
#: Tokens that end a sentence, by their text in the vocabulary.
STOPS = [".</w>", "!</w>", "?</w>", "...</w>"]
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Codes(dict):
    """A number for each chunk; new ones are noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.new.append(chunk)
        return code


class Encoder:
    """Ids of whole texts. No token reaches over a space or a line break, so chunks between them are encoded once each."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given the task its core
        self.tokenizer = Tokenizer.from_str(spec)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        stops = [i for i in (self.tokenizer.token_to_id(t) for t in STOPS) if i is not None]
        self.stops = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.stops[stops] = True
        self._clear()

    def _clear(self) -> None:
        self.codes = Codes()
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self) -> None:
        """Ids of the new chunks. A chunk that is letters or digits before closing marks is put together from these two, as
        no token spans both; the others are encoded together, with a special token between them, or alone if they hold that."""
        chunks, self.codes.new = self.codes.new, []
        first = len(self.codes) - len(chunks)
        plain, codes, joint = [], [], []
        for code, chunk in enumerate(chunks, first):
            core = chunk.rstrip(CLOSING)
            if core and len(core) < len(chunk) and core[-1].isalnum():
                joint.append((code, self.codes[core], self.codes[chunk[len(core):]]))
            else:
                plain.append(chunk)
                codes.append(code)
        codes += range(first + len(chunks), len(self.codes))
        plain += self.codes.new
        self.codes.new = []
        if self.between is None or any(BETWEEN in c for c in plain):
            parts = [self._ids(c) for c in plain]
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        else:
            ids = self._ids(BETWEEN.join(plain))
            at = np.flatnonzero(ids == self.between)
            lengths = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            ids = np.delete(ids, at)
        while len(self.codes) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(max(len(x), 1024), np.int64)]) for x in (self.starts, self.lengths))
        self._keep(np.array(codes, np.int64), ids, lengths)
        if joint:
            code, *two = np.array(joint, np.int64).T
            self._keep(code, self._flat(np.stack(two, 1).ravel()), self.lengths[two[0]] + self.lengths[two[1]])

    def _keep(self, codes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.starts[codes], self.lengths[codes] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)

    def _flat(self, codes: np.ndarray) -> np.ndarray:
        """Ids of chunks one after the other."""
        n, begin = self.lengths[codes], self.starts[codes]
        to = np.cumsum(n)
        return self.pool[np.arange(to[-1]) + np.repeat(begin - (to - n), n)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end token."""
        if len(self.codes) > REMEMBERED:
            self._clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        coded = [np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks)) for chunks in split]
        if self.codes.new:
            self._learn()
        return [np.append(self._flat(code), np.uint32(END)) for code in coded]


def cut_points(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after which the stream may be cut, from 1 on, and what a cut there costs. ``stops`` says which ids end a sentence."""
    kind = np.zeros(len(ids) + 1, np.int8)
    kind[1:][stops[ids]] = 2
    kind[ends] = 3
    edge = np.concatenate([[0], np.flatnonzero(kind)])
    more = (np.diff(edge) - 1) // STRIDE
    kind[np.repeat(edge[:-1], more) + STRIDE * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0.0, INSIDE, SENTENCE, 0.0])[kind[at]]


def plan(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts of least padding plus penalties, the last of ``at`` among them; monotone queue over best[i] + at[i]."""
    places, costs = [0, *at.tolist()], [0.0, *cost.tolist()]
    best, back = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(places)):
        here = places[j]
        while places[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        best[j] = total = costs[j] + value + window - here
        back[j] = i
        total += here
        while queue and queue[-1][0] >= total:
            queue.pop()
        queue.append((total, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


class Stream:
    """Turns documents, in order, into pieces of sequences."""

    def __init__(self, first: int, stops: np.ndarray, window: int = WINDOW, stretch: int = STRETCH):
        self.sequence, self.stops, self.window, self.stretch = first, stops, window, stretch
        self.held: list[tuple[object, np.ndarray, int]] = []  # key, all ids, ids already placed
        self.size = 0

    def add(self, key: object, ids: np.ndarray) -> list[tuple]:
        self.held.append((key, ids, 0))
        self.size += len(ids)
        return self._place(False) if self.size >= self.stretch else []

    def finish(self) -> list[tuple]:
        return self._place(True) if self.held else []

    def _place(self, all_of_it: bool) -> list[tuple]:
        parts = [ids[done:] for _, ids, done in self.held]
        ends = np.cumsum([len(p) for p in parts])
        ids = np.concatenate(parts)
        cuts = plan(*cut_points(ids, ends, self.stops), self.window)
        if not all_of_it:
            cuts = [c for c in cuts[:-1] if ends[-1] - c >= 0]
        out, k, start = [], 0, 0
        for cut in cuts:
            at = start
            while at < cut:
                key, whole, done = self.held[k]
                stop = min(cut, int(ends[k]))
                begin = len(whole) - (int(ends[k]) - at)
                piece = whole[begin:begin + stop - at]
                out.append((key, begin, stop - at, zlib.crc32(piece.astype("<u4").tobytes()), len(whole), self.sequence, at - start))
                at = stop
                if stop == ends[k]:
                    k += 1
            self.sequence += 1
            start = cut
        rest = []
        for j in range(k, len(self.held)):
            key, whole, _ = self.held[j]
            rest.append((key, whole, max(len(whole) - (int(ends[j]) - start), 0)))
        self.held, self.size = rest, int(ends[-1]) - start
        return out


def pack(docs: DataFrame, spec: str, window: int = WINDOW) -> DataFrame:
    """One row per piece. ``spec`` is the tokenizer's JSON; it is read on the driver and sent along."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    inner = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = inner.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        stream = Stream(TaskContext.get().partitionId() << 40, encoder.stops, window)
        names = ["doc_id", *re.findall(r"(\w+) long", PIECE)]

        def rows(pieces: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), types)], names)

        types = None
        for batch in batches:
            types = types or [batch.column(0).type, *[pa.int64()] * 6]
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 64):
                pieces = [p for key, ids in zip(keys[at:at + 64], encoder.encode(texts.slice(at, 64).to_pylist()))
                          for p in stream.add(key, ids)]
                if pieces:
                    yield rows(pieces, types)
        pieces = stream.finish()
        if pieces:
            yield rows(pieces, types)

    return inner.mapInArrow(run, f"doc_id {kind.simpleString()}, {PIECE}")


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
