"""Hashed character n-grams of whole texts, in numpy and in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Characters handled at once; longer texts go in overlapping slices.
BLOCK = 1_000_000
#: Longest n-gram, hence one more than the overlap of two slices.
ORDER = 3

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass
class Block:
    """Slices of texts laid end to end. Slice k is points[start[k]:end[k]] of text owner[k]; what lies before fresh[k] is
    context that the slice before has counted."""

    points: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    fresh: np.ndarray
    end: np.ndarray


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[Block]:
    """Every character of every text exactly once as fresh, in blocks of about ``size``."""
    parts: list[tuple[int, str, int]] = []
    held = 0
    for owner, text in enumerate(texts):
        for at in range(0, len(text), size):
            context = min(at, ORDER - 1)
            parts.append((owner, text[at - context:at + size], context))
            held += len(parts[-1][1])
            if held >= size:
                yield _laid(parts)
                parts, held = [], 0
    if parts:
        yield _laid(parts)


def _laid(parts: list[tuple[int, str, int]]) -> Block:
    lengths = np.array([len(p[1]) for p in parts], np.int64)
    end = np.cumsum(lengths)
    start = end - lengths
    return Block(np.frombuffer("".join(p[1] for p in parts).encode("utf-32-le"), np.uint32),
                 np.array([p[0] for p in parts], np.int64), start, start + np.array([p[2] for p in parts], np.int64), end)


def ngrams(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each position; the first order - 1 entries mean nothing."""
    h = points * np.uint32(_MULTIPLIERS[0]) + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)
    for k in range(1, order):
        h[k:] ^= points[:-k] * np.uint32(_MULTIPLIERS[k]) + (points[:-k] >> np.uint32(3 * k))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def spans(block: Block, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) position of each slice at which an n-gram of its text ends."""
    return np.minimum(np.maximum(block.fresh, block.start + order - 1), block.end), block.end


def segment_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of rows begin[k]:end[k] of ``values``."""
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
    sums = np.add.reduceat(padded, np.stack([begin, end], 1).ravel(), axis=0)[::2]
    sums[begin >= end] = 0
    return sums
