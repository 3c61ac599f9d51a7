"""Vectorised work on the UTF-8 bytes of many texts at once.

Tasks read Arrow batches of documents in blocks of a few MB (:func:`blocks`), whatever the number of
rows in a batch, so that memory stays bounded; one longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_IS_WORD = np.ones(256, bool)
_IS_WORD[0x00:0x30] = False
_IS_WORD[0x3A:0x61] = False
_IS_WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Block:
    """Texts side by side: ``data`` bytes, text i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, texts: pa.Array, first: int):
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            width = np.int64
        else:
            width = np.int32
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, width)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[at[0]: at[-1]]
        self.offsets = at - at[0]
        self.first = first
        self.rows = len(texts)

    def text(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i]: self.offsets[i + 1]]

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run of true bytes; runs do not cross texts."""
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[:1] = False
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def lowered(self) -> np.ndarray:
        return _LOWER[self.data]

    def plain_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of anything but white space (space, \\t to \\r)."""
        return self.runs(~_IS_SPACE[self.data])

    def lower_words(self, lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of digits, letters a to z and non-ASCII bytes."""
        return self.runs(_IS_WORD[lowered])

    def per_row(self, rows: np.ndarray, weights=None) -> np.ndarray:
        """Sum by text; ``rows`` must be sorted."""
        found = np.bincount(rows, weights, minlength=self.rows)
        return found.astype(np.int64)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    texts = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(lengths)))
    first = 0
    while first < len(lengths):
        last = int(np.searchsorted(total, total[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(lengths))
        yield Block(texts.slice(first, last - first), first)
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shift, xor, multiply)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run: the sum of a random-looking value per (byte, position in the run)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    byte = data[np.repeat(starts, lengths) + within]
    value = mixed((within.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(seed << 40))
    return mixed(np.add.reduceat(value, firsts) + lengths.astype(np.uint64))


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive values (``len - size + 1`` of them)."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out ^ hashes[i: i + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mixed(out)
