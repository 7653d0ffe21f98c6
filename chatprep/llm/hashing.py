"""Word and shingle hashes of Arrow batches, a bounded slice at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into numpy arrays at once.
SLICE_BYTES = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_AS_IS = np.arange(256, dtype=np.uint64)
# For words of letters and digits alone; bytes of other alphabets count as letters.
_IS_MARK = _IS_BLANK.copy()
_IS_MARK[[b for b in range(128) if not chr(b).isalnum()]] = True

_ALL = 0xFFFFFFFFFFFFFFFF
_BASE = 0x9E3779B97F4A7C15
_TWO = np.uint64(0xBF58476D1CE4E5B9)
_THREE = np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * _BASE + 0x632BE59BD9B4E019) & _ALL)
    x = (x ^ (x >> np.uint64(30))) * _TWO
    x = (x ^ (x >> np.uint64(27))) * _THREE
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def _piece(text: bytes, lower: bool, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    blank = (_IS_MARK if marks else _IS_BLANK)[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers_to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(((_LOWER if lower else _AS_IS)[raw] + np.uint64(1)) * up[: len(raw)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return starts, mix(value, 3) ^ mix((ends - starts).astype(np.uint64), 5)


def word_hashes(values: list[bytes | None], lower: bool = True, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, one text after
    the other, and the bounds of each text. ``lower`` folds A-Z; with ``marks`` ASCII
    punctuation parts words like a blank. A null has no words."""
    joined = b"\n".join(v or b"" for v in values)
    sizes = np.fromiter((len(v or b"") + 1 for v in values), np.int64, len(values))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    starts, hashes, begin = [], [], 0
    while begin < len(joined):
        # A piece ends before a blank, so no word lies in two pieces.
        found = _BLANK.search(joined, begin + SLICE_BYTES)
        end = found.start() if found else len(joined)
        at, made = _piece(joined[begin:end], lower, marks)
        starts.append(at + begin)
        hashes.append(made)
        begin = max(end, begin + 1)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(values) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches with about ``size`` bytes (``SLICE_BYTES``) of ``column``, text or binary, and its
    values as bytes, None for null. One longer value makes a part of its own."""
    for batch in batches:
        values = batch.column(column).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            limit = (ends[begin - 1] if begin else 0) + (size or SLICE_BYTES)
            count = max(1, int(np.searchsorted(ends, limit, "right")) - begin)
            yield batch.slice(begin, count), values.slice(begin, count).to_pylist()
            begin += count


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows of texts that lie one after the other, cut at
    ``bounds``; the text of each, and its first word. No window spans two texts."""
    lengths = np.diff(bounds)
    counts = np.maximum(lengths - k + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    before = np.cumsum(counts) - counts
    first = np.repeat(bounds[:-1] - before, counts) + np.arange(len(owner))
    total = np.zeros(len(owner), np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + hashes[first + j]
    return mix(total, k), owner, first
