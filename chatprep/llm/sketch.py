"""Fast similarity sketching of many sets at once."""

from __future__ import annotations

import numpy as np

from chatprep.llm.hashing import mix

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE_BITS = np.uint64(48)
_VALUE = np.uint64((1 << 48) - 1)


def sketches(members: np.ndarray, owner: np.ndarray, sets: int, size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each of ``sets`` non-empty sets.

    Rounds 0 to size-1 throw every member into a random bin, rounds size to 2*size-1
    into bin 0, 1, .. in turn. A coordinate keeps the smallest (round, value) that fell
    into it, and a set stops after the round that has filled all its bins, so no
    coordinate stays empty and two sets agree in a coordinate with the probability of
    their Jaccard similarity, concentrated as for ``size`` independent minima.
    """
    filled = np.full((sets, size), _FULL)
    for turn in range(2 * size):
        if not len(members):
            break
        thrown = mix(members, turn + 1)
        if turn < size:
            bins = ((thrown >> _VALUE_BITS) * np.uint64(size) >> np.uint64(16)).astype(np.int64)
        else:
            bins = np.full(len(members), turn - size)
        # Bits below the bin number are independent of it.
        value = (np.uint64(turn) << _VALUE_BITS) | (thrown & _VALUE)
        np.minimum.at(filled.reshape(-1), owner * size + bins, value)
        empty = (filled == _FULL).any(axis=1)
        if not empty.any():
            break
        going = empty[owner]
        members, owner = members[going], owner[going]
    return filled


def bands(filled: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates, different between bands."""
    sets, size = filled.shape
    parts = filled.reshape(sets, size // rows, rows)
    key = np.broadcast_to(np.arange(size // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ mix(parts[:, :, j], j + 1), j + 7)
    return key
