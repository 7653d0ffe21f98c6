"""An adaptive context-mixing range coder for token ids.

A block of ids is cut into streams of consecutive ids that are coded side by side, so each step of the coder is a few numpy operations over all of them. They share
one model, which starts from nothing with each block and learns from every step:

* The id that last followed the last two ids (order 2), and the one that last followed the
  last id (order 1), with a confidence that grows while they hold. The first of them that
  is known is the candidate.
* The chance that the candidate holds, mixed from three adaptive estimates: its rate at
  this confidence of order 2, its rate at this confidence and agreement of order 1, and its
  rate at all. Their weights follow how well each foretold what came.
* Adaptive order-0 frequencies for the ids that were not the candidate.

A writer knows all ids, so followers, chances and bounds come for many steps at once, and
only the range coder goes step by step.

The range coder has 64 bits, puts out words of 16 and adds a carry to the word before.
Words of all streams lie in the order in which a reader wants them. Everything is
integer arithmetic: what one machine writes reads the same on any other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

STREAMS = 2048
#: Ids of one stream of a full block.
STEPS = 256
BLOCK = STREAMS * STEPS
#: Blocks that are written and read at once.
TOGETHER = 1

_BITS = 15
_TOTAL = 1 << _BITS
_ONE, _TWO = 13, 15  # bits of the tables of followers of one and of two ids
_SURE = 15
_JOINT = (_SURE + 1) * 2 * (_SURE + 1)
_WEIGHT = 24  # what one id adds to its order-0 frequency of 1
_U = np.uint64
_SHIFT, _TOP, _LEAST = _U(16), _U(48), _U(1 << 48)
_FULL = 0xFFFFFFFFFFFFFFFF


def _mixes(step: int) -> bool:
    """Whether the chances are mixed anew before this step."""
    return step % 8 == 0 or step in (1, 2, 4)


def _adds_up(step: int) -> bool:
    """Whether the order-0 frequencies are added up anew before this step."""
    return step % 32 == 0 or step in (1, 2, 4, 8, 16)


def _places(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where the followers of the last id and of the last two lie, order 2 after order 1."""
    mixed = last * 40503
    one = mixed >> 3 & (1 << _ONE) - 1
    two = (mixed + before * 30011 >> 4 & (1 << _TWO) - 1) + (1 << _ONE)
    return np.stack((one, two), axis=-2)


class _Followers:
    """The ids that last followed one and two ids, each with how sure it is."""

    def __init__(self):
        self.table = np.zeros((1 << _ONE) + (1 << _TWO), np.uint32)

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate of each stream, and the class of its chance."""
        self.at, self.entry = at, self.table.take(at)
        self.ids, self.sure = self.entry >> 4, self.entry & _SURE
        candidate = np.where(self.sure[1] > 0, self.ids[1], self.ids[0])
        agree = (self.ids[0] == candidate).view(np.uint8).astype(np.uint32)
        return candidate, (self.sure[1] << 1 | agree) << 4 | self.sure[0]

    def learn(self, ids: np.ndarray) -> None:
        # An entry that held grows surer, one that failed loses half of it, at last its place.
        held = self.ids == ids
        kept = np.where(held, self.entry + (self.sure < _SURE).view(np.uint8), self.entry - (self.sure + 1 >> 1))
        held |= self.sure > 1
        self.table[self.at] = np.where(held, kept, ids << 4 | 1)


class _Chances:
    """The chance that a candidate holds, for every class, from what has been seen so far."""

    def __init__(self):
        self.hits, self.all = np.zeros(_JOINT, np.int64), np.zeros(_JOINT, np.int64)
        self.weights = np.full(3, _TOTAL // 3, np.int64)
        self.mix(first=True)

    def count(self, joint: np.ndarray, hit: np.ndarray) -> None:
        seen = np.bincount((joint << 1 | hit.view(np.uint8)).ravel(), minlength=2 * _JOINT).reshape(-1, 2)
        self.hits += seen[:, 1]
        self.all += seen.sum(1)

    def mix(self, first: bool = False) -> None:
        hits, seen = self.hits.reshape(_SURE + 1, -1), self.all.reshape(_SURE + 1, -1)
        rate = lambda axis: (hits.sum(axis, keepdims=True) * 2 + 1) * _TOTAL // (seen.sum(axis, keepdims=True) * 2 + 2)
        parts = [rate(axis) for axis in (1, 0, (0, 1))]
        if not first:
            # Each estimate's weight moves to its share in the chances of what came since.
            new_hits, new_all = hits - self.old_hits, seen - self.old_all
            mixed = np.maximum(self._mixed(parts), 1)
            other = np.maximum(_TOTAL - mixed, 1)
            count = max(int(new_all.sum()), 1)
            new_lost = new_all - new_hits
            for k, p in enumerate(parts):
                share = (new_hits * p << 10) // mixed + (new_lost * (_TOTAL - p) << 10) // other
                self.weights[k] = max(int(self.weights[k]) * (int(share.sum()) // count + 1024) >> 11, 64)
            self.weights = self.weights * _TOTAL // self.weights.sum()
        self.chances = np.clip(self._mixed(parts), 32, _TOTAL - 32).astype(np.uint64).reshape(-1)
        self.old_hits, self.old_all = hits.copy(), seen.copy()

    def _mixed(self, parts: list[np.ndarray]) -> np.ndarray:
        return sum(w * p for w, p in zip(self.weights, parts)) // self.weights.sum()


class _Frequencies:
    """Order-0 frequencies of the ids that were not the candidate, and their bounds."""

    def __init__(self, vocabulary: int):
        self.frequency = np.ones(vocabulary, np.int64)
        self.bounds = np.zeros(vocabulary + 1, np.uint64)
        self.missed: list[np.ndarray] = []
        self.add_up()

    def add_up(self) -> None:
        if self.missed:
            self.frequency += _WEIGHT * np.bincount(np.concatenate(self.missed), minlength=len(self.frequency))
            self.missed.clear()
        self.widths = self.frequency.astype(np.uint64)
        np.cumsum(self.widths, out=self.bounds[1:])
        self.total = self.bounds[-1]


def _encode(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """Words of a block ``ids[stream, step]``."""
    lanes, steps = ids.shape
    ids = np.ascontiguousarray(ids.T)
    # The two ids before the first one are 0.
    told = np.concatenate((np.zeros((2, lanes), np.int64), ids[:-1]))
    at = _places(told[1:], told[:-1])
    followers, chances, frequencies = _Followers(), _Chances(), _Frequencies(vocabulary)
    hit, joint = np.zeros(ids.shape, bool), np.zeros(ids.shape, np.uint32)
    for t, now in enumerate(ids):
        candidate, joint[t] = followers.predict(at[t])
        np.equal(candidate, now, out=hit[t])
        followers.learn(now)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
    room = 3 * steps + 8
    words, place = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    wanted: list[np.ndarray] = [np.zeros(0, np.int64)]
    turns = [t for t in range(steps) if _mixes(t)]
    for begin, end in zip(turns, [*turns[1:], steps]):
        if begin:
            chances.mix()
        if begin and _adds_up(begin):
            frequencies.add_up()
        some, held = ids[begin:end], hit[begin:end]
        chance = chances.chances.take(joint[begin:end])
        # An id that is the candidate begins at 0 and has the candidate's share alone.
        starts, sizes, total = frequencies.bounds.take(some), frequencies.widths.take(some), frequencies.total
        chances.count(joint[begin:end], held)
        frequencies.missed.append(some[~held])
        for h, c, start, size in zip(held, chance, starts, sizes):
            share = (width >> _U(_BITS)) * c
            unit = (width - share) // total
            below = low
            low = low + np.where(h, _U(0), share + unit * start)
            width = np.where(h, share, unit * size)
            over = low < below
            if over.any():
                words[place[over] - 1] += 1
            small = np.flatnonzero(width < _LEAST)
            while len(small):
                k, l, w = place[small], low[small], width[small] << _SHIFT
                words[k] = l >> _TOP
                low[small] = l << _SHIFT
                width[small] = w
                place[small] = k + 1
                wanted.append(k)
                small = small[w < _LEAST]
    for k in range(4):
        words[place + k] = low >> _U(48 - 16 * k) & _U(0xFFFF)
    while len(carried := np.flatnonzero(words >> 16)):
        # A stream's first word takes no carry from the stream before: none leaves a stream.
        carry = words[carried] >> 16
        words[carried] &= 0xFFFF
        words[carried - 1] += carry
    # A reader begins with four words of each stream; for each word that a stream put out
    # it wants the fourth one after it.
    later = words[np.concatenate(wanted) + 4].astype("<u2")
    return np.concatenate((words.reshape(lanes, room)[:, :4].astype("<u2").reshape(-1), later))


def _decode(coded: np.ndarray, streams: int, steps: int, vocabulary: int) -> np.ndarray:
    words = coded.astype(np.uint64)
    head = words[: 4 * streams].reshape(streams, 4)
    value = head[:, 0] << _U(48) | head[:, 1] << _U(32) | head[:, 2] << _U(16) | head[:, 3]
    width, upcoming = np.full(streams, _FULL, np.uint64), 4 * streams
    followers, chances, frequencies = _Followers(), _Chances(), _Frequencies(vocabulary)
    ids = np.zeros((steps, streams), np.uint32)
    hit, joint = np.zeros(ids.shape, bool), np.zeros(ids.shape, np.uint32)
    last = before = np.zeros(streams, np.int64)
    begin = 0
    for t in range(steps):
        if t and _mixes(t):
            chances.count(joint[begin:t], hit[begin:t])
            chances.mix()
            begin = t
        if t and _adds_up(t):
            frequencies.add_up()
        now, joint[t] = followers.predict(_places(last, before))
        share = (width >> _U(_BITS)) * chances.chances.take(joint[t])
        np.less(value, share, out=hit[t])
        lost = np.flatnonzero(~hit[t])
        rest = share[lost]
        left = value[lost] - rest
        unit = (width[lost] - rest) // frequencies.total
        goal = np.minimum(left // unit, frequencies.total - _U(1))
        # Sorted goals lie near each other in the bounds, which makes the search several times faster.
        order = np.argsort(goal)
        found = np.empty(len(goal), np.int64)
        found[order] = np.searchsorted(frequencies.bounds, goal[order], "right") - 1
        value[lost] = left - unit * frequencies.bounds[found]
        width = share
        width[lost] = unit * frequencies.widths[found]
        now[lost] = found
        small = np.flatnonzero(width < _LEAST)
        while len(small):
            if upcoming + len(small) > len(words):
                raise ValueError("a block ends too soon")
            w = width[small] << _SHIFT
            value[small] = value[small] << _SHIFT | words[upcoming : upcoming + len(small)]
            width[small] = w
            upcoming += len(small)
            small = small[w < _LEAST]
        ids[t] = now
        followers.learn(now)
        frequencies.missed.append(found)
        last, before = now.astype(np.int64), last
    return np.ascontiguousarray(ids.T)


def _shape(size: int) -> tuple[int, int]:
    """Streams and their steps for a block of ``size`` ids; a short block has fewer streams."""
    streams = min(STREAMS, -(-size // 64))
    return streams, -(-size // streams)


def encode(blocks: Sequence[np.ndarray], vocabulary: int) -> list[bytes]:
    """Each block of 1 to ``BLOCK`` ids below ``vocabulary`` as bytes."""
    out: list[bytes] = []
    for block in blocks:
        ids = np.zeros(_shape(len(block)), np.uint32)
        ids.reshape(-1)[: len(block)] = block
        out.append(_encode(ids, vocabulary).tobytes())
    return out


def decode(coded: Sequence[bytes], sizes: Sequence[int], vocabulary: int) -> list[np.ndarray]:
    """The blocks of ``encode``, given how many ids each has."""
    return [_decode(np.frombuffer(c, "<u2"), *_shape(n), vocabulary).reshape(-1)[:n] for c, n in zip(coded, sizes)]
