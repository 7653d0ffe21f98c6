"""Greedy string tiling of two token sequences, with running Karp-Rabin matching."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from chatprep.llm.hashing import windows

#: Match length with which the search begins.
FIRST_LENGTH = 20


def _open_windows(tokens: np.ndarray, taken: np.ndarray, length: int) -> dict[int, list[int]]:
    """Karp-Rabin values of all windows without a taken token, and where they begin."""
    found = defaultdict(list)
    made, _, first = windows(tokens, np.array([0, len(tokens)]), length)
    if len(made):
        held = np.concatenate(([0], np.cumsum(taken)))
        free = held[first + length] == held[first]
        for value, at in zip(made[free].tolist(), first[free].tolist()):
            found[value].append(at)
    return found


def tiles(text: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches ``(start in text, start in pattern, length)`` of at least
    ``least`` tokens; the longest match that is still free is marked first, in whatever
    order the passages stand. Equal lengths are taken by their place in the pattern,
    then in the text."""
    in_text, in_pattern = np.zeros(len(text), bool), np.zeros(len(pattern), bool)
    a, b = text.tolist(), pattern.tolist()
    made: list[tuple[int, int, int]] = []
    search = max(least, min(FIRST_LENGTH, len(pattern)))
    while True:
        where = _open_windows(pattern, in_pattern, search)
        matches, longest = [], 0
        for value, starts in _open_windows(text, in_text, search).items() if where else ():
            for j in where.get(value, ()):
                for i in starts:
                    n = 0
                    while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]
                           and not in_text[i + n] and not in_pattern[j + n]):
                        n += 1
                    if n >= search:
                        matches.append((n, j, i))
                        longest = max(longest, n)
        if not matches:
            if search == least:
                return made
            search = max(least, search // 2)
            continue
        # All of the longest length, then a new search: what they cut off others may
        # still be long enough.
        for n, j, i in sorted(matches):
            if n == longest and not in_text[i : i + n].any() and not in_pattern[j : j + n].any():
                in_text[i : i + n] = in_pattern[j : j + n] = True
                made.append((i, j, n))
