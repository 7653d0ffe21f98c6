"""Letters of texts as code points, several texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters that are turned into arrays at once.
PIECE = 1 << 20

_tables: dict[str, np.ndarray] = {}


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letter"]


def pieces(texts: list[str], ended: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(code points, text number of each)`` of the texts, in lower case and with a zero
    after each text. A text longer than ``PIECE`` comes in several pieces, which lie one
    after the other; unless ``ended``, only the last of them has the zero."""
    held, owners, size = [], [], 0

    def joined():
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, np.repeat(owners, [len(t) for t in held])

    for number, text in enumerate(texts):
        low = text.lower()
        begin = 0
        while True:
            part = low[begin : begin + PIECE]
            if held and size + len(part) > PIECE:
                yield joined()
                held, owners, size = [], [], 0
            last = begin + PIECE >= len(low)
            held.append(part + "\0" if ended or last else part)
            owners.append(number)
            size += len(part)
            if last:
                break
            begin += PIECE
    if held:
        yield joined()
