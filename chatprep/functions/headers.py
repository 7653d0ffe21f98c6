"""Height and width of an image from its header, without decoding pixels."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle

# Executors need not have this package installed to read headers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ``read(start, count)`` gives bytes of a file, fewer at its end.
Reader = Callable[[int, int], bytes]

# Fixed values of the file formats.
PNG_MARK = b"\x89PNG\r\n\x1a\n"
GIF_MARKS = (b"GIF87a", b"GIF89a")
JPEG_MARK = b"\xff\xd8"
# Markers from C0 to CF start a frame, but for tables (C4, CC) and a reserved one (C8).
NO_FRAME = (0xC4, 0xC8, 0xCC)
# Markers without a length: TEM and restarts.
BARE = (0x01, *range(0xD0, 0xD8))


def _big(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _little(data: bytes) -> int:
    return int.from_bytes(data, "little")


def _png(read: Reader) -> tuple[int, int] | None:
    head = read(12, 12)
    return (_big(head[8:12]), _big(head[4:8])) if len(head) == 12 and head[:4] == b"IHDR" else None


def _gif(read: Reader) -> tuple[int, int] | None:
    """Size of the first frame, which need not fill the screen that the file names."""
    flags = read(10, 1)
    if not flags:
        return None
    at = 13 + (3 << ((flags[0] & 7) + 1) if flags[0] & 0x80 else 0)
    while kind := read(at, 1):
        if kind == b",":
            frame = read(at + 5, 4)
            return (_little(frame[2:]), _little(frame[:2])) if len(frame) == 4 else None
        if kind != b"!":
            return None
        at += 2
        while (size := read(at, 1)) and size[0]:
            at += 1 + size[0]
        at += 1
    return None


def _jpeg(read: Reader) -> tuple[int, int] | None:
    at = 2
    while len(mark := read(at, 4)) == 4 and mark[0] == 0xFF:
        kind = mark[1]
        if kind == 0xFF:  # filling
            at += 1
        elif kind in BARE:
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in NO_FRAME:
            frame = read(at + 5, 4)
            return (_big(frame[:2]), _big(frame[2:])) if len(frame) == 4 else None
        elif kind in (0xD9, 0xDA):  # end, or pixels without a frame
            return None
        else:
            at += 2 + max(_big(mark[2:]), 2)
    return None


def image_size(read: Reader) -> tuple[int, int] | None:
    """``(height, width)`` of a PNG, GIF or JPEG file; None for others and for broken headers."""
    mark = read(0, 8)
    if mark == PNG_MARK:
        found = _png(read)
    elif mark[:6] in GIF_MARKS:
        found = _gif(read)
    elif mark[:2] == JPEG_MARK:
        found = _jpeg(read)
    else:
        found = None
    return found if found and found[0] > 0 and found[1] > 0 else None


def blocks(fetch: Reader, size: int = 4096) -> Reader:
    """A reader that fetches whole blocks and keeps the last one."""
    held: list = [-1, b""]

    def read(start: int, count: int) -> bytes:
        made = b""
        while len(made) < count:
            number, offset = divmod(start + len(made), size)
            if held[0] != number:
                held[:] = [number, fetch(number * size, size)]
            part = held[1][offset : offset + count - len(made)]
            if not part:
                break
            made += part
        return made

    return read
