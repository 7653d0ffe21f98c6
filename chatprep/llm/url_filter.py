"""URL filters on a sorted digest array.

A rule is a host and a path start, such as ``example.net/en/``. The rules' 64-bit xxhash
keys lie sorted in one file that every executor fetches once and maps into memory. A
URL's possible rules, every suffix of its host with every start of its path of a length
that some rule has, are probed together by vectorised binary search, and a hit counts
only if the stored rule is the same string.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm.hashing import slices

#: Rules one filter may hold; 64 bytes each make a file of some 2 GB that is mapped,
#: not read.
MOST_RULES = 1 << 25

_URL = re.compile(rb"://([^/?#]*)([^?#]*)", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool = False

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: bytes | None) -> tuple[bytes, bytes]:
    """Host, A-Z in lower case, and path; both empty without ``://``."""
    found = _URL.search(url or b"")
    return (found[1].lower(), found[2]) if found else (b"", b"")


class DigestArray:
    """The mapped file: number of rules, number of path lengths, path lengths; sorted
    keys; ends of the rules' strings; whether each allows; the strings."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n, m = whole[:16].view(np.int64)
        at = 16 + 8 * m
        self.path_lengths = whole[16:at].view(np.int64).tolist()
        self.keys = whole[at : at + 8 * n].view(np.uint64)
        self.ends = whole[at + 8 * n : at + 16 * n].view(np.int64)
        self.host_sizes = whole[at + 16 * n : at + 20 * n].view(np.int32)
        self.allow = whole[at + 20 * n : at + 21 * n]
        self.strings = whole[at + 21 * n :]

    @staticmethod
    def packed(rules: Iterable[Rule]) -> bytes:
        """Of rules for the same host and path the last one holds."""
        last = {(r.host.lower().encode(), r.path.encode()): r.allow for r in rules}
        if len(last) > MOST_RULES:
            raise ValueError(f"{len(last)} rules; a filter holds {MOST_RULES}")
        rows = sorted((_key(h, p), h, p, allow) for (h, p), allow in last.items())
        lengths = np.array(sorted({len(p) for _, _, p, _ in rows}), np.int64)
        strings = [h + p for _, h, p, _ in rows]
        return b"".join((
            np.array([len(rows), len(lengths)], np.int64).tobytes(), lengths.tobytes(),
            np.array([k for k, *_ in rows], np.uint64).tobytes(),
            np.cumsum([len(s) for s in strings], dtype=np.int64).tobytes(),
            np.array([len(h) for _, h, _, _ in rows], np.int32).tobytes(),
            np.array([a for *_, a in rows], np.uint8).tobytes(), b"".join(strings),
        ))

    def rule(self, i: int) -> tuple[bytes, bytes]:
        text = self.strings[(self.ends[i - 1] if i else 0) : self.ends[i]].tobytes()
        return text[: self.host_sizes[i]], text[self.host_sizes[i] :]

    def probe(self, urls: list[tuple[bytes, bytes]]) -> list[int]:
        """For each host and path the longest rule that fits, or -1; of rules of one
        length the one with the longer host."""
        owner, tried, keys = [], [], []
        for number, (host, path) in enumerate(urls):
            starts = [0, *(i + 1 for i, c in enumerate(host) if c == 46)] if host else []
            for s in starts:
                for n in self.path_lengths:
                    if n <= len(path):
                        owner.append(number)
                        tried.append((host[s:], path[:n]))
                        keys.append(_key(host[s:], path[:n]))
        best, size = [-1] * len(urls), [(-1, -1)] * len(urls)
        if not keys or not len(self.keys):
            return best
        keys = np.array(keys, np.uint64)
        low = np.searchsorted(self.keys, keys, "left")
        for k in np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == keys):
            at = int(low[k])
            while at < len(self.keys) and self.keys[at] == keys[k]:
                if self.rule(at) == tried[k]:
                    rank = (len(tried[k][0]) + len(tried[k][1]), len(tried[k][0]))
                    if rank > size[owner[k]]:
                        best[owner[k]], size[owner[k]] = at, rank
                at += 1  # another string with the same key
        return best


def _key(host: bytes, path: bytes) -> int:
    return xxhash.xxh64_intdigest(host + b"\0" + path)


def publish(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Gives the digest array of ``rules`` to all executors; its name there."""
    data = DigestArray.packed(rules)
    name = f"urls-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    folder = tempfile.mkdtemp()  # only Spark's own file server reads it
    with open(os.path.join(folder, name), "wb") as out:
        out.write(data)
    try:
        spark.sparkContext.addFile(os.path.join(folder, name))
    except Exception as e:  # the same content is there already, from another folder
        if "already registered" not in str(e):
            raise
    return name


def judged(urls: DataFrame, rules: Iterable[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``urls``.

    ``rule`` is the longest rule that fits, null if none does; ``verdict`` is its verdict,
    or ``allow``. A null URL or one without ``://`` has an empty host and path and is
    allowed. Repeated rows and null ids are judged like others; other columns are not
    looked at. Without rules everything is allowed.
    """
    name = publish(urls.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for part, values in slices(batches, "url"):
            split = [parts(v) for v in values]
            found = array.probe(split)
            texts = [b"".join(array.rule(i)).decode() if i >= 0 else None for i in found]
            verdicts = ["allow" if i < 0 or array.allow[i] else "block" for i in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"),
                    *(pa.array([x[k].decode() for x in split], pa.string()) for k in (0, 1)),
                    pa.array(texts, pa.string()), pa.array(verdicts, pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = urls.schema[id_column].dataType.simpleString()
    narrow = urls.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("binary").alias("url"))
    return narrow.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
