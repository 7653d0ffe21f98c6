"""Token ids of a corpus in binary files, written and read by Spark.

A file is a run of frames, each a header, a payload and a line feed: ``index`` frames list
documents and how many ids each has, ``ids`` frames hold one block of the ids that follow
each other, coded by ``id_coder`` and checksummed. Blocks begin anew, so a file whose
frames are found can be read from any block. Files in the order of their names hold the
documents in ascending order of their ids.

Frames are rows of Spark's text writer, so its commit protocol applies: a lost executor
leaves no half a file. Reading is Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.llm import id_coder
from chatprep.llm.hashing import slices
from chatprep.sources.stages import scratch

#: Bytes of text that make one file.
FILE_BYTES = 64 << 20
#: Different words whose ids a task remembers. Beyond them it keeps those that came back.
REMEMBERED = 500_000
#: Magic, kind, number of documents or ids, crc32 of what the payload stands for, its bytes.
_HEADER = "<4scQIQ"
_MAGIC = b"TIDS"
_CLOSING = ",.;:!?"
_MARKS = _CLOSING + "#*$%&|"
#: Bytes of text whose words are looked up at once.
_SLICE = 2 << 20
#: Words of letters that are encoded in one call.
_JOINED = 50


class Damaged(ValueError):
    """A frame that is cut off or does not match its checksum."""


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class WordIds:
    """Ids of texts word by word: each different word, between blanks, is encoded once and its
    ids are remembered. Right for tokenizers that drop white space, never join characters
    across it, and take a run of letters, or one closing mark after it, as a piece."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.plain = self._takes_plain_letters()
        pieces = self.plain and [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str("ab" + _MARKS)]
        # What closes a word: a run of marks, if that is one piece, or else one mark.
        self.closing = f"[{_MARKS}]+" if pieces == ["ab", _MARKS] else f"[{_CLOSING}]"
        self.clear()

    def _takes_plain_letters(self) -> bool:
        """Whether A-Z are only lower-cased and a run of a-z reaches the model as it is."""
        before, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        lower = string.ascii_lowercase
        if not before or not split or any(before.normalize_str(x) != lower for x in (lower, lower.upper())):
            return False
        return [piece for piece, _ in split.pre_tokenize_str(lower)] == [lower]

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.seen = np.zeros(0, np.int64)
        self.sizes, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Leaves the words that came at least twice, or nothing if those are most of them;
        what stays has to come again to stay once more."""
        stay = np.flatnonzero(self.seen > 1)
        if len(stay) > REMEMBERED // 2:
            self.clear()
            return
        words = list(self.numbers)
        self.numbers = _Numbers((words[i], n) for n, i in enumerate(stay.tolist()))
        sizes = self.sizes[stay]
        self.flat = _gather(self.flat, self.starts[stay], sizes)
        self.starts, self.sizes, self.seen = np.cumsum(sizes) - sizes, sizes, np.zeros(len(stay), np.int64)

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts one after the other, and how many each has."""
        plain, letters, alone = [], [], []
        for i, p in enumerate(parts):
            (alone if not p.isalpha() else plain if self.plain and p.isascii() else letters).append(i)
        groups = [letters[i : i + _JOINED] for i in range(0, len(letters), _JOINED)]
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        order: list[int] = []
        sizes: list[np.ndarray] = [np.zeros(0, np.int64)]
        for group, made in zip(groups, self.tokenizer.encode_batch([" ".join([parts[i] for i in g]) for g in groups], add_special_tokens=False)):
            counts = np.bincount(np.array(made.word_ids, np.int64), minlength=len(group))
            if len(counts) != len(group) or not counts.all():
                alone += group
                continue
            order += group
            sizes.append(counts)
            ids.append(np.array(made.ids, np.uint32))
        tokenize = self.tokenizer.model.tokenize
        lists = [[t.id for t in tokenize(parts[i].lower())] for i in plain]
        lists += [made.ids for made in self.tokenizer.encode_batch_fast([parts[i] for i in alone], add_special_tokens=False)]
        order += plain + alone
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids.append(np.fromiter(itertools.chain.from_iterable(lists), np.uint32))
        counts = np.concatenate(sizes)
        starts = np.cumsum(counts) - counts
        back = np.argsort(np.array(order, np.int64))
        return _gather(np.concatenate(ids), starts[back], counts[back]), counts[back]

    def _remember(self, fresh: list[bytes]) -> None:
        # Marks after a letter are a piece of their own, so the word before them will do.
        words = pa.array(b" ".join(fresh).decode(errors="replace").split(" "), pa.large_string())
        cut = pc.extract_regex(words, f"^(?P<stem>.*[A-Za-z])(?P<marks>{self.closing})$")
        closed = cut.is_valid().to_numpy(zero_copy_only=False)
        stems = pc.coalesce(pc.struct_field(cut, "stem"), words).dictionary_encode()
        marks = pc.struct_field(cut, "marks").filter(pa.array(closed)).dictionary_encode()
        parts = [p for d in (stems, marks) for p in d.dictionary.to_numpy(zero_copy_only=False).tolist()]
        pieces = np.where(closed, 2, 1)
        first = np.cumsum(pieces) - pieces
        at = np.zeros(int(pieces.sum()), np.int64)
        at[first] = stems.indices.to_numpy()
        at[first[closed] + 1] = len(stems.dictionary) + marks.indices.to_numpy()
        ids, counts = self._encoded(parts)
        starts = (np.cumsum(counts) - counts)[at]
        sizes = np.add.reduceat(counts[at], first)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, _gather(ids, starts, counts[at])))

    def encode(self, values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        known = len(self.numbers)
        # Arrow finds the different words of the slice, so that each is looked up once.
        lists = pc.ascii_split_whitespace(pa.array(values, pa.large_binary()).fill_null(b"").view(pa.large_string()))
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[lists.offsets.to_numpy()]
        found = flat.filter(full).view(pa.large_binary()).dictionary_encode()
        numbers = np.fromiter(map(self.numbers.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)), np.int64)
        words = numbers[found.indices.to_numpy()]
        if len(self.numbers) > known:
            self._remember(list(itertools.islice(self.numbers, known, None)))
        counts = np.bincount(words, minlength=len(self.numbers))
        counts[: len(self.seen)] += self.seen
        self.seen = counts
        sizes = self.sizes[words]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[ends]
        return _gather(self.flat, self.starts[words], sizes), np.diff(bounds)


class TextIds:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [(v or b"").decode(errors="replace") for v in values]
        made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *made]), np.array([len(m) for m in made])


def frame(kind: bytes, count: int, crc: int, payload: bytes) -> bytes:
    return struct.pack(_HEADER, _MAGIC, kind, count, crc, len(payload)) + payload


def frames(content: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
    """``(kind, count, crc, payload)`` of a file."""
    begin = 0
    while begin < len(content):
        if begin + struct.calcsize(_HEADER) > len(content):
            raise Damaged("a frame is cut off")
        magic, kind, count, crc, size = struct.unpack_from(_HEADER, content, begin)
        begin += struct.calcsize(_HEADER)
        if magic != _MAGIC or begin + size > len(content):
            raise Damaged("not a frame, or one that is cut off")
        yield kind, count, crc, content[begin : begin + size]
        begin += size + 1  # and the line feed


def _index_frame(ids: list, counts: list[int]) -> bytes:
    raw = json.dumps([ids, counts]).encode()
    return frame(b"x", len(ids), zlib.crc32(raw), zlib.compress(raw))


def _ids_frames(blocks: list[np.ndarray], vocabulary: int) -> Iterator[bytes]:
    for ids, coded in zip(blocks, id_coder.encode(blocks, vocabulary)):
        yield frame(b"i", len(ids), zlib.crc32(ids.astype("<u4").tobytes()), coded)


def read_frames(content: bytes, vocabulary: int) -> Iterator[tuple[list, list[int]] | np.ndarray]:
    """Index entries and checked blocks of ids, in the order of the file."""
    waiting: list[tuple[int, int, bytes]] = []

    def blocks():
        for (count, crc, _), ids in zip(waiting, id_coder.decode([p for _, _, p in waiting], [c for c, _, _ in waiting], vocabulary)):
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise Damaged("a block does not match its checksum")
            yield ids
        waiting.clear()

    for kind, count, crc, payload in frames(content):
        if kind == b"i":
            waiting.append((count, crc, payload))
            if len(waiting) == id_coder.TOGETHER:
                yield from blocks()
            continue
        yield from blocks()
        raw = zlib.decompress(payload)
        if zlib.crc32(raw) != crc:
            raise Damaged("an index does not match its checksum")
        yield tuple(json.loads(raw))
    yield from blocks()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
          by_word: bool = True) -> None:
    """Files of the ids of ``docs`` below ``path``, in ascending order of document ids.

    The tokenizer file has to lie at ``tokenizer_path`` on every executor; special tokens are
    not added, ``end_id`` closes each document. ``by_word`` is for tokenizers that drop white
    space. A null or empty text has the end id alone; rows with one id follow each other in the
    order they were read, null ids come first; malformed UTF-8 is read as replacement
    characters. A task holds a bounded number of ids, however long the texts. One file has
    about ``FILE_BYTES`` of text, or one document if that is longer. Other columns are not looked at.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    vocabulary = max([*own.get_vocab(with_added_tokens=True).values(), end_id]) + 1
    ahead = id_coder.BLOCK * id_coder.TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The task has one core; threads of the tokenizer would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = (WordIds if by_word else TextIds)(Tokenizer.from_file(tokenizer_path))
        names: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def out(rest: bool):
            nonlocal held, size
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            upto = len(ids) if rest else len(ids) // id_coder.BLOCK * id_coder.BLOCK
            written = [_index_frame(names, sizes)] if names else []
            written += _ids_frames([ids[i : min(i + id_coder.BLOCK, upto)] for i in range(0, upto, id_coder.BLOCK)], vocabulary)
            names.clear()
            sizes.clear()
            held, size = [ids[upto:]], len(ids) - upto
            return pa.RecordBatch.from_arrays([pa.array(written, pa.binary())], names=["frame"])

        for part, values in slices(batches, "text", _SLICE):
            ids, counts = made.encode(values)
            ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
            names += part.column("id").to_pylist()
            sizes += (counts + 1).tolist()
            held.append(ids)
            size += len(ids)
            if size >= ahead:
                yield out(False)
        yield out(True)

    narrow = docs.select(
        F.col(f"`{id_column}`").alias("key"), F.col(f"`{id_column}`").cast("string").alias("id"),
        F.col(f"`{text_column}`").cast("binary").alias("text"), F.monotonically_increasing_id().alias("tie"),
    )
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("key").asc_nulls_first(), F.col("tie").asc()]
    placed = narrow.repartitionByRange(max(1, -(-total // FILE_BYTES)), *order).sortWithinPartitions(*order)
    written = placed.select("id", "text").mapInArrow(run, "frame binary")
    written.select(F.col("frame").cast("string").alias("value")).write.text(path)


def read(spark: SparkSession, path: str, vocabulary: int, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the documents in the files below ``path``;
    ``start`` counts the ids of all documents before. Every block is decoded and checked; a
    damaged one ends the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                part = int(re.search(r"part-(\d+)-", name)[1])
                names: list = []
                sizes: list[int] = []
                crcs: list[int] = []
                crc = got = 0
                for found in read_frames(content.as_buffer().to_pybytes(), vocabulary):
                    if isinstance(found, tuple):
                        names += found[0]
                        sizes += found[1]
                        continue
                    raw = memoryview(found.astype("<u4").tobytes())
                    at = 0
                    while at < len(found):
                        step = min(sizes[len(crcs)] - got, len(found) - at)
                        crc = zlib.crc32(raw[4 * at : 4 * (at + step)], crc)
                        at, got = at + step, got + step
                        if got == sizes[len(crcs)]:
                            crcs.append(crc)
                            crc = got = 0
                if len(crcs) != len(sizes):
                    raise Damaged("ids are missing")
                ends = np.cumsum(np.array(sizes, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([part] * len(names), pa.int64()), pa.array(ends - np.array(sizes, np.int64)),
                     pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["id", "part", "within", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = scratch(files.mapInArrow(run, "id string, part bigint, within bigint, n_tokens bigint, ids_crc32 bigint"), "tokens-read")
    # What lies before a file: files before it among 4096 neighbours, and the neighbourhoods before.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("held")).withColumn("near", F.expr("part div 4096"))
    earlier = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    areas = parts.groupBy("near").agg(F.sum("held").alias("held")).select("near", earlier(W.partitionBy(F.lit(0)).orderBy("near")).alias("far"))
    offsets = parts.withColumn("before", earlier(W.partitionBy("near").orderBy("part"))).join(areas, "near").select("part", F.col("before") + F.col("far"))
    offsets = offsets.toDF("part", "offset")
    return rows.join(offsets, "part").select(
        F.col("id").cast(id_type).alias("doc_id"), (F.col("within") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
