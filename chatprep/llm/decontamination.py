"""Benchmark decontamination by greedy string tiling.

Benchmark items are the stated queries and are taken in blocks of bounded size. What a
block finds is stored before the next one is drawn, so neither the driver nor a plan ever
holds more than one. For a block, every document is read once: windows of ``LEAST`` words that also stand in an
item are the seeds. Seeds bound how much of an item a document can cover; where that is
enough, the parts of the document around its seeds and the item are tiled. The share of
the item that lies under tiles decides, in whatever order the passages stand, or a single
tile that is long by itself, however long the item is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatprep.llm.hashing import slices, windows, word_hashes
from chatprep.llm.tiling import tiles
from chatprep.sources.stages import scratch_path

#: Words of the shortest tile.
LEAST = 5
#: Share of an item's words under tiles from which a document is contaminated.
COVERAGE = 0.5
#: Words of one tile from which a document is contaminated, whatever the coverage.
VERBATIM = 20
#: Bytes of item text in one block.
BLOCK_BYTES = 4 << 20


@dataclass
class Block:
    """Items, their words, and their seeds sorted by hash."""

    ids: list
    words: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(items: list[tuple]) -> Block:
        words, bounds = word_hashes([text.encode() for _, text in items], marks=True)
        made, item, first = windows(words, bounds, LEAST)
        order = np.argsort(made, kind="stable")
        return Block([i for i, _ in items], words, bounds, made[order], item[order], (first - bounds[item])[order])

    def found(self, values: list[bytes | None], least_coverage: float, verbatim: int) -> Iterator[tuple]:
        """``(text number, item, words of the item, covered words, tiles)`` of each pair
        whose tiles reach ``least_coverage`` or have one of ``verbatim`` words; a tile is
        (first word in the text, first word in the item, words)."""
        if not len(self.seeds):
            return
        words, bounds = word_hashes(values, marks=True)
        made, owner, first = windows(words, bounds, LEAST)
        low, high = np.searchsorted(self.seeds, made, "left"), np.searchsorted(self.seeds, made, "right")
        hit = np.flatnonzero(high > low)
        begin = 0
        while begin < len(hit):
            text = owner[hit[begin]]
            end = begin + int(np.searchsorted(owner[hit[begin:]], text, "right"))
            own, begin = hit[begin:end], end
            many = high[own] - low[own]
            seed = np.repeat(low[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            start = np.repeat(first[own], many)
            items = self.item[seed]
            for item in np.unique(items):
                here = items == item
                pattern = self.words[self.bounds[item] : self.bounds[item + 1]]
                could = _under(self.place[seed[here]], len(pattern))
                if could.sum() < min(least_coverage * len(pattern), verbatim):
                    continue
                parts, places = _around(words, start[here])
                matched = tiles(parts, pattern, LEAST)
                covered = sum(n for _, _, n in matched)
                if covered >= least_coverage * len(pattern) or max((n for _, _, n in matched), default=0) >= verbatim:
                    yield (int(text), self.ids[item], len(pattern), covered,
                           [(int(places[i] - bounds[text]), j, n) for i, j, n in matched])


def _under(starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words lie under the windows that begin at ``starts``."""
    steps = np.bincount(starts, minlength=size + LEAST) - np.bincount(starts + LEAST, minlength=size + LEAST)[: size + LEAST]
    return np.cumsum(steps)[:size] > 0


def _around(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words under the windows at ``starts``, runs parted by a word that matches
    nothing, and the place of each."""
    first = int(starts.min())
    places = np.flatnonzero(_under(starts - first, int(starts.max()) - first + LEAST)) + first
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    return np.insert(words[places], gaps, np.uint64(0)), np.insert(places, gaps, -1)


def blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text",
           block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of about ``block_bytes``, one block at a time."""
    held, size = [], 0
    rows = items.filter(F.col(text_column).isNotNull()).select(id_column, text_column)
    for item, text in rows.toLocalIterator():
        if held and size + len(text.encode()) > block_bytes:
            yield Block.of(held)
            held, size = [], 0
        held.append((item, text))
        size += len(text.encode())
    if held:
        yield Block.of(held)


def _stored(made: Iterator[Block], found: Callable[[Block], DataFrame], schema: T.StructType,
            spark: SparkSession, label: str) -> DataFrame:
    """What ``found`` gives for all blocks, as one table; each block goes before the next is drawn."""
    path, written = scratch_path(spark, label), False
    for block in made:
        found(block).write.mode("append").parquet(path)
        written = True
        del block
    return spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)


_TILE = "array<struct<doc_word:bigint,item_word:bigint,words:bigint>>"


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, verbatim: int = VERBATIM,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, item_words, covered_words, coverage, n_tiles, tiles)`` of every
    document and item of which at least ``coverage`` lies under tiles, or one tile has
    ``verbatim`` words or more.

    Words are runs of letters and digits, A-Z as a-z. Null and empty texts and items of
    fewer than ``LEAST`` words match nothing. Repeated documents and items each give
    rows of their own; an empty table gives no rows. Other columns are not looked at.
    """
    kinds = [docs.schema[id_column].dataType, items.schema[item_id].dataType]
    schema = T.StructType([
        T.StructField("doc_id", kinds[0]), T.StructField("item_id", kinds[1]),
        T.StructField("item_words", T.LongType()), T.StructField("covered_words", T.LongType()),
        T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType()),
        T.StructField("tiles", T._parse_datatype_string(_TILE)),
    ])
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))

    def of_block(block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, values in slices(batches, "text"):
                found = list(block.found(values, coverage, verbatim))
                arrow = part.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())).cast(arrow),
                        pa.array([f[1] for f in found]) if found else pa.array([], pa.null()),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array([f[3] for f in found], pa.int64()),
                        pa.array([f[3] / f[2] for f in found], pa.float64()),
                        pa.array([len(f[4]) for f in found], pa.int64()),
                        pa.array(
                            [[{"doc_word": i, "item_word": j, "words": n} for i, j, n in f[4]] for f in found],
                            pa.list_(pa.struct([(k, pa.int64()) for k in ("doc_word", "item_word", "words")])),
                        ),
                    ],
                    names=schema.names,
                ) if found else None

        def made(batches):
            return (b for b in run(batches) if b is not None)

        return narrow.mapInArrow(made, schema)

    return _stored(blocks(items, item_id, item_text, block_bytes), of_block, schema, docs.sparkSession, "decontamination-found")


def _row_keys(docs: DataFrame, text_column: str) -> list[Column]:
    """Two hashes of a row; rows of different text differ, null or not. Ids and the like count
    as well, so that copies of a text do not meet in one place."""
    text = F.col(f"`{text_column}`")
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields
              if f.name != text_column and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return [F.xxhash64(F.lit(seed), text.isNull(), text, *others).alias(f"k{seed}") for seed in (1, 2)]


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id",
          item_text: str = "text", coverage: float = COVERAGE, verbatim: int = VERBATIM,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item as above. Rows are judged
    by their own text, so repeated rows stay or go together; null texts stay."""
    narrow = docs.select(*_row_keys(docs, text_column), F.col(f"`{text_column}`").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])

    def of_block(block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, values in slices(batches, "text"):
                goes = np.zeros(len(values), bool)
                goes[[f[0] for f in block.found(values, coverage, verbatim)]] = True
                yield part.select(["k1", "k2"]).filter(pa.array(goes))

        return narrow.mapInArrow(run, schema)

    gone = _stored(blocks(items, item_id, item_text, block_bytes), of_block, schema, docs.sparkSession, "decontamination-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_keys(docs, text_column))
    stay = rows.join(gone, ["k1", "k2"], "left_anti")
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
