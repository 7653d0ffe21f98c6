"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has a mask of one bit per language in every slot. An n-gram is
put into a few slots under the bits of the languages it is typical of; the masks of its
slots, taken together with AND, give all languages that contain it at once. Bits are
counted per language over a whole text, corrected for the filter's false positives, and
the language with the largest share of contained n-grams is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.hashing import mix, slices
from chatprep.llm.letters import is_letter, pieces
from chatprep.sources.stages import scratch

GRAMS = (3, 4)
#: Documents of a language that are learned from, in the mean of the draw.
SAMPLE_DOCS = 3000
#: An n-gram is typical of a language in which it is at least this share as frequent as
#: in the language where it is most frequent, and occurs so often.
TYPICAL = 0.3
LEAST_COUNT = 3
#: Slots of the filter, a power of two, and slots an n-gram is put into.
SLOTS = 1 << 20
HASHES = 3
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from; ids that are null are in no fold and held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hashes, text number)`` of the n-grams; what is not a letter is one blank. Pieces
    of a long text go on with the last letters of the piece before, so that each n-gram
    comes once wherever the text is cut."""
    before = max(GRAMS) - 1
    tail, tail_own, after_letter = np.zeros(0, np.uint64), np.zeros(0, np.int64), False
    for codes, owner in pieces(texts, ended=False):
        letter = is_letter()[codes]
        kept = np.flatnonzero(letter | np.concatenate(([after_letter], letter[:-1])))
        c = np.concatenate((tail, np.where(letter[kept], codes[kept], 32).astype(np.uint64)))
        own = np.concatenate((tail_own, owner[kept]))
        for n in GRAMS:
            # N-grams that end in the tail came with the piece before.
            skip = max(len(tail) - n + 1, 0)
            size = len(c) - skip - n + 1
            if size <= 0:
                continue
            total = np.zeros(size, np.uint64)
            for j in range(n):
                at = c[skip + j : skip + j + size]
                total = (total << np.uint64(21)) * np.uint64(0x9E3779B1) + at * np.uint64(2 * j + 1) + total
            whole = own[skip : skip + size] == own[skip + n - 1 :]
            yield mix(total, n)[whole], own[skip : skip + size][whole]
        tail, tail_own, after_letter = c[-before:], own[-before:], bool(letter[-1])


def slots_of(hashes: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram."""
    second = mix(hashes, 99) | np.uint64(1)
    return [((hashes + np.uint64(j) * second) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]


@dataclass
class Filters:
    """``masks`` has a row of 64-bit words for each slot; bit ``i`` belongs to ``names[i]``."""

    names: list[str]
    masks: np.ndarray

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each text and language the share of n-grams that the language contains,
        less what false positives add."""
        hits = np.zeros((len(texts), len(self.names)))
        total = np.zeros(len(texts))
        for hashes, owner in _grams(texts):
            at = slots_of(hashes)
            total += np.bincount(owner, minlength=len(texts))
            for word in range(self.masks.shape[1]):
                both = self.masks[at[0], word]
                for a in at[1:]:
                    both = both & self.masks[a, word]
                for i in range(64 * word, min(64 * word + 64, len(self.names))):
                    bit = (both >> np.uint64(i % 64)) & np.uint64(1)
                    hits[:, i] += np.bincount(owner, bit, len(texts))
        false = self._false_positives()
        return (hits / np.maximum(total, 1)[:, None] - false) / (1 - false)

    def _false_positives(self) -> np.ndarray:
        filled = [((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.names))]
        return np.minimum(np.array(filled) ** HASHES, 0.999)


def train(docs: DataFrame, text_column: str = "text", label: str = "lang", id_column: str = "doc_id",
          sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters learned from rows that have a text and a language. Of a language with more
    than ``sample_docs`` documents about so many are drawn by a hash of their id and text;
    the n-gram counts come together in Spark, only slots and masks reach the driver."""
    known = docs.filter(F.col(label).isNotNull() & F.col(text_column).isNotNull())
    sizes = {r["name"]: r["n"] for r in known.groupBy(F.col(label).alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filters([], np.zeros((SLOTS, 1), np.uint64))
    share = F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, sample_docs / sizes[k])])
    chance = F.pmod(F.xxhash64(id_column, text_column), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = known.filter(chance < F.element_at(share, F.col(label))).select(
        F.col(label).alias("name"), F.col(text_column).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in slices(batches, "text"):
            names = np.array(part.column("name").to_pylist(), object)
            for name in sorted(set(names)):
                own = [v.decode(errors="replace") for v, n in zip(values, names) if n == name]
                for hashes, _ in _grams(own):
                    gram, count = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count)],
                        names=["name", "gram", "count"],
                    )

    counted = scratch(
        drawn.mapInArrow(run, "name string, gram bigint, count bigint").groupBy("name", "gram").agg(F.sum("count").alias("count")),
        "language-grams",
    )
    totals = {r["name"]: r["n"] for r in counted.groupBy("name").agg(F.sum("count").alias("n")).collect()}
    names = sorted(totals)
    masks = np.zeros((SLOTS, max(1, -(-len(names) // 64))), np.uint64)
    if not names:
        return Filters(names, masks)
    of_total = F.create_map(*[F.lit(x) for k in names for x in (k, float(totals[k]))])
    of_bit = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)])
    rated = counted.withColumn("rate", F.col("count") / F.element_at(of_total, F.col("name")))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    typical = rated.join(most, "gram").filter((F.col("count") >= LEAST_COUNT) & (F.col("rate") >= TYPICAL * F.col("most")))
    bits = typical.select("gram", F.element_at(of_bit, F.col("name")).alias("bit"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            bit = part.column("bit").to_numpy()
            for slot in slots_of(part.column("gram").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit // 64), pa.array(1 << (bit % 64).astype(np.int64))], names=["slot", "word", "mask"])

    # At most SLOTS rows for every 64 languages.
    put = bits.mapInArrow(place, "slot bigint, word int, mask bigint").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    made = put.toPandas()
    masks[made["slot"].to_numpy(), made["word"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    return Filters(names, masks)


def predicted(docs: DataFrame, filters: Filters, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, shares)``, one row per row of ``docs``; ``shares`` has the
    corrected share of every language in the order of their names.

    Whole texts are read. A text that is null or has no letter, or filters that have
    learned nothing, give ``und`` with score 0; languages that tie go by name. Repeated
    rows and null ids are answered like others. Bytes that are no UTF-8 count as no letters.
    """
    # SLOTS masks, whatever the corpus.
    shared, languages = docs.sparkSession.sparkContext.broadcast(filters.masks), filters.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(languages, shared.value)
        for part, values in slices(batches, "text"):
            texts = [(v or b"").decode(errors="replace") for v in values]
            if own.names:
                shares = own.shares(texts)
                best = shares.argmax(axis=1)
                score = np.clip(shares[np.arange(len(texts)), best], 0.0, 1.0)
            lettered = [any(map(str.isalpha, t)) for t in texts]
            ok = np.array(lettered, bool) & bool(own.names)
            names = [own.names[best[i]] if ok[i] else UNKNOWN for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(names, pa.string()),
                    pa.array(np.where(ok, score, 0.0) if own.names else np.zeros(len(texts))),
                    pa.array([shares[i].tolist() if own.names else [] for i in range(len(texts))], pa.list_(pa.float64())),
                ],
                names=["doc_id", "lang_pred", "score", "shares"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, shares array<double>")
