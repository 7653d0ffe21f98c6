"""Rows whose key is wanted, told apart before any row moves.

A Bloom filter of the wanted keys is built by partial aggregation and tested where the
rows lie: what it turns away reaches no shuffle, however many rows one unwanted key
has. It lets a small share of other keys through, so an exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.sources.stages import scratch

#: Bits for each wanted key, hashes of a key, and bits of the largest filter (8 MB). With 10
#: bits and 4 hashes 1.2 % of other keys pass; of more keys than 6.7 million, more do.
BITS_PER_KEY, HASHES, MOST_BITS = 10, 4, 1 << 26


def _size(n_keys: int) -> int:
    """Bits for ``n_keys``: the next power of two, within bounds."""
    return min(MOST_BITS, max(1 << 10, 1 << (n_keys * BITS_PER_KEY - 1).bit_length() if n_keys else 0))


def _positions(key: str, bits: int):
    """Places of a key: two of its hashes, and steps of the one from the other."""
    one, two = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits)) for seed in (1, 2))
    return [F.pmod(one + i * two, F.lit(bits)) for i in range(HASHES)]


def bloom_words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``(words)``, one row: the filter of ``keys`` as an array of 64-bit words. Each task
    combines its keys' bits first, so at most a filter a task is shuffled."""
    place = keys.select(F.explode(F.array(*_positions(key, bits))).alias("at"))
    word = F.shiftright("at", 6).alias("word")
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit")
    held = place.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    empty = keys.sparkSession.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    whole = held.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))


def likely(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without most rows whose ``key`` is not among ``keys``; every row whose key is stays.
    A null key is never among them. ``keys`` is read twice, once to be counted, and should be
    stored and narrow. No rows move; the filter is stored and read as a scalar subquery."""
    bits = _size(keys.count())
    words = scratch(bloom_words(keys, key, bits), "bloom").scalar()
    marked = df.withColumns({f"__at{i}": at for i, at in enumerate(_positions(key, bits))})
    passed = F.col(key).isNotNull()
    for i in range(HASHES):
        # The filter's words stand in the condition itself: as a column each row would carry them.
        word = F.get(words, F.expr(f"CAST(shiftright(__at{i}, 6) AS INT)"))
        passed = passed & (word.bitwiseAND(F.expr(f"shiftleft(1L, CAST(__at{i} & 63 AS INT))")) != 0)
    return marked.filter(passed).select(*df.columns)


def semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df``'s rows whose ``key`` is among the distinct ``keys``, exactly."""
    return likely(df, keys, key).join(keys.select(key), key, "left_semi")
