"""Row order and batches without packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.operators.ordering import TABLE_DIGITS, ranked, shuffled


def shuffle_rows(df: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Adds the zero-based ``position`` of each row in the epoch's random order."""
    return ranked(df, [], shuffled(seed, epoch, digits=TABLE_DIGITS), "position").withColumn(
        "position", F.col("position") - 1
    )


def fixed(df: DataFrame, size: int, drop_last: bool, seed: int, epoch: int, accumulate: int = 1) -> DataFrame:
    """Adds ``position``, ``batch_id`` and ``step_id``: batches of ``size`` rows in
    shuffled order, ``accumulate`` batches to a step. ``drop_last`` leaves out a
    last batch that is short."""
    rows = ranked(df, [], shuffled(seed, epoch, digits=TABLE_DIGITS), "position", total="__all")
    rows = rows.withColumn("position", F.col("position") - 1).withColumn(
        "batch_id", F.floor(F.col("position") / size)
    )
    if drop_last:
        rows = rows.filter(F.col("batch_id") < F.floor(F.col("__all") / size))
    return rows.withColumn("step_id", F.floor(F.col("batch_id") / accumulate)).drop("__all")


def by_length(df: DataFrame, size: int, mega: int, seed: int, epoch: int) -> DataFrame:
    """Adds ``batch_id`` and the row's ``slot`` in it: shuffled rows are cut into
    groups of ``mega`` batches, and each group is sorted by length, so a batch
    holds rows of similar length. A group has ``size * mega`` rows at most."""
    wide = size * mega
    rows = shuffle_rows(df, seed, epoch).withColumn("__mega", F.floor(F.col("position") / wide))
    w = W.partitionBy("__mega").orderBy(F.col("length").desc(), F.col("row_id"))
    at = F.row_number().over(w) - 1
    return (
        rows.withColumn("__at", at)
        .withColumn("batch_id", F.col("__mega") * mega + F.floor(F.col("__at") / size))
        .withColumn("slot", (F.col("__at") % size).cast("int"))
        .drop("__mega", "__at", "position")
    )


def collect_batches(rows: DataFrame, at: str = "position") -> DataFrame:
    """One row per batch with its ``members`` in order and their offsets, shaped
    like a pack so the same assembly applies."""
    carried = [c for c in rows.columns if c not in ("batch_id", at)]
    return rows.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct(at, *carried))).alias("members")
    )
