"""Truncate, filter, route and concatenate sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.operators.ordering import BUCKET, bucket_sizes, digest, shuffled

PLACE = ["source", "split"]
ROLE_NAMES = ("train", "valid", "test")


def settings_table(spark: SparkSession, limits: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``{source: {split: max_rows}}`` as rows. It holds what the caller typed, so
    it is small enough to broadcast at any data size."""
    rows = [(s, p, n) for s, splits in limits.items() for p, n in splits.items()]
    return spark.createDataFrame(rows, "source string, split string, max_rows bigint")


def drawn(df: DataFrame, limits: Mapping[str, Mapping[str, int]], seed: int) -> DataFrame:
    """Adds ``drawn``: true for a random sample of ``max_rows`` rows of each
    (source, split) that has a limit and more rows than that, and for every row of
    the others.

    The last row to keep is found from narrow columns: bucket sizes tell in which
    1/4096th of the shuffled order the cut falls, and only that piece is ranked.
    The rows themselves are then compared with one cut per limit, in place,
    without a shuffle.
    """
    settings = settings_table(df.sparkSession, limits)
    order = shuffled(seed, None)
    limited = df.select(*PLACE, "row_id").join(F.broadcast(settings), PLACE)
    short = F.col("max_rows") - F.col("__before")
    crossing = (
        bucket_sizes(limited, [*PLACE, "max_rows"], order)
        .filter((short > 0) & (short <= F.col("__here")))
        .select(*PLACE, BUCKET, short.alias("__take"))
    )
    nth = F.row_number().over(W.partitionBy(*PLACE).orderBy(*order.keys))
    cuts = (
        limited.withColumn(BUCKET, order.bucket)
        .join(F.broadcast(crossing), [*PLACE, BUCKET])
        .withColumn("__nth", nth)
        .filter(F.col("__nth") == F.col("__take"))
        .select(*PLACE, digest(seed, F.col("row_id").cast("string")).alias("__key"), F.col("row_id").alias("__last"))
    )
    bounds = settings.join(cuts, PLACE, "left")
    key = order.keys[0]
    keep = (
        F.col("max_rows").isNull()
        | (F.col("max_rows") > 0)
        & (
            F.col("__key").isNull()
            | (key < F.col("__key"))
            | (key == F.col("__key")) & (F.col("row_id") <= F.col("__last"))
        )
    )
    marked = df.join(F.broadcast(bounds), PLACE, "left").withColumn("drawn", keep)
    return marked.drop("max_rows", "__key", "__last")


def truncate(df: DataFrame, limits: Mapping[str, Mapping[str, int]], seed: int) -> DataFrame:
    """The rows that ``drawn`` marks."""
    return drawn(df, limits, seed).filter("drawn").drop("drawn") if limits else df


def truncate_warnings(df: DataFrame, limits: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Limits that are not below the number of rows they apply to."""
    settings = settings_table(df.sparkSession, limits)
    sizes = df.groupBy(*PLACE).agg(F.count("*").alias("n_rows"))
    return sizes.join(F.broadcast(settings), PLACE).filter("n_rows <= max_rows")


def within(max_length: int) -> Column:
    return F.col("length") <= max_length


def _filtered(train_splits: Sequence[str], do_train: bool) -> Column:
    return F.col("split").isin(*train_splits) if do_train and train_splits else F.lit(False)


def length_filter(df: DataFrame, max_length: int, train_splits: Sequence[str], do_train: bool = True) -> DataFrame:
    """Drops overlong rows of train splits; other splits are left alone."""
    return df.filter(~_filtered(train_splits, do_train) | within(max_length))


def route(
    df: DataFrame,
    splits: Mapping[str, Sequence[str]],
    max_length: int,
    do: Sequence[str] = ROLE_NAMES,
) -> DataFrame:
    """One row per role that a row's split serves. Split names match exactly. A
    split that serves train is length-filtered in all its roles."""
    active = {r: list(splits.get(r, ())) for r in ROLE_NAMES if r in do}
    rows = [(role, split) for role, names in active.items() for split in names]
    roles = df.sparkSession.createDataFrame(rows, "role string, split string")
    chosen = length_filter(df, max_length, active.get("train", []))
    return chosen.join(F.broadcast(roles), "split")


def concat(tables: Sequence[DataFrame]) -> DataFrame | None:
    """All tables of a collection, in the order given; nothing for no tables."""
    if not tables:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def top_lengths(
    df: DataFrame,
    max_length: int,
    train_splits: Sequence[str],
    k: int = 100,
    do_train: bool = True,
    pieces: int = 64,
) -> DataFrame:
    """The ``k`` longest rows of each (source, split). Spark keeps only ``k`` rows
    per group and task before a shuffle; a first round over ``pieces`` of each group
    leaves few rows for the task that ends up with a large source."""
    longest = [F.col("length").desc(), F.col("row_id")]
    piece = F.pmod(F.hash("row_id"), F.lit(pieces)).alias("__piece")

    def first(rows: DataFrame, *by: str) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(*by).orderBy(*longest))
        return rows.withColumn("rank", nth).filter(F.col("rank") <= k)

    rows = length_filter(df, max_length, train_splits, do_train)
    rows = first(rows.select(*PLACE, "row_id", "length", piece), *PLACE, "__piece")
    return first(rows.drop("__piece", "rank"), *PLACE)


def size_report(
    before: DataFrame, max_length: int, train_splits: Sequence[str], limits: Mapping[str, Mapping[str, int]], seed: int
) -> DataFrame:
    """Rows per (source, split) as read and after truncation and filter, counted
    in one pass over the rows."""
    left = F.col("drawn") & (~_filtered(train_splits, True) | within(max_length))
    return (
        drawn(before, limits, seed)
        .groupBy(*PLACE)
        .agg(F.count("*").alias("n_before"), F.count_if(left).alias("n_after"))
    )
