"""Exact ranks without a window over one large group.

A group may hold a third of all rows, so a plain ``row_number`` over it is one
task's work. Here every order comes with a bucket: a value that never decreases
along the order and that splits any group into pieces of bounded share. A row's
rank is its rank inside (group, bucket) plus the sizes of the group's earlier
buckets. Rows move once, to (group, bucket); the sizes are pre-aggregated and
arrive at the same place, so adding them moves no rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatprep.sources.stages import scratch

BUCKET = "__bucket"
# Hexadecimal digits of a digest that make a bucket: 4096 even ones in each group, or a
# million where the whole table is one group.
GROUP_DIGITS = 3
TABLE_DIGITS = 5


@dataclass(frozen=True)
class Order:
    keys: tuple[Column, ...]
    bucket: Column


def digest(*parts) -> Column:
    """md5 over ``a:b:c``; the same text in any engine, so shuffles can be checked."""
    return F.md5(
        F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    )


def shuffled(seed: int, epoch: int | None, row: str = "row_id", digits: int = GROUP_DIGITS) -> Order:
    salt = [seed] if epoch is None else [seed, epoch]
    key = digest(*salt, F.col(row).cast("string"))
    return Order((key, F.col(row)), F.substring(key, 1, digits))


def latest_first(df: DataFrame, row: str = "row_id", buckets: int = 512) -> Order:
    """Descending ``row``. Bucket bounds are quantiles of the whole table, fetched
    once as ``buckets`` - 1 numbers, so every later use sees the same bounds and a
    bucket holds an even share of the rows whatever the ids look like. A table of
    more rows than 512 tasks should sort wants more ``buckets``."""
    bounds: list = []
    if buckets > 1:
        steps = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(df.agg(F.percentile_approx(row, steps, 20 * buckets)).first()[0] or []))
    # The number of bounds at or above the value grows as the value falls.
    bucket = (
        F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= F.col(row)))
        if bounds
        else F.lit(0)
    )
    return Order((F.col(row).desc(),), bucket)


def bucket_sizes(df: DataFrame, by: Sequence[str], order: Order, total: str | None = None) -> DataFrame:
    """(by, bucket) with its row count and the rows in earlier buckets; a group
    has at most as many rows here as there are buckets."""
    sizes = (
        df.select(*by, order.bucket.alias(BUCKET))
        .groupBy(*by, BUCKET)
        .agg(F.count("*").alias("__here"))
    )
    group = W.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    cols = [*by, BUCKET, "__here", F.coalesce(F.sum("__here").over(earlier), F.lit(0)).alias("__before")]
    if total:
        cols.append(F.sum("__here").over(group).alias(total))
    return sizes.select(*cols)


def rank_in_bucket(df: DataFrame, by: Sequence[str], order: Order, name: str = "__nth") -> DataFrame:
    # The bucket leads: it tells rows apart better than a common group value, and
    # the sort compares its first column first.
    placed = W.partitionBy(BUCKET, *by).orderBy(*order.keys)
    return df.withColumn(BUCKET, order.bucket).withColumn(name, F.row_number().over(placed))


def ranked(
    df: DataFrame, by: Sequence[str], order: Order, rank: str = "rank", total: str | None = None
) -> DataFrame:
    """Adds the one-based ``rank`` of each row in its group, and the group's size.
    ``df`` is read twice (the counting pass reads only group and order columns), so
    pass a stored table, not an expensive plan. Group columns must not be null."""
    offsets = bucket_sizes(df, by, order, total).drop("__here")
    return (
        rank_in_bucket(df, by, order)
        .join(offsets, [BUCKET, *by])
        .withColumn(rank, F.col("__nth") + F.col("__before"))
        .drop("__nth", "__before", BUCKET)
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str, label: str) -> DataFrame:
    """Adds the zero-based position of each row in a total order over the table.

    Rows are range-partitioned and sorted, then written once: the bounds of a
    range exchange are sampled, so both readers must see one run of it. Positions
    follow from the row's place in its partition and the sizes of the partitions
    before it; those sizes are fetched, as many as there are shuffle partitions.
    """
    placed = scratch(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id()),
        label,
    )
    # Spark keeps the partition number in the upper bits, the row in the lower 33.
    part = F.shiftright("__place", 33).cast("int")
    sizes = dict(placed.groupBy(part.alias("part")).agg(F.count("*")).collect())
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    offsets = F.split(F.lit(",".join(map(str, starts or [0]))), ",").cast("array<bigint>")
    row = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, row + F.get(offsets, part)).drop("__place")
