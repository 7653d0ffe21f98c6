"""Length profiles. Everything after the first partial aggregation works on one
row per distinct length, so the number of rows behind a length does not matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAR = "█"


def length_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "length").agg(F.count("*").alias("n"))


def distinct_lengths(df: DataFrame) -> DataFrame:
    return df.select("length").distinct()


def histogram(df: DataFrame, by: Sequence[str] = (), bins: int = 100, width: int = 50) -> DataFrame:
    """Equal-width bins between the least and greatest length, empty ones listed,
    the greatest length in the last bin. When all lengths are equal there is one
    bin; for no rows there are none."""
    counts = length_counts(df, by)
    ends = counts.groupBy(*by).agg(F.min("length").alias("__low"), F.max("length").alias("__high"))
    ends = ends.filter("__low is not null").withColumn(
        "__step", (F.col("__high") - F.col("__low")) / F.lit(float(bins))
    )
    flat = F.col("__step") == 0
    last = F.when(flat, 0).otherwise(bins - 1)
    low, step = F.col("__low"), F.col("__step")
    nth = F.when(flat, 0).otherwise(F.least(F.floor((F.col("length") - low) / step), last)).cast("int")
    on = list(by) or ["__all"]
    if not by:
        counts, ends = (t.withColumn("__all", F.lit(0)) for t in (counts, ends))
    filled = (
        counts.join(ends, on)
        .groupBy(*on, nth.alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    every = ends.select(*on, "__low", "__step", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    most = F.max("n").over(W.partitionBy(*on))
    return (
        every.join(filled, [*on, "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("bar", F.repeat(F.lit(BAR), F.floor(F.col("n") / most * width).cast("int")))
        .select(
            *by,
            "bin",
            (low + F.col("bin") * step).alias("start"),
            (low + (F.col("bin") + 1) * step).alias("end"),
            "n",
            "bar",
        )
    )


def summary(df: DataFrame, by: Sequence[str] = (), bins: int = 100) -> DataFrame:
    low, high = F.min("length"), F.max("length")
    return (
        df.groupBy(*by)
        .agg(
            F.count("*").alias("n_rows"),
            low.alias("min_length"),
            high.alias("max_length"),
            (F.sum("length") / F.count("*")).alias("mean_length"),
            ((high - low) / F.lit(float(bins))).alias("bin_size"),
        )
        .filter("n_rows > 0")
    )
