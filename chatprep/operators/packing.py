"""Packing: fill fixed token budgets with whole sequences.

Which lengths share a pack depends only on how many rows have each length, so
the search runs on one histogram per group, never on rows. It yields strategies:
lists of lengths with the number of packs built that way. Every row then finds
its place by arithmetic. The rows of one length are ranked; the places for that
length are counted off in pack order; a row of rank r takes place r.
"""

from __future__ import annotations

import sys
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import count

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatprep.operators.ordering import (
    BUCKET,
    GROUP_DIGITS,
    TABLE_DIGITS,
    Order,
    bucket_sizes,
    rank_in_bucket,
    ranked,
    shuffled,
)
from chatprep.operators.profile import length_counts

# Executors need not have this package installed to run the packing function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CHUNK = 10_000


class _Shelf:
    """Open packs by free room; the newest pack of a room comes off first."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.packs: dict[int, list] = {}
        self.since: dict[int, int] = {}
        self._clock = count()

    def roomiest(self, limit: int) -> int:
        """Largest free room not above ``limit``, 0 when there is none."""
        at = bisect_right(self.rooms, limit)
        return self.rooms[at - 1] if at else 0

    def put(self, room: int, copies: int, lengths: list[int]) -> None:
        if room not in self.packs:
            insort(self.rooms, room)
            self.packs[room] = []
            self.since[room] = next(self._clock)
        self.packs[room].append((copies, lengths))

    def tidy(self, room: int) -> None:
        if not self.packs[room]:
            self.rooms.remove(room)
            del self.packs[room], self.since[room]


def shortest_pack_first(histogram: dict[int, int], max_len: int, limit: int) -> Iterator[tuple[int, list[int]]]:
    """Yields ``(copies, lengths)`` in pack order.

    Lengths go in from longest to shortest, each into the open pack with the most
    room that still takes it (Krell et al. 2021, arXiv 2107.02027). A length opens
    at most one new strategy or splits at most one, and in both cases is used up,
    so there are never more strategies than distinct lengths.
    """
    wrong = [n for n in histogram if not 1 <= n <= max_len]
    if wrong:
        raise ValueError(f"lengths outside 1..{max_len}: {sorted(wrong)[:5]}")
    waiting, done = _Shelf(), _Shelf()

    def shelve(room: int, copies: int, lengths: list[int]) -> None:
        full = room == 0 or len(lengths) == limit
        (done if full else waiting).put(room, copies, lengths)

    for length in sorted(histogram, reverse=True):
        left, reach = histogram[length], max_len
        while left:
            reach = waiting.roomiest(reach)
            if reach < length:
                shelve(max_len - length, left, [length])
                break
            copies, lengths = waiting.packs[reach].pop()
            used = min(copies, left)
            if copies > used:
                waiting.put(reach, copies - used, lengths)
            shelve(reach - length, used, [*lengths, length])
            waiting.tidy(reach)
            left -= used

    # Rooms in the order they first closed a pack, then those never closed in the
    # order they opened; within a room closed packs come before open ones.
    rooms = [*sorted(done.since, key=done.since.get)]
    rooms += [r for r in sorted(waiting.since, key=waiting.since.get) if r not in done.since]
    for room in rooms:
        yield from done.packs.get(room, [])
        yield from waiting.packs.get(room, [])


def strategies(df: DataFrame, max_len: int, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by, strategy_id, n, lengths, first_pack)``. A group's input is its length
    histogram, at most ``max_len`` rows for any number of sequences; a length
    outside ``1..max_len`` is an error. Store the result before using it twice."""
    by = list(by)
    fields = [df.schema[c] for c in by]
    schema = T.StructType(
        [
            *fields,
            T.StructField("strategy_id", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("first_pack", T.LongType()),
        ]
    )

    def pack(counts: pd.DataFrame) -> pd.DataFrame:
        if counts["length"].isna().any():
            raise ValueError("packing needs a length in every row")
        histogram = dict(zip(counts["length"].tolist(), counts["n"].tolist()))
        rows, first = [], 0
        for i, (copies, lengths) in enumerate(shortest_pack_first(histogram, max_len, limit)):
            rows.append((*(counts[c].iloc[0] for c in by), i, copies, lengths, first))
            first += copies
        return pd.DataFrame(rows, columns=schema.names)

    return length_counts(df, by).groupBy(*by).applyInPandas(pack, schema)


def needless(plan: DataFrame, max_len: int, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by, needless)``: strategies whose first sequence would have fitted into a pack that
    was open before. A pack is opened by its longest sequence and its room only shrinks, so
    a strategy with a longer first member, fewer members than ``limit`` and final room for
    the sequence was open then. 0 for ``strategies``; reads the plan, not the rows."""
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    room = F.when(F.size("lengths") < limit, F.lit(max_len) - total)
    firsts = plan.select(*by, F.get("lengths", F.lit(0)).alias("first"), room.alias("room"))
    # One row for each first length, at most max_len of a group.
    widest = firsts.groupBy(*by, "first").agg(F.count("*").alias("n"), F.max("room").alias("room"))
    before = W.partitionBy(*by).orderBy(F.col("first").desc()).rowsBetween(W.unboundedPreceding, -1)
    fits = F.max("room").over(before) >= F.col("first")
    return widest.withColumn("fits", fits).groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("n"))), F.lit(0).cast("long")).alias("needless"))


def _places(plan: DataFrame) -> DataFrame:
    """One row per slot of a strategy, with the slot's offsets in the pack."""
    upto = lambda k: F.aggregate(F.slice("lengths", 1, k), F.lit(0), lambda a, x: a + x)
    each = plan.select("*", F.posexplode("lengths").alias("slot", "length"))
    ended = each.withColumn("end", upto(F.col("slot") + 1))
    return ended.withColumn("start", F.col("end") - F.col("length"))


def packs(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every pack ``(by, pack_id, lengths)``. A strategy may stand for billions of
    packs, so its copies are split into chunks and dealt out to tasks before they
    are listed."""
    last = F.col("n") - 1
    step = F.lit(_CHUNK).cast("long")
    chunks = plan.withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("long"), last, step))
    ).repartition("strategy_id", "__from")
    copies = F.sequence("__from", F.least(F.col("__from") + (_CHUNK - 1), last))
    listed = chunks.select(*by, "lengths", "first_pack", F.explode(copies).alias("__copy"))
    return listed.select(*by, (F.col("first_pack") + F.col("__copy")).alias("pack_id"), "lengths")


def slots(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every slot of every pack ``(by, pack_id, slot, length, start, end)``."""
    return _places(packs(plan, by)).drop("lengths")


def place_ranges(df: DataFrame, plan: DataFrame, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """``(by, length, bucket, __at, __range)``: from which row of a bucket on the places of
    which strategy are filled, at most one row for each bucket and each strategy of a length.

    Within a length, copy c of a strategy that uses the length m times offers the
    places c*m .. c*m+m-1 after all earlier strategies' places. Starts of buckets and of
    strategies go into one sorted list; what holds at a start is the last of each kind.
    """
    key = [*by, "length"]
    group = W.partitionBy(*key).orderBy("strategy_id").rowsBetween(W.unboundedPreceding, -1)
    offered = (
        _places(plan)
        .groupBy(*key, "strategy_id", "n", "first_pack")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "start", "end"))).alias("slots"))
        .withColumn("__base", F.coalesce(F.sum(F.col("n") * F.size("slots")).over(group), F.lit(0).cast("long")))
    )
    strategy = F.struct("__base", "first_pack", "slots")
    cell = F.struct(F.col(BUCKET).alias("bucket"), "__before")
    cells = bucket_sizes(df, key, order).select(*key, F.col("__before").alias("__start"), cell.alias("__cell"))
    starts = cells.unionByName(
        offered.select(*key, F.col("__base").alias("__start"), strategy.alias("__strategy")), allowMissingColumns=True
    )
    sofar = W.partitionBy(*key).orderBy("__start").rangeBetween(W.unboundedPreceding, 0)
    held = starts.select(
        *key, "__start", F.last("__cell", True).over(sofar).alias("__cell"), F.last("__strategy", True).over(sofar).alias("__strategy"),
        F.lead("__start").over(W.partitionBy(*key).orderBy("__start")).alias("__next"),
    )
    # Of starts at one place the last stands for all.
    return held.filter(F.col("__next").isNull() | (F.col("__next") > F.col("__start"))).select(
        *key, F.col("__cell.bucket").alias(BUCKET), (F.col("__start") - F.col("__cell.__before")).alias("__at"),
        F.struct(
            (F.col("__start") - F.col("__strategy.__base")).alias("turn"), F.col("__start").alias("start"), "__cell.__before",
            "__strategy.first_pack", "__strategy.slots",
        ).alias("__range"),
    )


def assign(df: DataFrame, plan: DataFrame, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``pack_id, slot, start, end`` to each row of ``df``.

    Rows and ``place_ranges`` are merged in row order within (by, length, bucket), where
    the ranking has put the rows already, so a row meets the one range it falls into and
    no other. No length is one task's work, however common, and however many strategies
    share it.
    """
    key = [*by, "length"]
    ranges = place_ranges(df, plan, order, by)
    rows = rank_in_bucket(df, key, order).select(
        *key, BUCKET, (F.col("__nth") - 1).cast("long").alias("__at"), F.struct(*df.columns).alias("__row")
    )
    merged = rows.unionByName(ranges, allowMissingColumns=True)
    # A range comes before the row that starts it.
    sofar = W.partitionBy(BUCKET, *key).orderBy("__at", F.col("__row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = merged.withColumn("__range", F.last("__range", True).over(sofar)).filter(F.col("__row").isNotNull())
    turn = F.col("__range.turn") + F.col("__range.__before") + F.col("__at") - F.col("__range.start")
    times = F.size("__range.slots")
    return met.withColumn("__seat", F.get("__range.slots", (turn % times).cast("int"))).select(
        *[F.col("__row").getField(c).alias(c) for c in df.columns],
        (F.col("__range.first_pack") + F.call_function("div", turn, times)).alias("pack_id"),
        "__seat.slot", "__seat.start", "__seat.end",
    )


def gather(rows: DataFrame, placed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Packs as rows, from row contents kept apart from their places."""
    places = placed.select(*by, "row_id", "pack_id", "slot", "start", "end")
    return collect_packs(rows.join(places, [*by, "row_id"]), by)


def collect_packs(placed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per pack with its ``members`` in slot order. A pack has at most the
    element limit of members."""
    carried = [c for c in placed.columns if c not in (*by, "pack_id", "slot")]
    member = F.struct("slot", *carried)
    return placed.groupBy(*by, "pack_id").agg(F.array_sort(F.collect_list(member)).alias("members"))


def concatenated(members: str = "members", ids: str = "input_ids", labels: str | None = "labels") -> list:
    """Columns of one assembled sequence from an array of members."""
    each = lambda name: F.flatten(F.transform(members, lambda m: m[name]))
    positions = F.flatten(
        F.transform(members, lambda m: F.transform(m[ids], lambda _, i: i))
    )
    cols = [each(ids).alias(ids), positions.alias("position_ids")]
    return cols + ([each(labels).alias(labels)] if labels else [])


def images(members: str = "members", refs: str = "image_refs"):
    """Image references of a pack in order; members without images add none."""
    held = F.filter(members, lambda m: m[refs].isNotNull())
    return F.flatten(F.transform(held, lambda m: m[refs])).alias(refs)


def segments(members: str = "members"):
    """Bounds of the sequences in a pack: a position sees the positions of its own
    segment up to itself."""
    return F.transform(members, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("segments")


def visible_pairs(members: str = "members"):
    size = lambda m: (m["end"] - m["start"]).cast("long")
    return F.aggregate(
        members, F.lit(0).cast("long"), lambda a, m: a + (size(m) * (size(m) + 1) / 2).cast("long")
    ).alias("visible_pairs")


def running_segments(placed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Segment bounds from places alone, for packs that come without offsets."""
    w = W.partitionBy(*by, "pack_id").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("end", F.sum("length").over(w)).withColumn(
        "start", F.col("end") - F.col("length")
    )


def pack_order(packs: DataFrame, seed: int, epoch: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds the zero-based shuffled ``position`` of each pack in its epoch."""
    order = shuffled(seed, epoch, "pack_id", GROUP_DIGITS if by else TABLE_DIGITS)
    return ranked(packs, list(by), order, "position").withColumn("position", F.col("position") - 1)


def gather_batches(rows: DataFrame, placed: DataFrame, position: DataFrame, size: int) -> DataFrame:
    """``size`` packs joined into one longer sequence. ``position`` holds ``(pack_id,
    position)``; places are brought to their batch while they are narrow, so row contents
    move twice, to their place and to their batch."""
    at = placed.select("row_id", "pack_id", "slot").join(position.select("pack_id", "position"), "pack_id")
    carried = [c for c in rows.columns if c != "row_id"]
    return (
        rows.join(at.withColumn("batch_id", F.floor(F.col("position") / size)).drop("pack_id"), "row_id")
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "slot", "row_id", *carried))).alias("members"))
    )


def batches_of_packs(packs: DataFrame, size: int) -> DataFrame:
    """``size`` packs joined into one longer sequence, by their ``position``."""
    return (
        packs.withColumn("batch_id", F.floor(F.col("position") / size))
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "members"))).alias("__packs"))
        .select(
            "batch_id",
            F.flatten(F.transform("__packs", lambda p: p["members"])).alias("members"),
        )
    )


def summary(packs: DataFrame, max_len: int, by: Sequence[str] = ()) -> DataFrame:
    """Number of packs, tokens and fill rate. ``packs`` holds one row per pack
    with its ``n_tokens``, so counting needs no second shuffle."""
    return packs.groupBy(*by).agg(
        F.count("*").alias("n_packs"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_tokens") / (F.count("*") * F.lit(float(max_len)))).alias("fill_rate"),
    )
