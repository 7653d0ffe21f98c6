import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chatprep.operators import ordering, packing

GOLDENS = [
    ([7, 3, 3, 5, 5, 2], 3, [[5, 3], [5, 3], [7, 2]], [[4, 2], [3, 1], [0, 5]]),
    ([2, 2, 2, 2], 2, [[2], [2], [2], [2]], [[3], [2], [1], [0]]),
    ([6, 2, 2], 3, [[6, 2, 2]], [[0, 2, 1]]),
    ([6, 2, 2], 2, [[6, 2], [2]], [[0, 2], [1]]),
]


def one_by_one(lengths, max_len, limit):
    """Packing sequence after sequence, pack after pack, without a histogram."""
    stacks, closed, opened_at, closed_at, clock = {}, {}, {}, {}, 0
    for length in sorted(set(lengths), reverse=True):
        cursor = max_len
        todo = lengths.count(length)
        while todo:
            fitting = [r for r in stacks if length <= r <= cursor]
            if fitting:
                cursor = max(fitting)
                pack, room = stacks[cursor].pop() + [length], cursor - length
            else:
                pack, room = [length], max_len - length
            clock += 1
            if room == 0 or len(pack) == limit:
                closed.setdefault(room, []).append(pack)
                closed_at.setdefault(room, clock)
            elif fitting or not stacks.get(("fresh", length)):
                stacks.setdefault(room, []).append(pack)
                opened_at.setdefault(room, clock)
            if fitting and not stacks[cursor]:
                del stacks[cursor], opened_at[cursor]
            todo -= 1
            if not fitting:
                # Nothing fits any more: the rest of this length opens packs too.
                for _ in range(todo):
                    home = closed if room == 0 or limit == 1 else stacks
                    home[room].append([length])
                todo = 0
    rooms = sorted(closed_at, key=closed_at.get) + sorted(
        (r for r in opened_at if r not in closed_at), key=opened_at.get
    )
    return [p for r in rooms for p in closed.get(r, []) + stacks.get(r, [])]


def histogram_packs(lengths, max_len, limit):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = list(packing.shortest_pack_first(histogram, max_len, limit))
    return [p for copies, p in plan for _ in range(copies)], plan


@pytest.mark.parametrize("lengths, limit, packs, _", GOLDENS)
def test_golden_strategies(lengths, limit, packs, _):
    assert histogram_packs(lengths, 10, limit)[0] == packs
    assert one_by_one(lengths, 10, limit) == packs


@given(st.lists(st.integers(1, 30), max_size=120), st.integers(1, 6))
@settings(max_examples=400, deadline=None)
def test_histogram_equals_one_by_one(lengths, limit):
    packs, plan = histogram_packs(lengths, 30, limit)
    assert packs == one_by_one(lengths, 30, limit)
    assert sorted(x for p in packs for x in p) == sorted(lengths)
    assert all(sum(p) <= 30 and len(p) <= limit for p in packs)
    # The bound that keeps the plan table small.
    assert len(plan) <= len(set(lengths))


def test_needless_packs_are_counted(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, i % 2, rng.randint(1, 20)) for i in range(300)], "row_id bigint, g int, length int")
    for limit in (1, 2, 4):
        plan = packing.strategies(df, 20, limit, ["g"])
        assert {r["needless"] for r in packing.needless(plan, 20, limit, ["g"]).collect()} == {0}
    alone = packing.strategies(df, 20, 1, ["g"])
    assert all(r["needless"] > 0 for r in packing.needless(alone, 20, 4, ["g"]).collect())


def place(spark, lengths, max_len, limit, order=None, **kw):
    df = spark.createDataFrame(list(enumerate(lengths)), "row_id bigint, length int")
    plan = packing.strategies(df, max_len, limit)
    return df, packing.assign(df, plan, order or ordering.latest_first(df, **kw))


@pytest.mark.parametrize("lengths, limit, packs, rows", GOLDENS)
def test_golden_rows(spark, lengths, limit, packs, rows):
    for buckets in (8, 1):
        _, placed = place(spark, lengths, 10, limit, buckets=buckets)
        made = packing.collect_packs(placed).orderBy("pack_id").collect()
        assert [[m["row_id"] for m in r["members"]] for r in made] == rows
        assert [[m["length"] for m in r["members"]] for r in made] == packs


def check_invariants(df, plan, placed, max_len, limit):
    got = placed.collect()
    assert sorted(r["row_id"] for r in got) == sorted(r["row_id"] for r in df.collect())
    packs = {}
    for r in got:
        packs.setdefault(r["pack_id"], []).append((r["slot"], r["start"], r["end"], r["length"]))
    assert sorted(packs) == list(range(sum(r["n"] for r in plan.collect())))
    for p in packs.values():
        p.sort()
        assert [s for s, *_ in p] == list(range(len(p))) and len(p) <= limit
        at = 0
        for _, start, end, length in p:
            assert (start, end) == (at, at + length)
            at = end
        assert at <= max_len
    return packs


@pytest.mark.parametrize("seed", range(3))
def test_hot_length_and_shuffle(spark, seed):
    """Half of all rows share one length and meet many strategies."""
    rng = random.Random(seed)
    lengths = [3 if rng.random() < 0.5 else rng.randint(1, 40) for _ in range(4000)]
    df, placed = place(spark, lengths, 40, 5, ordering.shuffled(seed, 0))
    plan = packing.strategies(df, 40, 5)
    packs = check_invariants(df, plan, placed, 40, 5)
    want = one_by_one(lengths, 40, 5)
    assert [[x for *_, x in packs[i]] for i in range(len(packs))] == want


def test_groups_never_share_a_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id bigint, source string, length int")
    plan = packing.strategies(df, 10, 4, ["source"])
    placed = packing.assign(df, plan, ordering.shuffled(1, 0), ["source"])
    for s in "ab":
        mine = F.col("source") == s
        check_invariants(df.filter(mine), plan.filter(mine), placed.filter(mine), 10, 4)
    slots = packing.slots(plan, ["source"])
    assert slots.join(placed, ["source", "pack_id", "slot", "length", "start", "end"]).count() == 500


@pytest.mark.parametrize("bad", [0, 11, None])
def test_length_out_of_range_is_an_error(spark, bad):
    df = spark.createDataFrame([(1, 5), (2, bad)], "row_id bigint, length int")
    with pytest.raises(Exception, match="length"):
        packing.strategies(df, 10, 3).collect()


def test_no_rows_no_packs(spark):
    empty = spark.createDataFrame([], "row_id bigint, length int")
    assert packing.strategies(empty, 10, 3).count() == 0


def test_large_counts_are_listed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "_CHUNK", 3)
    df = spark.createDataFrame([(i, 4) for i in range(10)] + [(10 + i, 6) for i in range(10)], "row_id bigint, length int")
    plan = packing.strategies(df, 10, 3)
    assert [(r["n"], r["lengths"]) for r in plan.collect()] == [(10, [6, 4])]
    got = packing.slots(plan).orderBy("pack_id", "slot").collect()
    assert [(r["pack_id"], r["slot"], r["length"], r["start"]) for r in got] == [
        x for p in range(10) for x in ((p, 0, 6, 0), (p, 1, 4, 6))
    ]


def test_assembly(spark):
    rows = [(0, [1, 2, 3], [-100, 2, 3], ["x"]), (1, [4, 5], [4, -100], None), (2, [6], [6], ["y", "z"])]
    df = spark.createDataFrame(rows, "row_id bigint, input_ids array<int>, labels array<int>, image_refs array<string>")
    places = spark.createDataFrame(
        [(2, 0, 2, 5, 6), (0, 0, 0, 0, 3), (1, 0, 1, 3, 5)], "row_id bigint, pack_id bigint, slot int, start int, end int"
    )
    pack = packing.gather(df, places)
    r = pack.select(*packing.concatenated(), packing.images(), packing.segments(), packing.visible_pairs()).first()
    assert r["input_ids"] == [1, 2, 3, 4, 5, 6] and r["labels"] == [-100, 2, 3, 4, -100, 6]
    assert r["position_ids"] == [0, 1, 2, 0, 1, 0] and r["image_refs"] == ["x", "y", "z"]
    assert [tuple(s) for s in r["segments"]] == [(0, 3), (3, 5), (5, 6)] and r["visible_pairs"] == 6 + 3 + 1


def test_packs_join_into_batches(spark):
    df, placed = place(spark, [6, 4, 5, 5, 9], 10, 3)
    packs = packing.pack_order(packing.collect_packs(placed), 1, 0)
    made = packing.batches_of_packs(packs, 2).orderBy("batch_id").collect()
    order = [[m["row_id"] for m in r["members"]] for r in packs.orderBy("position").collect()]
    assert [[m["row_id"] for m in r["members"]] for r in made] == [sum(order[i : i + 2], []) for i in range(0, len(order), 2)]


def test_place_ranges_are_as_many_as_buckets_and_strategies(spark):
    # One length in many strategies, at a maximum far above the number of rows.
    longest = 131_072
    lengths = [longest - 2 * i - 1 for i in range(400)] + [1] * 900 + [7] * 50
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "row_id bigint, length int")
    plan = packing.strategies(df, longest, 3)
    order = ordering.shuffled(1, 0)
    ranges = packing.place_ranges(df, plan, order).groupBy("length").count().collect()
    cells = {r["length"]: r["count"] for r in ordering.bucket_sizes(df, ["length"], order).groupBy("length").count().collect()}
    used = {r["length"]: r["count"] for r in plan.select(F.explode(F.array_distinct("lengths")).alias("length")).groupBy("length").count().collect()}
    assert used[1] > 100
    assert all(r["count"] <= cells[r["length"]] + used[r["length"]] for r in ranges)
    placed = packing.assign(df, plan, order)
    got = sorted((r["pack_id"], r["slot"], r["length"]) for r in placed.collect())
    want = sorted((r["pack_id"], r["slot"], r["length"]) for r in packing.slots(plan).collect())
    assert got == want


def test_assign_meets_ranges_without_a_join(spark):
    df = spark.createDataFrame([(i, 1 + i % 5) for i in range(100)], "row_id bigint, length int")
    plan = packing.strategies(df, 8, 4)
    text = packing.assign(df, plan, ordering.shuffled(1, 0))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text
