import hashlib
import random

from pyspark.sql import functions as F

from chatprep.operators import batches, ordering


def table(spark, n=3000, ids=None):
    """Two thirds of the rows in one group, ids with large gaps."""
    rng = random.Random(5)
    ids = ids or [i if i % 3 else i + (1 << 41) for i in range(n)]
    rows = [(i, rng.choice([4, 4, 4, 4, 1, 2])) for i in ids]
    return spark.createDataFrame(rows, "row_id bigint, length int"), rows


def plain_ranks(rows, key):
    out, seen = {}, {}
    for i, g in sorted(rows, key=key):
        seen[g] = seen.get(g, 0) + 1
        out[i] = seen[g]
    return out


def test_latest_first_across_buckets(spark):
    df, rows = table(spark)
    for buckets in (300, 30, 1):
        order = ordering.latest_first(df, buckets=buckets)
        got = {r["row_id"]: r["rank"] for r in ordering.ranked(df, ["length"], order).collect()}
        assert got == plain_ranks(rows, lambda r: -r[0])


def test_buckets_hold_an_even_share(spark):
    df, rows = table(spark)
    order = ordering.latest_first(df, buckets=30)
    sizes = [r["n"] for r in df.groupBy(order.bucket.alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 30 and max(sizes) < 200


def test_shuffled_ranks(spark):
    df, rows = table(spark)
    key = lambda r: (hashlib.md5(f"1:2:{r[0]}".encode()).hexdigest(), r[0])
    ranked = ordering.ranked(df, ["length"], ordering.shuffled(1, 2), total="all")
    got = ranked.collect()
    assert {r["row_id"]: r["rank"] for r in got} == plain_ranks(rows, key)
    assert {r["all"] for r in got if r["length"] == 4} == {sum(1 for _, g in rows if g == 4)}


def test_numbered_over_many_partitions(spark):
    df, rows = table(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.numbered(df, [F.col("length").desc(), F.col("row_id")], "at", "numbered").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r["row_id"], r["length"]) for r in sorted(got, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in got) == list(range(len(rows)))


def test_fixed_batches(spark):
    df, rows = table(spark, 100)
    for drop, expected in ((True, 14 * 7), (False, 100)):
        got = batches.fixed(df, 7, drop, 1, 0, accumulate=2).collect()
        assert len(got) == expected
        assert all(r["batch_id"] == r["position"] // 7 and r["step_id"] == r["batch_id"] // 2 for r in got)


def test_epochs_differ(spark):
    df, _ = table(spark, 100)
    order = lambda e: [r["row_id"] for r in batches.shuffle_rows(df, 1, e).orderBy("position").collect()]
    assert order(0) != order(1) and sorted(order(0)) == sorted(order(1))


def test_batches_by_length(spark):
    df, rows = table(spark, 100)
    got = batches.by_length(df, 4, 5, 1, 0).collect()
    assert sorted(r["row_id"] for r in got) == sorted(i for i, _ in rows)
    per_batch = {}
    for r in got:
        per_batch.setdefault(r["batch_id"], []).append((r["slot"], r["length"]))
    assert sorted(per_batch) == list(range(25))
    for b in per_batch.values():
        assert [s for s, _ in sorted(b)] == list(range(4))
    for mega in range(5):
        run = [x for b in range(mega * 5, mega * 5 + 5) for _, x in sorted(per_batch[b])]
        assert run == sorted(run, reverse=True)
