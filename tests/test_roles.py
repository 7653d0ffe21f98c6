import hashlib

import pytest

from chatprep.operators import profile, roles


def table(spark):
    rows = [("a", "train", i, i % 7 + 1) for i in range(400)]
    rows += [("a", "valid", 1000 + i, 9) for i in range(5)] + [("b", "train", 2000 + i, 3) for i in range(6)]
    return spark.createDataFrame(rows, "source string, split string, row_id bigint, length int"), rows


@pytest.mark.parametrize("n", [0, 1, 37, 399, 400, 500])
def test_truncate_takes_the_first_of_the_shuffled_order(spark, n):
    df, rows = table(spark)
    got = {r["row_id"] for r in roles.truncate(df, {"a": {"train": n}, "c": {"x": 1}}, 42).collect()}
    mine = sorted((r[2] for r in rows if r[:2] == ("a", "train")), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == set(mine[:n]) | {r[2] for r in rows if r[:2] != ("a", "train")}


def test_truncate_moves_no_payload(spark):
    df, _ = table(spark)
    plan = roles.truncate(df, {"a": {"train": 3}}, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()


def test_warnings(spark):
    df, _ = table(spark)
    got = roles.truncate_warnings(df, {"a": {"train": 399, "valid": 5}, "b": {"train": 7}}).collect()
    assert {(r["source"], r["split"], r["n_rows"], r["max_rows"]) for r in got} == {("a", "valid", 5, 5), ("b", "train", 6, 7)}


def test_route_filters_train_splits_in_all_their_roles(spark):
    df, _ = table(spark)
    count = lambda *a, **k: {
        (r["role"], r["split"]): r["count"] for r in roles.route(df, *a, **k).groupBy("role", "split").count().collect()
    }
    splits = {"train": ["train"], "valid": ["train", "valid"], "test": ["val"]}
    short = sum(1 for i in range(400) if i % 7 + 1 <= 4) + 6
    assert count(splits, 4) == {("train", "train"): short, ("valid", "train"): short, ("valid", "valid"): 5}
    # Without training nothing is filtered, and names match whole.
    assert count(splits, 4, do=("valid", "test")) == {("valid", "train"): 406, ("valid", "valid"): 5}


def test_concat(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2,)], "i int")
    assert roles.concat([]) is None
    assert [tuple(r) for r in roles.concat([a, b]).collect()] == [(1, "x"), (2, None)]


def test_histogram_edges(spark):
    same = spark.createDataFrame([("a", 5)] * 3 + [("b", 1), ("b", 11)], "source string, length int")
    got = profile.histogram(same, ["source"], 10, 50).orderBy("source", "bin").collect()
    assert [(r["bin"], r["n"]) for r in got if r["source"] == "a"] == [(0, 3)]
    assert [r["n"] for r in got if r["source"] == "b"] == [1] + [0] * 8 + [1]
    assert got[0]["bar"] == "█" * 50
    empty = same.filter("length > 99")
    assert profile.histogram(empty, [], 10, 50).count() == 0
    assert profile.summary(empty).count() == 0


def test_top_lengths(spark):
    df, _ = table(spark)
    got = roles.top_lengths(df, 4, ["train"], 3).orderBy("source", "split", "rank").collect()
    assert [(r["source"], r["split"], r["length"]) for r in got] == [
        *[("a", "train", 4)] * 3, *[("a", "valid", 9)] * 3, *[("b", "train", 3)] * 3,
    ]
    assert [r["row_id"] for r in got[:3]] == [3, 10, 17]


def test_size_report(spark):
    df, _ = table(spark)
    got = roles.size_report(df, 2, ["train"], {"a": {"train": 10_000}}, 1).collect()
    assert {(r["source"], r["split"]): (r["n_before"], r["n_after"]) for r in got} == {
        ("a", "train"): (400, 115), ("a", "valid"): (5, 5), ("b", "train"): (6, 0),
    }
