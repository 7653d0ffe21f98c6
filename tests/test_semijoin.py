"""Rows of wanted keys, told apart where they lie."""

import pytest
from pyspark.sql import functions as F

from chatprep.operators import render, semijoin
from chatprep.plans import packed
from chatprep.settings import TOKENS


@pytest.mark.parametrize("n", [0, 1, 100, 20_000])
def test_no_wanted_key_is_lost_and_few_others_pass(spark, n):
    keys = spark.range(n).select((F.col("id") * 3).alias("k"))
    rows = spark.range(-5, 60_000).select(F.when(F.col("id") >= 0, F.col("id")).alias("k"))
    passed = semijoin.likely(rows, keys, "k")
    exact = semijoin.semi(rows, keys, "k")
    assert sorted(r.k for r in exact.collect()) == list(range(0, 3 * n, 3))
    assert passed.join(keys, "k", "left_semi").count() == n
    assert passed.count() - n <= 0.03 * (60_000 - n) + 5 and passed.filter("k IS NULL").count() == 0


def test_more_keys_than_the_filter_is_made_for(spark, monkeypatch):
    monkeypatch.setattr(semijoin, "MOST_BITS", 1 << 10)
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(8000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("__at0x"))
    assert semijoin.semi(rows, keys, "k").count() == 5000


def test_other_columns_stay(spark):
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 1)], "k string, words int")
    assert sorted(map(tuple, semijoin.semi(rows, keys, "k").collect())) == [("a", 1), ("a", 1)]


def test_refused_conversations_reach_no_shuffle(spark, tmp_path):
    """One refused conversation is half of the table, and there are 2000 more."""
    hot = spark.range(20_000).selectExpr("7L conv_id", "id turn", "'user' role", "'\"w w\"' content")
    refused = spark.range(20_000).selectExpr("1000 + id % 2000 conv_id", "id turn", "'user' role", "'broken' content")
    kept = spark.range(40).selectExpr("900000 + id conv_id", "0L turn", "'user' role", "'\"a\"' content")
    hot.unionByName(refused).unionByName(kept).write.parquet(f"{tmp_path}/turns")
    turns, none = spark.read.parquet(f"{tmp_path}/turns"), F.lit(None).cast("array<string>")
    made = packed.fitting_conversations(turns, none, TOKENS, 100)
    assert sorted(r.row_id for r in made.collect()) == list(range(900_000, 900_040))
    pieces = render.render_turns(turns, TOKENS)
    wanted = kept.select("conv_id")
    left = semijoin.likely(pieces.select("conv_id", "turn", "piece"), wanted, "conv_id")
    assert left.filter("conv_id = 7").isEmpty() and left.count() < 40 + 0.03 * 20_000
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Subquery" in plan
