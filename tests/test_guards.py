from chatprep.operators import guards


def test_reasons(spark):
    rows = [
        ("a", None, None),
        ("<img>", None, "orphan_placeholder"),
        ("a", [], None),
        ("<img>", [], None),
        ("<img>", ["x"], None),
        ("a", ["x"], "image_mismatch"),
        ("<img><img>", ["x"], "image_mismatch"),
        ("<img> <img>", ["x", "y"], None),
        ("<img>", ["x", "y"], "image_mismatch"),
        ("<im<img>g>", ["x"], None),
        (None, ["x"], "bad_content"),
    ]
    df = spark.createDataFrame(rows, "text string, image_refs array<string>, expected string")
    marked = guards.classify(df, "<img>")
    assert marked.filter("not (reason <=> expected)").collect() == []
    assert guards.kept(marked).count() == 6
    assert guards.rejects(marked).count() == 5


def test_overlapping_token_counts_without_overlap(spark):
    from pyspark.sql import functions as F

    from chatprep.functions.images import count_placeholders

    df = spark.createDataFrame([("aaaa",), ("aaa",)], "t string")
    assert [r[0] for r in df.select(count_placeholders(F.col("t"), "aa")).collect()] == [2, 1]
