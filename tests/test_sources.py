import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chatprep.functions import headers
from chatprep.operators import guards, ordering, packing, render
from chatprep.plans import packed, recipes
from chatprep.plans.prepare import prepare
from chatprep.settings import TOKENS
from chatprep.sources import collection, fixtures, stages
from chatprep.operators import vocab
from chatprep.sources.collection import Source, load
from chatprep.sources.ids import IdDictionary
from chatprep.streaming import arrivals


def test_load_splits_and_subsets(spark, tmp_path):
    for name, ids in {"one/train": [1, 2], "one/valid": [3], "two/ko": [1], "two/en": [1, 5]}.items():
        spark.createDataFrame([(i, f"t{i}") for i in ids], "id bigint, text string").write.parquet(f"{tmp_path}/{name}")
    made = collection.load(
        spark,
        {
            "one": collection.Source({s: f"{tmp_path}/one/{s}" for s in ("train", "valid")}, row_id="id"),
            "two": collection.Source(f"{tmp_path}/two", row_id="id"),
        },
        {"two": "en"},
    )
    base = collection.ROWS_PER_SOURCE
    got = sorted((r["row_id"], r["source"], r["source_ord"], r["split"], r["text"]) for r in made.collect())
    assert got == [
        (1, "one", 0, "train", "t1"), (2, "one", 0, "train", "t2"), (base + 3, "one", 0, "valid", "t3"),
        (2 * base + 1, "two", 1, "train", "t1"), (2 * base + 5, "two", 1, "train", "t5"),
    ]


def test_subset_reaches_the_scan(spark, small):
    df = collection.load(spark, fixtures.collection(small), {"captions": "en"}).filter("source = 'captions'").select("text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan
    assert "ReadSchema: struct<text:string,lang:string>" in plan


def png(path, width, height):
    chunk = lambda kind, data: (
        struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    )
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    pixels = zlib.compress(b"".join(b"\0" + b"\x10\x20\x30" * width for _ in range(height)))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", pixels) + chunk(b"IEND", b""))


def test_image_sizes(spark, tmp_path):
    png(tmp_path / "a b%20.png", 5, 3)
    r = collection.image_sizes(spark, str(tmp_path)).first()
    assert (r["image_size"]["height"], r["image_size"]["width"]) == (3, 5) and r["image_ref"].endswith("a b%20.png")


def test_image_sizes_equal_those_of_decoded_images(spark, tmp_path):
    jvm = spark._jvm
    for kind, width, height in (("png", 301, 7), ("jpg", 40, 33), ("gif", 9, 700)):
        image = jvm.java.awt.image.BufferedImage(width, height, 1)
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(f"{tmp_path}/x.{kind}"))
    size = lambda r: (r["height"], r["width"])
    want = {r["origin"].split("/")[-1]: size(r) for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect()}
    for whole in (False, True):
        got = {r["image_ref"].split("/")[-1]: size(r["image_size"]) for r in collection.image_sizes(spark, str(tmp_path), whole).collect()}
        assert got == want and len(got) == 3


def test_broken_headers_have_no_size(spark, tmp_path):
    png(tmp_path / "cut.png", 5, 3)
    (tmp_path / "cut.png").write_bytes((tmp_path / "cut.png").read_bytes()[:20])
    (tmp_path / "cut.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x10JFIF")
    (tmp_path / "empty.gif").write_bytes(b"")
    (tmp_path / "loop.gif").write_bytes(b"GIF89a" + bytes(7) + b"!\xfe")
    (tmp_path / "text.jpg").write_bytes(b"not an image")
    for whole in (False, True):
        got = collection.image_sizes(spark, str(tmp_path), whole).collect()
        assert len(got) == 4 and all(r["image_size"] is None for r in got)


def test_headers_are_read_and_not_the_rest():
    asked = []

    def fetch(start, count):
        asked.append((start, count))
        return whole[start : start + count]

    frame = b"\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 12, 34) + bytes(4)
    # Two large sections that are stepped over, filling bytes and a restart mark.
    section = lambda n: b"\xff\xe1" + struct.pack(">H", n) + bytes(n - 2)
    whole = b"\xff\xd8" + section(60_000) + section(65_000) + b"\xff\xff\xff\xd0" + frame + bytes(10_000_000)
    assert headers.image_size(headers.blocks(fetch)) == (12, 34)
    assert sum(count for _, count in asked) <= 4 * 4096


def test_attach_sizes(spark):
    rows = [(1, ["a", "b"]), (2, ["b"]), (3, []), (4, None), (5, ["a"]), (5, ["gone"]), (None, None), (None, ["a"])]
    df = spark.createDataFrame(rows, "row_id bigint, image_refs array<string>")
    sizes = spark.createDataFrame([("a", (3, 5)), ("b", (7, 9))], "image_ref string, image_size struct<height:int,width:int>")
    made = collection.attach_sizes(df, sizes)
    assert made.columns == ["row_id", "image_refs", "image_size"]
    got = sorted((r["row_id"] or 0, r["image_refs"] or [], r["image_size"] and r["image_size"]["height"]) for r in made.collect())
    assert got == [(0, [], None), (0, ["a"], 3), (1, ["a", "b"], 3), (2, ["b"], 7), (3, [], None), (4, [], None), (5, ["a"], 3), (5, ["gone"], None)]
    with pytest.raises(ValueError, match="not told apart"):
        collection.attach_sizes(df, sizes.union(sizes))


def test_gate_raises(spark, small):
    raw = fixtures.captions(spark, small)
    run = lambda **more: prepare(raw, "caption", TOKENS, splits=fixtures.SPLITS, max_length=500, **more)
    with pytest.raises(ValueError, match="missing_response"):
        run(response=["###", "Nobody:"])
    with pytest.raises(ValueError, match="missing_instruction"):
        run(response=["###", "Assistant:"], instruction=["###", "Nobody:"])
    assert run(response=["###", "Assistant:"]).rows.count()


def test_stage_is_reused_by_fingerprint(spark, tmp_path):
    root = str(tmp_path)
    first = spark.range(3).toDF("x")
    params = {"input": "p", "recipe": "chat", "max_length": 10}
    assert stages.stage(first, root, "map", params).count() == 3
    # Same parameters: what lies there is read, whatever the plan would give.
    assert stages.stage(spark.range(9).toDF("x"), root, "map", params).count() == 3
    for other in ({"recipe": "caption"}, {"max_length": 11}, {"input": "q"}):
        assert stages.stage(spark.range(9).toDF("x"), root, "map", params | other).count() == 9


def test_unfinished_stage_is_written_again(spark, tmp_path):
    params = {"a": 1}
    stages.stage(spark.range(3).toDF("x"), str(tmp_path), "map", params)
    folder = tmp_path / f"map-{stages.fingerprint(params)}"
    (folder / "_SUCCESS").rename(folder / "_GONE")
    assert stages.stage(spark.range(5).toDF("x"), str(tmp_path), "map", params).count() == 5


def test_prepare_reuses_both_stages(spark, small, tmp_path):
    raw = fixtures.captions(spark, small)
    run = lambda rows, n: prepare(
        rows, "caption", TOKENS, splits=fixtures.SPLITS, max_length=n, cache_dir=str(tmp_path), inputs=[small]
    )
    first = run(raw, 500)
    assert first.refused.count() == 0 and 0 < first.rows.count()
    assert first.rows.filter("size(input_ids) != length").count() == 0
    assert run(raw, 500).rows.count() == first.rows.count()
    assert run(raw, 5000).rows.count() > first.rows.count()
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["filter", "filter", "map", "words"]


def test_changed_input_is_computed_again(spark, tmp_path):
    def run(k, **more):
        spark.createDataFrame([(i, f"w{i} " * k, "a", "train", ["x"]) for i in range(4)], "row_id bigint, caption string, source string, split string, image_refs array<string>").write.mode("overwrite").parquet(f"{tmp_path}/in")
        raw = spark.read.parquet(f"{tmp_path}/in")
        return prepare(raw, "caption", TOKENS, splits={"train": ["train"]}, max_length=500, cache_dir=f"{tmp_path}/cache", **more)

    one, two = run(1, inputs=["in"]), run(5, inputs=["in"])
    length = lambda made: made.rows.agg(F.sum("length")).first()[0]
    assert length(two) == length(one) + 4 * 4
    with pytest.raises(ValueError, match="inputs"):
        run(1)


def test_splits_that_repeat_ids_do_not_mix(spark, tmp_path):
    for split, word in (("train", "a"), ("valid", "b b b")):
        spark.createDataFrame([(1, word), (2, word)], "id bigint, text string").write.parquet(f"{tmp_path}/{split}")
    source = collection.Source({s: f"{tmp_path}/{s}" for s in ("train", "valid")}, {"caption": "text"}, row_id="id")
    raw = collection.load(spark, {"one": source}).withColumn("image_refs", F.array("source"))
    made = prepare(raw, "caption", TOKENS, splits={"train": ["train"], "valid": ["valid"]}, max_length=500)
    assert made.rows.count() == 4 and made.rows.filter("size(input_ids) != length").count() == 0
    assert made.rows.select("row_id").distinct().count() == 4
    with pytest.raises(ValueError, match="not told apart"):
        prepare(raw.union(raw.limit(1)), "caption", TOKENS, splits={"train": ["train"]}, max_length=500)


@pytest.mark.parametrize("bad", [1 << 40, -1, None])
def test_ids_that_do_not_fit_are_refused(spark, tmp_path, bad):
    spark.createDataFrame([(bad, "x")], "id bigint, text string").write.parquet(f"{tmp_path}/one")
    made = collection.load(spark, {"one": collection.Source(f"{tmp_path}/one", row_id="id")})
    with pytest.raises(Exception, match="not below 2"):
        made.select("row_id").collect()
    assert made.select("text").count() == 1


def test_scope_deletes_its_own_tables_only(spark):
    outside = stages.scratch(spark.range(3).toDF("x"), "outside")
    with stages.scope(spark):
        inside = stages.scratch(outside, "inside")
        assert inside.count() == 3
        path = inside.inputFiles()[0]
    assert outside.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_readme_way(spark, small):
    """Sources to packs of each role, by the public functions alone."""
    raw = collection.load(
        spark,
        {
            "captions": collection.Source(
                f"{small}/documents.parquet", {"caption": "text"}, row_id="doc_id", split=fixtures.split_of(F.col("doc_id"))
            )
        },
    ).withColumn("image_refs", F.array("source"))
    made = prepare(raw, "caption", TOKENS, splits=fixtures.SPLITS, max_length=500, limits={"captions": {"train": 90}})
    rows = stages.scratch(made.rows.filter("length <= 500"), "rows")
    plan = stages.scratch(packing.strategies(rows, 500, 20, ["role"]), "strategies")
    packs = packing.collect_packs(packing.assign(rows, plan, ordering.shuffled(1, 0), ["role"]), ["role"])
    whole = packs.select("role", *packing.concatenated(labels=None), packing.images())
    assert whole.filter("size(input_ids) > 500").count() == 0
    got = {r["role"]: (r["n"], r["images"]) for r in whole.groupBy("role").agg(F.sum(F.size("input_ids")).alias("n"), F.sum(F.size("image_refs")).alias("images")).collect()}
    want = {r["role"]: (r["n"], r["images"]) for r in rows.groupBy("role").agg(F.sum("length").alias("n"), F.count("*").alias("images")).collect()}
    assert got == want and set(got) == {"train", "valid", "test"}


def test_scratch_is_released(spark):
    made = stages.scratch(spark.range(3).toDF("x"), "kept")
    assert made.count() == 3
    assert stages.release(spark) >= 1 and stages.release(spark) == 0


def test_stream_equals_batch(spark, small, tmp_path):
    rows = fixtures.chat(spark, small)
    source = f"{tmp_path}/in"
    rows.repartition(4).write.parquet(source)
    arriving = arrivals.arriving(spark, source, rows.schema, files_per_batch=1)
    q = arrivals.write_measured(arriving, "chat", TOKENS, 700, f"{tmp_path}/out", f"{tmp_path}/c1")
    q.awaitTermination(120)
    batch = arrivals.measured(rows, "chat", TOKENS, 700).select("row_id", "text", "length")
    streamed = spark.read.parquet(f"{tmp_path}/out").select("row_id", "text", "length")
    assert 0 < batch.count() < rows.count()
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))

    words = vocab.build_vocab(recipes.chat(rows, TOKENS), TOKENS.specials)
    q = arrivals.write_encoded(arriving, "chat", TOKENS, 700, words, f"{tmp_path}/ids", f"{tmp_path}/c2")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/ids").select("row_id", "input_ids")
    want = recipes.encoded(arrivals.measured(rows, "chat", TOKENS, 700), words).select("row_id", "input_ids")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("max_length", [400, 100_000])
def test_sums_over_turns_equal_whole_conversations(spark, small, max_length):
    """The way that measures before it assembles keeps the same rows."""
    whole = guards.kept(recipes.chat(fixtures.chat(spark, small), TOKENS)).filter(F.col("length") <= max_length)
    summed = packed.fitting_conversations(
        fixtures.turns(spark, small), fixtures.image_refs(F.col("conv_id")), TOKENS, max_length
    )
    cols = ["row_id", "image_refs", "tokens", "length"]
    as_rows = lambda df: sorted(df.select(*cols).collect(), key=lambda r: r["row_id"])
    assert as_rows(whole) == as_rows(summed)


def test_bad_turn_drops_its_conversation(spark):
    rows = [(1, 0, "user", '"a"'), (1, 1, "assistant", "broken"), (2, 0, "user", '"b"')]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")
    none = F.lit(None).cast("array<string>")
    made = packed.fitting_conversations(turns, none, TOKENS, 100).collect()
    assert [r["row_id"] for r in made] == [2]
    assert render.conversation_sizes(render.render_turns(turns, TOKENS)).filter("bad").count() == 1


def test_hot_conversation_is_dropped_before_assembly(spark):
    """One conversation holds nearly all turns; it cannot fit and is not collected."""
    hot = spark.range(5000).selectExpr("7L conv_id", "id turn", "'user' role", "'\"w w\"' content")
    cold = spark.range(40).selectExpr("100 + id conv_id", "0L turn", "'user' role", "'\"a\"' content")
    turns = hot.unionByName(cold)
    none = F.lit(None).cast("array<string>")
    made = packed.fitting_conversations(turns, none, TOKENS, 100)
    assert sorted(r["row_id"] for r in made.collect()) == list(range(100, 140))
    pieces = render.render_turns(turns, TOKENS)
    sizes = packed.judged_conversations(pieces, none)
    heavy = sizes.filter("length > 100").select("conv_id", "length")
    everything = sizes.select("conv_id", "length", "image_refs")
    # Even when asked for everything, the heavy one is gone before the join.
    assert render.assemble(pieces, everything, heavy, TOKENS).count() == 40


def test_hot_conversation_of_unusable_turns_is_dropped(spark):
    """It has no length at all, and still goes before its turns are put together."""
    hot = spark.range(5000).selectExpr("7L conv_id", "id turn", "'user' role", "'broken' content")
    cold = spark.range(40).selectExpr("100 + id conv_id", "0L turn", "'user' role", "'\"a\"' content")
    turns, none = hot.unionByName(cold), F.lit(None).cast("array<string>")
    assert packed.fitting_conversations(turns, none, TOKENS, 100).count() == 40
    sizes = packed.judged_conversations(render.render_turns(turns, TOKENS), none)
    assert [tuple(r) for r in sizes.filter("reason IS NOT NULL").select("conv_id", "length", "n_turns").collect()] == [(7, None, 5000)]


def test_rows_are_rendered_once(spark, small):
    """The filter reads the row that was made; it does not hold the rendering again."""
    rows = fixtures.chat(spark, small)
    plan = arrivals.measured(rows, "chat", TOKENS, 700)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any(TOKENS.image in line for line in filters)
    assert plan.count("Generate inline") == 1


def test_plan_does_not_depend_on_size(spark, small):
    from chatprep.plans import queries

    for name in ("rank_in_length", "fixed_batches"):
        shapes = []
        for folder in (small, small.replace("sf0.001", "sf0.01")):
            plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
            shapes.append([line.strip(" :+-").split(" ")[0] for line in plan.splitlines()])
        assert shapes[0] == shapes[1]


def test_text_ids_keep_their_numbers(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    ids = IdDictionary(spark, f"{tmp_path}/ids")
    docs = table("d", [("y", None, "t1"), ("x", 10, "t2"), ("x", 9, "t3"), ('q","1', 1, "t4"), ("q", None, "t5")], "a string, b int, text string")
    papers = Source(docs, {"caption": "text"}, row_id=["a", "b"])
    number = lambda **sources: {(r.source, r.caption): r.row_id for r in load(spark, sources, ids=ids).collect()}
    first = number(papers=papers)
    assert sorted(first.values()) == [0, 1, 2, 3, 4]
    assert number(papers=papers) == first and ids.numbers().count() == 5
    notes = table("n", [("k2", "u"), ("k1", "v")], "k string, text string")
    both = number(notes=Source({"train": notes, "test": notes}, {"caption": "text"}, row_id="k"), papers=papers)
    assert {k: v for k, v in both.items() if k[0] == "papers"} == first
    # Both splits count for themselves: test comes before train.
    got = sorted(r.row_id for r in ids.numbers().filter("source = 'notes'").collect())
    assert got == [5, 6, 7, 8] and ids.numbers().filter("path_split = 'test' AND row_id < 7").count() == 2
    # Sources without ids keep all their rows, and have none.
    plain = load(spark, {"papers": papers, "plain": Source(notes, {"caption": "text"})}, ids=ids)
    assert plain.filter("row_id IS NULL").count() == 2 and plain.count() == 7
    empty = spark.createDataFrame([], "source string, path_split string, own string")
    assert ids.extend(empty).count() == 9
    with pytest.raises(Exception, match="row id of source bad is null"):
        number(bad=Source(table("z", [(None, None, "t")], "a string, b int, text string"), {"caption": "text"}, row_id=["a", "b"]))
    with pytest.raises(ValueError, match="several columns"):
        load(spark, {"papers": papers})
