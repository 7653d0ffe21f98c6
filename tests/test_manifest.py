"""Stages kept by file, and streams kept by batch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from chatprep.operators import vocab
from chatprep.plans import recipes
from chatprep.plans.prepare import prepare, prepare_files
from chatprep.settings import TOKENS
from chatprep.sources import fixtures
from chatprep.sources.manifest import FileStage, file_of_row
from chatprep.streaming import arrivals, committed


def _write(spark, folder, name, values):
    """One file of numbers; a changed one also has another time."""
    made = f"{os.path.dirname(folder)}/made-{time.time_ns()}"
    spark.createDataFrame([(v,) for v in values], "x bigint").coalesce(1).write.parquet(made)
    part = next(f for f in os.listdir(made) if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    os.replace(f"{made}/{part}", f"{folder}/{name}.parquet")


@pytest.fixture
def numbers(spark, tmp_path):
    read = []

    def mapped(files):
        read.append(sorted(os.path.basename(f) for f in files))
        if not files:
            return spark.createDataFrame([], "y bigint, input_file string")
        return spark.read.schema("x bigint").parquet(*files).select((F.col("x") * 10).alias("y"), file_of_row())

    stage = FileStage(spark, f"{tmp_path}/stages", "ten", {"times": 10}, mapped)
    return f"{tmp_path}/in", stage, read


def _values(df):
    return sorted(r.y for r in df.collect())


def test_only_new_changed_and_removed_files_count(spark, numbers):
    folder, stage, read = numbers
    _write(spark, folder, "a", [1, 2])
    _write(spark, folder, "b", [3])
    assert _values(stage.update(folder)) == [10, 20, 30]
    assert _values(stage.update(folder)) == [10, 20, 30]
    assert read == [["a.parquet", "b.parquet"]] and stage.version() == 1
    _write(spark, folder, "c", [4])
    assert _values(stage.update(folder)) == [10, 20, 30, 40]
    _write(spark, folder, "a", [1, 2, 2])
    assert _values(stage.update(folder)) == [10, 20, 20, 30, 40]
    os.remove(f"{folder}/b.parquet")
    assert _values(stage.update(folder)) == [10, 20, 20, 40]
    assert read == [["a.parquet", "b.parquet"], ["c.parquet"], ["a.parquet"]]
    _write(spark, folder, "b", [3])
    assert _values(stage.update(folder)) == [10, 20, 20, 30, 40]
    # The same stage, opened again.
    again = FileStage(spark, stage.path.rsplit("/", 1)[0], "ten", {"times": 10}, stage.mapped)
    assert _values(again.update(folder)) == [10, 20, 20, 30, 40] and len(read) == 4


def test_unchanged_files_are_not_opened(spark, numbers):
    """Their content may even be unreadable."""
    folder, stage, _ = numbers
    _write(spark, folder, "a", [1])
    stage.update(folder)
    path = f"{folder}/a.parquet"
    was = os.stat(path)
    with open(path, "wb") as f:
        f.write(b"x" * was.st_size)
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))
    _write(spark, folder, "b", [2])
    assert _values(stage.update(folder)) == [10, 20]


def test_a_run_that_stops_leaves_the_stage_as_it_was(spark, numbers, monkeypatch):
    folder, stage, read = numbers
    _write(spark, folder, "a", [1])
    stage.update(folder)
    _write(spark, folder, "b", [2])
    with monkeypatch.context() as m:
        m.setattr(stage, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            stage.update(folder)
    assert _values(stage.rows()) == [10]
    # Half a log entry is passed over: its rows say there are more of them.
    half = stage._log()[1].withColumn("n_entries", F.lit(5).cast("bigint"))
    half.write.parquet(f"{stage.path}/log/version=7")
    assert stage.version() == 1 and _values(stage.rows()) == [10]
    assert _values(stage.update(folder)) == [10, 20] and read[-1] == ["b.parquet"]


def test_of_two_runs_at_once_the_second_fails(spark, numbers):
    folder, stage, _ = numbers
    _write(spark, folder, "a", [1])
    stage.update(folder)
    entries = stage._log()[1]
    stage._commit(entries, 2)
    with pytest.raises(Exception, match="(?i)exist"):
        stage._commit(entries, 2)


def test_many_runs_are_written_together(spark, numbers, monkeypatch):
    folder, stage, _ = numbers
    monkeypatch.setattr("chatprep.sources.manifest.MOST_RUNS", 2)
    for i in range(5):
        _write(spark, folder, f"f{i}", [i])
        if i == 3:
            os.remove(f"{folder}/f0.parquet")
        stage.update(folder)
    assert _values(stage.rows()) == [10, 20, 30, 40]
    assert stage.files().select("stage_run").distinct().count() <= 2


def test_no_files(spark, numbers):
    folder, stage, _ = numbers
    os.makedirs(folder)
    assert stage.update(folder).count() == 0
    _write(spark, folder, "a", [1])
    assert _values(stage.update(folder)) == [10]
    os.remove(f"{folder}/a.parquet")
    assert stage.update(folder).count() == 0


def test_prepared_by_file_equals_prepared_at_once(spark, small, tmp_path):
    rows = fixtures.captions(spark, small).withColumn("caption", F.when(F.col("row_id") % 7 == 0, F.concat("caption", F.lit(TOKENS.image))).otherwise(F.col("caption")))
    source = f"{tmp_path}/captions"
    read = lambda files: spark.read.parquet(*files).select("*", file_of_row())
    settings = dict(splits=fixtures.SPLITS, max_length=400, limits=fixtures.LIMITS)
    for lot in range(3):
        rows.filter(F.col("row_id") % 3 == lot).write.mode("append").parquet(source)
        made = prepare_files(spark, source, read, "caption", TOKENS, cache_dir=f"{tmp_path}/stages", **settings)
    whole = prepare(rows, "caption", TOKENS, **settings)
    as_rows = lambda df: sorted(map(tuple, df.select("role", "source", "split", "row_id", "input_ids").collect()))
    assert as_rows(made.rows) == as_rows(whole.rows) and as_rows(made.rows)
    told = lambda df: sorted(map(tuple, df.select("row_id", "reason", "text").collect()))
    assert told(made.refused) == told(whole.refused) and len(told(made.refused)) > 10


def test_a_run_without_new_files_counts_and_encodes_nothing(spark, tmp_path, monkeypatch):
    source = f"{tmp_path}/captions"
    raw = spark.createDataFrame([(i, "s", "train", f"some words {i}") for i in range(20)], "row_id bigint, source string, split string, caption string")
    raw.withColumn("image_refs", F.array("source")).write.parquet(source)
    read = lambda files: spark.read.parquet(*files).select("*", file_of_row())
    run = lambda: prepare_files(spark, source, read, "caption", TOKENS, cache_dir=f"{tmp_path}/stages", splits={"train": ["train"]}, max_length=99)
    first = run()
    want = sorted(map(tuple, first.rows.select("row_id", "length", "input_ids").collect()))

    def refused(*_, **__):
        raise AssertionError("vocabulary and ids are there")

    monkeypatch.setattr(vocab, "build_vocab", refused)
    monkeypatch.setattr(vocab, "encode", refused)
    again = run()
    assert sorted(map(tuple, again.rows.select("row_id", "length", "input_ids").collect())) == want and len(want) == 20
    assert again.rows.schema == first.rows.schema and again.vocabulary.schema == first.vocabulary.schema


def test_text_is_stored_for_refused_rows_only(spark, small, tmp_path):
    rows = fixtures.captions(spark, small).withColumn("caption", F.when(F.col("row_id") < 5, TOKENS.image).otherwise(F.col("caption")))
    prepare(rows, "caption", TOKENS, splits=fixtures.SPLITS, max_length=400, cache_dir=str(tmp_path), inputs=["x"])
    stored = spark.read.parquet(*[f"{tmp_path}/{f}" for f in os.listdir(tmp_path) if f.startswith("map-")])
    assert stored.filter("reason IS NULL AND text IS NOT NULL").count() == 0
    assert stored.filter("reason IS NOT NULL AND text IS NULL").count() == 0 < stored.filter("reason IS NOT NULL").count()


def _stream(spark, tmp_path, sink):
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    incoming = arrivals.arriving(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    return committed.write_arrivals(incoming, "chat", TOKENS, 700, sink, f"{tmp_path}/checkpoint")


def test_stream_goes_on_after_a_killed_batch(spark, small, tmp_path, monkeypatch):
    rows = fixtures.chat(spark, small)
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    sink = committed.CommittedBatches(spark, f"{tmp_path}/out")
    commit, calls = sink._commit, []

    def killed(table, batches):
        calls.append(batches)
        if len(calls) == 2:
            raise RuntimeError("killed before the commit")
        commit(table, batches)
        if len(calls) == 3:
            raise RuntimeError("killed after the commit")

    monkeypatch.setattr(sink, "_commit", killed)
    for _ in range(2):
        with pytest.raises(Exception):
            _stream(spark, tmp_path, sink).awaitTermination()
    monkeypatch.setattr(sink, "_commit", commit)
    _stream(spark, tmp_path, sink).awaitTermination()
    batch = arrivals.measured(rows, "chat", TOKENS, 700)
    as_rows = lambda df: sorted(map(tuple, df.select("row_id", "tokens", "length").collect()))
    assert as_rows(sink.rows()) == as_rows(batch) and sink.commits().count() == 4
    # More folders were written than count.
    assert len(os.listdir(f"{tmp_path}/out/rows")) == 5

    words = vocab.build_vocab(batch, TOKENS.specials)
    got = sink.encode(words)
    want = recipes.encoded(batch, words)
    ids = lambda df: sorted(map(tuple, df.select("row_id", "input_ids").collect()))
    assert ids(got) == ids(want) and len(os.listdir(f"{tmp_path}/out/encoded")) == 1


def test_later_rows_are_encoded_with_the_pinned_vocabulary(spark, small, tmp_path):
    rows = fixtures.chat(spark, small)
    rows.filter("row_id % 2 = 0").write.parquet(f"{tmp_path}/in")
    sink = committed.CommittedBatches(spark, f"{tmp_path}/out")
    assert sink.rows() is None and sink.encode(vocab.build_vocab(recipes.chat(rows.limit(1), TOKENS), TOKENS.specials)) is None
    _stream(spark, tmp_path, sink).awaitTermination()
    words = vocab.build_vocab(sink.rows(), TOKENS.specials)
    first = sink.encode(words).count()
    rows.filter("row_id % 2 = 1").write.mode("append").parquet(f"{tmp_path}/in")
    _stream(spark, tmp_path, sink).awaitTermination()
    other = vocab.build_vocab(recipes.chat(rows, TOKENS), TOKENS.specials)
    made = sink.encode(other)
    want = recipes.encoded(arrivals.measured(rows, "chat", TOKENS, 700), words)
    ids = lambda df: sorted(map(tuple, df.select("row_id", "input_ids").collect()))
    assert ids(made) == ids(want) and made.count() > first
    # The vocabulary meets the rows of a run once: one folder of ids for each run.
    assert len(os.listdir(f"{tmp_path}/out/encoded")) == 2


def test_kept_stages_are_small(spark, tmp_path):
    """Stages that stay are written with zstd, the map stage with one text of tokens a row."""
    import pyarrow.parquet as pq

    raw = spark.createDataFrame([(i, "s", "train", f"some  words {i}") for i in range(20)], "row_id bigint, source string, split string, caption string")
    raw = raw.withColumn("image_refs", F.array("source"))
    prepare(raw, "caption", TOKENS, splits={"train": ["train"]}, max_length=99, cache_dir=str(tmp_path), inputs=["x"])
    files = list(tmp_path.glob("*/*.parquet"))
    assert {f.parent.name.split("-")[0] for f in files} == {"map", "words", "filter"}
    for f in files:
        seen = pq.ParquetFile(f).metadata
        assert all(seen.row_group(g).column(c).compression == "ZSTD" for g in range(seen.num_row_groups) for c in range(seen.num_columns))
    stored = spark.read.parquet(*{str(f.parent) for f in files if f.parent.name.startswith("map-")})
    assert dict(stored.dtypes)["tokens"] == "string" and stored.filter("tokens NOT LIKE '% some words %'").count() == 0
