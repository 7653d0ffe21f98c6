"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from chatprep.llm import (
    decontamination, language, line_dedup, mixing, near_dedup, quality, secrets, token_counts, toxicity, url_filter,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id string, node bigint, found string"
LONG = " ".join(f"word{i}" for i in range(300_000))
PROSE = " ".join(f"plain{i} speech{i}" for i in range(40))
ROWS = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (1, "another text of the same id", "en", "a"), (None, PROSE, None, None),
    (None, None, None, None), (2, None, "en", "b"), (3, "", "en", None), (4, " \t\n ", None, "a"), (5, "ab", "fr", "a"),
    (6, LONG, "en", "b"), (7, "é" * 500, "fr", "b"), (8, "x\ny\nz\nx\ny\nz", "en", "b"), (9, "1 2 3", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    full = [(*r, len(r[1]) if r[1] else None, "r", "i", 5, "f") for r in ROWS]
    return spark.createDataFrame(full, SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (8, 0, 1), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    text = "one two three four five six seven eight nine ten"
    return spark.createDataFrame([(1, text), (1, text), (2, None), (None, ""), (3, "too short")], "item_id bigint, text string")


def test_near_groups(docs):
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.groups(docs).collect()}
    assert near_dedup.groups(docs).count() == len(ROWS)
    assert got[(1, 76)].component_id == 1 and got[(1, 76)].kept
    assert got[(None, 76)].component_id == 1 and not got[(None, 76)].kept
    assert got[(2, 0)].component_id == 2 and got[(2, 0)].kept
    assert got[(None, 0)].component_id is None and got[(None, 0)].kept
    assert got[(6, 299_996)].kept and got[(5, 1)].kept


def test_near_kept_documents(docs):
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    # One of the three rows with the prose, everything else once.
    assert kept.count() == len(ROWS) - 2
    assert kept.filter(F.col("text") == PROSE).count() == 1


def test_quality(docs, labels):
    got = {r.doc_id: r for r in quality.rated(docs, labels).collect() if r.doc_id not in (1, None)}
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[2].base_failed
    assert got[6].n_words == 300_000 and got[7].word_chars == 500
    assert quality.rejecting(docs, labels).columns == docs.columns


def test_line_dedup(docs):
    got = {(r.doc_id, r.n_chars): r for r in line_dedup.deduped(docs).collect()}
    # Of x y z x y z the window xyz comes again, and covers the last three lines.
    assert got[(8, 11)].text == "x\ny\nz" and got[(8, 11)].removed_lines == 3
    assert got[(2, None)].text is None and got[(2, None)].removed_lines is None
    assert got[(3, None)].text == "" and got[(3, None)].removed_lines == 0


def test_line_dedup_across_documents(spark):
    rows = [(2, "p\nq\nr\nown"), (1, "a\np\n\nq \nr\nb"), (None, "p\nq\nr"), (3, "q\nr"), (2, "p\nq\nr\nown")]
    made = line_dedup.deduped(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = sorted((str(r.doc_id), r.text, r.removed_lines) for r in made)
    # The null id comes first; equal rows share their result.
    assert got == [("1", "a\n\nb", 3), ("2", "own", 3), ("2", "own", 3), ("3", "q\nr", 0), ("None", "p\nq\nr", 0)]


def test_line_dedup_on_its_own_output(docs, tmp_path):
    once = line_dedup.deduped(docs)
    twice = line_dedup.deduped(once)
    assert twice.columns == once.columns and twice.filter("removed_lines > 0").count() == 0
    stage = dict(corpus_pipeline.STAGES)["line dedup"](docs.sparkSession, once, str(tmp_path))
    assert stage.columns == once.columns and stage.count() == once.count()
    # The stage leaves a column of that name alone.
    assert stage.filter("removed_lines = 3").count() == once.filter("removed_lines = 3").count()


def test_decontamination(docs, items, spark):
    assert decontamination.contaminated(docs, items).count() == 0
    bad = spark.createDataFrame([(1, "x six seven, eight NINE ten y one two three four five z"), (2, "one two three"), (None, None)], "doc_id bigint, text string")
    got = decontamination.contaminated(bad, items).collect()
    assert [(r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in got] == [(1, 1, 1.0, 2)] * 2
    assert [r.doc_id for r in decontamination.clean(bad, items).orderBy("doc_id").collect()] == [None, 2]
    assert decontamination.clean(docs, items).columns == docs.columns


def test_mixing(docs):
    made = mixing.sampled(docs)
    assert made.columns == [*docs.columns, "mix_topic", "mix_tokens", "mix_probability"]
    # Nothing without words is lost.
    assert made.filter("mix_tokens = 0").count() == sum(not (r[1] or "").strip() for r in ROWS)


def test_language(docs):
    filters = language.train(docs)
    got = {r.doc_id: r for r in language.predicted(docs, filters).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 9)] == ["und"] * 4 and got[2].score == 0.0
    assert got[6].lang_pred == "en" and got[7].lang_pred == "fr"
    nothing = language.train(docs.filter("lang = 'none'"))
    assert {r.lang_pred for r in language.predicted(docs, nothing).collect()} == {"und"}


def test_toxicity(docs, labels):
    for model in (toxicity.train(docs, labels), toxicity.train(docs, labels.filter("toxic = 0"))):
        got = toxicity.scored(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)


def test_secrets(docs):
    ledger = secrets.Ledger.fresh(docs.sparkSession)
    ledger.scan(docs)
    made = ledger.found_in(docs.drop("found"))
    assert made.count() == len(ROWS) and made.filter("size(found) > 0").count() == 0


def test_token_counts(docs, tmp_path):
    rollup = token_counts.Rollup(docs.sparkSession, str(tmp_path))
    rollup.commit(1, token_counts.changes(docs, "insert"))
    words = {(r.source, r.lang): r.tokens for r in rollup.totals().filter("tokenizer = 'words-1'").collect()}
    assert words[("b", "en")] == 300_000 + 6 + 3 and words[(None, "en")] == 0


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, None), (None, ""), (2, "a.b.net"), (3, "HTTP://A.B.NET/x"), (3, "HTTP://A.B.NET/x"), (4, "x://net?/y")], "page_id bigint, url string")
    rules = [url_filter.Rule("b.net", "/")]
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, rules).collect())
    hit = ("3", "a.b.net", "/x", "b.net/", "block")
    assert got == [("1", "", "", None, "allow"), ("2", "", "", None, "allow"), hit, hit, ("4", "net", "", None, "allow"), ("None", "", "", None, "allow")]
    assert {r.verdict for r in url_filter.judged(pages, []).collect()} == {"allow"}


def test_empty_tables(spark, docs, labels, items, tmp_path):
    none = docs.limit(0)
    assert near_dedup.groups(none).count() == near_dedup.kept_documents(none).count() == 0
    assert quality.rated(none, labels).count() == quality.rejecting(none, labels).count() == 0
    assert line_dedup.deduped(none).count() == mixing.sampled(none).count() == 0
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == len(ROWS)
    assert language.predicted(none, language.train(none)).count() == 0
    assert toxicity.scored(none, toxicity.train(none, labels)).count() == 0
    assert quality.rejecting(docs, labels.limit(0)).count() == 4


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_documents(spark, docs, labels, items, tmp_path, k):
    for name, df in (("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for rows in (docs, docs.limit(0)):
        made = corpus_pipeline.STAGES[k][1](spark, rows, str(tmp_path))
        assert made.columns[: len(docs.columns)] == docs.columns
        made.collect()
