"""The registered queries over the smallest tables."""

import itertools
import re
import string

import corpus_pipeline
import pytest
from compare import connect, differs
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chatprep.llm.oracle import ORACLE_SQL, near_dedup_sql
from chatprep.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline"} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, name):
    assert differs(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name]) is None


def _labelled(spark, name, folder):
    made = QUERIES[name](spark, folder).filter("held_out")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    return made.join(docs, "doc_id")


def test_language_of_held_out_documents(spark):
    made = _labelled(spark, "op10_language", "/root/testdata/sf0.01").collect()
    assert sum(r.lang == r.lang_pred for r in made) >= 0.97 * len(made) > 100


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    made = _labelled(spark, "op3_toxicity", folder).join(labels, "doc_id").collect()
    toxic = [r for r in made if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted != r.toxic for r in made) <= 0.05 * len(made)
    assert any(s.score >= 0.5 for r in toxic for s in r.offending)


def test_offending_sentences_lie_where_they_say(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for r in QUERIES["op3_toxicity"](spark, small).filter(F.size("offending") > 0).join(docs, "doc_id").collect():
        for s in r.offending:
            part = r.text[s.start : s.end]
            assert part and not set(part) & set("!?\n.") and s.end <= len(r.text)


def test_pipeline_stage_by_stage(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert kept[-1].columns == docs.columns, name
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    # Each stage against its operator on its own input.
    rated = QUERIES["op6_quality_forest"](spark, folder)
    assert ids[1] == {r.doc_id for r in rated.filter("kept").collect()}
    con = connect(folder)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/0/*.parquet'")
    wanted = dict(con.sql(f"SELECT doc_id, text FROM ({ORACLE_SQL['op8_line_dedup']})").fetchall())
    assert {r.doc_id: r.text for r in kept[2].collect()} == {i: wanted[i] for i in ids[2]}
    assert all(not wanted[i].strip() for i in ids[1] - ids[2])
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/1/*.parquet'")
    wanted = con.sql(f"SELECT doc_id FROM ({near_dedup_sql(corpus_pipeline.NEAR_PERCENT)}) WHERE kept").fetchall()
    assert ids[3] == {i for i, in wanted}
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/3/*.parquet'")
    wanted = con.sql(f"SELECT doc_id FROM ({ORACLE_SQL['op1_mix_sources']})").fetchall()
    assert ids[5] == {i for i, in wanted}
    assert corpus_pipeline.run(spark, folder).count() == len(ids[5])


def test_pipeline_near_dedup_from_80(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    # All pairs of the stage's own input, without sketches.
    sets = {}
    for r in kept[2].select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(LOWER))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    first = {i: i for i in sets}
    links = []
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        both = len(x & y)
        if both and 100 * both >= 80 * len(x | y):
            links.append((a, b))
    for _ in links:
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    assert ids[3] == {i for i in sets if first[i] == i} and len(ids[3]) < len(sets)
    con = connect(folder)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/3/*.parquet'")
    wanted = con.sql(f"SELECT doc_id FROM ({ORACLE_SQL['op1_mix_sources']})").fetchall()
    assert ids[5] == {i for i, in wanted}
    assert corpus_pipeline.run(spark, folder).count() == len(ids[5])
