import random

import pytest
from pyspark.sql import functions as F

from chatprep.functions import tokens as tok
from chatprep.operators import vocab
from chatprep.settings import TOKENS

R, I = [7, 8], [7, 9]


def expected(ids, response, instruction):
    """The rule said plainly: walk along, switching on and off."""
    ends = [i + len(response) for i in range(len(ids)) if ids[i : i + len(response)] == response]
    out = [-100] * len(ids)
    if not instruction:
        ends = ends[-1:]
    for e in ends:
        for i in range(e, len(ids)):
            if instruction and ids[i : i + len(instruction)] == instruction:
                break
            out[i] = ids[i]
    return out


def labels(spark, rows, response, instruction):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, input_ids array<int>")
    made = vocab.add_labels(df, response, instruction).orderBy("i")
    return [list(r["labels"]) for r in made.collect()]


@pytest.mark.parametrize("instruction", [I, None, []])
def test_labels_follow_the_rule(spark, instruction):
    rng = random.Random(3)
    rows = [[rng.choice([7, 8, 9, 1, 2]) for _ in range(rng.randrange(0, 14))] for _ in range(200)]
    rows += [[], [7, 8], [7, 8, 7, 9], [7, 9, 1, 7, 8, 2, 7, 9], [7, 8, 7, 8, 1]]
    assert labels(spark, rows, R, instruction) == [expected(r, R, instruction) for r in rows]


def test_overlapping_template(spark):
    assert labels(spark, [[5, 5, 5, 1]], [5, 5], None) == [expected([5, 5, 5, 1], [5, 5], None)]


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\n\nc ",), ("",), (" ",), (None,)], "t string")
    got = [r[0] for r in df.select(tok.words(F.col("t"))).collect()]
    assert got == [["a", "b", "c"], [], [], None]


def test_tokenise_sets_specials_apart(spark):
    df = spark.createDataFrame([("<start_of_turn>### User:\n<img>Q\n\n<end_of_turn><eos>",)], "t string")
    assert df.select(tok.tokenise(F.col("t"), TOKENS)).first()[0] == [
        "<bos>", "<start_of_turn>", "###", "User:", "<img>", "Q", "<end_of_turn>", "<eos>",
    ]


def corpus(spark):
    rows = [(1, ["<bos>", "b", "a", "a", "c"]), (2, ["b", "a"]), (3, []), (4, ["c", "b", "z"])]
    return spark.createDataFrame(rows, "row_id bigint, tokens array<string>")


def test_vocabulary_order(spark):
    made = vocab.build_vocab(corpus(spark), ["<unk>", "<bos>"]).orderBy("id").collect()
    assert [(r["token"], r["n"], r["id"]) for r in made] == [
        ("<unk>", 0, 0), ("<bos>", 1, 1), ("a", 3, 2), ("b", 3, 3), ("c", 2, 4), ("z", 1, 5),
    ]


@pytest.mark.parametrize("common", [1_000_000, 3, 0])
def test_encoding_with_small_and_large_vocabulary(spark, monkeypatch, common):
    """Tokens that are not broadcast come back by the join, same ids."""
    words = vocab.build_vocab(corpus(spark), ["<unk>", "<bos>"])
    monkeypatch.setattr(vocab, "COMMON_TOKENS", common)
    monkeypatch.setattr(vocab, "TOP_TOKENS", min(common, 1))
    extra = spark.createDataFrame([(9, ["new", "a", "new"], "kept")], "row_id bigint, tokens array<string>, note string")
    rows = corpus(spark).unionByName(extra, allowMissingColumns=True)
    got = {r["row_id"]: (r["input_ids"], r["note"]) for r in vocab.encode(rows, words).collect()}
    assert got == {
        1: ([1, 3, 2, 2, 4], None), 2: ([3, 2], None), 3: ([], None), 4: ([4, 3, 5], None), 9: ([0, 2, 0], "kept"),
    }


def test_check_counts_failures(spark):
    rows = [([1, 7, 8, 2],), ([7, 8, 7, 9],), ([1],)]
    df = spark.createDataFrame(rows, "input_ids array<int>")
    r = vocab.check(df, R, I, 1, 2).first()
    assert (r["n_rows"], r["missing_response"], r["missing_instruction"], r["missing_bos"], r["missing_eos"]) == (3, 1, 2, 1, 2)
    assert "missing_instruction" not in vocab.check(df, R, None, None, 2).columns


def test_missing_template_token_is_an_error(spark):
    words = vocab.build_vocab(corpus(spark), ["<unk>"])
    with pytest.raises(ValueError, match="nowhere"):
        vocab.template_ids(words, ["a", "nowhere"])


@pytest.mark.parametrize("common", [1_000_000, 3, 0])
def test_texts_of_tokens_encode_as_lists_do(spark, monkeypatch, common):
    rows = corpus(spark).unionByName(spark.createDataFrame([(5, None), (6, ["new", "b", "new"]), (None, ["a"])], "row_id bigint, tokens array<string>"))
    joined = rows.withColumn("tokens", F.array_join("tokens", " "))
    words = vocab.build_vocab(corpus(spark), ["<unk>", "<bos>"])
    assert vocab.build_vocab(corpus(spark).withColumn("tokens", F.array_join("tokens", " ")), ["<unk>", "<bos>"]).collect() == words.collect()
    monkeypatch.setattr(vocab, "COMMON_TOKENS", common)
    monkeypatch.setattr(vocab, "TOP_TOKENS", min(common, 1))
    made = [sorted(map(tuple, vocab.encode(t, words).collect()), key=str) for t in (rows, joined)]
    assert made[0] == made[1] == sorted(
        [(1, [1, 3, 2, 2, 4]), (2, [3, 2]), (3, []), (4, [4, 3, 5]), (5, []), (6, [0, 3, 0]), (None, None)], key=str
    )


def test_a_row_of_rare_tokens(spark, monkeypatch):
    """Each gap is filled by its number, not by a search among all gaps of its row."""
    monkeypatch.setattr(vocab, "COMMON_TOKENS", 0)
    monkeypatch.setattr(vocab, "TOP_TOKENS", 0)
    tokens = [f"t{i:06}" for i in range(300_000)]
    rows = spark.createDataFrame([(1, tokens[::-1]), (2, ["t000007", "none"])], "row_id bigint, tokens array<string>")
    words = vocab.build_vocab(rows.filter("row_id = 1"), ["<unk>"])
    got = dict(map(tuple, vocab.encode(rows, words).collect()))
    assert got[1] == list(range(300_000, 0, -1)) and got[2] == [8, 0]


@pytest.mark.parametrize("common", [1_000_000, 0])
def test_rows_known_by_texts_and_numbers(spark, monkeypatch, common):
    """Sorted by the number first, though it is named last; columns stay where they were."""
    monkeypatch.setattr(vocab, "COMMON_TOKENS", common)
    monkeypatch.setattr(vocab, "TOP_TOKENS", 0)
    data = [("s", 1, ["a", None, "x"], 7), ("s", 2, ["b"], 8), ("t", 1, ["x", "b", "a"], 9), (None, 1, ["a"], 10)]
    rows = spark.createDataFrame(data, "source string, row_id bigint, tokens array<string>, note int")
    words = vocab.build_vocab(rows.filter("row_id = 2 OR source = 't'"), ["<bos>"])
    made = vocab.encode(rows.filter("source = 's' OR source IS NULL").unionByName(rows.filter("source = 't'")), words.filter("token <> 'x'"), ["source", "row_id"])
    assert made.columns == ["source", "row_id", "note", "input_ids"]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(
        [("s", 1, 7, [2, None, None]), ("s", 2, 8, [1]), ("t", 1, 9, [None, 1, 2]), (None, 1, 10, None)], key=str
    )
    sorts = [line for line in made._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortMergeJoin" in line and "row_id" in line]
    assert sorts and all(line.index("row_id") < line.index("source") for line in sorts)


def test_no_text_moves_with_the_rows(spark):
    words = vocab.build_vocab(corpus(spark), ["<unk>", "<bos>"])
    plan = vocab.encode(corpus(spark), words)._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line or "Repartition" in line]
    assert joined and not any("tokens" in line for line in joined)
    assert "posexplode_outer" not in plan


def test_checks_of_texts_and_lists_agree(spark):
    rows = [["<bos>", "###", "A:", "x", "<eos>"], ["###", "x", "A:"], ["x###", "A:"], ["###", "A:x"], ["A:", "###", "A:"], [], None]
    df = spark.createDataFrame([(r,) for r in rows], "tokens array<string>")
    joined = df.select(F.array_join("tokens", " ").alias("tokens"))
    for response, instruction in ((["###", "A:"], ["x"]), (["### A:"], [""])):
        made = [vocab.check(t, response, instruction, "<bos>", "<eos>", "tokens").first() for t in (df, joined)]
        assert made[0] == made[1], made


def test_words_at_any_white_space(spark):
    texts = ["a \x0b\x0c\r\n\t b", "\r\n", "x", "\u00a0a\u2003b\u0085 c", " .*  [a] ", "\t\tq"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tok.words(F.col("t"))).collect()]
    assert got == [["a", "b"], [], ["x"], ["\u00a0a\u2003b\u0085", "c"], [".*", "[a]"], ["q"]]
    assert "\\s" not in df.select(tok.words(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
