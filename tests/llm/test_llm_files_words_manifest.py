"""Token files, spelling variants and the manifest against plain versions."""

import itertools
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatprep.llm import id_coder, merkle, spelling, token_files
from chatprep.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# Token files


@pytest.mark.parametrize("size", [1, 63, 64, 65, 5000, id_coder.BLOCK + 1])
def test_blocks_come_back(size):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.geometric(0.002, size), 49407).astype(np.uint32)
    ids[size // 3 : size // 2] = 7
    ids[-1] = 49407
    blocks = [ids[i : i + id_coder.BLOCK] for i in range(0, size, id_coder.BLOCK)]
    coded = id_coder.encode(blocks, 49408)
    back = id_coder.decode(coded, [len(b) for b in blocks], 49408)
    assert all((a == b).all() for a, b in zip(blocks, back))
    assert size < 5000 or sum(map(len, coded)) < 2 * size
    # A block by itself reads as it does among others.
    assert (id_coder.decode(coded[-1:], [len(blocks[-1])], 49408)[0] == blocks[-1]).all()


def test_repeated_ids_cost_next_to_nothing():
    ids = np.tile(np.arange(50, dtype=np.uint32), 4000)
    assert len(id_coder.encode([ids], 49408)[0]) < len(ids) // 4


def test_blocks_are_modelled_not_packed():
    rng = np.random.default_rng(3)
    alone = np.minimum(rng.geometric(0.02, 400_000), 49407).astype(np.uint32)
    shares = np.bincount(alone) / len(alone)
    entropy = -(shares[shares > 0] * np.log2(shares[shares > 0])).sum()
    assert 8 * len(id_coder.encode([alone], 49408)[0]) < 1.08 * entropy * len(alone)
    # The id that follows two ids is known from before, at one place in four another one comes.
    follows = rng.integers(0, 49408, 4096)
    ids = [5, 6]
    for other in rng.random(200_000) < 0.25:
        ids.append(int(rng.integers(0, 2000)) if other else int(follows[(ids[-1] * 31 + ids[-2]) % 16]))
    coded = id_coder.encode([np.array(ids, np.uint32)], 49408)[0]
    assert 8 * len(coded) < 6.25 * len(ids)


@pytest.mark.parametrize("size, crc", [(1, 1696784233), (700, 3884878262), (200_000, 1898938550), (id_coder.BLOCK, 2554057845)])
def test_blocks_read_the_same_everywhere(size, crc):
    n = np.arange(size, dtype=np.int64)
    ids = (n * n % 997 * (n // 50 % 7) % 49408).astype(np.uint32)
    coded = id_coder.encode([ids], 49408)
    assert zlib.crc32(coded[0]) == crc
    assert (id_coder.decode(coded, [size], 49408)[0] == ids).all()


def _plain_files(rows):
    own, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_odd_texts(spark, tmp_path):
    texts = [
        None, "", " \t\n", "Word, word. WORD! don't it's a,,b x;", "Été naïve ÜBER été ½ 12 3456 日本語 text", "<|endoftext|> a<|startoftext|>b <|x|>",
        "a" * 3000, "long words " * 60_000, "tab\x0bvt\x85nel nbsp em", "…?! 'tis I'll we've (x) [y] {z}", "a\0b c\0",
    ]
    rows = [(i * 7 % 11, t) for i, t in enumerate(texts)] + [(None, "none"), (30, "same"), (30, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("path", F.lit("x")).repartition(3)
    token_files.write(docs, f"{tmp_path}/files", TOKENIZER, end_id=1)
    made = token_files.read(spark, f"{tmp_path}/files", 49408)
    assert sorted(map(tuple, made.collect()), key=lambda r: r[1]) == _plain_files(rows)


def test_token_files_of_many_files(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 50_000)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    token_files.write(docs, f"{tmp_path}/files", TOKENIZER, end_id=1)
    made = token_files.read(spark, f"{tmp_path}/files", 49408)
    assert len(list((tmp_path / "files").glob("part-*"))) > 3
    assert sorted(map(tuple, made.collect()), key=lambda r: r[1]) == _plain_files(map(tuple, docs.collect()))


def test_token_files_of_no_documents(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id bigint, text string"), f"{tmp_path}/files", TOKENIZER, end_id=1)
    assert token_files.read(spark, f"{tmp_path}/files", 49408).count() == 0


def test_words_and_whole_texts_agree():
    own = Tokenizer.from_file(TOKENIZER)
    texts = ["Hello, World! Hello".encode(), None, "x" .encode(), "Hello, x; y <|endoftext|>".encode()]
    a, b = token_files.WordIds(own).encode(texts), token_files.TextIds(own).encode(texts)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_words_that_came_back_are_remembered(monkeypatch):
    own = Tokenizer.from_file(TOKENIZER)
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    made = token_files.WordIds(own)
    texts = [f"often again, Été. {' '.join(f'w{i}x{k} Ab{chr(97 + i)}{chr(97 + k)}! é{chr(97 + k)}' for k in range(20))} often" for i in range(20)]
    got = [made.encode([t.encode()]) for t in texts]
    assert [g[0].tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert b"often" in made.numbers and b"w0x0" not in made.numbers


def test_plain_words_of_any_case():
    own = Tokenizer.from_file(TOKENIZER)
    words = ["a", "I", "Hello", "WORLD", "x" * 400, "tokenisation!", "Mixed;Case", "ab.", "b.,", "é.", "Ab\u0301c", "s", "don't", "a\ufffd", "\u0130x", "\u212aelvin", "ab&&&", "ab,.#", "&&&", "a<|x", "ab|>", "ab'&", "1&&", "ab&1", "x\u0085&&"]
    text = " ".join(words)
    made = token_files.WordIds(own)
    assert made.plain and made.encode([text.encode()])[0].tolist() == own.encode(text, add_special_tokens=False).ids


def test_damage_is_seen():
    ids = np.arange(1000, dtype=np.uint32)
    written = [token_files._index_frame(["1"], [1000]), *token_files._ids_frames([ids], 49408)]
    whole = b"".join(f + b"\n" for f in written)
    assert [len(x) for x in token_files.read_frames(whole, 49408)] == [2, 1000]
    flipped = bytearray(whole)
    flipped[-40] ^= 1
    for bad in (bytes(flipped), whole[:-20], whole[:60] + whole[61:]):
        with pytest.raises(Exception):
            list(token_files.read_frames(bad, 49408))


# Spelling variants


def _distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain_variants(words):
    near = {w: [v for v in words if _distance_one(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


@pytest.mark.parametrize("limits", [(20_000, 4), (40, 1), (3, 2)])
def test_variants_against_all_pairs(spark, monkeypatch, limits):
    monkeypatch.setattr(spelling, "NODE", limits[0])
    monkeypatch.setattr(spelling, "LEAF", limits[1])
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abeé"), rng.integers(1, 6))): int(rng.integers(3, 60)) for _ in range(400)}
    words |= {"x" * 500: 3, "x" * 501: 9, "x" * 250 + "y" + "x" * 249: 30, "": 4}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    made = spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, made)) == _plain_variants(words) and len(made) == len(words)


def test_near_words():
    words = ["".join(p) for n in range(1, 5) for p in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        assert spelling.near(a, b) == _distance_one(a, b), (a, b)


def test_word_counts_of_odd_texts(spark):
    rows = [(1, "Étude étude ÉTUDE hello Hello HELLO hell x"), (2, None), (3, ""), (None, "hello " * 5 + "naïve×÷naïve"), (4, "z" * 2_200_000 + " naïveté" * 3), (4, "hello-hello")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1))
    # Only A-Z are lower-cased.
    assert dict(map(tuple, spelling.word_counts(docs, min_count=1).collect())) == {
        "Étude": 2, "étude": 1, "hello": 10, "naïve×÷naïve": 1, "z" * 2_200_000: 1, "naïveté": 3,
    }
    assert spelling.variants(spelling.word_counts(docs.filter("doc_id = 2"))).count() == 0


def test_planted_misspellings(spark):
    rows = [(i, "alphabet gathering") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = Counter()
    for i, word in itertools.product(range(200), ("alphabet", "gathering")):
        h = zlib.crc32(f"{i}:{word}".encode())
        wanted[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 5 == 0 else word] += 1
    assert dict(map(tuple, spelling.word_counts(docs, misspell=5, min_count=1).collect())) == dict(wanted)


# Manifest


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _plain_manifest(rows):
    """(id, leaf) -> (subroot, root, siblings) by whole lists."""

    def up(nodes):
        proofs = [[] for _ in nodes]
        owners = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [list(range(i, min(i + 2, len(nodes)))) for i in range(0, len(nodes), 2)]
            for run in runs:
                for k in run:
                    for o in owners[k]:
                        proofs[o] += [nodes[j] for j in run if j != k]
            owners = [[o for k in run for o in owners[k]] for run in runs]
            nodes = [_h(*[nodes[k] for k in run]) for run in runs]
        return nodes[0], proofs

    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0]), _h(*map(value, r))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: up([leaf for _, leaf in sorted(groups[g])]) for g in names}
    root, tops = up([made[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        out += [(i, g, leaf, made[g][0], root, "".join(p + top)) for ((_, i), leaf), p in zip(sorted(groups[g]), made[g][1])]
    return out


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_against_whole_lists(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 1 << levels)
    rows = [(i * 37 % 91, f"g{i % 3 * (i % 2)}", "text " * (i % 4)) for i in range(91)]
    rows += [(None, "g0", None), (None, "g0", ""), (5, None, "é" * 1000), (200, "", "x"), (201, "lone", "y"), (7, "g0", "tie"), (7, "g0", "tie")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("witness", F.lit(1)).withColumn("leaf", F.lit(2)).repartition(5)
    made = merkle.folded(merkle.manifest(docs, ["doc_id", "lang", "text"]))
    got = [(r.id, r.grp, r.leaf, r.subroot, r.root, "".join(w.hex() for w in r.witness)) for r in made.collect()]
    assert Counter(got) == Counter(_plain_manifest(rows))
    assert made.filter("NOT folded_root <=> root").count() == 0


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(1, "en", "a")], "doc_id bigint, lang string, text string")
    row = merkle.folded(merkle.manifest(docs, ["doc_id", "text"])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.witness == []
    assert merkle.manifest(docs.limit(0), ["doc_id", "text"]).count() == 0


def test_changed_rows_do_not_lead_to_the_root(spark, small):
    made = QUERIES["op13_merkle_manifest"](spark, small).collect()
    assert {r.verified for r in made} == {r.folded_root == r.root for r in made} == {True, False}
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or docs[r.doc_id] is None) for r in made)
