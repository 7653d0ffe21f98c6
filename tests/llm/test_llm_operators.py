"""Each operator against brute force on small inputs."""

import itertools
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from chatprep.llm import decontamination, language, letters, mixing, near_dedup, quality, secrets, token_counts, url_filter
from chatprep.llm.components import components
from chatprep.llm.hashing import word_hashes
from chatprep.llm.sketch import sketches
from chatprep.llm.tiling import tiles


def test_word_hashes_follow_words():
    texts = [b"Alpha beta\x0balpha", None, b"", b"  beta\tALPHA ", "é été".encode(), b"x" * 3_000_000 + b" y"]
    hashes, bounds = word_hashes(texts)
    words = [(t or b"").lower().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    known = {}
    for h, w in zip(hashes.tolist(), itertools.chain(*words)):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for size in (1, 3, 50, 2000):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = a.copy()
        b[: size // 4] = rng.integers(0, 2**63, size // 4).astype(np.uint64)
        made = sketches(np.concatenate((a, b)), np.repeat([0, 1], size), 2, 512)
        assert (made != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        both = len(np.intersect1d(a, b))
        assert abs((made[0] == made[1]).mean() - both / (2 * size - both)) < 0.1


def _brute_groups(texts, percent):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in ((i, t.lower().split()) for i, t in texts)}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_match_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for base in range(3):
        origin = [word() for _ in range(rng.choice([12, 80, 150]))]
        for _ in range(14):
            copy = [word() if rng.random() < rng.choice([0, 0.003, 0.01, 0.03]) else w for w in origin]
            texts.append((len(texts), " ".join(copy)))
    texts += [(len(texts) + i, " ".join(word() for _ in range(rng.randrange(0, 9)))) for i in range(20)]
    wanted = _brute_groups(texts, near_dedup.PERCENT)
    got = near_dedup.groups(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == wanted
    assert len({v for v in wanted.values()}) < len(texts)


def test_near_copies_of_the_pipeline_match_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        origin = [f"w{rng.randrange(4000)}" for _ in range(100)]
        texts.append((len(texts), " ".join(origin)))
        for k in (1, 2, 3):  # similarity of about 0.9, 0.82, 0.74
            places = rng.sample(range(4, 96, 12), k)
            texts.append((len(texts), " ".join("new" + w if i in places else w for i, w in enumerate(origin))))
    wanted = {i for i, first in _brute_groups(texts, 80).items() if i == first}
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == wanted
    at_85 = {i for i, first in _brute_groups(texts, 85).items() if i == first}
    assert wanted < at_85
    assert {r.doc_id for r in near_dedup.groups(docs).filter("kept").collect()} == at_85


def test_near_plan_has_no_product(spark, small):
    df = near_dedup.groups(spark.read.parquet(f"{small}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def _brute_tiles(a, b, least):
    in_a, in_b, made = [False] * len(a), [False] * len(b), []
    while True:
        best = []
        for j, i in itertools.product(range(len(b)), range(len(a))):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not in_a[i + n] and not in_b[j + n]:
                n += 1
            if n >= least:
                best.append((-n, j, i))
        if not best:
            return made
        longest = min(best)[0]
        for n, j, i in sorted(best):
            if n == longest and not any(in_a[i : i - n]) and not any(in_b[j : j - n]):
                in_a[i : i - n] = in_b[j : j - n] = [True] * -n
                made.append((i, j, -n))


def test_tiles_match_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        size = rng.choice([2, 4, 30])
        a = [rng.randrange(1, size) for _ in range(rng.randrange(0, 60))]
        b = [rng.randrange(1, size) for _ in range(rng.randrange(1, 40))]
        if a and rng.random() < 0.6:
            cut = rng.randrange(len(b))
            a += b[cut:] + [99] + b[:cut]
        got = tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert got == _brute_tiles(a, b, 3)


def test_contaminated_matches_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randrange(5, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = [f"t{rng.randrange(300)}" for _ in range(rng.randrange(0, 80))]
        if d % 2:
            w = rng.choice(items)[1].split()
            cut = rng.randrange(len(w))
            words[3:3] = w[cut:] + ["Filler,"] + w[: rng.randrange(cut + 1)]
        docs.append((d, " ".join(words)))
    wanted = {}
    for (d, t), (i, p) in itertools.product(docs, items):
        a, b = t.lower().replace(",", "").split(), p.split()
        covered = sum(n for _, _, n in _brute_tiles(a, b, decontamination.LEAST))
        if covered >= decontamination.COVERAGE * len(b):
            wanted[(d, i)] = covered
    found = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    assert {(r.doc_id, r.item_id): r.covered_words for r in found} == wanted and len(wanted) > 10


def test_long_quotes_contaminate_whatever_the_item(spark):
    items = [(i, [f"t{i}x{k}" for k in range(n)]) for i, n in enumerate((59, 200, 200, 200))]
    quote = lambda i, a, b: " ".join(["before", *items[i][1][a:b], "after"])
    scattered = " ".join(quote(2, a, a + 12) for a in (0, 40, 80))
    texts = [quote(0, 10, 39), quote(1, 100, 190), scattered, quote(3, 5, 24), quote(3, 5, 25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    found = decontamination.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.covered_words) for r in found} == {(0, 0, 29), (1, 1, 90), (4, 3, 20)}
    assert sorted(r.doc_id for r in decontamination.clean(docs, benchmark).collect()) == [2, 3]


def test_blocks_cover_all_items(spark):
    items = spark.createDataFrame([(i, f"item number {i} has several words") for i in range(50)], "item_id bigint, text string")
    made = list(decontamination.blocks(items, block_bytes=200))
    assert len(made) > 5 and sorted(i for b in made for i in b.ids) == list(range(50))


def test_blocks_go_before_the_next_is_drawn(spark, monkeypatch):
    import gc
    import weakref

    items = [(i, " ".join(f"b{i}x{k}" for k in range(12))) for i in range(24)]
    texts = [(d, items[d][1] if d % 3 == 0 else f"free text number {d} of this table") for d in range(24)] + [(0, items[0][1]), (99, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    alive, most, drawn = [], [], decontamination.blocks

    def watched(*args):
        made = drawn(*args)
        while True:
            gc.collect()
            most.append(sum(ref() is not None for ref in alive))
            held = [block for block in [next(made, None)] if block]
            if not held:
                return
            alive.append(weakref.ref(held[0]))
            yield held.pop()

    monkeypatch.setattr(decontamination, "blocks", watched)
    bad = sorted((d, d) for d in (*range(0, 24, 3), 0))
    found = decontamination.contaminated(docs, benchmark, block_bytes=300)
    assert len(alive) > 5 and max(most) == 0
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == bad
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    alive.clear(), most.clear()
    kept = decontamination.clean(docs, benchmark, block_bytes=300)
    assert len(alive) > 5 and max(most) == 0
    assert sorted(r.doc_id for r in kept.collect()) == [d for d in range(24) if d % 3] + [99]
    assert "MapInArrow" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_quality_counts_match_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("text").collect()
    texts = [r.text for r in rows] + ["a b c a b c", "#x\n\n#x\n y", "", "É É É É"]
    got = quality.counts([t.encode() for t in texts])
    for k, t in enumerate(texts):
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        in_repeat = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\r\n\x0b\x0c")]
        assert got["n_words"][k] == len(w) and got["word_chars"][k] == sum(map(len, w))
        assert got["n_symbols"][k] == sum(c in "#*$%&|<>" for c in t)
        assert got["n_dup_lines"][k] == len(lines) - len(set(lines)) and got["n_repeat_words"][k] == len(in_repeat)


def test_isolation_scores_follow_paths():
    rng = np.random.default_rng(0)
    rows = np.concatenate((rng.normal(0, 1, (2000, 3)), [[9, 9, 9]]))
    forest = quality.Forest.fit(rows)
    score = forest.scores(rows)
    assert score[-1] > np.quantile(score[:-1], 0.999)
    # One row walked by hand.
    total = 0.0
    for t in range(len(forest.feature)):
        at = 0
        while forest.feature[t, at] >= 0:
            at = 2 * at + 1 + int(rows[0, forest.feature[t, at]] > forest.split[t, at])
        total += forest.path[t, at]
    assert score[0] == pytest.approx(2 ** (-total / len(forest.feature) / forest.norm))


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_key", lambda host, path: 7)
    path = tmp_path / "rules.bin"
    path.write_bytes(url_filter.DigestArray.packed([url_filter.Rule("a.org", "/"), url_filter.Rule("b.org", "/x", True), url_filter.Rule("org", "/")]))
    array = url_filter.DigestArray(str(path))
    found = array.probe([(b"w.a.org", b"/q"), (b"b.org", b"/xy"), (b"b.org", b"/y"), (b"c.net", b"/x")])
    assert [array.rule(i) if i >= 0 else None for i in found] == [(b"a.org", b"/"), (b"b.org", b"/x"), (b"org", b"/"), None]


def test_near_copies_lose_no_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id bigint, source string, text string"
    rows = [(1, "b", long), (1, "a", long), (1, "a", long), (2, "a", long + " z"), (None, "c", long),
            (3, "a", None), (3, "b", None), (3, "b", None), (4, "a", " \n"), (5, "a", "one"), (5, "a", "one"), (None, "a", "two"), (None, "b", "two")]
    kept = near_dedup.kept_documents(spark.createDataFrame(rows, schema), percent=80).collect()
    got = Counter((r.doc_id, r.text) for r in kept)
    # One of the five copies, whichever of the rows with the smallest id; all rows without words.
    assert got == {(1, long): 1, (3, None): 3, (4, " \n"): 1, (5, "one"): 1, (None, "two"): 1}
    assert Counter(r.source for r in kept if r.doc_id == 3) == {"a": 1, "b": 2}


def test_near_sets_hold_a_node_once(spark, monkeypatch):
    stored = {}
    own = near_dedup.scratch
    monkeypatch.setattr(near_dedup, "scratch", lambda df, label: stored.setdefault(label, own(df, label)))
    long = [f"w{i}" for i in range(60)]
    rows = [(k % 2 if k < 300 else None, " ".join([*long, "z" * (k % 2)])) for k in range(400)]
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 400 and {r.component_id for r in got} == {0}
    assert stored["near-sets"].count() == 2


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "x y"), (2, "a", "en", "z"), (3, "b", None, "q q q")], "doc_id bigint, source string, lang string, text string")
    rollup = token_counts.Rollup(spark, str(tmp_path))
    words = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().filter("tokenizer = 'words-1'").collect()}
    for _ in range(2):
        rollup.commit(1, token_counts.changes(docs, "insert"))
    assert words() == {("a", "en"): (2, 3), ("b", None): (1, 3)}
    moved = docs.filter("doc_id = 2").replace("a", "b", ["source"]).replace("z", "z z z z", ["text"])
    rollup.commit(2, token_counts.changes(moved, "revise"))
    assert words() == {("a", "en"): (1, 2), ("b", "en"): (1, 4), ("b", None): (1, 3)}
    for _ in range(2):
        rollup.commit(3, token_counts.changes(docs.filter("doc_id = 3"), "delete"))
    assert words() == {("a", "en"): (1, 2), ("b", "en"): (1, 4)}


def test_last_change_of_a_batch_counts(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path))
    feed = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, operation string, at int"
    rows = lambda *made: spark.createDataFrame([(i, "a", "en", "t", n, op, at) for i, n, op, at in made], feed)
    total = lambda: [(r.docs, r.tokens) for r in rollup.totals().collect()]
    rollup.commit(1, rows((1, 3, "insert", 0), (1, 3, "insert", 0)))
    assert total() == [(1, 3)]
    # Inserted and deleted in one batch, in that order and in the other; a delete without order.
    rollup.commit(2, rows((2, 5, "insert", 1), (2, 0, "delete", 2), (3, 0, "delete", 1), (3, 7, "insert", 2)), "at")
    assert total() == [(2, 10)]
    rollup.commit(2, rows((4, 5, "insert", 1), (4, 0, "delete", 0)))
    assert total() == [(1, 3)]
    rollup.commit(2, rows((1, 8, "revise", 1), (1, 9, "revise", 0)), "at")
    assert total() == [(1, 8)]
    # An empty feed clears an earlier commit of the same batch; what is older stays.
    rollup.commit(2, rows().limit(0))
    assert total() == [(1, 3)]
    with pytest.raises(ValueError):
        rollup.commit(1, rows((9, 1, "insert", 0)))
    assert total() == [(1, 3)]


def test_batch_that_stopped_half_way_does_not_count(spark, tmp_path, monkeypatch):
    rollup = token_counts.Rollup(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "a", "en", "x y"), (None, "a", None, None)], "doc_id bigint, source string, lang string, text string")
    rollup.commit(1, token_counts.changes(docs, "insert"))
    before = sorted(map(str, rollup.totals().collect()))
    put = rollup._put
    for stopped_at in ("rollup", "commits"):
        def some(rows, name, batch, stopped_at=stopped_at):
            if name == stopped_at:
                raise RuntimeError
            put(rows, name, batch)

        monkeypatch.setattr(rollup, "_put", some)
        with pytest.raises(RuntimeError):
            rollup.commit(2, token_counts.changes(docs, "delete"))
        assert sorted(map(str, rollup.totals().collect())) == before
    monkeypatch.setattr(rollup, "_put", put)
    rollup.commit(3, token_counts.changes(docs, "delete"))
    assert rollup.totals().count() == 0


def test_counts_by_tokenizer_file(spark, small):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    got = {r.doc_id: r.tokens for r in token_counts.file_counts(docs, "doc_id", "text", path, "bpe").collect()}
    for r in docs.collect():
        ids = own.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == len(ids) and own.decode(ids) == r.text


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path))
    first = spark.createDataFrame([("a", 1, 'é token = "abcdef12"'), ("b", 1, 'é token = "abcdef12"'), ("c", 1, "nothing")], "path string, version int, text string")
    ledger.scan(first)
    ledger.scan(first)
    assert ledger.rows(secrets.RULE_VERSION).count() == 2
    second = first.union(spark.createDataFrame([("a", 2, "AKIA" + "Z" * 16)], first.schema))
    ledger.scan(second)
    assert ledger.rows(secrets.RULE_VERSION).count() == 3
    got = {(r.path, r.version): [(f.kind, f.start, f.end) for f in r.found] for r in ledger.found_in(second).collect()}
    assert got == {("a", 1): [("assign", 2, 19)], ("b", 1): [("assign", 2, 19)], ("c", 1): [], ("a", 2): [("access", 0, 20)]}
    # Other rules have seen nothing yet, and what they find stays apart from what these find.
    fewer = secrets.RULES[:1]
    assert ledger.found_in(second, rules=fewer).filter("found IS NULL").count() == len(got)
    ledger.scan(second, rules=fewer)
    assert ledger.rows(secrets.version_of(fewer)).count() == 3
    kinds = lambda rules: sorted(f.kind for r in ledger.found_in(second, rules=rules).collect() for f in r.found)
    assert kinds(fewer) == ["assign", "assign"] and kinds(secrets.RULES) == ["access", "assign", "assign"]
    # A column of the findings' name is written over.
    again = ledger.found_in(second.withColumn("found", F.lit(1)))
    assert again.columns == ["path", "version", "found"] and again.filter("size(found) = 1").count() == 3


def test_ledger_of_no_texts_and_of_many_secrets(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path))
    schema = "path string, text string"
    ledger.scan(spark.createDataFrame([], schema))
    assert ledger.rows(secrets.RULE_VERSION).count() == 0
    many = "".join(f"token={i:06d} " for i in range(500))
    rows = spark.createDataFrame([("a", many), ("a", many), (None, None), ("b", "")], schema)
    ledger.scan(rows)
    got = [(r.path, len(r.found), r.found[-1].end if r.found else None) for r in ledger.found_in(rows).collect()]
    assert sorted(got, key=str) == [("a", 500, len(many) - 1)] * 2 + [("b", 0, None), (None, 0, None)]


def test_raking_meets_its_marginals(spark):
    rng = random.Random(2)
    rows = [(s, l, t, rng.randrange(200, 900)) for s in "abcd" for l in ("en", "fr", None) for t in "pq" for _ in range(20)]
    wanted = {"source": {"a": 4, "b": 2, "c": 2, "d": 2}, "lang": {"en": 2, "fr": 1}}
    cells = mixing.raked(spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens bigint"), wanted, 0.3, 24).collect()
    total = defaultdict(float)
    for c in cells:
        assert 0 <= c.probability <= 1
        for name in ("source", "lang"):
            total[(name, c[name])] += c.weight
    all_tokens = 0.3 * sum(r[3] for r in rows)
    assert sum(c.weight for c in cells) == pytest.approx(all_tokens, rel=1e-3)
    assert total[("source", "a")] == pytest.approx(0.4 * all_tokens, rel=1e-3)
    assert total[("lang", "en")] == pytest.approx(all_tokens * 2 / 3, rel=1e-3) and total[("lang", None)] == 0


def test_raking_meets_every_feasible_marginal_of_the_given_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select("source", "lang", mixing.topic_of(docs.text).alias("topic"), mixing.token_count(docs.text).alias("n_tokens"))
    cells = mixing.raked(rows)
    made = mixing.marginals(cells).collect()
    assert max(r.residual for r in made) < 1e-3
    # What cannot be given is shown, and the rest of its dimension makes up for it.
    short = {r["value"] for r in made if r.target < r.asked * (1 - 1e-9)}
    assert short and all(r.target == r.own for r in made if r["value"] in short)
    total = 0.5 * sum(c.tokens for c in cells.collect())
    for name in mixing.DIMENSIONS:
        assert sum(r.target for r in made if r.dimension == name) == pytest.approx(total)


def test_raking_reports_targets_that_contradict_each_other(spark):
    # All of a is in en, so half of the tokens from a cannot go with a tenth in en.
    rows = [("a", "en", "t", 50), ("b", "fr", "t", 50), ("b", "en", "t", 50)]
    wanted = {"source": {"a": 1, "b": 1}, "lang": {"en": 1, "fr": 9}}
    counted = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens bigint")
    cells = mixing.raked(counted, wanted, 0.3, rounds=8)
    assert max(r.residual for r in mixing.marginals(cells, wanted, 0.3).collect()) > 0.1
    assert all(0 <= c.probability <= 1 for c in cells.collect())


def test_mixing_runs_on_its_own_output(spark):
    rows = [(i, "s", "en", "one two three") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    again = mixing.sampled(mixing.sampled(docs))
    assert again.columns == [*docs.columns, "mix_topic", "mix_tokens", "mix_probability"] and again.count() <= 20


def plain_grams(text, n):
    """Every n-gram of a text, what is not a letter being one blank after a letter."""
    text = text.lower() + "\0"
    kept = [c if c.isalpha() else " " for i, c in enumerate(text) if c.isalpha() or (i and text[i - 1].isalpha())]
    return Counter("".join(kept[i : i + n]) for i in range(len(kept) - n + 1))


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 7, 64, 1 << 20])
def test_language_grams_come_once_wherever_a_text_is_cut(piece, monkeypatch):
    monkeypatch.setattr(letters, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice("abÀé .,\n1") for _ in range(rng.randrange(0, 90))) for _ in range(12)] + ["", "x", "日本語テキスト"]
    got = [Counter() for _ in texts]
    for hashes, owner in language._grams(texts):
        for h, t in zip(hashes.tolist(), owner.tolist()):
            got[t][h] += 1
    for text, counts in zip(texts, got):
        want = sum((plain_grams(text, n) for n in language.GRAMS), Counter())
        assert sorted(counts.values()) == sorted(want.values())


def test_language_of_bytes_that_are_no_text(spark):
    rows = [(i, f"the cat sat on the mat and the dog number {i}", "en") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = language.train(docs)
    broken = docs.withColumn("text", F.expr("CAST(concat(unhex('FFFE'), CAST(text AS binary)) AS string)"))
    assert [r.lang_pred for r in language.predicted(broken, filters).collect()] == ["en"] * 9
