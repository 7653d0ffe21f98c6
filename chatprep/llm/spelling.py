"""Spelling variants: words one letter apart, and the common form of each.

Letters fall into ``GROUPS`` groups. A word's *vector* counts its letters in each, and a
trie arranges words by those counts, one group after the other. Two words that differ by
one inserted, deleted or replaced letter have vectors with at most one surplus and one
deficit of one each, so a depth-first search that may spend both once meets all of them;
words of the leaves it reaches are compared letter by letter.

The upper levels of the trie are spread over Spark: a node of depth ``d`` is one group, and
a word visits the nodes that its own vector leads to, with or without spending. ``d`` is
the smallest depth, up to ``DEPTH``, at which no node holds more than ``NODE`` words; a node
that is still larger is split, and so is a crowd of visitors, with every part of the one
meeting every part of the other. Below, each task searches its node as a trie in memory.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.hashing import mix, slices
from chatprep.sources.stages import scratch

#: Groups of letters: a letter belongs to group ``code point % GROUPS``.
GROUPS = 32
#: The order of the groups in a trie: those of common letters tell words apart best.
_COMMON = "eaionrtsludmchpgbvfkqwzyxj"
ORDER = list(dict.fromkeys([*(ord(c) % GROUPS for c in _COMMON), *range(GROUPS)]))
#: Groups whose counts may tell nodes of the spread part of the trie apart.
DEPTH = 8
#: Words of a node, and of a crowd of visitors, that one task holds.
NODE = 20_000
#: Words that a leaf of the trie in memory holds.
LEAF = 4
#: Words a counting task holds before it passes on what it has counted.
HELD = 200_000
PIECE = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Letters a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_NO_RUN = re.compile(rb"[^a-z\x80-\xff]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text that end where no run goes on."""
    begin = 0
    while begin < len(text):
        found = _NO_RUN.search(text, begin + PIECE) if begin + PIECE < len(text) else None
        end = found.start() if found else len(text)
        yield text[begin:end]
        begin = end


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", misspell: int = 0,
                min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``(word, n)``: runs of letters, A-Z lower-cased, of at least ``min_length`` letters and
    ``min_count`` occurrences in all rows.

    With ``misspell`` k, a run loses one letter where the crc32 of ``<id>:<run>`` is a
    multiple of k, at the letter that the crc32 points to; tests use it to plant variants.
    Null texts have no words, a null id counts as an empty one, repeated rows count each.
    Texts are cut into pieces between runs, so long ones cost no more memory; a task holds
    a bounded number of words and passes sums on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def counted():
            names = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for part, values in slices(batches, "text"):
            for name, text in zip(part.column("id").to_pylist(), values):
                start = zlib.crc32(f"{name or ''}:".encode())
                for piece in _pieces((text or b"").translate(_LOWER)):
                    for word, n in Counter(_RUN.findall(piece)).items():
                        if len(word) < min_length:
                            continue
                        if misspell:
                            h = zlib.crc32(word, start)
                            if h % misspell == 0:
                                letters = word.decode()
                                at = h % len(letters)
                                word = (letters[:at] + letters[at + 1 :]).encode()
                        if len(word) < min_length or len(word) < 2 * min_length and len(word.decode()) < min_length:
                            continue
                        if word not in held:
                            size += 100 + len(word)
                        held[word] += n
                    if size > 150 * HELD:
                        yield counted()
                        held.clear()
                        size = 0
        if held:
            yield counted()

    narrow = docs.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{text_column}`").cast("binary").alias("text"))
    made = narrow.mapInArrow(run, "word string, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def vectors(words: list[str]) -> np.ndarray:
    """Letters of each word in each group, common groups first."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) % GROUPS
    at = np.repeat(np.arange(len(words)), lengths) * GROUPS + codes
    return np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)[:, ORDER]


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    gap = len(b) - len(a)
    if gap > 1 or a == b:
        return False
    half = len(a) // 2
    if a[:half] != b[:half] and a[half:] != b[half + gap :]:
        return False
    low, high = 0, len(a)  # the first letter that differs, by halving
    while low < high:
        middle = (low + high) // 2
        if a[low : middle + 1] == b[low : middle + 1]:
            low = middle + 1
        else:
            high = middle
    return a[low + 1 - gap :] == b[low + 1 :]


def _node_keys(counts: np.ndarray) -> np.ndarray:
    """64-bit keys of trie nodes given by their leading counts; two nodes with one key share
    a task, which changes no result."""
    key = np.zeros(len(counts), np.uint64)
    for column in counts.T:
        key = mix(key * np.uint64(31) + column.astype(np.uint64), 7)
    return key.view(np.int64)


def _moves(depth: int) -> np.ndarray:
    """What a search may have spent in the first ``depth`` groups, surplus first."""
    made = [np.zeros(depth, np.int32)]
    for i in range(depth):
        up = np.zeros(depth, np.int32)
        up[i] = 1
        made.append(up)
        for j in range(i + 1, depth):
            both = up.copy()
            both[j] = -1
            made.append(both)
    return np.array(made).reshape(len(made), depth)


class Trie:
    """Words by their counts; a node of few words is a leaf."""

    def __init__(self, words: list[str], counts: list[tuple], group: int = 0):
        self.words, self.counts, self.below = words, counts, None
        if len(words) > LEAF and group < GROUPS:
            split: dict[int, list[int]] = {}
            for i, c in enumerate(counts):
                split.setdefault(c[group], []).append(i)
            self.below = {k: Trie([words[i] for i in at], [counts[i] for i in at], group + 1) for k, at in split.items()}

    def search(self, crowd: list[tuple[tuple, str, int]]) -> Iterator[tuple[int, str]]:
        """``(number, word)`` for each of the ``crowd`` of ``(counts, word, number)``, sorted,
        and each word near it that comes after it by counts and letters."""
        # Below a node: a part of the crowd that has agreed so far, and what it has spent:
        # 0 nothing, 1 a surplus, 2 a surplus and a deficit.
        todo = [(self, 0, 0, len(crowd), 0)]
        while todo:
            node, group, low, high, spent = todo.pop()
            if node.below is None:
                for counts, word, number in crowd[low:high]:
                    # One change leaves the first or the last half as it is; the later word is
                    # as long or one longer.
                    half, longest = len(word) // 2, len(word) + 1
                    head, tail = word[:half], word[half:]
                    for other, theirs in zip(node.words, node.counts):
                        if (other.startswith(head) or other.endswith(tail)) and len(other) <= longest:
                            if (counts < theirs or counts == theirs and word < other) and near(word, other):
                                yield number, other
                continue
            while low < high:
                count = crowd[low][0][group]
                end = low + 1
                while end < high and crowd[end][0][group] == count:
                    end += 1
                steps = ((0, spent),) if spent == 2 else ((0, 1), (-1, 2)) if spent else ((0, 0), (1, 1))
                for step, then in steps:
                    child = node.below.get(count + step)
                    if child is not None:
                        todo.append((child, group + 1, low, end, then))
                low = end


def _search_node(key, homes: pa.Table, visitors: pa.Table) -> pa.Table:
    made: list[tuple] = []
    if homes.num_rows and visitors.num_rows:
        words, n = homes.column("word").to_pylist(), homes.column("n").to_pylist()
        trie = Trie(words, list(map(tuple, vectors(words).tolist())))
        of = dict(zip(words, n))
        guests, m = visitors.column("word").to_pylist(), visitors.column("n").to_pylist()
        crowd = sorted(zip(map(tuple, vectors(guests).tolist()), guests, range(len(guests))))
        made = [(guests[i], m[i], other, of[other]) for i, other in trie.search(crowd)]
    a, n_a, b, n_b = zip(*made) if made else ((), (), (), ())
    return pa.table({"a": pa.array(a, pa.string()), "n_a": pa.array(n_a, pa.int64()),
                     "b": pa.array(b, pa.string()), "n_b": pa.array(n_b, pa.int64())})


def _depth(vocabulary: DataFrame) -> int:
    """The smallest depth at which no node holds more than ``NODE`` words, or ``DEPTH``."""
    groups = [f"g{i}" for i in range(DEPTH)]
    leaves = vocabulary.select([F.col("counts")[i].alias(g) for i, g in enumerate(groups)]).groupBy(groups).agg(F.count(F.lit(1)).alias("held"))
    nodes = leaves.rollup(*groups).agg(F.sum("held").alias("held"), F.grouping_id().alias("level"))
    largest = {r.level: r.held for r in nodes.groupBy("level").agg(F.max("held").alias("held")).collect()}
    # The grouping number of depth d has a bit for each of the groups that are left out.
    return next((d for d in range(DEPTH) if (largest.get((1 << DEPTH - d) - 1) or 0) <= NODE), DEPTH)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``(a, n_a, b, n_b)``: all pairs of the distinct words ``(word, n)`` that are one letter
    apart, each pair once. Words are any strings; an empty vocabulary has no pairs."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = vectors(batch.column("word").to_pylist())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(made.reshape(-1)), GROUPS).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), lists], names=["word", "n", "counts"])

    known = scratch(vocabulary.select("word", "n").mapInArrow(counts, "word string, n bigint, counts array<int>"), "spelling-vectors")
    depth = _depth(known)
    moves = _moves(depth)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _node_keys(np.array(batch.column("counts").to_pylist(), np.int32).reshape(-1, GROUPS)[:, :depth])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(keys)], names=["word", "n", "node"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column("counts").to_pylist(), np.int32).reshape(-1, GROUPS)[:, :depth]
            for move in moves:
                reached = own + move
                there = np.flatnonzero((reached >= 0).all(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word").take(pa.array(there)), batch.column("n").take(pa.array(there)), pa.array(_node_keys(reached[there]))],
                    names=["word", "n", "node"],
                )

    schema = "word string, n bigint, node bigint"
    at_home = scratch(known.mapInArrow(homes, schema), "spelling-homes")
    held = at_home.groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    visiting = scratch(known.mapInArrow(visits, schema).join(held, "node"), "spelling-visits")
    crowds = visiting.groupBy("node").agg(F.count(F.lit(1)).alias("guests"), F.first("held").alias("held")).select(
        "node", F.ceil(F.col("held") / NODE).cast("int").alias("parts"), F.ceil(F.col("guests") / (2 * NODE)).cast("int").alias("crowds")
    )
    # Where a node or its crowd is split, every part of one meets every part of the other.
    own = lambda parts: F.pmod(F.xxhash64("word"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = at_home.join(crowds, "node").select("node", "word", "n", own("parts").alias("part"), every("crowds").alias("crowd"))
    right = visiting.drop("held").join(crowds, "node").select("node", "word", "n", own("crowds").alias("crowd"), every("parts").alias("part"))
    place = ["node", "part", "crowd"]
    return left.groupBy(place).cogroup(right.groupBy(place)).applyInArrow(_search_node, "a string, n_a bigint, b string, n_b bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: forms followed to the last one, by doubling: each
    round puts the target of a word's target in its place. Chains must not turn back."""
    at = scratch(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        made = scratch(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = made.select("word", "root")
        if made.filter("moved").isEmpty():
            return at


def variants(vocabulary: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the distinct words ``(word, n)``.

    ``form`` is the near word with the largest ``n``, of equal ones the first in code-point
    order, if it occurs at least twice as often; else null. ``root`` is the last form on
    the way from there, or the word itself. ``n_near`` counts near words. An empty
    vocabulary gives an empty result.
    """
    pairs = scratch(near_pairs(vocabulary), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best")
    )
    known = scratch(
        vocabulary.select("word", "n").join(best, "word", "left")
        .withColumn("fits", -F.col("best.less") >= 2 * F.col("n"))
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("fits"), F.col("best.b")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
