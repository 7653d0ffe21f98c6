"""Quality rules with an isolation forest on the rule statistics.

The base rules reject by fixed limits. What they let through is scored by an isolation
forest: trees that split random statistics at random values isolate unusual documents
after few splits. The forest is fitted on a bounded sample; the score above which a
document goes is calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.hashing import slices, windows, word_hashes
from chatprep.sources.stages import scratch

#: Base limits: fewer words, or more percent of words in repeated windows, are rejected.
LEAST_WORDS = 50
MOST_REPEATED = 50
WINDOW = 3

#: Rows the forest is fitted on, in the mean of the draw, trees, and rows drawn for each tree.
SAMPLE_ROWS = 16_384
TREES = 200
TREE_ROWS = 128
#: Share of the good labelled rows that calibration may reject at most.
MOST_GOOD_LOST = 0.005
#: Bins of the score in which labelled rows are counted.
SCORE_BINS = 4000
SEED = 7

SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = _UPPER | np.isin(np.arange(256), list(range(97, 123)))
_CODE_POINT = np.arange(256) & 0xC0 != 0x80


def counts(values: list[bytes | None]) -> dict[str, np.ndarray]:
    """The statistics ``COUNTS`` of each text; all zero for null."""
    hashes, bounds = word_hashes(values, lower=False)
    n_words = np.diff(bounds)
    made, owner, first = windows(hashes, bounds, WINDOW)
    order = np.lexsort((made, owner))
    same = (made[order][1:] == made[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(made), bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = first[order][twice]
    steps = np.bincount(start, minlength=len(hashes) + 1) - np.bincount(start + WINDOW, minlength=len(hashes) + 1)
    repeated = np.concatenate(([0], np.cumsum(np.cumsum(steps[:-1]) > 0)))

    raw = np.frombuffer(b"".join(v or b"" for v in values), np.uint8)
    ends = np.cumsum([len(v or b"") for v in values])

    def held(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[raw])))
        return np.diff(np.concatenate(([0], total[ends])))

    lines = [[x for x in (v or b"").split(b"\n") if x.strip()] for v in values]
    return {
        "n_words": n_words,
        "word_chars": held(_CODE_POINT & ~_BLANK),
        "n_symbols": held(_SYMBOL),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated[bounds[1:]] - repeated[bounds[:-1]],
        "n_upper": held(_UPPER),
        "n_letters": held(_LETTER),
    }


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on, one row per document: symbols a word, the share of
    capitals and the length of a word, on scales that spread small values. Repetition is
    left to the base rules: documents with a common licence line are no anomaly."""
    x = {k: np.asarray(v, np.float64) for k, v in c.items()}
    words = np.maximum(x["n_words"], 1)
    return np.column_stack((
        np.sqrt(x["n_symbols"] / words),
        np.sqrt(x["n_upper"] / np.maximum(x["n_letters"], 1)),
        np.log(np.maximum(x["word_chars"], 1) / words),
    ))


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    words = np.asarray(c["n_words"])
    return (words < LEAST_WORDS) | (100 * np.asarray(c["n_repeat_words"]) > MOST_REPEATED * words)


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, np.float64)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    norm: float

    @staticmethod
    def fit(rows: np.ndarray, trees: int = TREES, drawn: int = TREE_ROWS, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        drawn = min(drawn, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(drawn, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature = np.full((trees, nodes), -1)
        split = np.zeros((trees, nodes))
        path = np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, rows[rng.choice(len(rows), drawn, replace=False)])]
            while todo:
                at, level, own = todo.pop()
                low, high = own.min(axis=0), own.max(axis=0)
                varied = np.flatnonzero(high > low)
                if level == depth or len(own) < 2 or not len(varied):
                    path[t, at] = level + _expected(len(own))
                    continue
                f = rng.choice(varied)
                cut = rng.uniform(low[f], high[f])
                left = own[:, f] <= cut
                feature[t, at], split[t, at] = f, cut
                todo += [(2 * at + 1, level + 1, own[left]), (2 * at + 2, level + 1, own[~left])]
        return Forest(feature, split, path, max(float(_expected(drawn)), 1.0))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 is ordinary, near 1 is isolated at once."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            at = np.zeros(len(rows), np.int64)
            going = every[feature[at] >= 0]
            while len(going):
                here = at[going]
                right = rows[going, feature[here]] > split[here]
                at[going] = 2 * here + 1 + right
                going = going[feature[at[going]] >= 0]
            total += path[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


@dataclass
class Model:
    forest: Forest | None
    threshold: float


def _id_type(docs: DataFrame, id_column: str) -> str:
    return docs.schema[id_column].dataType.simpleString()


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, COUNTS..)`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in slices(batches, "text"):
            c = counts(values)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], names=["doc_id", *COUNTS]
            )

    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {_id_type(docs, id_column)}, " + ", ".join(f"{k} bigint" for k in COUNTS))


def judged(stats: DataFrame, model: Model) -> DataFrame:
    """Statistics with ``base_failed``, ``score`` and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            c = {k: part.column(k).to_numpy() for k in COUNTS}
            failed, score, kept = _verdict(c, model)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(failed), pa.array(score), pa.array(kept)],
                names=[*part.schema.names, "base_failed", "score", "kept"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInArrow(run, f"{kinds}, base_failed boolean, score double, kept boolean")


def _verdict(c: dict[str, np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(c)
    score = model.forest.scores(features(c)) if model.forest else np.full(len(failed), 0.5)
    return failed, score, ~failed & (score < model.threshold)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A forest from some ``SAMPLE_ROWS`` of the rows that pass the base rules (all, if there
    are fewer), drawn by a hash of their statistics and id, and the score that parts labelled good
    from bad rows best while at most ``MOST_GOOD_LOST`` of the good ones go.

    Without rows the forest is empty; without labelled rows of both kinds nothing is
    rejected beyond the base rules. Unlabelled rows and null labels are not counted.
    """
    passing = stats.filter((F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words")))
    rows = passing.count()
    if not rows:
        return Model(None, np.inf)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED), *COUNTS), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE_ROWS / rows))
    sample = passing.filter(drawn).select("doc_id", *COUNTS).toPandas().sort_values(["doc_id", *COUNTS], ignore_index=True)
    if not len(sample):
        return Model(None, np.inf)
    forest = Forest.fit(features({k: sample[k].to_numpy() for k in COUNTS}))
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("good"))
    scored = judged(passing, Model(forest, np.inf)).select("doc_id", "score")
    bins = (
        scored.join(known, F.col("doc_id") == F.col("label_id"))
        .groupBy(F.floor(F.col("score") * SCORE_BINS).cast("int").alias("bin"), "good").count().collect()
    )
    good, bad = np.zeros(SCORE_BINS + 1), np.zeros(SCORE_BINS + 1)
    for r in bins:
        (good if r["good"] else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return Model(forest, np.inf)
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    caught = np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(lost <= MOST_GOOD_LOST, caught - lost, -1.0)
    best = int(gain.argmax())
    return Model(forest, best / SCORE_BINS if gain[best] > 0 else np.inf)


def rejecting(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules and the forest keep.

    Each row is judged by its own text, so repeated rows stay or go together; null and
    empty texts have no words and go. Ids, null or not, play no part in the verdict.
    """
    model = fit(scratch(statistics(docs, id_column, text_column), "quality-statistics"), labels)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices([batch], place):
                yield part.filter(pa.array(_verdict(counts(values), model)[2]))

    return docs.mapInArrow(run, docs.schema)


def rated(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, COUNTS.., base_failed, score, kept)``, one row per row of ``docs``.
    A null text counts as one without words and fails the base rules."""
    stats = scratch(statistics(docs, id_column, text_column), "quality-statistics")
    return judged(stats, fit(stats, labels))
