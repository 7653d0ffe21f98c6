"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a toxicity p from a logistic model
of its words and word beginnings; a document is toxic unless all of its sentences are
clean: 1 - (1 - p1)(1 - p2).. (noisy-or). Only document labels are learned from, and
the sentence scores that come out tell where a document offends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.hashing import mix, slices
from chatprep.llm.letters import is_letter, pieces
from chatprep.sources.stages import scratch

#: Labelled documents of each class that are learned from, in the mean of the draw.
SAMPLE_DOCS = 2000
#: Hashed features, and lengths of the word beginnings among them.
FEATURES = 1 << 18
BEGINNINGS = (4, 5, 6, 7)
#: A feature is learned from if it is in so many more of the sample's toxic documents
#: than of its clean ones, in standard errors. Other words say nothing on a sentence.
LEAST_EXCESS = 6.0
STEPS = 200
RATE = 0.1
PENALTY = 1e-5
SENTENCE_ENDS = ".!?\n"


def _features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of ``(feature of each word or beginning, its sentence, text of each sentence,
    end of each sentence)``; ends count characters of the lower-cased text."""
    for codes, owner in pieces(texts):
        letter = is_letter()[codes]
        ends = np.flatnonzero(np.isin(codes, [0, *map(ord, SENTENCE_ENDS)]))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        value = mix(codes.astype(np.uint64))
        sentence = np.searchsorted(ends, starts)
        made, where = [], []
        for length in (*BEGINNINGS, None):
            own = np.arange(len(starts)) if length is None else np.flatnonzero(stops - starts > length)
            total = np.full(len(own), np.uint64(length or 0))
            size = (stops - starts)[own] if length is None else np.full(len(own), length)
            for j in range(int(size.max(initial=0))):
                here = np.flatnonzero(size > j)
                total[here] = mix(total[here] * np.uint64(31) + value[starts[own[here]] + j])
                if j == 63:  # words of more letters are told apart by their first 64 and their length
                    break
            made.append((mix(total + size.astype(np.uint64)) & np.uint64(FEATURES - 1)).astype(np.int64))
            where.append(sentence[own])
        yield np.concatenate(made), np.concatenate(where), owner[ends], ends


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, feature: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        z = self.bias + np.bincount(sentence, self.weights[feature], count)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _noisy_or(p: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), count))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label: str = "toxic", label_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model fitted to some ``sample_docs`` labelled documents of each class (all, if
    there are fewer), drawn by a hash of their id. Null texts and labels, and documents whose labels differ,
    are not learned from; a sample without one of the classes gives a model that calls
    nothing toxic."""
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(label_id).isNotNull())
        .groupBy(F.col(label_id).alias("label_id")).agg(F.min(label).alias("y"), F.max(label).alias("y2"))
        .filter("y = y2").select("label_id", "y").withColumn("h", F.xxhash64("label_id", F.lit(11)))
    )
    there = known.join(docs.select(F.col(id_column).alias("label_id")), "label_id", "left_semi")
    sizes = {r["y"]: r["n"] for r in there.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.when(F.col("y") == 1, sample_docs / max(sizes.get(1, 1), 1)).otherwise(sample_docs / max(sizes.get(0, 1), 1))
    # Stored, so that its size is known before the texts are joined: it is bounded by the
    # sample, and the texts need not move.
    chosen = scratch(there.filter(F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40)) < part), "toxicity-chosen")
    rows = (
        docs.filter(F.col(text_column).isNotNull()).join(chosen, F.col(id_column) == F.col("label_id"))
        .select("y", F.col(text_column).cast("binary").alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in slices(batches, "text"):
            for y, value in zip(part.column("y").to_pylist(), values):
                features, sentences, at = [], [], 0
                for feature, sentence, text, _ in _features([value.decode()]):
                    pair = np.unique(sentence * FEATURES + feature)
                    features.append(pair % FEATURES)
                    sentences.append(pair // FEATURES + at)
                    at += len(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([y], pa.int32()), pa.array([at], pa.int32()),
                        pa.array([np.concatenate(features).astype(np.int32)]), pa.array([np.concatenate(sentences).astype(np.int32)]),
                    ],
                    names=["y", "n", "feature", "sentence"],
                )

    bags = scratch(rows.mapInArrow(run, "y int, n int, feature array<int>, sentence array<int>"), "toxicity-bags")
    sizes = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(FEATURES, np.float32), -20.0)
    # At most FEATURES rows.
    held = (
        bags.select("y", F.explode(F.array_distinct("feature")).alias("feature")).groupBy("feature")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).toPandas()
    )
    pooled = (held["toxic"] + held["clean"] + 1) / (sizes[0] + sizes[1] + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]))
    excess = (held["toxic"] / sizes[1] - held["clean"] / sizes[0]) / error
    telling = np.zeros(FEATURES, bool)
    telling[held["feature"].to_numpy()[excess.to_numpy() >= LEAST_EXCESS]] = True

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            feature, sentence = part.column("feature"), part.column("sentence")
            bag = np.repeat(np.arange(len(part)), np.diff(feature.offsets.to_numpy()))
            kept = telling[feature.flatten().to_numpy()]
            offsets = pa.array(np.searchsorted(bag[kept], np.arange(len(part) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x.flatten().filter(pa.array(kept))) for x in (feature, sentence)]
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("n"), *lists], names=["y", "n", "feature", "sentence"])

    made = bags.mapInArrow(reduced, bags.schema).toArrow()
    y, n = made["y"].to_numpy().astype(np.float64), made["n"].to_numpy().astype(np.int64)
    lists = [made[c].combine_chunks() for c in ("feature", "sentence")]
    feature, sentence = (x.flatten().to_numpy().astype(np.int64) for x in lists)
    of_bag = np.repeat(np.arange(len(y)), np.diff(lists[0].offsets.to_numpy()))
    return _fitted(feature, sentence + (np.cumsum(n) - n)[of_bag], np.repeat(np.arange(len(y)), n), y)


def _fitted(feature: np.ndarray, sentence: np.ndarray, bag: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the likelihood of the bags' labels, each class with half of the weight."""
    model = Model(np.zeros(FEATURES), -4.0)
    first, second = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    count = len(bag)
    for step in range(1, STEPS + 1):
        p = model.sentences(feature, sentence, count)
        whole = np.clip(_noisy_or(p, bag, len(y)), 1e-9, 1.0)
        pull = np.where(y == 1, -(1 - whole) / whole, 1.0) * share
        on_sentence = p * pull[bag]
        gradient = np.append(np.bincount(feature, on_sentence[sentence], FEATURES) + PENALTY * model.weights, on_sentence.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        move = RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
        model = Model(model.weights - move[:-1], model.bias - move[-1])
    return Model(model.weights.astype(np.float32), float(model.bias))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, score, predicted, n_sentences, offending)``, one row per row of ``docs``.

    ``offending`` lists ``(start, end, score)`` of the sentences that score 0.5 or more, in
    characters of the text. Null and empty texts have no sentence with a word and get the
    score of a clean one. Repeated rows and null ids are scored like others.
    """
    # FEATURES weights, whatever the corpus.
    shared, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, bias)
        for part, values in slices(batches, "text"):
            texts = [(v or b"").decode() for v in values]
            clean = np.zeros(len(texts))
            found: list[list] = [[] for _ in texts]
            counts = np.zeros(len(texts), np.int64)
            read: dict[int, int] = {}
            for feature, sentence, text, ends in _features(texts):
                pair = np.unique(sentence * FEATURES + feature)
                p = own.sentences(pair % FEATURES, pair // FEATURES, len(text))
                clean += np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))
                counts += np.bincount(text, minlength=len(texts))
                fresh = np.concatenate(([True], text[1:] != text[:-1]))
                begin = np.concatenate(([0], ends[:-1] + 1))
                base = np.maximum.accumulate(np.where(fresh, begin, 0))
                for i in np.flatnonzero(p >= 0.5):
                    t = int(text[i])
                    off = read.get(t, 0) - int(base[i])
                    found[t].append({"start": int(begin[i]) + off, "end": int(ends[i]) + off, "score": float(p[i])})
                last = int(text[-1])  # a long text goes on in the next piece
                read[last] = read.get(last, 0) + int(ends[-1] - base[-1])
            score = -np.expm1(clean)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(counts), pa.array(found, kind)],
                names=["doc_id", "score", "predicted", "n_sentences", "offending"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return narrow.mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
    )
