"""Corpus vocabulary, token ids and checks on encoded rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.functions import tokens as tok
from chatprep.operators.ordering import numbered
from chatprep.settings import UNKNOWN

# Workers get the functions themselves, not the name of a module they may not have.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The part of a vocabulary that is broadcast, some 14 MB of text at most: common tokens
# of usual size, and very common ones that may be longer.
COMMON_TOKENS, COMMON_BYTES = 100_000, 64
TOP_TOKENS, TOP_BYTES = 1000, 8192


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of some rows one after the other, and where each row's begin and end. Rows
    are lists of tokens, or texts of tokens with one blank between two."""
    if not pa.types.is_nested(column.type):
        empty = pc.equal(column, "")
        column = pc.split_pattern(pc.if_else(empty, pa.scalar(None, column.type), column), " ")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _found(column: pa.Array, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, bounds of the rows, the place of each token in ``words`` (-1 for none), and
    which of the tokens are a gap: there, but not in ``words``."""
    flat, bounds = _flat(column)
    at = pc.fill_null(pc.index_in(flat, value_set=words.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
    gap = (at < 0) & flat.is_valid().to_numpy(zero_copy_only=False)
    return flat, bounds, at, gap


def _lookups(common: Broadcast):
    """``(known, missing)`` over a column of tokens: ids by the common part of a vocabulary,
    a gap as -1, -2 .. in the order of the row and a null token as null; and the tokens of
    the gaps in that order."""

    @F.arrow_udf("array<int>")
    def known(column: pa.Array) -> pa.Array:
        words, ids = common.value
        flat, bounds, at, gap = _found(column, words)
        before = np.concatenate(([0], np.cumsum(gap)))
        nth = before[1:] - np.repeat(before[bounds[:-1]], np.diff(bounds))
        coded = np.where(gap, -nth, np.append(ids, 0)[at])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(coded, pa.int32(), mask=(at < 0) & ~gap))

    @F.arrow_udf("array<string>")
    def missing(column: pa.Array) -> pa.Array:
        flat, bounds, _, gap = _found(column, common.value[0])
        before = np.concatenate(([0], np.cumsum(gap)))
        return pa.ListArray.from_arrays(pa.array(before[bounds], pa.int32()), flat.filter(pa.array(gap)).cast(pa.string()))

    return known, missing


def _filling(unknown: int | None):
    """``fill`` over the ids of ``known`` and, for each row, what came back for its gaps in
    their order; what has no id gets ``unknown``."""

    @F.arrow_udf("array<int>")
    def fill(coded: pa.Array, late: pa.Array) -> pa.Array:
        flat, bounds = _flat(coded)
        found, ends = _flat(late)
        lacking = ~flat.is_valid().to_numpy(zero_copy_only=False)
        ids = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        gaps = np.flatnonzero(ids < 0)
        row = np.searchsorted(bounds, gaps, "right") - 1
        at = ends[row] - 1 - ids[gaps]
        there = at < ends[row + 1]
        back = np.zeros(len(gaps), np.int64)
        back[there] = found.to_numpy(zero_copy_only=False)[at[there]] & (1 << 32) - 1
        ids[gaps] = back - 1
        lacking[gaps] = back == 0
        if unknown is not None:
            ids[lacking] = unknown
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32(), mask=None if unknown is not None else lacking))

    return fill


def build_vocab(df: DataFrame, specials: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """``(token, n, id)``: specials in their order, then tokens by count
    descending and text. Tokens are counted by batches of rows, and the counts combined
    before they are shuffled: a token that makes up a third of the corpus costs one row per task."""
    spark = df.sparkSession
    # Unseen specials need an id too, so each is present at least with count 0.
    reserved = spark.createDataFrame([(s, 0) for s in specials], "token string, n bigint")
    place = F.array_position(F.array(*[F.lit(s) for s in specials]), F.col("token"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(_flat(batch.column(0))[0].drop_null())
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["token", "n"])

    seen = df.select(tokens).mapInArrow(count, "token string, n bigint")
    counts = (
        seen.unionByName(reserved)
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .withColumn("__last", F.when(place > 0, place).otherwise(len(specials) + 1))
    )
    order = [F.col("__last"), F.when(F.col("__last") > len(specials), F.col("n")).desc(), F.col("token")]
    return numbered(counts, order, "id", "vocabulary").select("token", "n", F.col("id").cast("int"))


def unknown_id(vocab: DataFrame) -> int | None:
    return vocab.filter(F.col("token") == UNKNOWN).agg(F.max("id")).first()[0]


def encode(
    df: DataFrame, vocab: DataFrame, key: str | Sequence[str] = "row_id", tokens: str = "tokens",
    unknown: int | None = None,
) -> DataFrame:
    """Replaces ``tokens``, lists or texts of tokens with a blank between, by ``input_ids``; an unknown token gets the reserved id, which is
    looked up unless ``unknown`` gives it. ``key`` must name a row: routed rows need
    ``["role", "row_id"]``.

    ``df`` and ``vocab`` are read twice and must be stored, with ``id`` falling with the
    token's count. Tokens meet the commonest part of the vocabulary in place, as whole Arrow
    columns. The others leave gaps: only ``(key, gap, token)`` goes to the join on the
    token, and of the rows only their ids, no texts, move to where the gaps come back. The
    plan is the same for any size of vocabulary. A row whose key is null gets no ids.
    """
    given = [key] if isinstance(key, str) else list(key)
    # Numbers first: sorting by a few common texts would compare whole keys over and over.
    key = sorted(given, key=lambda k: df.schema[k].dataType.typeName() == "string")
    if unknown is None:
        unknown = unknown_id(vocab)
    size = F.octet_length("token")
    often = ((F.col("id") < COMMON_TOKENS) & (size <= COMMON_BYTES)) | ((F.col("id") < TOP_TOKENS) & (size <= TOP_BYTES))
    common = vocab.filter(often).select("token", "id").toArrow().combine_chunks()
    held = df.sparkSession.sparkContext.broadcast(
        (pa.array(common.column("token").to_pylist(), pa.string()), common.column("id").to_numpy().astype(np.int32))
    )
    known, missing = _lookups(held)
    rows = df.withColumn("__ids", known(F.col(tokens))).drop(tokens)
    gaps = df.select(*key, F.posexplode(missing(F.col(tokens))).alias("__nth", "token"))
    # A gap's number and id in one value, which sorts faster than a pair; 0 for no id.
    packed = F.shiftleft(F.col("__nth").cast("long"), 32) + F.coalesce(F.col("id") + 1, F.lit(0))
    filled = (
        gaps.join(vocab.filter(~often).select("token", "id"), "token", "left")
        .drop("token")
        # A row's gaps are spread over all tasks: combining them there would be in vain.
        .repartition(*key)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(packed)).alias("__filled"))
    )
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    coded = _filling(unknown)(F.col("__ids"), F.col("__filled"))
    made = rows.join(filled, key, "left").withColumn("input_ids", F.when(named, coded)).drop("__ids", "__filled")
    return made.select(*given, *[c for c in made.columns if c not in given])


def check(
    df: DataFrame,
    response: Sequence,
    instruction: Sequence | None,
    bos,
    eos,
    ids: str = "input_ids",
) -> DataFrame:
    """Failures over the whole table, in one pass. ``ids`` may hold ids or
    tokens, as long as the templates and marks hold the same, or texts of tokens with
    a blank between."""
    row = F.col(ids)
    lits = lambda xs: [F.lit(x) for x in xs]
    if df.schema[ids].dataType.typeName() == "string":
        spaced = F.concat(F.lit(" "), row, F.lit(" "))
        # No token is empty or holds a blank: a template with such a one is nowhere.
        whole = lambda xs: all(x and " " not in x for x in xs)
        held = lambda xs: F.when(spaced.isNotNull(), F.contains(spaced, F.lit(f" {' '.join(xs)} ")) & F.lit(whole(xs)))
        holds, marked = held, lambda x: held([x])
    else:
        holds, marked = (lambda xs: tok.contains_template(row, lits(xs))), (lambda x: F.array_contains(row, F.lit(x)))
    count = lambda failing, name: F.count_if(failing).alias(name)
    aggs = [
        F.count("*").alias("n_rows"),
        count(~holds(response), "missing_response"),
    ]
    if instruction:
        aggs.append(count(~holds(instruction), "missing_instruction"))
    if bos is not None:
        aggs.append(count(~marked(bos), "missing_bos"))
    aggs.append(count(~marked(eos), "missing_eos"))
    return df.agg(*aggs)


def require(
    df: DataFrame, response: Sequence, instruction: Sequence | None, bos, eos, ids: str = "input_ids"
) -> None:
    """Raises if a row lacks a template or mark. One pass; an empty table lacks nothing."""
    found = check(df, response, instruction, bos, eos, ids).first().asDict()
    rows = found.pop("n_rows")
    lacking = {name: n for name, n in found.items() if n}
    if lacking:
        raise ValueError(f"of {rows} rows: {lacking}")


def add_labels(df: DataFrame, response: Sequence, instruction: Sequence | None, ids: str = "input_ids") -> DataFrame:
    """Adds ``labels``: ids in responses, the ignore label elsewhere. Template
    positions become columns first, so each row is searched once per template and
    not once more for every response in it."""
    found = df.withColumn("__answers", tok.template_starts(F.col(ids), [F.lit(x) for x in response]))
    if instruction:
        found = found.withColumn("__asks", tok.template_starts(F.col(ids), [F.lit(x) for x in instruction]))
    spans = tok.response_spans(
        F.size(ids), F.col("__answers"), len(response), F.col("__asks") if instruction else None
    )
    return (
        found.withColumn("__spans", spans)
        .withColumn("labels", tok.response_labels(F.col(ids), F.col("__spans")))
        .drop("__answers", "__asks", "__spans")
    )


def template_ids(vocab: DataFrame, *templates: Sequence[str]) -> list[list[int]]:
    """Ids of a few template tokens, as the settings of a run give them."""
    names = sorted({t for template in templates for t in template})
    known = dict(vocab.filter(F.col("token").isin(names)).select("token", "id").collect())
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"template tokens not in the vocabulary: {missing}")
    return [[known[t] for t in template] for template in templates]
