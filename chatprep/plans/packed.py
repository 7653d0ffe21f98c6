"""From raw turns to packed training sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep import settings as S
from chatprep.functions import images
from chatprep.operators import guards, packing, render, vocab
from chatprep.operators.ordering import Order, latest_first, shuffled
from chatprep.operators.roles import within
from chatprep.sources import fixtures
from chatprep.sources.stages import scratch


def judged_conversations(pieces: DataFrame, image_refs: Column, key: str = "conv_id") -> DataFrame:
    """``(key, length, n_placeholders, image_refs, n_images, reason)`` of each
    conversation, from sums over its rendered turns."""
    n_images = images.count_images(F.col("image_refs"))
    reason = guards.reason(~F.col("bad"), F.col("n_placeholders"), F.col("n_images"))
    return (
        render.conversation_sizes(pieces, key)
        .withColumn("image_refs", image_refs)
        .withColumn("n_images", n_images)
        .withColumn("reason", reason)
        .drop("bad")
    )


def fitting_conversations(
    turns: DataFrame, image_refs: Column, tokens: S.ChatTokens, max_length: int, key: str = "conv_id"
) -> DataFrame:
    """``(row_id, image_refs, tokens, length)`` of the conversations that pass the
    guards and fit. Only what is kept gets put together. The sums are stored: they
    are narrow, and what is wanted and what is too heavy are both read from them."""
    pieces = render.render_turns(turns, tokens)
    judged = scratch(judged_conversations(pieces, image_refs, key), "judged")
    wanted = guards.kept(judged).filter(within(max_length)).select(key, "length", "image_refs")
    # A conversation of unusable turns has no length and is as unwanted as an overlong one.
    oversize = judged.filter(F.col("reason").isNotNull() | ~within(max_length)).select(key, "n_turns")
    rows = render.assemble(pieces, wanted, oversize, tokens, key)
    return render.rendered_length(rows, tokens).select(
        F.col(key).alias("row_id"), "image_refs", "tokens", "length"
    )


def fitting_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = fixtures.turns(spark, folder)
    return fitting_conversations(
        turns, fixtures.image_refs(F.col("conv_id")), S.TOKENS, S.MAX_LENGTH
    )


def judged_chat(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations of the turn table, measured but not put together."""
    pieces = render.render_turns(fixtures.turns(spark, folder), S.TOKENS)
    judged = judged_conversations(pieces, fixtures.image_refs(F.col("conv_id")))
    return judged.withColumnRenamed("conv_id", "row_id")


def places(
    rows: DataFrame, max_length: int, limit: int, shuffle: tuple[int, int] | None = None, by=()
) -> tuple[DataFrame, DataFrame]:
    """``(plan, placed rows)`` for stored ``rows``; ``shuffle`` is (seed, epoch)."""
    plan = scratch(packing.strategies(rows, max_length, limit, by), "strategies")
    order: Order = shuffled(*shuffle) if shuffle else latest_first(rows)
    return plan, packing.assign(rows, plan, order, by)


def encoded_chat(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(encoded rows with labels, vocabulary)`` of the fitting conversations."""
    rows = scratch(fitting_chat(spark, folder), "rows")
    words = vocab.build_vocab(rows, S.TOKENS.specials)
    response, instruction = vocab.template_ids(words, S.RESPONSE_TEMPLATE, S.INSTRUCTION_TEMPLATE)
    ids = vocab.encode(rows, words)
    return vocab.add_labels(ids, response, instruction), words


def packed_chat(spark: SparkSession, folder: str, seed: int = S.SEED, epoch: int = S.EPOCH) -> DataFrame:
    """One row per pack with everything training needs. Sequences are placed by
    their narrow (row_id, length); their contents move once, to their pack."""
    rows, _ = encoded_chat(spark, folder)
    rows = scratch(rows, "encoded")
    _, placed = places(rows.select("row_id", "length"), S.MAX_LENGTH, S.PACK_LIMIT, (seed, epoch))
    packs = packing.gather(rows.drop("length"), placed)
    n_tokens = F.element_at("members", -1)["end"]
    return packs.select(
        "pack_id",
        F.size("members").alias("n_sequences"),
        n_tokens.alias("n_tokens"),
        (n_tokens / F.lit(float(S.MAX_LENGTH))).alias("fill_rate"),
        *packing.concatenated(),
        packing.segments(),
        packing.images(),
    )
