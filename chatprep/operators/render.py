"""From raw rows to one rendered text per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.functions import content, template, tokens as tok
from chatprep.functions.images import count_placeholders
from chatprep.operators import semijoin
from chatprep.settings import ChatTokens


def caption_to_chat(df: DataFrame, caption: str = "caption") -> DataFrame:
    return df.withColumn("messages", content.caption_messages(F.col(caption)))


def parse_content(
    df: DataFrame,
    numeric_to_text: bool = True,
    strip_parts: bool = False,
    messages: str = "messages",
) -> DataFrame:
    """Adds ``parsed``; the caller keeps or drops ``messages``."""
    return df.withColumn(
        "parsed", content.parse_messages(messages, numeric_to_text, strip_parts)
    )


def render_chat(
    df: DataFrame,
    tokens: ChatTokens,
    include_last: bool = True,
    open_assistant: bool = False,
    parsed: str = "parsed",
) -> DataFrame:
    """Adds ``text``, null where a message cannot be used."""
    return df.withColumn(
        "text", template.conversation(F.col(parsed), tokens, include_last, open_assistant)
    )


def render_turns(
    turns: DataFrame, tokens: ChatTokens, numeric_to_text: bool = True, strip_parts: bool = False
) -> DataFrame:
    """Turn rows ``(.., role, content)`` with the rendered ``piece``, its token
    count and its placeholder count. All three add up over a conversation, because
    a piece starts and ends with a special token."""
    one = content.parse_messages("array(struct(role, content))", numeric_to_text, strip_parts)
    return (
        turns.withColumn("__m", one[0])
        .withColumn("piece", template.turn(F.col("__m.role"), F.col("__m.parts"), tokens))
        .withColumn("piece", F.when(F.col("__m.parts").isNotNull(), F.col("piece")))
        .withColumn("n_tokens", F.array_size(tok.words(tok.spaced(F.col("piece"), tokens))))
        .withColumn("n_placeholders", count_placeholders(F.col("piece"), tokens.image))
        .drop("__m", "content")
    )


def chat_from_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation with its messages in turn order. A conversation is
    one row by definition, so its size is bounded by what one row can hold."""
    message = F.struct("turn", "role", "content")
    return turns.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(message)),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages")
    )


def conversation_sizes(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """Token and placeholder counts of each conversation, from partial sums: a
    conversation of any size is measured without being put together."""
    return pieces.groupBy(key).agg(
        (F.sum("n_tokens") + 2).cast("int").alias("length"),
        F.sum("n_placeholders").cast("int").alias("n_placeholders"),
        F.bool_or(F.col("piece").isNull()).alias("bad"),
        F.count(F.lit(1)).alias("n_turns"),
    )


def assemble(
    pieces: DataFrame,
    wanted: DataFrame,
    oversize: DataFrame,
    tokens: ChatTokens,
    key: str = "conv_id",
) -> DataFrame:
    """Rendered text of the ``wanted`` conversations that are not ``oversize``; both are
    narrow, stored tables with one row for each conversation.

    A Bloom filter of their keys turns other conversations away where they lie, so not one
    of them, however large, comes to the join on the key. Of those it lets through by chance
    the join drops the rest.
    """
    fitting = wanted.join(oversize.select(key), key, "left_anti")
    light = semijoin.likely(pieces.select(key, "turn", "piece"), fitting.select(key), key)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    said = F.array_join(F.transform("__pieces", lambda p: p["piece"]), "")
    carried = [c for c in wanted.columns if c != key]
    return (
        light.join(fitting, key)
        .groupBy(key)
        .agg(ordered.alias("__pieces"), *[F.any_value(c).alias(c) for c in carried])
        .select(key, *carried, F.concat(said, F.lit(template.closing(tokens))).alias("text"))
    )


def rendered_length(df: DataFrame, tokens: ChatTokens, text: str = "text") -> DataFrame:
    """Adds ``tokens`` and ``length``."""
    return df.withColumn("tokens", tok.tokenise(F.col(text), tokens)).withColumn(
        "length", F.array_size("tokens")
    )
