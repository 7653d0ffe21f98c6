"""Recipes: raw rows to measured rows, chosen by name.

A recipe takes rows with ``row_id`` and messages (or a caption) and gives the
declared columns only: keys that are there, image references, the text, its
tokens and length, the guard's counts and the ``reason`` a row is refused for,
null when it is kept. Refused rows stay in so that they can be reported;
``guards.kept`` leaves them out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.functions import content
from chatprep.operators import guards, render
from chatprep.operators.vocab import encode
from chatprep.settings import ChatTokens

KEYS = ("row_id", "source", "source_ord", "split", "input_file")
MEASURED = ("image_refs", "text", "tokens", "length", "n_placeholders", "n_images", "reason")


def _measured(parsed: DataFrame, tokens: ChatTokens, extra: tuple[str, ...] = ()) -> DataFrame:
    if "image_refs" not in parsed.columns:
        parsed = parsed.withColumn("image_refs", F.lit(None).cast("array<string>"))
    rows = render.render_chat(parsed, tokens)
    rows = guards.classify(render.rendered_length(rows, tokens), tokens.image)
    keys = [c for c in KEYS if c in rows.columns]
    return rows.select(*keys, *extra, *MEASURED)


def caption(df: DataFrame, tokens: ChatTokens) -> DataFrame:
    """Captions or conversations; text parts are stripped."""
    if "caption" in df.columns:
        parsed = df.withColumn("parsed", content.caption_parsed(F.col("caption")))
    else:
        parsed = render.parse_content(df, numeric_to_text=True, strip_parts=True)
    return _measured(parsed, tokens)


def chat(df: DataFrame, tokens: ChatTokens) -> DataFrame:
    return _measured(render.parse_content(df), tokens)


def _needs_images(df: DataFrame) -> None:
    missing = [c for c in ("image_refs", "image_size") if c not in df.columns]
    if missing:
        raise ValueError(f"this recipe needs the columns {missing}")


def chat_sized(df: DataFrame, tokens: ChatTokens) -> DataFrame:
    """Conversations whose image size goes along."""
    _needs_images(df)
    return _measured(render.parse_content(df), tokens, ("image_size",))


def chat_sized_raw(df: DataFrame, tokens: ChatTokens) -> DataFrame:
    """As ``chat_sized``, but a number as content is refused."""
    _needs_images(df)
    return _measured(render.parse_content(df, numeric_to_text=False), tokens, ("image_size",))


RECIPES: dict[str, Callable[[DataFrame, ChatTokens], DataFrame]] = {
    "caption": caption,
    "chat": chat,
    "chat_sized": chat_sized,
    "chat_sized_raw": chat_sized_raw,
}


def apply(df: DataFrame, name: str, tokens: ChatTokens) -> DataFrame:
    if name not in RECIPES:
        raise ValueError(f"unknown recipe {name!r}, one of {sorted(RECIPES)}")
    return RECIPES[name](df, tokens)


def custom(df: DataFrame, function, schema, arrow: bool = False, **kwargs) -> DataFrame:
    """A caller's own batch function: it gets batches of rows and may drop rows
    and change columns. Use it for a tokenizer Spark has no expression for."""

    def run(batches):
        for batch in batches:
            yield function(batch, **kwargs)

    return (df.mapInArrow if arrow else df.mapInPandas)(run, schema)


def encoded(measured: DataFrame, vocab: DataFrame, unknown: int | None = None) -> DataFrame:
    """The declared output of the map stage: keys, image references, ids, length."""
    rows = guards.kept(measured).drop("text", "n_placeholders", "n_images", "reason")
    return encode(rows, vocab, unknown=unknown)
