"""Image placeholders and image references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_placeholders(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of ``token``."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))
    return (gone / F.lit(len(token))).cast("int")


def count_images(refs: Column) -> Column:
    """Number of images; null without an image column value."""
    return F.when(refs.isNotNull(), F.size(refs))


def first_image(refs: Column) -> Column:
    return F.try_element_at(refs, F.lit(1))


def expanded_length(length: Column, images: Column, image_size: int, patch_size: int) -> Column:
    """Length when each placeholder stands for one token per image patch."""
    side = image_size // patch_size
    return (length + images * F.lit(side * side - 1)).cast("int")
