"""Rows the recipes refuse, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions import images

BAD_CONTENT = "bad_content"
IMAGE_MISMATCH = "image_mismatch"
ORPHAN_PLACEHOLDER = "orphan_placeholder"


def image_mismatch(n_placeholders: Column, n_images: Column) -> Column:
    """Images are there, but not as many as placeholders. An empty list passes."""
    return F.coalesce((n_images > 0) & (n_placeholders != n_images), F.lit(False))


def orphan_placeholder(n_placeholders: Column, n_images: Column) -> Column:
    return n_images.isNull() & (n_placeholders > 0)


def reason(usable: Column, n_placeholders: Column, n_images: Column) -> Column:
    return (
        F.when(~usable, BAD_CONTENT)
        .when(image_mismatch(n_placeholders, n_images), IMAGE_MISMATCH)
        .when(orphan_placeholder(n_placeholders, n_images), ORPHAN_PLACEHOLDER)
    )


def classify(df: DataFrame, image_token: str, text: str = "text", image_refs: str = "image_refs") -> DataFrame:
    """Adds ``n_placeholders``, ``n_images`` and ``reason``, null when kept."""
    return (
        df.withColumn("n_placeholders", images.count_placeholders(F.col(text), image_token))
        .withColumn("n_images", images.count_images(F.col(image_refs)))
        .withColumn(
            "reason",
            reason(F.col(text).isNotNull(), F.col("n_placeholders"), F.col("n_images")),
        )
    )


def settled(classified: DataFrame) -> DataFrame:
    """The same rows behind a generator, which no filter is pushed through: a row that is
    not stored is rendered once, not once more for every test of its text."""
    return classified.select(F.inline(F.array(F.struct(*classified.columns))))


def kept(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reason").isNull())


def rejects(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reason").isNotNull())
