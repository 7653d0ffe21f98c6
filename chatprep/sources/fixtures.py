"""Inputs derived from the given tables, see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions.content import part
from chatprep.functions.tokens import words
from chatprep.operators.render import chat_from_turns
from chatprep.sources.collection import Source, spread

# Some limits below, some above the rows of a source, at every scale factor.
LIMITS = {
    "src0": {"train": 5, "validation": 1},
    "src3": {"train": 12},
    "src7": {"train": 100_000, "test": 2},
    "src9": {"train": 1},
}
SPLITS = {"train": ["train"], "valid": ["validation", "train"], "test": ["test"]}


# Columns by which the rows of a table are dealt out to tasks, where a session asks for it.
_DEAL_BY = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spread(spark.read.parquet(path), *_DEAL_BY[name])


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, turn, role, content)``: the first user turn of a conversation
    carries image parts before its text."""
    rows = table(spark, folder, "conversations")
    first = (
        rows.filter(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.min("turn").alias("turn"))
        .withColumn("__images", placeholders_of(F.col("conv_id")))
    )
    count = F.coalesce("__images", F.lit(0)).cast("int")
    parts = F.concat(
        F.array_repeat(part("image"), count), F.array(part("text", F.col("text")))
    )
    return rows.join(first, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.to_json(parts).alias("content")
    )


def placeholders_of(conv_id):
    return conv_id % 3 + F.when(conv_id % 10 == 0, 1).otherwise(0)


def image_refs(conv_id):
    """Null for every third conversation, else one or two references."""
    refs = F.transform(
        F.sequence(F.lit(0).cast("long"), conv_id % 3 - 1),
        lambda k: F.concat_ws("-", F.lit("img"), conv_id.cast("string"), k.cast("string")),
    )
    return F.when(conv_id % 3 > 0, refs)


def with_images(chats: DataFrame) -> DataFrame:
    return chats.withColumn("row_id", F.col("conv_id")).withColumn(
        "image_refs", image_refs(F.col("conv_id"))
    )


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, row_id, messages, image_refs)``."""
    return with_images(chat_from_turns(turns(spark, folder)))


def split_of(doc_id):
    return F.when(doc_id % 10 == 8, "validation").when(doc_id % 10 == 9, "test").otherwise("train")


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, caption, image_refs, source, split)``."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select(
        doc.alias("row_id"),
        F.col("text").alias("caption"),
        F.array(F.concat_ws("-", F.lit("doc"), doc.cast("string"))).alias("image_refs"),
        "source",
        split_of(doc).alias("split"),
    )


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, source, split, length)``: captions with their number of words."""
    return captions(spark, folder).select(
        "row_id", "source", "split", F.size(words(F.col("caption"))).alias("length")
    )


def collection(folder: str) -> dict[str, Source]:
    """Three differently shaped sources of one collection."""
    return {
        "captions": Source(
            f"{folder}/documents.parquet",
            {"text": "text", "lang": "lang"},
            row_id="doc_id",
            split=split_of(F.col("doc_id")),
            subset_column="lang",
        ),
        "turns": Source(
            f"{folder}/conversations.parquet",
            {"text": "text", "role": "role"},
            row_id=None,
            split=F.lit("train"),
            subset_column="role",
        ),
        "probes": Source({"test": f"{folder}/benchmark.parquet"}, {"text": "text"}),
    }
