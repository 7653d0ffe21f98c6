"""Recipes on rows as they arrive.

Rendering, guards, lengths and the length filter look at one row, so they run on
a stream as they are. Only token ids meet another table, the stored vocabulary,
and do so per micro-batch with the batch job's own function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from chatprep.operators import guards, vocab as words
from chatprep.operators.roles import within
from chatprep.plans import recipes
from chatprep.settings import ChatTokens


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def measured(rows: DataFrame, recipe: str, tokens: ChatTokens, max_length: int) -> DataFrame:
    return guards.kept(guards.settled(recipes.apply(rows, recipe, tokens))).filter(within(max_length))


def write_measured(
    rows: DataFrame, recipe: str, tokens: ChatTokens, max_length: int, out: str, checkpoint: str
):
    """Starts a query that handles everything there is and stops."""
    return (
        measured(rows, recipe, tokens, max_length)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def write_encoded(
    rows: DataFrame, recipe: str, tokens: ChatTokens, max_length: int, vocab: DataFrame, out: str, checkpoint: str
):
    """As ``write_measured`` with token ids. A repeated micro-batch overwrites its
    own folder, so a restart leaves no duplicates."""
    unknown = words.unknown_id(vocab)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        recipes.encoded(batch, vocab, unknown).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    return (
        measured(rows, recipe, tokens, max_length)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
