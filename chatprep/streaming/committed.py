"""A stream's rows in batches that are committed once, and ids for what has arrived.

Micro-batches are written as measured rows; ids come later, for all batches that
have arrived since, in one job. So the vocabulary meets the rows once per run and not
once per micro-batch, and every row of a run is encoded with one and the same vocabulary.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatprep.operators import vocab as words
from chatprep.plans import recipes
from chatprep.settings import ChatTokens
from chatprep.streaming.arrivals import measured

_COMMIT = "batch bigint, folder string, n_rows bigint"


class CommittedBatches:
    """Rows below ``out``, a folder that all executors share.

    Each attempt at a micro-batch writes a folder of its own, and one row of ``commits`` names
    the folder that counts. A batch that is tried again after its commit is left alone, one
    that stopped before is written anew; what it left behind is never read.
    """

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        for table in ("commits", "encoded-commits"):
            spark.createDataFrame([], _COMMIT).write.mode("ignore").partitionBy("batch").parquet(f"{self.out}/{table}")

    def _commits(self, table: str) -> DataFrame:
        return self.spark.read.schema(_COMMIT).parquet(f"{self.out}/{table}")

    def _commit(self, table: str, batches: list[tuple[int, str, int]]) -> None:
        made = self.spark.createDataFrame(batches, _COMMIT).coalesce(1)
        made.write.mode("append").partitionBy("batch").parquet(f"{self.out}/{table}")

    def take(self, rows: DataFrame, batch: int) -> None:
        """The sink of ``foreachBatch``."""
        if not self.commits().filter(F.col("batch") == batch).isEmpty():
            return
        folder = f"{self.out}/rows/{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._commit("commits", [(batch, folder, self.spark.read.parquet(folder).count())])

    def commits(self) -> DataFrame:
        """``(batch, folder, n_rows)`` of the batches that count."""
        return self._commits("commits")

    def _read(self, commits: DataFrame) -> DataFrame | None:
        # Folders are few: one for each micro-batch, or for each run that encoded.
        folders = sorted(r.folder for r in commits.select("folder").distinct().collect())
        return self.spark.read.parquet(*folders) if folders else None

    def rows(self) -> DataFrame | None:
        """Measured rows of all committed batches, None before the first."""
        return self._read(self.commits())

    def pinned(self, vocabulary: DataFrame) -> DataFrame:
        """The vocabulary of this folder: the one it was first given, whatever comes later."""
        path = f"{self.out}/vocabulary"
        vocabulary.write.mode("ignore").parquet(path)
        return self.spark.read.schema(vocabulary.schema).parquet(path)

    def encode(self, vocabulary: DataFrame) -> DataFrame | None:
        """Ids of every committed batch, those that have none yet in one job with the pinned
        vocabulary. A run that stops leaves its batches to the next."""
        done = self._commits("encoded-commits").select("batch")
        open_ = self.commits().join(done, "batch", "left_anti").orderBy("batch").collect()
        if open_:
            folder = f"{self.out}/encoded/{uuid.uuid4().hex}"
            known = self.pinned(vocabulary)
            waiting = self.spark.read.parquet(*[r.folder for r in open_])
            recipes.encoded(waiting, known, words.unknown_id(known)).write.parquet(folder)
            self._commit("encoded-commits", [(r.batch, folder, r.n_rows) for r in open_])
        return self._read(self._commits("encoded-commits"))


def write_arrivals(rows: DataFrame, recipe: str, tokens: ChatTokens, max_length: int, sink: CommittedBatches, checkpoint: str) -> StreamingQuery:
    """Starts a query that takes everything there is, in micro-batches, and stops."""
    return (
        measured(rows, recipe, tokens, max_length)
        .writeStream.foreachBatch(sink.take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
