"""Stable dense numbers for ids that are texts or several columns.

A dictionary is kept below one folder: the numbers each run gave, and one row per run
that names them. A run numbers the keys it has not seen, after all earlier numbers, so
what once got a number keeps it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.operators.ordering import numbered

#: A key is a source, one of its paths by its split ("" for a source of one path), and an own id.
KEY = ["source", "path_split", "own"]

_NUMBERS = "source string, path_split string, own string, row_id bigint"
_RUNS = "folder string, n_keys bigint, run bigint"


def own_id(source: str, columns: Sequence[str]) -> Column:
    """The values of some columns as one JSON list; a null value is one of its own, but an
    id of which every value is null stops the job when it is read."""
    parts = [F.col(f"`{c}`").cast("string") for c in columns]
    none = F.raise_error(F.lit(f"row id of source {source} is null")).cast("string")
    return F.when(F.coalesce(*parts).isNull(), none).otherwise(F.to_json(F.array(*parts), {"ignoreNullFields": "false"}))


class IdDictionary:
    """Numbers from 0, without a gap, of the keys of all runs below ``folder``.

    New keys of one run are numbered in the order of ``KEY`` by a range sort; no window
    runs over them. Numbers are written before the run that names them, so a run that
    stops gives none, and of two runs at once the one that names its numbers second fails
    on a folder that is there already. After such a stop a folder ``runs/run=N`` without
    rows may be left, and has to be removed before the next run.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], _RUNS).write.mode("ignore").partitionBy("run").parquet(f"{self.folder}/runs")

    def _runs(self) -> list:
        return self.spark.read.schema(_RUNS).parquet(f"{self.folder}/runs").orderBy("run").collect()

    def numbers(self) -> DataFrame:
        """``(source, path_split, own, row_id)`` of all keys."""
        folders = [f"{self.folder}/numbers/{r.folder}" for r in self._runs()]
        return self.spark.read.schema(_NUMBERS).parquet(*folders) if folders else self.spark.createDataFrame([], _NUMBERS)

    def extend(self, keys: DataFrame) -> DataFrame:
        """Numbers the rows of ``keys`` (columns ``KEY``, repeated or not) that have no number
        yet, and gives the numbers of all."""
        runs = self._runs()
        before = sum(r.n_keys for r in runs)
        fresh = keys.select(*KEY).distinct().join(self.numbers(), KEY, "left_anti")
        placed = numbered(fresh, [F.col(c) for c in KEY], "__nth", "id-order")
        folder = uuid.uuid4().hex
        path = f"{self.folder}/numbers/{folder}"
        placed.select(*KEY, (F.col("__nth") + before).alias("row_id")).write.parquet(path)
        found = self.spark.read.schema(_NUMBERS).parquet(path).agg(F.lit(folder).alias("folder"), F.count(F.lit(1)).alias("n_keys"))
        if not found.filter("n_keys > 0").isEmpty():
            found.coalesce(1).write.mode("error").parquet(f"{self.folder}/runs/run={len(runs)}")
        return self.numbers()
