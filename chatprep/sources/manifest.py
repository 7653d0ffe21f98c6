"""Stages that know which files they were made from.

A stage is kept below one folder: rows of each run, and a log that says for every
input file its size and time, the run that mapped it, and whether it is still there. A
later run maps new and changed files alone. What a removed or changed file once gave
stays where it is and is left out when the stage is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.sources.stages import fingerprint

FILE = "input_file"
RUN = "stage_run"
#: Runs after which the rows of all of them are written together.
MOST_RUNS = 32

_LOG = f"{FILE} string, bytes bigint, changed timestamp, {RUN} string, alive boolean, n_entries bigint, version bigint"


def file_of_row():
    """The file a row was read from; select it right after reading."""
    return F.col("_metadata.file_path").alias(FILE)


def listed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, input_file, bytes, changed)`` of the files below ``path``. No file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", file_of_row(), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


class FileStage:
    """Rows mapped from files, below ``root`` under the name and all parameters of the stage.

    ``mapped`` turns a list of files into rows that carry ``file_of_row``. It must look at
    one file's rows at a time, or runs would differ by what they happened to see together.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, params: dict, mapped: Callable[[Sequence[str]], DataFrame]):
        self.spark, self.mapped = spark, mapped
        self.path = f"{root.rstrip('/')}/{name}-{fingerprint(params)}"
        spark.createDataFrame([], _LOG).write.mode("ignore").partitionBy("version").parquet(f"{self.path}/log")

    def _log(self) -> tuple[int, DataFrame]:
        """The latest whole entry of the log. A write that stopped half-way has fewer rows
        than each of its rows says, and is passed over."""
        log = self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        whole = log.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.max("n_entries").alias("m")).filter("n = m")
        version = whole.agg(F.max("version")).first()[0] or 0
        return version, log.filter((F.col("version") == version) & F.col(FILE).isNotNull()).select(FILE, "bytes", "changed", RUN, "alive")

    def version(self) -> int:
        return self._log()[0]

    def files(self) -> DataFrame:
        """``(input_file, bytes, changed, stage_run)`` the stage is made from."""
        return self._log()[1].filter("alive").drop("alive")

    def update(self, path: str | Sequence[str]) -> DataFrame:
        """Brings the stage up to the files that lie below ``path`` now, and gives its rows.

        Rows are written before the log names them, so a run that stops leaves the stage as
        it was. Of two runs at once the one that writes its log second fails.
        """
        version, before = self._log()
        now = listed(self.spark, path)
        same = [FILE, "bytes", "changed"]
        state = now.join(before.filter("alive").drop("alive"), same, "left")
        fresh = [r.path for r in state.filter(F.col(RUN).isNull()).select("path").collect()]
        gone = before.filter("alive").join(now, same, "left_anti")
        if not fresh and gone.isEmpty():
            return self.rows()
        run = uuid.uuid4().hex
        if fresh:
            self._write(self.mapped(fresh), run)
        alive = state.select(*same, F.coalesce(RUN, F.lit(run)).alias(RUN), F.lit(True).alias("alive"))
        # What no longer counts is kept in mind as long as its run has rows that do.
        dead = before.filter("NOT alive").drop("alive").unionByName(gone.select(*same, RUN))
        dead = dead.join(alive.select(RUN).distinct(), RUN, "left_semi").withColumn("alive", F.lit(False))
        self._commit(alive.unionByName(dead.select(alive.columns)), version + 1)
        if self.files().select(RUN).distinct().count() > MOST_RUNS:
            self.compact()
        return self.rows()

    def compact(self) -> None:
        """Writes the rows that count together, as one run."""
        version, entries = self._log()
        run = uuid.uuid4().hex
        self._write(self.rows().drop(RUN), run)
        self._commit(entries.filter("alive").withColumn(RUN, F.lit(run)), version + 1)

    def _write(self, rows: DataFrame, run: str) -> None:
        # Kept rows hold whole texts: zstd writes a third less of them than snappy.
        rows.withColumn(RUN, F.lit(run)).write.option("compression", "zstd").parquet(f"{self.path}/rows/{run}")

    def _commit(self, entries: DataFrame, version: int) -> None:
        n = entries.count() + 1
        head = self.spark.createDataFrame([(None, None, None, None, None)], "input_file string, bytes bigint, changed timestamp, stage_run string, alive boolean")
        # Each version is a folder of its own, which must not be there yet.
        entries.unionByName(head).withColumn("n_entries", F.lit(n).cast("bigint")).coalesce(1).write.parquet(f"{self.path}/log/version={version}")

    def rows(self) -> DataFrame:
        """The rows of all files that count, with ``input_file`` and ``stage_run``."""
        _, entries = self._log()
        runs = [r[0] for r in entries.filter("alive").select(RUN).distinct().collect()]
        if not runs:
            nothing = self.mapped([])
            return nothing.withColumn(RUN, F.lit(None).cast("string")).filter("false")
        rows = self.spark.read.parquet(*[f"{self.path}/rows/{r}" for r in sorted(runs)])
        dead = entries.filter("NOT alive").select(FILE, RUN)
        return rows if dead.isEmpty() else rows.join(dead, [FILE, RUN], "left_anti")
