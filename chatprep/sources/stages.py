"""Stages written to shared storage: reused by fingerprint, or scratch."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Paths of scratch tables, one list for each open scope and one for what is outside.
_scopes: list[list[str]] = [[]]


def fingerprint(params: dict) -> str:
    """Every parameter counts, so two recipes never share a stage."""
    text = json.dumps(params, sort_keys=True, ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:20]


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its success marker; works on any file
    system Spark can reach."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    conf = spark._jsc.hadoopConfiguration()
    return marker.getFileSystem(conf).exists(marker)


def _stage_path(root: str, name: str, params: dict) -> str:
    return f"{root.rstrip('/')}/{name}-{fingerprint(params)}"


def stage(df: DataFrame, root: str, name: str, params: dict) -> DataFrame:
    """``df`` as written under ``root``; a finished stage with the same name and
    parameters is read back instead of computed again. ``params`` must name the
    inputs as well as the settings."""
    path = _stage_path(root, name, params)
    if not is_complete(df.sparkSession, path):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, root: str, name: str, params: dict) -> DataFrame | None:
    """The stage of this name and parameters if it is there. Asked before the rows are planned
    at all: building a vocabulary or ids runs jobs of its own before the first row is written."""
    path = _stage_path(root, name, params)
    return spark.read.parquet(path) if is_complete(spark, path) else None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a local session may
    fall back on a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="chatprep-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: lineage ends here, later branches read
    only the columns they need, and they all see the same rows."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for a scratch table that is written in parts."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> int:
    conf = spark._jsc.hadoopConfiguration()
    count = len(paths)
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside go at its end, and no others; whatever reads them
    has to be stored by then."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        _delete(spark, own)


def release(spark: SparkSession) -> int:
    """Deletes the scratch tables written outside any scope, once results are stored;
    gives their number."""
    return _delete(spark, _scopes[0])
