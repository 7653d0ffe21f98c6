"""Reading a collection of named sources."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions import headers
from chatprep.functions.images import first_image
from chatprep.sources.ids import KEY, IdDictionary, own_id

# Own ids of one path lie from 0 to below this; others are refused with an error.
ROWS_PER_SOURCE = 1 << 40


# Session setting for tables that lie in fewer row groups than there are cores: the
# number of tasks to deal their rows out to. Unset, tables are read where they lie.
DEAL_OUT = "spark.chatprep.dealOut"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, dealt out by ``keys`` if the session asks for it, whatever its size."""
    parts = df.sparkSession.conf.get(DEAL_OUT, None)
    return df.repartition(int(parts), *keys) if parts else df


@dataclass(frozen=True)
class Source:
    """Where a source lies and how its columns are called.

    ``path`` is one path, or a path per split. ``split`` gives the split of a row
    where one path holds several. A subset is a value of ``subset_column``, or a
    folder below the path when no column is named. ``row_id`` names one column of
    numbers; with a dictionary of ids, also a column of texts or several columns.
    """

    path: str | Mapping[str, str]
    columns: Mapping[str, str | Column] = field(default_factory=dict)
    row_id: str | Sequence[str] | None = None
    split: Column | None = None
    subset_column: str | None = None
    format: str = "parquet"


def _read(spark: SparkSession, source: Source, path: str, subset: str | None) -> DataFrame:
    reader = spark.read.format(source.format)
    if subset is None:
        return reader.load(path)
    if source.subset_column is None:
        return reader.load(f"{path.rstrip('/')}/{subset}")
    return reader.load(path).filter(F.col(source.subset_column) == subset)


def _paths(source: Source) -> Mapping[str | None, str]:
    return source.path if isinstance(source.path, Mapping) else {None: source.path}


def _checked_id(name: str, own: Column, place: int) -> Column:
    """An id of the collection; a null or too large own id stops the job when it is read."""
    fits = (own >= 0) & (own < ROWS_PER_SOURCE)
    said = F.concat(F.lit(f"row id of source {name} is null or not below 2^40: "), F.coalesce(own.cast("string"), F.lit("null")))
    return F.when(fits, F.lit(place * ROWS_PER_SOURCE).cast("long") + own).otherwise(F.raise_error(said).cast("long"))


def _id_columns(source: Source) -> list[str]:
    return [source.row_id] if isinstance(source.row_id, str) else list(source.row_id or ())


def _one(spark: SparkSession, name: str, place: int, first: int, source: Source, subset: str | None,
         by_dictionary: bool) -> DataFrame:
    """``first`` numbers the source's first path among all paths of the collection."""
    tables = []
    for at, (split, path) in enumerate(_paths(source).items(), first):
        df = _read(spark, source, path, subset)
        named = {k: (F.col(v) if isinstance(v, str) else v) for k, v in source.columns.items()}
        chosen = [c.alias(k) for k, c in named.items()] or [
            F.col(c) for c in df.columns if c not in (*_id_columns(source), "source", "split")
        ]
        if source.row_id and by_dictionary:
            chosen += [F.lit(split or "").alias("__path_split"), own_id(name, _id_columns(source)).alias("__own")]
        elif source.row_id:
            if len(_id_columns(source)) > 1:
                raise ValueError(f"source {name} has an id of several columns, which takes a dictionary of ids")
            own = F.col(_id_columns(source)[0]).cast("long")
            chosen.insert(0, _checked_id(name, own, at).alias("row_id"))
        where = F.lit(split) if split is not None else (source.split if source.split is not None else F.lit("train"))
        tables.append(
            df.select(
                F.lit(name).alias("source"),
                F.lit(place).alias("source_ord"),
                where.alias("split"),
                *chosen,
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def load(
    spark: SparkSession,
    sources: Mapping[str, Source | str],
    subset: Mapping[str, str] | None = None,
    ids: IdDictionary | None = None,
) -> DataFrame:
    """All sources in list order as one table with ``source``, ``source_ord``,
    ``split`` and, where a source names its id column, a ``row_id`` that sorts by
    source and path, then by the own id. Ids that are unique in each path are unique in
    the collection, also where the files of several splits each count from 1. An own id
    that is null, negative or 2^40 and more is an error.

    With ``ids``, own ids may be texts or several columns, of any number and size: the
    dictionary is extended by those it has not seen, and ``row_id`` is their number there.
    It then sorts by the run that first saw a row, by source name, split and own id."""
    picked, tables, plain, first = subset or {}, [], [], 0
    for i, (name, s) in enumerate(sources.items()):
        source = s if isinstance(s, Source) else Source(s)
        made = _one(spark, name, i, first, source, picked.get(name), ids is not None)
        # What has no ids meets nothing in the dictionary.
        (tables if ids is None or source.row_id else plain).append(made)
        first += len(_paths(source))
    if ids is not None and tables:
        keyed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        key = ["source", "__path_split", "__own"]
        known = ids.extend(keyed.select(*[F.col(a).alias(b) for a, b in zip(key, KEY)])).toDF(*key, "row_id")
        tables = [keyed.join(known, key).drop("__path_split", "__own")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables + plain)


def check_identity(rows: DataFrame, key: Sequence[str]) -> None:
    """Raises if a key is null or names several rows: their contents would be mixed."""
    bad = rows.groupBy(*key).count().filter(
        (F.col("count") > 1) | reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    )
    found = bad.limit(3).collect()
    if found:
        raise ValueError(f"rows are not told apart by {', '.join(key)}: {[r.asDict() for r in found]}")


def attach_sizes(df: DataFrame, sizes: DataFrame, key: str = "row_id") -> DataFrame:
    """``df`` with ``image_size`` of each row's first reference in ``image_refs``; null for
    rows without one and for references that ``sizes`` ``(image_ref, image_size)`` does not
    hold. ``sizes`` has to name each reference once.

    Rows without an image meet nothing and are spread by ``key`` instead of meeting in one
    task. Neither side is aggregated on the way, so AQE can split a common reference.
    """
    check_identity(sizes, ["image_ref"])
    known = sizes.select(F.struct(F.lit(True), "image_ref").alias("__ref"), "image_size")
    first = first_image(F.col("image_refs"))
    apart = F.struct(F.lit(False), F.coalesce(F.xxhash64(key).cast("string"), F.lit("")))
    ref = F.when(first.isNotNull(), F.struct(F.lit(True), first)).otherwise(apart)
    return df.withColumn("__ref", ref).join(known, "__ref", "left").drop("__ref")


def image_sizes(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``(image_ref, image_size)`` of the files under ``path``, from their headers.

    Spark lists the files; tasks open each and read the blocks that the header takes, no
    pixels. That needs a file system that pyarrow can open (local, HDFS, S3, GCS); with
    ``whole_files`` Spark reads the files instead, on any file system. PNG, GIF and JPEG
    are known; other files and broken headers get a null size. Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            refs = batch.column("path").to_pylist()
            if whole_files:
                for content in batch.column("content"):
                    view = content.as_buffer()
                    found.append(headers.image_size(lambda at, n, view=view: view[at : at + n].to_pybytes()))
            else:
                for ref in refs:
                    if ref.startswith("file:"):  # Spark gives names as they are, not as a URI writes them
                        system, inside = pa_fs.LocalFileSystem(), "/" + ref[5:].lstrip("/")
                    else:
                        system, inside = pa_fs.FileSystem.from_uri(quote(ref, safe=":/@"))
                    with system.open_input_file(inside) as f:
                        size = f.size()
                        fetch = lambda at, n, f=f, size=size: f.read_at(min(n, size - at), at) if at < size else b""
                        found.append(headers.image_size(headers.blocks(fetch)))
            sizes = [s and {"height": s[0], "width": s[1]} for s in found]
            kind = pa.struct([("height", pa.int32()), ("width", pa.int32())])
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(sizes, kind)], names=["image_ref", "image_size"])

    listed = files.select("path", "content") if whole_files else files.select("path")
    return listed.mapInArrow(run, "image_ref string, image_size struct<height:int,width:int>")
