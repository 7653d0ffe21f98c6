"""The corpus pipeline: documents to a clean, deduplicated, mixed sample.

Each stage is written to the shared folder and read again before the next one works on
what it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm import decontamination, line_dedup, mixing, near_dedup, quality
from chatprep.sources.stages import scratch

#: Similarity in per cent from which the stage links; ``op4_minhash_near_dedup`` has its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the isolation forest reject."""
    return quality.rejecting(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of repeated three-line windows; ``n_chars`` follows the
    text. A document of which nothing but blanks is left goes."""
    removed = line_dedup.free_name("removed_lines", docs.columns)
    made = line_dedup.deduped(docs, removed_column=removed)
    touched = F.col(removed) > 0
    left = made.filter(~F.coalesce(touched & (line_dedup.line_count(F.col("text")) == 0), F.lit(False)))
    return left.select(
        *[
            F.when(touched, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c == "n_chars" else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.kept_documents(docs, percent=NEAR_PERCENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold half of a benchmark item or a long part of it."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn to the target weights, with topic, tokens and probability."""
    return mixing.sampled(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("near dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("mixing", target_mix),
]

#: SQL cannot grow an isolation forest; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
