"""Times the headline queries; prints one JSON line.

Each query writes its whole result to Spark's ``noop`` sink, so nothing is
skipped and nothing is collected. Each query runs twice; ``queries`` and
``value`` are wall clock of the second run, ``first_run`` includes class loading
and compilation.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from chatprep import settings as S  # noqa: E402
from chatprep.operators import batches, packing, profile, vocab  # noqa: E402
from chatprep.plans import packed, queries, recipes  # noqa: E402
from chatprep.sources import fixtures  # noqa: E402
from chatprep.sources.collection import DEAL_OUT  # noqa: E402
from chatprep.sources.stages import scope, scratch  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("chatprep-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config(DEAL_OUT, CPUS)  # the tables lie in one file each
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def captions_measured(spark: SparkSession) -> DataFrame:
    return recipes.apply(fixtures.captions(spark, FOLDER), "caption", S.TOKENS)


def vocabulary(spark: SparkSession) -> DataFrame:
    return vocab.build_vocab(captions_measured(spark), S.TOKENS.specials)


def encoded(spark: SparkSession) -> DataFrame:
    """Vocabulary and ids of every caption."""
    rows = scratch(captions_measured(spark).select("row_id", "tokens", "length"), "tokens")
    return vocab.encode(rows, vocab.build_vocab(rows, S.TOKENS.specials))


def packs(spark: SparkSession) -> DataFrame:
    """Lengths to placed rows to packs that hold their captions."""
    rows, _, placed = queries._placed(spark, FOLDER)
    texts = fixtures.captions(spark, FOLDER).select("row_id", "caption", "image_refs")
    return packing.gather(texts, placed)


HEADLINES = {
    "render_captions": lambda s: captions_measured(s),
    "render_chat": lambda s: recipes.apply(fixtures.chat(s, FOLDER), "chat", S.TOKENS),
    "fitting_chat": lambda s: packed.fitting_chat(s, FOLDER),
    "vocabulary": vocabulary,
    "encode": encoded,
    "truncate": lambda s: queries.truncate_sources(s, FOLDER),
    "histogram": lambda s: profile.histogram(fixtures.lengths(s, FOLDER), ["source", "split"], S.BINS, S.BAR_WIDTH),
    "batches_by_length": lambda s: batches.by_length(fixtures.lengths(s, FOLDER), S.BATCH_SIZE, S.MEGA_BATCHES, S.SEED, S.EPOCH),
    "pack": packs,
    "packed_chat": lambda s: packed.packed_chat(s, FOLDER),
}


def main() -> None:
    spark = session()
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    spark.read.parquet(f"{FOLDER}/documents.parquet").agg(F.sum(F.length("text"))).collect()
    wanted = sys.argv[1:] or list(HEADLINES)
    runs: list[dict[str, float]] = [{}, {}]
    for run in runs:
        for name in wanted:
            start = time.perf_counter()
            with scope(spark):
                HEADLINES[name](spark).write.format("noop").mode("overwrite").save()
            run[name] = round(time.perf_counter() - start, 3)
    first, times = runs
    fill = None
    if not sys.argv[1:]:
        # How full the packs of the caption lengths are.
        _, _, placed = queries._placed(spark, FOLDER)
        made = packing.summary(queries._per_pack(placed), S.MAX_LENGTH).first()
        fill = round(made["fill_rate"], 4)
    print(
        json.dumps(
            {
                "metric": "chat data preparation, total of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first_run": first,
                "sf": Path(FOLDER).name.removeprefix("sf"),
                "pack_fill_rate": fill,
            }
        )
    )


if __name__ == "__main__":
    main()
