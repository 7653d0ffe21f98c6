"""Token counts as delta-maintained rollups.

A change feed inserts, deletes or revises documents. Each batch becomes signed counts:
what its documents counted before goes out, what they count now comes in. The signed
rows are kept per document (the ledger) and, added up, per source, language and
tokenizer version (the rollup); totals are sums of the rollup. A batch is one folder
of each, written over as a whole, so committing it again changes nothing; it counts once a
row of the table of commits names it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm.hashing import slices
from chatprep.sources.stages import scratch

GROUP = ["source", "lang", "tokenizer"]
DELETE = "delete"

#: Tokenizer versions in SQL: words; and pieces, a run of letters, of up to three digits
#: or of other marks.
WORDS = "[^\\x20\\x09-\\x0D]+"
PIECES = "\\p{L}+|\\p{N}{1,3}|[^\\x20\\x09-\\x0D\\p{L}\\p{N}]+"
VERSIONS = {"words-1": WORDS, "pieces-1": PIECES}


def pattern_counts(text: Column, versions: Mapping[str, str] = VERSIONS) -> Column:
    """``map(version, tokens)`` of a text; a null text has no tokens."""
    parts = [x for name, p in versions.items() for x in (F.lit(name), F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("bigint"))]
    return F.create_map(*parts)


def file_counts(docs: DataFrame, id_column: str, text_column: str, path: str, version: str) -> DataFrame:
    """``(doc_id, tokenizer, tokens)`` by a tokenizer file of the ``tokenizers`` library,
    which has to lie at ``path`` on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        for part, values in slices(batches, "text"):
            made = own.encode_batch([(v or b"").decode() for v in values], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([version] * len(made)), pa.array([len(m.ids) for m in made], pa.int64())],
                names=["doc_id", "tokenizer", "tokens"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, tokenizer string, tokens bigint")


def changes(docs: DataFrame, operation: str, id_column: str = "doc_id", text_column: str = "text",
            versions: Mapping[str, str] = VERSIONS) -> DataFrame:
    """Change rows ``(doc_id, source, lang, tokenizer, tokens, operation)`` of documents."""
    return docs.select(
        F.col(id_column).alias("doc_id"), "source", "lang",
        F.explode(pattern_counts(F.col(text_column), versions)).alias("tokenizer", "tokens"),
        F.lit(operation).alias("operation"),
    )


class Rollup:
    """Ledger, rollup and commits below ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint"):
        group = "source string, lang string, tokenizer string"
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas = {
            "ledger": f"doc_id {id_type}, {group}, docs bigint, tokens bigint, batch bigint",
            "rollup": f"{group}, docs bigint, tokens bigint, batch bigint",
            "commits": "ledger_rows bigint, batch bigint",
        }
        for name, schema in self.schemas.items():
            # An empty table, so that reading needs no special case.
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch").parquet(f"{self.folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def _committed(self, name: str) -> DataFrame:
        return self._read(name).join(self._read("commits").select("batch"), "batch", "left_semi")

    def ledger(self) -> DataFrame:
        """The signed rows of all committed batches."""
        return self._committed("ledger")

    def commit(self, batch: int, feed: DataFrame, sequence: str | None = None) -> None:
        """Takes in the change rows of one batch: ``insert`` and ``revise`` give the counts
        a document now has for a tokenizer version, ``delete`` takes its counts away.

        Of several rows of a batch for one document and tokenizer version the last counts,
        by the feed's column ``sequence``; of those with the largest number, and of all if
        no column is named, a delete goes before the others, then the largest tokens, source
        and language. So a repeated row counts once. A document that is inserted again counts
        once; deleting an unknown document does nothing. Rows with a null id are taken as one
        document. Null sources and languages are values of their own; null tokens are none.

        Committing the latest batch again, after a failure or by mistake, replaces it as a
        whole, also by an empty feed. A batch below the latest one is refused with
        ``ValueError``, as later ones have been set against what was there. A commit that
        stops on its way leaves totals as they were, or without its batch if it was made
        before, until it is committed again.
        """
        latest = self._read("commits").agg(F.max("batch")).first()[0]
        if latest is not None and batch < latest:
            raise ValueError(f"batch {batch} comes after batch {latest} has been committed")
        order = F.col(sequence) if sequence else F.lit(0)
        last = F.max(F.struct(
            order.alias("at"), (F.col("operation") == DELETE).alias("gone"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "source", "lang"
        ))
        latest_rows = feed.groupBy("doc_id", "tokenizer").agg(last.alias("x")).select(
            F.col("doc_id").alias("k_id"), F.col("tokenizer").alias("k_tokenizer"), "x.gone", "x.tokens", "x.source", "x.lang"
        )
        # Read for what was there before and for what is there now.
        now = scratch(latest_rows, "tokens-now")
        changed = F.col("doc_id").eqNullSafe(F.col("k_id")) & F.col("tokenizer").eqNullSafe(F.col("k_tokenizer"))
        known = self.ledger().filter(F.col("batch") < batch)
        before = known.join(now.select("k_id", "k_tokenizer"), changed, "left_semi").select(
            "doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")
        )
        after = now.filter("NOT gone").select(
            F.col("k_id").alias("doc_id"), "source", "lang", F.col("k_tokenizer").alias("tokenizer"), F.lit(1).cast("bigint").alias("docs"), "tokens"
        )
        signed = (
            before.unionByName(after).groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .filter("docs != 0 OR tokens != 0")
        )
        self._put(signed, "ledger", batch)
        own = self._read("ledger").filter(F.col("batch") == batch)
        self._put(own.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "rollup", batch)
        self._put(own.agg(F.count(F.lit(1)).alias("ledger_rows")), "commits", batch)

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` of what is there after all batches."""
        rows = self._committed("rollup")
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0 OR tokens != 0")
