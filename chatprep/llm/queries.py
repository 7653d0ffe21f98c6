"""The operators over the given tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chatprep.llm import decontamination, language, line_dedup, merkle, mixing, near_dedup, quality, secrets, spelling
from chatprep.llm import token_counts, token_files, toxicity, url_filter
from chatprep.sources.stages import scratch, scratch_path, shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The documents drawn to the tempered marginals of source, language and topic."""
    drawn = mixing.sampled(_table(spark, folder, "documents"), keep_text=False)
    return drawn.select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_probability", 6).alias("probability"),
    )


def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.groups(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold half of a benchmark item or a long part of it, with their tiles."""
    return decontamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_quality_forest(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality.rated(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    made = line_dedup.deduped(docs)
    return made.select("doc_id", "text", F.col("removed_lines").cast("long").alias("removed_lines"))


#: Longer rules hold before shorter ones; what no rule fits is allowed.
URL_RULES = (
    url_filter.Rule("net", "/"),
    url_filter.Rule("example.net", "/en/", allow=True),
    url_filter.Rule("example.com", "/de/"),
    url_filter.Rule("org", "/fr/", allow=True),
)


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(_table(spark, folder, "pages"), URL_RULES)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = language.held_out(F.col("doc_id"))
    model = toxicity.train(docs.filter(~held_out), _table(spark, folder, "labels"))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_sentences", "offending")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A change feed over the documents: all come in, toxic ones are deleted, and those of
    low quality are revised to their text without marks. The last batch is committed twice."""
    docs = _table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    labels = _table(spark, folder, "labels")
    plain = docs.withColumn("text", F.regexp_replace("text", "[#*$%&!|]+", ""))
    # Counted before anything is joined, so no text moves.
    counted = scratch(token_counts.changes(docs, "insert"), "tokens-counted")
    revised = scratch(token_counts.changes(plain, "revise"), "tokens-revised")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    low = labels.filter("quality = 0 AND toxic = 0").select("doc_id").distinct()
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    rollup.commit(1, counted)
    rollup.commit(2, counted.join(toxic, "doc_id", "left_semi").withColumn("operation", F.lit("delete")))
    for _ in range(2):
        rollup.commit(3, revised.join(low, "doc_id", "left_semi"))
    return rollup.totals()


def _of_kind(kind: str):
    return F.filter("found", lambda x: x["kind"] == kind)


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    ledger = secrets.Ledger.fresh(spark)
    ledger.scan(docs)
    kinds = [r.kind for r in secrets.BASE]
    span = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind"].isin(kinds))
    return ledger.found_in(docs).select(
        "doc_id",
        *[F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.array_join(F.transform(base, span), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", span), ",").alias("spans"),
    )


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = language.held_out(F.col("doc_id"))
    filters = language.train(docs.filter(~held_out))
    return language.predicted(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as ids in coded files, and what reading the files back gives."""
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    token_files.write(_table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path, vocabulary=49408)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, some of them misspelt by rule, with the form each stands for."""
    words = spelling.word_counts(_table(spark, folder, "documents"), misspell=97)
    return spelling.variants(scratch(words, "spelling-words"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of the documents; every seventh (by a hash of its id) is presented with its
    ``n_chars`` raised by one, which its witness must not lead to the root."""
    docs = _table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    presented = merkle.leaf([shown if c == "n_chars" else F.col(c) for c in columns])
    made = merkle.folded(merkle.manifest(docs, columns, carried={"presented": presented}), "presented")
    hexed = F.array_join(F.transform("witness", lambda w: F.lower(F.hex(w))), "")
    return made.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(hexed.cast("binary"), 256).alias("proof_sha256"),
        "folded_root", F.col("folded_root").eqNullSafe(F.col("root")).alias("verified"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_url_filter, op3_toxicity, op4_minhash_near_dedup, op5_decontaminate, op6_quality_forest,
        op7_token_counts, op8_line_dedup, op9_secret_scan, op10_language, op11_token_files, op12_spelling_variants,
        op13_merkle_manifest,
    )
} | {"pipeline": corpus_pipeline.run}
