"""Sources to role tables: map, truncate, filter, encode, route."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.operators import guards, profile, roles, vocab
from chatprep.plans import recipes
from chatprep.settings import ChatTokens
from chatprep.sources.collection import check_identity
from chatprep.sources.manifest import FILE, RUN, FileStage
from chatprep.sources.stages import finished, scratch, stage

#: How the map stage is stored; stages of another layout are not reused.
LAYOUT = "joined tokens"


class Prepared(NamedTuple):
    rows: DataFrame
    refused: DataFrame
    vocabulary: DataFrame
    reports: Mapping[str, DataFrame]


def _reports(kept: DataFrame, taken: DataFrame, routed: DataFrame, limits, max_length: int, train, seed: int) -> dict[str, DataFrame]:
    """What a run tells about itself. Each is computed when it is read, from the stored
    stages' columns of keys and lengths alone."""
    return {
        "warnings": roles.truncate_warnings(kept, limits),
        "histogram": profile.histogram(taken, roles.PLACE),
        "longest": roles.top_lengths(taken, max_length, train),
        "sizes": roles.size_report(kept, max_length, train, limits, seed),
        "role_histogram": profile.histogram(routed, ["role"]),
    }


def prepare(
    raw: DataFrame,
    recipe: str,
    tokens: ChatTokens,
    *,
    splits: Mapping[str, Sequence[str]],
    max_length: int,
    limits: Mapping[str, Mapping[str, int]] | None = None,
    do: Sequence[str] = roles.ROLE_NAMES,
    seed: int = 0,
    cache_dir: str | None = None,
    inputs: Sequence[str] = (),
    response: Sequence[str] | None = None,
    instruction: Sequence[str] | None = None,
) -> Prepared:
    """Role rows with ``input_ids`` and ``length``, the refused rows with their
    reason, the vocabulary of all rows that were not refused, and reports: limits without
    effect, lengths after truncation and by role, the longest rows, sizes before and after.
    With a ``response`` template, given as its tokens, rows that are not refused must hold
    it, the ``instruction`` template if there is one, and the begin and end marks; a row
    that does not is an error.

    The map stage is stored: everything after it reads single columns (key,
    length, reason), so truncation and filter never render a text again, and the
    length filter reaches the file scan. A row is known by source, split and row id; a
    null or repeated one is an error. Only rows that some role keeps are
    encoded, once, before they are routed. With ``cache_dir`` the stages are kept
    under a fingerprint of ``inputs``, the files and columns of ``raw`` and all settings,
    and reused by later runs. Files changed in place need other ``inputs``.
    """
    if cache_dir and not inputs:
        raise ValueError("a cache_dir needs inputs, which name the data the stages are kept for")
    # Spark gives every file it writes a name of its own, so other data has other files.
    data = [list(inputs), sorted(raw.inputFiles()), raw.schema.simpleString()]
    mapping = {"inputs": data, "recipe": recipe, "tokens": vars(tokens), "layout": LAYOUT}
    mapped = _store(raw.sparkSession, lambda: _mapped(raw, recipe, tokens), "map", mapping, cache_dir)
    return _routed(mapped, tokens, mapping, cache_dir, splits, max_length, limits, do, seed, response, instruction)


def prepare_files(
    spark: SparkSession,
    path: str | Sequence[str],
    read: Callable[[Sequence[str]], DataFrame],
    recipe: str,
    tokens: ChatTokens,
    *,
    cache_dir: str,
    splits: Mapping[str, Sequence[str]],
    max_length: int,
    name: str = "map",
    limits: Mapping[str, Mapping[str, int]] | None = None,
    do: Sequence[str] = roles.ROLE_NAMES,
    seed: int = 0,
    response: Sequence[str] | None = None,
    instruction: Sequence[str] | None = None,
) -> Prepared:
    """As ``prepare``, from the files below ``path`` and with a map stage that is brought up
    to them: ``read`` turns files into raw rows with ``manifest.file_of_row``, and only new
    and changed files are read. Vocabulary and ids follow if any file changed, and are
    taken as they are if none did. ``name`` names what ``read`` does: another reading of the
    same files needs another name.
    """
    params = {"recipe": recipe, "tokens": vars(tokens), "name": name, "layout": LAYOUT}
    kept = FileStage(spark, cache_dir, name, params, lambda files: _mapped(read(files), recipe, tokens))
    mapped = kept.update(path).drop(FILE, RUN)
    mapping = params | {"stage": kept.path, "version": kept.version()}
    return _routed(mapped, tokens, mapping, cache_dir, splits, max_length, limits, do, seed, response, instruction)


def _store(spark: SparkSession, made: Callable[[], DataFrame], name: str, params: dict, cache_dir: str | None) -> DataFrame:
    """What ``made`` gives, stored. It is not called for a stage that is there."""
    if not cache_dir:
        return scratch(made(), name)
    there = finished(spark, cache_dir, name, params)
    return stage(made(), cache_dir, name, params) if there is None else there


def _mapped(raw: DataFrame, recipe: str, tokens: ChatTokens) -> DataFrame:
    """Measured rows; the text of a row that is kept is not stored, its tokens are enough.
    They are stored as one text with blanks between, which they never hold: that is
    written, read and handed to Arrow several times faster than a list."""
    rows = recipes.apply(raw, recipe, tokens).withColumn("text", F.when(F.col("reason").isNotNull(), F.col("text")))
    return rows.withColumn("tokens", F.array_join("tokens", " "))


def _routed(mapped, tokens, mapping, cache_dir, splits, max_length, limits, do, seed, response, instruction) -> Prepared:
    """Everything after the map stage."""
    limits = dict(limits or {})
    routing = {"splits": dict(splits), "max_length": max_length, "limits": limits, "do": list(do), "seed": seed}
    key = [c for c in ("source", "split", "row_id") if c in mapped.columns]
    check_identity(mapped, key)
    kept = guards.kept(mapped).drop("text", "n_placeholders", "n_images", "reason")
    if response:
        vocab.require(kept, response, instruction, tokens.bos, tokens.eos, "tokens")
    spark = mapped.sparkSession
    words = _store(spark, lambda: vocab.build_vocab(kept, tokens.specials), "words", mapping, cache_dir)
    train = splits.get("train", ()) if "train" in do else ()
    taken = roles.truncate(kept, limits, seed)
    drawn = roles.length_filter(taken, max_length, train)
    wanted = {s for role in do for s in splits.get(role, ())}
    ids = _store(spark, lambda: vocab.encode(drawn.filter(drawn["split"].isin(*wanted)), words, key), "filter", mapping | routing, cache_dir)
    routed = roles.route(ids, splits, max_length, do)
    reports = _reports(kept, taken, routed, limits, max_length, train, seed)
    return Prepared(routed, guards.rejects(mapped), words, reports)
