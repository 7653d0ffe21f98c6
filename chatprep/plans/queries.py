"""One query per operator over the given tables.

Array columns are joined to text so that any engine can compare them; counts and
sums are cast where engines differ in width.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep import settings as S
from chatprep.functions import content, images, tokens as tok
from chatprep.operators import batches, guards, ordering, packing, profile, render, roles, vocab
from chatprep.plans import packed, recipes
from chatprep.plans.prepare import prepare, prepare_files
from chatprep.sources.collection import ROWS_PER_SOURCE, Source, load
from chatprep.sources import collection, fixtures
from chatprep.sources.ids import IdDictionary
from chatprep.sources.fixtures import LIMITS, SPLITS
from chatprep.sources.manifest import file_of_row
from chatprep.sources.stages import scratch, scratch_path
from chatprep.streaming import arrivals, committed

# Queries that need no text of a whole conversation use sums over its turns.
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def flat(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), " ")


# Sources


@query
def load_sources(spark, folder):
    rows = collection.load(spark, fixtures.collection(folder))
    return rows.select("source", "source_ord", "split", "row_id", "text", "lang", "role")


@query
def load_subset(spark, folder):
    picked = {"captions": "en", "turns": "user"}
    rows = collection.load(spark, fixtures.collection(folder), picked)
    return rows.groupBy("source", "split").agg(
        F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars")
    )


# Content and template


@query
def caption_to_chat(spark, folder):
    rows = render.caption_to_chat(fixtures.captions(spark, folder))
    return rows.select(
        "row_id",
        F.size("messages").alias("n_messages"),
        *[
            F.col("messages")[i][k].alias(f"{k}_{i}")
            for i in (0, 1)
            for k in ("role", "content")
        ],
    )


def _mixed_content(spark, folder) -> DataFrame:
    """Turns whose content takes each JSON kind in turn."""
    rows = fixtures.table(spark, folder, "conversations")
    number = F.col("conv_id").cast("string")
    boxed = F.to_json(F.array("text"))
    as_string = F.substring(boxed, F.lit(2), F.length(boxed) - 2)
    kind = (F.col("conv_id") + F.col("turn")) % 8
    listed = F.to_json(
        F.array(content.part("image"), content.part("text", F.concat(F.lit("  "), "text", F.lit("\t"))))
    )
    made = (
        F.when(kind == 0, as_string)
        .when(kind == 1, number)
        .when(kind == 2, F.concat(number, F.lit(".50")))
        .when(kind == 3, F.when(F.col("turn") % 2 == 0, "true").otherwise("false"))
        .when(kind == 4, listed)
        .when(kind == 5, F.lit("[]"))
        .when(kind == 6, F.lit('{"a":1}'))
        .otherwise(F.when(F.col("turn") % 2 == 0, "null").otherwise(F.col("text")))
    )
    return rows.select("conv_id", "turn", "role", made.alias("content"))


def _parsed_turns(rows: DataFrame, **flags) -> DataFrame:
    parsed = rows.withColumn("messages", F.array(F.struct("role", "content")))
    return render.parse_content(parsed, **flags).withColumn("parts", F.col("parsed")[0]["parts"])


def _shown(parts: Column) -> Column:
    return F.array_join(
        F.transform(parts, lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], F.lit("")))),
        "|",
    )


@query
def parse_content(spark, folder):
    rows = _mixed_content(spark, folder)
    rows = rows.withColumn("kind", content.content_kind(F.col("content")))
    return _parsed_turns(rows).select("conv_id", "turn", "kind", _shown(F.col("parts")).alias("parts"))


@query
def numeric_content(spark, folder):
    """Numbers as text where the recipe converts them, refused where not."""
    rows = _mixed_content(spark, folder)
    rows = rows.filter(content.content_kind(F.col("content")).isin("number", "bool"))
    raw = _parsed_turns(rows, numeric_to_text=False).select(
        "conv_id", "turn", "role", "content", F.col("parts").isNull().alias("raw_refused")
    )
    return _parsed_turns(raw).select(
        "conv_id", "turn", F.col("parts")[0]["text"].alias("text"), "raw_refused"
    )


@query
def strip_parts(spark, folder):
    rows = _mixed_content(spark, folder)
    rows = rows.filter(content.content_kind(F.col("content")) == "list")
    return _parsed_turns(rows, strip_parts=True).select(
        "conv_id", "turn", _shown(F.col("parts")).alias("parts")
    )


def _rendered(spark, folder, **flags) -> DataFrame:
    rows = render.parse_content(fixtures.chat(spark, folder))
    return render.render_chat(rows, S.TOKENS, **flags).select("row_id", "text")


@query
def render_chat(spark, folder):
    return _rendered(spark, folder)


@query
def render_without_answer(spark, folder):
    return _rendered(spark, folder, include_last=False)


@query
def render_prompt(spark, folder):
    return _rendered(spark, folder, open_assistant=True)


# Images and lengths


def _measured(spark, folder) -> DataFrame:
    return recipes.chat(fixtures.chat(spark, folder), S.TOKENS)


@query
def count_placeholders(spark, folder):
    return packed.judged_chat(spark, folder).select("row_id", "n_placeholders")


@query
def count_images(spark, folder):
    return fixtures.chat(spark, folder).select(
        "row_id", images.count_images(F.col("image_refs")).alias("n_images")
    )


@query
def first_image(spark, folder):
    return fixtures.chat(spark, folder).select(
        "row_id", images.first_image(F.col("image_refs")).alias("first_image")
    )


@query
def token_length(spark, folder):
    return packed.judged_chat(spark, folder).select("row_id", "length")


@query
def expanded_length(spark, folder):
    longer = images.expanded_length(
        F.col("length"), F.col("n_placeholders"), S.IMAGE_SIZE, S.PATCH_SIZE
    )
    return packed.judged_chat(spark, folder).select("row_id", longer.alias("expanded_length"))


@query
def output_columns(spark, folder):
    """Only declared columns leave the map stage; every source column is gone."""
    rows = fixtures.chat(spark, folder).withColumn("unused", F.lit(1))
    made = guards.kept(guards.settled(recipes.chat(rows, S.TOKENS)))
    return made.select(
        "row_id",
        "length",
        flat(F.col("image_refs")).alias("image_refs"),
        F.lit(" ".join(sorted(made.columns))).alias("columns"),
    )


# Guards


@query
def drop_image_mismatch(spark, folder):
    rows = packed.judged_chat(spark, folder)
    bad = guards.image_mismatch(F.col("n_placeholders"), F.col("n_images"))
    return rows.filter(~bad).select("row_id", "n_placeholders", "n_images")


@query
def drop_orphan_placeholder(spark, folder):
    rows = packed.judged_chat(spark, folder)
    bad = guards.orphan_placeholder(F.col("n_placeholders"), F.col("n_images"))
    return rows.filter(~bad).select("row_id", "n_placeholders", "n_images")


@query
def reject_report(spark, folder):
    return guards.rejects(packed.judged_chat(spark, folder)).groupBy("reason").agg(F.count("*").alias("n"))


# Recipes


def _recipe_result(rows: DataFrame, *extra) -> DataFrame:
    return rows.select("row_id", "text", "length", "reason", *extra)


def _area(rows: DataFrame) -> tuple[Column, Column]:
    return (
        F.col("image_size.height").alias("height"),
        F.col("image_size.width").alias("width"),
    )


@query
def recipe_caption(spark, folder):
    rows = recipes.apply(fixtures.captions(spark, folder), "caption", S.TOKENS)
    return _recipe_result(rows, "source", "split")


@query
def recipe_chat(spark, folder):
    return _recipe_result(recipes.apply(fixtures.chat(spark, folder), "chat", S.TOKENS))


def _mixed_chat(spark, folder) -> DataFrame:
    """Conversations with numbers, flags, lists and broken JSON among the turns."""
    size = F.struct(
        (F.lit(224) + F.col("conv_id") % 4).cast("int").alias("height"),
        (F.lit(224) + F.col("conv_id") % 5).cast("int").alias("width"),
    )
    chats = render.chat_from_turns(_mixed_content(spark, folder))
    return fixtures.with_images(chats).withColumn("image_size", size)


@query
def recipe_chat_sized(spark, folder):
    rows = recipes.apply(_mixed_chat(spark, folder), "chat_sized", S.TOKENS)
    return _recipe_result(rows, *_area(rows))


@query
def attach_image_sizes(spark, folder):
    """Captions with the size of their first image, from a table of sizes; some images
    have none there, a third of all rows share one image, and some have no image."""
    rows = fixtures.captions(spark, folder)
    shared = F.when(F.col("row_id") % 3 == 0, F.array(F.lit("doc-shared")))
    none = F.when(F.col("row_id") % 7 == 1, F.array().cast("array<string>"))
    rows = rows.withColumn("image_refs", F.coalesce(shared, none, F.col("image_refs"))).select("row_id", "image_refs")
    number = F.regexp_extract("image_ref", "[0-9]+", 0).try_cast("int")
    sizes = (
        rows.select(F.explode("image_refs").alias("image_ref")).distinct()
        .withColumn("k", F.coalesce(number, F.lit(0))).filter("k % 5 != 4")
        .select("image_ref", F.struct((F.col("k") % 4 + 224).alias("height"), (F.col("k") % 5 + 224).alias("width")).alias("image_size"))
    )
    made = collection.attach_sizes(rows, scratch(sizes, "sizes"))
    return made.select("row_id", *_area(made))


@query
def recipe_chat_sized_raw(spark, folder):
    rows = recipes.apply(_mixed_chat(spark, folder), "chat_sized_raw", S.TOKENS)
    return _recipe_result(rows, *_area(rows))


@query
def custom_recipe(spark, folder):
    """A caller's own batch function that drops rows and changes the columns."""

    def longest_word(batch, least):
        words = batch["caption"].str.split()
        sizes = words.map(lambda ws: max((len(w) for w in ws), default=0))
        out = batch[["row_id"]].assign(longest=sizes.astype("int32"))
        return out[out["longest"] >= least]

    rows = fixtures.captions(spark, folder).select("row_id", "caption")
    return recipes.custom(rows, longest_word, "row_id bigint, longest int", least=10)


# Tokens


@query
def build_vocab(spark, folder):
    return vocab.build_vocab(_measured(spark, folder), S.TOKENS.specials)


def _encoded(spark, folder) -> DataFrame:
    rows, _ = packed.encoded_chat(spark, folder)
    return rows


@query
def encode_tokens(spark, folder):
    rows = _encoded(spark, folder)
    return rows.select("row_id", "length", flat(F.col("input_ids")).alias("input_ids"))


@query
def position_ids(spark, folder):
    rows = _measured(spark, folder)
    return rows.select("row_id", flat(tok.position_ids(F.col("tokens"))).alias("position_ids"))


@query
def response_labels(spark, folder):
    return _encoded(spark, folder).select("row_id", flat(F.col("labels")).alias("labels"))


@query
def check_templates(spark, folder):
    rows = _measured(spark, folder)
    found = vocab.check(
        rows, S.RESPONSE_TEMPLATE, S.INSTRUCTION_TEMPLATE, S.TOKENS.bos, S.TOKENS.eos, "tokens"
    )
    return found.select("n_rows", "missing_response", "missing_instruction")


@query
def check_bos_eos(spark, folder):
    """Prompts end in an open assistant turn, so they lack the end mark."""
    prompts = render.rendered_length(_rendered(spark, folder, open_assistant=True), S.TOKENS)
    rows = prompts.unionByName(_measured(spark, folder).select(*prompts.columns))
    found = vocab.check(rows, S.RESPONSE_TEMPLATE, None, S.TOKENS.bos, S.TOKENS.eos, "tokens")
    return found.select("n_rows", "missing_bos", "missing_eos")


@query
def label_coverage(spark, folder):
    rows = _encoded(spark, folder).withColumn("__kept", tok.labelled(F.col("labels")))
    return rows.select("row_id", F.size("__kept").alias("n_labels"), flat(F.col("__kept")).alias("labels"))


# Roles


@query
def truncate_sources(spark, folder):
    rows = fixtures.lengths(spark, folder)
    return roles.truncate(rows, LIMITS, S.SEED).select("source", "split", "row_id", "length")


@query
def truncate_warnings(spark, folder):
    return roles.truncate_warnings(fixtures.lengths(spark, folder), LIMITS)


@query
def length_filter(spark, folder):
    rows = roles.length_filter(fixtures.lengths(spark, folder), S.MAX_LENGTH, SPLITS["train"])
    return rows.select("row_id", "split", "length")


@query
def route_splits(spark, folder):
    routed = roles.route(fixtures.lengths(spark, folder), SPLITS, S.MAX_LENGTH)
    return routed.select("role", "source", "split", "row_id", "length")


@query
def concat_roles(spark, folder):
    """Captions and conversations of one role as one table in source order."""
    first = fixtures.lengths(spark, folder).withColumn("source_ord", F.lit(0))
    second = (
        packed.judged_chat(spark, folder)
        .filter(F.col("reason").isNull())
        .select("row_id", "length", "n_images")
        .withColumn("source", F.lit("chats"))
        .withColumn("split", F.lit("train"))
        .withColumn("source_ord", F.lit(1))
    )
    joined = roles.route(roles.concat([first, second]), SPLITS, S.MAX_LENGTH)
    return joined.select("role", "source_ord", "source", "split", "row_id", "length", "n_images")


@query
def top_lengths(spark, folder):
    return roles.top_lengths(
        fixtures.lengths(spark, folder), S.MAX_LENGTH, SPLITS["train"], S.TOP_LENGTHS
    )


@query
def size_report(spark, folder):
    return roles.size_report(
        fixtures.lengths(spark, folder), S.MAX_LENGTH, SPLITS["train"], LIMITS, S.SEED
    )


@query
def prepared_roles(spark, folder):
    """Captions through all preprocessing steps to their roles."""
    made = prepare(
        fixtures.captions(spark, folder), "caption", S.TOKENS,
        splits=SPLITS, max_length=S.MAX_LENGTH, limits=LIMITS, seed=S.SEED,
    )
    return made.rows.select(
        "role", "source", "split", "row_id", "length", flat(F.col("input_ids")).alias("input_ids")
    )


@query
def staged_roles(spark, folder):
    """Captions that arrive in two lots: the second run of the map stage reads the files of
    the second lot alone, a third run reads none."""
    path, cache = scratch_path(spark, "staged-captions"), scratch_path(spark, "staged")
    rows = fixtures.captions(spark, folder)

    def read(files):
        if not files:
            return spark.createDataFrame([], rows.schema).withColumn("input_file", F.lit(""))
        return spark.read.schema(rows.schema).parquet(*files).select("*", file_of_row())

    for lot in (F.col("row_id") % 2 == 0, F.col("row_id") % 2 == 1, None):
        if lot is not None:
            rows.filter(lot).write.mode("append").parquet(path)
        made = prepare_files(
            spark, path, read, "caption", S.TOKENS, cache_dir=cache,
            splits=SPLITS, max_length=S.MAX_LENGTH, limits=LIMITS, seed=S.SEED,
        )
    return made.rows.select(
        "role", "source", "split", "row_id", "length", flat(F.col("input_ids")).alias("input_ids")
    )


@query
def stream_equals_batch(spark, folder):
    """Conversations that arrive as a stream of files, kept in committed batches and encoded
    after the stream has stopped."""
    arrived = scratch(fixtures.chat(spark, folder), "stream-source")
    incoming = arrivals.arriving(spark, arrived.inputFiles()[0].rsplit("/", 1)[0], arrived.schema, files_per_batch=4)
    sink = committed.CommittedBatches(spark, scratch_path(spark, "stream-out"))
    stream = committed.write_arrivals(incoming, "chat", S.TOKENS, S.MAX_LENGTH, sink, scratch_path(spark, "stream-checkpoint"))
    stream.awaitTermination()
    rows = sink.encode(vocab.build_vocab(sink.rows(), S.TOKENS.specials))
    return rows.select("row_id", "length", flat(F.col("input_ids")).alias("input_ids"))


@query
def prepared_reports(spark, folder):
    """The reports of a whole run, with the templates required."""
    made = prepare(
        fixtures.captions(spark, folder), "caption", S.TOKENS, splits=SPLITS, max_length=S.MAX_LENGTH,
        limits=LIMITS, seed=S.SEED, response=S.RESPONSE_TEMPLATE, instruction=S.INSTRUCTION_TEMPLATE,
    )
    said = made.reports
    told = lambda name, place, a, b: said[name].groupBy(place.alias("place")).agg(a.alias("a"), b.alias("b")).withColumn("report", F.lit(name))
    place = F.concat_ws("/", "source", "split")
    one = lambda c: F.sum(c).cast("long")
    return reduce(
        DataFrame.unionByName,
        [
            told("warnings", place, one("n_rows"), one("max_rows")),
            told("histogram", place, one("n"), F.count("*")),
            told("longest", place, one("length"), one("row_id")),
            told("sizes", place, one("n_before"), one("n_after")),
            told("role_histogram", F.col("role"), one("n"), F.count("*")),
        ],
    ).select("report", "place", "a", "b")


@query
def load_split_ids(spark, folder):
    """Two splits of one source that count their rows alike, through all steps."""
    path = f"{folder}/documents.parquet"
    source = Source({"train": path, "test": path}, {"caption": "text"}, row_id="doc_id")
    raw = load(spark, {"captions": source}).withColumn("image_refs", F.array("source"))
    made = prepare(raw, "caption", S.TOKENS, splits={"train": ["train"], "test": ["test"]}, max_length=S.MAX_LENGTH)
    return made.rows.select(
        "role", "split", (F.col("row_id") % ROWS_PER_SOURCE).alias("doc_id"), "length", F.size("input_ids").alias("n_ids")
    )


@query
def load_text_ids(spark, folder):
    """Ids of two columns, numbered by a dictionary; a second source comes in later, and
    the numbers of the first stay."""
    docs = Source(f"{folder}/documents.parquet", {"caption": "text", "own_source": "source", "own_id": "doc_id"}, row_id=["source", "doc_id"])
    turns = Source(f"{folder}/conversations.parquet", {"caption": "text", "own_id": "conv_id", "turn": "turn"}, row_id=["conv_id", "turn"])
    ids = IdDictionary(spark, scratch_path(spark, "id-dictionary"))
    load(spark, {"papers": docs}, ids=ids)
    made = load(spark, {"chats": turns, "papers": docs}, ids=ids)
    return made.select("source", "own_source", "own_id", "turn", "row_id", F.length("caption").cast("long").alias("n_chars"))


# Profiles


@query
def length_histogram(spark, folder):
    return profile.histogram(fixtures.lengths(spark, folder), (), S.BINS, S.BAR_WIDTH)


@query
def length_summary(spark, folder):
    return profile.summary(fixtures.lengths(spark, folder), (), S.BINS)


@query
def histogram_by_source(spark, folder):
    """After truncation and before the length filter."""
    rows = roles.truncate(fixtures.lengths(spark, folder), LIMITS, S.SEED)
    return profile.histogram(rows, ["source", "split"], S.BINS, S.BAR_WIDTH)


@query
def histogram_by_role(spark, folder):
    rows = roles.route(fixtures.lengths(spark, folder), SPLITS, S.MAX_LENGTH)
    return profile.histogram(rows, ["role"], S.BINS, S.BAR_WIDTH)


@query
def length_counts(spark, folder):
    return profile.length_counts(fixtures.lengths(spark, folder))


@query
def distinct_lengths(spark, folder):
    return profile.distinct_lengths(fixtures.lengths(spark, folder))


# Order and batches


@query
def rank_in_length(spark, folder):
    rows = fixtures.lengths(spark, folder)
    ranked = ordering.ranked(rows, ["length"], ordering.latest_first(rows))
    return ranked.select("row_id", "length", "rank")


@query
def rank_in_length_shuffled(spark, folder):
    rows = fixtures.lengths(spark, folder)
    ranked = ordering.ranked(rows, ["length"], ordering.shuffled(S.SEED, S.EPOCH))
    return ranked.select("row_id", "length", "rank")


@query
def shuffle_rows(spark, folder):
    rows = batches.shuffle_rows(fixtures.lengths(spark, folder), S.SEED, S.EPOCH)
    return rows.select("row_id", "position")


@query
def fixed_batches(spark, folder):
    rows = batches.fixed(
        fixtures.lengths(spark, folder), S.BATCH_SIZE, True, S.SEED, S.EPOCH, accumulate=4
    )
    return rows.select("row_id", "position", "batch_id", "step_id")


@query
def length_grouped_batches(spark, folder):
    rows = batches.by_length(
        fixtures.lengths(spark, folder), S.BATCH_SIZE, S.MEGA_BATCHES, S.SEED, S.EPOCH
    )
    return rows.select("row_id", "length", "batch_id", "slot")


@query
def batch_concat(spark, folder):
    rows = scratch(_encoded(spark, folder), "encoded")
    batched = batches.fixed(rows, S.BATCH_SIZE, False, S.SEED, S.EPOCH).drop("step_id")
    made = batches.collect_batches(batched).select("batch_id", *packing.concatenated())
    return made.select(
        "batch_id", *[flat(F.col(c)).alias(c) for c in ("input_ids", "position_ids", "labels")]
    )


# Packing: each query gives one row of facts that hold for any correct packing.


def _trainable(spark, folder) -> DataFrame:
    """Stored lengths in range: the filter then reads one stored column instead of
    splitting every text a second time."""
    rows = scratch(fixtures.lengths(spark, folder).select("row_id", "length"), "lengths")
    return rows.filter(F.col("length").between(1, S.MAX_LENGTH))


def _placed(spark, folder, epoch: int = S.EPOCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _trainable(spark, folder)
    plan, placed = packed.places(rows, S.MAX_LENGTH, S.PACK_LIMIT, (S.SEED, epoch))
    return rows, plan, placed


def _per_pack(placed: DataFrame) -> DataFrame:
    return placed.groupBy("pack_id").agg(
        F.sum("length").alias("n_tokens"), F.count("*").alias("n_sequences")
    )


def _wrong_length_counts(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Lengths whose number of slots differs from their number of rows."""
    have = profile.length_counts(rows)
    both = have.join(counted.select("length", F.col("n").alias("m")), "length", "full")
    return both.agg(F.count_if(~F.col("n").eqNullSafe(F.col("m"))).alias("wrong_lengths"))


def _beside(*facts: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    tables = [f.withColumn("__one", F.lit(1)) for f in facts]
    first = tables[0]
    for other in tables[1:]:
        first = first.join(other, "__one")
    return first.drop("__one")


@query
def pack_strategies(spark, folder):
    rows = _trainable(spark, folder)
    plan = scratch(packing.strategies(rows, S.MAX_LENGTH, S.PACK_LIMIT), "strategies")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    facts = plan.withColumn("t", total).agg(
        F.sum(F.col("n") * F.size("lengths")).alias("n_sequences"),
        F.sum(F.col("n") * F.col("t")).alias("n_tokens"),
        F.count_if(F.col("t") > S.MAX_LENGTH).alias("over_budget"),
        F.count_if(F.size("lengths") > S.PACK_LIMIT).alias("over_limit"),
        F.count_if(F.col("n") < 1).alias("empty_strategies"),
        (F.sum("n") * S.MAX_LENGTH >= F.sum(F.col("n") * F.col("t"))).alias("enough_packs"),
    )
    counted = plan.select("n", F.explode("lengths").alias("length")).groupBy("length").agg(F.sum("n").alias("n"))
    sparing = packing.needless(plan, S.MAX_LENGTH, S.PACK_LIMIT)
    return _beside(_beside(facts, sparing), _wrong_length_counts(rows, counted))


@query
def pack_slots(spark, folder):
    rows = _trainable(spark, folder)
    plan = scratch(packing.strategies(rows, S.MAX_LENGTH, S.PACK_LIMIT), "strategies")
    slots = packing.slots(plan)
    facts = slots.agg(
        F.count("*").alias("n_slots"),
        (F.max("pack_id") + 1 == F.count_distinct("pack_id")).alias("packs_numbered"),
        F.sum("length").alias("n_tokens"),
        F.count_if(F.col("end") > S.MAX_LENGTH).alias("over_budget"),
        F.count_if(F.col("slot") >= S.PACK_LIMIT).alias("over_limit"),
    )
    return _beside(facts, _wrong_length_counts(rows, profile.length_counts(slots)))


@query
def pack_assign(spark, folder):
    rows, plan, placed = _placed(spark, folder)
    per_row = placed.groupBy("row_id").agg(F.count("*").alias("c"), F.max("length").alias("placed_length"))
    seen = rows.join(per_row, "row_id", "left").agg(
        F.count("c").alias("assigned"),
        F.count_if(F.col("c") > 1).alias("duplicates"),
        F.count_if(F.col("c").isNull()).alias("missing"),
        F.sum("placed_length").alias("n_tokens"),
    )
    packs = _per_pack(placed).agg(
        F.count_if(F.col("n_tokens") > S.MAX_LENGTH).alias("over_budget"),
        F.count_if(F.col("n_sequences") > S.PACK_LIMIT).alias("over_limit"),
    )
    slots = packing.slots(plan).withColumnRenamed("length", "slot_length")
    fits = placed.join(slots, ["pack_id", "slot"], "full").agg(
        F.count_if(~F.col("length").eqNullSafe(F.col("slot_length"))).alias("wrong_slots")
    )
    return _beside(seen, packs, fits)


@query
def pack_summary(spark, folder):
    _, plan, placed = _placed(spark, folder)
    made = packing.summary(_per_pack(placed), S.MAX_LENGTH)
    planned = plan.agg(F.sum("n").alias("planned"))
    return _beside(made, planned).select(
        "n_tokens",
        (F.col("n_packs") == F.col("planned")).alias("as_planned"),
        (F.col("n_packs") >= F.ceil(F.col("n_tokens") / S.MAX_LENGTH)).alias("above_lower_bound"),
        F.col("fill_rate").between(0, 1).alias("fill_in_range"),
    )


@query
def pack_gather(spark, folder):
    rows, _, placed = _placed(spark, folder)
    texts = fixtures.captions(spark, folder).select("row_id", "caption")
    packs = packing.gather(texts, placed)
    members = packs.select("pack_id", F.posexplode("members").alias("at", "m"))
    return members.agg(
        F.count("*").alias("n_sequences"),
        F.count_distinct("m.row_id").alias("distinct_rows"),
        F.count_if(F.col("at") != F.col("m.slot")).alias("out_of_order"),
        F.sum(F.length("m.caption")).alias("n_chars"),
        F.sum("m.row_id").alias("row_id_sum"),
    )


@query
def pack_segments(spark, folder):
    _, _, placed = _placed(spark, folder)
    planned = placed.select("pack_id", "slot", "length", F.col("start").alias("s"), F.col("end").alias("e"))
    checked = packing.running_segments(planned).agg(
        F.count("*").alias("n_segments"),
        F.count_if((F.col("s") != F.col("start")) | (F.col("e") != F.col("end"))).alias("wrong_bounds"),
        F.sum(F.col("end") - F.col("start")).alias("n_tokens"),
    )
    packs = packing.collect_packs(placed).select(packing.visible_pairs())
    return _beside(checked, packs.agg(F.sum("visible_pairs").alias("visible_pairs")))


def _chat_places(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(encoded rows, plan, placed rows)`` of the conversations."""
    rows = scratch(_encoded(spark, folder), "encoded")
    plan, placed = packed.places(
        rows.select("row_id", "length"), S.MAX_LENGTH, S.PACK_LIMIT, (S.SEED, S.EPOCH)
    )
    return rows.drop("length"), plan, placed


def _chat_packs(spark, folder) -> DataFrame:
    rows, _, placed = _chat_places(spark, folder)
    return packing.gather(rows, placed)


@query
def pack_concat(spark, folder):
    made = _chat_packs(spark, folder).select("pack_id", *packing.concatenated())
    sizes = [F.size(c) for c in ("input_ids", "position_ids", "labels")]
    total = lambda c: F.sum(F.aggregate(F.col(c).cast("array<bigint>"), F.lit(0).cast("long"), lambda a, x: a + x))
    return made.agg(
        F.sum(sizes[0]).alias("n_ids"),
        F.count_if((sizes[0] != sizes[1]) | (sizes[0] != sizes[2])).alias("uneven"),
        total("input_ids").alias("id_sum"),
        total("position_ids").alias("position_sum"),
        total("labels").alias("label_sum"),
    )


@query
def pack_images(spark, folder):
    packs = _chat_packs(spark, folder).select("pack_id", packing.images())
    return packs.select(F.explode("image_refs").alias("image_ref")).groupBy("image_ref").agg(F.count("*").alias("n"))


@query
def pack_epoch(spark, folder):
    """Two epochs share their strategies, not their rows' places or pack order."""
    rows = _trainable(spark, folder)
    plan = scratch(packing.strategies(rows, S.MAX_LENGTH, S.PACK_LIMIT), "strategies")
    packs = packing.packs(plan).select("pack_id")
    per_epoch = []
    for epoch in (0, 1):
        placed = packing.assign(rows, plan, ordering.shuffled(S.SEED, epoch))
        at = packing.pack_order(packs, S.SEED, epoch)
        per_epoch.append(
            placed.join(at, "pack_id").select(
                "row_id", "pack_id", "slot", "length", "position", F.lit(epoch).alias("epoch")
            )
        )
    both = scratch(per_epoch[0].unionByName(per_epoch[1]), "epochs")
    wide = both.groupBy("row_id").agg(
        F.count_distinct("pack_id", "slot").alias("places"), F.count("*").alias("times")
    )
    moved = wide.agg(
        (F.count_if(F.col("places") > 1) > 0).alias("rows_moved"),
        F.count_if(F.col("times") != 2).alias("not_twice"),
    )
    order = both.groupBy("epoch", "pack_id").agg(F.min("position").alias("position"), F.sum("length").alias("t"))
    spread = order.groupBy("epoch").agg(
        F.count_distinct("position").alias("positions"), F.count("*").alias("packs"),
        F.max("position").alias("last"), F.sum("t").alias("t"),
    )
    even = spread.agg(
        F.count_if((F.col("positions") != F.col("packs")) | (F.col("last") != F.col("packs") - 1)).alias("bad_epochs"),
        F.sum("t").alias("n_tokens"),
    )
    return _beside(moved, even)


@query
def pack_batches(spark, folder):
    """Packs of a batch as one longer sequence, in the epoch's order."""
    rows, plan, placed = _chat_places(spark, folder)
    position = packing.pack_order(packing.packs(plan).select("pack_id"), S.SEED, S.EPOCH)
    made = packing.gather_batches(rows, placed, position, 4).select("batch_id", *packing.concatenated())
    return made.agg(
        F.sum(F.size("input_ids")).alias("n_ids"),
        (F.max("batch_id") + 1 == F.count("*")).alias("batches_numbered"),
        F.count_if(F.size("input_ids") > 4 * S.MAX_LENGTH).alias("over_budget"),
    )


@query
def packed_conversations(spark, folder):
    """The whole way from turns to packs, counted."""
    made = packed.packed_chat(spark, folder)
    return made.agg(
        F.sum("n_sequences").alias("n_sequences"),
        F.sum("n_tokens").alias("n_tokens"),
        F.count_if(F.size("input_ids") != F.col("n_tokens")).alias("wrong_size"),
        F.count_if(F.col("fill_rate") > 1).alias("over_budget"),
        F.sum(F.size(tok.labelled(F.col("labels")))).alias("n_labels"),
        F.sum(F.size("image_refs")).alias("n_images"),
    )
