"""Near-duplicate groups: fast similarity sketching, banding, exact verification.

Texts become sets of word shingles; texts with the same set are one *node*. Sketches
put nodes into band buckets, and what shares a bucket may be linked. No bucket is ever
turned into all its pairs:

* Shingles that no other candidate holds bound the similarity a node can have with
  anything. Most nodes of a bucket are shown to have no link at all by that count.
* The others are compared with the member of their bucket that has the fewest such
  shingles (the likely origin of a group of copies), which joins up the groups.
* Pairs that are still in different components, share a bucket and whose counts allow
  a link are compared one by one.

Every comparison is on full sets. With 32 bands of 4 rows, a pair of similarity 0.85
shares no bucket with a probability of 6e-11.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.components import components
from chatprep.llm.hashing import mix, slices, windows, word_hashes
from chatprep.llm.sketch import bands, sketches
from chatprep.sources.stages import scratch

SHINGLE = 5
#: Two sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDINATES = 128
ROWS = 4

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(values: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted within each text, and its bounds.
    Fewer words than ``size`` make one shingle, no words an empty set."""
    hashes, bounds = word_hashes(values)
    made, owner, _ = windows(hashes, bounds, size)
    lengths = np.diff(bounds)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, text in enumerate(short):
            for h in hashes[bounds[text] : bounds[text + 1]]:
                whole[i : i + 1] = mix(whole[i : i + 1] * _PRIME + h, 11)
        made, owner = np.concatenate((made, whole)), np.concatenate((owner, short))
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    fresh = np.ones(len(made), bool)
    fresh[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    made, owner = made[fresh], owner[fresh]
    return made, np.searchsorted(owner, np.arange(len(values) + 1))


def _digests(members: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    made = []
    for seed in (101, 202):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(members, seed))))
        made.append(mix(total[bounds[1:]] - total[bounds[:-1]], seed).view(np.int64))
    return made[0], made[1]


#: What a word is made of; texts that hold none of it have no words.
_FILLED = "[^\\x20\\x09-\\x0D]"


def _row_keys(columns: Sequence[str]) -> list[Column]:
    """Two hashes that tell rows apart which differ in any of the columns, null or not."""
    told = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(seed), *told).alias(f"k{seed}") for seed in (1, 2)]


def _hashable(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def sketched(docs: DataFrame, id_column: str, text_column: str, size: int = SHINGLE,
             coordinates: int = COORDINATES, rows: int = ROWS, told_by: Sequence[str] | None = None) -> DataFrame:
    """``(doc_id, k1, k2, n_shingles, lo, hi, bands)`` of every row; ``k1``, ``k2`` hash
    the columns ``told_by`` (id and text), ``lo``, ``hi`` the set, ``bands`` is empty for
    an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in slices(batches, "text"):
            members, bounds = shingle_sets(values, size)
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            owner = np.repeat(np.arange(len(full)), counts[full])
            keys = bands(sketches(members, owner, len(full), coordinates), rows).view(np.int64)
            held = np.where(counts > 0, coordinates // rows, 0)
            offsets = np.concatenate(([0], np.cumsum(held))).astype(np.int32)
            lo, hi = _digests(members, bounds)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array(counts), pa.array(lo), pa.array(hi), lists],
                names=["doc_id", "k1", "k2", "n_shingles", "lo", "hi", "bands"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(
        F.col(id_column).alias("doc_id"), *_row_keys(told_by or (id_column, text_column)), F.col(text_column).cast("binary").alias("text")
    )
    return narrow.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, n_shingles bigint, lo bigint, hi bigint, bands array<bigint>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """``(node, n, shingles)`` of rows ``(node, lo, hi, text)`` whose digests agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in slices(batches, "text"):
            members, bounds = shingle_sets(values, size)
            lo, hi = _digests(members, bounds)
            same = (lo == part.column("lo").to_numpy()) & (hi == part.column("hi").to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(members.view(np.int64)))
            made = pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(np.diff(bounds)), lists], names=["node", "n", "shingles"]
            )
            yield made.filter(pa.array(same))

    return rows.mapInArrow(run, "node bigint, n bigint, shingles array<bigint>")


def _may_link(a: str, b: str, percent: int):
    """Whether the counts of shingles that others share allow a link."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n_a - F.col(f"{a}.own"), n_b - F.col(f"{b}.own"))
    return 100 * most >= percent * (n_a + n_b - most)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))
        .select("a", "b")
    )


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE,
           percent: int = PERCENT, coordinates: int = COORDINATES, rows: int = ROWS,
           told_by: Sequence[str] | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, component, k1, k2)``, one row per row of ``docs``.

    ``component_id`` is the smallest id a document is linked with over any number of
    links, and the document's own id if it has none; a text that is null or has no
    words is linked with nothing. ``kept`` marks the documents whose id is that of
    their component; of a document without id nothing is known to be kept but itself,
    so it is kept only if its group has no id at all. Rows with one id and different
    texts are different documents, equal rows share everything. An empty table gives
    an empty one. Other columns are not looked at. ``component`` numbers the group in this
    run (null without words), ``k1`` and ``k2`` hash the columns ``told_by``, of which the
    text has to be one (id and text unless given).
    """
    told_by = told_by or (id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    made = scratch(sketched(docs, id_column, text_column, size, coordinates, rows, told_by), "near-sketches")
    key = ["lo", "hi", "n_shingles"]
    classes = scratch(
        made.filter("n_shingles > 0").groupBy(key)
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("k"))
        .withColumn("node", F.monotonically_increasing_id()),
        "near-classes",
    )
    members = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("bucket")
    hits = scratch(members.join(shared, "bucket"), "near-hits")

    # Any one text of a node will do; rows that repeat it are put together after the join,
    # which leaves AQE free to split a row that is repeated very often.
    wanted = hits.select("node").distinct().join(classes.select("node", "k.k1", "k.k2", "lo", "hi"), "node")
    texts = docs.select(*_row_keys(told_by), F.col(text_column).cast("binary").alias("text"))
    found = wanted.join(texts, ["k1", "k2"]).groupBy("node", "lo", "hi").agg(F.first("text").alias("text"))
    sets = scratch(_sets(found.select("node", "lo", "hi", "text"), size), "near-sets")

    # A shingle is a node's own when no other candidate has it.
    own = (
        sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("node"))
        .filter("held = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    )
    open_nodes = scratch(
        sets.select("node", "n").join(own, "node", "left").fillna(0, ["own"])
        .filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")),
        "near-open",
    )
    open_hits = scratch(hits.join(open_nodes, "node"), "near-open-hits")
    origin = open_hits.groupBy("bucket").agg(
        F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "own")).alias("o")
    ).select("bucket", "o.node", "o.n", "o.own")
    spokes = (
        open_hits.alias("x").join(origin.alias("o"), "bucket")
        .filter((F.col("x.node") != F.col("o.node")) & _may_link("x", "o", percent))
        .select(F.least("x.node", "o.node").alias("a"), F.greatest("x.node", "o.node").alias("b"))
        .distinct()
    )
    links = scratch(_verified(spokes, sets, percent), "near-links")
    label = components(links)

    # Pairs that no link joins yet. Of a bucket, members outside its largest component
    # are compared with the others; a pair is taken in the first bucket it shares.
    labelled = scratch(
        open_hits.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-labelled"
    )
    counted = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = (
        counted.groupBy("bucket")
        .agg(F.max(F.struct("held", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1").select("bucket", F.col("top.component").alias("top"))
    )
    split = scratch(labelled.join(largest, "bucket").join(classes.select("node", "bands"), "node"), "near-split")
    outside = split.filter("component != top")
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), F.lit(True))
    rest = (
        outside.alias("x").join(split.alias("y"), F.col("x.bucket") == F.col("y.bucket"))
        .filter(F.col("x.component") != F.col("y.component"))
        .filter((F.col("y.component") == F.col("y.top")) | (F.col("x.node") < F.col("y.node")))
        .filter(_may_link("x", "y", percent))
        .filter(first == F.col("x.band") + 1)
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
    )
    more = scratch(_verified(rest, sets, percent), "near-more-links")
    label = components(links.unionByName(more))

    named = (
        classes.select(*key, "node", "rep").join(label, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = named.join(smallest, "component").select(*key, "component", "component_id")
    out = made.select("doc_id", "k1", "k2", *key).join(of_class, key, "left")
    empty = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).cast(kind).alias("component_id"),
        F.when(empty, True).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "component", "k1", "k2",
    )


def kept_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group, and every
    row whose text is null or has no words, however often it is repeated.

    Of a group the document with the smallest id stays. If several rows have that id, the
    one with the smallest hash over all columns (but maps) stays, and equal rows are one
    row. A group without any id keeps the row with the smallest hash likewise. An empty
    table gives an empty one; no column is added, so no name can clash.
    """
    told_by = _hashable(docs)
    made = scratch(groups(docs, id_column, text_column, told_by=told_by, **settings), "near-groups")
    stay = made.filter("kept AND n_shingles > 0").groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
    words = F.coalesce(F.regexp_like(F.col(f"`{text_column}`"), F.lit(_FILLED)), F.lit(False))
    rows = docs.filter(words).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_keys(told_by))
    found = rows.join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.filter(~words))
