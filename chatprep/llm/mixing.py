"""Mixing sources to target weights by iterative proportional fitting, in SQL only.

Documents are counted in cells (source, language, topic). What a value is asked for and
has not got is first shared out among the other values of its dimension. Raking then
scales the token weights of the cells in turn to the target sums of each source, language
and topic, never above what a cell has, until all three hold. A document is then taken
with its cell's probability, weight over tokens, by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatprep.sources.stages import scratch

Targets = Mapping[str, Mapping[str, float]]

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: shares proportional to tokens to this power, so that large values
#: of a dimension give way to small ones.
TEMPERING = 0.7
#: Tokens of the sample as a share of all tokens.
KEEP_SHARE = 0.5
#: Raking ends when no sum is off its target by more than this share of it. Targets that
#: contradict each other end it after so many rounds; ``marginals`` shows what is off.
TOLERANCE = 1e-10
MOST_ROUNDS = 60
#: From this share of its tokens on a value counts as wanted whole.
WHOLE = 1 - 1e-12
SEED = "mix-1"

#: Words as everywhere in these operators.
BLANKS = "[\\x20\\x09-\\x0D]+"


def token_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    """A topic from the form of a text, for corpora without a topic column: ``table``,
    ``shouting``, ``marked``, ``short``, else ``prose``; null texts are ``short``."""
    size = F.length(text)
    lost = lambda chars: size - F.length(F.translate(text, chars, ""))
    return (
        F.when(text.isNull() | (size < 400), "short")
        .when(20 * lost("|") >= size, "table")
        .when(20 * lost("!") >= size, "shouting")
        .when(20 * lost("#*$%&") >= size, "marked")
        .otherwise("prose")
    )


def chance(id_column: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on seed and id alone, the same for a null id."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(id_column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _joined(cells: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """``cells`` with the columns of ``table``, whose ``value`` is one of dimension ``name``."""
    return cells.join(table, F.col(name).eqNullSafe(F.col("value"))).drop("value")


def _shared(cells: DataFrame, targets: Targets | None) -> DataFrame:
    """Cells with ``share_<name>``, the share of the sample that their value of a dimension
    is asked for, and ``usable``, their tokens if all three shares are positive, else 0."""
    for name in DIMENSIONS:
        wanted = (targets or {}).get(name)
        sums = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("own"))
        if wanted is None:
            share = F.when(F.col("own") > 0, F.pow(F.col("own").cast("double"), F.lit(TEMPERING))).otherwise(0.0)
        else:
            pairs = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, float(v))])
            share = F.coalesce(F.try_element_at(pairs, F.col("value")), F.lit(0.0))
        cells = scratch(_joined(cells, sums.select("value", share.alias(f"share_{name}")), name), "mix-cells")
    positive = [F.col(f"share_{name}") > 0 for name in DIMENSIONS]
    return cells.withColumn("usable", F.when(positive[0] & positive[1] & positive[2], F.col("tokens")).otherwise(0).cast("double"))


def _goals(cells: DataFrame, keep_share: float) -> DataFrame:
    """``(dimension, value, own, asked, target)``: tokens there are, tokens asked for, and
    what is asked for once no value is to give more than it has and the others make up for
    it in proportion to their shares."""
    per = [
        cells.groupBy(F.lit(name).alias("dimension"), F.col(name).alias("value"))
        .agg(F.sum("usable").alias("own"), F.max(f"share_{name}").alias("share"))
        for name in DIMENSIONS
    ]
    per = scratch(per[0].unionByName(per[1]).unionByName(per[2]), "mix-values")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    sums = {r["dimension"]: r for r in per.groupBy("dimension").agg(F.sum("own").alias("own"), F.sum("share").alias("share")).collect()}
    # All cells are in each dimension, so what is usable is one and the same sum.
    wanted = min([keep_share * total, *(r["own"] for r in sums.values())])
    of = lambda by_name: F.element_at(F.create_map(*[F.lit(x) for k in DIMENSIONS for x in (k, float(by_name[k]))]), F.col("dimension"))
    whole_share = {k: (sums[k]["share"] if k in sums else 0.0) or 1.0 for k in DIMENSIONS}
    level = {k: wanted / whole_share[k] for k in DIMENSIONS}
    rising = bool(sums)
    while rising:  # three rows come back; a level rises only if more values are then whole
        full = F.col("own") <= of(level) * F.col("share")
        rest = per.groupBy("dimension").agg(
            F.sum(F.when(full, F.col("own")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("open")
        ).collect()
        up = {r["dimension"]: (wanted - r["full"]) / r["open"] for r in rest if r["open"] > 0}
        rising = any(v > level[k] * (1 + 1e-12) for k, v in up.items())
        level = {k: max(level[k], up.get(k, 0.0)) for k in DIMENSIONS}
    asked = F.lit(keep_share * total) * F.col("share") / of(whole_share)
    return scratch(per.select("dimension", "value", "own", asked.alias("asked"), F.least("own", of(level) * F.col("share")).alias("target")), "mix-goals")


def raked(counted: DataFrame, targets: Targets | None = None, keep_share: float = KEEP_SHARE,
          rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``(source, lang, topic, docs, tokens, weight, probability)``, one row per cell of
    ``counted`` ``(source, lang, topic, n_tokens)``.

    ``targets`` gives wanted shares by dimension and value; a dimension it does not
    name is tempered. A value asked for more than it has gives all it has, and the others
    of its dimension the rest. Targets that cells cannot meet together are met as far as
    they can: see ``marginals``. A null value is a value of its own, and one that ``targets`` does not name gets nothing. Cells without tokens get
    no weight and probability 1: they cost nothing.
    """
    cells = counted.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    cells = scratch(_shared(scratch(cells, "mix-cells"), targets), "mix-cells")
    goals = _goals(cells, keep_share)
    # Cells of a value that is wanted whole are taken whole; the rest is raked to what is
    # then left of the targets.
    whole = F.lit(False)
    for name in DIMENSIONS:
        goal = goals.filter(F.col("dimension") == name).select("value", F.col("target").alias(f"goal_{name}"), F.col("own").alias(f"own_{name}"))
        cells = _joined(cells, goal, name)
        whole |= F.col(f"goal_{name}") >= F.col(f"own_{name}") * WHOLE
    cells = scratch(cells.withColumn("fixed", F.when(whole, F.col("usable")).otherwise(0.0)), "mix-cells")
    for name in DIMENSIONS:
        cells = _joined(cells, cells.groupBy(F.col(name).alias("value")).agg(F.sum("fixed").alias(f"fixed_{name}")), name)
        cells = scratch(cells.withColumn(f"goal_{name}", F.greatest(F.col(f"goal_{name}") - F.col(f"fixed_{name}"), F.lit(0.0))), "mix-cells")
    cells = cells.select(
        *DIMENSIONS, "docs", "tokens", "fixed", *[f"goal_{name}" for name in DIMENSIONS],
        (F.col("usable") - F.col("fixed")).alias("room"), ((F.col("usable") - F.col("fixed")) * keep_share).alias("free"), F.lit(0.0).alias("off"),
    )
    for _ in range(rounds):
        cells = cells.withColumn("off", F.lit(0.0))
        for name in DIMENSIONS:
            now = F.sum(F.least("free", "room"))
            goal = F.max(f"goal_{name}")
            sums = cells.groupBy(F.col(name).alias("value")).agg(F.when(now > 0, goal / now).otherwise(0.0).alias("times"))
            moved = F.when((F.col("times") > 0) & (F.col("room") > 0), F.abs(F.col("times") - 1)).otherwise(0.0)
            cells = scratch(
                _joined(cells, sums, name).withColumn("off", F.greatest("off", moved)).withColumn("free", F.col("free") * F.col("times")).drop("times"),
                "mix-cells",
            )
        if (cells.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    weight = F.col("fixed") + F.least("free", "room")
    return cells.select(
        *DIMENSIONS, "docs", "tokens", weight.alias("weight"),
        F.when(F.col("tokens") > 0, weight / F.col("tokens")).otherwise(1.0).alias("probability"),
    )


def marginals(cells: DataFrame, targets: Targets | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """``(dimension, value, own, asked, target, reached, residual)`` of what ``raked`` gave
    for the same arguments: ``asked`` is the wish, ``target`` what of it the tokens of the
    value allow, ``residual`` how far ``reached`` is off the target, as a share of it."""
    goals = _goals(_shared(cells, targets), keep_share)
    reached = [
        cells.groupBy(F.lit(name).alias("at"), F.col(name).alias("of")).agg(F.sum("weight").alias("reached")) for name in DIMENSIONS
    ]
    made = goals.join(
        reached[0].unionByName(reached[1]).unionByName(reached[2]), (F.col("dimension") == F.col("at")) & F.col("value").eqNullSafe(F.col("of"))
    ).drop("at", "of")
    return made.withColumn("residual", F.when(F.col("target") > 0, F.abs(F.col("reached") - F.col("target")) / F.col("target")).otherwise(F.col("reached")))


def sampled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", topic: Column | None = None,
            targets: Targets | None = None, keep_share: float = KEEP_SHARE,
            keep_text: bool = True) -> DataFrame:
    """The documents drawn, with all their columns and ``mix_topic``, ``mix_tokens`` and
    ``mix_probability``, the chance with which each was drawn; columns of these names in
    ``docs`` give way to the new ones.

    Rows with one id are drawn or left together if their cells agree; rows without an id
    share one draw. Documents without words are kept. An empty table gives an empty one.
    ``keep_text`` False leaves the text out. Topics and tokens are taken from the texts
    once and stored with the rows.
    """
    made = ("mix_topic", "mix_tokens", "mix_probability")
    names = [c for c in docs.columns if (keep_text or c != text_column) and c not in made]
    text = F.col(f"`{text_column}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(f"`{id_column}`").alias("id"),
        F.col("source"), F.col("lang"),
        (topic_of(text) if topic is None else topic).alias("topic"),
        token_count(text).alias("n_tokens"),
    )
    rows = scratch(rows, "mix-rows")
    cells = raked(rows.select(*DIMENSIONS, "n_tokens"), targets, keep_share)
    cell = cells.select(*[F.col(c).alias(f"cell_{c}") for c in DIMENSIONS], "probability")
    same = [F.col(c).eqNullSafe(F.col(f"cell_{c}")) for c in DIMENSIONS]
    drawn = rows.join(cell, same).filter(chance(F.col("id")) < F.col("probability"))
    return drawn.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.col("topic").alias("mix_topic"), F.col("n_tokens").alias("mix_tokens"),
        F.col("probability").alias("mix_probability"),
    )
