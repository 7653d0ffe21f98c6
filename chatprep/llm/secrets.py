"""Secret scans with an incremental blob ledger, in SQL functions only.

Texts are content-addressed: a blob is one text, whatever paths and versions hold it.
The ledger remembers which (blob, rule version) pairs have been scanned and what was
found; a scan reads only unseen pairs, and findings are joined back to every path.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.sources.stages import shared_folder

#: Goes up when the same rules come to mean something else.
READING = 2


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap. ``value`` is the pattern that a
    match has to meet as a whole; other matches are dropped."""

    kind: str
    pattern: str
    value: str | None = None


_ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: The base kinds in their order; then those this scan adds.
BASE = (
    Rule("assign", _ASSIGN + "([A-Za-z0-9+/_.=-]+)", _ASSIGN + "([A-Za-z0-9+/_.=-]{6,})"),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + ADDED


def version_of(rules: Sequence[Rule]) -> str:
    """A digest of the rules in their order, so that no other rules pass for them."""
    return hashlib.sha256(json.dumps([READING, *map(astuple, rules)]).encode()).hexdigest()[:16]


RULE_VERSION = version_of(RULES)
FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of one rule as ``(start, rank, end, kind)``, in code points. The lengths of
    the matches and of what lies between them add up to the places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    at = F.aggregate(
        F.zip_with(found, F.slice(between, 1, F.size(between) - 1), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("m"))),
        F.struct(F.lit(0).alias("place"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["place"] + x["gap"] + x["size"]).alias("place"),
            F.concat(
                acc["out"],
                F.array(F.struct((acc["place"] + x["gap"]).alias("start"), (acc["place"] + x["gap"] + x["size"]).alias("end"), x["m"].alias("m"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    kept = at if rule.value is None else F.filter(at, lambda x: F.regexp_like(x["m"], F.lit(f"^{rule.value}$")))
    made = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    # Most texts hold no match at all.
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), made).otherwise(F.array().cast(FINDINGS)).cast(FINDINGS)


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then by the order of the rules."""
    return F.array_sort(F.concat(*[spans(text, r, i) for i, r in enumerate(rules)]))


def blob_of(text: Column) -> Column:
    """The address of a text; a null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """The table ``(blob, rule_version, found)`` below ``folder``, which executors share.
    Pairs without a finding are in it too."""

    SCHEMA = f"blob string, found {FINDINGS}, rule_version string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/blobs"
        spark.createDataFrame([], self.SCHEMA).write.mode("ignore").partitionBy("rule_version").parquet(self.path)

    @staticmethod
    def fresh(spark: SparkSession) -> Ledger:
        return Ledger(spark, f"{shared_folder(spark).rstrip('/')}/secrets-{uuid.uuid4().hex}")

    def rows(self, rule_version: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).filter(F.col("rule_version") == rule_version).select("blob", "found")

    def scan(self, versions: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scans the blobs of ``versions`` that these rules have not seen, each once.

        Equal and null texts (read as empty) are one blob, an empty table adds nothing, and
        texts of any length are scanned as a whole. A lost run leaves either nothing or
        whole pairs behind; scanning again is safe. Of one ledger, one scan runs at a time:
        two at once would both store the blobs that are new to both.
        """
        version = version_of(rules)
        texts = versions.select(blob_of(F.col(text_column)).alias("blob"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
        unseen = texts.join(self.rows(version).select("blob"), "blob", "left_anti")
        once = unseen.groupBy("blob").agg(F.first("text").alias("text"))
        made = once.select("blob", findings(F.col("text"), rules).alias("found"), F.lit(version).alias("rule_version"))
        made.write.mode("append").partitionBy("rule_version").parquet(self.path)

    def found_in(self, versions: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``versions`` without the text, with ``found``: the findings of every path and
        version, in place of a column of that name. A blob that these rules have not scanned
        has a null ``found``. Repeated rows stay. The ledger holds a blob once, so AQE can
        split one that many paths share."""
        others = [F.col(f"`{c}`") for c in versions.columns if c not in (text_column, "found")]
        rows = versions.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), blob_of(F.col(text_column)).alias("blob"))
        made = rows.join(self.rows(version_of(rules)), "blob", "left")
        return made.select(*[F.col("row").getField(c).alias(c) for c in versions.columns if c not in (text_column, "found")], "found")
