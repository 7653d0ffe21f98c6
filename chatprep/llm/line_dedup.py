"""Line dedup over overlapping three-line windows, in SQL functions only.

Lines are compared without the blanks around them, and blank lines are passed over.
Every three lines in a row make a window. Of a window that occurs more than once, in
any documents, the first occurrence by (document id, position) stays; each later one
covers its three lines, and covered lines are removed. The first line of its kind is
never covered, so nothing is lost altogether.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 3
#: The blanks around a line that do not count.
BLANKS = " \t\r\x0b\x0c"


def _filled(text: Column) -> Column:
    """``[(pos, line)]`` of the lines that are not blank."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x, F.lit(BLANKS)).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def _windows(docs: DataFrame) -> DataFrame:
    """``(id, print, a, b, pos, spans)``: two hashes of each window, its first line's
    place, and the places it covers."""
    at = lambda lines, i: F.get(lines, i)["line"]
    place = lambda lines, i: F.get(lines, i)["pos"]
    made = docs.select("id", "print", _filled(F.col("text")).alias("lines")).filter(F.size("lines") >= SPAN)
    every = F.transform(
        F.sequence(F.lit(0), F.size("lines") - SPAN),
        lambda i: F.struct(
            F.xxhash64(*[at(F.col("lines"), i + k) for k in range(SPAN)]).alias("a"),
            F.xxhash64(*[at(F.col("lines"), i + k) for k in reversed(range(SPAN))]).alias("b"),
            place(F.col("lines"), i).alias("pos"),
            F.array(*[place(F.col("lines"), i + k) for k in range(SPAN)]).alias("spans"),
        ),
    )
    return made.select("id", "print", F.inline(every))


def deduped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            removed_column: str = "removed_lines") -> DataFrame:
    """``docs`` with all its columns, ``text_column`` without the covered lines, and one
    more column ``removed_column``, the number of lines taken out (null for null texts).
    A column of ``docs`` with that name is written over.

    A text of fewer than three filled lines stays as it is. Rows that agree in id and
    text are one document and get the same result; rows with one id and different texts
    are different documents. Null ids come first. An empty table gives an empty one.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    known = rows.withColumn("id", F.col("row").getField(id_column)).withColumn("text", F.col("row").getField(text_column))
    known = known.withColumn("print", F.xxhash64("text"))
    windows = _windows(known.select("id", "print", "text"))
    first = (
        windows.groupBy("a", "b")
        .agg(F.min(F.struct("id", "print", "pos")).alias("first"), F.count(F.lit(1)).alias("held"))
        .filter("held > 1").select("a", "b", "first")
    )
    covered = (
        windows.join(first, ["a", "b"])
        .filter(~F.struct("id", "print", "pos").eqNullSafe(F.col("first")))
        .select(F.col("id").alias("c_id"), F.col("print").alias("c_print"), F.explode("spans").alias("pos"))
        .groupBy("c_id", "c_print").agg(F.collect_set("pos").alias("covered"))
    )
    joined = known.join(covered, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("print") == F.col("c_print")), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    removed = F.when(F.col("text").isNotNull(), F.coalesce(F.size("covered"), F.lit(0)))
    return joined.select("row", text.alias("text"), removed.alias("removed")).select(
        *[(F.col("text") if c == text_column else F.col("row").getField(c)).alias(c)
          for c in docs.columns if c.lower() != removed_column.lower()],
        F.col("removed").alias(removed_column),
    )


def line_count(text: Column) -> Column:
    """Number of lines of a text that are not blank; 0 for null."""
    return F.coalesce(F.size(_filled(text)), F.lit(0))


def free_name(wanted: str, columns: Sequence[str]) -> str:
    """``wanted``, with as many underscores after it as no column has yet."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
