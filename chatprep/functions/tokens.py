"""Tokens, label masks and positions as array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep.settings import IGNORE_LABEL, ChatTokens

_SPACES = " \t\n\x0b\x0c\r"


def spaced(text: Column, tokens: ChatTokens) -> Column:
    """Special tokens set apart by blanks, other white space as it was."""
    for special in (tokens.start, tokens.end, tokens.image, tokens.eos):
        text = F.replace(text, F.lit(special), F.lit(f" {special} "))
    return text


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text. Split at single blanks,
    which takes no regular expression, and what is empty between two of them left out."""
    for blank in _SPACES[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def tokenise(text: Column, tokens: ChatTokens) -> Column:
    return words(F.concat(F.lit(tokens.bos + " "), spaced(text, tokens)))


def position_ids(ids: Column) -> Column:
    return F.transform(ids, lambda _, i: i)


def _hit(ids: Column, at: Column, template: list[Column]) -> Column:
    """True where ``template`` starts at zero-based ``at``."""
    return reduce(
        lambda a, b: a & b,
        [F.coalesce(F.get(ids, at + k) == t, F.lit(False)) for k, t in enumerate(template)],
    )


def template_starts(ids: Column, template: list[Column]) -> Column:
    """Zero-based start positions of ``template`` in ``ids``."""
    return F.filter(position_ids(ids), lambda at: _hit(ids, at, template))


def contains_template(ids: Column, template: list[Column]) -> Column:
    return F.exists(position_ids(ids), lambda at: _hit(ids, at, template))


def response_spans(size: Column, answers: Column, width: int, asks: Column | None) -> Column:
    """Zero-based half-open ranges of ids that belong to a response. ``answers``
    and ``asks`` hold the start positions of the response and instruction
    templates; without an instruction template only the last response counts."""
    if asks is None:
        return F.transform(
            F.slice(answers, -1, 1),
            lambda a: F.struct((a + width).alias("start"), size.alias("end")),
        )

    def span(answer: Column, nth: Column) -> Column:
        begin = answer + width
        ask = F.array_min(F.filter(asks, lambda a: a >= begin))
        # A second response template before the next instruction stays inside
        # the first one's span, so cut there to keep the spans disjoint.
        following = F.get(answers, nth + 1) + width
        end = F.least(F.coalesce(ask, size), F.coalesce(following, size))
        return F.struct(begin.alias("start"), end.alias("end"))

    return F.transform(answers, span)


def response_labels(ids: Column, spans: Column) -> Column:
    """Ids inside ``spans``, the ignore label elsewhere. Built from slices, so a
    row costs one array operation per span instead of a test per id."""
    ignore = F.lit(IGNORE_LABEL)

    def piece(s: Column, nth: Column) -> Column:
        before = F.when(nth == 0, F.lit(0)).otherwise(F.get(spans, nth - 1)["end"])
        return F.concat(
            F.array_repeat(ignore, s["start"] - before),
            F.slice(ids, s["start"] + 1, s["end"] - s["start"]),
        )

    tail_from = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    return F.concat(
        F.flatten(F.transform(spans, piece)),
        F.array_repeat(ignore, F.size(ids) - tail_from),
    )


def labelled(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != IGNORE_LABEL)
