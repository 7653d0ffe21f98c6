"""The chat template as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep.settings import ChatTokens

# The heading of each role and the gap after user and system turns.
HEADINGS = {"user": "### User:\n", "system": "### System:\n", "assistant": "### Assistant:\n"}
TURN_GAP = "\n\n"


def _joined(parts: Column, image: str | None) -> Column:
    def shown(p: Column) -> Column:
        text = F.when(p["type"] == "text", p["text"])
        return text if image is None else text.when(p["type"] == "image", F.lit(image))

    # array_join skips the nulls that other part types leave.
    return F.array_join(F.transform(parts, shown), "")


def turn(role: Column, parts: Column, tokens: ChatTokens, spoken: Column | None = None) -> Column:
    """One rendered turn. ``spoken`` false leaves an assistant turn without body."""
    answer = _joined(parts, None)
    if spoken is not None:
        answer = F.when(spoken, answer).otherwise("")
    asked = _joined(parts, tokens.image)
    opened = lambda who: F.lit(tokens.start + HEADINGS[who])
    return (
        F.when(role == "assistant", F.concat(opened("assistant"), answer, F.lit(tokens.end)))
        .when(role == "user", F.concat(opened("user"), asked, F.lit(TURN_GAP + tokens.end)))
        .when(role == "system", F.concat(opened("system"), asked, F.lit(TURN_GAP + tokens.end)))
        .otherwise(F.lit(tokens.start + tokens.end))
    )


def closing(tokens: ChatTokens, include_last: bool = True, open_assistant: bool = False) -> str:
    if not include_last:
        return ""
    return HEADINGS["assistant"] if open_assistant else tokens.eos


def conversation(
    parsed: Column, tokens: ChatTokens, include_last: bool = True, open_assistant: bool = False
) -> Column:
    """A parsed conversation as one string; null when any message is unusable."""

    def piece(m: Column, i: Column) -> Column:
        spoken = None if include_last else i < F.size(parsed) - 1
        return turn(m["role"], m["parts"], tokens, spoken)

    usable = ~F.exists(parsed, lambda m: m["parts"].isNull())
    text = F.array_join(F.transform(parsed, piece), "")
    return F.when(usable, F.concat(text, F.lit(closing(tokens, include_last, open_assistant))))
