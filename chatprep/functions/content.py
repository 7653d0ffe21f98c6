"""Message content: JSON text in, a list of typed parts out.

A parsed message is ``struct<role, parts: array<struct<type, text>>>``. ``parts``
is null when the content cannot be used, which the guards report as
``bad_content``. A plain string becomes one text part, so the template only ever
sees parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = "struct<type:string,text:string>"
_RAW_PARTS = "array<struct<type:string,text:variant>>"

# The characters Python counts as white space at a string's ends.
WHITESPACE = "".join(
    map(
        chr,
        [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288],
    )
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def part(kind: str, text: Column | None = None) -> Column:
    body = F.lit(None).cast("string") if text is None else text
    return F.struct(F.lit(kind).alias("type"), body.alias("text"))


def caption_messages(caption: Column) -> Column:
    """A caption as a two-turn conversation with JSON content."""
    return F.array(
        F.struct(
            F.lit("user").alias("role"),
            F.lit('[{"type":"image"}]').alias("content"),
        ),
        F.struct(
            F.lit("assistant").alias("role"),
            F.to_json(F.array(part("text", caption))).alias("content"),
        ),
    )


def caption_parsed(caption: Column) -> Column:
    """What parsing ``caption_messages`` with stripping gives, without the
    round trip through JSON."""
    said = F.when(caption.isNotNull(), F.array(part("text", strip(caption))))
    return F.array(
        F.struct(F.lit("user").alias("role"), F.array(part("image")).alias("parts")),
        F.struct(F.lit("assistant").alias("role"), said.alias("parts")),
    )


def _float_text(v: str) -> str:
    """A double as Python prints it: exponent form only below 1e-4 or from 1e16,
    a trailing ``.0`` on whole numbers."""
    digits = f"""CASE WHEN abs({v}) < 1 THEN string(CAST({v} AS DECIMAL(38,22)))
                      ELSE string(CAST({v} AS DECIMAL(38,18))) END"""
    return rf"""CASE
        WHEN {v} = 0 THEN string({v})
        WHEN abs({v}) < 1e-4D OR abs({v}) >= 1e16D THEN concat(
            regexp_replace(substring_index(string({v}), 'E', 1), r'\.0$', ''),
            CASE WHEN abs({v}) < 1 THEN 'e-' ELSE 'e+' END,
            format_string('%02d', abs(int(substring_index(string({v}), 'E', -1)))))
        WHEN abs({v}) < 1e-3D OR abs({v}) >= 1e7D
            THEN regexp_replace(regexp_replace({digits}, r'0+$', ''), r'\.$', '.0')
        ELSE string({v}) END"""


def _typed(value: str) -> str:
    """Fields ``kind``, ``said`` and ``number`` of a JSON value, each read once."""
    return f"""schema_of_variant({value}) AS kind,
        try_variant_get({value}, '$', 'string') AS said,
        CASE WHEN schema_of_variant({value}) RLIKE '^D|^BIGINT$'
             THEN try_variant_get({value}, '$', 'double') END AS number"""


def _scalar_text(v: str) -> str:
    """A typed JSON scalar as Python's ``str`` gives it; null for null, lists and
    objects. Decimals of 19 digits and more without fraction are long integers."""
    return rf"""CASE
        WHEN {v}.kind IN ('STRING', 'BIGINT') THEN {v}.said
        WHEN {v}.kind = 'BOOLEAN' THEN initcap({v}.said)
        WHEN {v}.kind RLIKE r'^DECIMAL\((19|[23]\d),0\)$' THEN {v}.said
        WHEN {v}.number IS NOT NULL THEN {_float_text(v + ".number")} END"""


def _list_parts(value: str, strict: bool) -> str:
    """Parts of a JSON list. Strict recipes touch ``type`` and ``text`` of each
    part, so a part that lacks them spoils the message; lenient ones skip it."""
    if strict:
        blanks = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
        text = f"CASE WHEN p.kind = 'STRING' THEN trim(BOTH '{blanks}' FROM p.said) ELSE {_scalar_text('p')} END"
    else:
        # No text at all prints as nothing, a null text as Python's None.
        text = f"""CASE WHEN p.kind IS NULL THEN '' WHEN p.kind = 'VOID' THEN 'None'
                        ELSE {_scalar_text('p')} END"""
    # A text part left without text held a list, an object or nothing usable.
    hollow = "(p.type = 'text' AND p.text IS NULL)"
    spoilt = f"p.type IS NULL OR {hollow}" if strict else f"coalesce({hollow}, false)"
    parts = f"""transform(
        transform(try_variant_get({value}, '$', '{_RAW_PARTS}'),
                  p -> struct(p.type AS type, {_typed("p.text")})),
        p -> struct(p.type AS type, CASE WHEN p.type = 'text' THEN {text} END AS text))"""
    return f"""transform(array({parts}), ps -> CASE WHEN NOT exists(ps, p -> {spoilt}) THEN ps END)[0]"""


def parse_messages(messages: str, numeric_to_text: bool = True, strip_parts: bool = False) -> Column:
    """``array<struct<role, content>>``, given as SQL, to ``array<struct<role, parts>>``."""
    scalar_leads = ['"', *"tf-0123456789"] if numeric_to_text else ['"']
    leads = ", ".join(f"'{c}'" for c in scalar_leads)
    return F.expr(
        rf"""transform(
            transform({messages}, m -> struct(
                m.role AS role,
                substring(ltrim(' \t\n\r', m.content), 1, 1) AS lead,
                try_parse_json(m.content) AS value)),
            m -> struct(m.role AS role, CASE
                WHEN m.value IS NULL THEN NULL
                WHEN m.lead = '[' THEN {_list_parts("m.value", strip_parts)}
                WHEN m.lead IN ({leads}) THEN transform(
                    array(struct({_typed("m.value")})),
                    v -> struct('text' AS type, {_scalar_text("v")} AS text))
                WHEN m.lead = '{{' THEN CAST(array() AS array<{PART}>) END AS parts))"""
    )


def content_kind(content: Column) -> Column:
    """list, string, number, bool, object, null or invalid."""
    lead = F.substring(F.ltrim(content, F.lit(" \t\n\r")), 1, 1)
    return (
        F.when(F.try_parse_json(content).isNull(), "invalid")
        .when(lead == "[", "list")
        .when(lead == '"', "string")
        .when(lead == "{", "object")
        .when(lead.isin("t", "f"), "bool")
        .when(lead == "n", "null")
        .otherwise("number")
    )
