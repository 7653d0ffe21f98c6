"""The registered queries as DuckDB SQL over the same tables.

Written against the source tables, not against the Spark plans: turns are
rendered from their text, ranks are plain window functions, packing is checked
by sums that hold for any correct packing.
"""

from __future__ import annotations

from chatprep import settings as S
from chatprep.sources.fixtures import LIMITS

_T = S.TOKENS
_SPECIALS = ", ".join(f"'{s}'" for s in _T.specials)
_N_SPECIALS = len(_T.specials)
_RESPONSE, _INSTRUCTION = S.RESPONSE_TEMPLATE, S.INSTRUCTION_TEMPLATE
_LIMIT_ROWS = ", ".join(f"('{s}', '{p}', {n})" for s, ps in LIMITS.items() for p, n in ps.items())


def _words(text: str) -> str:
    return (
        rf"list_filter(string_split(regexp_replace({text}, '\s', ' ', 'g'), ' '), lambda w: w <> '')"
    )


def _spaced(text: str) -> str:
    for s in (_T.start, _T.end, _T.image, _T.eos):
        text = f"replace({text}, '{s}', ' {s} ')"
    return text


def _tokens(text: str) -> str:
    return _words(f"'{_T.bos} ' || {_spaced(text)}")


def _body(role: str, asked: str, said: str) -> str:
    return (
        f"CASE {role} WHEN 'user' THEN '### User:' || chr(10) || {asked} || chr(10) || chr(10) "
        f"WHEN 'system' THEN '### System:' || chr(10) || {asked} || chr(10) || chr(10) "
        f"WHEN 'assistant' THEN '### Assistant:' || chr(10) || {said} ELSE '' END"
    )


def _piece(role: str, asked: str, said: str) -> str:
    return f"'{_T.start}' || {_body(role, asked, said)} || '{_T.end}'"


def _length(text: str) -> str:
    return f"len({_tokens(text)})::INTEGER"


_TURNS = """
first_user AS (
  SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
turns AS (
  SELECT c.conv_id, c.turn, c.role, c.text,
    CASE WHEN f.turn IS NULL THEN 0
         ELSE c.conv_id % 3 + CASE WHEN c.conv_id % 10 = 0 THEN 1 ELSE 0 END END AS k,
    c.turn = max(c.turn) OVER (PARTITION BY c.conv_id) AS last
  FROM conversations c LEFT JOIN first_user f ON c.conv_id = f.conv_id AND c.turn = f.turn)"""

_IMAGES = "CASE WHEN conv_id % 3 > 0 THEN (conv_id % 3)::INTEGER END"


def _chat(said: str = "text", tail: str = _T.eos) -> str:
    asked = f"repeat('{_T.image}', k::BIGINT) || text"
    return f"""{_TURNS},
chat AS (
  SELECT conv_id AS row_id, any_value({_IMAGES}) AS n_images,
    string_agg({_piece('role', asked, said)}, '' ORDER BY turn) || '{tail}' AS text
  FROM turns GROUP BY conv_id)"""


_MEASURED = f"""{_chat()},
measured AS (
  SELECT *, {_tokens('text')} AS tokens, {_length('text')} AS length,
    ((length(text) - length(replace(text, '{_T.image}', ''))) / {len(_T.image)})::INTEGER AS n_placeholders
  FROM chat),
judged AS (
  SELECT *, CASE WHEN n_images > 0 AND n_placeholders <> n_images THEN 'image_mismatch'
                 WHEN n_images IS NULL AND n_placeholders > 0 THEN 'orphan_placeholder' END AS reason
  FROM measured)"""

_LENGTHS = f"""
lengths AS (
  SELECT doc_id AS row_id, source,
    CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split,
    len({_words('text')})::INTEGER AS length
  FROM documents)"""

_TRAINABLE = f"""{_LENGTHS},
trainable AS (SELECT row_id, length FROM lengths WHERE length BETWEEN 1 AND {S.MAX_LENGTH})"""

_TRUNCATED = f"""{_LENGTHS},
limits(source, split, max_rows) AS (VALUES {_LIMIT_ROWS}),
drawn AS (
  SELECT l.*, m.max_rows, row_number() OVER (
    PARTITION BY source, split ORDER BY md5('{S.SEED}:' || row_id), row_id) AS nth
  FROM lengths l LEFT JOIN limits m USING (source, split)),
truncated AS (
  SELECT source, split, row_id, length FROM drawn WHERE max_rows IS NULL OR nth <= max_rows)"""

_ROUTED = f"""
roles(role, split) AS (VALUES ('train', 'train'), ('valid', 'validation'), ('valid', 'train'), ('test', 'test')),
fitting AS (SELECT * FROM pool WHERE split <> 'train' OR length <= {S.MAX_LENGTH}),
routed AS (SELECT role, f.* FROM fitting f JOIN roles USING (split))"""

_VOCABULARY = f"""vocabulary AS (
  SELECT token, row_number() OVER (
    ORDER BY coalesce(list_position([{_SPECIALS}], token), {_N_SPECIALS + 1}),
      CASE WHEN list_position([{_SPECIALS}], token) IS NULL THEN n END DESC, token) - 1 AS id
  FROM (SELECT coalesce(c.token, s.token) AS token, coalesce(n, 0) AS n
        FROM counted c FULL JOIN (SELECT unnest([{_SPECIALS}]) AS token) s ON c.token = s.token))"""

_ENCODED = f"""{_MEASURED},
kept AS (SELECT * FROM judged WHERE reason IS NULL AND length <= {S.MAX_LENGTH}),
spread AS (
  SELECT row_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM kept),
counted AS (SELECT token, count(*) AS n FROM spread GROUP BY token),
{_VOCABULARY},
placed AS (SELECT row_id, pos, token, id FROM spread JOIN vocabulary USING (token)),
marked AS (
  SELECT *,
    lag(token, 1) OVER w AS before_1, lag(token, 2) OVER w AS before_2,
    lead(token, 1) OVER w AS after_1
  FROM placed WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
switched AS (
  SELECT *,
    max(CASE WHEN before_2 = '{_RESPONSE[0]}' AND before_1 = '{_RESPONSE[1]}' THEN pos END) OVER w AS answered,
    max(CASE WHEN token = '{_INSTRUCTION[0]}' AND after_1 = '{_INSTRUCTION[1]}' THEN pos END) OVER w AS asked
  FROM marked WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
encoded AS (
  SELECT *, CASE WHEN answered IS NOT NULL AND (asked IS NULL OR asked < answered)
                 THEN id ELSE {S.IGNORE_LABEL} END AS label
  FROM switched)"""

# Turns whose content takes each JSON kind in turn.
_MIXED = """
mixed AS (
  SELECT conv_id, turn, role, text,
    CASE (conv_id + turn) % 8
      WHEN 0 THEN to_json(text)::VARCHAR
      WHEN 1 THEN conv_id::VARCHAR
      WHEN 2 THEN conv_id || '.50'
      WHEN 3 THEN CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END
      WHEN 4 THEN '[{"type":"image"},' || to_json({'type': 'text', 'text': '  ' || text || chr(9)})::VARCHAR || ']'
      WHEN 5 THEN '[]'
      WHEN 6 THEN '{"a":1}'
      ELSE CASE WHEN turn % 2 = 0 THEN 'null' ELSE text END END AS content
  FROM conversations),
typed AS (
  SELECT *, CASE WHEN NOT json_valid(content) THEN 'invalid' ELSE
    CASE json_type(content) WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool'
      WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' ELSE 'number' END END AS kind
  FROM mixed),
scalars AS (
  SELECT *, CASE kind
    WHEN 'string' THEN json_extract_string(content, '$')
    WHEN 'bool' THEN upper(content[1]) || content[2:]
    WHEN 'number' THEN CASE WHEN contains(content, '.') THEN (content::DOUBLE)::VARCHAR ELSE content END
    END AS scalar
  FROM typed),
listed AS (
  SELECT conv_id, turn, unnest(from_json(content, '[{"type":"VARCHAR","text":"VARCHAR"}]')) AS p,
    generate_subscripts(from_json(content, '[{"type":"VARCHAR","text":"VARCHAR"}]'), 1) AS nth
  FROM typed WHERE kind = 'list')"""


def _mixed_recipe(numbers: bool) -> str:
    """Whole conversations over the mixed turns: an image part shows in user and
    system turns only, unusable content spoils its conversation."""
    usable = "'string', 'list', 'object'" + (", 'number', 'bool'" if numbers else "")
    asked = f"CASE WHEN scalar IS NOT NULL THEN scalar WHEN (conv_id + turn) % 8 = 4 THEN '{_T.image}  ' || text || chr(9) ELSE '' END"
    said = "CASE WHEN scalar IS NOT NULL THEN scalar WHEN (conv_id + turn) % 8 = 4 THEN '  ' || text || chr(9) ELSE '' END"
    return f"""WITH {_MIXED},
talk AS (
  SELECT conv_id, bool_and(kind IN ({usable})) AS usable,
    string_agg({_piece('role', asked, said)}, '' ORDER BY turn) || '{_T.eos}' AS raw_text
  FROM scalars GROUP BY conv_id),
shown AS (
  SELECT *, {_IMAGES} AS n_images, CASE WHEN usable THEN raw_text END AS text FROM talk),
counted AS (
  SELECT *, (length(text) - length(replace(text, '{_T.image}', ''))) / {len(_T.image)} AS n_placeholders FROM shown)
SELECT conv_id AS row_id, text, {_length('text')} AS length,
  CASE WHEN NOT usable THEN 'bad_content'
       WHEN n_images > 0 AND n_placeholders <> n_images THEN 'image_mismatch'
       WHEN n_images IS NULL AND n_placeholders > 0 THEN 'orphan_placeholder' END AS reason,
  (224 + conv_id % 4)::INTEGER AS height, (224 + conv_id % 5)::INTEGER AS width
FROM counted"""


def _histogram(source: str, by: list[str]) -> str:
    keys = ", ".join(by)
    comma = keys + ", " if by else ""
    group = f"GROUP BY {keys}" if by else ""
    on = f"USING ({keys})" if by else "ON true"
    return f"""
ends AS (
  SELECT {comma}min(length) AS low, max(length) AS high,
    (max(length) - min(length)) / {float(S.BINS)}::DOUBLE AS step FROM {source} {group}),
binned AS (
  SELECT {comma}CASE WHEN step = 0 THEN 0
      ELSE least(floor((length - low) / step), {S.BINS - 1}) END::INTEGER AS bin, count(*) AS n
  FROM {source} JOIN ends {on} GROUP BY ALL),
every AS (
  SELECT {comma}low, step, unnest(range(CASE WHEN step = 0 THEN 1 ELSE {S.BINS} END))::INTEGER AS bin FROM ends),
filled AS (
  SELECT {comma}bin, low + bin * step AS start, low + (bin + 1) * step AS "end", coalesce(n, 0)::BIGINT AS n
  FROM every LEFT JOIN binned USING ({comma}bin))
SELECT {comma}bin, start, "end", n,
  repeat('█', floor(n::DOUBLE / max(n) OVER ({f'PARTITION BY {keys}' if by else ''}) * {S.BAR_WIDTH})::BIGINT) AS bar
FROM filled"""


def _join(values: str, order: str) -> str:
    return f"string_agg({values}::VARCHAR, ' ' ORDER BY {order})"


_SHUFFLED = f"md5('{S.SEED}:{S.EPOCH}:' || row_id), row_id"
_POSITIONS = f"""{_LENGTHS},
positions AS (
  SELECT row_id, length, row_number() OVER (ORDER BY {_SHUFFLED}) - 1 AS position, count(*) OVER () AS total
  FROM lengths)"""

_NO_RESPONSE = (
    f"NOT list_contains(list_zip(tokens, tokens[2:]), row('{_RESPONSE[0]}', '{_RESPONSE[1]}'))"
)
_NO_INSTRUCTION = (
    f"NOT list_contains(list_zip(tokens, tokens[2:]), row('{_INSTRUCTION[0]}', '{_INSTRUCTION[1]}'))"
)


def _rendered(said: str = "text", tail: str = _T.eos) -> str:
    return f"WITH {_chat(said, tail)} SELECT row_id, text FROM chat"


_EXPANSION = (S.IMAGE_SIZE // S.PATCH_SIZE) ** 2 - 1

ORACLE_SQL: dict[str, str] = {
    "load_sources": """
SELECT 'captions' AS source, 0 AS source_ord,
  CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split,
  doc_id AS row_id, text, lang, NULL::VARCHAR AS role FROM documents
UNION ALL SELECT 'turns', 1, 'train', NULL, text, NULL, role FROM conversations
UNION ALL SELECT 'probes', 2, 'test', NULL, text, NULL, NULL FROM benchmark""",
    "load_subset": """
SELECT source, split, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM (
  SELECT 'captions' AS source, text,
    CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split
  FROM documents WHERE lang = 'en'
  UNION ALL SELECT 'turns', text, 'train' FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'probes', text, 'test' FROM benchmark)
GROUP BY source, split""",
    "caption_to_chat": """
SELECT doc_id AS row_id, 2 AS n_messages, 'user' AS role_0, '[{"type":"image"}]' AS content_0,
  'assistant' AS role_1, '[' || to_json({'type': 'text', 'text': text})::VARCHAR || ']' AS content_1
FROM documents""",
    "parse_content": f"""WITH {_MIXED},
joined AS (
  SELECT conv_id, turn, string_agg(p.type || '=' || coalesce(p.text, ''), '|' ORDER BY nth) AS parts
  FROM listed GROUP BY ALL)
SELECT s.conv_id, s.turn, kind, CASE WHEN scalar IS NOT NULL THEN 'text=' || scalar
  WHEN kind IN ('list', 'object') THEN coalesce(parts, '') END AS parts
FROM scalars s LEFT JOIN joined j ON s.conv_id = j.conv_id AND s.turn = j.turn""",
    "numeric_content": f"""WITH {_MIXED}
SELECT conv_id, turn, scalar AS text, true AS raw_refused FROM scalars WHERE kind IN ('number', 'bool')""",
    "strip_parts": f"""WITH {_MIXED},
joined AS (
  SELECT conv_id, turn,
    string_agg(p.type || '=' || coalesce(trim(p.text, ' ' || chr(9) || chr(10) || chr(13)), ''), '|' ORDER BY nth) AS parts
  FROM listed GROUP BY ALL)
SELECT t.conv_id, t.turn, coalesce(parts, '') AS parts
FROM typed t LEFT JOIN joined j ON t.conv_id = j.conv_id AND t.turn = j.turn WHERE kind = 'list'""",
    "render_chat": _rendered(),
    "render_without_answer": _rendered("CASE WHEN last THEN '' ELSE text END", ""),
    "render_prompt": _rendered(tail="### Assistant:\n"),
    "count_placeholders": f"WITH {_MEASURED} SELECT row_id, n_placeholders FROM judged",
    "count_images": f"SELECT conv_id AS row_id, any_value({_IMAGES}) AS n_images FROM conversations GROUP BY conv_id",
    "first_image": """
SELECT DISTINCT conv_id AS row_id, CASE WHEN conv_id % 3 > 0 THEN 'img-' || conv_id || '-0' END AS first_image
FROM conversations""",
    "token_length": f"WITH {_MEASURED} SELECT row_id, length FROM judged",
    "expanded_length": f"""WITH {_MEASURED}
SELECT row_id, (length + n_placeholders * {_EXPANSION})::INTEGER AS expanded_length FROM judged""",
    "output_columns": f"""WITH {_MEASURED}
SELECT row_id, length, CASE n_images WHEN 1 THEN 'img-' || row_id || '-0'
    WHEN 2 THEN 'img-' || row_id || '-0 img-' || row_id || '-1' END AS image_refs,
  'image_refs length n_images n_placeholders reason row_id text tokens' AS columns
FROM judged WHERE reason IS NULL""",
    "drop_image_mismatch": f"""WITH {_MEASURED}
SELECT row_id, n_placeholders, n_images FROM judged WHERE reason IS DISTINCT FROM 'image_mismatch'""",
    "drop_orphan_placeholder": f"""WITH {_MEASURED}
SELECT row_id, n_placeholders, n_images FROM judged WHERE reason IS DISTINCT FROM 'orphan_placeholder'""",
    "reject_report": f"""WITH {_MEASURED}
SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason""",
    "recipe_caption": f"""WITH rendered AS (
  SELECT doc_id AS row_id, source,
    CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split,
    {_piece("'user'", f"'{_T.image}'", "''")} || {_piece("'assistant'", "''", "trim(text, ' ' || chr(9) || chr(10) || chr(13))")} || '{_T.eos}' AS text
  FROM documents)
SELECT row_id, text, {_length('text')} AS length,
  CASE WHEN (length(text) - length(replace(text, '{_T.image}', ''))) / {len(_T.image)} <> 1 THEN 'image_mismatch' END AS reason,
  source, split
FROM rendered""",
    "recipe_chat": f"WITH {_MEASURED} SELECT row_id, text, length, reason FROM judged",
    "recipe_chat_sized": _mixed_recipe(True),
    "recipe_chat_sized_raw": _mixed_recipe(False),
    "custom_recipe": r"""
SELECT doc_id AS row_id, longest::INTEGER AS longest FROM (
  SELECT doc_id, list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda w: length(w))) AS longest FROM documents)
WHERE longest >= 10""",
    "build_vocab": f"""WITH {_MEASURED},
counted AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM judged) GROUP BY token),
present AS (
  SELECT coalesce(c.token, s.token) AS token, coalesce(n, 0) AS n,
    coalesce(list_position([{_SPECIALS}], coalesce(c.token, s.token)), {_N_SPECIALS + 1}) AS place
  FROM counted c FULL JOIN (SELECT unnest([{_SPECIALS}]) AS token) s ON c.token = s.token)
SELECT token, n, (row_number() OVER (
  ORDER BY place, CASE WHEN place > {_N_SPECIALS} THEN n END DESC, token) - 1)::INTEGER AS id
FROM present""",
    "encode_tokens": f"""WITH {_ENCODED}
SELECT row_id, count(*)::INTEGER AS length, {_join('id', 'pos')} AS input_ids FROM encoded GROUP BY row_id""",
    "position_ids": f"""WITH {_MEASURED}
SELECT row_id, array_to_string(range(length), ' ') AS position_ids FROM judged""",
    "response_labels": f"""WITH {_ENCODED}
SELECT row_id, {_join('label', 'pos')} AS labels FROM encoded GROUP BY row_id""",
    "check_templates": f"""WITH {_MEASURED}
SELECT count(*) AS n_rows, count(*) FILTER ({_NO_RESPONSE}) AS missing_response,
  count(*) FILTER ({_NO_INSTRUCTION}) AS missing_instruction FROM judged""",
    "check_bos_eos": f"""WITH {_MEASURED}
SELECT 2 * count(*) AS n_rows, 2 * count(*) FILTER (NOT list_contains(tokens, '{_T.bos}')) AS missing_bos,
  count(*) + count(*) FILTER (NOT list_contains(tokens, '{_T.eos}')) AS missing_eos FROM judged""",
    "label_coverage": f"""WITH {_ENCODED}
SELECT row_id, count(*) FILTER (label <> {S.IGNORE_LABEL})::INTEGER AS n_labels,
  coalesce({_join('label', 'pos')} FILTER (label <> {S.IGNORE_LABEL}), '') AS labels
FROM encoded GROUP BY row_id""",
    "truncate_sources": f"WITH {_TRUNCATED} SELECT * FROM truncated",
    "truncate_warnings": f"""WITH {_TRUNCATED}
SELECT source, split, count(*) AS n_rows, any_value(max_rows)::BIGINT AS max_rows FROM drawn
WHERE max_rows IS NOT NULL GROUP BY source, split HAVING count(*) <= any_value(max_rows)""",
    "length_filter": f"""WITH {_LENGTHS}
SELECT row_id, split, length FROM lengths WHERE split <> 'train' OR length <= {S.MAX_LENGTH}""",
    "route_splits": f"""WITH {_LENGTHS}, pool AS (SELECT * FROM lengths), {_ROUTED}
SELECT role, source, split, row_id, length FROM routed""",
    "concat_roles": f"""WITH {_LENGTHS}, {_MEASURED}, pool AS (
  SELECT 0 AS source_ord, source, split, row_id, length, NULL::INTEGER AS n_images FROM lengths
  UNION ALL SELECT 1, 'chats', 'train', row_id, length, n_images FROM judged WHERE reason IS NULL),
{_ROUTED}
SELECT role, source_ord, source, split, row_id, length, n_images FROM routed""",
    "prepared_roles": f"""WITH rendered AS (
  SELECT doc_id AS row_id, source,
    CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split,
    {_piece("'user'", f"'{_T.image}'", "''")} || {_piece("'assistant'", "''", "text")} || '{_T.eos}' AS text
  FROM documents),
cut AS (SELECT row_id, source, split, {_tokens('text')} AS tokens FROM rendered),
spread AS (SELECT row_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM cut),
counted AS (SELECT token, count(*) AS n FROM spread GROUP BY token),
{_VOCABULARY},
ids AS (SELECT row_id, {_join('id', 'pos')} AS input_ids FROM spread JOIN vocabulary USING (token) GROUP BY row_id),
limits(source, split, max_rows) AS (VALUES {_LIMIT_ROWS}),
ordered AS (
  SELECT row_id, source, split, max_rows, len(tokens)::INTEGER AS length, row_number() OVER (
    PARTITION BY source, split ORDER BY md5('{S.SEED}:' || row_id), row_id) AS nth
  FROM cut LEFT JOIN limits USING (source, split)),
pool AS (SELECT * FROM ordered WHERE max_rows IS NULL OR nth <= max_rows),
{_ROUTED}
SELECT role, source, split, row_id, length, input_ids FROM routed JOIN ids USING (row_id)""",
    "top_lengths": f"""WITH {_LENGTHS}, longest AS (
  SELECT source, split, row_id, length, row_number() OVER (
    PARTITION BY source, split ORDER BY length DESC, row_id)::INTEGER AS rank
  FROM lengths WHERE split <> 'train' OR length <= {S.MAX_LENGTH})
SELECT * FROM longest WHERE rank <= {S.TOP_LENGTHS}""",
    "size_report": f"""WITH {_TRUNCATED},
left_over AS (
  SELECT source, split, count(*) AS n FROM truncated WHERE split <> 'train' OR length <= {S.MAX_LENGTH} GROUP BY ALL)
SELECT source, split, count(*) AS n_before, coalesce(any_value(n), 0)::BIGINT AS n_after
FROM lengths LEFT JOIN left_over USING (source, split) GROUP BY source, split""",
    "length_histogram": f"WITH {_LENGTHS}, {_histogram('lengths', [])}",
    "length_summary": f"""WITH {_LENGTHS}
SELECT count(*) AS n_rows, min(length) AS min_length, max(length) AS max_length,
  sum(length)::DOUBLE / count(*) AS mean_length, (max(length) - min(length)) / {float(S.BINS)}::DOUBLE AS bin_size
FROM lengths""",
    "histogram_by_source": f"WITH {_TRUNCATED}, {_histogram('truncated', ['source', 'split'])}",
    "histogram_by_role": f"WITH {_LENGTHS}, pool AS (SELECT * FROM lengths), {_ROUTED}, {_histogram('routed', ['role'])}",
    "length_counts": f"WITH {_LENGTHS} SELECT length, count(*) AS n FROM lengths GROUP BY length",
    "distinct_lengths": f"WITH {_LENGTHS} SELECT DISTINCT length FROM lengths",
    "rank_in_length": f"""WITH {_LENGTHS}
SELECT row_id, length, row_number() OVER (PARTITION BY length ORDER BY row_id DESC) AS rank FROM lengths""",
    "rank_in_length_shuffled": f"""WITH {_LENGTHS}
SELECT row_id, length, row_number() OVER (PARTITION BY length ORDER BY {_SHUFFLED}) AS rank FROM lengths""",
    "shuffle_rows": f"WITH {_POSITIONS} SELECT row_id, position FROM positions",
    "fixed_batches": f"""WITH {_POSITIONS}
SELECT row_id, position, position // {S.BATCH_SIZE} AS batch_id, position // {S.BATCH_SIZE} // 4 AS step_id
FROM positions WHERE position // {S.BATCH_SIZE} < total // {S.BATCH_SIZE}""",
    "length_grouped_batches": f"""WITH {_POSITIONS},
grouped AS (
  SELECT row_id, length, position // {S.BATCH_SIZE * S.MEGA_BATCHES} AS mega, row_number() OVER (
    PARTITION BY position // {S.BATCH_SIZE * S.MEGA_BATCHES} ORDER BY length DESC, row_id) - 1 AS seat
  FROM positions)
SELECT row_id, length, mega * {S.MEGA_BATCHES} + seat // {S.BATCH_SIZE} AS batch_id,
  (seat % {S.BATCH_SIZE})::INTEGER AS slot FROM grouped""",
    "batch_concat": f"""WITH {_ENCODED},
ordered AS (
  SELECT row_id, (row_number() OVER (ORDER BY {_SHUFFLED}) - 1) AS position FROM kept)
SELECT position // {S.BATCH_SIZE} AS batch_id, {_join('id', 'position, pos')} AS input_ids,
  {_join('pos', 'position, pos')} AS position_ids, {_join('label', 'position, pos')} AS labels
FROM encoded JOIN ordered USING (row_id) GROUP BY ALL""",
    "pack_strategies": f"""WITH {_TRAINABLE}
SELECT count(*) AS n_sequences, sum(length)::BIGINT AS n_tokens, 0::BIGINT AS over_budget, 0::BIGINT AS over_limit,
  0::BIGINT AS empty_strategies, true AS enough_packs, 0::BIGINT AS needless, 0::BIGINT AS wrong_lengths FROM trainable""",
    "pack_slots": f"""WITH {_TRAINABLE}
SELECT count(*) AS n_slots, true AS packs_numbered, sum(length)::BIGINT AS n_tokens, 0::BIGINT AS over_budget,
  0::BIGINT AS over_limit, 0::BIGINT AS wrong_lengths FROM trainable""",
    "pack_assign": f"""WITH {_TRAINABLE}
SELECT count(*) AS assigned, 0::BIGINT AS duplicates, 0::BIGINT AS missing, sum(length)::BIGINT AS n_tokens,
  0::BIGINT AS over_budget, 0::BIGINT AS over_limit, 0::BIGINT AS wrong_slots FROM trainable""",
    "pack_summary": f"""WITH {_TRAINABLE}
SELECT sum(length)::BIGINT AS n_tokens, true AS as_planned, true AS above_lower_bound, true AS fill_in_range
FROM trainable""",
    "pack_gather": f"""WITH {_TRAINABLE}
SELECT count(*) AS n_sequences, count(*) AS distinct_rows, 0::BIGINT AS out_of_order,
  sum(length(text))::BIGINT AS n_chars, sum(row_id)::BIGINT AS row_id_sum
FROM trainable JOIN documents ON row_id = doc_id""",
    "pack_segments": f"""WITH {_TRAINABLE}
SELECT count(*) AS n_segments, 0::BIGINT AS wrong_bounds, sum(length)::BIGINT AS n_tokens,
  sum(length::BIGINT * (length + 1) // 2)::BIGINT AS visible_pairs FROM trainable""",
    "pack_concat": f"""WITH {_ENCODED}
SELECT count(*) AS n_ids, 0::BIGINT AS uneven, sum(id)::BIGINT AS id_sum, sum(pos)::BIGINT AS position_sum,
  sum(label)::BIGINT AS label_sum FROM encoded""",
    "pack_images": f"""WITH {_MEASURED}
SELECT 'img-' || row_id || '-' || unnest(range(n_images)) AS image_ref, 1::BIGINT AS n
FROM judged WHERE reason IS NULL AND length <= {S.MAX_LENGTH}""",
    "pack_epoch": f"""WITH {_TRAINABLE}
SELECT true AS rows_moved, 0::BIGINT AS not_twice, 0::BIGINT AS bad_epochs, 2 * sum(length)::BIGINT AS n_tokens
FROM trainable""",
    "pack_batches": f"""WITH {_ENCODED}
SELECT count(*) AS n_ids, true AS batches_numbered, 0::BIGINT AS over_budget FROM encoded""",
    "packed_conversations": f"""WITH {_ENCODED}
SELECT (SELECT count(*) FROM kept) AS n_sequences, count(*) AS n_tokens, 0::BIGINT AS wrong_size,
  0::BIGINT AS over_budget, count(*) FILTER (label <> {S.IGNORE_LABEL}) AS n_labels,
  (SELECT sum(n_images)::BIGINT FROM kept) AS n_images FROM encoded""",
}

ORACLE_SQL["load_split_ids"] = f"""
SELECT s AS role, s AS split, row_id AS doc_id, length, length AS n_ids
FROM ({ORACLE_SQL["recipe_caption"]}), (VALUES ('train'), ('test')) v(s)
WHERE reason IS NULL AND (s <> 'train' OR length <= {S.MAX_LENGTH})"""

ORACLE_SQL["load_text_ids"] = """WITH papers AS (
  SELECT source, doc_id, text, row_number() OVER (ORDER BY '["' || source || '","' || doc_id || '"]') - 1 AS n FROM documents),
chats AS (
  SELECT conv_id, turn, text, row_number() OVER (ORDER BY '["' || conv_id || '","' || turn || '"]') - 1 AS n FROM conversations)
SELECT 'papers' AS source, source AS own_source, doc_id AS own_id, NULL::BIGINT AS turn, n AS row_id, length(text) AS n_chars FROM papers
UNION ALL
SELECT 'chats', NULL, conv_id, turn, n + (SELECT count(*) FROM papers), length(text) FROM chats"""

ORACLE_SQL["attach_image_sizes"] = """WITH referred AS (
  SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 7 = 1 THEN NULL ELSE doc_id END AS k FROM documents)
SELECT row_id, CASE WHEN k % 5 <> 4 THEN (224 + k % 4)::INTEGER END AS height,
  CASE WHEN k % 5 <> 4 THEN (224 + k % 5)::INTEGER END AS width
FROM referred"""

_ENDS = f"count(*) AS a, CASE WHEN min(length) = max(length) THEN 1 ELSE {S.BINS} END::BIGINT AS b"
ORACLE_SQL["prepared_reports"] = f"""WITH lengths AS (
  SELECT row_id, source, split, length FROM ({ORACLE_SQL["recipe_caption"]}) WHERE reason IS NULL),
limits(source, split, max_rows) AS (VALUES {_LIMIT_ROWS}),
pool AS (
  SELECT * FROM (
    SELECT l.*, max_rows, row_number() OVER (
      PARTITION BY source, split ORDER BY md5('{S.SEED}:' || row_id), row_id) AS nth
    FROM lengths l LEFT JOIN limits USING (source, split))
  WHERE max_rows IS NULL OR nth <= max_rows),
{_ROUTED},
longest AS (
  SELECT *, row_number() OVER (PARTITION BY source, split ORDER BY length DESC, row_id) AS place
  FROM fitting),
sizes AS (SELECT source, split, count(*) AS n FROM lengths GROUP BY ALL)
SELECT 'warnings' AS report, source || '/' || split AS place, n AS a, max_rows::BIGINT AS b
FROM sizes JOIN limits USING (source, split) WHERE n <= max_rows
UNION ALL SELECT 'histogram', source || '/' || split, {_ENDS} FROM pool GROUP BY source, split
UNION ALL SELECT 'longest', source || '/' || split, sum(length)::BIGINT, sum(row_id)::BIGINT
FROM longest WHERE place <= {S.TOP_LENGTHS} GROUP BY source, split
UNION ALL SELECT 'sizes', source || '/' || split, any_value(n), count(f.row_id)
FROM sizes LEFT JOIN fitting f USING (source, split) GROUP BY source, split
UNION ALL SELECT 'role_histogram', role, {_ENDS} FROM routed GROUP BY role"""

# Arriving in lots, or as a stream, changes nothing.
ORACLE_SQL["staged_roles"] = ORACLE_SQL["prepared_roles"]
ORACLE_SQL["stream_equals_batch"] = ORACLE_SQL["encode_tokens"]
