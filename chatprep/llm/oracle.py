"""DuckDB SQL of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def near_dedup_sql(percent: int) -> str:
    """Groups of documents whose sets are linked from ``percent`` on."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * k >= {percent} * (x.n + y.n - k)
), reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  coalesce(m, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)
"""


OP4 = near_dedup_sql(85)

_TRIMMED = r"trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"

OP8 = f"""
WITH lines AS (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS l, generate_subscripts(str_split(text, chr(10)), 1) AS pos FROM documents
), filled AS (
  SELECT doc_id, pos, {_TRIMMED} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM lines WHERE {_TRIMMED} <> ''
), win AS (
  SELECT a.doc_id, a.line AS x, b.line AS y, c.line AS z, a.pos AS p, b.pos AS q, c.pos AS r
  FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN filled c ON a.doc_id = c.doc_id AND c.k = a.k + 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, p) AS nth FROM win),
covered AS (SELECT DISTINCT doc_id, unnest([p, q, r]) AS pos FROM ranked WHERE nth > 1),
kept AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN covered USING (doc_id, pos) GROUP BY 1
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  CASE WHEN d.text IS NOT NULL THEN coalesce(n, 0) END::BIGINT AS removed_lines
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1) USING (doc_id)
"""


def _op1(rounds: int, tempering: float, keep: float, seed: str) -> str:
    lost = lambda chars: f"length(text) - length(translate(text, '{chars}', ''))"
    sql = f"""
WITH doc AS (
  SELECT doc_id, source, lang, CASE WHEN text IS NULL OR length(text) < 400 THEN 'short'
    WHEN 20 * ({lost('|')}) >= length(text) THEN 'table' WHEN 20 * ({lost('!')}) >= length(text) THEN 'shouting'
    WHEN 20 * ({lost('#*$%&')}) >= length(text) THEN 'marked' ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM documents
), cell AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM doc GROUP BY ALL),
total AS (SELECT sum(tokens) * {keep} AS wanted FROM cell),
"""
    # A value gives all it has while the level that the others then need is above it.
    for name in ("source", "lang", "topic"):
        sql += f"""level_{name} AS (SELECT {name}, t, share, (wanted - coalesce(sum(t) OVER up, 0)) / sum(share) OVER down AS level
  FROM (SELECT {name}, sum(tokens) AS t, pow(sum(tokens), {tempering}) AS share FROM cell GROUP BY 1 HAVING sum(tokens) > 0), total
  WINDOW up AS (ORDER BY t / share, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    down AS (ORDER BY t / share, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goal_{name} AS (SELECT {name}, t, least(t, share * (SELECT max(level) FROM level_{name})) AS goal FROM level_{name}),
"""
    whole = " OR ".join(f"g_{name}.goal >= g_{name}.t * (1 - 1e-12)" for name in ("source", "lang", "topic"))
    joins = " ".join(f"JOIN goal_{n} g_{n} ON c.{n} IS NOT DISTINCT FROM g_{n}.{n}" for n in ("source", "lang", "topic"))
    sql += f"""fixed AS MATERIALIZED (SELECT c.*, {', '.join(f'g_{n}.goal AS goal_{n}' for n in ("source", "lang", "topic"))},
  CASE WHEN {whole} THEN tokens ELSE 0 END AS fixed FROM cell c {joins}),
w0 AS MATERIALIZED (SELECT source, lang, topic, tokens, fixed, tokens - fixed AS room, (tokens - fixed) * {keep} AS free,
  {', '.join(f"greatest(goal_{n} - sum(fixed) OVER (PARTITION BY {n}), 0) AS goal_{n}" for n in ("source", "lang", "topic"))} FROM fixed)"""
    step = 0
    for _ in range(rounds):
        for name in ("source", "lang", "topic"):
            step += 1
            sql += f""",
w{step} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(least(free, room)) OVER v > 0 THEN free * goal_{name} / sum(least(free, room)) OVER v ELSE 0 END AS free)
  FROM w{step - 1} WINDOW v AS (PARTITION BY {name}))"""
    return sql + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(p, 6) AS probability
FROM doc d JOIN (SELECT source, lang, topic, coalesce((fixed + least(free, room)) / tokens, 1.0) AS p FROM cell c LEFT JOIN
  (SELECT source AS s, lang AS l, topic AS o, fixed, free, room FROM w{step}) ON source IS NOT DISTINCT FROM s AND lang IS NOT DISTINCT FROM l AND topic = o AND tokens > 0) c
ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic
WHERE ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < p
"""


OP1 = _op1(40, 0.7, 0.5, "mix-1")

OP2 = """
WITH split AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{up}', '{low}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(verdict, length(r.host || r.path)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
""".format(up=_UPPER, low=_LOWER)

_PIECES = r"\p{L}+|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{N}]+"

OP7 = f"""
WITH now AS (
  SELECT doc_id, source, lang, CASE WHEN l.quality = 0 THEN regexp_replace(text, '[#*$%&!|]+', '', 'g') ELSE text END AS text
  FROM documents LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0
), counted AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS n FROM now
  UNION ALL SELECT source, lang, 'pieces-1', coalesce(len(regexp_extract_all(text, '{_PIECES}')), 0) FROM now
)
SELECT source, lang, tokenizer, count(*) AS docs, sum(n)::BIGINT AS tokens FROM counted GROUP BY 1, 2, 3
"""

_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
]
_MATCHES = "\nUNION ALL ".join(
    f"SELECT doc_id, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g"
    + (f", regexp_extract_all(t, '{p}', 2) AS v FROM d" if k == "assign" else ", m AS v FROM d")
    for i, (k, p) in enumerate(_KINDS)
)

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_MATCHES}),
each AS (SELECT doc_id, rank, kind, m, g, v, unnest(generate_series(1, len(m))) AS i FROM found WHERE len(m) > 0),
placed AS (
  SELECT doc_id, rank, kind, length(m[i]) AS size, length(v[i]) AS value,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM each
), kept AS (
  SELECT doc_id, kind, rank, start::BIGINT AS start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM placed
  WHERE CASE kind WHEN 'assign' THEN value >= 6 WHEN 'access' THEN size >= 20 WHEN 'hex' THEN size >= 24 ELSE true END
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY 1
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""

# crc32 by bytes: a table of 256 steps made from the polynomial, then a fold over the text.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
)"""


def _crc32(text: str) -> str:
    """Needs ``crc_table`` among the tables of its query."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""


def _leaf(n_chars: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
crcs AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS crc FROM documents, crc_table),
leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size
  FROM documents JOIN crcs USING (doc_id)
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, size FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM nodes WHERE size > 1 GROUP BY lang, level, pos // 2, size
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), tops AS (
  SELECT 0 AS level, pos, subroot AS h, size FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM tops WHERE size > 1 GROUP BY level, pos // 2, size
), steps AS (
  SELECT l.doc_id, n.level, n.size, (l.pos >> n.level) % 2 AS is_right, s.h
  FROM leaves l JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.pos = l.pos >> n.level AND n.size > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = n.level AND s.pos = xor(n.pos, 1)
  UNION ALL
  SELECT l.doc_id, 100 + n.level, n.size, (r.pos >> n.level) % 2, s.h
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN tops n ON n.pos = r.pos >> n.level AND n.size > 1
  LEFT JOIN tops s ON s.level = n.level AND s.pos = xor(n.pos, 1)
), ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM steps),
way AS (
  SELECT doc_id, shown AS h, 0 AS k FROM leaves
  UNION ALL
  SELECT w.doc_id, sha256(CASE WHEN o.h IS NULL THEN w.h WHEN o.is_right = 1 THEN o.h || w.h ELSE w.h || o.h END), o.k
  FROM way w JOIN ordered o ON o.doc_id = w.doc_id AND o.k = w.k + 1
), ends AS (SELECT doc_id, arg_max(h, k) AS folded FROM way GROUP BY 1),
proofs AS (SELECT doc_id, string_agg(h, '' ORDER BY level) AS p FROM steps WHERE h IS NOT NULL GROUP BY 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE size = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256,
  folded AS folded_root, folded = (SELECT h FROM tops WHERE size = 1) AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
  ) WHERE length(run) >= 5 GROUP BY 1, 2
), hashed AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM runs, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), cut AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.a || c.b
), best AS (
  SELECT p.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS form, max(o.n) AS form_n
  FROM pairs p JOIN words o ON o.word = p.other GROUP BY 1
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS root, 0 AS k FROM words
  UNION ALL SELECT w.word, f.form, k + 1 FROM way w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, k) AS root FROM way GROUP BY 1) USING (word)
"""

ORACLE_SQL = {
    "op1_mix_sources": OP1, "op2_url_filter": OP2, "op4_minhash_near_dedup": OP4, "op7_token_counts": OP7,
    "op8_line_dedup": OP8, "op9_secret_scan": OP9, "op12_spelling_variants": OP12,
    "op13_merkle_manifest": OP13,
}
