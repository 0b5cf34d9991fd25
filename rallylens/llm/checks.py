"""SQL that gives the same rows as the queries of this subpackage."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _count(column: str, piece: str) -> str:
    return f"(length({column}) - length(replace({column}, '{piece}', ''))) // {len(piece)}"


def _escaped_length(column: str) -> str:
    return f"length({column}) + " + " + ".join(_count(column, p) for p in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))


CHAT = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(22 + {_escaped_length('role')} + {_escaped_length('text')}) OVER w AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS said, least(len(w), 10) AS n
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS said
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins))
), hits AS (SELECT r, i, runs.n, item_id FROM runs JOIN wins ON runs.said = wins.said AND runs.n = wins.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE
    WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT WHEN {_DIGITS}[-i]::INT > 4 THEN {_DIGITS}[-i]::INT * 2 - 9 ELSE {_DIGITS}[-i]::INT * 2 END)) % 10 = 0"""
_PLAIN = "replace(v, ' ', '')"
_MOD97 = f"""list_reduce(list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[:4], ''),
    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1"""
_NEAR = "regexp_matches(lower(near), '(^|[^a-z])({})')"
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256))) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}", "true"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(v, '^(000|666|9)') AND " + _NEAR.format("ssn|social security")),
]
_ACCOUNT = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"

def _found(k: int, name: str, pattern: str, valid: str) -> str:
    return f"""SELECT r, {k} AS k, '{name}' AS kind, start, start + length(v) AS stop, t FROM (
  SELECT r, t, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start,
    right(left(t, start), 40) || ' ' || substr(t, start + length(v) + 1, 40) AS near
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')))
) WHERE {valid}"""


_HEADS = _found(4, *_KINDS[4])
_RUNS = f"""SELECT r, start, t, unnest(list_transform(range(1, len(ws) + 1), lambda n: array_to_string(ws[1:n], ' '))) AS v FROM (
  SELECT r, start, t, string_split(regexp_extract(substr(t, start + 1, 61), '^{_ACCOUNT}\\b'), ' ') AS ws FROM ({_HEADS}))"""
#: No letter or digit, of any script, on either side.
_ALONE = r"NOT regexp_matches(substr(t, start + length(v) + 1, 1), '[\p{L}\p{N}_]') AND (start = 0 OR NOT regexp_matches(substr(t, start, 1), '[\p{L}\p{N}_]'))"
_ACCOUNTS = f"SELECT r, 4 AS k, 'iban' AS kind, start, start + max(length(v)) AS stop FROM ({_RUNS}) WHERE regexp_matches(v, '^{_ACCOUNT}$') AND {_MOD97} AND {_ALONE} GROUP BY r, start"
_SPANS = " UNION ALL ".join(f"SELECT r, k, kind, start, stop FROM ({_found(k, *kind)})" for k, kind in enumerate(_KINDS) if k != 4)

PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({_ACCOUNTS}),
s AS ({_SPANS} UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.r = a.r AND b.start < a.start AND b.stop > a.start)),
n AS (SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (k < 4) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (r)
"""

TOPK = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i]))::BIGINT AS score, c.r
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, r))::INT AS rank FROM s) WHERE rank <= 5
"""

_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

TRIE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(said ORDER BY k) AS s, list(chars ORDER BY k) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id::VARCHAR")} % 6 AS h, s, n FROM own, (SELECT {_CRC_TABLE} AS tab)),
made AS (
  SELECT h.conv_id AS c, coalesce(b.s[1:h], []) || h.s[h + 1:] AS s, coalesce(b.n[1:h], []) || h.n[h + 1:] AS n FROM h LEFT JOIN own b ON b.conv_id = h.base
), paths AS (
  SELECT c, d, sha256(array_to_string(s[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(s[1:d - 1], ',')) END AS parent,
    CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars, d = len(s) AS ends
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM made)
), nodes AS (
  SELECT node, parent, d, chars, min(c) AS conv_id, count(*) AS n_convs, string_agg(c, ',' ORDER BY c) FILTER (ends) AS ids FROM paths GROUP BY node, parent, d, chars
), kids AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT top AS node, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved
  FROM below JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top
)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM nodes x JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON p.node = x.parent
"""

NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT vec_id AS anchor_id, label AS own, v AS q FROM e WHERE vec_id % 100 = 0)),
s AS (SELECT k, anchor_id, own, vec_id, label, r, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * q[i]))::BIGINT AS score FROM a, e),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id, r) AS n FROM s WHERE label = own AND vec_id <> anchor_id),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.k, p.n ORDER BY s.score DESC, s.vec_id, s.r))::INT AS rank
  FROM p JOIN s ON s.k = p.k AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.n <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
