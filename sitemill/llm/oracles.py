"""SQL of the queries that SQL can express."""

from sitemill.llm import secrets
from sitemill.llm.queries import MIX_REST, MIX_SEED, MIX_WEIGHTS, NEAR_PERCENT, PHRASE_COVER, PHRASE_LEAST, PHRASE_TOP, PHRASE_WORDS, SHARD_BYTES, TRIE_FAMILY, TRIE_HEADS

ORACLES = {}


def trie_crc_table() -> list[int]:
    """The steps of CRC-32 for each value of a byte."""
    table = list(range(256))
    for _ in range(8):
        table = [(v >> 1) ^ (0xEDB88320 if v & 1 else 0) for v in table]
    return table


ORACLES["op2_sharding"] = f"""
WITH keyed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
         lpad(to_base(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, 2), 60, '0') AS bits
  FROM documents),
prefixed AS (SELECT *, d AS depth, substr(bits, 1, d::INT) AS shard FROM keyed, range(0, 61) r(d)),
sums AS (SELECT shard, depth, sum(bytes) AS shard_bytes, count(*) AS shard_docs FROM prefixed GROUP BY ALL),
first AS (
  SELECT doc_id, min(p.depth) AS depth FROM prefixed p JOIN sums s USING (shard, depth)
  WHERE s.shard_bytes <= {SHARD_BYTES} OR s.shard_docs = 1 OR p.depth = 60 GROUP BY doc_id)
SELECT p.doc_id, p.bytes::BIGINT AS bytes, p.shard, p.depth::INT AS depth, s.shard_bytes::BIGINT AS shard_bytes, s.shard_docs
FROM prefixed p JOIN first f ON p.doc_id = f.doc_id AND p.depth = f.depth JOIN sums s ON p.shard = s.shard AND p.depth = s.depth
"""

ORACLES["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_named = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in MIX_WEIGHTS.items())
_whole = sum(MIX_WEIGHTS.values()) + MIX_REST

ORACLES["op10_mixing"] = f"""
WITH n AS (SELECT source, count(*) AS n, CASE source {_named} END AS share FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS aim, coalesce(sum(n) FILTER (share IS NULL), 1)::DOUBLE AS others FROM n),
r AS (
  SELECT source, CASE WHEN share IS NOT NULL THEN aim * share / {_whole!r} / n ELSE aim * {MIX_REST!r} / {_whole!r} / others END AS rate FROM n, t),
c AS (
  SELECT source, rate, pieces, sum(exp(k * ln(rate / pieces) - rate / pieces - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT *, greatest(1, ceil(rate / 32.0))::INT AS pieces FROM r) q, range(0, 151) x(k)),
u AS (
  SELECT d.doc_id, d.source, ('0x' || substr(md5('draw{MIX_SEED}:' || piece || ':' || d.doc_id), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM documents d JOIN (SELECT DISTINCT source, pieces FROM c) p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.pieces + 1)) x(piece)),
k AS (SELECT doc_id, any_value(rate) AS rate, count(*) FILTER (c <= u) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY doc_id)
SELECT d.*, copy::INT AS copy, rate, ('0x' || substr(md5('order{MIX_SEED}:' || copy || ':' || d.doc_id), 1, 15))::BIGINT AS shuffle_key
FROM documents d JOIN k USING (doc_id), unnest(range(1, copies + 1)) y(copy)
"""

ORACLES["op4_near_dedup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(2, len(ws) - 3))) x(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {NEAR_PERCENT} * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id
"""


def _spans(name: str, pattern: str, where: str = "true") -> str:
    """Matches of a pattern with their places: lengths of what lies between them, and their own, summed up."""
    quoted = pattern.replace("'", "''").replace('\\"', '"')
    return f"""
{name} AS (
  SELECT doc_id, list_sum(g[1:i]) + coalesce(list_sum(s[1:i - 1]), 0) AS a, m[i] AS value, v[i] AS word FROM (
    SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {2 if name == "assign" else 0}) AS v,
           list_transform(regexp_extract_all(t, '{quoted}'), lambda x: length(x)) AS s, list_transform(string_split_regex(t, '{quoted}'), lambda x: length(x)) AS g
    FROM d WHERE regexp_matches(t, '{quoted}')) q, unnest(range(1, len(m) + 1)) x(i)
  WHERE {where})"""


def _fitting(value: str, encodings: list) -> str:
    whens = (f"WHEN regexp_matches({value}, '{p}') " + " ".join(f"AND regexp_matches({value}, '{x}')" for x in parts) + f" THEN {i}" for i, (_, p, parts, _) in enumerate(encodings))
    return f"CASE {' '.join(whens)} END"


def _parts(i: int, pattern: str) -> str:
    """The runs of one alphabet inside the runs that are cut, with their places in the text."""
    return f"""
parts{i} AS (
  SELECT doc_id, a + list_sum(g[1:i]) + coalesce(list_sum(s[1:i - 1]), 0) AS a, m[i] AS value FROM (
    SELECT doc_id, a, regexp_extract_all(value, '{pattern}') AS m, list_transform(regexp_extract_all(value, '{pattern}'), lambda x: length(x)) AS s,
           list_transform(string_split_regex(value, '{pattern}'), lambda x: length(x)) AS g
    FROM candidate WHERE {_mixed} AND regexp_matches(value, '{pattern}')) q, unnest(range(1, len(m) + 1)) x(i))"""


_mixed = f"(regexp_matches(value, '[+/_-]') AND ({_fitting('value', secrets.ENCODINGS)} IS NULL OR regexp_matches(value, '{secrets.WORDY}')))"
_code = f"coalesce({_fitting('value', secrets.ENCODINGS)}, {_fitting("rtrim(value, '=')", secrets.EVERY)})"
_letters = "CASE code " + " ".join(f"WHEN {i} THEN '{e[3]}'" for i, e in enumerate(secrets.EVERY)) + " END"
_long = " + ".join(f"(n >= {x})::INT" for x in secrets.LENGTHS[1:])


def _tail(z: str) -> str:
    return f"1 / (1 + exp(least(600.0::DOUBLE, 1.5976::DOUBLE * ({z}) + 0.070566::DOUBLE * ({z}) * ({z}) * ({z}))))"


def _two(z: str) -> str:
    return f"ln(greatest(1e-12, least(1.0::DOUBLE, 2 * ({_tail(z)}))))"


ORACLES["op9_secrets"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assign", secrets.ASSIGN, f"length(v[i]) >= {secrets.ASSIGN_LEAST}")},
{_spans("access", secrets.ACCESS)},
{_spans("hex", secrets.HEX)},
{_spans("candidate", secrets.CANDIDATE)},
base AS (
  SELECT doc_id, a, 0 AS k, a + length(value) AS b FROM assign UNION ALL SELECT doc_id, a, 1, a + length(value) FROM access
  UNION ALL SELECT doc_id, a, 2, a + length(value) FROM hex),
{",".join(_parts(i, p) for i, p in enumerate(secrets.PARTS))},
units AS (
  SELECT doc_id, a, value FROM candidate WHERE NOT {_mixed}
  UNION {" UNION ".join(f"SELECT * FROM parts{i}" for i in range(len(secrets.PARTS)))}),
coded AS (SELECT *, {_code} AS code FROM units),
ranked AS (
  SELECT doc_id, a, a + length(value) AS b, value, code, length({_letters})::DOUBLE AS size, string_split(rtrim(value, '='), '') AS cs, {_letters} AS letters
  FROM coded WHERE code IS NOT NULL),
numbers AS (
  SELECT *, len(cs)::DOUBLE AS n, list_transform(cs, lambda c: strpos(letters, c)::DOUBLE) AS r,
         list_transform(list_distinct(cs), lambda c: len(list_filter(cs, lambda o: o = c))::DOUBLE) AS counts FROM ranked),
sums AS (
  SELECT *, list_sum(list_transform(counts, lambda c: c * c)) AS squares, list_sum(list_transform(r, lambda x: (x > size / 2)::INT::DOUBLE)) AS high,
         list_sum(list_transform(range(1, len(r)), lambda i: ((r[i] > size / 2) <> (r[i + 1] > size / 2))::INT::DOUBLE)) AS turns,
         list_sum(list_transform(range(1, len(r)), lambda i: (r[i] - (size + 1) / 2) * (r[i + 1] - (size + 1) / 2))) AS products
  FROM numbers),
z AS (
  SELECT *, (size / n * squares - n - (size - 1)) / sqrt(2 * (size - 1) * (n - 1) / n) AS z1,
         abs(turns + 1 - (2 * high * (n - high) / n + 1)) / sqrt(greatest(1e-9, (2 * high * (n - high) / n) * (2 * high * (n - high) / n - 1) / (n - 1))) AS z2,
         abs(products) / ((size * size - 1) / 12 * sqrt(n - 1)) AS z3 FROM sums),
logs AS (SELECT *, ln(greatest(1e-12, {_tail("z1")})) + {_two("z2")} + {_two("z3")} AS l FROM z),
p AS (SELECT doc_id, a, b, rtrim(value, '=') AS token, code * {len(secrets.LENGTHS)} + {_long} AS stratum, exp(l) * (1 - l + l * l / 2) AS p FROM logs),
counts AS (SELECT stratum, least({secrets.STEPS - 1}, floor(p * {secrets.STEPS}))::INT AS step, count(DISTINCT token) AS n FROM p GROUP BY ALL),
rated AS (
  SELECT stratum, step, 2 * coalesce(sum(n) FILTER (step >= {secrets.STEPS // 2}) OVER (PARTITION BY stratum), 0) AS random,
         sum(n) OVER (PARTITION BY stratum ORDER BY step DESC) AS taken FROM counts),
least_p AS (
  SELECT stratum, min(step / {secrets.STEPS}.0) AS least_p FROM rated
  WHERE 1 - (1 - step / {secrets.STEPS}.0) * random / taken <= {secrets.FALSE_SHARE} AND random > 0 GROUP BY stratum),
free AS MATERIALIZED (
  SELECT p.doc_id, p.a, p.b, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.a, p.b) AS i FROM p JOIN least_p USING (stratum)
  WHERE p.p >= least_p AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = p.doc_id AND base.a < p.b AND p.a < base.b)),
held AS (  -- the span that is held after the i-th; a new one comes when it is apart or longer
  SELECT doc_id, i, a, b FROM free WHERE i = 1
  UNION ALL SELECT f.doc_id, f.i, if(h.b <= f.a OR h.b - h.a < f.b - f.a, f.a, h.a), if(h.b <= f.a OR h.b - h.a < f.b - f.a, f.b, h.b)
  FROM held h JOIN free f ON f.doc_id = h.doc_id AND f.i = h.i + 1),
added AS (
  SELECT h.doc_id, h.a, 3 AS k, h.b FROM held h LEFT JOIN free f ON f.doc_id = h.doc_id AND f.i = h.i + 1 WHERE f.i IS NULL OR h.b <= f.a),
every AS (SELECT *, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || a::BIGINT || ':' || b::BIGINT AS s FROM (FROM base UNION ALL FROM added)),
lists AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(s, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(s, ',' ORDER BY a, k) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN lists USING (doc_id)
"""

_grams = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS p, {k} AS k FROM w WHERE len(ws) >= {k}" for k in range(1, PHRASE_WORDS + 1))

ORACLES["op12_phrases"] = rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda s: s <> '') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM t)),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, p, k, count(*) AS f FROM ({_grams}) GROUP BY ALL HAVING count(*) >= {PHRASE_LEAST}),
c AS (
  SELECT f.lang, f.p, f.k, f.f, i, array_to_string(string_split(p, ' ')[1:i], ' ') AS a, array_to_string(string_split(p, ' ')[i + 1:], ' ') AS b
  FROM f, range(1, {PHRASE_WORDS}) x(i) WHERE i < f.k),
s AS (
  SELECT c.lang, c.p, c.k, c.f AS a, l.f AS l, r.f AS r, n, i, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.p = c.a JOIN f r ON r.lang = c.lang AND r.p = c.b JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, i) = 1),
inner_phrases AS (
  SELECT DISTINCT f.lang, array_to_string(string_split(p, ' ')[i:i + m - 1], ' ') AS p, f.f AS longer
  FROM f, range(1, {PHRASE_WORDS + 1}) x(i), range(2, {PHRASE_WORDS}) y(m) WHERE m < f.k AND i + m - 1 <= f.k),
o AS (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM inner_phrases h WHERE h.lang = b.lang AND h.p = b.p AND 100 * h.longer >= {PHRASE_COVER} * b.a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank FROM o)
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM q WHERE rank <= {PHRASE_TOP}
"""

_table = ",".join(str(v) for v in trie_crc_table())

ORACLES["op13_trie"] = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY i) AS xs FROM o GROUP BY conv_id),
crc AS (  -- CRC-32 of the decimal id, a byte a step
  SELECT conv_id, conv_id::VARCHAR AS s, 1 AS j, 4294967295::BIGINT AS v FROM own
  UNION ALL SELECT conv_id, s, j + 1, xor(v >> 8, [{_table}][(xor(v, ascii(substr(s, j, 1))) & 255) + 1]::BIGINT) FROM crc WHERE j <= length(s)),
h AS (SELECT conv_id, xor(v, 4294967295::BIGINT) % {TRIE_HEADS} AS h FROM crc WHERE j = length(s) + 1),
c AS MATERIALIZED (
  SELECT own.conv_id, list_concat(coalesce(d.xs[1:h], []), own.xs[h + 1:]) AS xs
  FROM own JOIN h USING (conv_id) LEFT JOIN own d ON d.conv_id = own.conv_id - own.conv_id % {TRIE_FAMILY}),
p AS MATERIALIZED (SELECT conv_id, d, xs[1:d] AS k, d = len(xs) AS whole FROM c, range(0, (SELECT max(len(xs)) + 1 FROM c)) r(d) WHERE d <= len(xs)),
n AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(k[d].t), 0) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256
  FROM p GROUP BY k, d),
u AS (SELECT a.k, count(*) AS n_children FROM n a JOIN n b ON b.d = a.d + 1 AND b.k[1:a.d] = a.k GROUP BY a.k),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN u USING (k)),
q AS (
  SELECT a.k, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves
  FROM m a JOIN (SELECT n_children, saved, k[1:r.d] AS k FROM m, range(0, (SELECT max(d) + 1 FROM m)) r(d) WHERE r.d <= m.d) b ON b.k = a.k GROUP BY a.k)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN q USING (k) LEFT JOIN m up ON up.d = m.d - 1 AND up.k = m.k[1:m.d - 1]
"""
