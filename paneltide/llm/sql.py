"""DuckDB SQL for the corpus queries that SQL can express."""

from paneltide.llm.quality_rules import RULES, STOP_WORDS
from paneltide.llm.secret_scan import ASSIGN, ENDPOINT, WEAK_ID, WEAK_SECRET

ORACLE: dict[str, str] = {}

ORACLE["op4_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
),
h AS (
  SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key
),
m AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(h.n >= 3 AND k.doc_id <> h.top, false) AS gone
  FROM k LEFT JOIN h ON h.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_checks = " AND ".join(
    [f"coalesce({r.value.replace('/ n_words', '/ nullif(n_words, 0)')} >= {r.low}, false)" for r in RULES if r.low is not None]
    + [f"coalesce({r.value.replace('/ n_words', '/ nullif(n_words, 0)')} <= {r.high}, false)" for r in RULES if r.high is not None]
)
ORACLE["op10_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 6)
),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (
  SELECT doc_id, sum(least(5, nxt - i)) AS n
  FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 5) AS nxt FROM r) GROUP BY doc_id
),
s AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(repr(x) for x in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words,
    length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_capitals,
    len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id
),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_checks} AS kept, n_stop_words, n_capitals, n_lines
FROM f
"""


def _found(kind: int, pattern: str, keep: str = "true") -> str:
    """Spans of one pattern as rows (doc_id, s, k, e): lengths of what stands between matches add up to their places."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, e - length(m) AS s, {kind} AS k, e FROM (
    SELECT doc_id, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {2 if "token" in pattern else 0}) AS vs,
          string_split_regex(t, '{quoted}') AS gs FROM d)))
  WHERE {keep}"""


_near = lambda a, b: f"{b}.doc_id = {a}.doc_id AND {b}.s < {a}.e + 200 AND {a}.s < {b}.e + 200"
_text = lambda cond: f"coalesce(string_agg(name[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE {cond}), '')"
ORACLE["op6_credential_links"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_found(0, ASSIGN, "length(v) >= 12")} UNION ALL {_found(1, r"AKIA[A-Z0-9]{14,}")} UNION ALL {_found(2, r"[0-9a-f]{16,}")}),
weak AS (
  SELECT * FROM ({_found(3, WEAK_ID)} UNION ALL {_found(4, ASSIGN, "length(v) BETWEEN 6 AND 11")} UNION ALL {_found(4, WEAK_SECRET)} UNION ALL {_found(5, ENDPOINT)}) x
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)
),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
marked AS (
  SELECT x.*, EXISTS (SELECT 1 FROM parts y WHERE {_near("x", "y")} AND y.k IN (0, 2, 4)) AS near_secret,
    EXISTS (SELECT 1 FROM parts y WHERE {_near("x", "y")} AND y.k IN (1, 3)) AS near_id
  FROM weak x
),
allspans AS (
  SELECT doc_id, s, k, e FROM base
  UNION ALL SELECT doc_id, s, k, e FROM marked
  WHERE (k = 3 AND near_secret) OR (k = 4 AND near_id) OR (k = 5 AND near_secret AND near_id)
)
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256({_text("k <= 2")}) AS base_sha256, {_text("k IS NOT NULL")} AS spans
FROM (SELECT doc_id, ['assign', 'access', 'hex', 'id', 'secret', 'endpoint'] AS name FROM d) d LEFT JOIN allspans a ON a.doc_id = d.doc_id
GROUP BY d.doc_id
"""

#: CRC-32 of what a list of bytes holds, bit by bit.
_crc = lambda values: f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"

ORACLE["op13_dominance_tiles"] = f"""
WITH a AS (
  SELECT sale_id, CAST(floor(epoch(CAST(sold_at AS TIMESTAMP)) / 3600) AS BIGINT) AS slot,
    CASE WHEN isfinite(total) AND abs(total) < 1e15 THEN CAST(floor(floor(100 * total + 0.5) / 100) AS BIGINT) END AS level,
    1 + {_crc("list_transform(string_split(coalesce(sale_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)")} % 2 AS stands
  FROM sales
),
c AS (SELECT slot, level, count(*) AS n, sum(stands) AS w FROM a WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
u AS (
  SELECT x.slot, x.level, sum(y.n) AS n_sales, sum(y.w) AS n_rows
  FROM c x LEFT JOIN c y ON y.slot <= x.slot AND y.level > x.level GROUP BY ALL
)
SELECT sale_id, a.slot, a.level, CASE WHEN a.slot IS NOT NULL AND a.level IS NOT NULL THEN CAST(coalesce(n_sales, 0) AS BIGINT) END AS n_sales,
  CASE WHEN a.slot IS NOT NULL AND a.level IS NOT NULL THEN CAST(coalesce(n_rows, 0) AS BIGINT) END AS n_rows
FROM a LEFT JOIN u ON u.slot = a.slot AND u.level = a.level
"""

_digits = "0123456789ABCDEF"
_bytes = f"list_transform(range(1, length(hx), 2), lambda p: ((instr('{_digits}', substr(hx, p, 1)) - 1) * 16 + instr('{_digits}', substr(hx, p + 1, 1)) - 1)::BIGINT)"
ORACLE["op12_crc_ring_resampling"] = f"""
WITH tx AS (
  SELECT 0 AS src, row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, coalesce(text, '') FROM benchmark
),
w AS (
  SELECT src, rid, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM tx
),
f AS (
  SELECT src, rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM w
),
h AS (SELECT feature, hex(encode(feature)) AS hx FROM (SELECT DISTINCT feature FROM f)),
b AS (SELECT feature, {_crc(_bytes)} % 10000 AS bucket FROM h),
fb AS (SELECT src, rid, bucket FROM f JOIN b USING (feature)),
k AS (SELECT bucket, count(*) FILTER (WHERE src = 0) AS s, count(*) FILTER (WHERE src = 1) AS t FROM fb GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM k)::BIGINT + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM k)::BIGINT + 10000)))) AS gain FROM k
),
m AS (SELECT rid, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM fb JOIN g USING (bucket) WHERE src = 0 GROUP BY rid),
n AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(ws)::BIGINT AS n_words,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN m USING (rid) WHERE src = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS fit FROM n)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank, n_words FROM r
"""
