"""DuckDB SQL of the queries that SQL can express."""

_SPACE = r"\x20\x09-\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ["password", "passwd", "secret", "token", "api_?key"])
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(pattern: str) -> str:
    """SQL list of (start, value) of the matches of ``pattern`` in t."""
    found, gaps = f"regexp_extract_all(t, '{pattern}')", f"regexp_split_to_array(t, '{pattern}')"
    return f"(SELECT list({{'s': CAST(list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS BIGINT), 'v': m[i]}} ORDER BY i) FROM (SELECT m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {found} AS m, {gaps} AS g)))"


OP1 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS t FROM documents),
raw AS (
  SELECT row_id, 'assign' AS kind, 0 AS o, unnest({_spans(_ASSIGN)}) AS x FROM d
  UNION ALL SELECT row_id, 'access', 1, unnest({_spans('AKIA[A-Z0-9]+')}) FROM d
  UNION ALL SELECT row_id, 'hex', 2, unnest({_spans('[0-9a-f]+')}) FROM d WHERE regexp_matches(t, '[0-9a-f]{{32}}')
  UNION ALL SELECT row_id, 'owned', 3, unnest({_spans('[A-Za-z0-9_-]+')}) FROM d WHERE regexp_matches(t, '[A-Za-z0-9_-]{{20}}')),
s AS (
  SELECT row_id, kind, o, x.s AS a, x.s + length(x.v) AS e, CASE WHEN kind = 'assign' THEN regexp_extract(x.v, '{_ASSIGN}', 2) ELSE x.v END AS v FROM raw),
base AS (SELECT * FROM s WHERE kind = 'assign' AND length(v) >= 8 OR kind = 'access' AND length(v) >= 16 OR kind = 'hex' AND length(v) >= 32),
more AS (
  SELECT * FROM s WHERE kind = 'owned' AND length(v) >= 20 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
    AND len(list_distinct(string_split(v, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_id = s.row_id AND b.a < s.e AND s.a < b.e)),
spread AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, coalesce(CAST(doc_id AS VARCHAR), chr(0)))) AS repos FROM (SELECT * FROM base UNION ALL SELECT * FROM more) JOIN d USING (row_id) GROUP BY v),
kept AS (SELECT * FROM base JOIN spread USING (v) UNION ALL SELECT * FROM more JOIN spread USING (v) WHERE owners = 1 AND repos < 10),
k AS (
  SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS spans,
    count(*) FILTER (owners = 1 AND repos < 10) AS one, count(*) FILTER (owners >= 3 OR repos >= 10) AS wide, string_agg(repos, ',' ORDER BY a, o) AS repos FROM kept GROUP BY row_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(one, 0) AS BIGINT) AS n_owner_specific, CAST(coalesce(wide, 0) AS BIGINT) AS n_widely_copied, coalesce(repos, '') AS repos
FROM d LEFT JOIN k USING (row_id)
"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT row_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT row_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hits AS (SELECT row_id, k, p, g FROM dw SEMI JOIN iw USING (k, g)),
words AS (SELECT row_id, count(*) AS n_hit FROM (SELECT DISTINCT row_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY row_id),
items AS (
  SELECT row_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN iw USING (k, g) WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)
"""

OP7 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
lines AS (
  SELECT row_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^{_SPACE}]')] AS l FROM d),
grams AS (
  SELECT row_id, p, w[p:p + 2] AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
twice AS (SELECT row_id, p FROM (SELECT row_id, p, count(*) OVER (PARTITION BY row_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT row_id, count(*) AS n FROM (SELECT DISTINCT row_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY row_id),
f AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[{_SPACE}]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low,
         len([x for x in w if regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')]) AS letter_words
  FROM d JOIN lines USING (row_id) LEFT JOIN rep USING (row_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * up > 60 * (up + low) OR 100 * letter_words < 70 * n_words) AS kept
FROM b
"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
g AS (
  SELECT row_id, doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT row_id, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
hits AS (SELECT row_id, p FROM (SELECT row_id, p, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id OR least IS NOT NULL AND doc_id IS NULL),
gone AS (SELECT row_id, list(q) AS qs FROM (SELECT DISTINCT row_id, unnest(range(p, p + 13)) AS q FROM hits) GROUP BY row_id),
k AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(qs), 0) AS n_removed,
         CASE WHEN qs IS NULL THEN w ELSE [w[i] for i in range(1, len(w) + 1) if NOT list_contains(qs, i)] END AS kept
  FROM d LEFT JOIN gone USING (row_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""



def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII string, a bit at a time."""
    byte = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b))"
    return f"xor(4294967295, list_reduce([CAST(ascii(x) AS BIGINT) for x in string_split({text}, '')], lambda a, b: {byte}, CAST(4294967295 AS BIGINT)))"


OP12 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w,
         coalesce({_crc32("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents),
s AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h % 10 = 0 AND len(w) > 0 AS again FROM d),
t AS (
  SELECT doc_id, row_id, n, CASE WHEN again THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END] for i in range(n)] ELSE w END AS w FROM s),
p AS (SELECT row_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM t),
e AS (SELECT l.row_id, l.i, r.i - l.i AS q FROM p l JOIN p r ON l.row_id = r.row_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
g AS (SELECT row_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row_id, q ORDER BY i) AS k FROM e) GROUP BY row_id, q, k),
r AS (SELECT row_id, start, length, min(q) AS q FROM g WHERE length >= greatest(6, 4 * q) GROUP BY row_id, start, length),
gone AS (SELECT row_id, list(DISTINCT i) AS gone FROM (SELECT row_id, unnest(range(start + q, start + length)) AS i FROM r) GROUP BY row_id),
f AS (
  SELECT row_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed,
         min_by({{'s': start, 'n': length, 'q': q}}, (-length, start, q)) AS best FROM r GROUP BY row_id),
c AS (SELECT row_id, string_agg(x, ' ' ORDER BY i) AS kept FROM p LEFT JOIN gone USING (row_id) WHERE gone IS NULL OR NOT list_contains(gone, i) GROUP BY row_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.n AS BIGINT) AS length,
       CAST(best.q AS BIGINT) AS period, CAST(1000 * best.n // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN f USING (row_id) LEFT JOIN c USING (row_id)
"""



def _paid(x: str, cost: str, letters: str) -> str:
    """A (cost, audit) text, cost first in nine digits, with more cost and letters."""
    return f"lpad(CAST(CAST({x}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {x}[10:] || '{letters}'"


def _kept(x: str, initial: str) -> str:
    """The row kept or reroled after ``x`` as that role."""
    return f"CASE WHEN bad THEN NULL WHEN ini = '{initial}' THEN {_paid(x, 'cut', 'K')} ELSE {_paid(x, '2 + cut', 'R')} END"


#: The parser's states in a recursion over rows: z nothing yet, s after a system turn, u after a user's, a after an assistant's.
OP13 = rf"""
WITH RECURSIVE k AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
m AS (SELECT *, {_crc32("key")} % 20 AS kind FROM k),
r AS (
  SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) FROM m)),
n AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^{_SPACE}])[{_SPACE}]*$', 1) AS final FROM r),
f AS (SELECT *, role[1:1] AS ini, final = '' AS blank, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS again, final NOT IN ('.', '!', '?') AS open FROM n),
g AS (SELECT *, blank OR again AS bad, CASE WHEN open THEN 1 ELSE 0 END AS cut, lag(ini) OVER (PARTITION BY cid ORDER BY i) || ini AS pair FROM f),
c AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (open AND NOT bad) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY cid),
p AS (
  SELECT cid, 0 AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, '000000002I' AS u, '000000004II' AS a FROM (SELECT DISTINCT cid FROM k)
  UNION ALL
  SELECT cid, i, z, s, u, least(a, {_paid("u", "2", "I")}) FROM (
    SELECT cid, i, z, s, least(u, {_paid("z", "2", "I")}, {_paid("s", "2", "I")}, {_paid("a", "2", "I")}) AS u, a FROM (
      SELECT p.cid, g.i, {_paid("z", "3", "D")} AS z,
             least({_paid("s", "3", "D")}, CASE WHEN ini = 's' AND NOT bad THEN {_paid("z", "cut", "K")} END) AS s,
             least({_paid("u", "3", "D")}, {_kept("z", "u")}, {_kept("s", "u")}, {_kept("a", "u")}) AS u,
             least({_paid("a", "3", "D")}, {_kept("u", "a")}) AS a
      FROM p JOIN g ON g.cid = p.cid AND g.i = p.i + 1))),
e AS (SELECT cid, least(z, a) AS e FROM p WHERE i = coalesce((SELECT n FROM c WHERE c.cid = p.cid), 0)),
l AS (SELECT cid, unnest(string_split(e[10:], '')) AS x, unnest(range(1, len(e) - 8)) AS k FROM e WHERE len(e) > 9),
w AS (SELECT *, sum(CASE WHEN x = 'I' THEN 0 ELSE 1 END) OVER o AS i, sum(CASE WHEN x = 'D' THEN 0 ELSE 1 END) OVER o AS j FROM l WINDOW o AS (PARTITION BY cid ORDER BY k)),
y AS (SELECT w.*, g.role, CASE WHEN x = 'I' THEN '' ELSE g.text END AS text, max(CASE WHEN j = 1 AND x = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.cid) AS sys FROM w LEFT JOIN g USING (cid, i) WHERE x <> 'D'),
t AS (SELECT cid, string_agg(CASE WHEN x = 'K' THEN role WHEN (j - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS repaired FROM y GROUP BY cid)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(e[1:9] AS BIGINT) AS cost, e[10:] AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM k) JOIN e USING (cid) LEFT JOIN c USING (cid) LEFT JOIN t USING (cid)
"""

ORACLES: dict[str, str] = {
    "op1_secret_ownership": OP1,
    "op4_winnowed_decontamination": OP4,
    "op10_substring_recompression": OP10,
    "op7_quality_cascade": OP7,
    "op12_periodic_runs": OP12,
    "op13_conversation_repair": OP13,
}
