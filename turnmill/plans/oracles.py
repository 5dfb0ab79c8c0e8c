"""DuckDB SQL of the registered transcript queries."""

from __future__ import annotations

_KIND = "CASE role WHEN 'user' THEN 'human' WHEN 'system' THEN 'boundary' ELSE CASE length(text) % 5 WHEN 0 THEN 'plan' WHEN 1 THEN 'question' ELSE 'assistant' END END"
_STAMP = "lpad(CAST({} AS VARCHAR), 12, '0')"

#: Events of conversations and forks, then the human messages that their first owner keeps.
_EVENTS = f"""
own AS (SELECT conv_id, conv_id AS session, turn AS pos, {_KIND} AS kind, {_STAMP.format('conv_id * 1000 + turn')} AS ts, text FROM conversations),
ev AS (
  SELECT CAST(session AS VARCHAR) AS sid, 'p' || (conv_id % 7) AS project, pos, kind, ts, text FROM (
    SELECT * FROM own
    UNION ALL SELECT conv_id, conv_id + 1000000, pos, kind, ts, text FROM own WHERE conv_id % 5 = 0
    UNION ALL SELECT conv_id, conv_id + 1000000, max(pos) + 1, 'human', {_STAMP.format('conv_id * 1000 + 999')}, 'one more thing ' || conv_id FROM own WHERE conv_id % 5 = 0 GROUP BY conv_id)),
said AS (SELECT sid, project, pos, ts, text FROM ev WHERE kind = 'human' AND true),
early AS (SELECT sid, min(ts) AS earliest FROM said GROUP BY sid),
kept AS (
  SELECT sid, project, pos, ts, text, row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS idx FROM (
    SELECT *, row_number() OVER (PARTITION BY ts, text ORDER BY earliest, sid, pos) AS rn FROM said JOIN early USING (sid)) WHERE rn = 1)"""

#: Sessions of the run that ``export_statistics`` counts, with the first reason that leaves one out.
_STATUS = """st AS (
  SELECT sid, origin, CASE WHEN project = 'p6' THEN 'filtered' WHEN origin = 'k2' AND n % 3 <> 0 AND (n % 4 = 1 OR n % 10 = 2) THEN 'automation' WHEN n % 11 = 5 THEN 'unreadable' ELSE 'read' END AS status
  FROM (SELECT DISTINCT sid, project, CASE WHEN project < 'p3' THEN 'a' ELSE 'k2' END AS origin, CAST(sid AS BIGINT) AS n FROM ev)),
"""

_CONTEXT = _EVENTS + """,
looked AS (
  SELECT *, last_value(CASE WHEN kind = 'assistant' THEN pos END IGNORE NULLS) OVER w AS said_at, last_value(CASE WHEN kind IN ('plan', 'question') THEN pos END IGNORE NULLS) OVER w AS asked_at,
    last_value(CASE WHEN kind = 'assistant' THEN right(text, 1600) END IGNORE NULLS) OVER w AS said, last_value(CASE WHEN kind IN ('plan', 'question') THEN text END IGNORE NULLS) OVER w AS asked,
    last_value(CASE WHEN kind IN ('plan', 'question') THEN kind END IGNORE NULLS) OVER w AS asked_kind,
    coalesce(max(CASE WHEN kind = 'boundary' THEN pos END) OVER w, -1) AS wall, coalesce(max(CASE WHEN kind = 'human' THEN pos END) OVER w, -1) AS turn
  FROM ev WINDOW w AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ctx AS (
  SELECT l.sid AS session_id, CAST(k.idx AS BIGINT) AS index, l.ts AS timestamp, l.text AS human_text, CASE WHEN said_at > wall THEN said END AS antecedent,
    CASE WHEN asked_at > wall AND asked_at > turn THEN asked_kind END AS decision_kind, CASE WHEN asked_at > wall AND asked_at > turn THEN asked END AS decision_text
  FROM looked l JOIN kept k ON k.sid = l.sid AND k.pos = l.pos
  WHERE l.kind = 'human' AND len(string_split_regex(trim(l.text), '\\s+')) <= 15)"""


def _note_length(value: str) -> str:
    return f"(length('\n\n[... cut ') + length(' characters here ...]\n\n') + length(CAST({value} AS VARCHAR)))"


def _cut(table: str, key: str, column: str, budget: int) -> str:
    """SELECT of key, cut, dropped: the middle cut of a column, its note's length settled by substitution."""
    steps = f"k0 AS (SELECT {key}, {column} AS t, length({column}) AS n, {budget} - {_note_length(f'length({column}) - {budget}')} AS keep FROM {table})"
    for i in range(5):
        steps += f", k{i + 1} AS (SELECT {key}, t, n, {budget} - {_note_length('n - keep')} AS keep FROM k{i})"
    note = "'\n\n[... cut ' || {} || ' characters here ...]\n\n'"
    text = f"CASE WHEN n <= {budget} THEN t WHEN keep <= 0 THEN left({note.format('n')}, {budget}) ELSE left(t, CAST(ceil(keep / 2) AS BIGINT)) || {note.format('(n - keep)')} || right(t, keep - CAST(ceil(keep / 2) AS BIGINT)) END"
    return f"{steps}, cut AS (SELECT {key}, {text} AS cut, CAST(CASE WHEN n <= {budget} THEN 0 WHEN keep <= 0 THEN n ELSE n - keep END AS BIGINT) AS dropped FROM k5)"


_EXPORT = "'doc-' || doc_id || '.md'"
_MEMBERS = f"m AS (SELECT source AS slug, {_EXPORT} AS export, doc_id AS pos, text FROM documents)"
_DIGESTS = f"""g AS (
  SELECT {_EXPORT} AS export, doc_id, 'goal ' || (doc_id % 10) AS goal, 'area' || (doc_id % 3) AS domain,
    CASE WHEN toxic = 1 THEN 'abandoned' WHEN quality = 1 THEN 'completed' WHEN doc_id % 2 = 0 THEN 'partial' ELSE 'unclear' END AS outcome FROM labels)"""
_NUMBER = "CAST(regexp_replace(slug, '[^0-9]', '', 'g') AS INTEGER)"
_LIBRARY = f"""lib AS (
  SELECT slug, CASE WHEN {_NUMBER} % 3 = 0 THEN 'g0' ELSE 'g1' END AS generation, {_NUMBER} % 4 = 0 AS short, {_NUMBER} % 2 = 0 AS is_edited, count(*) AS size FROM m GROUP BY slug)"""
_SUMMARY = """summary AS (
  SELECT slug, concat_ws(', ', CASE WHEN c > 0 THEN c || ' completed' END, CASE WHEN p > 0 THEN p || ' partial' END, CASE WHEN a > 0 THEN a || ' abandoned' END, CASE WHEN u > 0 THEN u || ' unclear' END) AS outcome_summary
  FROM (SELECT slug, count(*) FILTER (outcome = 'completed') AS c, count(*) FILTER (outcome = 'partial') AS p, count(*) FILTER (outcome = 'abandoned') AS a, count(*) FILTER (coalesce(outcome, 'unclear') = 'unclear') AS u
        FROM m LEFT JOIN g USING (export) GROUP BY slug))"""
_DOMAINS = "dom AS (SELECT slug, string_agg(domain, ',' ORDER BY f) AS domains FROM (SELECT slug, domain, min(pos) AS f FROM m JOIN g USING (export) GROUP BY slug, domain) GROUP BY slug)"


def _allocate(table: str, slug: str, used: str) -> str:
    """CTE named (rn, made): in the order of rn, a slug that is used is numbered from 2 until it is free; at five words the last one gives way."""
    stem = f"CASE WHEN len(string_split({slug}, '-')) < 5 THEN {slug} ELSE array_to_string(string_split({slug}, '-')[1:4], '-') END"
    tries = f"[{slug}] || list_transform(range(2, 500), lambda n: {stem} || '-' || n)"
    return f"""walk AS (
          SELECT 0::BIGINT AS rn, {used} AS used, CAST(NULL AS VARCHAR) AS made
          UNION ALL SELECT rn, used || [made], made FROM (SELECT r.rn, walk.used, list_filter({tries}, lambda x: NOT list_contains(walk.used, x))[1] AS made FROM walk JOIN {table} r ON r.rn = walk.rn + 1)),
        named AS (SELECT rn, made FROM walk WHERE rn > 0)"""


_SLUG_OK = "regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+){1,4}$')"
_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"

_PREFERENCES = f"""
p AS (SELECT source AS slug, CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) AS n, doc_id, split_part(text, chr(10), 1) AS t FROM documents),
k AS (SELECT *, {_KEY.format('t')} AS key, {_STAMP.format('n')} AS authored FROM p),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug, key ORDER BY doc_id) AS rn FROM k WHERE key <> '') WHERE rn = 1),
r AS (
  SELECT key, count(*) AS count, max(authored) AS last_authored_at, string_agg(slug || '=' || doc_id, ',' ORDER BY n) AS occurrences, arg_max(trim(t), authored) AS text FROM f GROUP BY key)"""

_LINES_A = f"""
l AS (
  SELECT CAST(conv_id AS VARCHAR) AS sid, turn AS pos, {_STAMP.format('conv_id * 1000 + turn')} AS ts, text, role,
    length(text) % 13 = 0 AS bad, length(text) % 3 <> 0 AND length(text) % 11 = 0 AS side, length(text) % 3 = 0 AS blocks FROM conversations)"""
_BLANK = r"regexp_replace(text, '\s+', ' ', 'g')"

ORACLES: dict[str, str] = {
    "short_turn_context": f"WITH {_CONTEXT} SELECT * FROM ctx",
    "context_lines": f"""WITH {_CONTEXT}, {_cut('(SELECT * FROM ctx WHERE decision_text IS NOT NULL)', 'session_id, index', 'decision_text', 1600)}
        SELECT session_id, index, concat_ws(chr(10), '> ' || human_text, 'answering: ' || antecedent, decision_kind || ': ' || cut) AS line
        FROM ctx LEFT JOIN cut USING (session_id, index) WHERE antecedent IS NOT NULL OR decision_kind IS NOT NULL""",
    "outcome_evidence": f"""WITH {_EVENTS},
        t AS (SELECT sid, string_agg(text, '|' ORDER BY idx) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY idx DESC) AS rn FROM kept) WHERE rn <= 3 GROUP BY sid)
        SELECT sid AS session_id, turns, coalesce((SELECT arg_max(right(text, 1600), pos) FROM ev WHERE ev.sid = t.sid AND kind = 'assistant'), '') AS final_assistant_tail FROM t""",
    "fork_dedupe": f"WITH {_EVENTS} SELECT sid AS session_id, CAST(idx AS BIGINT) AS index, ts AS timestamp, text FROM kept",
    "corpus_sessions": f"""WITH {_EVENTS},
        a AS (SELECT sid, count(*) AS n FROM said GROUP BY sid), b AS (SELECT sid, count(*) AS n, arg_min(ts, idx) AS f, arg_max(ts, idx) AS l FROM kept GROUP BY sid)
        SELECT a.sid AS session_id, CAST(coalesce(b.n, 0) AS BIGINT) AS messages, coalesce(f, '') AS first_ts, coalesce(l, '') AS last_ts, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS bad_lines,
               CASE WHEN coalesce(b.n, 0) = 0 THEN 'zero' WHEN b.n < 2 THEN 'below' ELSE 'eligible' END AS bucket FROM a LEFT JOIN b ON a.sid = b.sid""",
    "export_documents": f"""WITH {_EVENTS}
        SELECT sid AS session_id, count(*) AS messages, '<!-- source: log/' || sid || chr(10) || '     messages: ' || count(*) || ' -->' || chr(10) || string_agg(chr(10) || '### ' || ts || chr(10) || chr(10) || text || chr(10), '' ORDER BY idx) AS content
        FROM kept GROUP BY sid""",
    "project_inventory": f"WITH {_EVENTS} SELECT project, count(DISTINCT sid) AS sessions, count(*) FILTER (trim(text) <> '') AS entries, max(ts) AS latest FROM ev GROUP BY project",
    "origin_rollup": f"""WITH {_EVENTS}, s AS (SELECT DISTINCT sid, CASE WHEN project < 'p3' THEN 'a' ELSE 'k2' END AS origin FROM ev)
        SELECT coalesce(origin, 'total') AS origin, count(*) AS sessions FROM s GROUP BY ROLLUP (origin)""",
    "law_check": "SELECT CAST(NULL AS VARCHAR) AS side, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS timestamp, CAST(NULL AS VARCHAR) AS text WHERE false",
    "extract_dialect_a": f"""WITH {_LINES_A},
        e AS (SELECT sid, pos, ts, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS kind, trim(text) || CASE WHEN blocks AND role = 'user' THEN chr(10) || chr(10) || '[image pasted]' ELSE '' END AS text
              FROM l WHERE role <> 'system' AND NOT bad AND NOT side)
        SELECT sid AS session_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS BIGINT) AS event_pos, kind, ts AS timestamp, text FROM e""",
    "extract_dialect_k2": """WITH e AS (
          SELECT CAST(conv_id AS VARCHAR) AS sid, turn, CASE role WHEN 'user' THEN 'human' WHEN 'system' THEN 'boundary' ELSE 'assistant' END AS kind,
            CASE role WHEN 'user' THEN strftime(make_timestamp((1700000000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S.') || '000Z' ELSE '' END AS timestamp, CASE role WHEN 'system' THEN 'Clear' ELSE trim(text) END AS text FROM conversations)
        SELECT sid AS session_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY turn) - 1 AS BIGINT) AS event_pos, kind, timestamp, text FROM e""",
    "extract_dialect_k3": f"""WITH e AS (
          SELECT CAST(conv_id AS VARCHAR) AS sid, turn, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS kind, {_STAMP.format('conv_id * 1000 + turn')} AS timestamp, trim(text) AS text
          FROM conversations WHERE role = 'user' OR role = 'assistant' AND length(text) % 2 = 0)
        SELECT sid AS session_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY turn) - 1 AS BIGINT) AS event_pos, kind, timestamp, text FROM e""",
    "bad_lines": f"WITH {_LINES_A} SELECT sid AS session_id, count(*) FILTER (bad) AS bad_lines FROM l GROUP BY sid",
    "drops_a": f"""WITH {_LINES_A}
        SELECT sid AS session_id, 'side chain' AS reason, CASE WHEN length({_BLANK}) > 120 THEN left({_BLANK}, 117) || '...' ELSE {_BLANK} END AS snippet, ts AS timestamp FROM l WHERE role = 'user' AND side AND NOT bad""",
    "classify_sessions": """SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id % 3 = 0 OR conv_id % 2 <> 0 AS include,
        CASE WHEN conv_id % 3 = 0 THEN 'history' WHEN conv_id % 2 = 0 THEN 'spawned child' ELSE 'default' END AS reason FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "middle_cut": f"WITH {_cut('documents', 'doc_id', 'text', 1000)} SELECT doc_id, cut, dropped FROM cut",
    "text_functions": rf"""SELECT doc_id, CAST(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim({_BLANK}), ' ')) END AS INTEGER) AS words, len(string_split_regex(trim({_BLANK}), ' ')) <= 15 AS short,
        CASE WHEN length(trim({_BLANK})) > 120 THEN left(trim({_BLANK}), 117) || '...' ELSE trim({_BLANK}) END AS snippet, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS capped,
        {_KEY.format('right(text, 200)')} AS key, sha256(text) AS hash FROM documents""",
    "oversized_sessions": "SELECT doc_id, length(text) AS chars FROM documents WHERE strlen(text) > 8000 AND length(text) > 8000",
    "task_budget": f"""WITH {_MEMBERS}, s AS (SELECT slug, export, length(text) AS chars, count(*) OVER (PARTITION BY slug) AS members, sum(length(text)) OVER (PARTITION BY slug) AS total FROM m),
        d AS (SELECT slug, min(members) AS members, sum(chars) AS chars, sum(CASE WHEN total > 100000 AND chars > 100000 // members THEN chars - 100000 // members ELSE 0 END) AS dropped FROM s GROUP BY slug)
        SELECT slug, members, CAST(chars AS BIGINT) AS chars, CAST(dropped AS BIGINT) AS dropped, round((chars - dropped) / chars, 6) AS coverage, 'ready' AS status FROM d""",
    "outcome_summary": f"WITH {_MEMBERS}, {_DIGESTS}, {_SUMMARY} SELECT * FROM summary",
    "viable_tasks": f"WITH {_MEMBERS}, {_DIGESTS} SELECT DISTINCT slug FROM m JOIN g USING (export) WHERE outcome IN ('completed', 'partial')",
    "distinct_domains": f"WITH {_MEMBERS}, {_DIGESTS}, {_DOMAINS} SELECT * FROM dom",
    "author_work": f"""WITH {_MEMBERS}, {_DIGESTS}, {_LIBRARY}, n AS (SELECT slug, count(*) AS c, sum(length(text)) AS chars FROM m WHERE slug <> 'src1' GROUP BY slug),
        v AS (SELECT DISTINCT slug FROM m JOIN g USING (export) WHERE outcome IN ('completed', 'partial'))
        SELECT n.slug, CASE WHEN v.slug IS NULL THEN 'skipped' WHEN generation = 'g1' AND (NOT short OR c = 1) THEN 'resumed' WHEN is_edited THEN 'edited' WHEN chars > 150000 THEN 'over budget' ELSE 'ready' END AS status, CAST(chars AS BIGINT) AS chars
        FROM n LEFT JOIN v USING (slug) LEFT JOIN lib USING (slug)""",
    "provenance": f"""WITH {_MEMBERS}, {_DIGESTS}, {_SUMMARY}, {_DOMAINS},
        s AS (SELECT slug, CAST(count(*) AS INTEGER) AS members, string_agg(CASE WHEN pos % 4 <> 0 THEN 's' || pos ELSE 'unknown' END, ',' ORDER BY pos) AS session_ids FROM m WHERE slug <> 'src1' GROUP BY slug)
        SELECT s.slug, upper(s.slug) AS title, members, session_ids, outcome_summary, coalesce(domains, '') AS domains, 'low' AS confidence, sha256('# ' || s.slug) AS content_hash FROM s LEFT JOIN summary USING (slug) LEFT JOIN dom USING (slug)""",
    "orphans": f"""WITH {_MEMBERS}, {_LIBRARY} SELECT slug, CASE WHEN is_edited THEN 'kept because edited' ELSE 'removable' END AS plan FROM lib WHERE slug = 'src1' OR generation <> 'g1'""",
    "funnel": f"""WITH {_MEMBERS}, {_DIGESTS}, {_LIBRARY}
        SELECT 'discovered' AS stage, (SELECT count(*) FROM m) + (SELECT count(*) FROM g) AS n UNION ALL SELECT 'exported', count(*) FROM m UNION ALL SELECT 'digested', count(*) FROM g JOIN m USING (export) UNION ALL SELECT 'clustered', count(*) FROM m WHERE slug <> 'src1' UNION ALL SELECT 'misc', count(*) FROM m WHERE slug = 'src1'
        UNION ALL SELECT 'authored', count(*) FROM lib WHERE generation = 'g1' AND slug <> 'src1' UNION ALL SELECT 'tasks', count(DISTINCT slug) FROM m WHERE slug <> 'src1'""",
    "resume_work": f"WITH {_MEMBERS}, {_DIGESTS} SELECT export FROM m ANTI JOIN g USING (export)",
    "stale_keys": f"WITH {_MEMBERS}, {_DIGESTS} SELECT DISTINCT export FROM g ANTI JOIN (SELECT export FROM m WHERE pos % 3 <> 0) USING (export)",
    "apply_ratings": f"""WITH {_MEMBERS}, {_LIBRARY}, r AS (SELECT source AS slug, CAST(arg_max(n_chars % 5, doc_id) AS INTEGER) AS rating, {_STAMP.format('max(doc_id)')} AS rated_at FROM documents WHERE source <> 'src2' GROUP BY source)
        SELECT slug, generation, rating, rated_at FROM lib LEFT JOIN r USING (slug)""",
    "preferences_ranked": f"WITH {_PREFERENCES} SELECT key, text, count, last_authored_at, occurrences FROM r",
    "preference_block": f"""WITH {_PREFERENCES},
        b AS (SELECT count, chr(10) || '<!-- stated in ' || count || ' of 20 tasks -->' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY last_authored_at DESC, text) AS part FROM r GROUP BY count)
        SELECT '<!-- preferences -->' || chr(10) || '## Working preferences' || coalesce(chr(10) || string_agg(part, chr(10) ORDER BY count DESC), '') AS block FROM b""",
    "recurring_preferences": f"WITH {_PREFERENCES} SELECT count(*) FILTER (count > 1) AS recurring FROM r",
    "normalized_duplicates": f"SELECT sha256({_KEY.format('text')}) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "cluster_validation": f"""WITH {_MEMBERS}, u AS (
          SELECT CASE WHEN pos % 50 = 0 THEN 'Bad Slug' ELSE 'task-' || (pos % 20) END AS slug, CASE WHEN pos % 9 = 0 THEN export || 'x' ELSE export END AS member FROM m WHERE pos % 7 <> 0),
        x AS (SELECT export AS member FROM m WHERE pos % 14 = 0 UNION ALL SELECT 'nowhere' FROM m WHERE pos = 5)
        SELECT 'malformed slug' AS problem, slug, CAST(NULL AS VARCHAR) AS member FROM (SELECT DISTINCT slug FROM u) WHERE NOT {_SLUG_OK}
        UNION ALL SELECT 'duplicate slug', 'task-3', NULL WHERE EXISTS (SELECT 1 FROM u WHERE slug = 'task-3') UNION ALL SELECT 'no members', 'task-3', NULL WHERE EXISTS (SELECT 1 FROM u WHERE slug = 'task-3')
        UNION ALL SELECT 'unknown session', slug, member FROM u WHERE member NOT IN (SELECT export FROM m) UNION ALL SELECT 'unknown session', NULL, member FROM x WHERE member NOT IN (SELECT export FROM m)
        UNION ALL SELECT 'dropped session', NULL, export FROM m WHERE export NOT IN (SELECT member FROM u UNION SELECT member FROM x)""",
    "id_canonicalise": f"""WITH {_MEMBERS}, a AS (SELECT slug, pos, CASE WHEN pos % 2 = 0 THEN regexp_replace(export, '\\.md$', '') WHEN pos % 5 = 0 THEN export || '.md' ELSE export END AS member FROM m),
        i AS (SELECT export AS id FROM m WHERE pos % 3 <> 1)
        SELECT slug, pos, coalesce(i.id, s.id, member) AS member FROM a LEFT JOIN i ON i.id = member LEFT JOIN i s ON regexp_replace(s.id, '\\.md$', '') = regexp_replace(member, '\\.md$', '')""",
    "window_packing": """WITH RECURSIVE o AS (SELECT source, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, n_chars AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
        w AS (SELECT source, id, cost, rn, CAST(0 AS BIGINT) AS win, 500 + cost AS used FROM o WHERE rn = 1
              UNION ALL SELECT o.source, o.id, o.cost, o.rn, CASE WHEN used + o.cost > 20000 THEN win + 1 ELSE win END, CASE WHEN used + o.cost > 20000 THEN 500 + o.cost ELSE used + o.cost END FROM w JOIN o ON o.source = w.source AND o.rn = w.rn + 1)
        SELECT source, id, cost, win AS bin FROM w""",
    "apply_merges": f"""WITH RECURSIVE {_MEMBERS}, t AS (SELECT 'task-' || slug AS slug, upper(slug) AS title, {_NUMBER} AS n, CAST(count(*) AS INTEGER) AS members FROM m WHERE slug <> 'src1' GROUP BY m.slug),
        t2 AS (SELECT n, CASE WHEN slug = 'task-src18' THEN 'task-both-2' ELSE slug END AS slug, title, members FROM t),
        e AS (SELECT a.n AS pos, 'task-src' || a.n AS s1, 'task-src' || (a.n + 3) AS s2, coalesce(x.members, 0) + coalesce(y.members, 0) AS members, x.slug IS NULL OR y.slug IS NULL AS missing, row_number() OVER (ORDER BY a.n) AS rn
              FROM t a LEFT JOIN t2 x ON x.slug = a.slug LEFT JOIN t2 y ON y.slug = 'task-src' || (a.n + 3) WHERE a.n % 2 = 0),
        w AS (SELECT 0::BIGINT AS rn, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS note
              UNION ALL SELECT e.rn, CASE WHEN NOT missing AND NOT list_has_any(taken, [s1, s2]) THEN taken || [s1, s2] ELSE taken END, e.pos, CASE WHEN missing THEN 'unknown slug' WHEN list_has_any(taken, [s1, s2]) THEN 'already merged' END FROM w JOIN e ON e.rn = w.rn + 1),
        j AS (SELECT e.*, w.note FROM e JOIN w USING (rn)),
        k AS (SELECT * FROM t2 WHERE slug NOT IN (SELECT unnest([s1, s2]) FROM j WHERE note IS NULL)),
        g AS (SELECT row_number() OVER (ORDER BY pos) AS rn, 'task-both' AS slug, members, pos FROM j WHERE note IS NULL),
        {_allocate("g", "slug", "(SELECT list(slug) FROM k)")}
        SELECT slug, title, members, 'own' AS rationale, 'kept' AS kind, CAST(NULL AS VARCHAR) AS note FROM k
        UNION ALL SELECT made, 'both', members, 'why ' || pos, 'merged', NULL FROM g JOIN named USING (rn) UNION ALL SELECT 'task-both', 'both', 2, 'why ' || pos, 'skipped', note FROM j WHERE note IS NOT NULL""",
    "single_session_tasks": rf"""WITH RECURSIVE x AS (
          SELECT doc_id, CASE doc_id % 20 WHEN 3 THEN 'A b c d ' || (doc_id % 9) || ' x' WHEN 7 THEN 'A b' WHEN 8 THEN 'A b 2' ELSE 'A b--c d e f ' END || CASE WHEN doc_id % 20 IN (7, 8) THEN '(' ELSE (doc_id % 40) || '(' || doc_id END || repeat('(', CAST(doc_id // 20 AS BIGINT)) || '.md' AS export,
            'goal ' || (doc_id % 10) AS title, CASE doc_id % 20 WHEN 3 THEN 'a-b-c-d-' || (doc_id % 9) WHEN 7 THEN 'a-b' WHEN 8 THEN 'a-b-2' ELSE 'a-b-c-d-e' END AS slug FROM labels),
        g AS (SELECT *, row_number() OVER (ORDER BY export) AS rn FROM x),
        {_allocate("g", "slug", "CAST([] AS VARCHAR[])")}
        SELECT made AS slug, title, export AS members FROM g JOIN named USING (rn)""",
    "failure_streaks": """WITH r AS (SELECT user_id, CASE WHEN event_type IN ('error', 'view', 'click') THEN 'failed' END AS message, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE event_type <> 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        i AS (SELECT *, sum(CASE WHEN n > 1 AND message IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS island FROM (SELECT *, lag(message) OVER (PARTITION BY user_id ORDER BY n) AS prev FROM r))
        SELECT user_id, message, CAST(min(n) AS INTEGER) AS first_n, count(*) AS length, max(total) - min(n) - 3 + 1 AS not_attempted FROM i WHERE message IS NOT NULL GROUP BY user_id, island, message HAVING count(*) >= 3 AND max(total) > 3""",
    "edited_flag": "SELECT doc_id, doc_id % 3 = 1 AS edited FROM documents",
    "project_names": """WITH x AS (SELECT page_id, '-' || regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]+', '-', 'g') AS dir FROM pages),
        y AS (SELECT page_id, dir, '/' || regexp_replace(regexp_replace(dir, '^-+|-+$', '', 'g'), '-+', '/', 'g') AS path FROM x), z AS (SELECT *, list_last(string_split(path, '/')) AS base FROM y)
        SELECT page_id, dir, path, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY dir, page_id) AS n FROM z)""",
    "core_ids": r"""WITH x AS (SELECT page_id, url, regexp_replace(md5(url), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS u FROM pages)
        SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'other_' || u ELSE u END AS core, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe FROM x""",
    "fence_strip": r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents",
    "response_parse": f"""WITH {_DIGESTS}
        SELECT doc_id, doc_id % 3 <> 2 AND doc_id % 5 = 0 AS is_error, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 7 = 0 THEN 'nope' ELSE outcome END AS outcome,
          CASE WHEN doc_id % 3 = 2 THEN 'not an object' WHEN doc_id % 7 = 0 THEN 'bad outcome' END AS problem, CASE WHEN doc_id % 3 = 2 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS cost FROM g""",
    "plan_counts": f"""WITH {_EVENTS}, s AS (SELECT sid FROM kept GROUP BY sid HAVING count(*) >= 2)
        SELECT count(*) AS digests, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END::INTEGER AS cluster, CAST(greatest(1, floor(count(*) / 3 + 0.5)) AS BIGINT) AS author FROM s""",
    "digest_prompts": f"""WITH {_EVENTS},
        doc AS (SELECT sid, '<!-- source: log/' || sid || chr(10) || '     messages: ' || count(*) || ' -->' || chr(10) || string_agg(chr(10) || '### ' || ts || chr(10) || chr(10) || text || chr(10), '' ORDER BY idx) AS content FROM kept GROUP BY sid),
        {_cut('doc', 'sid', 'content', 400_000)},
        t AS (SELECT sid, string_agg(text, chr(10) ORDER BY idx) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY idx DESC) AS rn FROM kept) WHERE rn <= 3 GROUP BY sid),
        a AS (SELECT sid, arg_max(right(text, 1600), pos) AS reply FROM ev WHERE kind = 'assistant' GROUP BY sid)
        SELECT cut.sid AS export, sha256(cut || '|' || turns || '|' || coalesce(reply, '')) AS prompt_hash, dropped FROM cut JOIN t USING (sid) LEFT JOIN a USING (sid)""",
    "prompts_with_place_holders": f"""WITH doc AS (SELECT CAST(doc_id AS VARCHAR) AS sid, coalesce(text, '') || ' {{reply}} {{turns}}' AS content FROM documents),
        {_cut('doc', 'sid', 'content', 400_000)}
        SELECT cut.sid AS export, sha256(cut || '|' || coalesce(lang, '') || ' {{document}}' || chr(10) || '{{reply}}|{{turns}} ' || coalesce(source, '') || '|{{other}}') AS prompt_hash, dropped
        FROM cut JOIN documents d ON cut.sid = CAST(d.doc_id AS VARCHAR)""",
    "export_manifest": f"""WITH {_EVENTS}, s AS (SELECT sid, project, count(*) AS messages, arg_min(ts, idx) AS first_ts, arg_max(ts, idx) AS last_ts FROM kept GROUP BY sid, project)
        SELECT project || '-' || left(sid, 8) || '.md' AS export, project, sid AS session_id, messages, first_ts, last_ts FROM s""",
    "export_statistics": f"""WITH {_CONTEXT.replace("AND true", "AND sid IN (SELECT sid FROM st WHERE status = 'read')").replace("said AS (", _STATUS + "said AS (", 1)},
        a AS (SELECT sid, count(*) AS n FROM said GROUP BY sid), b AS (SELECT sid, count(*) AS n FROM kept GROUP BY sid),
        x AS (SELECT sid, origin, coalesce(a.n, 0) AS all_, coalesce(b.n, 0) AS n FROM st LEFT JOIN a USING (sid) LEFT JOIN b USING (sid) WHERE status = 'read'),
        e AS (SELECT sid, origin FROM x WHERE n >= 2)
        SELECT 'exported' AS counter, count(*) AS n FROM e UNION ALL SELECT 'messages', CAST(coalesce(sum(n), 0) AS BIGINT) FROM x WHERE n >= 2 UNION ALL SELECT 'duplicates', CAST(coalesce(sum(all_ - n), 0) AS BIGINT) FROM x
        UNION ALL SELECT 'filtered', count(*) FROM st WHERE status = 'filtered' UNION ALL SELECT 'automation', count(*) FROM st WHERE status = 'automation' UNION ALL SELECT 'read_errors', count(*) FROM st WHERE status = 'unreadable'
        UNION ALL SELECT 'zero_message', count(*) FROM x WHERE n = 0 UNION ALL SELECT 'below_minimum', count(*) FROM x WHERE n = 1 UNION ALL SELECT 'bad_lines', count(*) FROM x WHERE CAST(sid AS BIGINT) % 2 = 1
        UNION ALL SELECT 'short_turns', count(*) FROM ctx WHERE session_id IN (SELECT sid FROM e) UNION ALL SELECT 'with_decision', count(*) FROM ctx WHERE decision_kind IS NOT NULL AND session_id IN (SELECT sid FROM e)
        UNION ALL SELECT 'outcome_sessions', count(*) FROM e WHERE sid IN (SELECT sid FROM ev WHERE kind = 'assistant' AND text <> '') UNION ALL SELECT 'stale_outputs', count(*) FROM st
        UNION ALL SELECT 'exported:' || origin, count(*) FROM e GROUP BY origin""",
    "task_marks": f"""WITH {_MEMBERS}, {_DIGESTS}, {_LIBRARY}, {_SUMMARY}, v AS (SELECT DISTINCT slug FROM m JOIN g USING (export) WHERE outcome IN ('completed', 'partial'))
        SELECT lib.slug, CASE WHEN generation = 'g1' THEN 'authored' WHEN v.slug IS NULL THEN 'skipped: ' || outcome_summary ELSE 'pending' END AS mark FROM lib LEFT JOIN v USING (slug) LEFT JOIN summary USING (slug) WHERE lib.slug <> 'src1'""",
    "cross_window_slugs": f"""WITH RECURSIVE x AS (
          SELECT CASE doc_id % 9 WHEN 4 THEN 'task-x-' || (doc_id % 5 + 2) WHEN 5 THEN 'a-b-c-d-' || (doc_id % 4) WHEN 6 THEN 'a-b-c-d' WHEN 0 THEN 'task-x' ELSE 'task-' || (doc_id % 60) END AS slug, doc_id % 7 AS win, doc_id AS pos FROM documents),
        g AS (SELECT *, row_number() OVER (ORDER BY win, pos) AS rn FROM x),
        {_allocate("g", "slug", "CAST([] AS VARCHAR[])")}
        SELECT made AS slug, win, pos FROM g JOIN named USING (rn)""",
    "library_read": f"""SELECT 's' || doc_id AS slug, 's' || doc_id AS title, source AS members, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, {_STAMP.format('doc_id')} AS authored_at, 1.0::DOUBLE AS coverage FROM documents WHERE doc_id % 5 > 1""",
    "library_issues": """SELECT 's' || doc_id AS slug, CASE WHEN doc_id % 10 = 7 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'not JSON' ELSE 'fails schema' END AS issue FROM documents WHERE doc_id % 10 = 7 OR doc_id % 5 < 2""",
}

#: Names that these queries had beside others over parts of texts; all run over whole texts now.
ORACLES["context_in_stretches"] = ORACLES["short_turn_context"]
ORACLES["document_chunks"] = f"""WITH whole AS ({ORACLES['export_documents']})
    SELECT session_id, messages, chunk, chunk * 900 AS "offset", substring(content, CAST(chunk * 900 + 1 AS BIGINT), 900) AS content
    FROM (SELECT *, unnest(range(0, (length(content) + 899) // 900)) AS chunk FROM whole)"""
ORACLES["windows_of_large_groups"] = ORACLES["window_packing"].replace("source", "lang")
ORACLES |= {f"{name}_whole": ORACLES[name] for name in ("fence_strip", "preferences_ranked", "preference_block", "recurring_preferences", "digest_prompts")}
_HUMAN = f"WITH x AS ({ORACLES['extract_dialect_a']}), h AS (SELECT * FROM x WHERE kind = 'human'),"
ORACLES["law_breaks"] = f"""{_HUMAN}
    a AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY event_pos) AS INTEGER) AS n, timestamp, text FROM h WHERE length(text) % 17 > 0),
    b AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY event_pos) AS INTEGER) AS n, timestamp, text FROM h)
    SELECT 'message' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'event', * FROM (FROM b EXCEPT ALL FROM a)"""
