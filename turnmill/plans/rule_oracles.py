"""DuckDB SQL of the queries in ``rules``, written from what each rule says."""

from __future__ import annotations

from turnmill.plans.oracles import _BLANK, _DIGESTS, _EVENTS, _KEY, _MEMBERS, _STAMP, _cut

_USER = f"""
l AS (SELECT CAST(conv_id AS VARCHAR) AS sid, turn AS pos, {_STAMP.format('conv_id * 1000 + turn')} AS ts, text, role, length(text) AS n FROM conversations)"""


def _snippet(value: str) -> str:
    line = rf"trim(regexp_replace({value}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({line}) > 120 THEN left({line}, 117) || '...' ELSE {line} END"


_TIME = "strftime(make_timestamp((1700000000 + pos) * 1000000), '%Y-%m-%dT%H:%M:%S.') || '000Z'"
_UUID = r"regexp_replace(md5(CAST(conv_id AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"
_SESSIONS = f"""{_EVENTS},
ses AS (
  SELECT sid, max(ts) AS mtime, CAST(sid AS BIGINT) AS n, 'log/' || sid AS path FROM ev GROUP BY sid),
place AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'k2' ELSE 'k3' END AS origin, CASE WHEN n % 3 > 0 AND n % 5 > 0 THEN '/w' || (n % 5) || '/src' END AS cwd, '-home-w' || (n % 4) || '-app' AS folder FROM ses)"""

ORACLES: dict[str, str] = {
    "rules_dialect_a": rf"""WITH {_USER},
        h AS (SELECT sid, pos, 0 AS sub, ts, 'human' AS kind, CASE n % 9 WHEN 0 THEN trim(text) || chr(10) || chr(10) || trim(text) WHEN 4 THEN '[command] /go ' || trim(text) WHEN 5 THEN '[decision] "' || trim(text) || '" → a, b' ELSE trim(text) END AS text
              FROM l WHERE role = 'user' AND n % 9 NOT IN (3, 6, 7)),
        s AS (SELECT sid, pos, unnest(CASE WHEN n % 2 = 0 THEN [1, 2, 3, 4] ELSE [0] END) AS sub, ts, text, n FROM l WHERE role NOT IN ('user', 'system')),
        a AS (SELECT sid, pos, sub, ts, CASE sub WHEN 2 THEN 'plan' WHEN 3 THEN 'question' ELSE 'assistant' END AS kind, CASE sub WHEN 2 THEN 'plan ' || n WHEN 3 THEN 'Go on? [yes, no] (multi-select)' WHEN 4 THEN 'end' ELSE trim(text) END AS text FROM s)
        SELECT sid AS session_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY pos, sub) - 1 AS BIGINT) AS event_pos, kind, ts AS timestamp, text FROM (SELECT sid, pos, sub, ts, kind, text FROM h UNION ALL SELECT sid, pos, sub, ts, kind, text FROM a)""",
    "rule_drops_a": f"""WITH {_USER}
        SELECT sid AS session_id, CASE n % 9 WHEN 3 THEN 'attachment' WHEN 6 THEN 'machine block' ELSE 'interruption' END AS reason,
          CASE n % 9 WHEN 3 THEN {_snippet('text')} WHEN 6 THEN {_snippet("'<ide>' || text")} ELSE '[Request interrupted by user]' END AS snippet, ts AS timestamp FROM l WHERE role = 'user' AND n % 9 IN (3, 6, 7)""",
    "rule_bad_lines": f"WITH {_USER} SELECT sid AS session_id, CAST(0 AS BIGINT) AS bad_lines FROM l GROUP BY sid",
    "rules_dialect_k2": f"""WITH {_USER},
        e AS (SELECT sid, pos, 0 AS sub, CASE role WHEN 'user' THEN 'human' WHEN 'system' THEN 'boundary' ELSE 'assistant' END AS kind, CASE WHEN role = 'user' THEN {_TIME} ELSE '' END AS ts,
                CASE WHEN role = 'system' THEN 'Clear' WHEN role <> 'user' THEN trim(text || chr(10) || 'b') WHEN n % 6 = 0 THEN trim(text) || chr(10) || chr(10) || '[image pasted]' ELSE trim(text) END AS text
              FROM l WHERE role <> 'user' OR n % 6 NOT IN (1, 2) UNION ALL SELECT sid, pos, 1, 'boundary', '', 'Compaction' FROM l WHERE role = 'user' AND n % 6 = 4)
        SELECT sid AS session_id, CAST(row_number() OVER (PARTITION BY sid ORDER BY pos, sub) - 1 AS BIGINT) AS event_pos, kind, ts AS timestamp, text FROM e""",
    "rule_drops_k2": f"""WITH {_USER}, u AS (SELECT *, n % 6 AS m FROM l WHERE role = 'user' AND n % 6 <> 3)
        SELECT sid AS session_id, CASE m WHEN 0 THEN 'unknown block audio' WHEN 1 THEN 'bracket marker' WHEN 2 THEN 'harness nudge' WHEN 4 THEN 'snapshot only' ELSE 'empty' END AS reason,
          CASE m WHEN 0 THEN 'zz' WHEN 1 THEN {_snippet("'[Subagent completion event] ' || text")} WHEN 2 THEN {_snippet("'You took too long to respond: ' || text")} WHEN 4 THEN {_snippet("'only here ' || text")} ELSE '' END AS snippet, {_TIME} AS timestamp FROM u""",
    "classify_tree_sessions": """WITH c AS (SELECT DISTINCT conv_id AS n FROM conversations WHERE role = 'user'),
        r AS (SELECT n, CASE WHEN n % 5 = 2 THEN 'own session' WHEN n % 7 = 0 THEN 'history' WHEN n % 5 = 0 THEN 'agent prompt' WHEN n % 5 = 1 THEN 'automation' WHEN n % 5 = 3 THEN 'nudge only' ELSE 'default' END AS reason FROM c)
        SELECT CAST(n AS VARCHAR) AS session_id, reason IN ('history', 'default') AS include, reason FROM r""",
    "detect_formats": "SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 2 = 1 THEN 'k3' ELSE 'k2' END AS format FROM conversations GROUP BY conv_id",
    "newer_store_wins": f"SELECT conv_id, {_UUID} AS session_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 2",
    "orphan_histories": f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT CASE conv_id % 4 WHEN 1 THEN 'sess_' || {_UUID} WHEN 2 THEN 'gone-' || conv_id ELSE 'cli_' || {_UUID} || '_x' END AS stem
        FROM c WHERE conv_id % 4 = 2 OR conv_id % 4 = 1 AND conv_id % 3 <> 0 OR conv_id % 4 = 3 AND conv_id % 3 <> 1""",
    "session_projects": f"""WITH {_SESSIONS},
        f AS (SELECT DISTINCT origin = 'a' AS own, CASE WHEN origin = 'a' THEN folder ELSE coalesce(cwd, '') END AS dir FROM place),
        b AS (SELECT own, dir, CASE WHEN own THEN 'app' WHEN dir = '' THEN 'unknown' ELSE 'src' END AS base FROM f),
        p AS (SELECT own, dir, base || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END AS project FROM (SELECT *, row_number() OVER (PARTITION BY own, base ORDER BY dir) AS rn FROM b))
        SELECT sid AS session_id, project FROM place JOIN p ON own = (origin = 'a') AND dir = CASE WHEN origin = 'a' THEN folder ELSE coalesce(cwd, '') END""",
    "folder_groups": f"WITH {_SESSIONS} SELECT coalesce(cwd, '') AS cwd, count(*) AS sessions, max(mtime) AS latest FROM place WHERE origin <> 'a' GROUP BY 1",
    "newest_sessions": f"WITH {_SESSIONS} SELECT sid AS session_id, folder, CAST(row_number() OVER (PARTITION BY folder ORDER BY mtime DESC, path) AS INTEGER) AS place FROM place",
    "session_metadata": """SELECT CAST(page_id AS VARCHAR) AS meta_path, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN '/r' END AS cwd, CASE WHEN page_id % 5 = 0 THEN 't' || page_id END AS title,
        CASE WHEN page_id % 5 = 0 AND page_id % 4 = 0 THEN url WHEN page_id % 5 = 1 THEN 'p' END AS parent_id, CAST(NULL AS VARCHAR) AS created_reason FROM pages""",
    "document_names": """WITH RECURSIVE c AS (
          SELECT conv_id, 'p-' || (conv_id % 2) AS p, 'abcdefgh' || CASE WHEN conv_id % 10 = 0 THEN '' ELSE left(md5(CAST(conv_id AS VARCHAR)), 3) END AS stem, row_number() OVER (ORDER BY conv_id) AS rn FROM (SELECT DISTINCT conv_id FROM conversations)),
        w AS (SELECT 0::BIGINT AS rn, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS conv_id, CAST(NULL AS VARCHAR) AS export
              UNION ALL
              SELECT rn, taken || [x], conv_id, x FROM (
                SELECT c.rn, w.taken, c.conv_id, list_filter(list_transform(range(8, length(stem) + 1), lambda n: p || '-' || left(stem, n)) || list_transform(range(2, 400), lambda n: p || '-' || stem || '-' || n), lambda x: NOT list_contains(w.taken, x))[1] AS x
                FROM w JOIN c ON c.rn = w.rn + 1))
        SELECT conv_id, export || '.md' AS export FROM w WHERE rn > 0""",
    "unreadable_members": f"""WITH {_MEMBERS}, s AS (SELECT slug, CASE WHEN pos % 100 <> 77 THEN length(text) END AS chars FROM m)
        SELECT slug, count(*) AS members, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars, CASE WHEN count(*) > count(chars) THEN 'unreadable' WHEN sum(chars) > 100000 THEN 'over budget' ELSE 'ready' END AS status FROM s GROUP BY slug""",
    "member_rows": f"""WITH {_MEMBERS}, {_DIGESTS}, x AS (SELECT 'doc-' || doc_id || '.md' AS export, doc_id % 3 + 1 AS n, CASE WHEN quality = 1 THEN doc_id % 3 + 1 ELSE 0 END AS k FROM labels)
        SELECT slug, m.export, outcome, CASE WHEN pos % 4 <> 0 THEN 's' || pos ELSE 'unknown' END AS session_id, CASE WHEN pos % 4 <> 0 AND pos % 3 > 0 THEN 'k2' ELSE 'a' END AS origin, CAST(coalesce(n, 0) AS BIGINT) AS context_rows, CAST(coalesce(k, 0) AS BIGINT) AS decisions
        FROM m LEFT JOIN g USING (export) LEFT JOIN x USING (export)""",
    "truncated_members": f"""WITH {_MEMBERS}, s AS (SELECT slug, export, length(text) AS chars, 100000 // count(*) OVER (PARTITION BY slug) AS share, sum(length(text)) OVER (PARTITION BY slug) AS total FROM m)
        SELECT slug, export, chars - share AS dropped_chars FROM s WHERE total > 100000 AND chars > share""",
    "parsed_documents": r"""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<!-- note -->' ELSE '' END AS comment, CASE doc_id % 3 WHEN 0 THEN 'Title ' || doc_id WHEN 1 THEN 'Only' ELSE '' END AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents)
        SELECT * FROM c""",
    "library_listing": f"""SELECT 's' || doc_id AS slug, 'T' || doc_id AS title, concat_ws(', ', source, lang) AS domains, CAST(doc_id % 3 + 1 AS INTEGER) AS members, 'high' AS confidence, '2024-01-01' AS authored, CASE WHEN doc_id % 4 = 0 THEN '13%' END AS coverage,
        doc_id % 2 = 0 AS edited, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 3 AS INTEGER) END AS rating, CAST(CASE WHEN trim({_BLANK}) = '' THEN 0 ELSE len(string_split(trim({_BLANK}), ' ')) END AS INTEGER) AS words FROM documents""",
    "misc_union": "SELECT DISTINCT 'doc-' || (doc_id // k) AS member FROM documents, (SELECT unnest([2, 3, 5]) AS k)",
    "coverage_equality": "SELECT unnest(['same', 'more', 'less']) AS inputs, unnest([true, false, false]) AS same FROM (SELECT count(*) FROM documents)",
    "resume_note": f"""WITH {_MEMBERS}, {_DIGESTS} SELECT count(g.export) AS done, count(*) - count(g.export) AS remaining FROM m LEFT JOIN g USING (export) WHERE pos % 2 = 0""",
    "cluster_prompts": f"""WITH {_DIGESTS},
        x AS (SELECT doc_id % 4 AS w, export, '{{"export":"' || export || '","goal":"' || goal || '","deliverable":"x","domain":" Area' || (doc_id % 3) || '","keywords":["k"],"outcome":"' || outcome || '"}}' AS line,
                CASE WHEN doc_id % 4 = 1 OR doc_id % 8 = 2 THEN 'dialect K' ELSE 'dialect A' END AS noun FROM g)
        SELECT 'g' || w AS win, sha256(CASE WHEN count(DISTINCT noun) > 1 THEN 'coding-agent' ELSE min(noun) END || '|' || string_agg(line, chr(10) ORDER BY export)) AS prompt_hash FROM x GROUP BY w""",
    "merge_prompts": f"""WITH {_MEMBERS}, x AS (SELECT slug, count(*) AS n FROM m WHERE slug <> 'src1' GROUP BY slug)
        SELECT count(*) || '|' || string_agg('{{"slug":"' || slug || '","title":"' || upper(slug) || '","rationale":"why ' || slug || '","sessions":' || n || '}}', chr(10) ORDER BY slug) AS prompt FROM x""",
    "author_prompts": f"""WITH {_MEMBERS}, s AS (SELECT slug, export, pos, text AS t, greatest(1, 20000 // count(*) OVER (PARTITION BY slug)) AS share, sum(length(text)) OVER (PARTITION BY slug) AS total FROM m WHERE slug <> 'src1'),
        {_cut('s', 'slug, export, pos, share, total', 't', 'share')},
        c AS (SELECT k5.slug, k5.pos, '== ' || k5.export || chr(10) || CASE WHEN k5.total > 20000 THEN cut ELSE k5.t END || CASE WHEN k5.pos % 2 = 0 THEN chr(10) || '> go ' || k5.pos || chr(10) || 'answering: said ' || k5.pos ELSE '' END AS block FROM k5 JOIN cut USING (slug, export)),
        p AS (SELECT slug, slug || '|' || upper(slug) || '|' || CASE WHEN slug = 'src2' THEN '' ELSE 'L' END || '|' || string_agg(block, chr(10) || chr(10) ORDER BY pos) AS prompt FROM c GROUP BY slug)
        SELECT slug, sha256(prompt) AS prompt_hash, CAST(length(prompt) AS INTEGER) AS chars FROM p""",
    "consolidate_prompt": "SELECT sha256(string_agg('- do ' || doc_id || ' (' || (doc_id % 7 + 1) || ')', chr(10) ORDER BY doc_id % 7 DESC, doc_id % 3 DESC, 'do ' || doc_id)) AS prompt_hash FROM documents",
    "answer_validation": """SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'bad tasks' WHEN 2 THEN 'bad misc' END AS cluster, CASE WHEN doc_id % 6 IN (3, 4) THEN 'bad merges' END AS "merge",
        CASE doc_id % 6 WHEN 1 THEN 'missing slug' WHEN 2 THEN 'missing title' WHEN 3 THEN 'body too short' WHEN 4 THEN 'bad confidence' WHEN 5 THEN 'bad preferences' END AS author, CASE doc_id % 6 WHEN 1 THEN 'bad preferences' WHEN 5 THEN 'not an object' END AS united FROM labels""",
    "run_costs": "SELECT doc_id % 5 AS run, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN doc_id % 8 / 4 ELSE 0 END) AS DOUBLE) AS cost FROM labels GROUP BY 1",
    "preference_occurrences": f"""WITH p AS (SELECT source AS slug, doc_id, {_KEY.format("split_part(text, chr(10), 1)")} AS key FROM documents)
        SELECT key, slug, CAST(doc_id AS VARCHAR) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY slug, key ORDER BY doc_id) AS rn FROM p WHERE key <> '') WHERE rn = 1""",
    "flat_preferences": f"""SELECT '<!-- preferences of 2024-01-01, for the agents file -->' || chr(10) || '## Working preferences' || chr(10) || chr(10) || string_agg('- do ' || doc_id, chr(10) ORDER BY {_STAMP.format('doc_id')} DESC) AS block FROM labels""",
}
