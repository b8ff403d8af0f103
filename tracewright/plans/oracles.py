"""The catalogue's queries in DuckDB's SQL.  RE2's ``\\b`` is ASCII, as redaction wants it."""

from __future__ import annotations

from .. import fixed as X
from .catalogue import ASKED, PLANTED, QUESTIONS

def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _redact(text: str, home: str = "") -> str:
    controls = X.TERMINAL_CONTROLS.replace("*+", "*").replace(r"(?:\x1b(?!\\)[^\x07\x9c\x1b]*)*", "").replace(r"[^\x07\x9c\x1b]*", r"(?:[^\x07\x9c\x1b]|\x1b[^\\])*")
    out = f"regexp_replace({text}, {_quote(controls)}, '', 'g')"
    for pattern, to in X.SECRETS:
        p = pattern.replace(r"(?<![A-Za-z0-9_])", r"\b").replace(r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", r"\b").replace("(?md)", "(?m)")
        out = f"regexp_replace({out}, {_quote(p)}, {_quote(to.replace('$1', chr(92) + '1').replace('$3', chr(92) + '3'))}, 'g')"
    return f"replace({out}, '{home}', '~')" if home else out


def _first(items: str, most: int) -> str:
    """First occurrences, limited."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)[:{most}]"


_TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_STOP = "[" + ", ".join(map(_quote, X.STOPWORDS)) + "]"
_HASH = "sha256(encode({role}) || '\\x00'::BLOB || encode({kind}) || '\\x00'::BLOB || encode({text}))[:32]"
_WORDS = r"unnest(list_filter(regexp_split_to_array(lower({t}), '[^\p{L}\p{N}\p{M}\p{Co}]+'), lambda w: w <> ''))"

_CORPUS = f"""
    e AS (SELECT conv_id * 1000000 + turn AS event_id, conv_id::VARCHAR AS session_id, turn AS seq, role, coalesce(text, '') AS text,
                 CASE role WHEN 'user' THEN 20.0 WHEN 'assistant' THEN 3.0 WHEN 'tool' THEN 1.0 ELSE 7.0 END::DOUBLE AS weight FROM conversations),
    w AS (SELECT event_id, {_WORDS.replace("{t}", "text")} AS term FROM e),
    l AS (SELECT e.event_id, count(term) AS dl FROM e LEFT JOIN w USING (event_id) GROUP BY 1),
    c AS (SELECT count(*) AS n, sum(dl) / count(*)::DOUBLE AS avgdl FROM l),
    q(pos, term) AS (VALUES {ASKED}),
    h AS (SELECT pos, w.term, w.event_id, count(*) AS tf FROM w JOIN q USING (term) GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
    i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM d, c)"""


def _bm25(weighted: bool) -> str:
    f = "(tf * weight)" if weighted else "tf::DOUBLE"
    return f"""{_CORPUS},
    s AS (SELECT event_id, round(list_sum(list(part ORDER BY pos)) * 1000000.0)::BIGINT AS score
          FROM (SELECT event_id, pos, idf * ({f} * 2.2::DOUBLE) / ({f} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part
                FROM h JOIN i USING (term) JOIN l USING (event_id) JOIN e USING (event_id), c) GROUP BY 1)"""


_CANDIDATES = f"""{_bm25(True)},
    t AS (SELECT event_id, score FROM s ORDER BY score DESC, event_id LIMIT 480),
    k AS (SELECT t.score, e.*, 'r' || (session_id::BIGINT % 50) AS root_id, {_HASH.format(role="role", kind="'response_message'", text="text")} AS content_hash FROM t JOIN e USING (event_id)),
    m AS (SELECT session_id, max(score) AS score FROM k GROUP BY 1 ORDER BY score DESC, session_id LIMIT 5)"""


#: Candidates by a rule, their sessions and evidence in final order.
_PACKETS = f"""
    e AS (SELECT conv_id::VARCHAR AS session_id, turn AS seq, role, coalesce(text, '') AS text, conv_id * 31 + turn AS n, conv_id % 4 AS query_id, 'r' || (conv_id % 10) AS root_id FROM conversations),
    k AS (SELECT *, n * 7919 % 1009 AS score, CASE WHEN n % 5 > 0 THEN 't' || (n % 3) END AS timestamp, md5(role || (n % 3)) AS content_hash FROM e),
    m AS (SELECT * FROM (SELECT query_id, session_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, session_id) AS place FROM k GROUP BY 1, 2) WHERE place <= 3),
    u AS (SELECT k.*, row_number() OVER (PARTITION BY k.query_id, root_id, content_hash ORDER BY k.score DESC, session_id, seq) AS copy FROM k SEMI JOIN m USING (query_id, session_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id, seq) AS r FROM u WHERE copy = 1),
    z AS (SELECT query_id, (SELECT count(*) FROM m WHERE m.query_id = o.query_id) AS sessions, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, timestamp NULLS FIRST, session_id, seq) - 1 AS place, session_id, root_id, role, timestamp,
                 'codex://session/' || session_id || '#event-' || seq AS citation, '/l/' || session_id || ':' || (seq + 1) AS source, seq + 1 AS line, seq * 10 AS byte_offset, score, {_redact("text")} AS shown FROM o WHERE r <= 7)"""

#: Conversations as an index has them: files but the last, events of those with a session record.
_INDEXED = """
    c AS (SELECT conv_id, turn, role AS own, coalesce(text, '') AS text, conv_id < (SELECT max(conv_id) FROM conversations) AS held FROM conversations),
    v AS (SELECT 's' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, line_no, CASE WHEN own IN ('user','assistant','tool','developer','system') THEN own ELSE 'unknown' END AS role, text
          FROM (SELECT *, 1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no FROM c WHERE held AND conv_id % 7 <> 0) WHERE text <> '')"""


def _hints(pattern: str, text: str, group: int, most: int, where: str = "true") -> str:
    found = f"list_transform(list_filter(regexp_extract_all({text}, {_quote(pattern.replace('(?iuU)', '(?i)'))}, {group}), lambda v: {where}), lambda v: lower(v))"
    return f"array_to_string({_first(found, most)}, ',')"


ORACLES: dict[str, str] = {
    "parse_rollouts": """
        WITH g AS (SELECT conv_id, turn, CASE WHEN role IN ('user','assistant','tool','developer','system') THEN role ELSE 'unknown' END AS role, text FROM conversations WHERE (conv_id + turn) % 7 <> 0 AND text <> '')
        SELECT conv_id::VARCHAR AS path, turn + 1 AS line, 'response_message' AS kind, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM g
        UNION ALL SELECT conv_id::VARCHAR, turn + 1, 'malformed_json', NULL, NULL, NULL FROM conversations WHERE (conv_id + turn) % 7 = 0""",
    "event_normalize": """
        SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq,
               CASE WHEN role IN ('user','assistant','tool','developer','system') THEN role ELSE 'unknown' END AS role,
               CASE WHEN role IN ('user','assistant','tool') THEN role ELSE 'metadata' END AS field FROM conversations""",
    "turn_carry": """
        SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_id FROM events""",
    "first_meta": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'signup') WHERE r = 1",
    "json_field": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN regexp_extract(props, ':\\s*([0-9]+)', 1)::BIGINT END AS k FROM events",
    "parse_kinds": f"""
        WITH e AS (SELECT user_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no, event_id % 13 AS k, event_id::VARCHAR AS n FROM events),
        v AS (SELECT *, last_value(CASE WHEN k = 0 THEN 'turn' || n END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM e)
        SELECT path, line_no, ['turn_context','user_message','final_answer','agent_message','task_complete','tool_call','tool_call','','','','','task_complete','response_message'][k + 1] AS kind,
               row_number() OVER (PARTITION BY path ORDER BY line_no) AS seq, 't' || n AS timestamp, turn AS turn_id,
               ['metadata','user','assistant','assistant','metadata','tool','tool','','','','','metadata','unknown'][k + 1] AS role,
               [concat('model m', n, chr(10), 'cwd /w/', n), concat('ask ', n, chr(10), '[attachments]', chr(10), '/i', n, '.png'), 'done ' || n, 'on it ' || n, 'over ' || n, concat('run', chr(10), 'x', n),
                concat('tool', chr(10), '{{"a":[1],"z":', n, '}}'), '', '', '', '', '', concat('in ', n, chr(10), 'out')][k + 1] AS text,
               CASE k WHEN 2 THEN 'final_answer' WHEN 3 THEN 'commentary' END AS phase, CASE k WHEN 0 THEN 'm' || n END AS model, CASE k WHEN 4 THEN 'completed' WHEN 6 THEN 'ok' WHEN 11 THEN 'failed' END AS status,
               CASE k WHEN 4 THEN n::BIGINT END AS duration_ms, CASE k WHEN 5 THEN 'run' WHEN 6 THEN 'tool' END AS tool_name, CASE k WHEN 5 THEN 'c' || n WHEN 6 THEN 'd' END AS call_id
        FROM v WHERE k NOT IN (7, 8, 9, 10)
        UNION ALL SELECT path, line_no, CASE k WHEN 8 THEN 'oversized_line' ELSE 'invalid_record' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM v WHERE k IN (8, 9)""",
    "hint_ids": """
        SELECT p_partkey, concat_ws(',', concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]), 'r' || p_partkey || 'x', 'ab-' || p_partkey || '-cdefg') AS ids FROM (SELECT p_partkey, md5(p_partkey::VARCHAR) AS h FROM part)""",
    "hint_named_repos": "SELECT p_partkey, 'acme_' || p_partkey || ',my-cool-app' || p_partkey AS repos FROM part",
    "query_bounds": "WITH b AS (SELECT doc_id, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 2048) AS q FROM documents), t AS (SELECT doc_id, q, list_filter(" + _TOKENS.replace("{t}", "q") + f", lambda w: (length(w) >= 2 OR regexp_full_match(w, '\\p{{N}}+')) AND NOT list_contains({_STOP}, w[:64])) AS w FROM b) SELECT doc_id, length(q) AS n, sha256(q) AS sha, least(32, len(list_distinct(list_transform(w, lambda x: x[:64])))) AS n_terms FROM t",
    "redact_controls": r"""
        SELECT doc_id, concat(lang, ' ', source, ' ~/', doc_id, '\x', chr(9), 'y', chr(10)) AS redacted, concat(lang, ' ', source, ' ~/', doc_id, '/x', chr(9), 'y', chr(10)) AS shown FROM documents""",
    "boost_repo": """
        SELECT doc_id, CASE WHEN lang <> 'fr' AND source IN ('src1', 'src2') THEN 6000000 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1500000 ELSE 800000 END AS boost FROM documents""",
    "packet_order": f"WITH {_PACKETS} SELECT query_id, 'say `' || query_id || '`' AS query, sessions, place, session_id, root_id, timestamp, citation, source, line, byte_offset, score FROM z",
    "packet_sessions": f"WITH {_PACKETS} SELECT query_id, place - 1 AS place, session_id, 'r' || (session_id::BIGINT % 10) AS root_id, 'repo' || (session_id::BIGINT % 3) AS repo, 'complete' AS provenance_status, score FROM m",
    "packet_markdown": f"""
        WITH {_PACKETS},
        h AS (SELECT query_id, concat('# Dossier: say  ', query_id, ' ', chr(10), chr(10), 'Intent: `general` · ', max(sessions), ' sessions · ', count(*), ' evidence events', chr(10)) AS head,
                     string_agg(concat(chr(10), '- **', role, ' / response_message**', CASE WHEN timestamp IS NOT NULL THEN ' · `' || timestamp || '`' ELSE '' END, chr(10),
                       array_to_string(list_transform(CASE WHEN shown = '' THEN [] ELSE regexp_split_to_array(regexp_replace(shown, '\r?\n$', ''), '\r?\n')[:80] END, lambda s: '    ' || s || chr(10)), ''),
                       '    `', citation, '` · `', source, '`', chr(10)), '' ORDER BY place) AS body FROM z GROUP BY 1),
        f AS (SELECT query_id, head || chr(10) || '## Evidence' || chr(10) AS top, concat(head, chr(10), '## Evidence', chr(10), body, chr(10), 'This is cited evidence, not a generated answer.', chr(10)) AS md FROM h
              UNION ALL SELECT 4, md, md FROM (SELECT concat('# Dossier: say  4 ', chr(10), chr(10), 'Intent: `general` · 0 sessions · 0 evidence events', chr(10), chr(10), 'No matching Codex evidence was found.', chr(10)) AS md))
        SELECT query_id, top AS head, sha256(md) AS sha FROM f""",
    "index_events": f"""
        WITH {_INDEXED} SELECT session_id, seq, line_no, role, 'response_message' AS kind, sha256(text) AS sha, {_HASH.format(role="role", kind="'response_message'", text="text")} AS content_hash FROM v""",
    "index_sessions": f"""
        WITH RECURSIVE {_INDEXED},
        s AS (SELECT DISTINCT conv_id AS k, CASE WHEN conv_id % 3 = 0 THEN conv_id - 2 END AS p FROM c WHERE held AND conv_id % 7 <> 0),
        g AS (SELECT s.k, s.p, t.k IS NOT NULL AS held FROM s LEFT JOIN s t ON s.p = t.k),
        r AS (SELECT k, k AS here, 0 AS steps FROM g UNION ALL SELECT r.k, g.p, steps + 1 FROM r JOIN g ON r.here = g.k WHERE g.held),
        z AS (SELECT k, max_by(here, steps) AS here FROM r GROUP BY 1)
        SELECT 's' || z.k AS session_id, '/w/repo' || (z.k % 5) AS cwd, 'repo' || (z.k % 5) AS repo, 's' || own.p AS parent_id, 's' || coalesce(g.p, z.here) AS root_id,
               CASE WHEN g.p IS NULL THEN 'complete' ELSE 'orphan' END AS provenance_status, CASE WHEN own.p IS NULL THEN 'user' ELSE 'subagent' END AS thread_source, 't0' AS timestamp
        FROM z JOIN g ON z.here = g.k JOIN s own ON own.k = z.k""",
    "index_files": f"""
        WITH {_INDEXED}, f AS (SELECT conv_id, '/logs/' || CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END || '/' || lpad(conv_id::VARCHAR, 6, '0') || '.jsonl' AS path FROM c WHERE held GROUP BY 1)
        SELECT path, row_number() OVER (ORDER BY path) - 1 AS place, CASE WHEN conv_id % 7 <> 0 THEN 's' || conv_id END AS session_id, n AS n_events FROM f LEFT JOIN (SELECT session_id, count(*) AS n FROM v GROUP BY 1) ON session_id = 's' || conv_id""",
    "index_postings": f"""
        WITH {_INDEXED}, w AS (SELECT session_id, seq, {_WORDS.replace("{t}", "text")} AS term FROM v) SELECT session_id, seq, count(*) AS words, count(*) AS length FROM w GROUP BY 1, 2""",
    "index_stats": f"""
        WITH {_INDEXED}, f AS (SELECT DISTINCT conv_id, conv_id % 7 <> 0 AS good FROM c WHERE held), l AS (SELECT max(conv_id) AS last FROM f WHERE conv_id % 2 = 0),
        n AS (SELECT count(*) AS files, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM f), t AS (SELECT count(*) AS events FROM v)
        SELECT 0 AS run, files AS files_scanned, 0 AS files_indexed, good AS files_unchanged, 0 AS files_deleted, good AS sessions, events, bad AS warnings FROM n, t
        UNION ALL SELECT 1, files, good, 0, 0, good, events, bad FROM n, t
        UNION ALL SELECT 2, files - 1, 0, good - (last % 7 <> 0)::INT, (last % 7 <> 0)::INT, good - (last % 7 <> 0)::INT, events - (SELECT count(*) FROM v WHERE session_id = 's' || last), bad - (last % 7 = 0)::INT FROM n, t, l""",
    "bound_text": """
        WITH c AS (SELECT doc_id, strlen(text) > 1000 AS truncated, CASE WHEN strlen(text) > 1000
                          THEN left(text, list_max(list_filter(range(0, 983), lambda n: strlen(left(text, n)) <= 982))) || chr(10) || '[…truncated…]' ELSE text END AS t FROM documents)
        SELECT doc_id, sha256(t) AS sha, strlen(t)::BIGINT AS n_bytes, truncated FROM c""",
    "redact_text": f"WITH r AS (SELECT doc_id, {_redact('text', '/home/someone')} AS t FROM documents) SELECT doc_id, sha256(t) AS sha, length(t) AS n_chars_left FROM r",
    "redact_counts": f"""
        WITH r AS (SELECT source, {_redact('text')} AS t FROM documents)
        SELECT source, count(*) FILTER (contains(t, '[REDACTED:SECRET]')) AS secrets, count(*) FILTER (contains(t, '[REDACTED:')) AS any_kind, count(*) AS n FROM r GROUP BY 1""",
    "redact_synthetic": "SELECT doc_id, " + _redact("[" + ", ".join(f"'{p}'" for p in PLANTED) + "][doc_id % 8 + 1] || ' ' || lang") + " AS redacted FROM documents",
    "content_hash": "SELECT conv_id, turn, " + _HASH.format(role="role", kind="'response_message'", text="coalesce(text, '')") + " AS content_hash FROM conversations",
    "exact_dedup": "WITH h AS (SELECT source, doc_id, " + _HASH.format(role="'user'", kind="'user_message'", text="coalesce(text, '')") + " AS content_hash FROM documents) SELECT source, content_hash, min(doc_id) AS doc_id FROM h GROUP BY 1, 2",
    "repo_name": "SELECT page_id, list_filter(string_split(replace(url, '\\', '/'), '/'), lambda p: p <> '' AND p <> '~')[-1] AS repo FROM pages",
    "tokenize_query": "SELECT p_partkey, array_to_string(" + _TOKENS.replace("{t}", "p_name || ' ' || p_brand || ' ' || p_type") + ", ' ') AS normalized FROM part",
    "select_terms": "WITH t AS (SELECT item_id, list_filter(" + _TOKENS.replace("{t}", "text") + f", lambda w: (length(w) >= 2 OR regexp_full_match(w, '\\p{{N}}+')) AND NOT list_contains({_STOP}, w)) AS w FROM benchmark) SELECT item_id, array_to_string({_first('w', X.MAX_TERMS)}, ' ') AS terms FROM t",
    "hint_versions": f"SELECT doc_id, {_hints(X.VERSION, 'text', 1, X.MAX_HINTS)} AS versions FROM documents",
    "hint_commits": f"WITH r AS (SELECT doc_id, regexp_replace(text, {_quote(X.UUID.replace('(?iuU)', '(?i)'))}, repeat('~', 36), 'g') AS t FROM documents) SELECT doc_id, {_hints(X.COMMIT, 't', 0, X.MAX_HINTS, where='regexp_matches(v, ' + _quote('[a-fA-F]') + ')')} AS commits FROM r",
    "hint_prs": "WITH p AS (SELECT p_partkey, [regexp_extract(p_brand, '#(\\d+)', 1)::BIGINT, p_size::BIGINT, 7::BIGINT] AS n FROM part) SELECT p_partkey, array_to_string(" + _first("n", X.MAX_HINTS) + ", ',') AS prs FROM p",
    "hint_repos": """
        WITH p AS (SELECT page_id, url, regexp_extract_all(url, '(?i)\\b([a-z0-9_.-]{1,64})/([a-z0-9_.-]{2,100})\\b', 0) AS m FROM pages),
             h AS (SELECT page_id, list_concat(list_transform(m, lambda x: lower(regexp_replace(x, '\\.git$', ''))),
                     list_filter(regexp_extract_all(lower(url), '\\b[a-z0-9]+(?:-[a-z0-9]+){2,}(?:\\.git)?\\b', 0), lambda s: true)) AS n FROM p)
        SELECT page_id, array_to_string(""" + _first("n", X.MAX_REPO_HINTS) + ", ',') AS repos FROM h",
    "intent": "SELECT n_nationkey, q, intent FROM nation, (VALUES " + ", ".join(f"({_quote(q)}, '{i}')" for q, i in QUESTIONS) + ") v(q, intent)",
    "corpus_stats": f"WITH {_CORPUS} SELECT term, count(DISTINCT event_id) AS df, count(*) AS tf FROM w GROUP BY 1",
    "bm25_topk": f"WITH {_bm25(False)} SELECT event_id, score FROM s ORDER BY score DESC, event_id LIMIT 100",
    "bm25_fields": f"WITH {_bm25(True)} SELECT event_id, score FROM s ORDER BY score DESC, event_id LIMIT 100",
    "bm25_batch": f"""
        WITH w AS (SELECT doc_id, {_WORDS.replace("{t}", "coalesce(text, '')")} AS term FROM documents),
        l AS (SELECT documents.doc_id, count(term) AS dl FROM documents LEFT JOIN w USING (doc_id) GROUP BY 1),
        c AS (SELECT count(*) AS n, sum(dl) / count(*)::DOUBLE AS avgdl FROM l),
        b AS (SELECT item_id, list_filter({_WORDS.replace("{t}", "text")[7:-1]}, lambda w: (length(w) >= 2 OR regexp_full_match(w, '\\p{{N}}+')) AND NOT list_contains({_STOP}, w)) AS ws FROM benchmark),
        q AS (SELECT item_id, unnest({_first('ws', X.MAX_TERMS)}) AS term, generate_subscripts({_first('ws', X.MAX_TERMS)}, 1) AS pos FROM b),
        h AS (SELECT term, doc_id, count(*)::DOUBLE AS f FROM w WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
        d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
        i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM d, c),
        p AS (SELECT item_id, pos, doc_id, idf * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part FROM q JOIN h USING (term) JOIN i USING (term) JOIN l USING (doc_id), c),
        s AS (SELECT item_id, doc_id, round(list_sum(list(part ORDER BY pos)) * 1000000.0)::BIGINT AS score FROM p GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s)
        SELECT item_id, doc_id, score, place FROM r WHERE place <= 5""",
    "structured_boost": """
        WITH e AS (SELECT conv_id * 1000000 + turn AS event_id, conv_id, role, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM conversations)
        SELECT event_id, CASE WHEN contains(t, 'the') THEN 4000000 ELSE 0 END + CASE WHEN contains(t, '#1') OR contains(t, 'pr 1') THEN 4000000 ELSE 0 END + CASE WHEN contains(t, 'ing') THEN 3000000 ELSE 0 END
             + CASE WHEN contains(t, 'and') THEN 4000000 ELSE 0 END + CASE WHEN contains(t, 'zzz') THEN 4000000 ELSE 0 END + CASE WHEN conv_id = 1 THEN 6000000 ELSE 0 END
             + CASE role WHEN 'user' THEN 1500000 WHEN 'assistant' THEN 900000 ELSE 0 END AS boost FROM e""",
    "chronology_bonus": """
        WITH e AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS t FROM events)
        SELECT event_id, least(row_number() OVER (PARTITION BY user_id ORDER BY t ASC NULLS FIRST, event_id) - 1, 100) * 10 AS bonus FROM e""",
    "session_topk": f"WITH {_CANDIDATES} SELECT session_id, score FROM m",
    "evidence_packet": f"""
        WITH {_CANDIDATES},
        u AS (SELECT *, row_number() OVER (PARTITION BY root_id, content_hash ORDER BY score DESC, session_id, seq) AS copy FROM k WHERE session_id IN (SELECT session_id FROM m))
        SELECT session_id, root_id, role, {_redact('text')} AS text, 'codex://session/' || session_id || '#event-' || seq AS citation, 'logs/' || session_id || '.jsonl:' || (seq + 1) AS source, score
        FROM u WHERE copy = 1 ORDER BY score DESC, session_id, seq LIMIT 12""",
    "lineage": """
        WITH RECURSIVE s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN -c_custkey WHEN c_custkey % 11 = 2 AND c_custkey % 2 = 0 THEN c_custkey
                                        WHEN c_custkey % 11 = 5 THEN c_custkey + 1 ELSE c_custkey - 1 END AS p FROM customer),
        g AS (SELECT s.k, s.p, t.k IS NOT NULL AS held FROM s LEFT JOIN s t ON s.p = t.k),
        r AS (SELECT k, k AS here, 0 AS steps FROM g UNION ALL SELECT r.k, g.p, steps + 1 FROM r JOIN g ON r.here = g.k WHERE g.held AND steps < 24),
        z AS (SELECT k, max_by(here, steps) AS here FROM r GROUP BY 1)
        SELECT z.k::VARCHAR AS session_id, (CASE WHEN g.held THEN z.k WHEN g.p IS NULL THEN z.here ELSE g.p END)::VARCHAR AS root_id,
               CASE WHEN g.held THEN 'cycle' WHEN g.p IS NULL THEN 'complete' ELSE 'orphan' END AS provenance_status FROM z JOIN g ON z.here = g.k""",
    "incremental_diff": """
        SELECT doc_id::VARCHAR AS path, CASE doc_id % 10 WHEN 3 THEN 'new' WHEN 5 THEN 'deleted' WHEN 7 THEN 'changed' WHEN 8 THEN 'changed' ELSE 'unchanged' END AS status FROM documents""",
    "models_by_session": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS models FROM events GROUP BY 1",
    "markdown_lines": r"""
        WITH l AS (SELECT doc_id, lang, source, CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_transform(regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n')[:80], lambda s: '    ' || s) END AS x FROM documents)
        SELECT doc_id, len(x) AS n_lines, sha256(array_to_string(x, chr(10))) AS sha, lang || '  ' || source AS label FROM l""",
}
