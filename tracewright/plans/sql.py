"""The queries in DuckDB SQL."""

from __future__ import annotations

from tracewright.functions.text import ANSWER, AUDIT_STOP, CHANGE_WORDS, DEPLOYMENT_WORDS, RECENCY_WORDS, REFUSAL, RETRIEVAL_STOP, TEST_WORDS
from tracewright.plans import facts_sql
from tracewright.plans.queries import ANSWERS_FROM, KNOWN_BEFORE, RETAIN_FROM, SELECTED, SNAPSHOT_CUTOFF


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def words(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[a-zA-Z0-9_-]{{3,}}'), lambda x: lower(x)))"


def terms(text: str, stop: tuple[str, ...]) -> str:
    return f"list_filter({words(text)}, lambda x: NOT list_contains({listed(stop)}, x))"


def kind(text: str) -> str:
    return f"CASE WHEN list_has_any({words(text)}, {listed(DEPLOYMENT_WORDS)}) THEN 'deployment' WHEN list_has_any({words(text)}, {listed(TEST_WORDS)}) THEN 'test' ELSE 'repository_change' END"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


CH = """
paths AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
churns AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS commit_churn FROM lineitem GROUP BY l_orderkey),
ch0 AS (
  SELECT p.l_orderkey AS commit, concat_ws('/', p_brand, p_type, CAST(p_partkey AS VARCHAR)) AS path, o_orderdate AS authored_at, commit_churn
  FROM paths p JOIN churns c USING (l_orderkey) JOIN orders ON p.l_orderkey = o_orderkey JOIN part ON p.l_partkey = p_partkey
),
ch AS (SELECT *, greatest(1, commit_churn // count(*) OVER (PARTITION BY commit)) AS churn FROM ch0)"""
HS = (
    CH
    + """,
st AS (SELECT path, count(*) AS commit_count, CAST(sum(churn) AS BIGINT) AS churn FROM ch GROUP BY path),
hs AS (SELECT path, commit_count, churn, 0.7e0 * commit_count / (SELECT max(commit_count) FROM st) + 0.3e0 * churn / (SELECT max(churn) FROM st) AS score FROM st)"""
)


def pairs(rows: str) -> str:
    return f"""
cn AS (SELECT path, count(*) AS n FROM ({rows}) GROUP BY path),
pr AS (SELECT a.path AS left_path, b.path AS right_path, count(*) AS commit_count FROM ({rows}) a JOIN ({rows}) b ON a.commit = b.commit AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 2),
co AS (SELECT left_path, right_path, commit_count, commit_count / (l.n + r.n - commit_count) AS confidence FROM pr JOIN cn l ON l.path = left_path JOIN cn r ON r.path = right_path)"""


CO = pairs("SELECT DISTINCT l_orderkey AS commit, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS path FROM lineitem")
MODULES = f"""
md AS (
  SELECT p_brand AS module, count(*) + count(*) FILTER (WHERE p_partkey % 4 = 0) AS n_files, count(s.path) AS changed_files
  FROM part LEFT JOIN (SELECT DISTINCT path FROM ch) s ON s.path = concat_ws('/', p_brand, p_type, CAST(p_partkey AS VARCHAR))
  GROUP BY p_brand
)"""
CLAIMS = rf"""
rep AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND length(text) <= 100000),
raw AS (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(text, '\n$', ''), '[^\n.!?]+(?:[.!?]+|$)')) AS r, generate_subscripts(regexp_extract_all(regexp_replace(text, '\n$', ''), '[^\n.!?]+(?:[.!?]+|$)'), 1) AS i FROM rep),
cl0 AS (SELECT conv_id, turn, i, {strip("regexp_replace(" + strip("r") + ", '^[-*•]+', '')")} AS claim FROM raw),
cl1 AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS ordinal, claim FROM cl0 WHERE claim <> ''),
cl AS (SELECT * FROM cl1 WHERE ordinal < 100)"""


def lexical(queries: str, docs: str, stop: tuple[str, ...]) -> str:
    """hits (query_id, doc_id, score, rank) of queries and docs (id, text)."""
    return f"""
qt AS (SELECT query_id, greatest(1, len({terms("text", stop)})) AS nt, unnest({terms("text", stop)}) AS term FROM ({queries})),
dt AS (SELECT doc_id, unnest({terms("text", stop)}) AS term FROM ({docs})),
hits AS (SELECT query_id, doc_id, count(*) / any_value(nt) AS score FROM qt JOIN dt USING (term) GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits)"""


ASSESSED = (
    lexical("SELECT item_id AS query_id, text FROM benchmark", "SELECT doc_id, text FROM documents", AUDIT_STOP)
    + f""",
best AS (SELECT query_id, max(score) AS best, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY rank) AS found FROM ranked WHERE rank <= 5 GROUP BY query_id),
asd0 AS (SELECT item_id, text, {kind("text")} AS kind, coalesce(best, 0.0e0) AS best, found FROM benchmark LEFT JOIN best ON query_id = item_id),
asd AS (
  SELECT item_id, text, kind,
    CASE WHEN kind <> 'repository_change' THEN 'EXTERNAL_EVIDENCE_REQUIRED' WHEN best >= 0.6 THEN 'VERIFIED' WHEN best >= 0.25 THEN 'PARTIALLY_VERIFIED' ELSE 'NO_SUPPORTING_EVIDENCE' END AS status,
    CASE WHEN kind <> 'repository_change' THEN 1.0e0 ELSE best END AS confidence,
    CASE WHEN kind = 'deployment' THEN '' ELSE coalesce(found, '') END AS evidence
  FROM asd0
)"""
)
QUESTIONS = "SELECT conv_id AS query_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id"
RECENT = f"(list_has_any({terms('text', RETRIEVAL_STOP)}, {listed(RECENCY_WORDS)}) AND list_has_any({terms('text', RETRIEVAL_STOP)}, {listed(CHANGE_WORDS)}))"
# No question of the tables asks for recent changes of documents, which hold no commit: such a one would get the refusal.
GROUNDED = (
    lexical(f"SELECT * FROM ({QUESTIONS}) WHERE NOT {RECENT}", "SELECT doc_id, text FROM documents", RETRIEVAL_STOP)
    + f""",
picked AS (SELECT query_id, string_agg({strip("substr(text, 1, 220)")}, '; ' ORDER BY rank) AS facts, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY rank) AS evidence, count(*) AS n FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id),
ga AS (SELECT q.query_id AS conv_id, CASE WHEN n > 0 THEN '{ANSWER}' || facts ELSE '{REFUSAL}' END AS answer, coalesce(evidence, '') AS evidence, coalesce(n, 0) AS n FROM ({QUESTIONS}) q LEFT JOIN picked USING (query_id))"""
)
LINKS = r"""
pp0 AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) AS rest, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS hrefs FROM pages),
pp AS (
  SELECT host, host || '/' || CASE WHEN trim(rest, '/') = '' THEN 'index.ts' ELSE replace(trim(rest, '/'), '/', '~') END AS path,
    host || '/' || CASE WHEN regexp_extract(rest, '^/+([^/]*)', 1) = '' THEN 'index' ELSE regexp_extract(rest, '^/+([^/]*)', 1) END || '.ts' AS section, hrefs
  FROM pp0 WHERE host <> ''
),
fl AS (SELECT path FROM pp UNION SELECT section FROM pp),
im AS (SELECT host, path, replace(ltrim(unnest(hrefs), '/'), '/', '~') AS x FROM pp),
im2 AS (SELECT *, CASE WHEN x IN ('', '.') THEN host ELSE host || '/' || x END AS base, lower(regexp_extract(x, '^.+(\.[^.]+)$', 1)) AS suffix FROM im),
cand AS (
  SELECT DISTINCT base, suffix, host = base AS bare FROM im2
), tried AS (
  SELECT base, unnest(CASE WHEN bare THEN [base]
    WHEN suffix IN ('.js', '.jsx') THEN [base, regexp_replace(base, '\.[^./]+$', '') || '.ts', regexp_replace(base, '\.[^./]+$', '') || '.tsx']
    WHEN suffix = '' THEN [base, base || '.ts', base || '.tsx', base || '.js', base || '.jsx', base || '.mjs', base || '.cjs', base || '/index.ts', base || '/index.tsx', base || '/index.js', base || '/index.jsx']
    ELSE [base] END) AS c, generate_subscripts(CASE WHEN bare THEN [1] WHEN suffix IN ('.js', '.jsx') THEN [1, 2, 3] WHEN suffix = '' THEN [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] ELSE [1] END, 1) AS pos
  FROM cand
), res AS (SELECT base, arg_min(c, pos) AS resolved FROM tried JOIN fl ON c = path GROUP BY base),
lk AS (
  SELECT i.path, CASE WHEN resolved IS NOT NULL THEN 'resolved' WHEN suffix <> '' AND suffix NOT IN ('.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts') THEN 'asset' ELSE 'unresolved' END AS class, resolved, base
  FROM im2 i LEFT JOIN res USING (base)
),
nd AS (
  SELECT 'FILE' AS kind, path AS natural_key, 1 AS n_evidence FROM fl
  UNION ALL SELECT 'MODULE', 'asset:' || base, count(*) FROM lk WHERE class = 'asset' GROUP BY base
),
ed AS (SELECT DISTINCT 'IMPORTS' AS type, path AS from_key, CASE WHEN class = 'resolved' THEN resolved ELSE 'asset:' || base END AS to_key FROM lk WHERE class <> 'unresolved')"""
LATEST = "SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE {}) WHERE r = 1"



def retention(name: str, gone: bool) -> str:
    """Rows of each table whose report or answer is older than its cutoff, or is not."""
    old = f"o_orderdate {'<' if gone else '>='} TIMESTAMP '{RETAIN_FROM}'"
    answer = f"{'' if gone else 'NOT '}(a.ts < TIMESTAMP '{ANSWERS_FROM}')"
    lines = f"FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {old}"
    return f"""SELECT 'reports' AS "table", count(*) AS {name} FROM orders WHERE {old}
        UNION ALL SELECT 'claims', count(*) {lines} UNION ALL SELECT 'assessments', count(*) {lines} AND l_linenumber % 2 = 1
        UNION ALL SELECT 'unreported', count(*) FROM orders WHERE {old}
        UNION ALL SELECT 'answers', count(*) FROM events a WHERE event_id % 2 = 0 AND {answer}
        UNION ALL SELECT 'feedback', count(*) FROM events f JOIN events a ON a.event_id = f.event_id - 1 WHERE f.event_id % 2 = 1 AND {answer}"""


SQL: dict[str, str] = {
    "file_change_stats": f"WITH {HS} SELECT path, commit_count, churn FROM st",
    "hotspots": f"WITH {HS} SELECT * FROM hs",
    "co_change_pairs": f"WITH {CO} SELECT * FROM co",
    "co_change_pairs_parts": f"WITH {CH}, {pairs('SELECT commit, path FROM ch')} SELECT * FROM co",
    "module_candidates": f"""WITH {CH}, {MODULES} SELECT module, n_files, changed_files, 0.5e0 + 0.5e0 * changed_files / n_files AS confidence,
        'Inferred directory module containing ' || n_files || ' current files; ' || changed_files || ' have observed commit evidence.' AS description FROM md""",
    "risk_scores": f"""WITH {HS}, rk AS (SELECT path, score AS hotspot, commit_count / (SELECT max(commit_count) FROM hs) AS change_frequency, churn / (SELECT max(churn) FROM hs) AS relative_churn FROM hs)
        SELECT path, 0.55e0 * hotspot + 0.25e0 * change_frequency + 0.2e0 * relative_churn AS score, hotspot, change_frequency, relative_churn FROM rk""",
    "impact_all": f"""WITH {CO}, rel AS (SELECT left_path AS s, right_path AS t, confidence AS w FROM co UNION ALL SELECT right_path, left_path, confidence * 0.9e0 FROM co),
        agg AS (SELECT s AS selected_path, t AS path, round(least(1.0e0, sum(w)), 6) AS score, count(*) AS n_reasons FROM rel GROUP BY s, t),
        rk AS (SELECT *, row_number() OVER (PARTITION BY selected_path ORDER BY score DESC, path) AS rank FROM agg)
        SELECT selected_path, path, score, n_reasons, rank FROM rk WHERE rank <= 20""",
    "impact_selected": f"""WITH {CO}, nxt AS (SELECT a.s_suppkey AS s, min(b.s_suppkey) AS t FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY a.s_suppkey),
        rel AS (SELECT left_path AS s, right_path AS t, 'co change' AS k, confidence AS w FROM co UNION ALL SELECT lpad(CAST(s AS VARCHAR), 8, '0'), lpad(CAST(t AS VARCHAR), 8, '0'), 'imports', 1.0e0 FROM nxt),
        both_ways AS (SELECT s, t, k, w FROM rel UNION ALL SELECT t, s, k, w * 0.9e0 FROM rel),
        agg AS (SELECT t AS path, round(least(1.0e0, sum(w)), 6) AS score, string_agg(k, '|' ORDER BY w DESC, k) AS reasons FROM both_ways WHERE s = '{SELECTED}' GROUP BY t)
        SELECT path, score, reasons FROM agg ORDER BY score DESC, path LIMIT 20""",
    "score_eval": """WITH x AS (SELECT n_chars / (SELECT max(n_chars) FROM documents) AS s, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id)),
        e AS (SELECT avg((s - y) * (s - y)) AS model, avg(y) AS p FROM x)
        SELECT round(model, 9) AS model_brier, round(p * (1 - p), 9) AS constant_brier, model < p * (1 - p) AS useful FROM e""",
    "term_sets": f"SELECT item_id, len(t) AS n_terms, array_to_string(list_sort(t), '|') AS terms FROM (SELECT item_id, {terms('text', AUDIT_STOP)} AS t FROM benchmark)",
    "claim_split": f"WITH {CLAIMS} SELECT conv_id, turn, ordinal, claim, {kind('claim')} AS claim_type FROM cl",
    "claim_offsets": f"WITH {CLAIMS} SELECT conv_id, turn, ordinal, TRUE AS exact FROM cl",
    "claim_types": f"WITH {CLAIMS} SELECT {kind('claim')} AS claim_type, count(*) AS n FROM cl GROUP BY 1",
    "claim_assessment": f"WITH {ASSESSED} SELECT item_id, status, confidence, evidence FROM asd",
    "unreported_changes": f"""WITH {ASSESSED}, cited AS (SELECT DISTINCT CAST(unnest(string_split(evidence, '|')) AS BIGINT) AS doc_id FROM asd WHERE evidence <> ''),
        mx AS (SELECT source, max(n_chars) AS mx FROM documents GROUP BY source)
        SELECT d.source, d.doc_id, d.n_chars AS churn, d.n_chars / mx AS materiality FROM documents d JOIN mx USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM cited)""",
    "report_markdown": f"""WITH {ASSESSED} SELECT item_id, '# Delivery audit ' || item_id || chr(10) || chr(10) || '## Claims' || chr(10) || chr(10) || '### 1. ' || text || chr(10) || chr(10) || 'Status: ' || status || chr(10)
        || 'Confidence: ' || CAST(CAST(round(confidence, 2) AS DECIMAL(9, 2)) AS VARCHAR) || chr(10) || 'Evidence: ' || CASE WHEN evidence = '' THEN 'none' ELSE replace(evidence, '|', ', ') END || chr(10)
        || 'Limitations: ' || CASE WHEN kind = 'deployment' THEN 'No trusted deployment provider evidence was connected.' WHEN kind = 'test' THEN 'No trusted CI evidence was connected.'
             WHEN evidence = '' THEN 'The selected commit and file-change scope was searched.' ELSE 'none' END || chr(10) || chr(10) || '## Unreported changes' || chr(10) || chr(10)
        || CASE WHEN item_id % 2 = 0 THEN CASE WHEN item_id % 4 = 0 THEN '' ELSE '- `b/' || item_id || '` (0.75): no claim of the item names it' || chr(10) END || '- `a/' || item_id || '` (0.50): no claim of the item names it'
             || CASE WHEN item_id % 4 = 0 THEN chr(10) || '- `b/' || item_id || '` (0.25): no claim of the item names it' ELSE '' END ELSE '' END AS body FROM asd""",
    "grounded_answers": f"WITH {GROUNDED} SELECT conv_id, answer, evidence FROM ga",
    "recent_answers": f"""WITH nw AS (SELECT 'commit:' || o_orderkey AS doc_id, o_orderpriority || ' ' || o_orderstatus AS t, row_number() OVER (ORDER BY o_orderdate DESC, 'commit:' || o_orderkey) AS r FROM orders),
        five AS (SELECT string_agg({strip("t")}, '; ' ORDER BY r) AS facts, string_agg(doc_id, '|' ORDER BY r) AS evidence FROM nw WHERE r <= 5)
        SELECT DISTINCT o_orderpriority AS question_id, '{ANSWER}' || facts AS answer, evidence FROM orders, five""",
    "citation_check": f"WITH {GROUNDED} SELECT conv_id, n + conv_id % 2 AS n_cited, n > 0 AND conv_id % 2 = 0 AS valid FROM ga",
    "link_nodes": f"WITH {LINKS} SELECT kind, natural_key, n_evidence FROM nd",
    "link_edges": f"WITH {LINKS} SELECT type, from_key, to_key FROM ed",
    "link_diagnostics": f"WITH {LINKS} SELECT 'UNRESOLVED_IMPORT' AS code, path, count(*) AS n FROM lk WHERE class = 'unresolved' GROUP BY path",
    "graph_page": f"""WITH {LINKS}, pg AS (SELECT kind, natural_key AS node_key FROM nd WHERE kind > 'FILE' OR (kind = 'FILE' AND natural_key > 'm') ORDER BY kind, natural_key LIMIT 100),
        n AS (SELECT from_key, count(*) AS n FROM ed WHERE from_key IN (SELECT node_key FROM pg) AND to_key IN (SELECT node_key FROM pg) GROUP BY from_key)
        SELECT node_key, kind, coalesce(n, 0) AS n_edges FROM pg LEFT JOIN n ON from_key = node_key""",
    "graph_summary": f"WITH {LINKS} SELECT kind, count(*) AS n FROM nd GROUP BY kind",
    "evidence_lookup": "SELECT 'ev_' || substr(sha256(page_id || chr(31) || 'page'), 1, 24) AS evidence_id, page_id, url FROM pages WHERE page_id IN (3, 7, 11)",
    "latest_snapshot": LATEST.format("o_orderdate IS NOT NULL"),
    "snapshot_as_of": LATEST.format(f"o_orderdate <= TIMESTAMP '{SNAPSHOT_CUTOFF}'"),
    "inventory": """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT o_custkey, o_orderkey, rn, n > 5 AS truncated FROM r WHERE rn <= 5""",
    "architecture": f"""WITH {HS}, {CO}, {MODULES}, h AS (SELECT path AS key, score AS value FROM hs ORDER BY score DESC, path LIMIT 20), p AS (SELECT left_path || '|' || right_path AS key, confidence AS value FROM co ORDER BY value DESC, key LIMIT 100)
        SELECT 'hotspot' AS section, key, value, row_number() OVER (ORDER BY value DESC, key) AS rank FROM h
        UNION ALL SELECT 'pair', key, value, row_number() OVER (ORDER BY value DESC, key) FROM p
        UNION ALL SELECT 'module', module, 0.5e0 + 0.5e0 * changed_files / n_files, 0 FROM md""",
    "new_commits": f"SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{KNOWN_BEFORE}')",
    "ref_upsert": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type",
    "idempotent_writes": """WITH f AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_min(props, (ts, event_id)) AS p FROM events GROUP BY user_id, event_type)
        SELECT user_id, event_type, first_event_id, count(*) FILTER (WHERE props = p) - 1 AS n_replays, count(*) FILTER (WHERE props <> p) AS n_conflicts FROM events JOIN f USING (user_id, event_type) GROUP BY ALL""",
    "retention_preview": retention("n_rows", True),
    "retention_purge": retention("n_remaining", False),
    "audit_export": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '''=' || event_type ELSE event_type END AS cell FROM events ORDER BY ts DESC, event_id LIMIT 10000",
    "tenant_visibility": "SELECT c_custkey, count(*) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY c_custkey",
    "run_ledger": """SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'F' ELSE arg_max(o_orderstatus, o_orderkey) END AS state,
        coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), max(o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""",
    "feedback_latest": """WITH r AS (SELECT event_type AS answer_id, user_id, event_id % 4 - 1 AS rating, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id % 4 DESC) AS r FROM events WHERE event_type <> 'error' AND event_id % 4 < 3)
        SELECT answer_id, user_id, rating FROM r WHERE r = 1""",
    "stable_ids": "SELECT p_partkey, 'node_' || substr(sha256('repo' || chr(31) || 'FILE' || chr(31) || p_brand || chr(31) || p_partkey), 1, 24) AS id FROM part",
    "stream_commit_dedup": "SELECT DISTINCT o_orderkey, o_custkey FROM orders",
    "stream_ref_upsert": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type",
}
SQL["stream_first_writes"] = SQL["idempotent_writes"]
SQL |= facts_sql.SQL | {"stream_admissions": facts_sql.LIMITER, "report_view": facts_sql.report_view(CLAIMS, kind("claim")), "limiter_admit": facts_sql.LIMITER}
