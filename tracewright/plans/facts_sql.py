"""The queries of facts.py in DuckDB SQL."""

from __future__ import annotations

from tracewright.plans.facts import PAGE_NODES, PASSED, SCOPE_FROM, SELECTED, SMALL


def node_id(kind: str, key: str) -> str:
    return f"'node_' || substr(sha256('r' || chr(31) || 's' || chr(31) || '{kind}' || chr(31) || {key}), 1, 24)"


STRUCTURE = """
p AS (SELECT p_partkey AS k, p_brand AS brand, p_size AS n, p_brand || '/' || p_partkey || '.ts' AS path, 's' || p_size AS symbol FROM part),
sy AS (SELECT path, path || '#function:' || symbol || ':' || n || ':0' AS key, n FROM p),
im0 AS (SELECT a.k, a.brand, a.path, a.n, b.path AS sibling FROM p a LEFT JOIN p b ON b.k = a.k + 1),
im AS (
  SELECT path, n, CASE WHEN k % 4 = 0 OR (k % 4 = 3 AND sibling IS NULL) THEN 'unresolved' WHEN k % 4 = 1 THEN 'external' WHEN k % 4 = 2 THEN 'asset' ELSE 'resolved' END AS class,
    CASE WHEN k % 4 = 1 THEN 'external:lib' || n WHEN k % 4 = 2 THEN 'asset:' || brand || '/style.css' WHEN k % 4 = 3 THEN sibling END AS to_key FROM im0
),
nodes AS (
  SELECT 'FILE' AS kind, path AS natural_key, 1 AS n_evidence FROM p
  UNION ALL SELECT 'SYMBOL', key, 1 FROM sy
  UNION ALL SELECT 'MODULE', to_key, count(DISTINCT (path, n)) FROM im WHERE class IN ('asset', 'external') GROUP BY to_key
),
edges AS (
  SELECT 'DECLARES' AS kind, path AS from_key, key AS to_key FROM sy
  UNION ALL SELECT 'EXPORTS', path, key FROM sy WHERE n % 2 = 0
  UNION ALL SELECT DISTINCT 'IMPORTS', path, to_key FROM im WHERE to_key IS NOT NULL
)"""


def evidence_id(path: str, n: str, kind: str) -> str:
    """The id of a range that begins on line n, as the facts have it."""
    span = f"'SourceSpan(start_line=' || {n} || ', start_column=0, end_line=' || ({n} + 1) || ', end_column=1)'"
    return f"'ev_' || substr(sha256('r' || chr(31) || 's' || chr(31) || {path} || chr(31) || {span} || chr(31) || '{kind}'), 1, 24)"


def edge(kind: str, source: str, target: str, evidence: str, rows: str) -> str:
    return f"""SELECT '{kind}', 'edge_' || substr(sha256('r' || chr(31) || 's' || chr(31) || '{kind}' || chr(31) || {source} || chr(31) || {target}), 1, 24), {source} || '>' || {target}, {evidence} FROM {rows}"""


#: kind, id, about, evidence of nodes and edges. A module's properties are those of the importer that comes last by path.
FACTS = f"""
fx AS (SELECT *, {node_id("FILE", "path")} AS file_id, path || '#function:' || symbol || ':' || n || ':0' AS key FROM p),
mx AS (SELECT i.*, CASE WHEN class = 'external' THEN 'lib' || n ELSE './style.css' END AS specifier FROM im i WHERE class IN ('external', 'asset')),
facts AS (
  SELECT 'FILE' AS kind, file_id AS id, '{{"language":"typescript","content_sha256":"' || sha256(path) || '","parse_status":"' || CASE WHEN n = 1 THEN 'PARTIAL' ELSE 'COMPLETE' END || '"}}' AS about,
    'ev_' || substr(sha256('r' || chr(31) || 's' || chr(31) || path || chr(31) || sha256(path) || chr(31) || 'file'), 1, 24) AS evidence FROM fx
  UNION ALL SELECT 'SYMBOL', {node_id("SYMBOL", "key")}, '{{"name":"' || symbol || '","symbol_kind":"function","exported":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"path":"' || path
    || '","span":{{"start_line":' || n || ',"start_column":0,"end_line":' || (n + 1) || ',"end_column":1}}}}', {evidence_id("path", "n", "symbol")} FROM fx
  UNION ALL SELECT 'MODULE', {node_id("MODULE", "to_key")}, '{{"specifier":"' || arg_max(specifier, path) || '","external":' || CASE WHEN arg_max(class, path) = 'external' THEN 'true}}' ELSE 'false,"asset":true}}' END,
    string_agg({evidence_id("path", "n", "import")}, '|' ORDER BY {evidence_id("path", "n", "import")}) FROM mx GROUP BY to_key
  UNION ALL {edge("DECLARES", "file_id", node_id("SYMBOL", "key"), evidence_id("path", "n", "symbol"), "fx")}
  UNION ALL {edge("EXPORTS", "file_id", node_id("SYMBOL", "key"), evidence_id("path", "n", "export"), "fx WHERE n % 2 = 0")}
  UNION ALL {edge("IMPORTS", node_id("FILE", "path"), node_id("MODULE", "to_key"), evidence_id("path", "n", "import"), "mx")}
  UNION ALL {edge("IMPORTS", node_id("FILE", "path"), node_id("FILE", "to_key"), evidence_id("path", "n", "import"), "im WHERE class = 'resolved'")}
)"""
HISTORY = """
h AS (SELECT DISTINCT l_orderkey AS commit, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS path, o_orderdate AS made FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pe AS (
  SELECT a.path AS left_path, b.path AS right_path, count(*) AS commit_count, list(a.commit ORDER BY a.made, a.commit)[1:20] AS evidence
  FROM h a JOIN h b ON a.commit = b.commit AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 2
)"""
MANIFEST = """
mf AS (
  SELECT p_brand, 'src/' || p_partkey || ['.ts', '.md', '.JS', '.py', '.tsx'][CAST(p_partkey % 5 AS INTEGER) + 1] AS path, p_partkey % 11 = 0 AS link, p_partkey % 5 IN (0, 2, 4) AS code, CAST(p_size AS BIGINT) * 40000 AS size FROM part
)"""

SQL: dict[str, str] = {
    "structural_nodes": f"""WITH {STRUCTURE} SELECT CASE kind WHEN 'FILE' THEN {node_id("FILE", "natural_key")} WHEN 'SYMBOL' THEN {node_id("SYMBOL", "natural_key")} ELSE {node_id("MODULE", "natural_key")} END AS node_id, kind, natural_key, n_evidence FROM nodes""",
    "structural_facts": f"WITH {STRUCTURE}, {FACTS} SELECT * FROM facts",
    "node_evidence": f"""WITH {STRUCTURE}, {FACTS} SELECT kind, id AS node_id, CAST(len(string_split(evidence, '|')) AS BIGINT) AS n_evidence, array_to_string(string_split(evidence, '|')[1:3], '|') AS first_evidence
        FROM facts WHERE kind IN ('FILE', 'SYMBOL', 'MODULE')""",
    "source_imports": """WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), m AS (SELECT unnest(['./' || host, './part' || (page_id % 50)]) AS module FROM h WHERE host <> '')
        SELECT module, count(*) AS n FROM m GROUP BY module""",
    "structural_edges": f"WITH {STRUCTURE} SELECT kind, from_key, to_key, 1.0e0 AS confidence FROM edges",
    # A file's evidence; the spans of its symbol, of its export, of its import and of its diagnostic.
    "structural_evidence": f"""WITH {STRUCTURE} SELECT 'source_file' AS kind, count(*) AS n FROM p
        UNION ALL SELECT 'source_range', 2 * count(*) + count(*) FILTER (WHERE n % 2 = 0) + count(*) FILTER (WHERE n = 1) FROM p""",
    "structural_diagnostics": f"""WITH {STRUCTURE} SELECT 'SYNTAX' AS code, path, 'line ' || n AS message FROM p WHERE n = 1
        UNION ALL SELECT 'UNRESOLVED_IMPORT', path, 'Relative import could not be resolved: ./missing' FROM im WHERE class = 'unresolved'""",
    "import_relations": f"WITH {STRUCTURE} SELECT path AS source, to_key AS target, 1.0e0 AS weight, 'evidence:' || {evidence_id('path', 'n', 'import')} AS evidence FROM im WHERE class = 'resolved'",
    "structural_page": f"""WITH {STRUCTURE}, pg AS (SELECT kind, natural_key AS node_key FROM nodes ORDER BY kind, natural_key LIMIT 1000),
        n AS (SELECT from_key, count(*) AS n FROM edges WHERE kind = 'IMPORTS' AND from_key IN (SELECT node_key FROM pg) AND to_key IN (SELECT node_key FROM pg) GROUP BY from_key)
        SELECT node_key, kind, coalesce(n, 0) AS n_edges FROM pg LEFT JOIN n ON from_key = node_key""",
    "stored_pages": f"""WITH {STRUCTURE}, r AS (SELECT kind, natural_key, row_number() OVER (ORDER BY kind, natural_key) - 1 AS r FROM nodes)
        SELECT kind, natural_key, r // {PAGE_NODES} AS page FROM r WHERE r < 2 * {PAGE_NODES} UNION ALL SELECT kind, natural_key, 2 FROM r WHERE r >= {PASSED} AND r < {PASSED} + {PAGE_NODES}""",
    "observed_counts": f"""WITH {MANIFEST} SELECT 'orders' AS what, count(*) AS n, CAST(0 AS BIGINT) AS bytes, count(*) > 1000 AS over FROM orders
        UNION ALL SELECT 'customer', count(*), 0, count(*) > 1000 FROM customer UNION ALL SELECT 'nation', count(*), 0, count(*) > 1000 FROM nation
        UNION ALL SELECT 'manifest', count(*), CAST(sum(size) AS BIGINT), sum(size) > 100000000 FROM mf""",
    "file_evidence": f"WITH {HISTORY} SELECT path, array_to_string(list(commit ORDER BY made, commit)[1:20], '|') AS evidence FROM h GROUP BY path",
    "pair_evidence": f"WITH {HISTORY} SELECT left_path, right_path, commit_count, array_to_string(evidence, '|') AS evidence FROM pe",
    "module_evidence": """WITH c AS (SELECT DISTINCT p_brand AS module, p_brand || '/' || p_type || '/' || p_partkey AS path, o_orderdate AS made, o_orderkey AS commit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
        f AS (SELECT module, commit, min(row(path, made, commit)) AS first FROM c GROUP BY module, commit)
        SELECT module, array_to_string(list(commit ORDER BY first)[1:20], '|') AS evidence FROM f GROUP BY module""",
    "impact_evidence": f"""WITH {HISTORY}, cn AS (SELECT path, count(*) AS n FROM h GROUP BY path),
        nxt AS (SELECT a.s_suppkey AS s, min(b.s_suppkey) AS t FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY a.s_suppkey),
        rel AS (
          SELECT left_path AS s, right_path AS t, 1 AS k, commit_count / (l.n + r.n - commit_count) AS w, array_to_string(list_transform(evidence, lambda c: 'commit:' || c), '|') AS ev FROM pe JOIN cn l ON l.path = left_path JOIN cn r ON r.path = right_path
          UNION ALL SELECT lpad(CAST(s AS VARCHAR), 8, '0'), lpad(CAST(t AS VARCHAR), 8, '0'), 2, 1.0e0, 'import:' || lpad(CAST(s AS VARCHAR), 8, '0') FROM nxt
        ), both_ways AS (SELECT * FROM rel UNION ALL SELECT t, s, k, w * 0.9e0, ev FROM rel)
        SELECT t AS path, round(least(1.0e0, sum(w)), 6) AS score, string_agg(ev, '|' ORDER BY k) AS evidence FROM both_ways WHERE s = '{SELECTED}' GROUP BY t ORDER BY score DESC, path LIMIT 20""",
    "scoped_changes": f"""WITH o AS (SELECT c_nationkey AS r, o_orderkey AS commit, o_orderpriority AS path, o_orderdate AS made, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey),
        s AS (SELECT 'rep' || r AS report_id, * FROM o
              WHERE made BETWEEN TIMESTAMP '{SCOPE_FROM}' AND TIMESTAMP '{SCOPE_FROM}' + to_days(CAST(r * 30 + 824 AS INTEGER)))
        SELECT report_id, 'change:' || commit || ':' || path AS doc_id, path || ' ' || CASE WHEN commit % 3 <> 0 THEN 'status ' || o_orderstatus ELSE '' END AS text FROM s""",
    "commit_churn": """WITH f AS (SELECT l_orderkey AS c, count(DISTINCT l_partkey) AS n_files, sum(CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS churn FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey AS commit, coalesce(n_files, 0) AS n_files, CAST(coalesce(churn, 0) AS BIGINT) AS churn FROM orders LEFT JOIN f ON c = o_orderkey WHERE o_orderkey % 7 <> 0""",
    "snapshot_newest": "SELECT p_partkey, p_size FROM part",
    "snapshot_by_sha": f"SELECT p_partkey, p_size FROM part WHERE p_size <= {SMALL}",
    "retrieval_documents": f"""WITH {HISTORY} SELECT 'module:' || n_name AS doc_id, 'module' AS kind, 'Module ' || n_name || ': region ' || n_regionkey AS text FROM nation
        UNION ALL SELECT 'hotspot:' || path, 'hotspot', 'File ' || path || ' is a relative hotspot with ' || count(*) || ' commits.' FROM h GROUP BY path
        UNION ALL SELECT * FROM (SELECT 'commit:' || o_orderkey, 'commit', o_orderpriority || ' ' || o_orderstatus FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 200)""",
    "source_selection": f"WITH {MANIFEST} SELECT path, CASE WHEN link OR NOT code THEN 'other' WHEN size <= 1000000 THEN 'candidate' ELSE 'skipped' END AS state, code AND NOT link AND size <= 1000000 AS analyzed FROM mf",
    "volume_guard": f"WITH {MANIFEST} SELECT p_brand, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, count(*) > 10000 OR sum(size) > 85000000 AS over FROM mf GROUP BY p_brand",
    "commit_dump": """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'rejected' ELSE sha1(CAST(o_orderkey AS VARCHAR)) END AS commit, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS n_parents,
        CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'An Author' END AS author, CASE WHEN o_orderkey % 10 = 0 THEN sha1(CAST(o_orderkey AS VARCHAR)) ELSE 'Message ' || o_orderkey END AS message FROM orders""",
    "manifest_rows": """SELECT 'src/' || p_partkey AS path, sha1(CAST(p_partkey AS VARCHAR)) AS blob_sha, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 9 <> 0
        UNION ALL SELECT '100644 ' || CASE WHEN p_partkey % 9 = 0 THEN 'tree' ELSE 'blob' END || ' zz    ' || CASE WHEN p_partkey % 9 = 0 THEN '-' ELSE CAST(p_size AS VARCHAR) END || chr(9) || 'src/' || p_partkey, 'rejected', 0 FROM part WHERE p_partkey % 10 = 0""",
    "ref_rows": """SELECT 'feature/' || c_custkey AS name, sha1(CAST(c_custkey AS VARCHAR)) AS head_sha FROM customer WHERE c_custkey % 6 <> 0
        UNION ALL SELECT 'rejected', sha1(CAST(c_custkey AS VARCHAR)) || ' bad..name' || c_custkey FROM customer WHERE c_custkey % 6 = 0""",
    "part_functions": """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS fingerprint, base64(encode(CAST(p_partkey AS VARCHAR))) AS cursor, p_partkey AS decoded,
        CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'javascript' WHEN 2 THEN 'tsx' END AS language,
        CASE WHEN p_partkey % 3 < 2 THEN 'https://example.org/' || replace(p_brand, '#', '') || '/n' || p_partkey || '.git' END AS repository,
        ' token [REDACTED] of ' || p_partkey AS redacted FROM part""",
    "newest_orders": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'",
}


def report_view(claims: str, kind: str) -> str:
    """claims: the common tables that end in cl (conv_id, turn, ordinal, claim)."""
    return f"""WITH {claims} SELECT conv_id, turn, ordinal, CASE WHEN ordinal % 2 = 0 THEN 'AS_' || ({kind}) END AS status, max(ordinal) OVER (PARTITION BY conv_id, turn) > 0 AS pending FROM cl"""


#: Which events of a user are admitted, one in any hour: from each event on, the next that is an hour later.
LIMITER = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
        nx AS (SELECT user_id, r, min(r) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e),
        ok AS (SELECT user_id, r FROM e WHERE r = 1 UNION ALL SELECT nx.user_id, nx.later FROM ok JOIN nx ON ok.user_id = nx.user_id AND ok.r = nx.r WHERE nx.later IS NOT NULL)
        SELECT e.user_id, event_id, ok.r IS NOT NULL AS admitted FROM e LEFT JOIN ok ON e.user_id = ok.user_id AND e.r = ok.r"""
