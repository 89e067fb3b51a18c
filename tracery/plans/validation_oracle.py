"""DuckDB SQL that gives the rows of plans/validation.py: what each variant must give, written down case by case."""

from __future__ import annotations

from .oracle_parts import PATHS

NOTE_PATH = "'docs/adr/20240229-p' || p_partkey || '.md'"
NOTE_LOCAL = f"""SELECT 'error' AS severity, 'document-format' AS code, {NOTE_PATH} AS path FROM part WHERE p_partkey % 8 = 1
 UNION ALL SELECT 'error', 'missing-id', 'docs/n' || p_partkey || '.md' FROM part WHERE p_partkey % 8 = 2
 UNION ALL SELECT 'error', 'invalid-kind', 'docs/n' || p_partkey || '.md' FROM part WHERE p_partkey % 8 = 3
 UNION ALL SELECT 'error', 'invalid-frontmatter', {NOTE_PATH} FROM part WHERE p_partkey % 8 = 4
 UNION ALL SELECT 'error', 'decision-location', 'docs/20240229-p' || p_partkey || '.md' FROM part WHERE p_partkey % 8 = 5
 UNION ALL SELECT 'error', 'adr-filename', 'docs/adr/other-' || p_partkey || '.md' FROM part WHERE p_partkey % 8 = 6
 UNION ALL SELECT 'error', 'invalid-adr-id', {NOTE_PATH} FROM part WHERE p_partkey % 8 = 7"""
DUPLICATES = f"SELECT 'error' AS severity, 'duplicate-id' AS code, {NOTE_PATH} AS path FROM part WHERE p_partkey % 8 = 7 AND (SELECT count(*) FROM part WHERE p_partkey % 8 = 7) > 1"
LINKS = """SELECT CASE p_partkey % 5 WHEN 1 THEN 'warning' ELSE 'error' END AS severity, CASE p_partkey % 5 WHEN 0 THEN 'broken-link' WHEN 1 THEN 'source-wikilink' ELSE 'non-portable-note-link' END AS code, p_brand AS path, p_partkey AS line
 FROM part WHERE p_partkey % 5 IN (0, 1, 3) UNION ALL SELECT 'warning', 'ambiguous-source-link', p_brand, p_partkey FROM part WHERE p_partkey % 5 IN (1, 2) AND p_size > 25"""
TARGETS = """SELECT 'error' AS severity, 'invalid-glob' AS code, p_brand AS path, p_partkey AS line FROM part WHERE p_size % 5 = 0
 UNION ALL SELECT 'warning', 'legacy-source-target', p_brand, p_partkey FROM part WHERE p_size % 5 > 0 AND p_size % 3 = 0
 UNION ALL SELECT CASE p_partkey % 4 WHEN 1 THEN 'warning' ELSE 'error' END, CASE p_partkey % 4 WHEN 0 THEN 'unresolved-target' WHEN 1 THEN 'empty-target-scope' WHEN 2 THEN 'unresolved-pattern' ELSE 'unresolved-governs' END, p_brand, p_partkey
 FROM part WHERE p_size % 5 > 0 AND p_size % 2 = 1"""
RING = """ring AS (SELECT CAST(k AS INT) AS k, CAST(CASE WHEN b < 10 THEN b + (a + 1) % 5 WHEN a < 4 THEN k + 1 WHEN b = 10 THEN 99 END AS INT) AS f,
 CAST(CASE WHEN b < 10 THEN b + (a + 4) % 5 WHEN a > 0 AND k % 3 > 0 THEN k - 1 WHEN b = 15 THEN 77 END AS INT) AS p FROM (SELECT n_nationkey AS k, n_nationkey // 5 * 5 AS b, n_nationkey % 5 AS a FROM nation))"""
SUPERSESSION = f"""WITH {RING} SELECT 'unknown-supersedes' AS code, 'd/' || k AS path, 'unknown decision: D' || f AS message FROM ring WHERE f > 24
 UNION ALL SELECT 'unknown-superseded-by', 'd/' || k, 'unknown decision: D' || p FROM ring WHERE p > 24
 UNION ALL SELECT 'inconsistent-supersession', 'd/' || r.k, 'D' || r.k || ' and D' || r.f || ' do not name each other' FROM ring r JOIN ring o ON o.k = r.f WHERE o.p IS DISTINCT FROM r.k
 UNION ALL SELECT 'inconsistent-supersession', 'd/' || r.k, 'D' || r.k || ' and D' || r.p || ' do not name each other' FROM ring r JOIN ring o ON o.k = r.p WHERE o.f IS DISTINCT FROM r.k
 UNION ALL SELECT 'supersession-cycle', 'd/' || k, (SELECT string_agg('D' || (k // 5 * 5 + (k % 5 + i) % 5), ' -> ' ORDER BY i) FROM range(5) t(i)) FROM ring WHERE k < 10"""
DECLARED = """SELECT p_brand AS path, p_partkey AS line, CASE p_partkey % 7 WHEN 1 THEN 'missing-policy-pattern-id' WHEN 2 THEN 'missing-policy-pattern-definition' WHEN 3 THEN 'missing-policy-pattern-language'
 WHEN 4 THEN 'missing-policy-pattern-body' WHEN 5 THEN 'ambiguous-policy-pattern-body' ELSE 'empty-policy-pattern' END AS code FROM part WHERE p_partkey % 7 > 0"""
FOUND = """found AS (SELECT f.id, f.decision, 'src/' || p_partkey AS path, f.line, CASE WHEN f.line = 2 THEN 'L2:C3-L2:C' || (3 + length(w)) ELSE f.place END AS range, coalesce(f.text, w) AS text, replace(f.captures, '@', '"' || p_name || '"') AS captures
 FROM (SELECT *, 'log("' || p_name || '", x + 1)' AS w FROM part) JOIN (VALUES
 ('p1', 'd1', 2, NULL, NULL, 'ARGS=@' || chr(10) || ',' || chr(10) || 'x + 1'), ('p1', 'd1', 4, 'L4:C11-L4:C16', 'log()', 'ARGS='), ('p1', 'd1', 4, 'L4:C23-L4:C32', 'log(y, z)', 'ARGS=y' || chr(10) || ',' || chr(10) || 'z'),
 ('p2', 'd1', 4, 'L4:C18-L4:C33', 'drop(log(y, z))', 'X=log(y, z)'), ('p3', 'd2', 2, NULL, NULL, 'A=@;B=x + 1'), ('p3', 'd2', 4, 'L4:C23-L4:C32', 'log(y, z)', 'A=y;B=z'),
 ('p5', 'd2', 2, NULL, NULL, 'A=@' || chr(10) || ',' || chr(10) || 'x + 1'), ('p5', 'd2', 4, 'L4:C23-L4:C32', 'log(y, z)', 'A=y' || chr(10) || ',' || chr(10) || 'z')
 ) f(id, decision, line, place, text, captures) ON CASE f.decision WHEN 'd1' THEN p_partkey % 2 = 0 AND p_size % 3 = 0 ELSE p_partkey % 2 = 1 AND p_size % 3 <> 1 END
 WHERE NOT (f.id = 'p5' AND f.line = 2 AND contains(p_name, 'red')))"""
#: The same after names were edited in one file of a hundred, and p3 asks for drop($X).
EDITED = FOUND.replace("FROM part)", "FROM (SELECT * REPLACE (CASE WHEN p_partkey % 101 = 1 THEN 'changed' ELSE p_name END AS p_name) FROM part))")
EDITED = EDITED.replace("('p3', 'd2', 2, NULL, NULL, 'A=@;B=x + 1'), ('p3', 'd2', 4, 'L4:C23-L4:C32', 'log(y, z)', 'A=y;B=z')", "('p3', 'd2', 4, 'L4:C18-L4:C33', 'drop(log(y, z))', 'X=log(y, z)')")
SITES = """s AS (SELECT event_id AS id, user_id, event_id AS line FROM events WHERE event_type = 'purchase'), d AS (SELECT user_id, event_id AS d FROM events WHERE event_type = 'signup'),
 a AS (SELECT s.id, d.d FROM s JOIN d ON d.user_id = s.user_id AND d.d < s.line AND s.line <= d.d + 8000)"""


def _field(x: str) -> str:
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


SQL = {
    "note_rules": f"{NOTE_LOCAL} UNION ALL {DUPLICATES}", "link_rules": LINKS, "target_rules": TARGETS, "supersession_rules": SUPERSESSION, "policy_declarations": f"SELECT line, code FROM ({DECLARED})",
    "immutable_decisions": """SELECT 'adr-immutability-violation' AS code, CASE WHEN p_size % 4 = 0 THEN 'src/' ELSE 'docs/adr/' END || p_partkey || '.md' AS path FROM part
 WHERE (p_size % 4 > 0 OR p_size = 7) AND p_partkey % 3 > 0 AND p_partkey % 5 > 0""",
    "scope_moves": "SELECT 'decision-scope-move' AS code, 'conf.toml' AS path",
    "full_scan": "SELECT p_brand, bool_or(p_size = 1 OR starts_with(p_name, 'red')) AS \"full\" FROM part GROUP BY 1",
    "diagnostic_order": """SELECT lower(p_type) AS code, p_brand AS path, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS BIGINT) END AS line, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS message FROM part
 ORDER BY path, coalesce(line, 0), code, message LIMIT 100""",
    "publication_gate": "SELECT p_brand AS path, p_partkey AS line FROM part WHERE p_partkey % 2 = 1",
    "reconciliation": """SELECT CAST(p_partkey AS VARCHAR) AS value, CASE p_partkey % 4 WHEN 0 THEN 'renamed' WHEN 1 THEN 'deleted' WHEN 2 THEN 'copied' ELSE 'unresolved' END AS outcome,
 CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey + 1000000 AS VARCHAR) END AS path FROM part""",
    "receipt_proof": """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 3 = 0 THEN 'not in the receipt' WHEN p_partkey % 4 = 0 THEN 'not staged' ELSE 'other contents' END AS reason FROM part
 WHERE (p_partkey % 3 = 0) <> (p_partkey % 4 = 0) OR p_partkey % 3 > 0 AND p_partkey % 4 > 0 AND p_size % 6 = 0""",
    "rename_conflicts": """WITH r AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R') SELECT 'supplier:' || l_suppkey AS path, 'left twice' AS reason FROM r GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1
 UNION ALL SELECT 'part:' || l_partkey, 'reached twice' FROM r GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""",
    "scope_active": f"WITH {SITES} SELECT id, d AS d_line FROM a",
    "alias_expansion": """WITH RECURSIVE s AS (SELECT event_id AS id, user_id, event_id AS line, 'A' || (event_id % 3) || '.f' AS module FROM events WHERE event_type = 'purchase'),
 d AS (SELECT user_id, event_id AS d, 'A' || (event_id % 3) AS alias, 'A' || ((event_id + 1) % 3) || '.x' AS target FROM events WHERE event_type = 'signup'),
 r(id, user_id, line, module, step) AS (SELECT id, user_id, line, module, 0 FROM s UNION ALL SELECT id, user_id, d, target || regexp_replace(module, '^[^.]*', ''), step + 1 FROM
  (SELECT r.*, d.d, d.target, row_number() OVER (PARTITION BY r.id ORDER BY d.d DESC) AS n FROM r JOIN d ON d.user_id = r.user_id AND d.d < r.line AND r.line <= d.d + 8000 AND d.alias = split_part(r.module, '.', 1) WHERE r.step < 16) WHERE n = 1)
 SELECT id, arg_max(module, step) AS module FROM r GROUP BY id""",
    "visible_imports": f"""WITH {SITES}, m AS (SELECT id, 'M' || (d % 2) AS module, max(d) AS last, coalesce(max(d) FILTER (d % 3 = 2), -1) AS cut FROM a GROUP BY 1, 2),
 c AS (SELECT 'C' || n_nationkey AS cid, 'M' || (n_nationkey % 2) AS module, n_nationkey % 4 = 0 AS macro, CASE WHEN n_nationkey < 10 THEN 'f' ELSE 'g' END || (n_nationkey % 3) || '/' || (n_nationkey % 2) AS who FROM nation),
 x AS (SELECT m.id, c.cid FROM m JOIN c ON c.module = m.module AND c.who = 'f' || (m.id % 3) || '/' || (m.id % 2) WHERE (last % 5 > 0 OR who IN ('f1/1', 'f2/0')) AND (last % 11 > 0 OR macro)
  AND NOT EXISTS (SELECT 1 FROM a WHERE a.id = m.id AND 'M' || (a.d % 2) = m.module AND a.d > m.cut AND who = CASE a.d % 3 WHEN 0 THEN 'f0/0' WHEN 1 THEN 'f1/1' END))
 SELECT s.id, CASE WHEN count(DISTINCT cid) = 1 THEN min(cid) END AS target FROM s LEFT JOIN x ON x.id = s.id GROUP BY s.id""",
    "notes_parsed": """SELECT p_partkey || '.md' AS path, 'N' || p_partkey AS id, 'decision' AS kind, 'src/**;7' AS governs, '1:' || p_name || ':6;2:Context:13' AS headings,
 'source:' || p_brand || '#L3|x:8;N' || p_partkey || ':16' AS links FROM part""",
    "line_fragments": "SELECT p_partkey, p_partkey % 9 IN (0, 2, 3, 7) AS lines FROM part",
    "selector_codec": """SELECT p_partkey, 'module:' || replace(p_name, ' ', '%20') || '/function:' || replace(p_brand, '#', '%23') || '/' || p_size AS selector, p_name AS module, p_brand AS name, CAST(p_size AS BIGINT) AS arity FROM part""",
    "callable_aliases": """SELECT p_partkey, p_name || ',' || p_name || '/' || p_size || CASE WHEN p_size % 2 = 0 THEN ',' || p_brand || '.' || p_name || '/' || p_size ELSE '' END AS aliases,
 CASE p_partkey % 4 WHEN 0 THEN 'fn:' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'type:' || p_brand || '/' ELSE '' END || 'member:' WHEN 2 THEN 'type:' ELSE 'macro:' END || p_name AS selector FROM part""",
    "node_identities": """SELECT p_partkey, 'note:' || p_brand || '#' || regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS heading, 'import:' || p_brand || ':alias:' || p_name || ':' || p_size AS directive, 'import' AS prefix,
 p_brand || ':alias:' || p_name || ':' || p_size AS body FROM part""",
    "fuzzy_scores": f"""WITH RECURSIVE {PATHS}, p AS (SELECT DISTINCT path FROM paths), f(path, i, hits, run, score, before) AS (SELECT path, 0, 0, 0, 0, '/' FROM p UNION ALL
 SELECT path, i + 1, hits + hit, CASE hit WHEN 1 THEN run + 1 ELSE 0 END, score + hit * (3 * (run + 1) + CASE before WHEN '/' THEN 8 ELSE 0 END), c FROM
  (SELECT *, substr(lower(path), i + 1, 1) AS c, CASE WHEN hits < 2 AND substr(lower(path), i + 1, 1) = substr('e3', hits + 1, 1) THEN 1 ELSE 0 END AS hit FROM f WHERE i < length(path)))
 SELECT path, CASE WHEN hits = 2 THEN CAST(score AS BIGINT) END AS score FROM f WHERE i = length(path)""",
    "media_and_languages": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' ELSE 'unknown' END AS language, CASE p_partkey % 5 WHEN 2 THEN 'image/png' WHEN 4 THEN 'image/svg+xml' END AS media, p_size % 3 = 0 AS hash FROM part""",
    "text_files": "SELECT doc_id, doc_id % 4 NOT IN (1, 2) AS is_text FROM documents",
    "positions": """WITH h AS (SELECT doc_id, text, left(text, length(text) // 2) AS b FROM documents), o AS (SELECT doc_id, b, CASE WHEN ends_with(b, chr(13)) AND substr(text, length(b) + 1, 1) = chr(10) THEN 1 ELSE 0 END AS cr,
  regexp_extract(b, '[^\\n]*$') AS own FROM h) SELECT doc_id, length(b) - length(replace(b, chr(10), '')) AS line, length(own) - cr + length(regexp_replace(own, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS utf16, length(own) - cr AS chars FROM o""",
    "portable_links": """SELECT p_partkey, 'a ' || CASE p_partkey % 5 WHEN 0 THEN '[[ADR-0001]]' WHEN 1 THEN '[[ADR-0001#x]]' WHEN 2 THEN '[[docs/adr/0002-y.md|ADR-0001]]' WHEN 3 THEN '`[[docs/adr/0001-use-spark.md|ADR-0001]]`' ELSE '[[ADR-20240229-a-b]]' END || ' b ' || p_partkey AS body,
 p_partkey % 6 < 5 AS backed, CASE p_partkey % 3 WHEN 0 THEN 'Guide' WHEN 1 THEN 'Guide#In|notes/Guide.md#In' ELSE 'Guide#In' END AS target FROM part""",
    "frontmatter_lines": """SELECT p_partkey, CAST(3 AS BIGINT) AS line, CAST(2 AS BIGINT) AS other, '---' || chr(10) || 'id: x' || chr(10) || 'governs:' || chr(10) || '  - ' || q || 'new/path' || q || chr(10) || '  - keep' || chr(10) || '---' || chr(10) || 'governs: ' || p_name AS text
 FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '"' ELSE chr(39) END AS q FROM part)""",
    "watch_relevance": f"""WITH {PATHS}, p AS (SELECT page_id, path || CASE page_id % 4 WHEN 0 THEN '' WHEN 2 THEN '/.git/x' ELSE '.md' END AS path FROM paths)
 SELECT page_id, CASE WHEN page_id % 4 = 2 THEN NULL WHEN starts_with(path, 'de/') AND ends_with(path, '.md') THEN 'docs' WHEN starts_with(path, 'fr/') THEN 'source' WHEN starts_with(path, 'en/') AND NOT regexp_matches(path, '^en/1[^/]*$') THEN 'source' END AS what FROM p""",
    "projected_nodes": f"""WITH n AS (SELECT DISTINCT 'code:' || p_brand AS id, 'code' AS kind, p_brand AS label, p_brand AS path FROM part
 UNION ALL SELECT 'symbol:' || p_brand || '#fn:' || p_name, 'function', arg_min(CASE WHEN p_size > 40 THEN p_name || '/' || p_size ELSE p_name END, p_brand || '#L' || p_partkey), min(p_brand || '#L' || p_partkey) FROM part GROUP BY p_brand, p_name
 UNION ALL SELECT DISTINCT 'external-call:' || p_type, 'external-call', p_type, CAST(NULL AS VARCHAR) FROM part WHERE p_size % 2 = 1)
 SELECT id, kind, label, path, sha256('4:node|' || {" || '|' || ".join(_field(x) for x in ("id", "kind", "label", "path"))}) AS hash FROM n""",
    "projected_edges": """SELECT CASE WHEN p_size % 4 = 0 THEN 'symbol:' || p_brand || '#type:' || p_type ELSE 'code:' || p_brand END AS src, 'contains' AS kind, 'symbol:' || p_brand || '#fn:' || p_name AS dst FROM part
 UNION SELECT 'symbol:' || p_brand || '#fn:' || p_name, CASE p_partkey % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'captures' ELSE 'delegates' END, CASE WHEN p_size % 2 = 0 THEN 'symbol:' || p_brand || '#' || p_type ELSE 'external-call:' || p_type END FROM part""",
    "symbol_index": """WITH s AS (SELECT 'part:' || p_partkey AS id, p_name || ' ' || p_brand AS name, lower(p_type) AS kind FROM part) SELECT name AS alias, id FROM s UNION SELECT 'fn:' || name, id FROM s UNION SELECT kind, id FROM s""",
    "heading_links": """SELECT c_custkey, CASE WHEN ok THEN 'note' ELSE 'broken' END AS kind, CASE WHEN ok THEN 'N' || (c_custkey % 25) END AS target FROM
 (SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN false WHEN 4 THEN false WHEN 5 THEN regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') = 'nation-3' ELSE true END AS ok FROM customer JOIN nation ON n_nationkey = c_custkey % 25)""",
    "policy_matches": f"WITH {FOUND} SELECT id, path, CAST(line AS BIGINT) AS line, range, text, captures FROM found",
    "policy_plan": """WITH d AS (SELECT p_brand AS path, p_partkey AS seq, 'D' || (p_size % 5) AS decision, p_name AS local FROM part WHERE p_size % 9 > 0 AND p_partkey % 4 > 1),
 f AS (SELECT decision, decision || '/' || local AS id, path, seq, row_number() OVER (PARTITION BY decision, local ORDER BY path, seq) AS n FROM d) SELECT id, path, seq FROM f WHERE n = 1 AND decision IN ('D0', 'D2', 'D4')""",
    "policy_rescan": f"""WITH {EDITED}, n AS (SELECT sum(CASE WHEN p_partkey % 2 = 0 AND p_size % 3 = 0 AND p_partkey % 101 = 1 THEN 2 WHEN p_partkey % 2 = 1 AND p_size % 3 <> 1 THEN CASE WHEN p_partkey % 101 = 1 THEN 3 ELSE 1 END ELSE 0 END) AS n FROM part)
 SELECT id, path, CAST(line AS BIGINT) AS line, range, text, CAST(n AS BIGINT) AS scanned FROM found, n""",
    "policy_violations": f"WITH {FOUND} SELECT 'error' AS severity, 'policy-violation' AS code, path, CAST(line AS BIGINT) AS line, decision || ' policy `' || id || '` matched `' || text || '`' AS message FROM found",
}
SQL |= {
    "scan_errors": """SELECT CASE WHEN doc_id % 7 = 0 THEN '../' ELSE 'a/' END || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'path is not safe' ELSE 'content is not UTF-8' END AS reason
 FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""",
    "documentation_scan": "SELECT 'docs/' || p_partkey || CASE p_size % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.PNG' ELSE '.svg' END AS path, CASE p_size % 6 WHEN 0 THEN 'note' ELSE 'asset' END AS what FROM part WHERE p_partkey % 4 = 0 AND p_size % 6 IN (0, 1, 5)",
    "asset_budget": """SELECT path, 'image/png' AS mime, bytes FROM (SELECT path, bytes, sum(bytes) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS used FROM
 (SELECT 'img/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.png' AS path, CAST(strlen(text) + 4 AS BIGINT) AS bytes FROM documents WHERE doc_id % 3 > 0)) WHERE used <= 300000""",
    "document_hashes": "SELECT doc_id, sha256(text || '.' || CASE doc_id % 4 WHEN 3 THEN chr(10) ELSE '' END) AS hash FROM documents",
    "citation_index": """WITH l AS (SELECT e.user_id AS note, p.user_id AS target FROM events e JOIN events p ON p.event_id = e.event_id - 1)
 SELECT u AS note, (SELECT count(DISTINCT note) FROM l WHERE target = u AND note <> u) AS citing, EXISTS (SELECT 1 FROM l WHERE note = u) AS has_outgoing FROM (SELECT DISTINCT user_id AS u FROM events UNION ALL SELECT c_custkey + 1000000 FROM customer)""",
    "note_targets": """WITH l AS (SELECT DISTINCT 'supplier:' || l_suppkey AS note, CASE WHEN l_suppkey % 10 = 0 AND p_size = 1 THEN p_brand ELSE 'part:' || p_partkey END AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50)
 SELECT 'supplier:' || s_suppkey AS note, 'src/main' AS target FROM supplier UNION SELECT note, target FROM l UNION SELECT note, 'match:p' || right(target, 1) FROM l""",
    "top_level_parts": "SELECT p_partkey, 'a<b, c>;[' || p_size || ', {2}];f(' || p_brand || ', x);' || p_name AS parts FROM part",
    "signatures": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a|u8;b|Vec<u8, A>' WHEN 1 THEN 'x|number|3;y?|string' WHEN 2 THEN 'self;n|2' ELSE '' END AS inputs,
 CASE p_partkey % 4 WHEN 0 THEN 'Option<T>' WHEN 1 THEN 'Map<a, b>' END AS output FROM part""",
    "parsed_sources": """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 2 WHEN 0 THEN n || ':function:true:2:5;other:function:false:6:6' ELSE n || ':class:true:2:4;run:method:true:3:4;_no:function:false:5:6' END AS symbols,
 CASE p_partkey % 2 WHEN 0 THEN 'a::{b, c}:1' ELSE 'os:1' END AS imports, CASE p_partkey % 2 WHEN 0 THEN n || ':helper:3' ELSE CASE WHEN n < 'run' THEN n || ':help:4;run:help:4' ELSE 'run:help:4;' || n || ':help:4' END END AS calls
 FROM (SELECT *, replace(p_name, ' ', '_') AS n FROM part)""",
    "brace_expansion": "SELECT p_partkey, unnest(['a::b', 'a::c::' || replace(p_name, ' ', '_'), 'a::c']) AS module FROM part",
    "incremental_parse": """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size % 2 = 0 THEN 'old' ELSE 'new' END AS hash, CASE WHEN p_size % 2 = 0 AND p_size < 40 THEN 'kept' ELSE 'parsed' END AS how FROM part WHERE p_size > 10""",
    "suggestions": f"""WITH f AS ({SQL["fuzzy_scores"]}), s AS (SELECT path, CAST(CASE WHEN path = 'e3' THEN 100000 WHEN regexp_extract(path, '[^/]*$') = 'e3' THEN 90000 WHEN ends_with(path, '/e3') THEN 80000 - strlen(path)
 WHEN starts_with(regexp_extract(path, '[^/]*$'), 'e3') THEN 70000 - strlen(path) WHEN contains(path, 'e3') THEN 60000 - (instr(path, 'e3') - 1) - strlen(path) ELSE 40000 + score - strlen(path) END AS BIGINT) AS score FROM f)
 SELECT path, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, path LIMIT 50""",
    "duplicate_pattern_rules": """WITH d AS (SELECT 'D/' || p_type AS pattern, p_type AS local, 'n' || (p_size % 4) AS path, p_partkey AS line FROM part),
 r AS (SELECT *, min(path) OVER (PARTITION BY pattern) AS first_note, row_number() OVER (PARTITION BY pattern, path ORDER BY line) AS n FROM d),
 m AS (SELECT pattern, string_agg(DISTINCT path, ', ' ORDER BY path) AS notes, count(DISTINCT path) AS many FROM d GROUP BY pattern)
 SELECT 'duplicate-policy-pattern' AS code, path, CAST(line AS BIGINT) AS line, 'policy pattern id `' || local || '` is declared more than once' AS message FROM r WHERE path = first_note AND n > 1
 UNION ALL SELECT DISTINCT 'duplicate-pattern-id', d.path, CAST(NULL AS BIGINT), 'pattern id `' || m.pattern || '` is declared in multiple notes: ' || m.notes FROM d JOIN m ON m.pattern = d.pattern WHERE m.many > 1""",
}
SQL |= {
    "elixir_callables": """SELECT 'Acme.M' || p_partkey || '.' || n AS id, kind, exported, CAST(clauses AS BIGINT) AS clauses, CAST(a AS BIGINT) AS first_line, CAST(b AS BIGINT) AS last_line FROM part,
 (VALUES ('run/1', 'function', true, 1, 4, 11), ('run/2', 'function', true, 2, 4, 15), ('own/1', 'function', false, 1, 12, 12), ('handle/1', 'callback', true, 1, 16, 16)) v(n, kind, exported, clauses, a, b)
 UNION ALL SELECT 'Acme.Base.help/1', 'function', true, 1, 2, 2""",
    "elixir_directives": """SELECT p_partkey || '.ex' AS path, 'alias' AS kind, 'Acme.M' || p_partkey AS owner, 'Acme.M' || (p_partkey - p_partkey % 2) AS module, 'Next' AS alias, CAST(NULL AS VARCHAR) AS only, CAST(2 AS BIGINT) AS d_line, CAST(2 AS BIGINT) AS scope_start, CAST(17 AS BIGINT) AS scope_end FROM part
 UNION ALL SELECT p_partkey || '.ex', 'import', 'Acme.M' || p_partkey, 'Acme.Base', NULL, 'help/1', 3, 3, 17 FROM part""",
    "elixir_relations": """WITH p AS (SELECT p_partkey || '.ex' AS path, 'Acme.M' || p_partkey || '.' AS me, 'Acme.M' || (p_partkey - p_partkey % 2) || '.' AS other, p_partkey - p_partkey % 2 IN (SELECT p_partkey FROM part) AS there FROM part)
 SELECT path, CAST(5 AS BIGINT) AS line, 'call' AS kind, 'run' AS caller, other || 'run/2' AS text, CASE WHEN there THEN other || 'run/2' END AS target, CASE WHEN there THEN 'resolved' ELSE 'external' END AS outcome FROM p
 UNION ALL SELECT path, 6, 'call', 'run', 'help/1', 'Acme.Base.help/1', 'resolved' FROM p UNION ALL SELECT path, 7, 'call', 'run', 'own/1', me || 'own/1', 'resolved' FROM p UNION ALL SELECT path, 8, 'call', 'run', 'gone/1', NULL, 'external' FROM p
 UNION ALL SELECT path, 9, 'call', 'run', me || 'run/1', me || 'run/1', 'resolved' FROM p UNION ALL SELECT path, 10, 'dynamic', 'run', 'send/1', NULL, 'dynamic' FROM p
 UNION ALL SELECT path, 12, 'capture', 'own', other || 'run/1', CASE WHEN there THEN other || 'run/1' END, CASE WHEN there THEN 'resolved' ELSE 'external' END FROM p
 UNION ALL SELECT path, 14, 'call', 'run', other || 'own/1', NULL, 'external' FROM p""",
}
_LOCAL = f"""SELECT code, path FROM ({NOTE_LOCAL}) UNION ALL SELECT code, path FROM ({LINKS}) UNION ALL SELECT code, path FROM ({TARGETS}) UNION ALL SELECT code, path FROM ({DECLARED})
 UNION ALL SELECT 'policy-violation', path FROM (WITH {FOUND} SELECT path FROM found)"""
SQL["validation_full"] = f"SELECT code, count(*) AS n FROM ({_LOCAL} UNION ALL SELECT code, path FROM ({DUPLICATES}) UNION ALL SELECT code, path FROM ({SUPERSESSION})) GROUP BY code"
SQL["validation_changed"] = f"""SELECT code, count(*) AS n FROM ({_LOCAL}) WHERE path = 'Brand#12' OR path IN (SELECT {NOTE_PATH} FROM part WHERE p_partkey % 2 = 1) OR path IN (SELECT 'src/' || p_partkey FROM part WHERE p_partkey % 2 = 1) GROUP BY code"""
_NOTED = """p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 3 <> 1 AS accepted, 'docs/adr/20240101-k' || p_partkey || '.md' AS path FROM part),
 d AS (SELECT p.*, accepted AND k % 10 = 9 AND EXISTS (SELECT 1 FROM p o WHERE o.k = p.k + 1 AND o.accepted) AS historical FROM p),
 f AS (SELECT k, s, 'src/m' || s || '/f' || k || '.rs' AS file FROM p WHERE k % 2 = 0),
 g AS (SELECT path, k, accepted, historical, CASE WHEN k % 5 = 2 THEN 'invalid-glob' WHEN k % 5 = 1 OR k % 5 = 4 AND k % 2 = 1 OR k % 5 = 0 AND s NOT IN (SELECT s FROM f) THEN 'unresolved-governs' END AS code FROM d)"""
SQL["validation_derived"] = f"""WITH {_NOTED}, told AS (
 SELECT 'error' AS severity, code FROM g WHERE NOT historical AND code IS NOT NULL
 UNION ALL SELECT CASE WHEN k % 8 IN (0, 4) THEN 'warning' ELSE 'error' END, CASE WHEN k % 8 IN (0, 4) THEN 'legacy-source-target' ELSE 'unresolved-target' END FROM d WHERE k % 8 IN (0, 1, 2, 4) AND NOT historical
 UNION ALL SELECT 'warning', 'empty-target-scope' FROM d WHERE k % 7 = 0 AND NOT historical
 UNION ALL SELECT 'error', 'unresolved-pattern' FROM d WHERE k % 6 = 0 AND k % 10 <> 0
 UNION ALL SELECT 'error', 'invalid-policy-pattern' FROM d WHERE k % 10 = 0
 UNION ALL SELECT 'error', 'document-format' FROM d WHERE k % 11 = 0 AND NOT historical
 UNION ALL SELECT 'error', 'broken-link' FROM d WHERE k % 9 = 1 OR k % 9 > 1 AND k % 2 = 1
 UNION ALL SELECT 'error', 'unknown-superseded-by' FROM d WHERE k % 10 = 9 AND k + 1 NOT IN (SELECT k FROM p)
 UNION ALL SELECT 'error', 'unknown-supersedes' FROM d WHERE k % 10 = 0 AND k - 1 NOT IN (SELECT k FROM p)
 UNION ALL SELECT 'error', 'policy-violation' FROM d JOIN f ON f.s = d.s AND f.k % 4 = 0 WHERE d.k % 10 = 0 AND d.accepted)
 SELECT severity, code, count(*) AS n FROM told GROUP BY 1, 2"""
SQL["publication_blockers"] = f"WITH {_NOTED} SELECT code, path FROM g WHERE accepted AND NOT historical AND code IS NOT NULL"
SQL["allowed_decision_changes"] = """SELECT 'adr-immutability-violation' AS code, 'docs/adr/' || p_partkey || '.md' AS path FROM part WHERE p_partkey % 6 IN (1, 3) OR p_partkey % 12 = 10"""
SQL["suggestions_of_many"] = f"""WITH {PATHS}, p AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name FROM paths),
 q AS (SELECT DISTINCT query FROM (SELECT split_part(path, '/', 1) AS query FROM p UNION ALL SELECT right(path, 1) FROM p) WHERE regexp_matches(query, '^[a-z0-9]+$')),
 s AS (SELECT query, path AS target, CAST(CASE WHEN path = query THEN 100000 WHEN name = query THEN 90000 WHEN ends_with(path, '/' || query) THEN 80000 - strlen(path)
  WHEN starts_with(name, query) THEN 70000 - strlen(path) ELSE 60000 - (instr(path, query) - 1) - strlen(path) END AS BIGINT) AS score FROM p JOIN q ON contains(path, query)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank FROM s) SELECT query, CAST(rank AS INT) AS rank, target, score FROM r WHERE rank <= 3"""
