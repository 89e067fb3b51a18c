"""DuckDB SQL that gives the rows of plans/queries.py, written independently of the operators."""

from __future__ import annotations

from .oracle_parts import PATHS
from .queries import ASKED, GLOBS, RULES, SCOPES
from .validation_oracle import SQL as VALIDATION

SYMBOLS = """symbols AS (SELECT 'part:' || p_partkey AS id, p_brand AS path, p_name || ' ' || p_brand AS name, lower(p_type) AS kind,
 p_size >= 25 AS exported, p_size % 5 = 0 AS top_level, p_partkey AS seq FROM part)"""
CALLS = """calls AS (SELECT DISTINCT 'order:' || l_orderkey AS caller, CASE WHEN p_size <= 45 THEN 'part:' || p_partkey END AS target,
 p_name || ' ' || p_brand AS text, CASE WHEN l_returnflag = 'R' THEN 'capture' ELSE 'call' END AS kind FROM lineitem JOIN part ON p_partkey = l_partkey)"""
GOVERNED = "governed AS (SELECT DISTINCT 'supplier:' || l_suppkey AS decision, 'part:' || l_partkey AS path FROM lineitem WHERE l_quantity = 50)"
NOTE_LINKS = """note_links AS (SELECT DISTINCT 'supplier:' || l_suppkey AS note, CASE WHEN l_suppkey % 10 = 0 AND p_size = 1 THEN p_brand ELSE 'part:' || p_partkey END AS target
 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50)"""
USER_LINKS = "user_links AS (SELECT e.user_id AS note, p.user_id AS target FROM events e JOIN events p ON p.event_id = e.event_id - 1)"
DECISIONS = """decisions AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'draft' END AS status FROM orders),
 edges AS (SELECT * FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"""
SHIPS = """a AS (SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'ships' AS kind, 'part:' || l_partkey AS dst FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'),
 b AS (SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'ships' AS kind, 'part:' || l_partkey AS dst FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')"""


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


#: What each glob of the bindings means, written by hand.
MEANT = {
    "fr/*": "^fr/[^/]*$", "**/2*": "^(.*/)?2[^/]*$", "en/[1-3]??": "^en/[1-3][^/][^/]$", "{de,es}/*5": "^(de|es)/[^/]*5$", "zz/*": "^zz/[^/]*$", "825": "^825$", "en/30?": "^en/30[^/]$",
    "economy": "^economy$", "small::red": "^small::red$", "*/blue/*": "^[^/]*/blue/[^/]*$", "Brand#1*": "^Brand#1[^/]*$", "*": "^[^/]*$", "Brand#?": "^Brand#[^/]$",
}


def _regexes(rows: list[tuple[str, str]]) -> str:
    return _values([(a, b, MEANT[b]) for a, b in rows])


SUPERSEDED = f"""WITH RECURSIVE {DECISIONS}, closure(id) AS (SELECT e.dst FROM edges e JOIN decisions d ON d.id = e.src AND d.status = 'accepted'
 UNION SELECT e.dst FROM closure c JOIN edges e ON e.src = c.id)"""


def _field(x: str) -> str:
    return f"strlen({x}) || ':' || {x}"


NODE_HASH = "sha256('4:node|' || " + " || '|' || ".join(_field(x) for x in ("id", "kind", "name", "path")) + ")"
EDGE_HASH = "sha256('4:edge|' || " + " || '|' || ".join(_field(x) for x in ("src", "kind", "dst")) + ")"

SQL = {
    "callers": f"""WITH {SYMBOLS}, {CALLS} SELECT target AS symbol, caller FROM calls WHERE kind <> 'capture' AND target IS NOT NULL
 UNION SELECT s.id, c.caller FROM calls c JOIN symbols s ON c.text = s.name WHERE c.kind <> 'capture' AND c.target IS NULL""",
    "callees": f"WITH {CALLS} SELECT DISTINCT caller, coalesce(target, text) AS callee FROM calls WHERE kind <> 'capture'",
    "attack_surface": f"""WITH {SYMBOLS}, {CALLS} SELECT id FROM symbols s WHERE exported OR name LIKE 'red %' OR
 (top_level AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.target = s.id AND c.kind <> 'capture'))""",
    "call_resolution": f"""WITH {SYMBOLS}, asked AS (SELECT DISTINCT 'Brand#' || (l_suppkey % 25 + 1) AS path, p_name || ' ' || p_brand AS text FROM lineitem JOIN part ON p_partkey = l_partkey),
 here AS (SELECT path, name, arg_min(id, seq) AS id FROM symbols GROUP BY 1, 2), only_one AS (SELECT name, min(id) AS id FROM symbols GROUP BY 1 HAVING count(DISTINCT id) = 1)
 SELECT a.path, a.text, coalesce(h.id, o.id) AS target FROM asked a LEFT JOIN here h ON h.path = a.path AND h.name = a.text LEFT JOIN only_one o ON o.name = a.text""",
    "references": f"WITH {SYMBOLS}, {NOTE_LINKS} SELECT DISTINCT s.id AS symbol, l.note FROM symbols s JOIN note_links l ON l.target = s.id OR l.target = s.path",
    "undocumented": f"WITH {SYMBOLS}, {NOTE_LINKS} SELECT id FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM note_links l WHERE l.target = s.id OR l.target = s.path)",
    "cites": f"WITH {USER_LINKS} SELECT DISTINCT note, target FROM user_links",
    "cited_by": f"WITH {USER_LINKS} SELECT DISTINCT target, note FROM user_links WHERE note <> target",
    "orphans": "SELECT o_orderkey AS note FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT doc_id FROM labels)",
    "governs": f"WITH {GOVERNED} SELECT decision, path FROM governed",
    "governing": f"WITH {GOVERNED}, {SYMBOLS} SELECT DISTINCT s.path, g.decision FROM governed g JOIN symbols s ON s.id = g.path",
    "glob_scope": f"""WITH {PATHS}, globs(decision, pat, regex) AS (VALUES {_regexes(GLOBS)}), hit AS (SELECT DISTINCT decision, pat, path FROM globs, paths WHERE regexp_matches(path, regex)),
 rest AS (SELECT decision, pat FROM globs EXCEPT SELECT decision, pat FROM hit)
 SELECT DISTINCT decision, path FROM hit UNION SELECT r.decision, min(p.path) FROM rest r JOIN paths p ON p.path = r.pat OR ends_with(p.path, '/' || r.pat) GROUP BY r.decision""",
    "suffix_resolution": f"""WITH {PATHS}, p AS (SELECT DISTINCT path FROM paths), q AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS query FROM p)
 SELECT query, CASE WHEN bool_or(path = query) THEN query ELSE min(path) END AS path, CASE WHEN bool_or(path = query) THEN false ELSE count(*) > 1 END AS ambiguous
 FROM q JOIN p ON path = query OR ends_with(path, '/' || query) GROUP BY query""",
    "coverage_total": f"""WITH {GOVERNED}, n AS (SELECT count(*) AS n FROM part), g AS (SELECT count(DISTINCT path) AS g FROM governed)
 SELECT CAST(n AS BIGINT) AS source_files, CAST(g AS BIGINT) AS governed_files, CAST(greatest(n - g, 0) AS BIGINT) AS ungoverned_files FROM n, g""",
    "coverage_by_module": f"""WITH {GOVERNED}, {SYMBOLS} SELECT s.path AS module, count(*) AS total, count(g.path) AS governed, count(*) - count(g.path) AS ungoverned
 FROM symbols s LEFT JOIN (SELECT DISTINCT path FROM governed) g ON g.path = s.id GROUP BY 1""",
    "coverage_by_owner": f"WITH {GOVERNED} SELECT 'supplier:' || s_suppkey AS decision, count(DISTINCT path) AS files FROM supplier LEFT JOIN governed ON decision = 'supplier:' || s_suppkey GROUP BY 1",
    "nodes_by_kind": f"""WITH {SYMBOLS} SELECT 'all' AS asked, path AS id FROM (SELECT DISTINCT path FROM symbols) UNION ALL SELECT 'all', n_name FROM nation
 UNION ALL SELECT 'doc', n_name FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 'decision', n_name FROM nation WHERE n_regionkey = 0
 UNION ALL SELECT 'code', id FROM symbols UNION ALL SELECT 'economy', id FROM symbols WHERE kind = 'economy'""",
    "snapshot_diff": f"""WITH {SHIPS}, na AS (SELECT src AS id FROM a UNION SELECT dst FROM a), nb AS (SELECT src AS id FROM b UNION SELECT dst FROM b),
 ea AS (SELECT src || ':' || kind || ':' || dst AS id FROM a), eb AS (SELECT src || ':' || kind || ':' || dst AS id FROM b)
 SELECT 'node_added' AS change, id AS item FROM (SELECT id FROM nb EXCEPT SELECT id FROM na) UNION ALL SELECT 'node_removed', id FROM (SELECT id FROM na EXCEPT SELECT id FROM nb)
 UNION ALL SELECT 'edge_added', id FROM (SELECT id FROM eb EXCEPT SELECT id FROM ea) UNION ALL SELECT 'edge_removed', id FROM (SELECT id FROM ea EXCEPT SELECT id FROM eb)""",
    "symmetric_difference": f"WITH {SHIPS} (SELECT src, dst FROM a EXCEPT SELECT src, dst FROM b) UNION ALL (SELECT src, dst FROM b EXCEPT SELECT src, dst FROM a)",
    "equal_sets": "SELECT NOT EXISTS (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part) AND NOT EXISTS (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem) AS equal",
    "changed_policy_paths": f"WITH {SHIPS}, {GOVERNED} SELECT dst AS path FROM b INTERSECT SELECT path FROM governed",
    "retention": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 20",
    "budget_cut": "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 1000000",
    "first_wins": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""",
    "duplicates": "SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE copies > 1",
    "duplicate_patterns": """WITH d AS (SELECT p_name || '/' || p_type AS pattern, p_brand AS note, p_partkey AS seq FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY pattern, note ORDER BY seq) AS n, min(note) OVER (PARTITION BY pattern) AS first_note, max(note) OVER (PARTITION BY pattern) AS last_note FROM d)
 SELECT pattern, note, seq, 'again in its note' AS reason FROM r WHERE note = first_note AND n > 1
 UNION ALL SELECT pattern, note, seq, 'in several notes' FROM r WHERE first_note <> last_note AND n = 1""",
    "supersession_effective": f"{SUPERSEDED} SELECT id FROM decisions WHERE status = 'accepted' AND id NOT IN (SELECT id FROM closure)",
    "supersession_historical": f"{SUPERSEDED} SELECT id FROM decisions WHERE status = 'accepted' AND id IN (SELECT id FROM closure)",
    "rename_chain": f"""WITH RECURSIVE {DECISIONS}, r(start, cur, steps) AS (SELECT dst, src, 1 FROM edges UNION ALL SELECT r.start, e.src, r.steps + 1 FROM r JOIN edges e ON e.dst = r.cur)
 SELECT start, arg_max(cur, steps) AS last, CAST(max(steps) AS BIGINT) AS steps FROM r GROUP BY start""",
    "asof_alias": """SELECT p.event_id, s.event_id AS alias FROM (SELECT * FROM events WHERE event_type = 'purchase') p
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""",
    "scope_interval": """SELECT p.event_id, s.event_id AS directive FROM events p JOIN events s ON p.user_id = s.user_id AND p.event_type = 'purchase' AND s.event_type = 'signup'
 AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 3 DAY""",
    "link_extract": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1, 2",
    "link_resolve": f"""WITH {PATHS}, p AS (SELECT DISTINCT path FROM paths), raw AS (SELECT page_id, page_id % 4 AS k, page_id, regexp_extract(path, '[^/]*$') AS tail FROM paths),
 found AS (SELECT tail, CASE WHEN bool_or(path = tail) THEN tail ELSE min(path) END AS path, CASE WHEN bool_or(path = tail) THEN false ELSE count(*) > 1 END AS ambiguous
  FROM (SELECT DISTINCT tail FROM raw) JOIN p ON path = tail OR ends_with(path, '/' || tail) GROUP BY tail)
 SELECT r.page_id, CASE WHEN k < 2 THEN 'source' WHEN k = 2 THEN CASE WHEN r.page_id % 7 IN (SELECT r_regionkey FROM region) THEN 'pattern' ELSE 'broken' END
  WHEN r.page_id % 30 IN (SELECT n_nationkey FROM nation) THEN 'note' ELSE 'broken' END AS kind,
  CASE WHEN k < 2 THEN f.path WHEN k = 2 THEN CASE WHEN r.page_id % 7 IN (SELECT r_regionkey FROM region) THEN 'P' || (r.page_id % 7) END
  WHEN r.page_id % 30 IN (SELECT n_nationkey FROM nation) THEN 'N' || (r.page_id % 30) END AS target, k < 2 AND f.ambiguous AS ambiguous FROM raw r JOIN found f ON f.tail = r.tail""",
    "slug": r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages",
    "safe_path": f"""WITH {PATHS} SELECT page_id, CASE page_id % 6 WHEN 3 THEN 'a/b/' || rtrim(path, '/') WHEN 5 THEN rtrim(path, '/') END AS safe FROM paths""",
    "id_parse": "SELECT o_orderkey, 'symbol' AS prefix, o_orderpriority || ':' || o_orderstatus AS body FROM orders",
    "decision_ids": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey BETWEEN 1000 AND 9999 WHEN 1 THEN true
 WHEN 2 THEN CAST(o_orderkey % 90 + 10 AS INT) <= day(last_day(o_orderdate)) ELSE false END AS valid FROM orders""",
    "suggest_topk": f"""WITH {PATHS}, p AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name FROM paths) SELECT path, CAST(CASE WHEN path = '{ASKED}' THEN 100000 WHEN name = '{ASKED}' THEN 90000
 WHEN starts_with(name, '{ASKED}') THEN 70000 - strlen(path) ELSE 60000 - (instr(path, '{ASKED}') - 1) - strlen(path) END AS BIGINT) AS score FROM p WHERE contains(path, '{ASKED}') ORDER BY score DESC, path LIMIT 20""",
    "node_hashes": f"WITH {SYMBOLS} SELECT id, {NODE_HASH} AS hash FROM symbols",
    "graph_root_hash": f"""WITH {SYMBOLS}, {SHIPS}, h AS (SELECT {NODE_HASH} AS h FROM symbols UNION ALL SELECT {EDGE_HASH} FROM b),
 low AS (SELECT substr(h, 1, 6) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1), mid AS (SELECT substr(p, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM low GROUP BY 1)
 SELECT sha256(string_agg(h, '' ORDER BY p)) AS root FROM mid""",
    "policy_scan": "SELECT b.item_id AS pattern, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''",
    "deny_imports": f"""WITH m AS (SELECT DISTINCT p_brand AS path, lower(p_type) || '::' || replace(p_name, ' ', '::') AS module FROM part), rules(rule, deny, regex) AS (VALUES {_regexes(RULES)}),
 scopes(rule, pat, regex) AS (VALUES {_regexes(SCOPES)}) SELECT DISTINCT r.rule, m.path, m.module FROM m JOIN scopes s ON regexp_matches(m.path, s.regex)
 JOIN rules r ON r.rule = s.rule AND (m.module = r.deny OR starts_with(m.module, r.deny || '::') OR regexp_matches(replace(m.module, '::', '/'), r.regex))""",
    "debounce_sessions": """SELECT event_id, CAST(sum(fresh) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM
 (SELECT event_id, ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) <= INTERVAL 250 MILLISECOND THEN 0 ELSE 1 END AS fresh FROM events)""",
    "state_summary": f"""WITH {SHIPS} SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM b) AS edges, (SELECT count(DISTINCT p_brand) FROM part) AS sources, (SELECT count(*) FROM benchmark) AS patterns""",
    "failure_categories": """WITH e AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE 'other' END AS category FROM orders WHERE o_orderstatus = 'P')
 SELECT category, count(*) AS n, category = (SELECT min(category) FROM e) AS sets_code FROM e GROUP BY 1""",
    "severity_counts": "SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings FROM events",
    "affected_paths": "SELECT 'part:' || l_partkey AS path FROM lineitem UNION SELECT 'supplier:' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'",
    "changes": f"""WITH {SHIPS}, bf AS (SELECT dst AS path, min(src) || '/' || max(src) || '/' || count(*) AS hash FROM a GROUP BY 1), af AS (SELECT dst AS path, min(src) || '/' || max(src) || '/' || count(*) AS hash FROM b GROUP BY 1),
 added AS (SELECT * FROM af WHERE path NOT IN (SELECT path FROM bf)), deleted AS (SELECT * FROM bf WHERE path NOT IN (SELECT path FROM af)),
 renamed AS (SELECT x.path, y.path AS previous_path FROM added x JOIN deleted y ON x.hash = y.hash WHERE x.hash IN (SELECT hash FROM added GROUP BY 1 HAVING count(*) = 1) AND x.hash IN (SELECT hash FROM deleted GROUP BY 1 HAVING count(*) = 1)),
 kept AS (SELECT af.hash, min(af.path) AS previous_path FROM af JOIN bf ON af.path = bf.path AND af.hash = bf.hash GROUP BY 1),
 copied AS (SELECT x.path, k.previous_path FROM added x JOIN kept k ON k.hash = x.hash WHERE x.path NOT IN (SELECT path FROM renamed))
 SELECT 'renamed' AS status, path, previous_path FROM renamed UNION ALL SELECT 'copied', path, previous_path FROM copied
 UNION ALL SELECT 'added', path, NULL FROM added WHERE path NOT IN (SELECT path FROM renamed) AND path NOT IN (SELECT path FROM copied)
 UNION ALL SELECT 'deleted', path, NULL FROM deleted WHERE path NOT IN (SELECT previous_path FROM renamed)
 UNION ALL SELECT 'modified', af.path, NULL FROM af JOIN bf ON af.path = bf.path AND af.hash <> bf.hash""",
    "changes_similar": r"""WITH RECURSIVE d AS (SELECT doc_id, text, doc_id % 5 AS k, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
 bf AS (SELECT CASE WHEN k = 4 THEN 'kept/' ELSE 'old/' END || doc_id AS path, text FROM d),
 af AS (SELECT CASE WHEN k = 4 THEN 'kept/' ELSE 'new/' END || doc_id AS path, CASE WHEN k = 0 THEN array_to_string(list_slice(l, 1, CAST(ceil(len(l) * 0.75) AS INT)), chr(10))
   WHEN k = 1 THEN 'begun ' || doc_id || substr(text, length(l[1]) + 1) WHEN k = 2 THEN array_to_string(list_slice(l, 1, CAST(ceil(len(l) * 0.25) AS INT)), chr(10))
   WHEN doc_id % 10 = 9 THEN text || chr(10) || 'more' ELSE text END AS text FROM d WHERE k <> 3),
 added AS (SELECT * FROM af WHERE path NOT IN (SELECT path FROM bf)), deleted AS (SELECT * FROM bf WHERE path NOT IN (SELECT path FROM af)),
 exact AS (SELECT x.path, y.path AS previous_path FROM added x JOIN deleted y USING (text) WHERE text IN (SELECT text FROM added GROUP BY 1 HAVING count(*) = 1) AND text IN (SELECT text FROM deleted GROUP BY 1 HAVING count(*) = 1)),
 copied AS (SELECT x.path, k.previous_path FROM added x JOIN (SELECT af.text, min(af.path) AS previous_path FROM af JOIN bf ON af.path = bf.path AND af.text = bf.text GROUP BY 1) k ON k.text = x.text WHERE x.path NOT IN (SELECT path FROM exact)),
 a AS (SELECT * FROM deleted WHERE path NOT IN (SELECT previous_path FROM exact)), b AS (SELECT * FROM added WHERE path NOT IN (SELECT path FROM exact) AND path NOT IN (SELECT path FROM copied)),
 ac AS (SELECT min(path) AS file, text, count(*) AS n, row_number() OVER (ORDER BY min(path)) AS i FROM a GROUP BY text), bc AS (SELECT min(path) AS file, text, count(*) AS n, row_number() OVER (ORDER BY min(path)) AS i FROM b GROUP BY text),
 ap AS (SELECT file, p, count(*) AS n FROM (SELECT file, unnest(regexp_extract_all(text, '[^
]{0,63}
|[^
]{1,64}')) AS p FROM ac) GROUP BY 1, 2), bp AS (SELECT file, p, count(*) AS n FROM (SELECT file, unnest(regexp_extract_all(text, '[^
]{0,63}
|[^
]{1,64}')) AS p FROM bc) GROUP BY 1, 2),
 s AS (SELECT ap.file AS l, bp.file AS r, sum(least(ap.n, bp.n) * strlen(p)) AS shared FROM ap JOIN bp USING (p) GROUP BY 1, 2),
 pairs AS (SELECT l, r, ac.i AS li, bc.i AS ri, ac.n AS ln, bc.n AS rn, CAST(floor(shared * 100 / greatest(strlen(ac.text), strlen(bc.text))) AS INT) AS percent,
   row_number() OVER (ORDER BY CAST(floor(shared * 100 / greatest(strlen(ac.text), strlen(bc.text))) AS INT) DESC, ac.text <> bc.text, l, r) AS place
   FROM s JOIN ac ON ac.file = l JOIN bc ON bc.file = r WHERE shared * 100 >= 50 * greatest(strlen(ac.text), strlen(bc.text))),
 walk(place, lu, ru, l, r, percent, lf, rf, n) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list_transform(range(max(i)), lambda x: 0) FROM ac), (SELECT list_transform(range(max(i)), lambda x: 0) FROM bc), '', '', 0, 0, 0, 0
  UNION ALL SELECT p.place, list_transform(lu, lambda x, i: CASE WHEN i = p.li THEN x + greatest(0, least(p.ln - lu[p.li], p.rn - ru[p.ri])) ELSE x END),
   list_transform(ru, lambda x, i: CASE WHEN i = p.ri THEN x + greatest(0, least(p.ln - lu[p.li], p.rn - ru[p.ri])) ELSE x END), p.l, p.r, p.percent, lu[p.li], ru[p.ri], least(p.ln - lu[p.li], p.rn - ru[p.ri])
  FROM walk JOIN pairs p ON p.place = walk.place + 1),
 took AS (SELECT l, r, percent, lf, rf, unnest(range(CAST(n AS BIGINT))) AS k FROM walk WHERE n > 0),
 am AS (SELECT a.path, ac.file, row_number() OVER (PARTITION BY ac.file ORDER BY a.path) - 1 AS number FROM a JOIN ac USING (text)), bm AS (SELECT b.path, bc.file, row_number() OVER (PARTITION BY bc.file ORDER BY b.path) - 1 AS number FROM b JOIN bc USING (text)),
 moved AS (SELECT bm.path, am.path AS previous_path, percent FROM took JOIN am ON am.file = l AND am.number = lf + k JOIN bm ON bm.file = r AND bm.number = rf + k)
 SELECT 'renamed' AS status, path, previous_path, 100 AS percent FROM exact UNION ALL SELECT 'copied', path, previous_path, 100 FROM copied UNION ALL SELECT 'renamed', path, previous_path, percent FROM moved
 UNION ALL SELECT 'added', path, NULL, NULL FROM b WHERE path NOT IN (SELECT path FROM moved) UNION ALL SELECT 'deleted', path, NULL, NULL FROM a WHERE path NOT IN (SELECT previous_path FROM moved)
 UNION ALL SELECT 'modified', af.path, NULL, NULL FROM af JOIN bf ON af.path = bf.path AND af.text <> bf.text""",
    "rename_history": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS commit, o_orderstatus <> 'P' AS there, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders
  UNION ALL SELECT DISTINCT o_custkey, NULL, o_custkey % 2 = 0, 0 FROM orders),
 f AS (SELECT *, CASE WHEN there AND NOT coalesce(lag(there) OVER (PARTITION BY c ORDER BY k), false) THEN 1 ELSE 0 END AS starts, lead(there) OVER (PARTITION BY c ORDER BY k) AS next, lead(commit) OVER (PARTITION BY c ORDER BY k) AS next_commit FROM o),
 g AS (SELECT *, sum(starts) OVER (PARTITION BY c ORDER BY k) AS life FROM f)
 SELECT c || '/' || (min(k) % 3) AS first_path, arg_min(commit, k) FILTER (k > 0 AND starts = 1) AS born, c || '/' || (max(k) % 3) AS last_path, max(next_commit) FILTER (next = false) AS died, count(*) - 1 AS steps
 FROM g WHERE there GROUP BY c, life""",
    "selector_resolution": f"""WITH {SYMBOLS}, q AS (SELECT path, name AS selector FROM symbols UNION SELECT path, kind FROM symbols UNION SELECT NULL, p_name || ' Brand#3' FROM part),
 k AS (SELECT id, path, name AS selector, 0 AS rank FROM symbols UNION ALL SELECT id, path, kind, 1 FROM symbols),
 m AS (SELECT q.path, q.selector, k.id, k.rank, min(k.rank) OVER (PARTITION BY q.path, q.selector) AS best FROM q LEFT JOIN k ON k.selector = q.selector AND (q.path IS NULL OR k.path = q.path))
 SELECT path, selector, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS symbol, CASE count(DISTINCT id) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state
 FROM m WHERE rank IS NULL OR rank = best GROUP BY 1, 2""",
    "container_parent": """WITH m AS (SELECT DISTINCT 'Brand#' || (l_suppkey % 25 + 1) AS path, p_name || ' ' || p_size AS container FROM lineitem JOIN part ON p_partkey = l_partkey),
 t AS (SELECT p_brand AS path, p_name || ' ' || p_size AS container, min('part:' || p_partkey) AS parent FROM part GROUP BY 1, 2 HAVING count(*) = 1) SELECT m.path, m.container, t.parent FROM m LEFT JOIN t USING (path, container)""",
    "pattern_resolution": """SELECT a.pattern, d.decision FROM (SELECT DISTINCT p_name || '/' || CASE WHEN p_size > 20 THEN p_type ELSE 'gone' END AS pattern FROM part) a
 LEFT JOIN (SELECT p_name || '/' || p_type AS pattern, arg_min('part:' || p_partkey, p_partkey) AS decision FROM part GROUP BY 1) d USING (pattern)""",
    "editor_lookup": f"""WITH {SYMBOLS}, q AS (SELECT name AS target FROM symbols UNION SELECT kind FROM symbols UNION SELECT name || '?' FROM symbols),
 k AS (SELECT id, name AS target, 0 AS rank FROM symbols UNION SELECT id, kind, 1 FROM symbols), m AS (SELECT k.*, min(rank) OVER (PARTITION BY target) AS best FROM k),
 n AS (SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY id) AS n, count(*) OVER (PARTITION BY target) AS total FROM m WHERE rank = best)
 SELECT q.target, CASE WHEN max(n.total) IS NULL THEN 'unresolved' WHEN max(n.total) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, coalesce(max(n.total), 0) AS total,
 string_agg(n.id, ',' ORDER BY n.id) FILTER (n.n <= 5) AS ids FROM q LEFT JOIN n USING (target) GROUP BY 1""",
    "note_resolution": """SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN (SELECT 'N' || min(n_nationkey) FROM nation WHERE n_regionkey = c_custkey % 8)
 ELSE (SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey = c_custkey % 40) END AS note FROM customer""",
    "github_escape": r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')) AS escaped_md5 FROM documents""",
    "diagnostic_filter": f"WITH {PATHS} SELECT page_id FROM paths WHERE contains(regexp_extract(path, '[^/]*$'), '12') OR (contains(path, '/') AND contains(regexp_replace(path, '/[^/]*$', ''), '12'))",
    "line_counts": "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS last_line FROM documents",
    "remote_callables": """SELECT p_brand AS module, p_name AS name, CAST(p_size % 3 AS BIGINT) AS arity, CASE WHEN count(*) = 1 THEN min('part:' || p_partkey) END AS target FROM part GROUP BY 1, 2, 3""",
    "clause_groups": """SELECT l_partkey AS module, CAST(a AS BIGINT) AS arity, count(*) AS clauses, min(l_orderkey) AS first_line, max(l_orderkey) AS last_line
 FROM (SELECT l_partkey, l_orderkey, unnest(range(l_linenumber % 3, l_linenumber + 1)) AS a FROM lineitem WHERE l_linenumber % 3 <= l_linenumber) GROUP BY 1, 2""",
    "snapshot_order": """WITH o AS (SELECT r_regionkey * 25 + n_nationkey AS snapshot, CASE WHEN r_regionkey < 3 THEN n_nationkey * 5 + r_regionkey END AS place, n_nationkey % 4 AS mtime FROM region, nation)
 SELECT snapshot, row_number() OVER (ORDER BY snapshot = 7, place IS NULL, place NULLS FIRST, mtime, snapshot) AS position FROM o""",
    **VALIDATION,
}
SQL["hash_tree_update"], SQL["stored_diff"] = SQL["graph_root_hash"], SQL["snapshot_diff"]
