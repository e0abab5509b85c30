"""DuckDB SQL that gives the same rows as the queries, written against the same tables."""

from __future__ import annotations

from corpusloom.functions.identifiers import STOPWORDS
from corpusloom.functions.paths import LANGUAGE_OF, SOURCE_EXTENSIONS
from corpusloom.operators.decisions import KEYWORDS
from corpusloom.operators.graph import EXTENSIONS, INDEX_FILES, LAYER_DIRS, LAYER_RANK
from corpusloom.operators.overview import ENTRY_NAMES, FRAMEWORKS


def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[\\\\/]+', '/', 'g'), '^(\\./)+', '')"


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in p) + ")" for p in pairs)


def _dir(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '^(.*/)?[^/]*$', 1), '/$', '')"


_FILES = f"""
langs(ext, lang) AS (VALUES {_values(LANGUAGE_OF.items())}),
lf0 AS (SELECT repo, {_norm("path")} AS path, file_id, ord, hash, content, scanned_at FROM (SELECT DISTINCT * FROM files WHERE removed_at IS NULL AND path IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY repo, {_norm("path")} ORDER BY scanned_at DESC NULLS LAST, file_id DESC) = 1),
lf AS (SELECT lf0.*, coalesce(lang, 'unknown') AS language FROM lf0 LEFT JOIN langs ON ext = lower(regexp_extract(path, '\\.([^./]+)$', 1)))"""
_SYMBOLS = f"sy AS (SELECT DISTINCT * REPLACE ({_norm('path')} AS path) FROM symbols WHERE removed_at IS NULL AND name IS NOT NULL)"
_IMPORTS = f"im AS (SELECT DISTINCT * REPLACE ({_norm('path')} AS path, {_norm('resolved_path')} AS resolved_path) FROM imports)"
_EDGES = """
ed AS (SELECT DISTINCT im.repo, im.path AS source, im.resolved_path AS target FROM im JOIN lf a ON a.repo = im.repo AND a.path = im.path JOIN lf b ON b.repo = im.repo AND b.path = im.resolved_path WHERE im.path <> im.resolved_path)"""
_NODES = """
deg AS (SELECT repo, path, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT repo, source AS path, 0 AS i, 1 AS o FROM ed UNION ALL SELECT repo, target, 1, 0 FROM ed) GROUP BY ALL),
esize AS (SELECT repo, count(*) AS n FROM ed GROUP BY repo),
no AS (SELECT lf.repo, lf.path, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) + coalesce(out_degree, 0) AS degree,
  coalesce(in_degree, 0) * coalesce(out_degree, 0) * 1.0e0 / greatest(coalesce(n, 0), 1) AS betweenness
  FROM lf LEFT JOIN deg USING (repo, path) LEFT JOIN esize USING (repo))"""
_dirs = _values((n, layer) for layer, names in LAYER_DIRS.items() for n in names)
_inner = " OR ".join(f"contains(source, '{n}')" for k in ("data", "model") for n in LAYER_DIRS[k])
_LAYERS = f"""
dirs(d, l) AS (VALUES {_dirs}),
parts AS (SELECT repo, path, k, lower(string_split(path, '/')[k]) AS part FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM lf)),
bydir AS (SELECT repo, path, l FROM parts JOIN dirs ON d = part QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY k) = 1),
hints AS (SELECT repo, path, bool_or({_inner}) AS inner_ FROM im WHERE source IS NOT NULL GROUP BY ALL),
exported AS (SELECT repo, path, count(*) AS n FROM sy WHERE exported AND type = 'function' GROUP BY ALL),
l0 AS (SELECT lf.repo, lf.path, bydir.l AS l, lower(regexp_replace(regexp_extract(lf.path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')) AS b, coalesce(inner_, false) AS inner_, coalesce(n, 0) AS n
  FROM lf LEFT JOIN bydir USING (repo, path) LEFT JOIN hints USING (repo, path) LEFT JOIN exported USING (repo, path)),
l1 AS (SELECT *, contains(b, '.test') OR contains(b, '.spec') OR contains(b, '_test') AS t, contains(b, 'controller') AS c, contains(b, 'service') AS s, contains(b, '.model') OR contains(b, '.entity') OR contains(b, '.schema') AS m, contains(b, '.repo') OR contains(b, 'repository') AS r FROM l0),
l2 AS (SELECT *, CASE WHEN r THEN 'data' WHEN m THEN 'model' WHEN s THEN 'service' WHEN c THEN 'controller' WHEN t THEN 'test' ELSE l END AS known,
  greatest(CASE WHEN l IS NULL THEN 0e0 ELSE 0.8e0 END, CASE WHEN t THEN 0.9e0 ELSE 0e0 END, CASE WHEN c OR s OR m OR r THEN 0.85e0 ELSE 0e0 END) AS sure FROM l1),
la AS (SELECT repo, path, CASE WHEN known IS NOT NULL THEN known WHEN inner_ THEN 'service' WHEN n > 3 THEN 'utility' WHEN b IN ('config', 'constants', 'env') THEN 'config' ELSE 'unknown' END AS layer,
  CASE WHEN known IS NOT NULL THEN sure WHEN inner_ THEN 0.5e0 WHEN n > 3 THEN 0.4e0 WHEN b IN ('config', 'constants', 'env') THEN 0.7e0 ELSE 0e0 END AS confidence FROM l2)"""


def _bounds(edges: str, name: str) -> str:
    return f"""
rank_{name}(layer, rank) AS (VALUES {_values(LAYER_RANK.items())}),
{name} AS (SELECT e.repo, f.layer AS from_layer, t.layer AS to_layer, count(*) AS edges, count(*) FILTER (rf.rank > rt.rank) AS violations, count(*) FILTER (rf.rank > rt.rank) = 0 AS allowed
  FROM {edges} e JOIN la f ON f.repo = e.repo AND f.path = e.source JOIN la t ON t.repo = e.repo AND t.path = e.target LEFT JOIN rank_{name} rf ON rf.layer = f.layer LEFT JOIN rank_{name} rt ON rt.layer = t.layer
  WHERE f.layer <> 'unknown' AND t.layer <> 'unknown' AND f.layer <> t.layer GROUP BY ALL)"""


_CALLS = """
sn AS (SELECT repo, path, CASE WHEN parent_symbol IS NULL OR parent_symbol = '' THEN name ELSE parent_symbol || '.' || name END AS name, name AS bare, symbol_id, type AS kind, exported, line, body_size FROM sy WHERE type IN ('function', 'class', 'method', 'interface')
  QUALIFY row_number() OVER (PARTITION BY repo, path, CASE WHEN parent_symbol IS NULL OR parent_symbol = '' THEN name ELSE parent_symbol || '.' || name END ORDER BY symbol_id) = 1),
lk AS (SELECT repo, path, key, name FROM (SELECT repo, path, name AS key, name, 0 AS p, symbol_id FROM sn UNION ALL SELECT repo, path, bare, name, 1, symbol_id FROM sn) QUALIFY row_number() OVER (PARTITION BY repo, path, key ORDER BY p, symbol_id) = 1),
imp AS (SELECT repo, path, root, resolved_path AS from_path FROM (SELECT repo, path, import_id, resolved_path, unnest(symbols) AS root FROM im WHERE resolved_path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY repo, path, root ORDER BY import_id DESC) = 1),
si AS (SELECT DISTINCT call_id, repo, path, CASE WHEN coalesce(caller, '') = '' THEN '<module>' ELSE caller END AS source, callee, coalesce(callee_root, callee) AS root, CASE WHEN callee_root IS NULL THEN callee ELSE substr(callee, length(callee_root) + 2) END AS member,
  CASE kind WHEN 'call' THEN 'call' WHEN 'new' THEN 'instantiation' WHEN 'extends' THEN 'inherits' WHEN 'implements' THEN 'implements' END AS kind, line FROM (SELECT DISTINCT * FROM calls) WHERE callee IS NOT NULL),
ce AS (SELECT si.call_id, si.repo, si.path, si.source, CASE WHEN o.name IS NOT NULL THEN si.path WHEN t.name IS NOT NULL THEN imp.from_path END AS target_path,
  coalesce(o.name, t.name, CASE WHEN starts_with(callee, 'external:') THEN callee ELSE 'external:' || callee END) AS target, si.kind, si.line, coalesce(o.name, t.name) IS NOT NULL AS resolved
  FROM si LEFT JOIN lk o ON o.repo = si.repo AND o.path = si.path AND o.key = si.callee LEFT JOIN imp ON imp.repo = si.repo AND imp.path = si.path AND imp.root = si.root LEFT JOIN lk t ON t.repo = si.repo AND t.path = imp.from_path AND t.key = si.member),
me AS (SELECT sn.*, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM sn
  LEFT JOIN (SELECT repo, target_path AS path, target AS name, count(*) AS n FROM ce WHERE resolved AND NOT (path = target_path AND source = target) GROUP BY ALL) i USING (repo, path, name)
  LEFT JOIN (SELECT repo, path, source AS name, count(*) AS n FROM ce GROUP BY ALL) o USING (repo, path, name))"""
_stop = ", ".join(f"'{w}'" for w in STOPWORDS)
_WORDS = """list_transform(regexp_split_to_array(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_\\-./\\\\:#]+'), lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g'))"""
_TOKENS = f"""
nm AS (SELECT repo, path, path AS name FROM lf UNION ALL SELECT repo, path, name FROM sy UNION ALL SELECT repo, path, parent_symbol FROM sy UNION ALL SELECT repo, path, source FROM im UNION ALL SELECT repo, path, unnest(symbols) FROM im),
wd AS (SELECT repo, path, unnest({_WORDS.format(x="name")}) AS term FROM nm WHERE name IS NOT NULL),
tk AS (SELECT repo, path, term, count(*) AS tf FROM wd SEMI JOIN lf USING (repo, path) WHERE length(term) >= 3 AND term NOT IN ({_stop}) GROUP BY ALL)"""
_TFIDF = """
dfr AS (SELECT repo, term, count(*) AS df FROM tk GROUP BY ALL),
vo AS (SELECT repo, term, df FROM dfr QUALIFY row_number() OVER (PARTITION BY repo ORDER BY df DESC, term) <= 5000),
rw AS (SELECT tk.repo, path, term, (1 + ln(tf)) * (1 + ln(n / df::DOUBLE)) AS w FROM tk JOIN vo USING (repo, term) JOIN (SELECT repo, count(*) AS n FROM lf GROUP BY repo) USING (repo)),
tw AS (SELECT repo, path, term, w / norm AS weight FROM rw JOIN (SELECT repo, path, sqrt(sum(w * w)) AS norm FROM rw GROUP BY ALL) USING (repo, path))"""
_RULES = "ru AS (SELECT DISTINCT * FROM rules)"
_CLAIMS = """
cl0 AS (SELECT rule_no, repo, id, description, applies_to, verification AS v, CASE WHEN verification.type = 'pattern-match' AND coalesce(verification.pattern, '') = '' THEN 'custom' ELSE verification.type END AS type FROM ru),
cl AS (SELECT rule_no, repo, id, type, CASE WHEN v.type = 'import-constraint' THEN coalesce(v.source, 'undefined') || ' -> ' || coalesce(v.forbidden, 'undefined') WHEN type = 'custom' THEN description ELSE coalesce(v.pattern, '') END AS assertion,
  CASE WHEN v.type IN ('import-constraint', 'file-exists') THEN 1e0 WHEN coalesce(v.threshold, 0) = 0 THEN CASE type WHEN 'no-pattern' THEN 0.95e0 WHEN 'naming-convention' THEN 0.9e0 ELSE 0.8e0 END ELSE v.threshold END AS threshold,
  CASE WHEN type IN ('pattern-match', 'no-pattern') THEN applies_to END AS applies_to, CASE WHEN type = 'naming-convention' THEN coalesce(v.subject, 'all') END AS subject, coalesce(v.source, 'undefined') AS source, coalesce(v.forbidden, 'undefined') AS forbidden FROM cl0)"""


def _glob(x: str) -> str:
    return f"'^' || replace(replace(replace(replace({x}, '**', chr(1)), '*', '[^/]*'), '?', '.'), chr(1), '.*') || '$'"


_SCORES = f"""
bt AS (SELECT rule_no, count(*) FILTER (contains(content, assertion)) AS m, count(*) AS n FROM lf JOIN cl USING (repo) WHERE type IN ('pattern-match', 'no-pattern') AND content IS NOT NULL AND (applies_to IS NULL OR regexp_matches(path, {_glob("applies_to")})) GROUP BY rule_no),
sc AS (SELECT rule_no, cl.forbidden, lf.repo, lf.path FROM lf JOIN cl USING (repo) WHERE type = 'import-constraint' AND regexp_matches(lf.path, {_glob("cl.source")})),
bi AS (SELECT rule_no, coalesce(sum(hit), 0)::BIGINT AS m, count(DISTINCT path) AS n FROM (SELECT rule_no, sc.path, coalesce(regexp_matches(im.resolved_path, {_glob("sc.forbidden")})::INT, 0) + coalesce(regexp_matches(im.source, {_glob("sc.forbidden")})::INT, 0) AS hit FROM sc LEFT JOIN im ON im.repo = sc.repo AND im.path = sc.path) GROUP BY rule_no),
bn AS (SELECT rule_no, count(*) FILTER (CASE assertion WHEN 'camelCase' THEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') WHEN 'snake_case' THEN regexp_matches(name, '^[a-z][a-z0-9_]*$') WHEN 'PascalCase' THEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') ELSE false END) AS m, count(*) AS n
  FROM cl JOIN sy USING (repo) WHERE cl.type = 'naming-convention' AND (subject = 'all' OR (subject = 'function' AND sy.type = 'function') OR (subject = 'class' AND sy.type IN ('class', 'interface', 'type', 'enum', 'struct')) OR (subject = 'other' AND sy.type NOT IN ('function', 'class', 'interface', 'type', 'enum', 'struct'))) GROUP BY rule_no),
bf AS (SELECT rule_no, 1 AS m, 1 AS n FROM cl WHERE type = 'file-exists' AND EXISTS (SELECT 1 FROM lf WHERE lf.repo = cl.repo AND lf.path = cl.assertion)),
cs0 AS (SELECT cl.*, coalesce(u.m, 0) AS matched, coalesce(u.n, 0) AS checked FROM cl LEFT JOIN (FROM bt UNION ALL FROM bi UNION ALL FROM bn UNION ALL FROM bf) u USING (rule_no)),
cs AS (SELECT *, CASE type WHEN 'pattern-match' THEN CASE WHEN checked > 0 THEN matched / checked::DOUBLE ELSE 0e0 END WHEN 'no-pattern' THEN CASE WHEN checked > 0 THEN (checked - matched) / checked::DOUBLE ELSE 1e0 END
  WHEN 'import-constraint' THEN CASE WHEN checked > 0 THEN greatest(0e0, 1 - matched / checked::DOUBLE) ELSE 1e0 END WHEN 'naming-convention' THEN CASE WHEN checked > 0 THEN matched / checked::DOUBLE ELSE 1e0 END WHEN 'file-exists' THEN least(matched, 1)::DOUBLE ELSE 0.5e0 END AS score FROM cs0),
rr AS (SELECT rule_no, repo, id, CASE WHEN rel >= 0.9 THEN 'valid' WHEN rel >= 0.6 THEN 'degraded' WHEN type = 'file-exists' AND score = 0 THEN 'obsolete' ELSE 'violated' END AS status, score FROM (SELECT *, least(1e0, score / CASE WHEN threshold > 0 THEN threshold ELSE 1e0 END) AS rel FROM cs)),
he AS (SELECT *, CASE WHEN score >= 90 THEN 'brightgreen' WHEN score >= 75 THEN 'green' WHEN score >= 60 THEN 'yellow' WHEN score >= 40 THEN 'orange' ELSE 'red' END AS color FROM (
  SELECT repo, count(*) AS rules, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'violated') AS violated, count(*) FILTER (status = 'obsolete') AS obsolete,
  floor((count(*) FILTER (status = 'valid') * 100 + count(*) FILTER (status = 'degraded') * 60) / count(*)::DOUBLE + 0.5)::BIGINT AS score FROM rr GROUP BY repo))"""
_BASE = [_FILES, _SYMBOLS, _IMPORTS]


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


_CHANGE = f"""
imb AS (SELECT * FROM im WHERE scanned_at < TIMESTAMP '2026-05-01'),
edb AS (SELECT DISTINCT imb.repo, imb.path AS source, imb.resolved_path AS target FROM imb JOIN lf a ON a.repo = imb.repo AND a.path = imb.path JOIN lf b ON b.repo = imb.repo AND b.path = imb.resolved_path WHERE imb.path <> imb.resolved_path),
{_bounds("edb", "bob").strip()},
ne AS (SELECT e.repo, e.source, e.target, coalesce(NOT bob.allowed, false) AS crosses_boundary, EXISTS (SELECT 1 FROM edb r WHERE r.repo = e.repo AND r.source = e.target AND r.target = e.source) AS creates_cycle
  FROM (SELECT * FROM ed EXCEPT SELECT * FROM edb) e LEFT JOIN la f ON f.repo = e.repo AND f.path = e.source LEFT JOIN la t ON t.repo = e.repo AND t.path = e.target LEFT JOIN bob ON bob.repo = e.repo AND bob.from_layer = f.layer AND bob.to_layer = t.layer),
cc AS (SELECT n.repo, n.path, n.d AS before, n.d + m AS after, n.d + m >= 8 AS risk FROM (SELECT lf.repo, lf.path, (SELECT count(*) FROM edb WHERE edb.repo = lf.repo AND (edb.source = lf.path)) + (SELECT count(*) FROM edb WHERE edb.repo = lf.repo AND edb.target = lf.path) AS d FROM lf) n JOIN (SELECT repo, source AS path, count(*) AS m FROM ne GROUP BY ALL) USING (repo, path)),
rh AS (SELECT DISTINCT ne.repo, rule_no, source, target FROM ne JOIN (SELECT DISTINCT rule_no, repo, regexp_replace(regexp_replace(verification.forbidden, '^(.*?)/\\*\\*', '\\1'), '^(.*?)/\\*', '\\1') AS f FROM rules WHERE verification.type = 'import-constraint' AND verification.forbidden IS NOT NULL) r ON r.repo = ne.repo AND contains(ne.target, f))"""
_key_sql = " OR ".join(f"contains(lower(message), '{k}')" for k in KEYWORDS)
_DECISIONS = f"""
cd AS (SELECT 'commit-' || doc_id || '-' || substr(regexp_replace(regexp_replace(lower(message), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 30) AS id, doc_id, repo, regexp_replace(message, '^(refactor|feat|fix|chore|arch|breaking):\\s*', '', 'i') AS title, decided_at, 'commit' AS kind
  FROM (SELECT doc_id, source AS repo, trim(split_part(text, chr(10), 1), ' ') AS message, created_at AS decided_at FROM documents WHERE kind = 'commit' AND text IS NOT NULL) WHERE message <> '' AND ({_key_sql})),
ad AS (SELECT 'adr-' || doc_id AS id, repo, CASE WHEN ti = '' THEN 'adr-' || doc_id ELSE ti END AS title, decided_at, 'adr' AS kind, CASE WHEN st = '' THEN 'active' ELSE st END AS status FROM (
  SELECT doc_id, source AS repo, created_at AS decided_at, trim(regexp_extract(t, '(?m)^#[ \\t]+(.+)', 1), ' ') AS ti, lower(regexp_extract(t, '(?i)## Status\\s*\\n\\s*(\\w+)', 1)) AS st FROM (SELECT *, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents WHERE kind = 'adr' AND text IS NOT NULL AND trim(text, ' ') <> ''))),
de AS (SELECT id, repo, title, decided_at, kind FROM ad UNION ALL (SELECT id, repo, title, decided_at, kind FROM cd ANTI JOIN ad USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY decided_at, title, kind) = 1))"""

_P3 = f"""
parents AS (
  SELECT DISTINCT 'F' AS kind, repo, {_norm("path")} AS k, scanned_at AS born, removed_at AS died FROM files
  UNION SELECT DISTINCT 'S', repo, CASE WHEN parent_symbol IS NULL THEN name ELSE parent_symbol || '.' || name END, scanned_at, removed_at FROM symbols),
refs AS (
  SELECT DISTINCT 'imports' AS ref_table, import_id AS ref_id, 0 AS ref_pos, 'F' AS kind, repo, {_norm("resolved_path")} AS k, scanned_at AS seen FROM imports WHERE resolved_path IS NOT NULL
  UNION SELECT DISTINCT 'calls', call_id, 0, 'S', repo, callee, scanned_at FROM calls WHERE callee IS NOT NULL AND NOT starts_with(callee, 'external:')
  UNION SELECT DISTINCT 'rules', rule_no, p::INT, 'F', repo, {_norm("evidence[p].file")}, mined_at FROM (SELECT *, unnest(range(1, len(evidence) + 1)) AS p FROM rules) WHERE evidence[p].file IS NOT NULL),
orphan AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.kind = r.kind AND p.repo IS NOT DISTINCT FROM r.repo AND p.k = r.k AND r.seen >= p.born AND (p.died IS NULL OR r.seen < p.died)))"""

_PAIRS = """
sg AS (SELECT repo, path, string_agg(term || '=' || floor(weight * 10000 + 0.5)::BIGINT, ',' ORDER BY floor(weight * 10000 + 0.5) DESC, term) AS g FROM tw GROUP BY ALL),
sm AS (SELECT repo, path, min(path) OVER (PARTITION BY repo, g) AS same FROM sg),
rep AS (SELECT tw.* FROM tw SEMI JOIN (SELECT repo, path FROM sm WHERE path = same) USING (repo, path)),
pr AS (SELECT a.repo, a.path AS a, b.path AS b, sum(a.weight * b.weight) AS cosine FROM rep a JOIN rep b ON a.repo = b.repo AND a.term = b.term AND a.path < b.path GROUP BY ALL),
e5 AS (SELECT repo, a, b FROM pr WHERE cosine >= 0.3 UNION SELECT repo, path, same FROM sm WHERE path <> same),
e5b AS (SELECT repo, a, b FROM e5 UNION SELECT repo, b, a FROM e5),
walk AS (SELECT repo, a AS path, a AS node FROM e5b UNION SELECT w.repo, w.path, e.b FROM walk w JOIN e5b e ON e.repo = w.repo AND e.a = w.node),
co AS (SELECT repo, path, min(node) AS component FROM walk GROUP BY ALL)"""
_base_ed = [*_BASE, _EDGES]
_exts = _values((k, e) for k, e in enumerate(EXTENSIONS))
_idx = _values((len(EXTENSIONS) * 2 + k, "/" + e) for k, e in enumerate(INDEX_FILES))

SQL = {
    "p3_found": _with(_P3) + "SELECT ref_table, ref_id, ref_pos::INT AS ref_pos FROM orphan",
    "p3_counts": _with(_P3) + "SELECT ref_table, strftime(seen, '%Y-%m') AS month, count(*) AS orphans FROM orphan GROUP BY ALL",
    "language_breakdown": _with(_FILES) + "SELECT repo, language, count(*) AS files FROM lf GROUP BY ALL",
    "top_directories": _with(_FILES) + f"""SELECT repo, dir, files, language FROM (
      SELECT repo, dir, sum(n)::BIGINT AS files, arg_min(language, (-n, language)) AS language FROM (SELECT repo, {_dir("path")} AS dir, language, count(*) AS n FROM lf GROUP BY ALL) WHERE dir <> '' GROUP BY ALL HAVING sum(n) >= 2)
      QUALIFY row_number() OVER (PARTITION BY repo ORDER BY files DESC, dir) <= 12""",
    "content_copies": _with(_FILES) + "SELECT substr(sha256(content), 1, 16) AS hash, count(*) AS files, count(DISTINCT repo) AS repos FROM lf WHERE content IS NOT NULL AND content <> '' GROUP BY 1 HAVING count(*) > 1",
    "incremental_scan": _with(_FILES) + f"""SELECT lf.repo, count(*) FILTER (coalesce(lf.hash = was, false)) AS reuse, count(*) FILTER (NOT coalesce(lf.hash = was, false)) AS parse FROM lf
      LEFT JOIN (SELECT repo, {_norm("path")} AS path, arg_max(hash, (scanned_at, file_id)) AS was FROM files WHERE scanned_at < TIMESTAMP '2026-01-01' AND path IS NOT NULL GROUP BY ALL) b USING (repo, path) GROUP BY lf.repo""",
    "scannable_files": _with(_FILES) + f"""SELECT file_id, path FROM lf WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ({", ".join(f"'{x}'" for x in SOURCE_EXTENSIONS)})
      AND NOT regexp_matches(path, '^node_modules/.*$|^.*/node_modules/.*$|^vendor/.*$|^dist/.*$|^build/.*$|^.*/[^/]*.min.js$')
      AND NOT list_bool_or(list_transform(string_split(path, '/'), lambda s: starts_with(s, '.') AND s NOT IN ('.github', '.cursor', '.vscode'))) AND octet_length(encode(content)) BETWEEN 1 AND 1048576""",
    "corpus_totals": _with(*_BASE) + "SELECT repo, count(*) FILTER (k = 'f') AS files, count(*) FILTER (k = 's') AS symbols, count(*) FILTER (k = 'i') AS imports FROM (SELECT repo, 'f' AS k FROM lf UNION ALL SELECT repo, 's' FROM sy UNION ALL SELECT repo, 'i' FROM im) GROUP BY repo",
    "resolved_imports": _with(_FILES, _IMPORTS, f"""
ext(k, e) AS (VALUES {_exts}), idx(k, e) AS (VALUES {_idx}),
rel AS (SELECT import_id, repo, path, source, CASE WHEN starts_with(source, '@/') THEN 'src/' || substr(source, 3) WHEN starts_with(source, '.') OR starts_with(source, '/') THEN {_dir("path")} || '/' || source END AS raw FROM im),
seg AS (SELECT import_id, repo, path, source, list_filter(string_split(raw, '/'), lambda s: s NOT IN ('', '.')) AS s FROM rel WHERE raw IS NOT NULL),
st AS (SELECT import_id, s, 1 AS k, []::VARCHAR[] AS o FROM seg UNION ALL SELECT import_id, s, k + 1, CASE WHEN s[k] = '..' AND len(o) > 0 AND o[-1] <> '..' THEN o[:-2] ELSE list_append(o, s[k]) END FROM st WHERE k <= len(s)),
ba AS (SELECT seg.import_id, repo, path, source, array_to_string(o, '/') AS base FROM seg JOIN st ON st.import_id = seg.import_id AND st.k = len(seg.s) + 1),
bs AS (SELECT *, 0 AS z FROM ba UNION SELECT import_id, repo, path, source, regexp_replace(base, '\\.(js|jsx|mjs|cjs)$', ''), CASE WHEN regexp_matches(base, '\\.(js|jsx|mjs|cjs)$') THEN 1 ELSE 0 END FROM ba),
ca AS (SELECT import_id, repo, path, source, base || e AS candidate, z * {len(EXTENSIONS)} + k AS r FROM bs, ext UNION ALL SELECT import_id, repo, path, source, base || e, 1000 + z * 100 + k FROM bs, idx)""")
    + "SELECT import_id, ca.repo, ca.path, source, arg_min(candidate, r) AS target FROM ca JOIN lf ON lf.repo = ca.repo AND lf.path = ca.candidate GROUP BY ALL",
    "import_edges": _with(*_base_ed) + "FROM ed",
    "degree_betweenness": _with(*_base_ed, _NODES) + "FROM no",
    "hub_files": _with(*_base_ed, _NODES) + "SELECT repo, path, degree FROM no WHERE degree >= 8",
    "architecture_top10": _with(*_base_ed, _NODES) + "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY degree DESC, path)::INT AS rank, path, degree FROM no QUALIFY rank <= 10",
    "file_layers": _with(*_BASE, _LAYERS) + "FROM la",
    "layer_boundaries": _with(*_base_ed, _LAYERS, _bounds("ed", "bo")) + "FROM bo",
    "boundary_rules": _with(*_base_ed, _LAYERS, _bounds("ed", "bo")) + "SELECT repo, 'architecture-no-' || from_layer || '-to-' || to_layer AS id, from_layer || '/**' AS source, to_layer || '/**' AS forbidden, violations FROM bo WHERE violations > 0",
    "files_on_cycles": _with(*_base_ed, "reach AS (SELECT repo, source, target FROM ed UNION SELECT r.repo, r.source, e.target FROM reach r JOIN ed e ON e.repo = r.repo AND e.source = r.target)") + "SELECT repo, source AS path FROM reach WHERE source = target",
    "dependencies": _with(*_base_ed, _NODES, _LAYERS) + """SELECT no.repo, no.path, coalesce(layer, 'unknown') AS layer, degree, coalesce(o, []) AS imports, coalesce(i, []) AS imported_by FROM no
      LEFT JOIN (SELECT repo, source AS path, list(target ORDER BY target) AS o FROM ed GROUP BY ALL) USING (repo, path) LEFT JOIN (SELECT repo, target AS path, list(source ORDER BY source) AS i FROM ed GROUP BY ALL) USING (repo, path) LEFT JOIN la USING (repo, path) WHERE degree > 0""",
    "call_edges": _with(_SYMBOLS, _IMPORTS, _CALLS) + "FROM ce",
    "fan_in_out": _with(_SYMBOLS, _IMPORTS, _CALLS) + "SELECT repo, path, name, kind, fan_in, fan_out FROM me",
    "hotspots": _with(_SYMBOLS, _IMPORTS, _CALLS) + "SELECT repo, path, name, kind, fan_in, fan_out FROM me WHERE kind IN ('function', 'method') AND fan_in >= 3",
    "callgraph_top10": _with(_SYMBOLS, _IMPORTS, _CALLS) + "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY fan_in DESC, path, name)::INT AS rank, path, name, fan_in, fan_out FROM me QUALIFY rank <= 10",
    "god_classes": _with(_SYMBOLS, _IMPORTS, _CALLS) + """SELECT * FROM (SELECT c.repo, c.path, c.name, coalesce(m.n, 0) AS methods, (c.fan_in + coalesce(m.f, 0))::BIGINT AS total_fan_in FROM me c
      LEFT JOIN (SELECT repo, path, split_part(name, '.', 1) AS name, count(*) AS n, sum(fan_in) AS f FROM me WHERE kind = 'method' GROUP BY ALL) m USING (repo, path, name) WHERE c.kind = 'class') WHERE methods >= 5 OR total_fan_in >= 5""",
    "p90_length": _with(_SYMBOLS) + "SELECT repo, count(*) AS functions, list_sort(list(body_size))[floor(count(*) * 0.9)::INT + 1] AS p90 FROM sy WHERE type IN ('function', 'method') AND body_size IS NOT NULL GROUP BY repo HAVING count(*) >= 20",
    "identifier_terms": _with(*_BASE, _TOKENS) + "FROM tk",
    "vocabulary": _with(*_BASE, _TOKENS, _TFIDF) + "FROM vo",
    "tfidf_weights": _with(*_BASE, _TOKENS, _TFIDF) + "SELECT repo, path, term, floor(weight * 10000 + 0.5) / 10000 AS weight FROM tw",
    "cosine_pairs": _with(*_BASE, _TOKENS, _TFIDF, _PAIRS) + "SELECT repo, a, b, floor(cosine * 1000 + 0.5) / 1000 AS cosine FROM pr WHERE cosine >= 0.3",
    "similar_files": _with(*_BASE, _TOKENS, _TFIDF) + """SELECT repo, query, path, cosine, row_number() OVER (PARTITION BY repo, query ORDER BY cosine DESC, path)::INT AS rank FROM (
      SELECT q.repo, q.path AS query, t.path, floor(sum(q.weight * t.weight) * 1000 + 0.5) / 1000 AS cosine FROM tw q JOIN lf ON lf.repo = q.repo AND lf.path = q.path AND lf.file_id % 100 = 0 JOIN tw t ON t.repo = q.repo AND t.term = q.term AND t.path <> q.path GROUP BY ALL) WHERE cosine > 0 QUALIFY rank <= 5""",
    "rule_similar_files": _with(*_BASE, _RULES, _TOKENS, _TFIDF, f"""
rt AS (SELECT repo, rule_no::VARCHAR AS query, term, 1 + ln(count(*)) AS w FROM (SELECT repo, rule_no, unnest({_WORDS.format(x="concat_ws(' ', id, verification.pattern, verification.source, verification.forbidden)")}) AS term FROM ru) WHERE length(term) >= 3 AND term NOT IN ({_stop}) GROUP BY ALL),
rq AS (SELECT repo, query, term, w / norm AS weight FROM rt JOIN (SELECT repo, query, sqrt(sum(w * w)) AS norm FROM rt GROUP BY ALL) USING (repo, query))""")
    + "SELECT repo, query, path, cosine, row_number() OVER (PARTITION BY repo, query ORDER BY cosine DESC, path)::INT AS rank FROM (SELECT q.repo, query, path, floor(sum(q.weight * t.weight) * 1000 + 0.5) / 1000 AS cosine FROM rq q JOIN tw t ON t.repo = q.repo AND t.term = q.term GROUP BY ALL) WHERE cosine > 0 QUALIFY rank <= 3",
    "clusters_at_threshold": _with(*_BASE, _TOKENS, _TFIDF, _PAIRS) + "FROM co",
    "cluster_cohesion": _with(*_BASE, _TOKENS, _TFIDF, _PAIRS) + """SELECT repo, component, files, floor(s / (files * (files - 1) / 2) * 1000 + 0.5) / 1000 AS cohesion FROM (SELECT repo, component, count(*) AS files FROM co GROUP BY ALL) JOIN (
      SELECT x.repo, x.component, sum(p.weight * q.weight) AS s FROM co x JOIN co y ON x.repo = y.repo AND x.component = y.component AND x.path < y.path JOIN tw p ON p.repo = x.repo AND p.path = x.path JOIN tw q ON q.repo = y.repo AND q.path = y.path AND q.term = p.term GROUP BY ALL) USING (repo, component) WHERE files > 1""",
    "cluster_imports": _with(_FILES, _IMPORTS) + f"""SELECT repo, component, source, count(*) AS files FROM (SELECT DISTINCT lf.repo, {_dir("lf.path")} AS component, lf.path, source FROM lf JOIN im ON im.repo = lf.repo AND im.path = lf.path WHERE source IS NOT NULL)
      JOIN (SELECT repo, {_dir("path")} AS component, count(*) AS members FROM lf GROUP BY ALL HAVING count(*) >= 4) USING (repo, component) GROUP BY repo, component, source, members HAVING count(*) >= members * 0.2""",
    "claims": _with(_RULES, _CLAIMS) + "SELECT rule_no, repo, type, assertion, threshold, applies_to, subject FROM cl",
    "claim_scores": _with(*_BASE, _RULES, _CLAIMS, _SCORES) + "SELECT rule_no, type, matched, checked, score FROM cs",
    "rule_status": _with(*_BASE, _RULES, _CLAIMS, _SCORES) + "FROM rr",
    "context_health": _with(*_BASE, _RULES, _CLAIMS, _SCORES) + "FROM he",
    "quick_verify": _with(*_BASE, "ru AS (SELECT DISTINCT * FROM rules WHERE severity = 'critical')", _CLAIMS, _SCORES) + "FROM he",
    "rule_projection": _with(_RULES) + "SELECT rule_no, repo, id, category, severity, priority, CASE WHEN enhanced IS NOT NULL AND NOT coalesce(enhanced.stale, false) THEN coalesce(enhanced.description, description) ELSE description END AS description FROM ru",
    "rules_to_enhance": _with(_RULES) + "SELECT rule_no, repo, id FROM ru WHERE enhanced IS NULL OR coalesce(enhanced.stale, false)",
    "prompt_batches": _with(_RULES) + "SELECT repo, batch, count(*) AS rules, list(rule_no ORDER BY rule_no) AS ids FROM (SELECT repo, rule_no, (row_number() OVER (PARTITION BY repo ORDER BY priority DESC, rule_no) - 1) // 10 AS batch FROM ru WHERE enhanced IS NULL OR coalesce(enhanced.stale, false)) GROUP BY ALL",
    "category_summary": _with(_RULES) + "SELECT repo, category, count(*) AS rules, count(*) FILTER (severity = 'critical') AS critical, sum(coalesce(len(evidence), 0))::BIGINT AS evidence FROM ru GROUP BY ALL",
    "rules_markdown": _with(_RULES, """
en AS (SELECT repo, rule_no, priority, coalesce(category, 'patterns') AS category, chr(10) || '- [' || coalesce(severity, 'info') || '] ' || coalesce(CASE WHEN enhanced IS NOT NULL AND NOT coalesce(enhanced.stale, false) THEN coalesce(enhanced.description, description) ELSE description END, '')
  || array_to_string(list_transform(list_filter(coalesce(evidence, []), lambda e: e.file IS NOT NULL)[:3], lambda e: chr(10) || '  - ' || e.file || coalesce(':' || e.line::VARCHAR, '')), '') AS entry FROM ru),
se AS (SELECT repo, category, '## ' || category || string_agg(entry, '' ORDER BY -coalesce(priority, 0), rule_no) AS section FROM en GROUP BY repo, category)""")
    + "SELECT repo, string_agg(section, chr(10) || chr(10) ORDER BY category, section) AS document FROM se GROUP BY repo",
    "new_edges": _with(*_base_ed, _LAYERS, _CHANGE) + "FROM ne",
    "complexity_changes": _with(*_base_ed, _LAYERS, _CHANGE) + "FROM cc",
    "rule_hits": _with(*_base_ed, _LAYERS, _CHANGE) + "FROM rh",
    "review_summary": _with(*_base_ed, _LAYERS, _CHANGE) + """SELECT repo, files, v AS violations, w AS warnings, greatest(0, files - v - w) AS clean FROM (SELECT f.repo, f.n AS files,
      (SELECT count(*) FROM ne WHERE ne.repo = f.repo AND crosses_boundary) + (SELECT count(*) FROM ne WHERE ne.repo = f.repo AND creates_cycle) + (SELECT count(*) FROM rh WHERE rh.repo = f.repo) AS v, (SELECT count(*) FROM cc WHERE cc.repo = f.repo AND risk) AS w FROM (SELECT repo, count(DISTINCT source) AS n FROM ne GROUP BY repo) f)""",
    "diff_files": _with(_FILES) + """SELECT repo, path, NULL::VARCHAR AS old_path, 'added' AS status, len(l) AS added, 0::BIGINT AS removed,
      len(list_filter(l, lambda x: regexp_matches(x, '^\\s*import\\s+|^\\s*from\\s+|require\\s*\\(|^\\s*use\\s+') AND NOT starts_with(x, '++'))) AS added_imports, 0::BIGINT AS removed_imports,
      len(list_filter(l, lambda x: regexp_matches(x, '(?:async\\s+)?function\\s+\\w+|class\\s+\\w+|(?:const|let)\\s+\\w+\\s*=.*=>'))) AS added_symbols FROM (SELECT repo, path, list_filter(string_split(regexp_replace(content, '\\n$', ''), chr(10)), lambda x: NOT starts_with(x, '++')) AS l FROM lf WHERE content IS NOT NULL AND content <> '')""",
    "commit_decisions": _with(_DECISIONS) + "SELECT id, doc_id, repo, title, decided_at, kind FROM cd",
    "record_decisions": _with(_DECISIONS) + "SELECT id, repo, title, status FROM ad",
    "decision_merge": _with(_DECISIONS) + "FROM de",
    "decision_rules": _with(_DECISIONS) + "SELECT DISTINCT d.id, rule_no FROM de d JOIN (SELECT DISTINCT rule_no, repo, id AS rule_id, category FROM rules) r ON r.repo = d.repo WHERE contains(rule_id, d.id) OR contains(d.id, rule_id) OR contains(lower(title), category)",
    "decision_timeline": _with(_DECISIONS) + "SELECT repo, strftime(decided_at, '%Y-%m') AS month, count(*) AS decisions, arg_min(title, (decided_at, id)) AS first_title FROM de GROUP BY ALL",
}

SQL |= {
    "frameworks": _with(_IMPORTS, f"fw(k, p, n) AS (VALUES {_values((k, p, n) for k, (p, n) in enumerate(FRAMEWORKS))})") + "SELECT repo, arg_min(n, k) AS framework FROM im JOIN fw ON starts_with(source, p) GROUP BY repo",
    "entry_points": _with(_FILES) + f"SELECT repo, path FROM lf WHERE regexp_extract(path, '([^/]*)$', 1) IN ({', '.join(repr(x) for x in ENTRY_NAMES)}) OR (regexp_matches(path, '^cmd/[^/]+/[^/]+$') AND language = 'go') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY len(string_split(path, '/')), path) <= 8",
    "external_packages": _with(_IMPORTS) + "SELECT repo, package, count(*) AS files FROM (SELECT DISTINCT repo, CASE WHEN starts_with(source, '@') THEN regexp_extract(source, '^(@[^/]+/[^/]+)', 1) ELSE split_part(source, '/', 1) END AS package, path FROM im WHERE source IS NOT NULL AND resolved_path IS NULL AND NOT regexp_matches(source, '^[./#~]|^@/')) GROUP BY ALL HAVING count(*) >= 2",
    "similar_suggestions": _with(*_BASE, _TOKENS, _TFIDF) + """SELECT repo, query AS path, path AS "like", cosine FROM (SELECT repo, query, path, cosine FROM (
      SELECT q.repo, q.path AS query, t.path, floor(sum(q.weight * t.weight) * 1000 + 0.5) / 1000 AS cosine FROM tw q JOIN lf ON lf.repo = q.repo AND lf.path = q.path AND lf.scanned_at >= TIMESTAMP '2026-05-01' JOIN tw t ON t.repo = q.repo AND t.term = q.term AND t.path <> q.path GROUP BY ALL) WHERE cosine > 0 QUALIFY row_number() OVER (PARTITION BY repo, query ORDER BY cosine DESC, path) = 1) WHERE cosine >= 0.1""",
    "pattern_adoption": _with(_FILES) + "SELECT repo, strftime(scanned_at, '%Y-%m') AS month, count(*) AS files, count(*) FILTER (contains(content, 'async ')) AS matching FROM lf WHERE content IS NOT NULL AND scanned_at IS NOT NULL GROUP BY ALL",
    "snapshot_retention": "SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50",
    "metric_trend": "SELECT event_type, ts::DATE AS day, count(*) AS n, floor(avg(value) * 1000 + 0.5) / 1000 AS mean FROM events WHERE value > 0 GROUP BY ALL",
}

from corpusloom.plans import oracle_lines  # noqa: E402

SQL |= oracle_lines.SQL
