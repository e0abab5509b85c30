"""DuckDB SQL of the queries over source lines and mined conventions."""

from __future__ import annotations

from corpusloom.operators.extract import EXPORTED, EXPORTS, IMPORTS, MARKER, SYMBOLS
from corpusloom.operators.mining import FEATURE_FOLDERS, LAYER_FOLDERS
from corpusloom.operators.rules import CHECKS
from corpusloom.plans.oracle import _BASE, _CALLS, _FILES, _IMPORTS, _PAIRS, _RULES, _SYMBOLS, _TFIDF, _TOKENS, _dir, _with

_LINES = r"""
sl0 AS (SELECT file_id, repo, path, language, CASE WHEN language IN ('typescript', 'javascript') THEN 'script' ELSE language END AS family, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, string_split(content, chr(10)) AS ls FROM lf WHERE content IS NOT NULL AND content <> ''),
sl AS (SELECT file_id, repo, path, language, family, line, regexp_replace(ls[line], '^\s+|\s+$', '', 'g') AS text FROM sl0 WHERE regexp_replace(ls[line], '^\s+|\s+$', '', 'g') <> '')"""


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _first(patterns: list[tuple[str, str, str]]) -> tuple[str, str]:
    """CASE expressions of the kind and group 1 of the first pattern that matches."""
    hits = [(f"family = '{of}' AND regexp_matches(text, {_quoted(p)})", name, f"regexp_extract(text, {_quoted(p)}, 1)") for of, name, p in patterns]
    return "CASE " + " ".join(f"WHEN {h} THEN '{n}'" for h, n, _ in hits) + " END", "CASE " + " ".join(f"WHEN {h} THEN {v}" for h, _, v in hits) + " END"


_ik, _iv = _first(IMPORTS)
_sk, _sv = _first(SYMBOLS)
_xk, _xv = _first(EXPORTS)
_EXPORTS = f"ex AS (SELECT file_id, line, {_xk} AS type, CASE WHEN {_xv} = '' THEN 'default' ELSE {_xv} END AS name FROM sl WHERE {_xk} IS NOT NULL)"
_base = "regexp_extract(lf.path, '([^/]*)$', 1)"
_FACTS = rf"""
fs AS (SELECT repo, path, count(*) FILTER (type = 'function') AS functions, count(*) FILTER (type = 'function' AND regexp_matches(name, '^[a-z][a-zA-Z0-9]*$')) AS camel, count(*) FILTER (type = 'function' AND regexp_matches(name, '^[a-z][a-z0-9_]*$') AND contains(name, '_')) AS snake,
  count(*) FILTER (type IN ('class', 'interface')) AS classes, count(*) FILTER (type IN ('class', 'interface') AND regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')) AS pascal, count(*) FILTER (type = 'interface') AS interfaces, count(*) FILTER (type = 'type') AS aliases, count(*) FILTER (type = 'class') AS structs, bool_or(contains(name, 'Result')) AS rs FROM sy GROUP BY ALL),
fi AS (SELECT repo, path, bool_or(list_bool_or(list_transform(coalesce(symbols, []), lambda x: contains(x, 'Result')))) AS ri, count(*) FILTER (starts_with(source, '.')) AS relative, count(*) FILTER (starts_with(source, '@/') OR starts_with(source, '~/') OR starts_with(source, '#')) AS alias,
  count(*) FILTER (NOT starts_with(source, '.') AND NOT starts_with(source, '/') AND NOT contains(source, 'node_modules') AND NOT starts_with(source, '@')) AS bare, bool_or(source = 'zustand' OR starts_with(source, 'zustand/')) AS zustand, bool_or(source IN ('redux', '@reduxjs/toolkit') OR starts_with(source, 'react-redux')) AS redux,
  bool_or(source IN ('@tanstack/react-query', 'react-query')) AS query, bool_or(source = 'zod' OR starts_with(source, 'zod/')) AS zod, bool_or(regexp_matches(lower(source), '/service|/controller|/handler')) AS up, bool_or(regexp_matches(lower(source), '/controller|/handler|/route')) AS entry FROM im WHERE source IS NOT NULL GROUP BY ALL),
fe AS (SELECT file_id, bool_or(type = 'named') AS named, bool_or(type = 'default') AS dflt FROM ex GROUP BY ALL),
ff AS (SELECT lf.repo, lf.path, language IN ('typescript', 'javascript') AS script, language = 'go' AS go, language = 'typescript' AS ts, {_dir("lf.path")} AS dir, CASE WHEN contains(lf.path, '/') THEN split_part(lf.path, '/', 1) END AS root, regexp_replace({_base}, '(.)\.[^.]*$', '\1') AS stem, {_base} AS b, coalesce(lf.content, '') AS t,
  contains({_base}, '.test.') OR contains({_base}, '.spec.') OR contains({_base}, '_test.') OR contains(lf.path, '__tests__/') OR contains(lf.path, '/tests/') AS test,
  list_bool_or(list_transform(string_split(lower(lf.path), '/'), lambda x: x IN ('services', 'service'))) AS in_service, list_bool_or(list_transform(string_split(lower(lf.path), '/'), lambda x: x IN ('utils', 'helpers', 'lib'))) AS in_util, fs.* EXCLUDE (repo, path), fi.* EXCLUDE (repo, path), coalesce(named, false) AS named, coalesce(dflt, false) AS dflt
  FROM lf LEFT JOIN fs ON fs.repo = lf.repo AND fs.path = lf.path LEFT JOIN fi ON fi.repo = lf.repo AND fi.path = lf.path LEFT JOIN fe ON fe.file_id = lf.file_id),
fd AS (SELECT ff.*, EXISTS (SELECT 1 FROM ff o WHERE o.repo = ff.repo AND o.dir = ff.dir AND NOT o.test) AS has_source FROM ff),
k AS (SELECT repo, count(*) AS files, count(*) FILTER (script) AS scripts, count(*) FILTER (go) AS gos, count(*) FILTER (ts) AS tss, coalesce(sum(functions), 0) AS functions, coalesce(sum(camel), 0) AS camel, coalesce(sum(snake), 0) AS snake, coalesce(sum(classes), 0) AS classes, coalesce(sum(pascal), 0) AS pascal,
  count(*) FILTER (regexp_matches(stem, '^[a-z][a-z0-9-]*$') AND contains(stem, '-')) AS kebabf, count(*) FILTER (regexp_matches(stem, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches(stem, '[A-Z]')) AS camelf, count(*) FILTER (regexp_matches(stem, '^[A-Z][a-zA-Z0-9]*$')) AS pascalf,
  count(*) FILTER (script AND (coalesce(rs, false) OR coalesce(ri, false))) AS results, count(*) FILTER (script AND regexp_matches(t, 'try\s*\{{')) AS tryf, count(*) FILTER (script AND regexp_matches(t, '\.catch\s*\(')) AS promf, count(*) FILTER (script AND regexp_matches(t, '\basync\s+function|\basync\s+\(')) AS asyncf, count(*) FILTER (script AND regexp_matches(t, 'new Promise\s*\(')) AS newp,
  count(*) FILTER (go AND contains(t, 'if err != nil')) AS errf, count(*) FILTER (go AND regexp_matches(t, '\bpanic\s*\(')) AS panicf, count(*) FILTER (go AND regexp_matches(t, 'func\s+\w+\s*\(\s*ctx\s+context\.Context')) AS ctxf, coalesce(sum(len(regexp_extract_all(t, 'func\s*\(\s*\w+\s+\*\w+\)'))) FILTER (go), 0) AS receivers, coalesce(sum(structs) FILTER (go), 0) AS structs,
  count(*) FILTER (go AND regexp_matches(lower(path), 'handler|route')) AS handf, count(*) FILTER (go AND regexp_matches(lower(path), 'handler|route') AND contains(t, 'gin.Context')) AS ginf, count(*) FILTER (go AND regexp_matches(lower(path), 'handler|route') AND contains(t, 'http.ResponseWriter') AND contains(t, '*http.Request')) AS netf,
  bool_or(go AND contains(lower(dir), 'handler')) AS hdir, bool_or(go AND contains(lower(dir), 'service')) AS sdir, bool_or(regexp_matches(root, '(?i)^(frontend|web|client|ui|app)$')) AS front, bool_or(regexp_matches(root, '(?i)^(backend|server|api|cmd|internal|service|services)$')) AS back, bool_or(regexp_matches(root, '(?i)^(shared|common|types|contracts|proto|schema)$')) AS shared,
  count(*) FILTER (script AND ((in_util AND coalesce(up, false)) OR (in_service AND coalesce(entry, false)))) AS viol, count(*) FILTER (script AND contains(path, '/app/') AND regexp_matches(path, '(page\.tsx?|layout\.tsx)$')) AS appf, count(*) FILTER (script AND contains(path, '/pages/') AND NOT contains(path, '/_')) AS pagef,
  count(*) FILTER (script AND contains(path, '/app/') AND regexp_matches(path, '(page\.tsx?|layout\.tsx)$') AND (contains(t, '"use client"') OR contains(t, '''use client'''))) AS clif, count(*) FILTER (script AND b IN ('index.ts', 'index.js') AND (named OR dflt)) AS barrels, count(*) FILTER (script AND contains(path, '/')) AS nested,
  count(*) FILTER (script AND named) AS namedf, count(*) FILTER (script AND dflt) AS dfltf, coalesce(sum(relative) FILTER (script), 0) AS relative, coalesce(sum(alias) FILTER (script), 0) AS alias, coalesce(sum(bare) FILTER (script), 0) AS bare, count(*) FILTER (script AND zustand) AS zusf, count(*) FILTER (script AND redux) AS redf, count(*) FILTER (script AND query) AS qf,
  count(DISTINCT root) FILTER (root IN ({", ".join(map(_quoted, LAYER_FOLDERS))})) AS layers, count(DISTINCT root) FILTER (root IN ({", ".join(map(_quoted, FEATURE_FOLDERS))})) AS features,
  count(*) FILTER (test) AS tests, count(*) FILTER (test AND has_source) AS colo, count(*) FILTER (test AND contains(b, '.test.')) AS dott, count(*) FILTER (test AND contains(b, '.spec.')) AS dots, count(*) FILTER (test AND contains(b, '_test.go')) AS gott, coalesce(sum(interfaces) FILTER (ts), 0) AS interfaces, coalesce(sum(aliases) FILTER (ts), 0) AS aliases, count(*) FILTER (ts AND zod) AS zodf FROM fd GROUP BY repo)"""

# (pattern, matched, population, emitted if, constant prevalence)
_PATTERNS = [
    ("naming-functions-camelcase", "camel", "functions", "functions > 3 AND camel / functions::DOUBLE >= 0.7", None),
    ("naming-functions-snake-case", "snake", "functions", "functions > 3 AND snake / functions::DOUBLE >= 0.7", None),
    ("naming-classes-pascalcase", "pascal", "classes", "classes > 2 AND pascal / classes::DOUBLE >= 0.7", None),
    ("naming-files-kebab-case", "kebabf", "files", "kebabf / files::DOUBLE >= 0.4", None),
    ("naming-files-camelcase", "camelf", "files", "kebabf / files::DOUBLE < 0.4 AND camelf / files::DOUBLE >= 0.4", None),
    ("naming-files-pascalcase", "pascalf", "files", "kebabf / files::DOUBLE < 0.4 AND camelf / files::DOUBLE < 0.4 AND pascalf / files::DOUBLE >= 0.4", None),
    ("error-handling-result-pattern", "results", "scripts", "scripts >= 3 AND results / scripts::DOUBLE >= 0.3", None),
    ("error-handling-try-catch", "tryf", "scripts", "scripts >= 3 AND tryf / scripts::DOUBLE >= 0.4", None),
    ("error-handling-promise-chain", "promf", "scripts", "scripts >= 3 AND promf / scripts::DOUBLE >= 0.3 AND tryf / scripts::DOUBLE < 0.4", None),
    ("go-error-handling-err-nil", "errf", "gos", "gos >= 3 AND errf / gos::DOUBLE >= 0.4", None),
    ("go-no-panic-in-handlers", "gos - panicf", "gos", "gos >= 3 AND panicf > 0 AND panicf / gos::DOUBLE <= 0.15", None),
    ("go-context-first-param", "ctxf", "gos", "gos >= 3 AND ctxf / gos::DOUBLE >= 0.3", None),
    ("go-layered-architecture", "1", "1", "gos >= 3 AND hdir AND sdir", 0.85),
    ("go-pointer-receivers", "receivers", "structs", "gos >= 3 AND structs >= 3 AND receivers > structs * 0.5", 0.75),
    ("architecture-monorepo-frontend-backend", "1", "1", "front AND back", 0.95),
    ("architecture-layer-violation-detected", "viol", "scripts", "viol > 0", 0.8),
    ("architecture-shared-types", "1", "1", "shared", 0.9),
    ("nextjs-app-router", "appf", "scripts", "appf > pagef AND appf >= 2", None),
    ("nextjs-use-client-directive", "clif", "appf", "appf > pagef AND appf >= 2 AND clif > 0", None),
    ("go-gin-framework", "ginf", "handf", "gos >= 3 AND ginf > 0", None),
    ("go-net-http-handlers", "netf", "handf", "gos >= 3 AND ginf = 0 AND netf > 0", None),
    ("state-management-zustand", "zusf", "scripts", "scripts >= 3 AND zusf >= 2", None),
    ("state-management-redux", "redf", "scripts", "scripts >= 3 AND redf >= 2", None),
    ("state-management-react-query", "qf", "scripts", "scripts >= 3 AND qf >= 2", None),
    ("async-await-pattern", "asyncf", "scripts", "scripts >= 3 AND asyncf / scripts::DOUBLE >= 0.4 AND asyncf > newp", None),
    ("imports-barrel-files", "barrels", "nested", "scripts >= 3 AND barrels >= 2", None),
    ("imports-path-alias", "alias", "alias + relative", "scripts >= 3 AND alias > relative AND alias >= 5", None),
    ("imports-relative", "relative", "relative + bare", "scripts >= 3 AND NOT (alias > relative AND alias >= 5) AND relative > bare AND relative > 5", None),
    ("organization-layer-folders", "layers", str(len(LAYER_FOLDERS)), "layers >= 2", None),
    ("organization-feature-folders", "features", str(len(FEATURE_FOLDERS)), "features >= 2", None),
    ("testing-colocated", "colo", "tests", "tests >= 2 AND files - tests >= 2 AND colo / tests::DOUBLE >= 0.5", None),
    ("testing-naming-test", "dott", "tests", "tests >= 2 AND files - tests >= 2 AND dott > dots AND dott / tests::DOUBLE >= 0.7", None),
    ("testing-go-test-files", "gott", "gos", "tests >= 2 AND files - tests >= 2 AND gott >= 2", None),
    ("types-prefer-interface", "interfaces", "interfaces + aliases", "tss >= 3 AND interfaces > aliases AND interfaces >= 5", None),
    ("types-prefer-type-alias", "aliases", "interfaces + aliases", "tss >= 3 AND aliases > interfaces AND aliases >= 5", None),
    ("types-zod-validation", "zodf", "tss", "tss >= 3 AND zodf >= 2", None),
    ("exports-named-only", "namedf", "scripts", "scripts >= 3 AND namedf > dfltf AND namedf >= 5", None),
    ("exports-default-preferred", "dfltf", "scripts", "scripts >= 3 AND dfltf > namedf AND dfltf >= 5", None),
]
_rows = " UNION ALL ".join(f"SELECT repo, '{n}' AS pattern, ({m})::BIGINT AS matched, ({p})::BIGINT AS population, {'NULL' if c is None else f'{c}e0'}::DOUBLE AS const FROM k WHERE {w}" for n, m, p, w, c in _PATTERNS)
_MINED = f"""
mp0 AS ({_rows}),
mp AS (SELECT repo, pattern, matched, population, coalesce(const, matched / greatest(population, 1)::DOUBLE) AS prevalence FROM mp0 WHERE coalesce(const, matched / greatest(population, 1)::DOUBLE) >= 0.2)"""
_checks = ", ".join(f"({_quoted(k)}, {', '.join(map(_quoted, v))})" for k, v in CHECKS.items())
_decision = "'(?i)(?://|#)\\s*(?:Decision|Why|ADR|Note):'"

SQL = {
    "line_symbols": _with(_FILES, _LINES) + f"SELECT file_id, line::INT AS line, {_sk} AS type, {_sv} AS name, CASE WHEN family = 'go' THEN regexp_matches({_sv}, '^[A-Z]') WHEN family = 'python' THEN NOT starts_with({_sv}, '_') ELSE regexp_matches(text, '{EXPORTED}') END AS exported FROM sl WHERE {_sk} IS NOT NULL",
    "line_exports": _with(_FILES, _LINES, _EXPORTS) + "SELECT file_id, line::INT AS line, type, name FROM ex",
    "line_imports": _with(_FILES, _LINES, rf"""
li AS (SELECT file_id, language, line, {_ik} AS kind, {_iv} AS source, last_value(CASE WHEN family = 'go' AND regexp_matches(text, '^import\s*\($') THEN true WHEN family = 'go' AND text = ')' THEN false END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM sl)""")
    + "SELECT language, kind, count(*) AS imports, count(DISTINCT source) AS sources FROM li WHERE kind IS NOT NULL AND (kind <> 'block' OR coalesce(inside, false)) GROUP BY ALL",
    "marker_comments": _with(_FILES, _LINES) + f"SELECT file_id, line::INT AS line, regexp_extract(text, '{MARKER}', 1) AS marker FROM sl WHERE regexp_matches(text, '{MARKER}')",
    "mined_patterns": _with(*_BASE, _LINES, _EXPORTS, _FACTS, _MINED) + "FROM mp",
    "pattern_checks": _with(*_BASE, _LINES, _EXPORTS, _FACTS, _MINED, f"ch(pattern, type, c, s) AS (VALUES {_checks})") + "SELECT repo, mp.pattern, prevalence, coalesce(ch.type, 'custom') AS type, c AS check, s AS subject FROM mp LEFT JOIN ch ON ch.pattern = mp.pattern",
    "call_depth": _with(_SYMBOLS, _IMPORTS, _CALLS, """
st AS (SELECT DISTINCT repo, path || '#' || source AS a, target_path || '#' || target AS b FROM ce WHERE resolved AND kind = 'call' AND NOT (path = target_path AND source = target)),
w AS (SELECT repo, n, 1 AS d, [n] AS seen FROM (SELECT repo, a AS n FROM st UNION SELECT repo, b FROM st) UNION SELECT st.repo, st.b, w.d + 1, list_append(w.seen, st.b) FROM w JOIN st ON st.repo = w.repo AND st.a = w.n WHERE NOT list_contains(w.seen, st.b))""") + "SELECT repo, max(d)::INT AS depth FROM w GROUP BY repo",
    "cluster_terms": _with(*_BASE, _TOKENS, _TFIDF, _PAIRS) + """SELECT repo, component, files, terms FROM (SELECT repo, component, list(term ORDER BY r) AS terms FROM (SELECT repo, component, term, row_number() OVER (PARTITION BY repo, component ORDER BY floor(sum(weight) * 10000 + 0.5) DESC, term) AS r FROM co JOIN tw USING (repo, path) GROUP BY repo, component, term QUALIFY r <= 5) GROUP BY repo, component)
      JOIN (SELECT repo, component, count(*) AS files FROM co GROUP BY repo, component) USING (repo, component)""",
    "comment_decisions": _with(_FILES, _RULES, _LINES) + f"""SELECT 'comment-' || rule_no || '-' || line AS id, rule_no, sl.repo, sl.path, line::INT AS line, substr(regexp_replace(text, '(?i)^[/#\\s]*(Decision|Why|ADR|Note):\\s*', ''), 1, 80) AS title
      FROM sl JOIN (SELECT DISTINCT rule_no, repo, e.file AS path FROM (SELECT rule_no, repo, unnest(evidence) AS e FROM ru) WHERE e.file IS NOT NULL AND NOT contains(e.file, '*')) c ON c.repo = sl.repo AND c.path = sl.path WHERE regexp_matches(text, {_decision})""",
}
