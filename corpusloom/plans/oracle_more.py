"""DuckDB SQL of names, exports, details and examples; patterns and limits are written out here, apart from the engine's own."""

from __future__ import annotations

from corpusloom.plans.oracle import _BASE, _CALLS, _CHANGE, _CLAIMS, _FILES, _IMPORTS, _LAYERS, _NODES, _PAIRS, _RULES, _SCORES, _SYMBOLS, _TFIDF, _TOKENS, _base_ed, _with
from corpusloom.plans.oracle_lines import _LINES

_TRIM = r"regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+as\s+.*$', '')"
_LIST = "list_filter(list_transform(string_split({x}, ','), lambda x: " + _TRIM + "), lambda n: n <> '')"
_BRACES = _LIST.format(x=r"regexp_extract(text, '\{([^}]*)\}', 1)")
_FROM = r"regexp_replace(regexp_extract(text, '^from\s+[\w.]+\s+import\s+(.+)$', 1), '^\s+|\s+$', '', 'g')"
_NAMES = rf"""
raw AS (SELECT *, CASE
    WHEN family = 'script' AND regexp_matches(text, '^import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{{[^}}]*\}}\s+from\s+[''"][^''"]+[''"]') THEN 'named'
    WHEN family = 'script' AND regexp_matches(text, '^import\s+(?:type\s+)?\w+\s+from\s+[''"][^''"]+[''"]') THEN 'default'
    WHEN family = 'script' AND regexp_matches(text, '^import\s+\*\s+as\s+\w+\s+from\s+[''"][^''"]+[''"]') THEN 'namespace'
    WHEN family = 'script' AND regexp_matches(text, '^import\s+[''"][^''"]+[''"]') THEN 'effect'
    WHEN family = 'script' AND regexp_matches(text, '(?:const|let|var)\s+(?:\{{[^}}]*\}}|\w+)\s*=\s*require\s*\(\s*[''"][^''"]+[''"]\s*\)') THEN 'require'
    WHEN family = 'python' AND regexp_matches(text, '^from\s+[\w.]+\s+import\s+') THEN 'from'
    WHEN family = 'python' AND regexp_matches(text, '^import\s+[\w.]+') THEN 'module'
    WHEN family = 'java' AND regexp_matches(text, '^import\s+(?:static\s+)?[\w.*]+\s*;') THEN 'module'
    WHEN family = 'rust' AND regexp_matches(text, '^(?:pub\s+)?use\s+[^;{{]+?(?:::\{{.*)?;') THEN 'module'
    WHEN family = 'go' AND regexp_matches(text, '^import\s+(?:[\w.]+\s+)?"[^"]+"') THEN 'module'
    WHEN family = 'go' AND regexp_matches(text, '^(?:[\w.]+\s+)?"[^"]+"$') THEN 'block' END AS kind,
  last_value(CASE WHEN family = 'go' AND regexp_matches(text, '^import\s*\($') THEN true WHEN family = 'go' AND text = ')' THEN false END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM sl),
li AS (SELECT *, CASE WHEN family = 'script' AND kind = 'require' THEN regexp_extract(text, 'require\s*\(\s*[''"]([^''"]+)', 1) WHEN family = 'script' AND kind = 'effect' THEN regexp_extract(text, '[''"]([^''"]+)[''"]', 1) WHEN family = 'script' THEN regexp_extract(text, '\sfrom\s+[''"]([^''"]+)[''"]', 1)
    WHEN kind = 'from' THEN regexp_extract(text, '^from\s+([\w.]+)', 1) WHEN family = 'python' THEN regexp_extract(text, '^import\s+([\w.]+)', 1) WHEN family = 'java' THEN regexp_extract(text, '^import\s+(?:static\s+)?([\w.*]+)', 1)
    WHEN family = 'rust' THEN regexp_extract(text, '^(?:pub\s+)?use\s+([^;{{]+?)(?:::\{{.*)?;', 1) ELSE regexp_extract(text, '"([^"]+)"', 1) END AS source,
  CASE WHEN kind = 'require' THEN regexp_extract(text, '(?:const|let|var)\s+(\w+)\s*=\s*require', 1) ELSE regexp_extract(text, '^import\s+(?:type\s+)?(\w+)\s*(?:,|\s+from)', 1) END AS dflt
  FROM raw WHERE kind IS NOT NULL AND (kind <> 'block' OR coalesce(inside, false))),
names AS (SELECT file_id, line::INT AS line, source,
  CASE WHEN kind = 'namespace' THEN [regexp_extract(text, '\*\s+as\s+(\w+)', 1)] WHEN kind = 'effect' THEN [] WHEN family = 'script' THEN list_concat(CASE WHEN dflt <> '' THEN [dflt] ELSE [] END, {_BRACES})
    WHEN kind = 'from' THEN list_filter({_LIST.format(x=_FROM)}, lambda n: n <> '*') WHEN family = 'go' THEN [CASE WHEN regexp_extract(text, '^(?:import\s+)?(\w+)\s+"', 1) NOT IN ('', 'import') THEN regexp_extract(text, '^(?:import\s+)?(\w+)\s+"', 1) ELSE regexp_extract(source, '([^/]*)$', 1) END]
    WHEN family = 'rust' AND contains(text, '{{') THEN {_BRACES} ELSE [regexp_extract(source, '(\w*)$', 1)] END AS names,
  CASE WHEN family = 'script' THEN dflt <> '' AND kind <> 'namespace' ELSE family = 'python' AND kind = 'module' END AS is_default, kind = 'namespace' OR (kind = 'from' AND {_FROM} = '*') AS is_namespace FROM li)"""

_EXPORTED = rf"""
xs AS (SELECT file_id, repo, path, line::INT AS line, 'default' AS type, CASE WHEN n = '' THEN 'default' ELSE n END AS name FROM (SELECT *, regexp_extract(text, '^export\s+default\s+(?:(?:async\s+)?(?:class|function|const|let|var)\s+)?(\w*)', 1) AS n FROM sl WHERE family = 'script' AND regexp_matches(text, '^export\s+default\s+'))
  UNION ALL SELECT file_id, repo, path, line::INT, 'named', regexp_extract(text, '^export\s+(?:async\s+)?(?:abstract\s+)?(?:const|let|var|function|class|interface|type|enum)\s+(\w+)', 1) FROM sl WHERE family = 'script' AND regexp_matches(text, '^export\s+(?:async\s+)?(?:abstract\s+)?(?:const|let|var|function|class|interface|type|enum)\s+\w+')
  UNION ALL SELECT file_id, repo, path, line::INT, 'named', unnest({_LIST.format(x=r"regexp_extract(text, '^export\s+\{([^}]*)\}', 1)")}) FROM sl WHERE family = 'script'
  UNION ALL SELECT file_id, repo, path, line::INT, 'named', n FROM (SELECT *, coalesce(nullif(regexp_extract(text, '^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]', 1), ''), regexp_extract(text, '^type\s+(\w+)\s+(?:struct|interface)\b', 1)) AS n FROM sl WHERE family = 'go') WHERE regexp_matches(n, '^[A-Z]')
  UNION ALL SELECT file_id, repo, path, line::INT, 'named', n FROM (SELECT *, regexp_extract(text, '^pub(?:\([^)]*\))?\s+(?:(?:async\s+|unsafe\s+|const\s+)*fn|struct|enum|trait)\s+(\w+)', 1) AS n FROM sl WHERE family = 'rust') WHERE n <> ''
  UNION ALL SELECT file_id, repo, path, line::INT, 'named', n FROM (SELECT *, regexp_extract(text, '^(?:public\s+|private\s+|protected\s+)?(?:static\s+|final\s+|abstract\s+)*class\s+(\w+)', 1) AS n FROM sl WHERE family = 'java') WHERE n <> ''
  UNION ALL SELECT file_id, repo, path, 0, 'named', unnest(regexp_extract_all(regexp_extract(content, '__all__\s*=\s*\[([^\]]*)\]', 1), '[''"](\w+)[''"]', 1)) FROM lf WHERE language = 'python' AND content IS NOT NULL)"""
_MARKED = r"mc AS (SELECT repo, path, text FROM sl WHERE regexp_matches(text, '^(?://|#)\s*(TODO|FIXME|NOTE|Decision|Why|HACK|ADR):'))"
_STYLES = """
ns AS (SELECT DISTINCT repo, style, CASE style WHEN 'functions-camelcase' THEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') WHEN 'functions-snake-case' THEN regexp_matches(name, '^[a-z][a-z0-9_]*$') AND contains(name, '_') ELSE regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') END AS follows, path, line::INT AS line, name
  FROM sy JOIN (VALUES ('functions-camelcase', 'function'), ('functions-snake-case', 'function'), ('classes-pascalcase', 'class'), ('classes-pascalcase', 'interface')) v(style, t) ON v.t = sy.type)"""

SQL = {
    "import_names": _with(_FILES, _LINES, _NAMES) + "FROM names",
    "exported_names": _with(_FILES, _LINES, _EXPORTED) + "SELECT file_id, line, type, name FROM xs",
    "full_terms": _with(*_BASE, _LINES, _EXPORTED, _MARKED, _TOKENS.replace("FROM lf UNION ALL", "FROM lf UNION ALL SELECT repo, path, name FROM xs UNION ALL SELECT repo, path, text FROM mc UNION ALL", 1)) + "FROM tk",
    "resolved_edges": _with(*_base_ed) + "FROM ed",
    "same_terms": _with(*_BASE, _TOKENS, _TFIDF, _PAIRS) + "SELECT repo, path, same FROM sm",
    "structural_clusters": _with(*_BASE, _TOKENS, _TFIDF, _PAIRS, """
sz AS (SELECT repo, component, count(*) AS members FROM co GROUP BY ALL HAVING count(*) >= 4),
sh AS (SELECT repo, component, source FROM (SELECT DISTINCT co.repo, component, co.path, source FROM co JOIN im ON im.repo = co.repo AND im.path = co.path WHERE source IS NOT NULL) JOIN sz USING (repo, component) GROUP BY repo, component, source, members HAVING count(*) >= members * 0.5),
s3 AS (SELECT repo, component, list(source ORDER BY source) AS shared FROM (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY repo, component ORDER BY source) <= 3) GROUP BY ALL),
ch AS (SELECT repo, component, floor(s / (files * (files - 1) / 2) * 1000 + 0.5) / 1000 AS cohesion FROM (SELECT repo, component, count(*) AS files FROM co GROUP BY ALL) JOIN (SELECT x.repo, x.component, sum(p.weight * q.weight) AS s FROM co x JOIN co y ON x.repo = y.repo AND x.component = y.component AND x.path < y.path JOIN tw p ON p.repo = x.repo AND p.path = x.path JOIN tw q ON q.repo = y.repo AND q.path = y.path AND q.term = p.term GROUP BY ALL) USING (repo, component) WHERE files > 1)""")
    + "SELECT repo, component, members, coalesce(shared, []) AS shared, cohesion, floor(members * 100 / n + 0.5) / 100 AS prevalence FROM sz LEFT JOIN s3 USING (repo, component) LEFT JOIN ch USING (repo, component) JOIN (SELECT repo, count(*) AS n FROM lf GROUP BY repo) USING (repo) WHERE shared IS NOT NULL OR cohesion >= 0.5",
    "naming_examples": _with(_SYMBOLS, _STYLES) + "SELECT repo, style, follows, row_number() OVER (PARTITION BY repo, style, follows ORDER BY path, line NULLS LAST, name)::INT AS rank, path, line, name FROM ns QUALIFY rank <= 3",
    "hub_rules": _with(*_base_ed, _NODES) + "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY degree DESC, path)::INT AS rank, path, degree FROM no WHERE degree >= 8 QUALIFY rank <= 3",
    "hotspot_rules": _with(_SYMBOLS, _IMPORTS, _CALLS) + "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY fan_in DESC, path, name)::INT AS rank, path, name, fan_in, fan_out FROM me WHERE kind IN ('function', 'method') AND fan_in >= 3 QUALIFY rank <= 3",
    "rule_details": _with(*_BASE, _RULES, _CLAIMS, _SCORES) + """SELECT rr.rule_no, rr.repo, rr.id, status, score, CASE WHEN enhanced IS NOT NULL AND NOT coalesce(enhanced.stale, false) THEN coalesce(enhanced.description, description) ELSE description END AS description,
      list_filter(list_transform(list_slice(coalesce(evidence, []), 1, 3), lambda e: e.file || coalesce(':' || e.line, '')), lambda x: x IS NOT NULL) AS evidence FROM rr JOIN ru USING (rule_no)""",
    "rules_to_mend": _with(*_BASE, _RULES, _CLAIMS, _SCORES) + "FROM rr WHERE status <> 'valid'",
    "model_files": _with(*_base_ed, _LAYERS, _CHANGE) + """SELECT ne.repo, ne.source, ne.target, look_at FROM ne JOIN (SELECT d.repo, min(d.path) AS look_at FROM (SELECT repo, path, count(*) AS degree FROM (SELECT repo, source AS path FROM edb UNION ALL SELECT repo, target FROM edb) GROUP BY ALL) d JOIN la USING (repo, path)
      WHERE layer = 'service' AND degree < 6 GROUP BY d.repo) USING (repo) WHERE crosses_boundary OR creates_cycle""",
}
