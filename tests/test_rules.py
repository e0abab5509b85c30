from datetime import datetime

import pytest

from corpusloom.operators import decisions, review, rules, verification
from corpusloom.sources import diffs

RULE = "rule_no long, repo string, id string, category string, severity string, priority int, description string, evidence array<struct<file:string,line:int,note:string>>, applies_to string, verification struct<type:string,pattern:string,source:string,forbidden:string,threshold:double,subject:string>, enhanced struct<description:string,rationale:string,stale:boolean>"


def rule(no, kind, pattern=None, threshold=None, applies_to=None, source=None, forbidden=None, subject=None, enhanced=None, priority=1):
    return (no, "r", f"id{no}", "naming", "critical", priority, f"rule {no}", [], applies_to, (kind, pattern, source, forbidden, threshold, subject), enhanced)


@pytest.fixture
def corpus(spark):
    files = spark.createDataFrame([("r", "src/a.ts", "x try { y"), ("r", "src/b.ts", "nothing"), ("r", "lib/c.ts", None)], "repo string, path string, content string")
    symbols = spark.createDataFrame([("r", "function", "camelCase"), ("r", "function", "Not_it"), ("r", "class", "Good"), ("r", "method", "skipped_it")], "repo string, type string, name string")
    imports = spark.createDataFrame([("r", "src/a.ts", "../db/x", "db/x.ts"), ("r", "src/b.ts", "ui/y", None)], "repo string, path string, source string, resolved_path string")
    return files, symbols, imports


def test_scores_and_statuses(spark, corpus):
    made = [
        rule(1, "pattern-match", "try {", 0.5), rule(2, "no-pattern", "try {"), rule(3, "pattern-match", "try {", 0.5, "src/a*"), rule(4, "pattern-match", None, 0.5), rule(5, "custom", None, 0.9), rule(6, "custom", None, 0.8),
        rule(7, "import-constraint", source="src/**", forbidden="db/**"), rule(8, "import-constraint", source="service/**", forbidden="db/**"), rule(9, "naming-convention", "camelCase", 0.9, subject="function"), rule(10, "file-exists", "src/a.ts"),
        rule(11, "file-exists", "gone.ts"), rule(12, "naming-convention", None, 0.9, subject="class"), rule(13, "pattern-match", "try {", 0.5, "none/**"), rule(14, "no-pattern", "a.b", 0.9, "none/**"), rule(15, "strange", None, 0.0),
    ]
    claims = verification.claims(spark.createDataFrame(made + made[:3], RULE))
    assert claims.count() == 15
    got = {r.rule_no: (round(r.score, 3), r.status) for r in verification.rule_results(verification.claim_scores(claims, *corpus)).collect()}
    assert got == {
        1: (0.5, "valid"), 2: (0.5, "violated"), 3: (1.0, "valid"), 4: (0.5, "valid"), 5: (0.5, "violated"), 6: (0.5, "degraded"), 7: (0.5, "violated"), 8: (1.0, "valid"), 9: (0.5, "violated"), 10: (1.0, "valid"),
        11: (0.0, "obsolete"), 12: (0.0, "violated"), 13: (0.0, "violated"), 14: (1.0, "valid"), 15: (0.5, "degraded"),
    }


@pytest.mark.parametrize(("statuses", "score", "color"), [(["valid", "valid"], 100, "brightgreen"), (["valid", "degraded"], 80, "green"), (["valid", "violated"], 50, "orange"), (["obsolete"], 0, "red")])
def test_health(spark, statuses, score, color):
    rows = verification.health(spark.createDataFrame([(k, "r", "i", s, 1.0) for k, s in enumerate(statuses)], "rule_no long, repo string, id string, status string, score double")).collect()
    assert (rows[0].score, rows[0].color) == (score, color)


def test_enhancements(spark):
    old = spark.createDataFrame([rule(1, "custom", enhanced=("better", None, False)), rule(2, "custom", enhanced=("stale", None, True)), rule(3, "custom")], RULE)
    new = old.selectExpr("repo", "id", "if(rule_no = 1, 'changed', description) as description")
    got = {r.id: r.enhanced and r.enhanced.stale for r in rules.carried_enhancements(old, new).collect()}
    assert got == {"id1": True, "id2": True, "id3": None}
    assert [r.rule_no for r in rules.needing_enhancement(old).orderBy("rule_no").collect()] == [2, 3]
    answers = spark.createDataFrame([("r", "id1", "long enough text", ["a.ts", "gone.ts"]), ("r", "nope", "long enough text", []), ("r", "id2", "short", ["a.ts"])], "repo string, id string, description string, examples array<string>")
    known = spark.createDataFrame([("r", "a.ts")], "repo string, path string")
    assert {r.id: (r.outcome, r.examples) for r in rules.applied_enhancements(old, answers, known).collect()} == {"id1": ("applied", ["a.ts"]), "nope": ("unknown", []), "id2": ("length", [])}


def test_batches_and_markdown(spark):
    made = spark.createDataFrame([rule(n, "custom", priority=n % 3) for n in range(23)], RULE)
    assert sorted(b.rules for b in rules.prompt_batches(made).collect()) == [3, 10, 10]
    text = rules.markdown(made).first().document
    assert text.startswith("## naming\n- [critical] rule 2") and text.count("\n- ") == 23
    assert rules.markdown(made.limit(0)).count() == 0


def test_review(spark):
    edge = "repo string, source string, target string"
    before, after = spark.createDataFrame([("r", "b", "a")], edge), spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "a", "db/x")], edge)
    layers = spark.createDataFrame([("r", "a", "service"), ("r", "db/x", "api")], "repo string, path string, layer string")
    bounds = spark.createDataFrame([("r", "service", "api", False)], "repo string, from_layer string, to_layer string, allowed boolean")
    fresh = review.new_edges(before, after, layers, bounds)
    assert sorted((e.target, e.crosses_boundary, e.creates_cycle) for e in fresh.collect()) == [("b", False, True), ("db/x", True, False)]
    nodes = spark.createDataFrame([("r", "a", 7)], "repo string, path string, degree long")
    changes = review.complexity_changes(fresh, nodes)
    assert [(c.before, c.after, c.risk) for c in changes.collect()] == [(7, 9, True)]
    hits = review.rule_hits(fresh, spark.createDataFrame([rule(1, "import-constraint", source="x", forbidden="db/**")], RULE))
    found = review.violations(fresh, changes, hits)
    assert sorted(v.type for v in found.collect()) == ["boundary-violation", "circular-dependency", "god-object", "rule-violation"]
    summary = review.summary(found, fresh.selectExpr("repo", "source as path")).first()
    assert (summary.files, summary.violations, summary.warnings, summary.clean) == (1, 3, 1, 0)


DIFF = """diff --git a/x.ts b/x.ts
--- a/x.ts
+++ b/x.ts
@@ -3,4 +3,5 @@ ctx
 keep
-import old from './old'
+import { a } from './db'
+export function hello() {}
 tail
diff --git a/old.ts b/new.ts
new file mode 100644
@@ -0,0 +1,2 @@
+++lost
+class Thing
diff --git a/gone.ts b/gone.ts
deleted file mode 100644
@@ -1,2 +0,0 @@
-one
---two
"""


def test_diff_parsing(spark):
    d = spark.createDataFrame([(1, DIFF), (2, ""), (3, "no diff")], "k long, diff string")
    got = {f.path: f for f in diffs.diff_files(d, "k").collect()}
    assert (got["x.ts"].status, got["x.ts"].added, got["x.ts"].removed, got["x.ts"].added_imports, got["x.ts"].removed_imports, got["x.ts"].added_symbols) == ("modified", 2, 1, 1, 1, 1)
    assert (got["new.ts"].status, got["new.ts"].old_path, got["new.ts"].added) == ("renamed", "old.ts", 1)
    assert (got["gone.ts"].status, got["gone.ts"].removed) == ("deleted", 1)
    lines = {(r.kind, r.content): r.number for r in diffs.diff_lines(diffs.diff_sections(d, "k"), "k").collect()}
    assert lines[("added", "import { a } from './db'")] == 4 and lines[("added", "export function hello() {}")] == 5 and lines[("removed", "import old from './old'")] == 4


def test_decisions(spark):
    now = datetime(2025, 5, 1)
    doc = "doc_id long, text string, source string, kind string, created_at timestamp"
    documents = spark.createDataFrame([(1, "refactor: Adopt queues\n\nbody", "r", "commit", now), (2, "fix: typo", "r", "commit", now), (3, "# Use X\n\n## Status\n\nAccepted\n", "r", "adr", now), (4, None, "r", "adr", now), (5, "text only", "r", "adr", now)], doc)
    commits, records = decisions.commit_decisions(documents), decisions.record_decisions(documents)
    assert [(c.id, c.title) for c in commits.collect()] == [("commit-1-refactor-adopt-queues", "Adopt queues")]
    assert {(r.title, r.status) for r in records.collect()} == {("Use X", "accepted"), ("adr-5", "active")}
    columns = ["id", "repo", "title", "decided_at", "kind"]
    whole = decisions.merged(records.select(*columns), commits.select(*columns).union(commits.select(*columns)).union(records.select(*columns)))
    assert whole.count() == 3
    linked = decisions.linked_rules(whole, spark.createDataFrame([(7, "r", "x", "queues"), (8, "q", "x", "queues")], "rule_no long, repo string, id string, category string"))
    assert [(r.id, r.rule_no) for r in linked.collect()] == [("commit-1-refactor-adopt-queues", 7)]
