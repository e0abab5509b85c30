"""A project from its sources to its graph, conventions and rules."""

from corpusloom.plans import project

FILES = {
    "src/types/result.ts": "export type Result<T> = { ok: true; value: T };\nexport function ok(v: number) { return v; }\n",
    "src/models/user-model.ts": "export interface User { id: string }\n",
    "src/services/user-service.ts": "import { Result, ok } from '../types/result.js';\nimport { User } from '@/models/user-model';\nimport { handle } from '../controllers/user-controller';\nexport class UserService {\n}\nexport async function getUser() { try { } catch {} }\n",
    "src/controllers/user-controller.ts": "import { UserService } from '../services/user-service';\nimport express from 'express';\nexport function handle() {}\n",
    "node_modules/x/index.js": "export const a = 1\n",
    "README.md": "# x",
    "empty.ts": "",
}


def test_project(spark):
    rows = [("p", path, text) for path, text in FILES.items()] + [("q", "a/b.py", "import os\nfrom .c import d\n__all__ = ['d']\n"), ("q", "a/c.py", "def d(): pass\n"), ("q", None, "x"), ("q", "n.py", None)]
    parts = project.analyze(spark.createDataFrame(rows, "repo string, path string, content string"), ["node_modules/**"])
    edges = {(r.source, r.target) for r in parts["edges"].filter("repo = 'p'").collect()}
    s = "src/services/user-service.ts"
    assert edges == {(s, "src/types/result.ts"), (s, "src/models/user-model.ts"), (s, "src/controllers/user-controller.ts"), ("src/controllers/user-controller.ts", s)}
    layers = {r.path: r.layer for r in parts["layers"].filter("repo = 'p'").collect()}
    assert layers["src/models/user-model.ts"] == "model" and layers[s] == "service" and layers["src/controllers/user-controller.ts"] == "controller"
    assert [(r.id, r.violations) for r in parts["rules"].collect()] == [("architecture-no-service-to-controller", 1)]
    patterns = {r.pattern for r in parts["patterns"].filter("repo = 'p'").collect()}
    assert "naming-files-kebab-case" in patterns and "error-handling-result-pattern" in patterns
    got = {r.repo: (r.files, r.symbols, r.imports, r.exports) for r in project.summary(parts).collect()}
    assert got == {"p": (4, 6, 5, 6), "q": (2, 1, 2, 1)}
    assert project.summary(project.analyze(spark.createDataFrame([], "repo string, path string, content string"))).count() == 0
