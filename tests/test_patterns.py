"""Every mined pattern fires on a fixture of its own, with the counts that a reader would make."""

import pytest

from corpusloom.operators import mining

FILES = "repo string, path string, language string, file_id long, ord long, content string"
SYMBOLS = "repo string, path string, name string, type string"
IMPORTS = "repo string, path string, source string, symbols array<string>"
TS, GO = "typescript", "go"

# repo: (files, symbols, imports, what must come out as (matched, population))
CASES = {
    "camel": ([("a.ts", TS, "")], [("a.ts", n, "function") for n in ("getOne", "getTwo", "three", "Bad")], [], {"naming-functions-camelcase": (3, 4)}),
    "snake": ([("a.py", "python", "")], [("a.py", n, "function") for n in ("get_one", "get_two", "get_three", "get_four")], [], {"naming-functions-snake-case": (4, 4)}),
    "pascal": ([("a.ts", TS, "")], [("a.ts", n, t) for n, t in (("One", "class"), ("Two", "interface"), ("Three", "class"), ("four", "class"))], [], {"naming-classes-pascalcase": (3, 4)}),
    "kebab": ([("x/my-file.py", "python", ""), ("x/other.py", "python", "")], [], [], {"naming-files-kebab-case": (1, 2)}),
    "camelfile": ([("x/myFile.py", "python", ""), ("x/other.py", "python", "")], [], [], {"naming-files-camelcase": (1, 2)}),
    "pascalfile": ([("x/MyFile.py", "python", ""), ("x/other.py", "python", "")], [], [], {"naming-files-pascalcase": (1, 2)}),
    "result": ([(f"x/{n}.ts", TS, "") for n in "abc"], [("x/a.ts", "ParseResult", "type")], [("x/b.ts", "./r", ["Result"])], {"error-handling-result-pattern": (2, 3)}),
    "try": ([("x/a.ts", TS, "try {"), ("x/b.ts", TS, "try{"), ("x/c.ts", TS, "retry")], [], [], {"error-handling-try-catch": (2, 3)}),
    "promise": ([("x/a.ts", TS, "f().catch(g)"), ("x/b.ts", TS, ""), ("x/c.ts", TS, "")], [], [], {"error-handling-promise-chain": (1, 3)}),
    "errnil": ([("x/a.go", GO, "if err != nil {"), ("x/b.go", GO, "if err != nil {"), ("x/c.go", GO, "")], [], [], {"go-error-handling-err-nil": (2, 3)}),
    "panic": ([(f"x/{n}.go", GO, "panic(1)" if n == 0 else "") for n in range(8)], [], [], {"go-no-panic-in-handlers": (7, 8)}),
    "ctx": ([("x/a.go", GO, "func f(ctx context.Context) {"), ("x/b.go", GO, ""), ("x/c.go", GO, "")], [], [], {"go-context-first-param": (1, 3)}),
    "layered": ([("handlers/a.go", GO, ""), ("services/b.go", GO, ""), ("models/c.go", GO, "")], [], [], {"go-layered-architecture": (1, 1), "organization-layer-folders": (3, 12)}),
    "pointers": ([(f"x/{n}.go", GO, "func (a *A) f() {}\nfunc (b *B) g() {}") for n in "abc"], [("x/a.go", n, "class") for n in "ABC"], [], {"go-pointer-receivers": (6, 3)}),
    "mono": ([("frontend/a.ts", TS, ""), ("backend/b.go", GO, "")], [], [], {"architecture-monorepo-frontend-backend": (1, 1)}),
    "violation": ([("src/utils/a.ts", TS, "")], [], [("src/utils/a.ts", "../x/services/b", None)], {"architecture-layer-violation-detected": (1, 1)}),
    "shared": ([("shared/a.ts", TS, "")], [], [], {"architecture-shared-types": (1, 1)}),
    "next": ([("web/app/page.tsx", TS, '"use client"'), ("web/app/x/layout.tsx", TS, ""), ("web/pages/y.tsx", TS, "")], [], [], {"nextjs-app-router": (2, 3), "nextjs-use-client-directive": (1, 2)}),
    "gin": ([("x/handler.go", GO, "c *gin.Context"), ("x/b.go", GO, ""), ("x/c.go", GO, "")], [], [], {"go-gin-framework": (1, 1)}),
    "nethttp": ([("x/handler.go", GO, "w http.ResponseWriter, r *http.Request"), ("x/routes.go", GO, ""), ("x/c.go", GO, "")], [], [], {"go-net-http-handlers": (1, 2)}),
    "zustand": ([(f"x/{n}.ts", TS, "") for n in "abc"], [], [("x/a.ts", "zustand", None), ("x/b.ts", "zustand/middleware", None)], {"state-management-zustand": (2, 3)}),
    "redux": ([(f"x/{n}.ts", TS, "") for n in "abc"], [], [("x/a.ts", "redux", None), ("x/b.ts", "react-redux", None)], {"state-management-redux": (2, 3)}),
    "query": ([(f"x/{n}.ts", TS, "") for n in "abc"], [], [("x/a.ts", "@tanstack/react-query", None), ("x/b.ts", "react-query", None)], {"state-management-react-query": (2, 3)}),
    "async": ([("x/a.ts", TS, "async function f"), ("x/b.ts", TS, "async () =>"), ("x/c.ts", TS, "new Promise(")], [], [], {"async-await-pattern": (2, 3)}),
    "barrel": ([("x/index.ts", TS, "export const a = 1"), ("y/index.ts", TS, "export default a"), ("c.ts", TS, "")], [], [], {"imports-barrel-files": (2, 2)}),
    "alias": ([(f"x/{n}.ts", TS, "") for n in "abc"], [], [("x/a.ts", f"@/m{n}", None) for n in range(5)] + [("x/b.ts", "./r", None)], {"imports-path-alias": (5, 6)}),
    "relative": ([(f"x/{n}.ts", TS, "") for n in "abc"], [], [("x/a.ts", f"./m{n}", None) for n in range(6)] + [("x/b.ts", "react", None)], {"imports-relative": (6, 7)}),
    "features": ([("auth/a.py", "python", ""), ("users/b.py", "python", "")], [], [], {"organization-feature-folders": (2, 9)}),
    "tests": ([("x/a.ts", TS, ""), ("x/b.ts", TS, ""), ("x/a.test.ts", TS, ""), ("y/c.test.ts", TS, "")], [], [], {"testing-colocated": (1, 2), "testing-naming-test": (2, 2)}),
    "gotests": ([("x/a.go", GO, ""), ("x/b.go", GO, ""), ("x/a_test.go", GO, ""), ("x/b_test.go", GO, "")], [], [], {"testing-go-test-files": (2, 4)}),
    "interfaces": ([(f"x/{n}.ts", TS, "") for n in "abc"], [("x/a.ts", f"I{n}", "interface") for n in range(5)] + [("x/a.ts", "T", "type")], [], {"types-prefer-interface": (5, 6)}),
    "aliases": ([(f"x/{n}.ts", TS, "") for n in "abc"], [("x/a.ts", f"T{n}", "type") for n in range(5)] + [("x/a.ts", "I", "interface")], [], {"types-prefer-type-alias": (5, 6)}),
    "zod": ([(f"x/{n}.ts", TS, "") for n in "abc"], [], [("x/a.ts", "zod", None), ("x/b.ts", "zod/v4", None)], {"types-zod-validation": (2, 3)}),
    "named": ([(f"x/{n}.ts", TS, "export const a = 1") for n in "abcde"], [], [], {"exports-named-only": (5, 5)}),
    "default": ([(f"x/{n}.ts", TS, "export default a") for n in "abcde"], [], [], {"exports-default-preferred": (5, 5)}),
}


@pytest.fixture(scope="module")
def mined(spark):
    files, symbols, imports, k = [], [], [], 0
    for repo, (of_files, of_symbols, of_imports, _) in CASES.items():
        for path, language, content in of_files:
            k += 1
            files.append((repo, path, language, k, k, content))
        symbols += [(repo, *s) for s in of_symbols]
        imports += [(repo, *i) for i in of_imports]
    rows = mining.mine_patterns(spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(imports, IMPORTS)).collect()
    return {(r.repo, r.pattern): (r.matched, r.population) for r in rows}


@pytest.mark.parametrize("repo", CASES)
def test_pattern(mined, repo):
    want = CASES[repo][3]
    assert {p: mined.get((repo, p)) for p in want} == want


def test_every_pattern_has_a_case_and_fires_nowhere_unasked(mined):
    ids = {p[0] for p in mining._patterns()}
    assert {p for _, _, _, want in CASES.values() for p in want} == ids and len(ids) == 38
    # a pattern with its own case may fire beside another, but no repository without its condition has it
    assert all((repo, "go-gin-framework") not in mined for repo in CASES if repo != "gin")
    assert all((repo, "nextjs-app-router") not in mined for repo in CASES if repo != "next")
    assert all((repo, "error-handling-try-catch") not in mined for repo in CASES if repo != "try")
    assert all((repo, "types-zod-validation") not in mined for repo in CASES if repo != "zod")
