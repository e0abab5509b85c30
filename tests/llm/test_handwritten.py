import pytest

from corpusloom.llm import handwritten

CODE = "import a from 'b';\n\nexport function f(x) {\n  return x;\n}\n"
TABLE = "export const T = [\n" + "".join(f"  {n}, {n + 1}, {n + 2},\n" for n in range(60)) + "];\n"
MIN = "!function(e,t){" + "if(!a1)for(var b=0;b<99;b++)cc(b);var d=3,e=[];" * 40 + "}();\n"
MACHINE = {
    "vendor/pkg/a.go": CODE, "x/node_modules/y/lib/a.js": CODE, "external/lib-1.2/a.py": CODE, "src/a_pb2.py": "x = 1\n", "a.pb.go": CODE, "a.generated.ts": CODE, "a.min.js": "f()", "a/b.js": MIN, "a/t.ts": TABLE, "third_party/p/n.rs": None,
    "a/1.go": "// Code generated by tool v1.2. DO NOT EDIT.\n\npackage a\n", "a/2.ts": "/*\n * @generated\n */\n" + CODE, "a/3.py": "# Copyright x\n#\n# more\n\n# AUTO-GENERATED FILE - overwritten by the next build\nx = 1\n",
    "a/4.js": "/*!\n * lib v6.2.0\n * Copyright (c) 2021 the lib contributors. Released under the MIT license.\n */\n" + CODE, "a/5.rs": "// Vendored from git.x.example at revision abc\nfn f() {}\n", "a/6.java": "// Dieser Code wurde von x erzeugt. Nicht bearbeiten.\nclass A {}\n",
    "a/7.ts": CODE + "\n// @generated by tool\n", "a/8.go": "// lib 1.2.3 | (c) 2016 lib authors | https://lib.example/license\npackage a\n",
}
HAND = {
    "app/vendors/invoice.ts": CODE, "src/vendor/vendor_list.ts": CODE, "pkg/external_calls/a.go": CODE, "src/my_bundle.ts": CODE, "a/banner.ts": 'const banner = "Code generated by x. DO NOT EDIT.";\n' + CODE,
    "a/gen.py": "# Writes the header 'Code generated by x. DO NOT EDIT.' into its output\nx = 1\n", "a/gen2.ts": "// Replaces the auto-generated client file\n" + CODE, "a/gen3.go": "// Edit this by hand after the generated parts of x changed\npackage a\n",
    "a/own.ts": "// Copyright (c) 2024 Our team. All rights reserved.\n" + CODE, "a/long.py": 'message = "' + "Under load, the module reads a list. " * 40 + '"\n', "a/null.ts": None, "a/empty.ts": "", "conf/a.json": "[1,2,3]", "deps.ts": CODE,
}


def test_machine_and_hand(spark):
    both = {**MACHINE, **HAND}
    ids = {p: n for n, p in enumerate(both)}
    files = spark.createDataFrame([(ids[p], p, t, "other") for p, t in both.items()] * 2, "file_id long, path string, content string, kind string")
    machine = handwritten.machine_files(files)
    got = [r.path for r in machine.collect()]
    assert sorted(got) == sorted(MACHINE)
    left = {r.path for r in handwritten.handwritten_files(files, machine).collect()}
    assert left == {p for p in HAND if not p.endswith("json")}


def test_backslashes_empty_table_and_null_path(spark):
    schema = "file_id long, path string, content string"
    files = spark.createDataFrame([(1, "a\\vendor\\p\\x.go", "package a"), (2, None, MIN)], schema)
    assert [r.file_id for r in handwritten.machine_files(files).collect()] == [1]
    assert handwritten.machine_files(files.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\n", "/* open", "# only\n# comments"])
def test_header_and_footer_of_odd_texts(text):
    assert handwritten.Notices().find(handwritten.header(text)) is None
    assert handwritten.Notices().find(handwritten.footer(text)) is None
