"""Pattern lists, imports, phantom dependencies and the join of spans with points, against hand cases and brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.operators import text_checks as T


def test_every_match_has_its_place(spark):
    check = T.PatternCheck("logs", (T.Pattern("log", r"\blog\("), T.Pattern("word", r"b+", "error", "no b", every=False)))
    text = "log(1); log(2)\n  // log(3)\n * log(4)\n*= log(5) bb b\n\né漢🙂log(b\ufdd0)"
    files = spark.createDataFrame([(1, text, "a.ts"), (2, None, "b.ts"), (3, "", "c.ts"), (4, "log(", "x/__tests__/a.ts")], "id long, text string, path string")
    got = sorted((r.id, r.line, r.column, r.type, r.severity, r.match) for r in T.regex_list_check(files, check, "id", "path").collect())
    assert got == [
        (1, 1, 1, "log", "warning", "log("), (1, 1, 9, "log", "warning", "log("), (1, 4, 4, "log", "warning", "log("), (1, 4, 11, "word", "error", "bb"),
        (1, 6, 4, "log", "warning", "log("), (1, 6, 8, "word", "error", "b"), (4, 1, 1, "log", "warning", "log("),
    ]
    assert T.regex_list_check(files, T.PatternCheck("logs", check.patterns, comments=True, tests=False), "id", "path").filter("type = 'log'").count() == 6
    one = T.regex_list_check(files, T.PatternCheck("logs", check.patterns, one_per_line=True), "id").filter("id = 1").collect()
    assert sorted((r.line, r.column, r.type) for r in one) == [(1, 1, "log"), (4, 4, "log"), (6, 4, "log")]
    with pytest.raises(ValueError):
        T.regex_list_check(files, T.PatternCheck("none", ()), "id")
    with pytest.raises(ValueError):
        T.regex_list_check(files, T.PatternCheck("x", check.patterns, filter="what"), "id")


def test_filters_hide_strings_and_comments(spark):
    files = spark.createDataFrame([(1, 'x = "eval(1)" + eval(2) // eval(3)')], "id long, text string")
    columns = lambda kind: sorted(r.column for r in T.regex_list_check(files, T.PatternCheck("e", (T.Pattern("eval", r"eval\("),), kind), "id").collect())
    assert columns("raw") == [6, 17, 28] and columns("blank") == [17] and columns("strip") == [10]


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_re(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab \u00e9(") for _ in range(rng.randrange(30))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"a+", r"\bab?", r"(a)(b)", r"[^ ]+$"):
        got = [[(m.column, m.match) for m in r.m] for r in rows.select(T.matches(F.col("t"), pattern).alias("m")).collect()]
        assert got == [[(m.start() + 1, m.group()) for m in re.finditer(pattern, t, re.ASCII)] for t in texts]


SOURCE = """import a, { b as c } from './a';
import './side.js'
import * as ns
  from "@x/y/z";
export { d } from '../up/d.ts'; export * from './dir'
// import no from 'comment'
/* import no from 'block'
 import no2 from 'block' */
const s = "import no from 'string'", t = `import no from 'template'`;
const e = await import( 'pkg/sub' ), f = require("fs"), g = require(`lit`), h = import(`./${name}`), i = require(name);
obj.require('no'); Array.from('no'); export default foo
import type { T } from 'types'
"""


def test_imports_of_a_text(spark):
    files = spark.createDataFrame([("src/m.ts", SOURCE), ("src/none.ts", None), ("src/a.ts", ""), ("src/side.ts", ""), ("src/dir/index.tsx", ""), ("up/d.ts", "")], "file_path string, text string")
    found = T.imports(files)
    assert sorted((r.line, r.specifier, r.form) for r in found.collect()) == [
        (1, "./a", "static"), (2, "./side.js", "static"), (3, "@x/y/z", "static"), (5, "../up/d.ts", "static"), (5, "./dir", "static"),
        (10, "fs", "require"), (10, "lit", "require"), (10, "pkg/sub", "dynamic"), (12, "types", "static"),
    ]
    assert sorted(tuple(r) for r in T.import_edges(files).collect()) == [("src/m.ts", "src/a.ts"), ("src/m.ts", "src/dir/index.tsx"), ("src/m.ts", "src/side.ts"), ("src/m.ts", "up/d.ts")]
    packages = spark.createDataFrame([("src/a.ts", "own"), ("q/w.ts", "pkg")], "file_path string, package string")
    known = files.select("file_path")
    got = T.imported_packages(T.resolve_specifiers(found, known), packages)
    assert {r.package for r in got.collect()} == {"own", "@x/y", "pkg", "fs", "lit", "types"}


def test_imports_without_a_target_are_spread(spark):
    found = spark.createDataFrame([(f"src/f{i}.ts", "lib/x" if i % 2 else "./gone", None) for i in range(60)] + [("src/a.ts", "./f3", "src/f3.ts")], "file_path string, specifier string, target string")
    packages = spark.createDataFrame([(f"src/f{i}.ts", "own") for i in range(60)], "file_path string, package string")
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        got = T._import_packages(found, packages).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.file_path, r.package) for r in got if r.package) == [("src/a.ts", "own"), *sorted((f"src/f{i}.ts", "lib") for i in range(1, 60, 2))]
    tasks = [r.task for r in got]
    assert max(map(tasks.count, tasks)) < len(tasks) / 2


def test_phantom_dependencies(spark):
    text = "import 'react';\nimport x from 'react/dom'; import { a } from '@s/p/q';\nimport fs from 'node:fs/promises'; import 'fs'; import 'node:test'; import 'test'; import 'self'; import './x'; import 'dev'"
    files = spark.createDataFrame([("p/src/a.ts", text), ("p/src/a.test.ts", "import 'dev'; import 'gone'"), ("p/vite.config.ts", "import 'dev'"), ("p/in/b.ts", "import 'react'"), ("free/c.ts", "import 'react'")], "file_path string, text string")
    manifests = [("p", "self", "dependencies", "react"), ("p", "self", "devDependencies", "dev"), ("p", "self", "peerDependencies", "@s/other"), ("p/in", "inner", None, None)]
    got = T.phantom_dependencies(files, spark.createDataFrame(manifests, "directory string, name string, section string, dependency string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("p/in/b.ts", 1, "react", "undeclared"), ("p/src/a.test.ts", 1, "gone", "undeclared"), ("p/src/a.ts", 2, "@s/p", "undeclared"), ("p/src/a.ts", 3, "dev", "dev only"), ("p/src/a.ts", 3, "test", "undeclared"),
    ]


def test_spans_meet_their_points(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), i, a := rng.randrange(3000), a + rng.randrange(-2, 1500) * (i % 3)) for i in range(150)] + [("a", 900, 0, 10**9), ("b", 901, 5, 5)]
    points = [(rng.choice("ab"), rng.randrange(4000)) for _ in range(200)] + [("a", 10**9), ("c", 7)]
    left = spark.createDataFrame(spans, "f string, id long, lo long, hi long")
    right = spark.createDataFrame(points, "f string, at long")
    got = sorted((r.id, r.at) for r in T.inside(left, right, ["f"], "lo", "hi", "at").collect())
    assert got == sorted((i, p) for f, i, lo, hi in spans for g, p in points if f == g and lo <= p <= hi)
    assert T.inside(left.limit(0), right, ["f"], "lo", "hi", "at").count() == 0
