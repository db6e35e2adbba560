"""Links between packages and layers of targets, by hand cases."""

from __future__ import annotations

from codeloom.functions import scalars as S
from codeloom.operators import exports as X
from codeloom.sources import targets as T


def packages(spark):
    return spark.createDataFrame([("@s/a",), ("b",), ("c",)], "package string")


def test_surface(spark):
    asked = spark.createDataFrame([(x,) for x in ("@s/a", "@s/a/in/x", "@s/a/in/private/y", "@s/a/out", "b", "b/any/thing", "@s/z", "./b", "/b", "", None, "c")], "specifier string")
    surface = spark.createDataFrame([("@s/a", ".", True), ("@s/a", "./in/*", True), ("@s/a", "./in/private/*", False), ("c", "./only", True)], "package string, subpath string, allowed boolean")
    got = {(r.specifier, r.package, r.subpath) for r in X.specifier_packages(asked, packages(spark), surface).collect()}
    assert got == {("@s/a", "@s/a", None), ("@s/a/in/x", "@s/a", "./in/x"), ("b", "b", None), ("b/any/thing", "b", "./any/thing")}


def test_link_exported(spark):
    exports = [("b", "one", 1, "packages/b/x.ts"), ("b", "two", 2, "packages/b/src/u.ts"), ("b", "two", 3, "packages/b/src/v/index.ts"), ("b", "two", 4, "packages/b/src/index.ts"), ("c", "root", 5, "v/index.ts"), ("c", "root", 6, "w.ts")]
    calls = [("b", "one"), ("b/no/such", "one"), ("b", "two"), ("b/src/u.js", "two"), ("b/u", "two"), ("b/v", "two"), ("b/src", "two"), ("b", "none"), ("x", "one"), ("./b", "one"), (None, "one"), ("c/v", "root"), ("c/v/index", "root")]
    got = X.link_exported(spark.createDataFrame(calls, "specifier string, name string"), spark.createDataFrame(exports, "package string, name string, target long, file_path string"), packages(spark))
    assert {(r.specifier, r.name): (r.target, r.link) for r in got.collect()} == {
        ("b", "one"): (1, "linked"), ("b/no/such", "one"): (1, "linked"), ("b", "two"): (None, "ambiguous"), ("b/src/u.js", "two"): (2, "linked"), ("b/u", "two"): (2, "linked"), ("b/v", "two"): (3, "linked"),
        ("b/src", "two"): (4, "linked"), ("b", "none"): (None, "missing"), ("x", "one"): (None, "external"), ("./b", "one"): (None, "local"), (None, "one"): (None, "local"),
        ("c/v", "root"): (None, "ambiguous"), ("c/v/index", "root"): (5, "linked")}


def test_reconcile(spark):
    declared = [("d1", "b", "f", "function", True), ("d2", "b", "g", "function", True), ("d3", "b", "g", "function", True), ("d4", "b", "h", "function", False), ("d2", "b", "k", "type", True), ("d2", "b", "k", "type", True)]
    refs = [(1, "d1", "b", "f", "function"), (2, "gone", "b", "f", "function"), (3, None, "b/sub", "f", "function"), (4, None, "b", "g", "function"), (5, None, "b/sub", "g", "function"), (6, None, "b", "h", "function"), (7, None, "npm", "f", "function"), (8, None, "./b", "f", "function"), (9, None, "b", "f", None), (10, None, "b", "k", "type")]
    got = X.reconcile_references(spark.createDataFrame(refs, "ref int, target string, specifier string, name string, kind string"), spark.createDataFrame(declared, "declaration string, package string, name string, kind string, exported boolean"), packages(spark))
    assert {r.ref: (r.target, r.package, r.basis, r.reason) for r in got.collect()} == {
        1: ("d1", None, "kept", None), 2: (None, None, "unresolved", "target-missing-after-merge"), 3: ("d1", "b", "workspace-export-index", None), 4: (None, "b", "ambiguous", "cross-package-join-ambiguous"),
        5: (None, "b", "unresolved", "cross-package-join-not-found"), 6: (None, "b", "unresolved", "cross-package-join-not-found"), 7: (None, None, "external", "external-or-unmapped-specifier"),
        8: (None, None, "local", None), 9: (None, "b", "unresolved", "cross-package-join-incomplete-descriptor"), 10: ("d2", "b", "workspace-export-index", None)}


def test_globs_and_dots():
    import re

    hit = lambda glob, path, dot: re.fullmatch(S.glob_pattern(glob, dot)[1:-1], path) is not None
    for path, dot in ((".a/b.ts", False), ("a/.b.ts", False), ("a/.c/b.ts", False)):
        assert not hit("**/*.ts", path, dot) and hit("**/*.ts", path, True)
    assert hit("**/*.ts", "b.ts", False) and hit("**/*.ts", "x/y/b.ts", False) and hit(".a/*.ts", ".a/b.ts", False) and hit("a/{b,c}/?", "a/c/d", False)
    assert hit("a/**", "a/b/c", False) and not hit("a/**", "a/b/.c", False) and not hit("a/?", "a/.", False)


def test_targets(spark):
    paths = ["/r/src/a.ts", "/r/src/./b.ts", "/r/src/.hid.ts", "/r/src/gen/c.ts", "/r/node_modules/x.ts", "/r/src/dist/d.ts", "/other/src/e.ts", "/r/../q/src/f.ts", "/r/lib/g.js", "/r2/src/h.ts", "/r/src/a.ts", None]
    files = spark.createDataFrame([(p,) for p in paths], "file_path string")
    targets = [T.Target("ts", ("src/**/*.ts",), ("src/gen/**",)), T.Target("all", ("**/*",)), T.Target("none", ())]
    got = {(r.file_path, r.target) for r in T.memberships(files, "/r/", targets, ("**/b.ts",)).collect()}
    assert got == {("/r/src/a.ts", "ts"), ("/r/src/a.ts", "all"), ("/r/src/gen/c.ts", "all"), ("/r/lib/g.js", "all")}
    assert [(r.file_path, r.capped) for r in T.resolve_targets(files, "/r", targets, ("**/b.ts",), 2).orderBy("file_path").collect()] == [("/r/lib/g.js", True), ("/r/src/a.ts", True)]
    assert {r.capped for r in T.resolve_targets(files, "/r", targets, ("**/b.ts",), 3).collect()} == {False}
    bounded = {r.file_path: (r.targets, r.targets_capped) for r in T.bounded_memberships(files, "/r", targets, ("**/b.ts",), max_targets=1).collect()}
    assert bounded["/r/src/a.ts"] == (["all"], True) and bounded["/r/lib/g.js"] == (["all"], False)
    assert T.memberships(files, "/r", [], ()).count() == 0
