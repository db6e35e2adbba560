"""Hand cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.operators import clones, graph, joins, ledger, predicates
from codeloom.sources import ingest


def test_resolve_callee_tiers(spark):
    occ = spark.createDataFrame([(1, "h0", "a", "f", "a.ts"), (2, "h1", "a", "x", "b.ts"), (3, "h1", "b", "w", "c.ts"), (4, "h2", "b", "q", "c.ts"), (5, "h2", "c", "p", "d.ts"), (6, "h3", "z", "n2", "e.ts"), (7, "h3", "y", "n1", "f.ts")], "occ_id long, body_hash string, package string, name string, file_path string")
    calls = spark.createDataFrame([(1, "h0"), (1, "h1"), (1, "h2"), (1, "h3"), (1, "unknown")], "src long, to_hash string")
    imports = spark.createDataFrame([("a.ts", "c")], "file_path string, package string")
    got = {r.to_hash: (r.callee, r.tier) for r in joins.resolve_callee(calls, occ, imports).collect()}
    assert got == {"h0": (1, 0), "h1": (2, 1), "h2": (5, 2), "h3": (7, 3)}


def test_strong_components_match_closure(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)}
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    got = graph.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_blast_leaves_the_node_out_of_its_own_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
    assert {r.node: (r.direct, r.transitive, r.score) for r in graph.blast(edges).collect()} == {1: (2, 0, 2.0), 2: (1, 1, 1.5)}


def test_walk_paths(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "src long, dst long")
    got = {r.node: (r.depth, r.parent, list(r.path)) for r in graph.walk(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got[4] == (2, 2, [1, 2, 4]) and got[1][0] == 0


def test_baseline_is_strict_or_bounded(spark):
    a = spark.createDataFrame([("x",), (None,), ("y",), ("y",)], "fingerprint string")
    b = spark.createDataFrame([("x",), ("z",)], "fingerprint string")
    with pytest.raises(ValueError):
        ledger.diff_baseline(a, b)
    got = {r.fingerprint: r.state for r in ledger.diff_baseline(a, b, strict=False).collect()}
    assert got == {"x": "unchanged", "y": "added", "z": "resolved"}


def test_filters_reject_unknown_tokens(spark):
    rows = spark.createDataFrame([("high", "c", "s", "f")], "severity string, category string, source string, file_path string")
    with pytest.raises(ValueError):
        predicates.agent_filter(rows, ["bogus"], ["file_path"])
    with pytest.raises(ValueError):
        ledger.keyset_page(rows, "file_path", None, 501)


def test_scalars(spark):
    df = spark.createDataFrame([("@a/b/c", "x/../y/./z.ts", "a 'b // c' // d\n/* e */f")], "s string, p string, t string")
    r = df.select(S.package_of_specifier(F.col("s")).alias("a"), S.normalize_path(F.col("p")).alias("b"), S.strip_literals(F.col("t")).alias("c"), S.fnv1a(F.lit("a")).alias("d"), S.fuzzy_score(F.lit("src/foo"), "sfo").alias("e"), S.safe_path(F.lit("../x")).alias("f")).first()
    assert (r.a, r.b, r.d, r.f) == ("@a/b", "y/z.ts", "e40c292c", False)
    assert r.c == "a '' \n/* e */f"  # strings and line comments go, block comments stay
    assert r.e == 5
    import re

    assert re.match(S.glob_pattern("src/**/*.{ts,js}"), "src/a/b.ts") and not re.match(S.glob_pattern("src/*.ts"), "src/a/b.ts")


def test_near_duplicates(spark):
    text = "the quick brown fox jumps over the lazy dog " * 4
    rows = [(1, "h1", clones.minhash(text)), (2, "h2", clones.minhash(text + "!")), (3, "h3", clones.minhash("something else entirely, with other words")), (4, "h1", clones.minhash(text))]
    pairs = clones.near_pairs(spark.createDataFrame(rows, "id long, hash string, sig array<bigint>"))
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (2, 4)}
    cover = clones.near_coverage(spark.createDataFrame(rows, "id long, hash string, sig array<bigint>"), bucket_cap=1).first()
    assert not cover.complete and cover.reason == "lsh-bucket-cap" and cover.left_out >= cover.capped > 0
    assert clones.minhash("") is None and clones.grams("abc") == {"abc"}
    with pytest.raises(ValueError):
        clones.near_pairs(spark.createDataFrame(rows, "id long, hash string, sig array<bigint>"), bands=7)


def test_reports_with_nested_findings(spark):
    def read(tool, *texts):
        return {tuple(r) for r in ingest.tool_signals(spark.createDataFrame([(t,) for t in texts], "value string"), tool).collect()}

    audit = '{"dependencies":[{"name":"a","version":"1","vulns":[{"id":"P-1","description":"bad"},{"id":"P-2"}]},{"name":"clean","version":"2","vulns":[]},{"name":"b","skip_reason":"not found"}]}'
    assert read("pip-audit", audit, "no json") == {("pip-audit", "P-1", "", None, None, "bad (a@1)", "high"), ("pip-audit", "P-2", "", None, None, "P-2 (a@1)", "high"), ("pip-audit", "pip-audit-skipped-dependency", "", None, None, "not found", "medium")}
    clippy = '{"reason":"compiler-message","message":{"message":"m","level":"warning","code":{"code":"clippy::x"},"spans":[{"is_primary":false,"file_name":"o.rs","line_start":1},{"is_primary":true,"file_name":"a.rs","line_start":7,"column_start":3}]}}\n{"reason":"compiler-message","message":{"message":"2 warnings emitted","spans":[],"code":null}}\nplain\n{"reason":"build-finished"}'
    (row,) = read("cargo-clippy", clippy)
    assert row[:6] == ("cargo-clippy", "clippy::x", "a.rs", 7, 3, "m")
    vuln = '{"osv":{"id":"GO-1","summary":"s"}}\n{"finding":{"osv":"GO-1","trace":[{"module":"m"}]}}\n{"finding":{"osv":"GO-1","trace":[{"module":"m"},{"function":"f","position":{"filename":"a.go","line":4,"column":2}}]}}\n{"finding":{"osv":"GO-2","trace":[]}}'
    assert read("govulncheck", vuln) == {("govulncheck", "GO-1", "a.go", 4, 2, "s", "high"), ("govulncheck", "GO-2", "", None, None, "Go vulnerability detected (GO-2) (imported, not called)", "medium")}


def test_strings_go_before_comments(spark):
    code = 'u = "http://x.y"; f(1) // end\nv = `a\nb` /* c\nd */ + \'it\\\'s\''
    rows = spark.createDataFrame([(code, '"' + "x" * 200_000 + '"')], "t string, long string")
    r = rows.select(S.strip_literals(F.col("t")).alias("a"), S.blank_literals(F.col("t")).alias("b"), S.strip_literals(F.col("long")).alias("c"), S.blank_literals(F.col("long")).alias("d")).first()
    assert r.a == 'u = ""; f(1) \nv = `` /* c\nd */ + \'\''
    assert r.b == 'u = "          "; f(1)       \nv = ` \n `     \n     + \'     \'' and len(r.b) == len(code)
    assert r.c == '""' and len(r.d) == 200_002 and r.d.strip('"').isspace()


def test_directives_of_other_checks_are_passed(spark):
    findings = spark.createDataFrame([(1, n, c) for n in range(1, 6) for c in ("c1", "c2")], "id long, number int, check string")
    directives = spark.createDataFrame([(1, 1, "next", "c1"), (1, 2, "next", "c2")], "id long, number int, scope string, check string")
    got = predicates.suppressed(findings, directives, ["id"], check="check").filter("suppressed").collect()
    assert {(r.number, r.check) for r in got} == {(3, "c1"), (3, "c2")}


def test_next_line_directives_mean_one_line(spark):
    findings = spark.createDataFrame([(1, n) for n in range(1, 12)], "id long, number int")
    directives = spark.createDataFrame([(1, n, "next") for n in (1, 5, 6, 7, 8, 9)], "id long, number int, scope string")
    got = {r.number for r in predicates.suppressed(findings, directives, ["id"]).filter("suppressed").collect()}
    assert got == {2, 9, 10}  # 5 passes 6, 7, 8 and no more; 6 to 9 mean 10
    whole = spark.createDataFrame([(1, 50, "file")], "id long, number int, scope string")
    assert predicates.suppressed(findings, whole, ["id"]).filter("suppressed").count() == 11


def test_tool_reports(spark):
    docs = spark.createDataFrame([('{"code":"E1","filename":"a.py","location":{"row":3},"message":"m","severity":"error"}\n',)], "value string")
    r = ingest.tool_signals(docs, "ruff").first()
    assert (r.rule_id, r.file_path, r.line, r.severity) == ("E1", "a.py", 3, "high")
    sarif = '{"runs":[{"tool":{"driver":{"name":"t","rules":[{"id":"R","properties":{"security-severity":"9.1"}}]}},"results":[{"ruleId":"R","message":{"text":"x"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"b.c"},"region":{"startLine":0}}}]}]}]}'
    r = ingest.tool_signals(spark.createDataFrame([(sarif,)], "value string"), "semgrep").first()
    assert (r.source, r.severity, r.line, r.file_path) == ("t", "critical", None, "b.c")


def test_stream_append(spark, tmp_path):
    from codeloom.streaming.append import append_stream

    spark.range(5).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    append_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"]).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_clusters_keep_hubs_when_the_cut_severs_all_pairs(spark):
    star = [(i, 1000, 0.9) for i in range(1, 61)]
    split = [(2001, 2002, 0.9), (2002, 2003, 0.95)]
    got = {r.cluster: r for r in clones.cluster_rows(spark.createDataFrame(star + split, "a long, b long, similarity double"), cap=50, hashes=spark.createDataFrame([(2001, "x"), (2003, "x"), (2002, "y")], "node long, hash string")).collect()}
    assert got[1].size == 50 and got[1].capped and 1000 in got[1].members and 60 not in got[1].members
    assert (got[2001].size, got[2001].capped, got[2001].similarity, got[2001].exact_members) == (3, False, 0.95, [2001, 2003])


def test_clusters_give_the_largest_part_that_the_cut_leaves(spark):
    pairs = [(1, 2, 0.99), (2, 9, 0.9), (3, 4, 0.9), (4, 5, 0.9), (5, 9, 0.9)]
    r = clones.cluster_rows(spark.createDataFrame(pairs, "a long, b long, similarity double"), cap=5).first()
    assert (r.cluster, r.anchor, r.members, r.capped) == (1, 3, [3, 4, 5], True)


def test_incremental_closure_matches_brute_force(spark):
    rng = random.Random(5)
    files = [f"f{i}" for i in range(30)]
    cached = {(rng.choice(files), f"h{rng.randrange(40)}") for _ in range(70)}
    fresh = {(f, h if rng.random() < 0.5 else h + "*") for f, h in sorted(cached)}
    calls = {(rng.choice(files), f"h{rng.randrange(40)}") for _ in range(60)}
    closure = {"f1", "f2", "f3", "f4"}
    while True:
        walked = {h for f, h in fresh if f in closure}
        lost = {h for f, h in cached if f in closure} - walked
        more = {f for f, h in calls if h in lost} - closure
        if not more:
            break
        closure |= more
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), names)
    got = graph.incremental_closure(frame(cached, ["file_path", "body_hash"]), frame(calls, ["file_path", "to_hash"]), frame(fresh, ["file_path", "body_hash"]), spark.createDataFrame([("f1",), ("f2",), ("f3",), ("f4",)], ["file_path"]))
    assert {r.file_path for r in got.collect()} == closure and 4 < len(closure) < 30


def test_weakest_hop_and_doubts(spark):
    paths = spark.createDataFrame([(1, [1]), (2, [1, 2, 3]), (3, [1, 2]), (4, [7, 8])], "id int, path array<long>")
    evidence = spark.createDataFrame([(1, 2, "high"), (2, 3, "medium"), (2, 3, "low")], "src long, dst long, confidence string")
    assert {r.id: r.weakest for r in graph.weakest_hop(paths, evidence).collect()} == {1: None, 2: "low", 3: "high", 4: None}
    changed = spark.createDataFrame([("a\\b", None), ("gone", "deleted"), ("new", "renamed"), ("odd", "modified")], "path string, status string")
    got = {(r.code, r.file_path) for r in graph.impact_doubts(changed, spark.createDataFrame([("a/b",), ("new",)], ["file_path"]), complete=False).collect()}
    assert got == {("graph-catalog-incomplete", None), ("changed-file-deleted", "gone"), ("changed-file-renamed", "new"), ("changed-file-unmatched", "odd")}
    assert graph.impact_doubts(changed.limit(0), spark.createDataFrame([("x",)], ["file_path"])).isEmpty()


def test_dynamic_imports(spark):
    occ = spark.createDataFrame([(1, "src/a.ts", True), (2, "src/a.ts", False), (3, "lib/index.ts", True), (4, "src/b.ts", True), (5, "x.ts", True)], "occ_id long, file_path string, exported boolean")
    texts = ["await import('./a.js')", 'import("../lib")', "import('b')", "import('../../x.ts')", "require('./b')"]
    got = joins.dynamic_import_entries(spark.createDataFrame([("src/m.ts", t) for t in texts], ["file_path", "text"]), occ)
    assert {r.node for r in got.collect()} == {1, 3}


def test_values_thrown_away(spark):
    from codeloom.operators import rules

    names = "occ_id long, kind string, in_test boolean, exported boolean, line long, end_line long, return_type string"
    occ = spark.createDataFrame([(i, "function", False, True, 1, 20, "void" if i == 5 else None) for i in range(1, 9)], names)
    leaves = [(n, to, "f()", None) for n in (2, 3, 4, 5) for to in (7, 8)]
    calls = [*leaves, (1, 2, "g()", True), (1, 3, "g()", True), (6, 3, "g()", False), (1, 4, "g()", None), (1, 5, "g()", True), (1, 6, "list.push(x)", True), (6, None, "?", None)]
    got = rules.no_side_effect_path(occ, spark.createDataFrame(calls, "src long, dst long, text string, discarded boolean"))
    assert {r.occ_id for r in got.collect()} == {2, 4}


def test_bounded_json(spark):
    import json

    deep = {"a": "x" * 600, "b": list(range(20)), "c": {"d": {"e": [1]}, "f": {}}, "n": None}
    rows = [(json.dumps(deep),), ("[]",), ("no json",), (None,), (json.dumps({str(i) + "k": i for i in range(20)}),), ("[1, NaN]",)]
    got = [r.j for r in spark.createDataFrame(rows, "t string").coalesce(1).select(S.bounded_json(F.col("t")).alias("j")).collect()]
    assert json.loads(got[0]) == {"a": "x" * 500, "b": list(range(10)), "n": None}
    assert got[1:4] == [None] * 3 and len(json.loads(got[4])) == 16 and got[5] == "[1]"


def test_pages_go_through_all_rows_once(spark):
    rows = spark.range(1, 24)
    seen, cursor = [], None
    while True:
        page, cursor, total = ledger.read_page(rows, "id", {"q": 1}, "g1", 10, cursor)
        seen += [r.id for r in page.orderBy("id").collect()]
        if cursor is None:
            break
        assert ledger.decode_cursor(cursor, ledger.query_digest({"q": 1}), "g1") == seen[-1]
        for bad in ((cursor[:-3] + "abc", {"q": 1}, "g1"), (cursor, {"q": 2}, "g1"), (cursor, {"q": 1}, "g2"), ("!", {"q": 1}, "g1")):
            with pytest.raises(ValueError, match="cursor-invalid"):
                ledger.decode_cursor(bad[0], ledger.query_digest(bad[1]), bad[2])
    assert seen == list(range(1, 24)) and total == 23


def test_clone_eligibility(spark):
    from codeloom.operators import clones as C

    rows = [(1, "function", False, 1, 5, None), (2, "arrow", False, 1, 9, None), (3, "function", True, 1, 9, None), (4, None, None, 1, 4, None), (5, "method", False, 1, 2, 7), (6, "method", False, 1, 20, 4), (7, "module-init", False, 1, 9, None), (8, "function-expression", False, 1, 9, 9)]
    cands = spark.createDataFrame(rows, "id int, kind string, in_test boolean, line long, end_line long, body_lines long")
    assert {r.id for r in C.eligible(cands).collect()} == {1, 4, 5, 6}
    assert {r.id for r in C.long_enough(C.eligible(cands)).collect()} == {1, 5}
    assert {r.id for r in C.long_enough(cands.drop("body_lines")).collect()} == {1, 2, 3, 6, 7, 8}


def test_twins_on_one_line_keep_their_own_edges(spark):
    key = "body_hash string, file_path string, line long, column long"
    owners = spark.createDataFrame([(1, "h", "a.ts", 3, 0), (2, "h", "a.ts", 3, 40), (3, "h", "a.ts", 3, 80)], f"occ_id long, {key}")
    exact = spark.createDataFrame([("h", "a.ts", 3, 0, 10), ("h", "a.ts", 3, 40, 20)], f"{key}, edges long")
    got = joins.stitch(owners, exact, spark.createDataFrame([("h", 10)], "body_hash string, edges long"))
    assert sorted((r.occ_id, r.edges) for r in got.collect()) == [(1, 10), (2, 20), (3, 10)]


def joins_by_broadcast(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_exploded_spans_are_not_broadcast(spark):
    occ = spark.createDataFrame([("a.ts", 1, 1, 9), ("a.ts", 2, 2, 5), ("b.ts", 3, 2, 5)], "file_path string, occ_id long, line long, end_line long")
    nested = joins.nested_spans(occ)
    assert [tuple(r) for r in nested.collect()] == [(1, 2)] and not joins_by_broadcast(nested)


def test_graph_steps_are_not_broadcast(spark):
    from codeloom.operators import rules
    from codeloom.plans.shared import iterate

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    occ = spark.createDataFrame([(k, "f", False, True, 1, 20, None) for k in range(1, 5)], "occ_id long, kind string, in_test boolean, exported boolean, line long, end_line long, return_type string")
    calls = edges.withColumns({"text": F.lit("f()"), "discarded": F.lit(True)})
    grown = iterate(seeds, lambda f, _: f.join(edges.hint("merge"), f["node"] == edges["src"]).select(F.col("dst").alias("node")), ["node"], 2)
    assert sorted(r.node for r in grown.collect()) == [1, 2, 3]
    for found in (rules.no_side_effect_path(occ, calls, min_calls=1), rules.high_blast(occ, graph.blast(edges), graph.reachable(edges, seeds), 1, 2)):
        assert not joins_by_broadcast(found)
    assert sorted(r.node for r in graph.reachable(edges, seeds).collect()) == [1, 2, 3, 4]


def test_long_texts_are_signed_in_bounded_memory(spark):
    import hashlib
    import tracemalloc

    import numpy as np

    def plain(text):
        x = np.frombuffer(b"".join(hashlib.sha256(g.encode()).digest()[:4] for g in clones.grams(text)), "<u4")[:, None] ^ np.array(clones.seeds(), np.uint32)[None, :]
        for _ in range(2):
            x = ((x >> np.uint32(16)) ^ x) * np.uint32(clones.MIX)
        return ((x >> np.uint32(16)) ^ x).min(axis=0).tolist()

    rng = random.Random(3)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü ", k=150_000))
    for text in ("a", "abcd", "abcde", letters[:1500], letters[: clones.PIECE + 4], letters[: clones.PIECE + 5]):
        assert clones.minhash(text) == plain(text)
    tracemalloc.start()
    clones.minhash(letters)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
