"""Groups of findings: order, ids, equal member sets, hot keys and odd values."""

from __future__ import annotations

from codeloom.operators import correlation as K

NAMES = """ref string, source string, rule_id string, file_path string, line long, col long, severity string, is_new boolean, dependents long, fingerprint string, step_index long,
  signal_index long, qualified_name string, body_hash string, scc_id string, packages array<string>, package string"""


def finding(ref, **given):
    row = dict(ref=ref, source="lint", rule_id="r", file_path=None, line=None, col=None, severity="low", is_new=False, dependents=None, fingerprint=None, step_index=0, signal_index=0, qualified_name=None, body_hash=None, scc_id=None, packages=None, package=None)
    assert given.keys() <= row.keys()
    return tuple((row | given).values())


def test_entities_and_keys(spark):
    rows = [finding("a", file_path=" apps\\web\\x.ts ", line=3, col=4, fingerprint="f", qualified_name="  ", body_hash="h", scc_id="s", packages=["apps", "/abs", "b"], package="b"), finding("b", file_path="/abs/x.ts", line=1), finding("none"), finding("long", package="p" * 300)]
    data = spark.createDataFrame(rows, NAMES)
    named = {}
    for r in K.entities(data).orderBy("ref", "position").collect():
        named.setdefault(r.ref, []).append((r.kind, r.id))
    assert named["a"] == [("fingerprint", "f"), ("file", "apps/web/x.ts"), ("file-range", "apps/web/x.ts:3:4"), ("graph-node", "body:h"), ("graph-node", "scc:s"), ("package", "apps"), ("package", "b")]
    assert named["b"] == [("file", "/abs/x.ts"), ("file-range", "/abs/x.ts:1")]
    assert "none" not in named and named["long"] == [("package", "p" * 240)]
    keyed = {(r.ref, r.kind, r.value) for r in K.keys(data).collect()}
    assert ("a", "rule-location", "r|apps/web/x.ts|3|4") in keyed and ("b", "rule-location", "r|/abs/x.ts|1|") in keyed


def test_most_important_keys_are_kept(spark):
    data = spark.createDataFrame([finding("a", file_path="x/y.ts", fingerprint="f", packages=[f"p{k:02}" for k in range(20)])], NAMES)
    kinds = [r.kind for r in K.keys(data).collect()]
    assert len(kinds) == 12 and kinds[:2] == ["fingerprint", "rule-location"] and kinds.count("package") == 10


def test_groups(spark):
    rows = [
        finding("1", file_path="a/x.ts", line=1, severity="high"), finding("2", file_path="a/x.ts", line=2, severity="critical", dependents=2),
        finding("3", file_path="a/y.ts", severity="critical", dependents=9, is_new=True), finding("4", file_path="b/z.ts", body_hash="k"), finding("5", body_hash="k", severity="medium"), finding("6", fingerprint="lone"),
    ]
    data = spark.createDataFrame(rows, NAMES)
    for limit in (10, None):
        got = {r.id: r for r in K.groups(data, limit).collect()}
        assert set(got) == {"corr-package-a", "corr-file-a-x-ts", "corr-graph-node-body-k"}
        a = got["corr-package-a"]
        assert (a.primary, a.severity, a.is_new, a.dependents, a.n) == ("3", "critical", True, 9, 3)
        assert got["corr-file-a-x-ts"].primary == "2" and got["corr-graph-node-body-k"].primary == "5"
    assert K.groups(data).filter("id = 'corr-package-a'").first().members == ["3", "2", "1"]
    assert [r.id for r in K.groups(data, group_limit=1).collect()] == ["corr-package-a"]


def test_same_members_and_ids(spark):
    rows = [finding(str(k), file_path=p, qualified_name=q) for k, (p, q) in enumerate([("s/a.b", None), ("s/a.b", None), ("s/a-b", None), ("s/a-b", None), ("t/c", "C"), ("t/c", "C")])]
    got = {r.id: (r.kind, r.value) for r in K.groups(spark.createDataFrame(rows, NAMES)).collect()}
    assert got == {
        "corr-rule-location-r-s-a-b": ("rule-location", "r|s/a-b||"), "corr-rule-location-r-s-a-b-2": ("rule-location", "r|s/a.b||"),
        "corr-package-s": ("package", "s"), "corr-symbol-c": ("symbol", "C")}


def test_hot_key_and_member_limit(spark):
    rows = [finding(f"{k:05}", file_path=f"hot/{k}.ts", signal_index=k) for k in range(3000)]
    data = spark.createDataFrame(rows, NAMES).repartition(16)
    (got,) = K.groups(data).collect()
    assert (got.n, got.value, len(got.members), got.primary) == (3000, "hot", 10, "00000")
    assert "WindowGroupLimit" in K.groups(data)._jdf.queryExecution().toString()
    assert K.group_entities(data).count() == 12


def test_no_findings(spark):
    empty = spark.createDataFrame([], NAMES)
    assert K.groups(empty).count() == K.group_entities(empty).count() == 0


def test_files_alone_hot_files_and_groups_that_need_more_findings(spark, monkeypatch):
    rows = [finding(f"{k:03}", rule_id=f"r{k % 2}", file_path=("a|b:1.ts", "a|b:1", "b", "c/d.ts")[k % 4], line=k % 3 or None, col=k % 5 or None, fingerprint=f"f{k % 7}" if k < 90 else f"g{k}", severity=("low", "odd", "high")[k % 3], signal_index=k) for k in range(120)]
    data = spark.createDataFrame(rows, NAMES)
    got = lambda df: sorted(map(str, df.collect()))
    shown = [got(K.groups(data, 10, None)), got(K.groups(data, None, None)), got(K.group_entities(data))]
    monkeypatch.setattr(K, "HOT", 5)
    monkeypatch.setattr(K, "AHEAD", 3)
    assert shown == [got(K.groups(data, 10, None)), got(K.groups(data, None, None)), got(K.group_entities(data))]
    plain = {}  # entities of each key, by order of the findings
    keys, named, order = {}, {}, {r.ref: r.n for r in K.numbered(data).selectExpr("ref", "rank as n").collect()}
    for r in K.keys(data).collect():
        keys.setdefault((r.kind, r.value), set()).add(r.ref)
    for r in K.entities(data).orderBy("ref", "position").collect():
        named.setdefault(r.ref, []).append((r.kind, r.id))
    for key, refs in keys.items():
        if len(refs) > 1:
            plain[key] = list(dict.fromkeys(e for ref in sorted(refs, key=order.get) for e in named[ref]))[:12]
    found = {}
    for r in K.group_entities(data).orderBy("kind", "value", "place").collect():
        found.setdefault((r.kind, r.value), []).append((r.entity_kind, r.entity_id))
    assert found == plain


def test_groups_at_files_take_one_shuffle_of_findings(spark):
    data = spark.createDataFrame([finding(str(k), file_path="a/x.ts", line=k) for k in range(3)], NAMES)
    (near, by), _ = K._parts(K.numbered(data), ["rank"])
    assert near.groupBy(*by).count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_findings_are_written_once_without_keys_and_entities(spark):
    data = spark.createDataFrame([finding("a", file_path="a/x.ts", line=1)], NAMES)
    assert not {"keys", "entities", "home"} & set(K.numbered(data).columns)


def test_findings_alone_at_their_place_have_the_key_of_their_file_only(spark):
    rows = [finding(str(k), file_path="a/x.ts", line=k, col=k // 4) for k in range(5)] + [finding("l", file_path="a/y.ts", line=7), finding("m", file_path="a/y.ts", line=7), finding("n", file_path="a/y.ts")]
    (near, _), _ = K._parts(K.numbered(spark.createDataFrame(rows, NAMES)), ["ref"])
    got = sorted((r.ref, K.KINDS[int(r.key[0])]) for r in near.collect())
    assert [kind for ref, kind in got if ref in ("4", "n")] == ["file", "file"]
    assert [kind for ref, kind in got if ref == "l"] == ["file", "file-range", "rule-location"] and len(got) == 5 + 2 * 4 + 3 + 2 * 2


def test_whole_sets_are_summed_up_without_an_order_in_each_group(spark):
    data = spark.createDataFrame([finding(str(k), file_path="a/x.ts", line=k, fingerprint="f") for k in range(3)], NAMES)
    plan = K.groups(data, None, None)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and "windowspecdefinition(slot" not in plan


def test_white_space_many_packages_and_large_numbers(spark):
    packages = [f"p{k:02}" for k in range(14)]
    rows = [
        finding("a", file_path="\u3000s/x.ts\u00a0\n", line=3, fingerprint="\x1cf\x1c", packages=packages, package="s", dependents=2**60), finding("b", file_path="s/x.ts", line=3, packages=[" ", "C:/d", *packages[:5]], dependents=2**58),
        finding("c", file_path="s\\x.ts", line=None, col=3, fingerprint=" \u2003f", severity="odd", dependents=-(2**60)), finding("d", file_path="é.ts é", qualified_name="é\u2028", severity="odd", dependents=-(2**58)), finding("e", file_path=" /s", package=" /q"),
    ]
    data = spark.createDataFrame(rows, NAMES)
    named, keyed = {}, {}
    for r in K.entities(data).orderBy("ref", "position").collect():
        named.setdefault(r.ref, []).append((r.kind, r.id))
    for r in K.keys(data).collect():
        keyed.setdefault(r.ref, []).append((r.kind, r.value))
    assert named["a"] == [("fingerprint", "\x1cf\x1c"), ("file", "s/x.ts"), ("file-range", "s/x.ts:3")] + [("package", p) for p in packages[:9]]
    assert named["b"] == [("file", "s/x.ts"), ("file-range", "s/x.ts:3")] + [("package", p) for p in [*packages[:5], "s"]]
    assert named["c"] == [("fingerprint", "f"), ("file", "s/x.ts"), ("package", "s")]
    assert named["d"] == [("file", "é.ts é"), ("symbol", "é"), ("package", "é.ts é")] and named["e"] == [("file", "/s")]
    assert len(keyed["a"]) == 12 and ("file", "s/x.ts") not in keyed["a"] and ("file", "s/x.ts") in keyed["b"] and ("rule-location", "r|s/x.ts||3") in keyed["c"]
    assert [r.ref for r in K.numbered(data).orderBy("rank").select("ref").collect()] == ["a", "b", "e", "d", "c"]
    groups = {r.id: (r.n, r.primary) for r in K.groups(data, None, None).collect()}
    assert groups["corr-package-s"] == (2, "b") and groups["corr-rule-location-r-s-x-ts-3"] == (2, "a")


def test_first_entities_of_a_group_take_one_window_and_no_row_for_each(spark):
    data = spark.createDataFrame([finding(str(k), file_path="a/x.ts", line=k, fingerprint=f"f{k}") for k in range(20)], NAMES)
    parts = K._parts(K.numbered(data), ["rank", *K.NAMED])
    for part, by in parts:
        plan = K._first_entities(part, by, 12)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("row_number() windowspecdefinition(") == 1 and "lead(" not in plan and "posexplode" not in plan
    (near, by), _ = parts
    got = {r.key: r for r in K._first_entities(near, by, 12).collect()}
    assert len(got) == 1 and len(got["6a/x.ts"].entities) == 12 and not got["6a/x.ts"].whole
