"""Named reads, recipes and selections on small hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.operators import aggregates as A
from codeloom.operators import ledger as L
from codeloom.operators import predicates as P
from codeloom.operators import reads as N
from codeloom.operators import rules as R

SIGNAL = "rule_id string, occ_id long, severity string, message string"


def test_failing_rule_is_a_signal(spark):
    good = lambda: spark.createDataFrame([("graph:cycle", 1, "high", "x")], SIGNAL)
    broken = lambda: spark.createDataFrame([(1,)], "occ_id long").select("nothing")
    late = lambda: spark.range(1).select(F.lit("r").alias("rule_id"), F.raise_error(F.lit("late")).cast("long").alias("occ_id"), F.lit("low").alias("severity"), F.lit("m").alias("message"))
    rows = R.run_recipe("agent-risk", {"cycle": good, "large-function": broken, "wide-function": late, "orphan-subtree": good}, spark).collect()
    assert sorted((r.rule_id, r.severity) for r in rows) == [("graph:cycle", "high"), ("graph:large-function", "high"), ("graph:wide-function", "high")]
    assert all(r.message.startswith("error") for r in rows if r.rule_id != "graph:cycle")


def test_resolve_checks(spark):
    checks = spark.createDataFrame([("a:x", ["security"], False), ("b:x", ["testing"], None), ("a:y", None, True), ("a:flaky-z", ["testing"], False)], "slug string, tags array<string>, disabled boolean")
    take = lambda s, **more: sorted(r.slug for r in R.resolve_checks(checks, s, **more).collect())
    assert take(R.Selector("all")) == ["a:flaky-z", "a:x", "b:x"]
    assert take(R.CHECK_RECIPES["ci"]) == ["a:x", "b:x"]
    assert take(R.Selector("all"), include_disabled=("y",), disabled=("a:x",)) == ["a:flaky-z", "a:y", "b:x"]
    assert take(R.Selector("explicit", ("x", "flaky-z"))) == ["a:flaky-z"]  # two checks end in x
    assert take(R.Selector("explicit", ("b:x",))) == ["b:x"]
    assert take(R.Selector("tags", ("testing",), ("security",))) == ["a:flaky-z", "b:x"]
    assert take(R.Selector("pattern", ("security/*", "testing/x"), ("b:*",))) == ["a:x"]
    with pytest.raises(ValueError, match="unknown selector"):
        R.resolve_checks(checks, R.Selector("some"))


def test_duplicate_signals(spark):
    rows = [(f"{h}{i}", i, h, p, n) for h, i, p, n in [("w", 1, "a", 90), ("w", 2, "b", 90), ("w", 3, "c", 90), ("e", 4, "a", 300), ("e", 5, "a", 300), ("u", 6, "a", None), ("u", 7, "b", None), ("s", 8, "a", 100), ("s", 9, "a", 100)]]
    found = R.duplicate_signals(spark.createDataFrame([*rows, rows[0]], "site string, occ_id long, body_hash string, package string, size long")).collect()
    assert sorted((r.occ_id, r.message) for r in found) == [(1, "shared by 3 packages: a, b, c"), (5, "same body as e4"), (7, "same body as u6")]


def test_coverage_facets(spark):
    reasons = spark.createDataFrame([("inventory", "b-cap"), ("inventory", "b-cap"), ("inventory", "a"), ("evidence", "lost")], "facet string, reason string")
    rows = {r.facet: r for r in N.coverage_facets(reasons, ("inventory", "grouping")).collect()}
    assert rows["inventory"].reasons == ["a", "b-cap"] and rows["inventory"].truncated and not rows["inventory"].complete
    assert not rows["evidence"].requested and not rows["evidence"].complete and not rows["evidence"].truncated
    assert rows["all"].reasons == ["a", "b-cap"] and rows["projection"].complete
    assert all(r.complete for r in N.coverage_facets(reasons.limit(0), ()).collect())


def test_shortest_traces(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(1, 3), (3, 1), (20, 5), (30, 31)], "src long, dst long")
    of = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    rows = {r.node: r.path for r in N.shortest_traces(edges, of(1, 20), of(1, 5, 12, 31, 12)).collect()}
    assert rows == {1: [1], 5: [20, 5], 12: [20, *range(5, 13)]}


def test_within_bytes(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("size"))
    found = [(r.id, r.so_far) for r in L.within_bytes(rows, [F.desc("id")], "size", 500).orderBy(F.desc("id")).collect()]
    wanted, so_far = [], 0
    for i in range(999, -1, -1):
        so_far += i % 7
        if so_far > 500:
            break
        wanted.append((i, so_far))
    assert found == wanted
    assert L.within_bytes(rows.limit(0), [F.col("id")], "size", 5).count() == 0


def test_confidence_floor_and_units(spark):
    rows = spark.createDataFrame([(1, "low", "a"), (2, "medium", "b"), (3, "high", None), (4, None, "b"), (5, None, None)], "id long, confidence string, category string")
    assert [r.id for r in rows.filter(P.confidence_floor("medium")).orderBy("id").collect()] == [2, 3, 4, 5]
    assert [r.id for r in rows.filter(P.confidence_floor("low", ("a",))).orderBy("id").collect()] == [1, 3, 5]
    units = spark.createDataFrame([("a", True, None, 5), ("b", False, None, 1), ("c", True, "boom", 2)], "unit string, passed boolean, failed_with string, duration long")
    signals = spark.createDataFrame([("b", True), ("b", False), ("z", True)], "source string, is_error boolean")
    table = A.unit_table(units, signals)
    assert sorted(map(tuple, table.collect())) == [("a", "PASS", 0, 0, 5), ("b", "FAIL", 1, 1, 1), ("c", "ERROR", 0, 0, 2)]
    assert tuple(A.unit_summary(table).first()) == (1, 2, 1, 1, 8)
