"""Exact ranks against sorted lists, on one huge group, ties, nulls and empty tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import aggregates as A
from codeloom.operators import ranks as Q

NAMES = "g string, v double"


def groups():
    rnd = random.Random(5)
    rows = [("hot", rnd.lognormvariate(0, 40)) for _ in range(6000)] + [("ties", float(rnd.choice([1, 1, 1, 7]))) for _ in range(900)]
    rows += [("same", 3.5)] * 700 + [("two", 1.0), ("two", 2.0), ("one", -4.0), (None, 8.0), (None, 9.0), ("none", None), ("nan", float("nan")), ("hot", None)]
    return rows


def values(rows):
    out = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            out.setdefault(g, []).append(v)
    return {g: sorted(x) for g, x in out.items()}


@pytest.mark.parametrize("limit", [20, 100_000])
def test_kth_values(spark, limit):
    rows = groups()
    data, sorted_ = spark.createDataFrame(rows, NAMES).repartition(7), values(rows)
    ranks = [(g, k) for g, x in sorted_.items() for k in {0, 1, len(x) // 3, len(x) - 1, len(x), -1}]
    got = {(r.g, r.k): r.value for r in Q.kth_values(data, "v", ["g"], spark.createDataFrame(ranks, "g string, k long"), limit).collect()}
    assert got == {(g, k): sorted_[g][k] for g, k in ranks if 0 <= k < len(sorted_[g])}


def test_quantiles_are_those_of_percentile(spark):
    data = spark.createDataFrame(groups(), NAMES).filter("not isnan(v) or v is null")
    wanted = {r.g: (r.n, r.mean, *r.p) for r in data.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p")).filter("n > 0").collect()}
    got = {r.g: (r.n, r.mean, r.p50, r.p95, r.p99) for r in A.latency_snapshot(data, "v", "g", limit=20).collect()}
    assert got.pop("none") == (0, 0.0, 0.0, 0.0, 0.0)
    assert got.keys() == wanted.keys()
    for g, x in got.items():
        assert x == pytest.approx(wanted[g], rel=1e-12), g
    whole = A.latency_snapshot(data, "v", limit=20).collect()
    assert [r.n for r in whole] == [sum(n for n, *_ in wanted.values())]


def test_nearest_rank_and_median(spark):
    rows = [("a", float(x)) for x in range(1, 21)] + [("b", 1.0), ("b", 2.0), ("c", None)]
    data = spark.createDataFrame(rows, NAMES)
    assert {(r.g, r.p) for r in Q.nearest_rank(data, "v", ["g"], "p", 0.95, 2).collect()} == {("a", 19.0), ("b", 2.0)}
    assert {(r.g, r.median) for r in A.median(data, "g", "v", 2).collect()} == {("a", 10.5), ("b", 1.5), ("c", None)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], NAMES)
    assert A.latency_snapshot(empty, "v", "g").count() == 0 and A.median(empty, "g", "v").count() == 0
