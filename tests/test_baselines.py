"""Baselines: round trip, replacing, empty and failed saves."""

from __future__ import annotations

import pytest

from codeloom.sources.baselines import BaselineStore

NAMES = "fingerprint string, payload string, ordinal long"


def entries(df):
    return None if df is None else sorted((r.fingerprint, r.payload) for r in df.collect())


def test_saves(spark, tmp_path):
    store = BaselineStore(spark, f"file://{tmp_path}/store")
    rows = lambda *x: spark.createDataFrame(list(x), NAMES)
    assert store.load("fit") is None and store.prune() == 0
    assert store.save("fit", rows(("a", "old", 1), ("a", "new", 2), ("b", None, 1))) == 2
    assert store.save("graph", rows(("z", "p", 1)), "v2") == 1
    assert entries(store.load("fit")) == [("a", "new"), ("b", None)]
    before = store.load("fit")
    assert store.save("fit", rows(("c", "x", 1))) == 1
    assert entries(store.load("fit")) == [("c", "x")] and entries(before) == [("a", "new"), ("b", None)]
    with pytest.raises(Exception, match="no fingerprint"):
        store.save("fit", rows(("d", "y", 1), (None, "y", 1)))
    assert entries(store.load("fit")) == [("c", "x")]
    assert store.save("fit", spark.createDataFrame([], NAMES)) == 0
    assert store.load("fit") is not None and entries(store.load("fit")) == []
    assert {(r.tool, r.strategy, r.n) for r in store.saved_tools().collect()} == {("fit", "", 0), ("graph", "v2", 1)}
    assert store.prune() >= 2 and entries(store.load("graph")) == [("z", "p")] and entries(store.load("fit")) == []
