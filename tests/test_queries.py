"""Every registered query over the reference operators against its SQL twin."""

from __future__ import annotations

import pytest
from conftest import rows_of

from codeloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    found = catalog.queries()[name](spark, DIR).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(found.columns)
        return
    wanted = duck(DIR).sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


def test_queries_cover_whole_tables(spark):
    run = lambda name: catalog.queries()[name](spark, DIR)
    texts = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {(r.id, r.number) for r in run("suppressions").collect()}
    assert got == {(r.doc_id, k + 1) for r in texts if r.text is not None for k in range(r.text.count("\n") + 1)}
    entries = {r.node for r in run("entry_points").collect()}
    for name in ("reachable_from_entry", "bounded_walk", "trace_path", "weakest_hop"):
        found = [r[0] for r in run(name).collect()]
        assert entries <= set(found) and len(found) == len(set(found)), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
