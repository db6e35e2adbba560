"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def connect(sf_dir: str):
        c = duckdb.connect()
        c.sql("SET timezone = 'UTC'")
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return c

    return connect


def rows_of(pdf) -> list[tuple]:
    """Rows as comparable tuples, columns by name, floats rounded."""
    import decimal

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return str([plain(y) for y in x])
        if isinstance(x, (float, decimal.Decimal)):
            return None if x != x else round(float(x), 6)
        return None if x is None or str(x) in ("NaT", "<NA>") else x

    out = [tuple(plain(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
