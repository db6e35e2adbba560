"""Cutting the lineage of iterative plans through the folder that driver and executors share."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
ROWS_PER_BATCH = 1000


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(sc.applicationId, f"file://{tempfile.mkdtemp(prefix='codeloom-')}")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_root(df.sparkSession)}/codeloom/plan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles: where it is exploded or read from packed files, Spark takes it for much smaller than
    it is, and would send it to all executors through the driver."""
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Make this package importable by the executors' Python workers, once for each application, and bound Arrow batches."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ROWS_PER_BATCH + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    path = Path(tempfile.mkdtemp(prefix="codeloom-"), "codeloom-functions.zip")
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def iterate(frontier: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], max_depth: int | None = None) -> DataFrame:
    """All rows reached from ``frontier``: each round adds step(frontier, seen) without rows whose keys were seen."""
    frontier = saved(frontier.dropDuplicates(keys))
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        fresh = step(frontier, seen).dropDuplicates(keys).join(spread(seen.select(*keys)), keys, "left_anti")
        frontier = saved(fresh)
        if frontier.isEmpty():
            break
        depth += 1
        seen = saved(seen.unionByName(frontier)) if depth % 4 == 0 else seen.unionByName(frontier)
    return seen
