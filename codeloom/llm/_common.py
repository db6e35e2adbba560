"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 1000
_OWN_SHARED: dict[str, str] = {}
_SHIPPED: set[str] = set()
_OPEN: list[list[str]] = []
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the cluster names none, as in tests on one machine, a folder of this process is used.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN_SHARED.setdefault(sc.applicationId, f"file://{tempfile.mkdtemp(prefix='codeloom-')}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is there yet."""
    return f"{shared_root(spark)}/codeloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Tables that ``saved`` writes meanwhile are deleted at the end; what is read later must have been written elsewhere."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        for path in paths:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    if not path.startswith(f"{shared_root(spark)}/codeloom/"):
        raise ValueError(f"not a table of this package: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    for paths in _OPEN:
        paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` gave; nothing that is still to be computed may read them."""
    for df in tables:
        discard(df.sparkSession, _PLACES.pop(df))


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once for each application, and bound the rows of an Arrow batch.

    Texts can be long: with batches of some hundred rows, a Python worker and its executor hold a few megabytes of them.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    name = os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom.zip")
    Path(name).write_bytes(data.getvalue())
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def numbered(df: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed c0, c1, ... and the columns ``own`` again behind them under their own names.

    Whatever ``df`` calls its columns, none can then clash with those that an operator adds.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names).select("*", *(F.col(names[df.columns.index(c)]).alias(c) for c in own)), names


def keyed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` saved with its columns renamed c0, c1, ... and a key of each row, ``row``: rows that repeat an id, or have none, stay apart."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return saved(df.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows"), names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
