"""Saved baselines in a shared folder: a save replaces all of a tool, and readers see the old one or the new one whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "fingerprint string, payload string"
META = "tool string, generation string, captured_at timestamp, strategy string, n long"


class BaselineStore:
    """A folder with a subfolder of entries for each save and one small file of meta for each.

    The meta row of a save is written after its entries, so a save that fails before it is not seen and can be made
    again.  The last meta row of a tool (by time, then generation) names its entries; a save without entries is a
    saved, empty baseline.  Entries of older saves stay until ``prune``.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, kind: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _meta(self) -> DataFrame:
        fs, folder = self._folder("meta")
        return self.spark.read.schema(META).parquet(str(folder)) if fs.exists(folder) else self.spark.createDataFrame([], META)

    def saved_tools(self) -> DataFrame:
        """The meta row of each tool's last save."""
        rows = self._meta()
        last = rows.groupBy("tool").agg(F.max_by(F.struct(*rows.columns), F.struct("captured_at", "generation")).alias("m"))
        return last.select("m.*")

    def save(self, tool: str, rows: DataFrame, strategy: str = "") -> int:
        """rows: fingerprint, payload, ordinal; of one fingerprint the last by ordinal (then the larger payload) stays.

        Returns the number of entries.  A null fingerprint is an error, and nothing is saved.
        """
        generation = uuid.uuid4().hex
        last = rows.groupBy("fingerprint").agg(F.max_by("payload", F.struct("ordinal", "payload")).alias("payload"))
        checked = last.select(F.coalesce("fingerprint", F.raise_error(F.lit("an entry has no fingerprint"))).alias("fingerprint"), "payload")
        checked.write.parquet(f"{self.path}/entries/{generation}")
        n = self._entries(generation).count()
        meta = self.spark.range(1).select(F.lit(tool).alias("tool"), F.lit(generation).alias("generation"), F.current_timestamp().alias("captured_at"), F.lit(strategy).alias("strategy"), F.lit(n).cast("long").alias("n"))
        meta.coalesce(1).write.mode("append").parquet(f"{self.path}/meta")
        return n

    def _entries(self, generation: str) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.path}/entries/{generation}")

    def load(self, tool: str) -> DataFrame | None:
        """fingerprint, payload of the last save; None where the tool was never saved."""
        row = self.saved_tools().filter(F.col("tool") == tool).first()
        return None if row is None else self._entries(row.generation)

    def prune(self) -> int:
        """Delete entries that no tool's last save names (failed and older saves); not while a save runs."""
        live = {r.generation for r in self.saved_tools().select("generation").collect()}  # one row for each tool
        fs, folder = self._folder("entries")
        old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in live] if fs.exists(folder) else []
        for p in old:
            fs.delete(p, True)
        return len(old)
