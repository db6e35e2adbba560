"""Connected components by label propagation with pointer jumping; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import saved


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for all ends of ``links`` (a long, b long)."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).filter("a is not null and b is not null").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("heard"))
        told = saved(labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("component", "heard").alias("component"), F.col("component").alias("was")), "labels")
        if told.filter("component <> was").isEmpty():
            return told.drop("was")
        roots = told.select(F.col("node").alias("root"), F.col("component").alias("of_root"))
        labels = saved(told.drop("was").join(roots, F.col("component") == F.col("root")).select("node", F.least("component", "of_root").alias("component")), "labels")
