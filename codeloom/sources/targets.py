"""Which files belong to which targets: includes, common ignores, excludes of a target and of the project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions import scalars as S
from codeloom.operators.joins import directories

#: What no target takes in.
COMMON_IGNORES = ("**/node_modules/**", "**/dist/**", "**/.git/**")


@dataclass(frozen=True)
class Target:
    name: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()


def patterns(spark: SparkSession, targets: list[Target], global_excludes: tuple[str, ...] = ()) -> DataFrame:
    """target (null for all), excludes, dir, pattern: each glob with the directory that its literal beginning names.

    Includes pass over names with a leading dot unless they say the dot; excludes don't.
    """
    globs = [(t.name, False, g) for t in targets for g in t.include] + [(t.name, True, g) for t in targets for g in t.exclude] + [(None, True, g) for g in (*COMMON_IGNORES, *global_excludes)]
    rows = [(t, out, _literal_directory(g), S.glob_pattern(g, dot=out)) for t, out, g in globs]
    return spark.createDataFrame(rows, "target string, excludes boolean, dir string, pattern string")


def _literal_directory(glob: str) -> str:
    literal = glob[: min((glob.index(c) for c in "*?{" if c in glob), default=len(glob))]
    return literal.rpartition("/")[0]


def memberships(files: DataFrame, root: str, targets: list[Target], global_excludes: tuple[str, ...] = ()) -> DataFrame:
    """file_path, target: every file (absolute ``file_path``) below the root with each target that takes it.

    A file meets the patterns of its own directories only, in an equi-join.
    """
    path = F.when(F.col("file_path").startswith("/"), F.concat(F.lit("/"), S.normalize_path(F.col("file_path"))))
    base = root.rstrip("/")
    below = files.select("file_path", path.alias("path")).filter(F.col("path").startswith(base + "/")).distinct()
    below = below.select("file_path", F.expr(f"substring(path, {len(base) + 2})").alias("relative"))
    met = below.withColumn("dir", F.explode(directories("relative"))).join(patterns(files.sparkSession, targets, global_excludes), "dir").filter(F.rlike("relative", F.col("pattern")))
    hits = met.groupBy("file_path", "target").agg(F.bool_or("excludes").alias("excluded"))
    taken = hits.filter("target is not null and not excluded")
    return taken.join(hits.filter("target is null"), "file_path", "left_anti").select("file_path", "target")


def resolve_targets(files: DataFrame, root: str, targets: list[Target], global_excludes: tuple[str, ...] = (), max_results: int | None = None) -> DataFrame:
    """file_path of all files that a target takes; with ``max_results`` the first ones by path, and capped: are there more."""
    found = memberships(files, root, targets, global_excludes).select("file_path").distinct()
    return found if max_results is None else _first(found, max_results)


def _first(rows: DataFrame, n: int) -> DataFrame:
    kept = rows.orderBy("file_path").limit(n + 1)  # few rows, so one task may number them
    numbered = kept.withColumn("at", F.row_number().over(W.Window.orderBy("file_path"))).withColumn("capped", F.count(F.lit(1)).over(W.Window.partitionBy(F.lit(1))) > n)
    return numbered.filter(F.col("at") <= n).drop("at")


def bounded_memberships(files: DataFrame, root: str, targets: list[Target], global_excludes: tuple[str, ...] = (), max_results: int | None = None, max_targets: int | None = None) -> DataFrame:
    """file_path, targets (by name), targets_capped, and capped where ``max_results`` is given: the first files by path.

    A file has as many names at most as there are targets.
    """
    grouped = memberships(files, root, targets, global_excludes).groupBy("file_path").agg(F.array_sort(F.collect_set("target")).alias("names"))
    few = F.col("names") if max_targets is None else F.slice("names", 1, max_targets)
    out = grouped.select("file_path", few.alias("targets"), (F.size("names") > F.size(few)).alias("targets_capped"))
    return out if max_results is None else _first(out, max_results)
