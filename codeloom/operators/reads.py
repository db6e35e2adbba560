"""Named read answers over a call graph: dependencies with evidence, architecture, files, traces, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.operators.graph import reachable
from codeloom.plans.shared import saved

FACETS = ("inventory", "evidence", "grouping", "projection")


def coverage_facets(reasons: DataFrame, requested: tuple[str, ...]) -> DataFrame:
    """facet, requested, complete, truncated, reasons of the four facets, and of the requested ones together (``all``).

    reasons: facet, reason (a code; those that end in -cap mean that rows were left out).
    """
    known = reasons.filter(F.col("facet").isin(*FACETS)).select("facet", "reason").distinct()
    own = known.groupBy("facet").agg(F.collect_list("reason").alias("own"))  # different codes: a handful
    whole = known.filter(F.col("facet").isin(*requested)).select("reason").distinct().agg(F.collect_list("reason").alias("own")).select(F.lit("all").alias("facet"), "own")
    named = reasons.sparkSession.createDataFrame([*((f, f in requested) for f in FACETS), ("all", True)], "facet string, requested boolean")
    sorted_ = F.array_sort(F.coalesce("own", F.array().cast("array<string>")))
    out = named.join(own.unionByName(whole), "facet", "left").select("facet", "requested", sorted_.alias("reasons"))
    return out.select("facet", "requested", (F.size("reasons") == 0).alias("complete"), F.exists("reasons", lambda r: r.endswith("-cap")).alias("truncated"), "reasons")


def package_evidence(edges: DataFrame, occ: DataFrame, imports: DataFrame) -> DataFrame:
    """Every piece of evidence that a package depends on another: src_package, dst_package, kind, site, target.

    imports: file_path, package.  Dependencies of a package on itself are no evidence.
    """
    a = occ.select(F.col("occ_id").alias("src"), F.col("package").alias("src_package"), stable_key().alias("site"))
    b = occ.select(F.col("occ_id").alias("dst"), F.col("package").alias("dst_package"), stable_key().alias("target"))
    calls = edges.join(a, "src").join(b, "dst").select("src_package", "dst_package", F.lit("call").alias("kind"), "site", "target")
    files = occ.select("file_path", F.col("package").alias("src_package")).distinct()
    named = imports.join(files, "file_path").select("src_package", F.col("package").alias("dst_package"), F.lit("import").alias("kind"), F.col("file_path").alias("site"), F.col("package").alias("target"))
    return calls.unionByName(named).filter("src_package <> dst_package")


def stable_key() -> Column:
    """File, line and name of an occurrence, in an order that pages can rely on."""
    return F.concat_ws("|", "file_path", F.lpad(F.col("line").cast("string"), 16, "0"), "name")


def why_depends(evidence: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` sites of each dependency with the number of all.

    Ranks are limited before the shuffle too (a window group limit), so a hot pair of packages sends no more than
    ``limit`` rows from each task; the totals are partial counts.
    """
    pair = ["src_package", "dst_package", "kind"]
    rank = F.row_number().over(W.Window.partitionBy(*pair).orderBy("site", "target"))
    shown = evidence.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return shown.join(evidence.groupBy(*pair).agg(F.count(F.lit(1)).alias("total")), pair)


def package_dependencies(evidence: DataFrame, samples: int = 3) -> DataFrame:
    """One row for each dependency: its evidence counted, and the first ``samples`` sites."""
    first = F.array_sort(F.collect_list(F.struct("rank", "site")))["site"]  # ``samples`` at most
    return why_depends(evidence, max(samples, 1)).groupBy("src_package", "dst_package", "kind").agg(F.max("total").alias("n"), F.slice(first, 1, samples).alias("samples"))


def architecture(edges: DataFrame, occ: DataFrame, coupling: DataFrame, top: int = 20) -> DataFrame:
    """section, rank, name, n: size metrics, the heaviest package edges, the functions with most callers.

    coupling: caller, callee, calls.
    """
    if not 1 <= top <= 100:
        raise ValueError("top must lie in 1..100")
    counts = occ.agg(F.count(F.lit(1)).alias("functions"), F.countDistinct("package").alias("packages"), F.countDistinct("file_path").alias("files"), F.count_if("in_test").alias("tests"))
    metrics = counts.unpivot([], ["functions", "packages", "files", "tests"], "name", "n")
    metrics = metrics.unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("calls").alias("name"), "n"))
    heavy = coupling.filter("caller <> callee").select(F.concat_ws(" -> ", "caller", "callee").alias("name"), F.col("calls").alias("n"))
    callers = edges.filter("src <> dst").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    hot = callers.join(occ.select(F.col("occ_id").alias("dst"), stable_key().alias("name")), "dst").select("name", "n")

    def first(rows: DataFrame, section: str) -> DataFrame:
        rank = F.row_number().over(W.Window.partitionBy("section").orderBy(F.desc("n"), "name"))  # ``top`` rows
        return rows.orderBy(F.desc("n"), "name").limit(top).select(F.lit(section).alias("section"), "name", "n").withColumn("rank", rank)

    return metrics.select(F.lit("metric").alias("section"), F.lit(0).alias("rank"), "name", "n").unionByName(first(heavy, "package-edge").unionByName(first(hot, "hotspot")))


def file_context(occ: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each file: its functions, calls from and into other files, findings.  findings: file_path, is_error."""
    of = occ.select("occ_id", "file_path")
    pairs = edges.join(of.select(F.col("occ_id").alias("src"), F.col("file_path").alias("a")), "src").join(of.select(F.col("occ_id").alias("dst"), F.col("file_path").alias("b")), "dst").filter("a <> b")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    columns = ["functions", "exported", "calls_out", "calls_in", "findings", "errors"]

    def part(rows: DataFrame, path: str, **values: Column) -> DataFrame:
        return rows.select(F.col(path).alias("file_path"), *(values.get(c, zero).alias(c) for c in columns))

    rows = part(occ, "file_path", functions=one, exported=F.col("exported").cast("long"))
    for more in (part(pairs, "a", calls_out=one), part(pairs, "b", calls_in=one)):
        rows = rows.unionByName(more)
    known = findings.join(occ.select("file_path").distinct(), "file_path", "left_semi")
    rows = rows.unionByName(part(known, "file_path", findings=one, errors=F.col("is_error").cast("long")))
    return rows.groupBy("file_path").agg(*(F.sum(c).alias(c) for c in columns))


def impact_files(impact: DataFrame, occ: DataFrame, changed_files: int, limit: int = 500) -> DataFrame:
    """The first ``limit`` files with impacted functions (node, depth): least depth, how many functions."""
    if not 1 <= changed_files <= 128 or not 1 <= limit <= 500:
        raise ValueError("at most 128 changed files and 500 rows")
    rows = impact.join(occ.select(F.col("occ_id").alias("node"), "file_path", "in_test"), "node")
    out = rows.groupBy("file_path").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("functions"), F.bool_or("in_test").alias("tests"))
    return out.orderBy("depth", "file_path").limit(limit)


def shortest_traces(edges: DataFrame, entries: DataFrame, targets: DataFrame, hops: int = 4) -> DataFrame:
    """A shortest path (node, depth, path) from any entry to each target that has one; the smallest parent at each step.

    entries and targets: node.  ``hops`` steps back are taken before each write.
    """
    levels = saved(reachable(edges, entries).select("node", "depth"))
    a, b = (levels.select(F.col("node").alias(n), F.col("depth").alias(f"{n}_depth")) for n in ("src", "dst"))
    parents = saved(edges.join(b, "dst").join(a, "src").filter("src_depth + 1 = dst_depth").groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("parent")))
    paths = targets.distinct().join(levels, "node").select("node", "depth", F.array("node").alias("path"), F.col("node").alias("at"))
    left = levels.agg(F.max("depth")).first()[0] or 0
    while left > 0:
        for _ in range(min(hops, left)):
            paths = paths.join(parents, "at", "left").select("node", "depth", F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"), F.coalesce("parent", F.lit(None)).alias("at"))
        paths, left = saved(paths), left - hops
    return paths.select("node", "depth", "path")


def latest_findings(sessions: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """Findings (session_id, ...) of the latest session of each tool."""
    n = F.row_number().over(W.Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id")))
    newest = sessions.withColumn("n", n).filter("n = 1").select(F.col("id").alias("session_id"), F.col(by))
    return findings.join(newest, "session_id")
