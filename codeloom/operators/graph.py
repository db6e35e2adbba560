"""Graph operators over edges (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.plans.shared import iterate, saved, spread


def hash_edges(edges: DataFrame, occ: DataFrame) -> DataFrame:
    """Distinct edges between body hashes; ends that the catalog does not know are dropped."""
    known = occ.select("occ_id", "body_hash")
    a = edges.join(known.withColumnRenamed("body_hash", "src_hash"), edges["src"] == known["occ_id"]).drop("occ_id")
    return a.join(known.withColumnRenamed("body_hash", "dst_hash"), a["dst"] == known["occ_id"]).select("src_hash", "dst_hash").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, hops: int = 6) -> DataFrame:
    """Nodes reached from seeds (column node), with the depth where each is first met.

    Without a bound, each round goes ``hops`` steps before it is written, so deep graphs take few rounds: a node that is
    new in a round lies within ``hops`` steps of the last level of the round before.
    """
    start = seeds.select("node", F.lit(0).alias("depth"))

    def once(f: DataFrame) -> DataFrame:
        return f.join(spread(edges), f["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))

    edges = saved(edges.select("src", "dst"))  # each step reads them
    if max_depth is not None:
        return iterate(start, lambda f, _: once(f), ["node"], max_depth)
    frontier = seen = saved(start.distinct())
    while True:
        level, found = frontier, []
        for _ in range(hops):
            level = once(level).groupBy("node").agg(F.min("depth").alias("depth"))
            found.append(level)
        fresh = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("depth").alias("depth"))
        frontier = saved(fresh.join(spread(seen.select("node")), "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = saved(seen.unionByName(frontier))


def walk(edges: DataFrame, start: DataFrame, max_depth: int = 5, cap: int | None = 2000) -> DataFrame:
    """Bounded breadth-first walk: node, depth, parent (lowest), path; depth is held to 1..5, and the first ``cap`` nodes
    by (depth, node) stay (None: all)."""
    max_depth, edges = min(max(max_depth, 1), 5), saved(edges.select("src", "dst"))
    first = start.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array("node").alias("path"))

    def step(f: DataFrame, _: DataFrame) -> DataFrame:
        out = f.join(spread(edges), f["node"] == edges["src"]).select(F.col("dst").alias("to"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("by"), "path")
        best = out.groupBy("to").agg(F.min("depth").alias("depth"), F.min("by").alias("parent"), F.min_by("path", "by").alias("path"))
        return best.select(F.col("to").alias("node"), "depth", "parent", F.concat("path", F.array("to")).alias("path"))

    out = iterate(first, step, ["node"], max_depth)
    return out if cap is None else out.orderBy("depth", "node").limit(cap)


def blast(edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """node, direct, transitive, score of every node with callers; a node is never its own caller."""
    edges = saved(edges.select("src", "dst"))
    pairs = edges.filter("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("caller"), F.lit(1).alias("depth"))
    step = lambda f, _: f.join(spread(edges.withColumnsRenamed({"src": "s", "dst": "d"})), F.col("caller") == F.col("d")).filter("node <> s").select("node", F.col("s").alias("caller"), (F.col("depth") + 1).alias("depth"))
    all_ = iterate(pairs, step, ["node", "caller"], max_depth - 1)
    counts = all_.groupBy("node").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    return counts.withColumn("score", F.col("direct") + 0.5 * F.col("transitive"))


def strong_components(edges: DataFrame, hops: int = 4) -> DataFrame:
    """node, component (its smallest node) of all nodes on cycles; other nodes are components of their own.

    Nodes without way in or out are trimmed first; what is left takes the smallest label that reaches it, and a label's
    component is what also reaches that label's node.  Components found are taken out and the rest goes round again.
    """
    edges = saved(edges.select("src", "dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    rest, found = saved(edges.filter("src <> dst")), []
    while True:
        while True:
            trimmed = saved(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if trimmed.count() == rest.count():
                break
            rest = trimmed
        if rest.isEmpty():
            break
        labels = saved(rest.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
        while True:
            level, heard = labels, []
            for _ in range(hops):  # labels travel some steps before each write
                level = rest.join(level, rest["src"] == level["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
                heard.append(level)
            least = reduce(DataFrame.unionByName, heard).groupBy("node").agg(F.min("label").alias("heard"))
            told = saved(labels.join(least, "node", "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("was")))
            labels = told.drop("was")
            if told.filter("label <> was").isEmpty():
                break
        a, b = (labels.select(F.col("node").alias(n), F.col("label").alias(f"{n}_label")) for n in ("src", "dst"))
        same = saved(rest.join(a, "src").join(b, "dst").filter("src_label = dst_label").select("src", "dst", F.col("src_label").alias("label")))
        roots = labels.filter("node = label")

        def back(f: DataFrame, _: DataFrame, same: DataFrame = same) -> DataFrame:
            steps = []
            for _ in range(hops):
                f = f.join(same.select(F.col("dst").alias("node"), "label", "src"), ["node", "label"]).select(F.col("src").alias("node"), "label").distinct()
                steps.append(f)
            return reduce(DataFrame.unionByName, steps)

        members = saved(iterate(roots, back, ["node"]))
        found.append(members)
        gone = members.select("node")
        rest = saved(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    known = reduce(DataFrame.unionByName, found)  # a node is taken out with the component that it is found in
    return nodes.join(known, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def impact(edges: DataFrame, changed: DataFrame, max_depth: int = 5) -> DataFrame:
    """Callers of changed nodes up to a depth, without the changed ones: node, depth."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, changed, max_depth).filter("depth > 0")


def cycle_proofs(evidence: DataFrame, components: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` edges between packages of one component, with the number of all.

    evidence: src, dst, kind, n; components: node, component.  Edges of a package to itself prove nothing.
    """
    a = components.select(F.col("node").alias("src"), "component")
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inside = saved(evidence.filter("src <> dst").join(a, "src").join(b, "dst").filter("component = other").select("component", "src", "dst", "kind", "n"))
    first = F.row_number().over(W.Window.partitionBy("component").orderBy("src", "dst", "kind"))
    shown = inside.withColumn("rank", first).filter(F.col("rank") <= min(max(limit, 0), 50))
    return shown.join(inside.groupBy("component").agg(F.count(F.lit(1)).alias("total")), "component")


def weakest_hop(paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """id and the lowest confidence of any evidence (src, dst, confidence) along a path; null where no hop has any.

    paths: id, path (an array of nodes).  Confidences other than low and medium count as high.
    """
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    hops = paths.filter("size(path) > 1").select("id", F.explode(steps).alias("hop")).select("id", "hop.*")
    level = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    worst = evidence.groupBy("src", "dst").agg(F.min(level).alias("level"))
    found = hops.join(worst, ["src", "dst"]).groupBy("id").agg(F.min("level").alias("level"))
    name = F.when(F.col("level") == 0, "low").when(F.col("level") == 1, "medium").when(F.col("level") == 2, "high")
    return paths.select("id").join(found, "id", "left").select("id", name.alias("weakest"))


def incremental_closure(cached: DataFrame, calls: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Files (file_path) to walk again: the changed ones, and those that call a body which the walked files have lost.

    cached and fresh: file_path, body_hash before and now; calls: file_path, to_hash of the cached edges.  A body that moved
    to another walked file is not lost.  Each round looks at the whole closure again until no file is added.
    """
    closure = saved(changed.select("file_path").distinct())
    while True:
        now = fresh.join(closure, "file_path", "left_semi").select("body_hash").distinct()
        lost = cached.join(closure, "file_path", "left_semi").select("body_hash").distinct().join(now, "body_hash", "left_anti")
        callers = calls.join(lost.withColumnRenamed("body_hash", "to_hash"), "to_hash", "left_semi").select("file_path").distinct()
        more = saved(callers.join(closure, "file_path", "left_anti"))
        if more.isEmpty():
            return closure
        closure = saved(closure.unionByName(more))


def impact_doubts(changed: DataFrame, catalog: DataFrame, complete: bool = True, approximate: bool = False, omitted: bool = False, truncated: bool = False) -> DataFrame:
    """Reasons (code, source, file_path) not to trust an impact answer; with any, all tests should run.

    changed: path, status (null: modified); catalog: file_path of all known files.  A deleted file is only that; a
    renamed one may also be unknown to the catalog.
    """
    spark = changed.sparkSession
    path = F.translate("path", "\\", "/")
    known = catalog.select(F.col("file_path").alias("path"), F.lit(True).alias("known")).distinct()
    rows = changed.select(path.alias("path"), "status").join(known, "path", "left")
    gone = F.coalesce(F.col("status") == "deleted", F.lit(False))
    reasons = F.array(
        F.when(gone, F.struct(F.lit("changed-file-deleted").alias("code"), F.lit("git").alias("source"))),
        F.when(F.col("status") == "renamed", F.struct(F.lit("changed-file-renamed").alias("code"), F.lit("git").alias("source"))),
        F.when(~gone & F.col("known").isNull(), F.struct(F.lit("changed-file-unmatched").alias("code"), F.lit("impact").alias("source"))),
    )
    files = rows.select("path", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("r")).select("r.code", "r.source", F.col("path").alias("file_path"))
    flags = [("graph-catalog-incomplete", "catalog", not complete), ("graph-catalog-approximate", "catalog", approximate), ("impact-malformed-row-omitted", "impact", omitted), ("impact-truncated", "impact", truncated)]
    whole = spark.createDataFrame([(c, s, None) for c, s, on in flags if on], "code string, source string, file_path string")
    return whole.unionByName(files)
