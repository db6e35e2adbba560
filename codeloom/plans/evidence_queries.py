"""Queries over evidence: proofs of package cycles, confidence of paths, doubts, effects, dynamic entries, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.operators import aggregates as A
from codeloom.operators import graph as G
from codeloom.operators import joins as J
from codeloom.operators import ledger as L
from codeloom.operators import rules as R
from codeloom.plans.graph_queries import BOTH, COUPLING, CYCLE, WALK, walk_from_entries
from codeloom.plans.registry import query, table
from codeloom.sources.adapters import call_edges, occurrences

EVIDENCE = f"""{COUPLING}, imports AS (SELECT DISTINCT a.package AS own, a.file_path, b.package FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id),
evidence AS (SELECT caller AS src, callee AS dst, 'call' AS kind, calls AS n FROM coupling WHERE caller <> callee AND calls >= 3
  UNION ALL SELECT own, package, 'import', count(*) FROM imports WHERE own <> package GROUP BY own, package HAVING count(*) >= 3)"""


def _evidence(s, d):
    """Edges between packages by calls and by files that import, of three or more each."""
    occ, edges = occurrences(s, d), call_edges(s, d)
    calls = A.package_coupling(edges, occ).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("call").alias("kind"), F.col("calls").alias("n"))
    files = occ.select("file_path", F.col("package").alias("src")).distinct()
    imports = J.imported_packages(edges, occ).join(files, "file_path").groupBy("src", F.col("package").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return calls.unionByName(imports.withColumn("kind", F.lit("import"))).filter("src <> dst and n >= 3")


query("package_cycle_proofs", f"""{EVIDENCE}, pairs AS (SELECT DISTINCT src, dst FROM evidence),
c AS (SELECT src AS a, dst AS b FROM pairs UNION SELECT c.a, p.dst FROM c JOIN pairs p ON p.src = c.b),
scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT a.component, e.src, e.dst, e.kind, e.n, CAST(row_number() OVER (PARTITION BY a.component ORDER BY e.src, e.dst, e.kind) AS INT) AS rank, count(*) OVER (PARTITION BY a.component) AS total
FROM evidence e JOIN scc a ON e.src = a.node JOIN scc b ON e.dst = b.node WHERE a.component = b.component QUALIFY rank <= 50""")(
    lambda s, d: G.cycle_proofs(_evidence(s, d), G.strong_components(_evidence(s, d).select("src", "dst").distinct())))

CONFIDENCE = "CASE WHEN (src + dst) % 11 = 0 THEN 'low' WHEN (src + dst) % 3 = 0 THEN 'medium' ELSE 'high' END"

query("weakest_hop", f"""{WALK},
hop AS (SELECT q.node, q.parent, q.depth, CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS level FROM q JOIN (SELECT DISTINCT src, dst, {CONFIDENCE} AS confidence FROM call_edge) e ON e.src = q.parent AND e.dst = q.node),
p AS (SELECT node, depth, CAST(NULL AS INTEGER) AS level FROM q WHERE depth = 0 UNION ALL SELECT h.node, h.depth, least(h.level, p.level) FROM hop h JOIN p ON h.parent = p.node AND h.depth = p.depth + 1)
SELECT node AS id, CASE level WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS weakest FROM p""")(
    lambda s, d: G.weakest_hop(walk_from_entries(s, d).select(F.col("node").alias("id"), "path"), call_edges(s, d).withColumn("confidence", F.expr(CONFIDENCE))))


def _closure(s, d):
    """Every file numbered 7 has changed; a quarter of all bodies would differ if walked again."""
    occ = occurrences(s, d).withColumn("body_hash", F.col("occ_id").cast("string"))
    calls = call_edges(s, d).join(occ.select(F.col("occ_id").alias("src"), "file_path"), "src").select("file_path", F.col("dst").cast("string").alias("to_hash"))
    fresh = occ.select("file_path", F.when(F.col("occ_id") % 4 == 3, F.concat("body_hash", F.lit("*"))).otherwise(F.col("body_hash")).alias("body_hash"))
    return G.incremental_closure(occ.select("file_path", "body_hash"), calls, fresh, occ.filter("file_path like '%/f7.ts'").select("file_path"))


query("incremental_closure", f"""{BOTH}, r AS (SELECT DISTINCT file_path FROM occ WHERE file_path LIKE '%/f7.ts'
  UNION SELECT a.file_path FROM r JOIN occ b ON b.file_path = r.file_path AND b.occ_id % 4 = 3 JOIN call_edge e ON e.dst = b.occ_id JOIN occ a ON e.src = a.occ_id) SELECT file_path FROM r""")(_closure)


def _doubts(s, d):
    occ = occurrences(s, d)
    status = F.when(F.col("occ_id") % 9 == 0, "deleted").when(F.col("occ_id") % 9 == 1, "renamed").otherwise("modified")
    changed = occ.filter("occ_id % 4 = 1").select(F.concat("file_path", F.when(F.col("occ_id") % 10 == 1, "x").otherwise("")).alias("path"), status.alias("status"))
    return G.impact_doubts(changed, occ.select("file_path"), complete=True, approximate=True)


query("impact_doubts", f"""{BOTH}, x AS (SELECT file_path || CASE WHEN occ_id % 10 = 1 THEN 'x' ELSE '' END AS path, CASE occ_id % 9 WHEN 0 THEN 'deleted' WHEN 1 THEN 'renamed' ELSE 'modified' END AS status FROM occ WHERE occ_id % 4 = 1)
SELECT 'graph-catalog-approximate' AS code, 'catalog' AS source, CAST(NULL AS VARCHAR) AS file_path UNION ALL SELECT 'changed-file-deleted', 'git', path FROM x WHERE status = 'deleted'
UNION ALL SELECT 'changed-file-renamed', 'git', path FROM x WHERE status = 'renamed'
UNION ALL SELECT 'changed-file-unmatched', 'impact', path FROM x WHERE status <> 'deleted' AND path NOT IN (SELECT file_path FROM occ)""")(_doubts)

TEXT = "CASE WHEN dst % 397 = 0 THEN 'console.log(x)' WHEN dst % 401 = 0 THEN 'items.push(x)' ELSE 'compute(x)' END"
DROPPED = "CASE (src + dst) % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END"
VALUE = "CASE WHEN occ_id % 5 = 0 THEN ' Void' WHEN occ_id % 5 = 1 THEN NULL ELSE 'number' END"


def _effects(s, d):
    calls = call_edges(s, d).select("src", "dst", F.expr(TEXT).alias("text"), F.expr(DROPPED).alias("discarded"))
    return R.no_side_effect_path(occurrences(s, d).withColumn("return_type", F.expr(VALUE)), calls)


query("no_side_effect_path", f"""{BOTH}, calls AS (SELECT src, dst, {TEXT} AS text, {DROPPED} AS discarded FROM call_edge),
i AS (SELECT src AS node FROM calls WHERE text <> 'compute(x)' UNION SELECT e.src FROM i JOIN call_edge e ON e.dst = i.node)
SELECT 'graph:no-side-effect-path' AS rule_id, occ_id, 'low' AS severity, 'its value is thrown away' AS message FROM occ
WHERE kind <> 'module-init' AND NOT in_test AND exported AND end_line - line + 1 >= 10 AND occ_id % 5 <> 0 AND occ_id NOT IN (SELECT node FROM i)
  AND (SELECT count(*) FROM calls c WHERE c.src = occ_id) >= 2 AND EXISTS (SELECT 1 FROM calls c WHERE c.dst = occ_id) AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = occ_id AND c.discarded = false)""")(_effects)
query("unexpected_coupling", f"""{COUPLING}, {CYCLE}, m AS (SELECT DISTINCT component, package FROM scc JOIN occ ON node = occ_id)
SELECT x.caller AS a, x.callee AS b, x.calls AS there, y.calls AS back, (SELECT count(*) FROM m p JOIN m q USING (component) WHERE p.package = x.caller AND q.package = x.callee) AS cycles, 'high' AS severity
FROM coupling x JOIN coupling y ON x.caller = y.callee AND x.callee = y.caller WHERE x.caller < x.callee""")(
    lambda s, d: R.unexpected_coupling(A.mutual_packages(A.package_coupling(call_edges(s, d), occurrences(s, d))), G.strong_components(call_edges(s, d)), occurrences(s, d)))

IMPORT = "'await import(''../../' || split_part(file_path, '/', 2) || '/src/' || split_part(split_part(file_path, '/', 4), '.', 1) || '.js'')'"


def _dynamic(s, d):
    occ = occurrences(s, d)
    calls = call_edges(s, d).filter("(src + dst) % 9 = 0").join(occ.select(F.col("occ_id").alias("src"), F.col("file_path").alias("home")), "src").join(occ.select(F.col("occ_id").alias("dst"), "file_path"), "dst")
    return J.dynamic_import_entries(calls.select(F.col("home").alias("file_path"), F.expr(IMPORT.replace("''", "\\'")).alias("text")), occ)


query("dynamic_import_entries", f"""{BOTH} SELECT occ_id AS node FROM occ WHERE exported AND file_path IN (SELECT b.file_path FROM call_edge e JOIN occ b ON e.dst = b.occ_id WHERE (e.src + e.dst) % 9 = 0)""")(_dynamic)
query("bounded_json")(lambda s, d: table(s, d, "documents").select("doc_id", S.bounded_json(F.to_json(F.struct("source", "lang", F.struct(F.split("text", "\n").alias("lines"), F.struct(F.array("n_chars").alias("deep")).alias("more")).alias("body")))).alias("json")))
query("named_page", f"{BOTH} SELECT occ_id, name FROM occ WHERE package = 'Brand#11' ORDER BY occ_id LIMIT 50")(
    lambda s, d: L.read_page(occurrences(s, d).filter("package = 'Brand#11'").select("occ_id", "name"), "occ_id", {"tool": "search_symbols", "package": "Brand#11"}, "g1")[0])


def _file_edges(s, d):
    files = occurrences(s, d).select("occ_id", "file_path")
    a, b = (files.withColumnsRenamed({"occ_id": n, "file_path": f"{n}_file"}) for n in ("src", "dst"))
    return call_edges(s, d).join(a, "src").join(b, "dst").select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).distinct()


query("import_cycles", f"""{BOTH}, pairs AS (SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id),
c AS (SELECT src AS a, dst AS b FROM pairs WHERE src <> dst UNION SELECT c.a, p.dst FROM c JOIN pairs p ON p.src = c.b WHERE p.src <> p.dst),
scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT component, count(*) AS files, min(node) AS anchor FROM scc GROUP BY component HAVING count(*) > 1""")(
    lambda s, d: G.strong_components(_file_edges(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("files"), F.min("node").alias("anchor")).filter("files > 1"))
