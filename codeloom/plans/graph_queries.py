"""Queries over the call graph: coupling, resolution, walks, cycles, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import aggregates as A
from codeloom.operators import graph as G
from codeloom.operators import joins as J
from codeloom.operators import predicates as P
from codeloom.operators import rules as R
from codeloom.plans.registry import query
from codeloom.sources.adapters import EDGE, OCC, call_edges, occurrences

BOTH = f"WITH RECURSIVE {OCC}, {EDGE}"
COUPLING = f"""{BOTH}, coupling AS (
  SELECT a.package AS caller, b.package AS callee, count(*) AS calls
  FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id GROUP BY ALL)"""


def _coupling(s, d):
    return A.package_coupling(call_edges(s, d), occurrences(s, d))


query("package_coupling", f"{COUPLING} SELECT * FROM coupling")(_coupling)
query("package_degrees", f"""{COUPLING}, o AS (SELECT caller AS package, count(DISTINCT callee) AS n FROM coupling GROUP BY ALL), i AS (SELECT callee AS package, count(DISTINCT caller) AS n FROM coupling GROUP BY ALL)
SELECT coalesce(o.package, i.package) AS package, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) AS fan_in FROM o FULL JOIN i USING (package)""")(lambda s, d: A.coupling_degrees(_coupling(s, d)))
query("mutual_packages", f"""{COUPLING} SELECT x.caller AS a, x.callee AS b, x.calls AS there, y.calls AS back
FROM coupling x JOIN coupling y ON x.caller = y.callee AND x.callee = y.caller WHERE x.caller < x.callee""")(lambda s, d: A.mutual_packages(_coupling(s, d)))
BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]
query("coupling_matrix", f"""{COUPLING} SELECT caller, {", ".join(f"CAST(coalesce(sum(calls) FILTER (callee = '{b}'), 0) AS BIGINT) AS {chr(34)}{b}{chr(34)}" for b in BRANDS)} FROM coupling GROUP BY caller""")(lambda s, d: A.coupling_matrix(_coupling(s, d), BRANDS))
query("top_coupling_weight", f"{COUPLING} SELECT caller, callee, calls FROM coupling ORDER BY calls DESC, caller, callee LIMIT 20")(lambda s, d: _coupling(s, d).orderBy(F.desc("calls"), "caller", "callee").limit(20))

HASHES = """h AS (SELECT DISTINCT a.body_hash AS src_hash, b.body_hash AS dst_hash FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id)"""
query("hash_adjacency", f"{BOTH}, {HASHES} SELECT * FROM h")(lambda s, d: G.hash_edges(call_edges(s, d), occurrences(s, d)))
query("graph_size", f"{BOTH} SELECT (SELECT count(*) FROM occ) AS nodes, (SELECT count(*) FROM call_edge) AS edges")(
    lambda s, d: occurrences(s, d).select(F.lit(True).alias("node")).union(call_edges(s, d).select(F.lit(False))).agg(F.count_if("node").alias("nodes"), F.count_if(~F.col("node")).alias("edges")))


def _calls(s, d):
    """Calls by hash: each call edge may mean any twin of its target."""
    occ = occurrences(s, d)
    return call_edges(s, d).join(occ.select(F.col("occ_id").alias("dst"), F.col("body_hash").alias("to_hash")), "dst").select("src", "to_hash").distinct()


def _resolved(s, d):
    occ = occurrences(s, d)
    return J.resolve_callee(_calls(s, d), occ, J.imported_packages(call_edges(s, d), occ))


RESOLVE = """imports AS (SELECT DISTINCT a.file_path, b.package FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id),
calls AS (SELECT DISTINCT e.src, b.body_hash AS to_hash FROM call_edge e JOIN occ b ON e.dst = b.occ_id),
resolved AS (
  SELECT c.src, c.to_hash, t.occ_id AS callee,
         CAST(CASE WHEN (SELECT count(*) FROM occ x WHERE x.body_hash = c.to_hash) = 1 THEN 0 WHEN t.package = o.package THEN 1
              WHEN EXISTS (SELECT 1 FROM imports i WHERE i.file_path = o.file_path AND i.package = t.package) THEN 2 ELSE 3 END AS INT) AS tier
  FROM calls c JOIN occ o ON c.src = o.occ_id JOIN occ t ON t.body_hash = c.to_hash
  QUALIFY row_number() OVER (PARTITION BY c.src, c.to_hash ORDER BY tier, t.name, t.occ_id) = 1)"""
query("resolve_callee", f"{BOTH}, {RESOLVE} SELECT * FROM resolved")(_resolved)
query("imported_packages", f"{BOTH}, {RESOLVE} SELECT * FROM imports")(lambda s, d: J.imported_packages(call_edges(s, d), occurrences(s, d)))
query("occurrence_graph", f"{BOTH}, {RESOLVE} SELECT src, callee AS dst, count(*) AS calls FROM resolved GROUP BY ALL")(lambda s, d: _resolved(s, d).groupBy("src", F.col("callee").alias("dst")).agg(F.count(F.lit(1)).alias("calls")))
query("unresolved_calls", f"{BOTH} SELECT e.src, count(*) AS missing FROM call_edge e LEFT JOIN occ b ON e.dst = b.occ_id AND b.size > 10 WHERE b.occ_id IS NULL GROUP BY e.src")(
    lambda s, d: call_edges(s, d).join(occurrences(s, d).filter("size > 10").select(F.col("occ_id").alias("dst")), "dst", "left_anti").groupBy("src").agg(F.count(F.lit(1)).alias("missing")))
query("known_targets", f"{BOTH} SELECT * FROM call_edge WHERE dst IN (SELECT occ_id FROM occ WHERE NOT in_test)")(lambda s, d: J.known_targets(call_edges(s, d), occurrences(s, d).filter("not in_test")).select("src", "dst"))


def _constrained(s, d):
    occ = occurrences(s, d)
    a = occ.select(F.col("occ_id").alias("src"), F.col("package").alias("own"), F.col("file_path").alias("own_file"))
    rows = call_edges(s, d).join(a, "src").join(occ.select(F.col("occ_id").alias("dst"), "package", "in_test"), "dst").withColumn("guessed", (F.col("src") + F.col("dst")) % 2 == 0)
    shown = call_edges(s, d).join(occ.filter("exported").select(F.col("occ_id").alias("dst")), "dst", "left_semi")  # only what is exported can be imported
    near = J.imported_packages(shown, occ)
    return J.constrain_edges(rows, near).select("src", "dst")


query("constrain_edges", f"""{BOTH}, near AS (SELECT DISTINCT a.file_path, b.package FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id WHERE b.exported)
SELECT e.src, e.dst FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id
WHERE (e.src + e.dst) % 2 <> 0 OR ((a.package = b.package OR EXISTS (SELECT 1 FROM near n WHERE n.file_path = a.file_path AND n.package = b.package)) AND (a.package = b.package OR NOT b.in_test))""")(_constrained)


def _owners(s, d):
    files = occurrences(s, d).select("file_path").distinct()
    roots = occurrences(s, d).select(F.regexp_extract("file_path", "^(packages/[^/]+)/", 1).alias("dir")).distinct().filter("dir not like '%5'").withColumn("name", F.substring_index("dir", "/", -1))
    return J.longest_prefix_owner(files, roots, "<unknown>")


query("nearest_package", f"""{BOTH} SELECT DISTINCT file_path, CASE WHEN regexp_extract(file_path, '^(packages/[^/]+)/', 1) LIKE '%5' THEN '<unknown>' ELSE regexp_extract(file_path, '^packages/([^/]+)/', 1) END AS owner FROM occ""")(_owners)
query("shard_of_file", f"""{BOTH} SELECT DISTINCT file_path, CASE WHEN file_path LIKE 'packages/brand-1%' THEN 'unit1' ELSE ':root' END AS owner FROM occ""")(
    lambda s, d: J.longest_prefix_owner(occurrences(s, d).select("file_path").distinct(), occurrences(s, d).select(F.regexp_extract("file_path", "^(packages/brand-1[^/]*)/", 1).alias("dir")).distinct().filter("dir <> ''").withColumn("name", F.lit("unit1")), ":root"))
query("nested_spans", f"""{BOTH} SELECT a.occ_id AS "outer", b.occ_id AS "inner" FROM occ a JOIN occ b ON a.file_path = b.file_path AND b.line > a.line AND b.end_line <= a.end_line""")(lambda s, d: J.nested_spans(occurrences(s, d)))
query("spans_at_line", f"""{BOTH} SELECT occ_id FROM occ WHERE 200 BETWEEN line AND end_line""")(
    lambda s, d: P.spans_at(occurrences(s, d), occurrences(s, d).select("file_path", F.lit(200).alias("at")).distinct()).select("occ_id"))

ENTRY = """entries AS (SELECT occ_id AS node FROM occ WHERE kind = 'module-init' OR name IN ('main','run','start','register','initialize','init','bootstrap') OR (exported AND occ_id NOT IN (SELECT dst FROM call_edge WHERE src <> dst))),
reached AS (SELECT node FROM entries UNION SELECT e.dst FROM reached JOIN call_edge e ON e.src = reached.node)"""
query("entry_points", f"{BOTH}, {ENTRY} SELECT node FROM entries")(lambda s, d: R.entry_points(occurrences(s, d), call_edges(s, d)))


def _reached(s, d):
    return G.reachable(call_edges(s, d), R.entry_points(occurrences(s, d), call_edges(s, d)))


query("reachable_from_entry", f"{BOTH}, {ENTRY} SELECT node FROM reached")(lambda s, d: _reached(s, d).select("node"))
query("orphan_subtree", f"""{BOTH}, {ENTRY} SELECT 'graph:orphan-subtree' AS rule_id, occ_id, 'medium' AS severity, 'not reachable' AS message FROM occ
WHERE occ_id NOT IN (SELECT node FROM reached) AND kind <> 'module-init' AND NOT exported AND NOT in_test""")(lambda s, d: R.orphans(occurrences(s, d), _reached(s, d)))
query("test_only_reachable", f"""{BOTH}, {ENTRY} SELECT 'graph:test-only-reachable' AS rule_id, occ_id, 'low' AS severity, 'only tests reach it' AS message FROM occ
WHERE NOT exported AND NOT in_test AND NOT generated AND kind <> 'module-init' AND occ_id NOT IN (SELECT node FROM reached)
  AND occ_id IN (SELECT e.dst FROM call_edge e JOIN occ a ON e.src = a.occ_id GROUP BY e.dst HAVING bool_and(a.in_test))""")(lambda s, d: R.test_only(occurrences(s, d), call_edges(s, d), _reached(s, d)))

BLAST = """b AS (SELECT dst AS node, src AS caller, 1 AS depth FROM call_edge WHERE src <> dst
  UNION SELECT b.node, e.src, b.depth + 1 FROM b JOIN call_edge e ON e.dst = b.caller WHERE b.depth < 5 AND e.src <> b.node),
m AS (SELECT node, caller, min(depth) AS depth FROM b GROUP BY ALL),
blast AS (SELECT node, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(*) FILTER (depth = 1) + 0.5::DOUBLE * count(*) FILTER (depth > 1) AS score FROM m GROUP BY node)"""
query("blast_score", f"{BOTH}, {BLAST} SELECT * FROM blast")(lambda s, d: G.blast(call_edges(s, d)))
query("high_blast_untested", f"""{BOTH}, {BLAST}, t AS (SELECT occ_id AS node FROM occ WHERE in_test UNION SELECT e.dst FROM t JOIN call_edge e ON e.src = t.node)
SELECT 'graph:high-blast-untested' AS rule_id, occ_id, CASE WHEN score >= 6 THEN 'high' ELSE 'medium' END AS severity FROM occ JOIN blast ON occ_id = node
WHERE NOT in_test AND score >= 3 AND occ_id NOT IN (SELECT node FROM t)""")(
    lambda s, d: R.high_blast(occurrences(s, d), G.blast(call_edges(s, d)), G.reachable(call_edges(s, d), occurrences(s, d).filter("in_test").select(F.col("occ_id").alias("node"))), 3, 6).drop("message"))
IMPACT = """changed AS (SELECT occ_id AS node FROM occ WHERE file_path LIKE '%/f7.ts'),
i AS (SELECT node, 0 AS depth FROM changed UNION SELECT e.src, i.depth + 1 FROM i JOIN call_edge e ON e.dst = i.node WHERE i.depth < 5),
impact AS (SELECT node, CAST(min(depth) AS INT) AS depth FROM i WHERE node NOT IN (SELECT node FROM changed) GROUP BY node)"""


def _impact(s, d):
    return G.impact(call_edges(s, d), occurrences(s, d).filter("file_path like '%/f7.ts'").select(F.col("occ_id").alias("node")))


query("impact", f"{BOTH}, {IMPACT} SELECT * FROM impact")(_impact)
query("impacted_packages", f"""{BOTH}, {IMPACT} SELECT package, count(*) AS functions FROM occ WHERE occ_id IN (SELECT node FROM impact UNION SELECT node FROM changed) GROUP BY package""")(
    lambda s, d: occurrences(s, d).join(_impact(s, d).select(F.col("node").alias("occ_id")).union(occurrences(s, d).filter("file_path like '%/f7.ts'").select("occ_id")), "occ_id", "left_semi").groupBy("package").agg(F.count(F.lit(1)).alias("functions")))
query("impact_reason", f"""{BOTH}, {BLAST}, {IMPACT} SELECT i.node, CASE WHEN score >= 10 THEN 'blast' WHEN NOT in_test THEN 'test-gap' ELSE 'caller' END AS reason FROM impact i JOIN occ ON i.node = occ_id LEFT JOIN blast USING (node)""")(
    lambda s, d: _impact(s, d).join(G.blast(call_edges(s, d)), "node", "left").join(occurrences(s, d).select(F.col("occ_id").alias("node"), "in_test"), "node").select("node", F.when(F.col("score") >= 10, "blast").when(~F.col("in_test"), "test-gap").otherwise("caller").alias("reason")))
query("select_tests", f"""{BOTH}, {IMPACT} SELECT DISTINCT file_path FROM impact JOIN occ ON node = occ_id WHERE in_test""")(
    lambda s, d: occurrences(s, d).filter("in_test").join(_impact(s, d).select(F.col("node").alias("occ_id")), "occ_id", "left_semi").select("file_path").distinct())
WALK = f"""{BOTH}, {ENTRY}, w AS (SELECT node, 0 AS depth FROM entries UNION SELECT e.dst, w.depth + 1 FROM w JOIN call_edge e ON e.src = w.node WHERE w.depth < 5),
f AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
q AS (SELECT f.node, CAST(f.depth AS INT) AS depth, min(p.node) AS parent FROM f LEFT JOIN call_edge e ON e.dst = f.node LEFT JOIN f p ON p.node = e.src AND p.depth = f.depth - 1 GROUP BY f.node, f.depth)"""


def walk_from_entries(s, d):
    """The walk from every entry point, with all nodes that it meets."""
    return G.walk(call_edges(s, d), R.entry_points(occurrences(s, d), call_edges(s, d)), cap=None)


query("bounded_walk", f"{WALK} SELECT node, depth, parent FROM q")(lambda s, d: walk_from_entries(s, d).drop("path"))
query("trace_path", f"""{WALK}, p AS (SELECT node, depth, CAST(node AS VARCHAR) AS trace FROM q WHERE depth = 0 UNION ALL SELECT q.node, q.depth, p.trace || '>' || CAST(q.node AS VARCHAR) FROM q JOIN p ON q.parent = p.node AND q.depth = p.depth + 1)
SELECT node, trace FROM p""")(lambda s, d: walk_from_entries(s, d).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("trace")))
CYCLE = """c AS (SELECT src AS a, dst AS b FROM call_edge WHERE src <> dst UNION SELECT c.a, e.dst FROM c JOIN call_edge e ON e.src = c.b WHERE e.src <> e.dst),
scc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""
query("strong_components", f"""{BOTH}, {CYCLE} SELECT n.node, coalesce(component, n.node) AS component FROM (SELECT src AS node FROM call_edge UNION SELECT dst FROM call_edge) n LEFT JOIN scc ON n.node = scc.node""")(lambda s, d: G.strong_components(call_edges(s, d)))
query("call_cycles", f"""{BOTH}, {CYCLE} SELECT component, count(*) AS size, min(node) AS anchor, count(DISTINCT package) > 1 AS crosses, CASE WHEN count(DISTINCT package) > 1 THEN 'high' ELSE 'medium' END AS severity
FROM scc JOIN occ ON node = occ_id GROUP BY component HAVING NOT bool_and(in_test) AND count(*) > 1 AND (count(*) > 2 OR count(DISTINCT package) > 1)""")(lambda s, d: R.cycles(G.strong_components(call_edges(s, d)), occurrences(s, d)))
PACK = f"""{COUPLING}, pe AS (SELECT dense_rank() OVER (ORDER BY caller) AS src, caller, callee FROM coupling WHERE caller <> callee AND calls >= 3),
c AS (SELECT caller AS a, callee AS b FROM pe UNION SELECT c.a, pe.callee FROM c JOIN pe ON pe.caller = c.b)"""
query("package_cycles", f"""{PACK} SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")(
    lambda s, d: _multi(G.strong_components(_coupling(s, d).filter("caller <> callee and calls >= 3").select(F.col("caller").alias("src"), F.col("callee").alias("dst")))))


def _multi(c):
    return c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component"), "component", "left_semi").select("node", "component")


query("pure_functions", f"""{BOTH}, i AS (SELECT occ_id AS node FROM occ WHERE size > 45 UNION SELECT e.src FROM i JOIN call_edge e ON e.dst = i.node) SELECT occ_id FROM occ WHERE occ_id NOT IN (SELECT node FROM i)""")(
    lambda s, d: R.pure_functions(occurrences(s, d), call_edges(s, d), occurrences(s, d).filter("size > 45").select(F.col("occ_id").alias("node"))).select("occ_id"))
query("large_function", f"""{BOTH} SELECT 'graph:large-function' AS rule_id, occ_id, CASE WHEN end_line - line + 1 > 500 THEN 'high' ELSE 'medium' END AS severity, CAST(end_line - line + 1 AS VARCHAR) || ' lines' AS message
FROM occ WHERE kind <> 'module-init' AND NOT in_test AND end_line - line + 1 > 300""")(lambda s, d: R.large_function(occurrences(s, d)))
query("wide_function", f"""{BOTH} SELECT 'graph:wide-function' AS rule_id, occ_id, CASE WHEN size % 10 > 7 THEN 'high' ELSE 'medium' END AS severity, CAST(size % 10 AS VARCHAR) || ' parameters' AS message FROM occ WHERE NOT in_test AND size % 10 > 5""")(
    lambda s, d: R.wide_function(occurrences(s, d).withColumn("params", F.col("size") % 10)))
query("always_throws_signals", f"""{BOTH}, o AS (SELECT * REPLACE (CASE WHEN starts_with(kind, 'PROMO') THEN 'module-init' ELSE kind END AS kind) FROM occ),
c AS (SELECT e.src AS owner, o.line + e.dst % 300 AS at, e.dst % 3 <> 0 AS throws FROM call_edge e JOIN o ON e.src = o.occ_id),
made AS (SELECT DISTINCT o.body_hash FROM call_edge e JOIN o ON e.dst = o.occ_id WHERE (e.src + e.dst) % 13 = 0),
own AS (SELECT c.throws, o.* FROM c JOIN o ON c.owner = o.occ_id WHERE o.kind <> 'module-init' AND NOT o.in_test AND NOT EXISTS (SELECT 1 FROM made m WHERE m.body_hash = o.body_hash)
  AND NOT EXISTS (SELECT 1 FROM o i WHERE i.file_path = o.file_path AND i.line > o.line AND i.end_line <= o.end_line AND c.at BETWEEN i.line AND i.end_line))
SELECT 'graph:always-throws-branch' AS rule_id, 'low' AS severity, 'quality' AS category, occ_id, file_path, line, name || ' appears to always throw.' AS message, count(*) AS edge_count
FROM own GROUP BY occ_id, file_path, line, name HAVING bool_and(throws)""")(lambda s, d: _always_throws(s, d))


def _always_throws(s, d):
    occ, edges = occurrences(s, d), call_edges(s, d)
    occ = occ.withColumn("kind", F.when(F.col("kind").startswith("PROMO"), "module-init").otherwise(F.col("kind")))
    calls = edges.join(occ.select(F.col("occ_id").alias("src"), "line"), "src")
    calls = calls.select(F.col("src").alias("owner"), F.when(F.col("dst") % 3 != 0, "throw new Error(x)").otherwise("call()").alias("text"), (F.col("line") + F.col("dst") % 300).alias("line"))
    made = edges.filter("(src + dst) % 13 = 0").join(occ, F.col("dst") == F.col("occ_id")).select("body_hash")
    return R.always_throws_signals(occ, calls, made)


query("always_throws", f"""{BOTH} SELECT src AS owner, count(*) AS edges FROM call_edge GROUP BY src HAVING bool_and(dst % 2 = 0)""")(
    lambda s, d: R.always_throws(call_edges(s, d).select(F.col("src").alias("owner"), F.when(F.col("dst") % 2 == 0, "throw e").otherwise("call()").alias("text"))))
query("who_calls", f"""{BOTH} SELECT b.name AS callee, a.name AS caller, a.file_path FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id WHERE b.package = 'Brand#11'""")(
    lambda s, d: call_edges(s, d).join(occurrences(s, d).select(F.col("occ_id").alias("src"), F.col("name").alias("caller"), "file_path"), "src").join(occurrences(s, d).filter("package = 'Brand#11'").select(F.col("occ_id").alias("dst"), F.col("name").alias("callee")), "dst").select("callee", "caller", "file_path"))
query("source_filter", f"""{BOTH} SELECT occ_id FROM occ WHERE NOT (in_test OR regexp_matches(file_path, '^(?:.*/)?f1[^/]*\\.ts$')) AND NOT generated AND package IN ('Brand#11', 'Brand#12', 'Brand#23') AND (file_path = 'packages/brand-11' OR file_path LIKE 'packages/brand-11/%')""")(
    lambda s, d: occurrences(s, d).filter(P.source_filter("production", "exclude", ("Brand#11", "Brand#12", "Brand#23"), prefix="packages/brand-11", test_globs=("**/f1*.ts",))).select("occ_id"))
query("symbol_search", f"""{BOTH} SELECT occ_id, name FROM occ WHERE contains(lower(name), 'red') ORDER BY name, occ_id LIMIT 50""")(lambda s, d: P.symbol_match(occurrences(s, d), "RED").orderBy("name", "occ_id").limit(50).select("occ_id", "name"))
query("incremental_merge", f"""{BOTH} SELECT src, dst, 'cached' AS origin FROM call_edge WHERE src % 10 <> 1 UNION ALL SELECT src, dst, 'walked' FROM call_edge WHERE src % 10 = 1""")(
    lambda s, d: J.merge_incremental(call_edges(s, d).withColumn("origin", F.lit("cached")), occurrences(s, d).filter("occ_id % 10 = 1").select(F.col("occ_id").alias("src")), call_edges(s, d).filter("src % 10 = 1").withColumn("origin", F.lit("walked")), "src"))
