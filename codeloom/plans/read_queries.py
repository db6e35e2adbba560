"""Queries behind the named reads: dependencies, architecture, files, traces, recipes, check selection, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.operators import aggregates as A
from codeloom.operators import graph as G
from codeloom.operators import joins as J
from codeloom.operators import ledger as L
from codeloom.operators import predicates as P
from codeloom.operators import reads as N
from codeloom.operators import rules as R
from codeloom.plans.graph_queries import BLAST, BOTH, COUPLING, ENTRY, IMPACT
from codeloom.plans.registry import query, table
from codeloom.plans.shared import shared_root
from codeloom.sources import ingest as I
from codeloom.sources.adapters import OCC, SESSION, SIGNAL, call_edges, occurrences, sessions, signals

KEY = "file_path || '|' || lpad(CAST(line AS VARCHAR), 16, '0') || '|' || name"
EVIDENCE = f"""{BOTH}, k AS (SELECT *, {KEY} AS sort_key FROM occ),
evidence AS (
  SELECT a.package AS src_package, b.package AS dst_package, 'call' AS kind, a.sort_key AS site, b.sort_key AS target FROM call_edge e JOIN k a ON e.src = a.occ_id JOIN k b ON e.dst = b.occ_id WHERE a.package <> b.package
  UNION ALL SELECT DISTINCT a.package, b.package, 'import', a.file_path, b.package FROM call_edge e JOIN k a ON e.src = a.occ_id JOIN k b ON e.dst = b.occ_id WHERE a.package <> b.package),
shown AS (SELECT *, CAST(row_number() OVER (PARTITION BY src_package, dst_package, kind ORDER BY site, target) AS INT) AS rank, count(*) OVER (PARTITION BY src_package, dst_package, kind) AS total FROM evidence)"""


def _evidence(s, d):
    occ, edges = occurrences(s, d), call_edges(s, d)
    return N.package_evidence(edges, occ, J.imported_packages(edges, occ))


query("why_depends", f"{EVIDENCE} SELECT * FROM shown WHERE rank <= 50")(lambda s, d: N.why_depends(_evidence(s, d)))
query("package_dependencies", f"""{EVIDENCE} SELECT src_package, dst_package, kind, count(*) AS n, string_agg(site, ';' ORDER BY rank) FILTER (rank <= 3) AS samples FROM shown GROUP BY ALL""")(
    lambda s, d: N.package_dependencies(_evidence(s, d)).withColumn("samples", F.array_join("samples", ";")))

query("get_architecture", f"""{COUPLING}, heavy AS (SELECT caller || ' -> ' || callee AS name, calls AS n FROM coupling WHERE caller <> callee),
hot AS (SELECT {KEY} AS name, n FROM occ JOIN (SELECT dst, count(*) AS n FROM call_edge WHERE src <> dst GROUP BY dst) ON dst = occ_id)
SELECT 'metric' AS section, 0 AS rank, 'functions' AS name, count(*) AS n FROM occ UNION ALL SELECT 'metric', 0, 'packages', count(DISTINCT package) FROM occ
UNION ALL SELECT 'metric', 0, 'files', count(DISTINCT file_path) FROM occ UNION ALL SELECT 'metric', 0, 'tests', count(*) FILTER (in_test) FROM occ UNION ALL SELECT 'metric', 0, 'calls', count(*) FROM call_edge
UNION ALL SELECT * FROM (SELECT 'package-edge', CAST(row_number() OVER (ORDER BY n DESC, name) AS INT) AS rank, name, n FROM heavy QUALIFY rank <= 20)
UNION ALL SELECT * FROM (SELECT 'hotspot', CAST(row_number() OVER (ORDER BY n DESC, name) AS INT) AS rank, name, n FROM hot QUALIFY rank <= 20)""")(
    lambda s, d: N.architecture(call_edges(s, d), occurrences(s, d), A.package_coupling(call_edges(s, d), occurrences(s, d))))


def _located(s, d):
    """Findings by the file of the function that their key names."""
    rows = signals(s, d).select(F.regexp_extract("file_path", "p([0-9]+)", 1).cast("long").alias("occ_id"), F.col("severity").isin("critical", "high").alias("is_error"))
    return rows.join(occurrences(s, d).select("occ_id", "file_path"), "occ_id").select("file_path", "is_error")


query("get_file_context", f"""{BOTH}, {SIGNAL},
x AS (SELECT a.file_path AS f, b.file_path AS t FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id WHERE a.file_path <> b.file_path),
g AS (SELECT o.file_path, s.severity IN ('critical', 'high') AS is_error FROM signal s JOIN occ o ON regexp_extract(s.file_path, 'p([0-9]+)', 1)::BIGINT = o.occ_id)
SELECT f.file_path, f.functions, f.exported, coalesce(o.n, 0) AS calls_out, coalesce(i.n, 0) AS calls_in, coalesce(g.n, 0) AS findings, coalesce(g.e, 0) AS errors
FROM (SELECT file_path, count(*) AS functions, count(*) FILTER (exported) AS exported FROM occ GROUP BY file_path) f LEFT JOIN (SELECT f, count(*) AS n FROM x GROUP BY f) o ON o.f = f.file_path
LEFT JOIN (SELECT t, count(*) AS n FROM x GROUP BY t) i ON i.t = f.file_path LEFT JOIN (SELECT file_path, count(*) AS n, count(*) FILTER (is_error) AS e FROM g GROUP BY file_path) g ON g.file_path = f.file_path""")(
    lambda s, d: N.file_context(occurrences(s, d), call_edges(s, d), _located(s, d)))

CHANGED = "file_path like '%/f7.ts'"
query("impact_files", f"""{BOTH}, {IMPACT} SELECT file_path, min(depth) AS depth, count(*) AS functions, bool_or(in_test) AS tests FROM impact JOIN occ ON node = occ_id GROUP BY file_path ORDER BY depth, file_path LIMIT 500""")(
    lambda s, d: N.impact_files(G.impact(call_edges(s, d), occurrences(s, d).filter(CHANGED).select(F.col("occ_id").alias("node"))), occurrences(s, d), occurrences(s, d).filter(CHANGED).select("file_path").distinct().count()))
query("impact_within_bytes", f"""{BOTH}, {IMPACT} SELECT node, so_far FROM (SELECT node, CAST(sum(strlen(file_path) + strlen(name)) OVER (ORDER BY depth, node ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM impact JOIN occ ON node = occ_id) WHERE so_far <= 8192""")(
    lambda s, d: L.within_bytes(G.impact(call_edges(s, d), occurrences(s, d).filter(CHANGED).select(F.col("occ_id").alias("node"))).join(occurrences(s, d).select(F.col("occ_id").alias("node"), "file_path", "name"), "node").withColumn("size", (F.octet_length("file_path") + F.octet_length("name")).cast("long")), [F.col("depth"), F.col("node")], "size", 8192).select("node", "so_far"))

query("trace_from_entries", f"""{BOTH}, {ENTRY}, l0 AS (SELECT node, 0 AS depth FROM entries UNION SELECT e.dst, l0.depth + 1 FROM l0 JOIN call_edge e ON e.src = l0.node WHERE l0.depth < 60),
lv AS (SELECT node, min(depth) AS depth FROM l0 GROUP BY node),
pa AS (SELECT b.node, min(a.node) AS parent FROM call_edge e JOIN lv a ON e.src = a.node JOIN lv b ON e.dst = b.node WHERE b.depth = a.depth + 1 GROUP BY b.node),
tr AS (SELECT lv.node, lv.depth, CAST(lv.node AS VARCHAR) AS trace, lv.node AS at_node FROM lv JOIN occ ON lv.node = occ_id WHERE in_test
  UNION ALL SELECT tr.node, tr.depth, CAST(pa.parent AS VARCHAR) || '>' || tr.trace, pa.parent FROM tr JOIN pa ON pa.node = tr.at_node)
SELECT node, CAST(depth AS INT) AS depth, trace FROM tr WHERE at_node IN (SELECT node FROM lv WHERE depth = 0)""")(
    lambda s, d: N.shortest_traces(call_edges(s, d), R.entry_points(occurrences(s, d), call_edges(s, d)), occurrences(s, d).filter("in_test").select(F.col("occ_id").alias("node"))).select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("trace")))

ORPHAN = f"""{BOTH}, {ENTRY}, dead AS (SELECT * FROM occ WHERE occ_id NOT IN (SELECT node FROM reached) AND kind <> 'module-init' AND NOT exported AND NOT in_test AND NOT generated)"""


def _dead(s, d):
    occ, edges = occurrences(s, d), call_edges(s, d)
    found = R.orphans(occ, G.reachable(edges, R.entry_points(occ, edges)))
    return occ.filter(P.source_filter("production", "exclude")).join(found.select("occ_id", "message"), "occ_id")


query("dead_code_page", f"{ORPHAN} SELECT {KEY} || '|' || CAST(occ_id AS VARCHAR) AS sort_key, package, 'not reachable' AS reason, (SELECT count(*) FROM dead) > 100 AS more FROM dead ORDER BY sort_key LIMIT 100")(
    lambda s, d: L.keyset_page(_dead(s, d).select(F.concat_ws("|", N.stable_key(), F.col("occ_id").cast("string")).alias("sort_key"), "package", F.col("message").alias("reason")), "sort_key", None, 100))
query("dead_code_groups", f"{ORPHAN} SELECT package, count(*) AS n, (SELECT count(DISTINCT package) > 500 FROM dead) AS truncated FROM dead GROUP BY package ORDER BY package LIMIT 500")(lambda s, d: A.group_counts(_dead(s, d), "package"))
query("body_twin_blast", f"""{BOTH}, {BLAST} SELECT body_hash, count(*) AS twins, sum(coalesce(direct, 0))::BIGINT AS direct, max(coalesce(score, 0)) AS score FROM occ LEFT JOIN blast ON occ_id = node GROUP BY body_hash""")(
    lambda s, d: occurrences(s, d).join(G.blast(call_edges(s, d)).withColumnRenamed("node", "occ_id"), "occ_id", "left").groupBy("body_hash").agg(F.count(F.lit(1)).alias("twins"), F.sum(F.coalesce("direct", F.lit(0))).alias("direct"), F.max(F.coalesce("score", F.lit(0.0))).alias("score")))

query("search_declarations", f"WITH {OCC} SELECT package, kind, count(*) AS declarations, count(*) FILTER (exported) AS exported, min({KEY}) AS first_site FROM occ WHERE NOT generated GROUP BY package, kind")(
    lambda s, d: occurrences(s, d).filter(P.source_filter("all", "exclude")).groupBy("package", "kind").agg(F.count(F.lit(1)).alias("declarations"), F.count_if("exported").alias("exported"), F.min(N.stable_key()).alias("first_site")))
query("references_to", f"{BOTH} SELECT dst AS target, count(*) AS refs, count(DISTINCT a.file_path) AS files, count(*) FILTER (a.package <> b.package) AS foreign_refs FROM call_edge e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id WHERE b.exported GROUP BY dst")(
    lambda s, d: call_edges(s, d).join(occurrences(s, d).filter("exported").select(F.col("occ_id").alias("dst"), F.col("package").alias("own")), "dst").join(occurrences(s, d).select(F.col("occ_id").alias("src"), "file_path", "package"), "src").groupBy(F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("file_path").alias("files"), F.count_if(F.col("package") != F.col("own")).alias("foreign_refs")))


def _facets(s, d):
    """Cyclic self calls are malformed evidence; more than 500 files cap a grouping by file."""
    edges, occ = call_edges(s, d), occurrences(s, d)
    own = edges.filter("src = dst").limit(1).select(F.lit("evidence").alias("facet"), F.lit("malformed-calls").alias("reason"))
    generated = occ.filter("generated").limit(1).select(F.lit("inventory").alias("facet"), F.lit("generated-source").alias("reason"))
    files = occ.agg(F.countDistinct("file_path").alias("n")).filter("n > 500").select(F.lit("grouping").alias("facet"), F.lit("group-cap").alias("reason"))
    return N.coverage_facets(own.unionByName(generated).unionByName(files), ("inventory", "grouping"))


query("coverage_facets", f"""{BOTH}, r AS (SELECT DISTINCT 'evidence' AS facet, 'malformed-calls' AS reason FROM call_edge WHERE src = dst UNION ALL SELECT DISTINCT 'inventory', 'generated-source' FROM occ WHERE generated
  UNION ALL SELECT 'grouping', 'group-cap' FROM occ HAVING count(DISTINCT file_path) > 500),
f AS (SELECT * FROM (VALUES ('inventory', true), ('evidence', false), ('grouping', true), ('projection', false)) t(facet, requested)),
a AS (SELECT facet, requested, reason FROM f LEFT JOIN r USING (facet) UNION ALL SELECT 'all', true, reason FROM f LEFT JOIN r USING (facet) WHERE requested)
SELECT facet, requested, count(reason) = 0 AS complete, coalesce(bool_or(reason LIKE '%-cap'), false) AS truncated, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM a GROUP BY facet, requested""")(
    lambda s, d: _facets(s, d).withColumn("reasons", F.array_join("reasons", ",")))

SITE = "file_path || ':' || CAST(line AS VARCHAR) || ':' || name || ':' || CAST(occ_id AS VARCHAR)"
DUPLICATES = f"""c AS (SELECT *, {SITE} AS site FROM occ), wide AS (SELECT body_hash, min(site) AS anchor, count(DISTINCT package) AS n, array_to_string(list_sort(list(DISTINCT package)), ', ') AS packages FROM c GROUP BY body_hash HAVING count(DISTINCT package) >= 3 AND arg_min(size, site) >= 8),
rest AS (SELECT body_hash, min(site) AS anchor FROM c WHERE size >= 20 AND body_hash NOT IN (SELECT body_hash FROM wide) GROUP BY body_hash HAVING count(*) >= 2),
dup_signals AS (SELECT 'graph:duplicated-function-body' AS rule_id, c.occ_id, 'low' AS severity, 'shared by ' || CAST(n AS VARCHAR) || ' packages: ' || packages AS message FROM wide JOIN c ON c.site = wide.anchor
  UNION ALL SELECT 'graph:duplicated-function-body', c.occ_id, 'low', 'same body as ' || rest.anchor FROM rest JOIN c USING (body_hash) WHERE c.site <> rest.anchor AND c.size >= 20)"""


def _duplicates(s, d):
    site = F.concat_ws(":", "file_path", F.col("line").cast("string"), "name", F.col("occ_id").cast("string"))
    return R.duplicate_signals(occurrences(s, d).withColumn("site", site), min_size=20, min_anchor=8)


query("duplicated_bodies", f"WITH {OCC}, {DUPLICATES} SELECT * FROM dup_signals")(_duplicates)


def _recipe(s, d):
    occ, edges = occurrences(s, d), call_edges(s, d)
    reached = G.reachable(edges, R.entry_points(occ, edges))
    tests = G.reachable(edges, occ.filter("in_test").select(F.col("occ_id").alias("node")))
    rules = {
        "orphan-subtree": lambda: R.orphans(occ, reached),
        "test-only-reachable": lambda: R.test_only(occ, edges, reached),
        "large-function": lambda: R.large_function(occ),
        "wide-function": lambda: R.wide_function(occ.withColumn("params", F.col("size") % 10)),
        "high-blast-untested": lambda: R.high_blast(occ, G.blast(edges), tests, 3, 6),
        "duplicated-function-body": lambda: _duplicates(s, d),
    }
    return R.run_recipe("default", rules, s)


query("recipe_signals", f"""{BOTH}, {ENTRY}, {BLAST}, {DUPLICATES}, t AS (SELECT occ_id AS node FROM occ WHERE in_test UNION SELECT e.dst FROM t JOIN call_edge e ON e.src = t.node),
x AS (SELECT rule_id, severity FROM dup_signals
  UNION ALL SELECT 'graph:orphan-subtree', 'medium' FROM occ WHERE occ_id NOT IN (SELECT node FROM reached) AND kind <> 'module-init' AND NOT exported AND NOT in_test
  UNION ALL SELECT 'graph:test-only-reachable', 'low' FROM occ WHERE NOT exported AND NOT in_test AND NOT generated AND kind <> 'module-init' AND occ_id NOT IN (SELECT node FROM reached) AND occ_id IN (SELECT e.dst FROM call_edge e JOIN occ a ON e.src = a.occ_id GROUP BY e.dst HAVING bool_and(a.in_test))
  UNION ALL SELECT 'graph:large-function', CASE WHEN end_line - line + 1 > 500 THEN 'high' ELSE 'medium' END FROM occ WHERE kind <> 'module-init' AND NOT in_test AND end_line - line + 1 > 300
  UNION ALL SELECT 'graph:wide-function', CASE WHEN size % 10 > 7 THEN 'high' ELSE 'medium' END FROM occ WHERE NOT in_test AND size % 10 > 5
  UNION ALL SELECT 'graph:high-blast-untested', CASE WHEN score >= 6 THEN 'high' ELSE 'medium' END FROM occ JOIN blast ON occ_id = node WHERE NOT in_test AND score >= 3 AND occ_id NOT IN (SELECT node FROM t))
SELECT rule_id, severity, count(*) AS n FROM x GROUP BY ALL""")(lambda s, d: _recipe(s, d).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n")))

query("latest_findings", f"""WITH {SESSION}, {SIGNAL}, l AS (SELECT id, tool FROM session QUALIFY row_number() OVER (PARTITION BY tool ORDER BY ts DESC, id DESC) = 1)
SELECT tool, s.ordinal, s.file_path, s.line, s.severity FROM l JOIN signal s ON s.ordinal = l.id""")(
    lambda s, d: N.latest_findings(sessions(s, d), signals(s, d).withColumn("session_id", F.col("ordinal")), "tool").select("tool", "ordinal", "file_path", "line", "severity"))
UNITS = f"""WITH {SIGNAL}, u AS (SELECT source AS unit, sum(line) AS duration, bool_and(severity NOT IN ('critical', 'high') OR line > 1) AS passed, CASE WHEN source = 's4' THEN 'timeout' END AS failed_with FROM signal GROUP BY source),
r AS (SELECT unit, CASE WHEN failed_with IS NOT NULL THEN 'ERROR' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, (SELECT count(*) FROM signal WHERE source = unit AND severity IN ('critical', 'high')) AS errors,
  (SELECT count(*) FROM signal WHERE source = unit AND severity NOT IN ('critical', 'high')) AS warnings, CAST(duration AS BIGINT) AS duration FROM u)"""


def _units(s, d):
    rows = signals(s, d).select("source", "line", F.col("severity").isin("critical", "high").alias("is_error"))
    units = rows.groupBy(F.col("source").alias("unit")).agg(F.sum("line").alias("duration"), F.bool_and(~F.col("is_error") | (F.col("line") > 1)).alias("passed")).withColumn("failed_with", F.when(F.col("unit") == "s4", "timeout"))
    return A.unit_table(units, rows)


query("unit_table", f"{UNITS} SELECT * FROM r")(_units)
query("unit_summary", f"{UNITS} SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status <> 'PASS') AS failed, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum(duration) AS BIGINT) AS duration FROM r")(lambda s, d: A.unit_summary(_units(s, d)))
query("median_duration", f"WITH {SESSION} SELECT tool AS tool, median(duration) AS median FROM session GROUP BY tool")(lambda s, d: A.median(sessions(s, d), "tool", "duration"))
query("confidence_floor", f"WITH {OCC}, r AS (SELECT occ_id, CASE size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence, CASE WHEN exported THEN 'dead-code' WHEN in_test THEN 'config' END AS category FROM occ) SELECT occ_id FROM r WHERE (confidence IS NULL OR confidence <> 'low') AND (category IS NULL OR category = 'dead-code')")(
    lambda s, d: occurrences(s, d).select("occ_id", F.when(F.col("size") % 4 == 0, "high").when(F.col("size") % 4 == 1, "medium").when(F.col("size") % 4 == 2, "low").alias("confidence"), F.when(F.col("exported"), "dead-code").when(F.col("in_test"), "config").alias("category")).filter(P.confidence_floor("medium", ("dead-code",))).select("occ_id"))
CHECKS = """c AS (SELECT 'pack' || CAST(p_size % 3 AS VARCHAR) || ':' || replace(lower(p_brand), '#', '-') || '-' || CAST(p_partkey AS VARCHAR) AS slug, replace(lower(p_brand), '#', '-') || '-' || CAST(p_partkey AS VARCHAR) AS bare,
  [CASE p_size % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'architecture' WHEN 2 THEN 'performance' ELSE 'quality' END, lower(p_type)] AS tags, p_size % 9 = 0 AS disabled FROM part)"""


def _checks(s, d):
    part = table(s, d, "part")
    bare = F.concat_ws("-", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.col("p_partkey").cast("string"))
    group = F.col("p_size") % 5
    tag = F.when(group == 0, "security").when(group == 1, "architecture").when(group == 2, "performance").otherwise("quality")
    return part.select(F.concat(F.lit("pack"), (F.col("p_size") % 3).cast("string"), F.lit(":"), bare).alias("slug"), F.array(tag, F.lower("p_type")).alias("tags"), (F.col("p_size") % 9 == 0).alias("disabled"))


query("resolve_checks", f"""WITH {CHECKS} SELECT slug, 'agent-risk' AS recipe FROM c WHERE len(list_filter(tags, lambda t: t IN ('architecture', 'security'))) > 0 AND NOT disabled
UNION ALL SELECT slug, 'ci' FROM c WHERE NOT list_contains(tags, 'performance') AND NOT disabled""")(
    lambda s, d: R.resolve_checks(_checks(s, d), R.CHECK_RECIPES["agent-risk"]).select("slug", F.lit("agent-risk").alias("recipe")).unionByName(R.resolve_checks(_checks(s, d), R.CHECK_RECIPES["ci"]).select("slug", F.lit("ci").alias("recipe"))))


def _csv(s, d):
    folder = f"{shared_root(s)}/codeloom/coupling-{uuid.uuid4().hex}"
    I.write_coupling(A.package_coupling(call_edges(s, d), occurrences(s, d)), folder)
    return I.read_coupling(s, folder)


query("coupling_csv", f"{COUPLING} SELECT * FROM coupling")(_csv)
