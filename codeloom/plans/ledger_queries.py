"""Queries over signals, baselines, sessions, clones, texts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions import scalars as S
from codeloom.operators import aggregates as A
from codeloom.operators import clones as C
from codeloom.operators import joins as J
from codeloom.operators import ledger as L
from codeloom.operators import predicates as P
from codeloom.operators import ranks as Q
from codeloom.operators import rules as R
from codeloom.plans.registry import query, table
from codeloom.plans.shared import saved
from codeloom.sources import ingest as I
from codeloom.sources.adapters import OCC, SESSION, SIGNAL, call_edges, occurrences, sessions, signals

SIG, SES, OC = f"WITH {SIGNAL}", f"WITH {SESSION}", f"WITH {OCC}"
FP = "rule_id || '|' || file_path || '|' || CAST(coalesce(line, 0) AS VARCHAR) || '|' || CAST(coalesce(col, 0) AS VARCHAR)"
STAMPED = f"""{SIG}, f AS (SELECT *, {FP} AS base FROM signal), stamped AS (
  SELECT *, CASE WHEN n = 1 THEN base ELSE base || '#' || CAST(n - 1 AS VARCHAR) END AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ordinal, at_ts) AS n FROM f))"""


def _stamped(s, d):
    return L.stamp_fingerprints(signals(s, d), ["ordinal", "at_ts"])


query("fingerprint_ordinals", f"{STAMPED} SELECT fingerprint, ordinal, severity FROM stamped")(lambda s, d: _stamped(s, d).select("fingerprint", "ordinal", "severity"))
DIFF = f"""{STAMPED}, now AS (SELECT fingerprint FROM stamped WHERE ordinal % 3 <> 0), old AS (SELECT fingerprint FROM stamped WHERE ordinal % 3 <> 1),
diff AS (SELECT coalesce(now.fingerprint, old.fingerprint) AS fingerprint, CASE WHEN old.fingerprint IS NULL THEN 'added' WHEN now.fingerprint IS NULL THEN 'resolved' ELSE 'unchanged' END AS state FROM now FULL JOIN old ON now.fingerprint = old.fingerprint)"""


def _diff(s, d, strict=True):
    rows = _stamped(s, d)
    return L.diff_baseline(rows.filter("ordinal % 3 <> 0"), rows.filter("ordinal % 3 <> 1"), strict)


query("baseline_diff", f"{DIFF} SELECT * FROM diff")(_diff)
query("baseline_compare_bounded", f"{DIFF} SELECT state, count(*) AS n FROM diff GROUP BY state")(lambda s, d: _diff(s, d, False).groupBy("state").agg(F.count(F.lit(1)).alias("n")))
query("baseline_delta", f"{DIFF} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'added') > 0 AS degraded FROM diff")(
    lambda s, d: _diff(s, d).agg(F.count_if(F.col("state") == "added").alias("added"), F.count_if(F.col("state") == "unchanged").alias("unchanged"), F.bool_or(F.col("state") == "added").alias("degraded")))
query("baseline_save", f"""{SIG} SELECT rule_id AS tool, {FP} AS fingerprint, 'old' AS payload FROM signal WHERE rule_id <> 'A' GROUP BY ALL
UNION ALL SELECT 'A', {FP}, arg_max(severity, row(ordinal, at_ts, severity)) FROM signal WHERE rule_id = 'A' GROUP BY ALL""")(
    lambda s, d: L.save_baseline(signals(s, d).select(F.col("rule_id").alias("tool"), S.fingerprint(*map(F.col, ("rule_id", "file_path", "line", "col"))).alias("fingerprint"), F.lit("old").alias("payload")).distinct(), "A",
                                 signals(s, d).filter("rule_id = 'A'").select(S.fingerprint(*map(F.col, ("rule_id", "file_path", "line", "col"))).alias("fingerprint"), F.col("severity").alias("payload"), F.struct("ordinal", "at_ts", "severity").alias("ordinal"))))
FILES = "before AS (SELECT o_orderkey AS k, 'src/' || CAST(o_orderkey AS VARCHAR) AS path, o_orderstatus AS mark FROM orders)"


def _marks(s, d, after):
    o = table(s, d, "orders").filter("o_orderkey % 5 <> 1" if after else "o_orderkey % 5 <> 2")
    mark = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")) if after else F.col("o_orderstatus")
    return o.select(F.concat(F.lit("src/"), F.col("o_orderkey").cast("string")).alias("path"), mark.alias("mark"))


query("changed_files", f"""WITH {FILES} SELECT path, CASE WHEN k % 5 = 2 THEN 'added' WHEN k % 5 = 1 THEN 'deleted' ELSE 'modified' END AS status FROM before WHERE k % 5 IN (1, 2) OR (k % 7 = 0 AND mark <> 'X')""")(
    lambda s, d: L.changed_files(_marks(s, d, False), _marks(s, d, True)))
query("cache_verdict", f"WITH {FILES} SELECT CASE WHEN count(*) FILTER (k % 5 IN (1, 2) OR k % 7 = 0) = 0 THEN 'valid' WHEN count(*) FILTER (k % 5 IN (1, 2) OR k % 7 = 0) * 2 < count(*) THEN 'incremental' ELSE 'invalid' END AS verdict FROM before")(
    lambda s, d: L.changed_files(_marks(s, d, False), _marks(s, d, True)).agg(F.count(F.lit(1)).alias("changed")).withColumn("all", F.lit(table(s, d, "orders").count())).select(F.when(F.col("changed") == 0, "valid").when(F.col("changed") * 2 < F.col("all"), "incremental").otherwise("invalid").alias("verdict")))
query("ledger_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders")(
    lambda s, d: L.upsert(table(s, d, "orders").filter("o_orderkey % 3 <> 0 or o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")), table(s, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("state")), ["id"]))
query("ledger_insert_ignore", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 4 = 0")(
    lambda s, d: L.upsert(table(s, d, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")), table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("state")), ["id"], replace=False))
query("merge_packages", "SELECT DISTINCT p_brand AS package FROM part UNION SELECT p_type FROM part")(lambda s, d: table(s, d, "part").select(F.col("p_brand").alias("package")).unionByName(table(s, d, "part").select(F.col("p_type").alias("package"))).dropDuplicates())
query("divergence", f"""{SIG} SELECT CASE WHEN severity = (CASE WHEN category = 'security' THEN 'high' ELSE 'low' END) THEN 'none' WHEN severity = 'critical' THEN 'verdict-changing' WHEN line = 1 THEN 'cosmetic' ELSE 'sub-verdict' END AS kind, count(*) AS n FROM signal GROUP BY kind""")(
    lambda s, d: signals(s, d).select(L.divergence(F.col("severity"), F.when(F.col("category") == "security", "high").otherwise("low"), F.col("line") == 1, F.col("severity") == "critical").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
query("chunk_by_count", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2000 AS chunk FROM orders")(lambda s, d: L.chunk_by_count(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 2000))
query("chunk_by_depth", f"{OC} SELECT array_to_string(string_split(file_path, '/')[1:2], '/') AS chunk, count(DISTINCT file_path) AS files FROM occ GROUP BY chunk")(
    lambda s, d: occurrences(s, d).groupBy(L.chunk_by_depth("file_path").alias("chunk")).agg(F.countDistinct("file_path").alias("files")))

query("latency_snapshot", f"{SES} SELECT tool, count(duration) AS n, avg(duration) AS mean, quantile_cont(duration, 0.5) AS p50, quantile_cont(duration, 0.95) AS p95, quantile_cont(duration, 0.99) AS p99 FROM session GROUP BY tool")(lambda s, d: A.latency_snapshot(sessions(s, d), "duration", "tool"))
query("nearest_rank", f"{SES} SELECT tool, median(duration) AS mid, quantile_disc(duration, 0.95) AS p95 FROM session GROUP BY tool")(
    lambda s, d: A.median(sessions(s, d), "tool", "duration").withColumnRenamed("median", "mid").join(Q.nearest_rank(sessions(s, d), "duration", ["tool"], "p95", 0.95), "tool"))
RATES = f"""{SES}, t AS (SELECT user_id, count(*) AS total, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (tool IN ('error', 'view')) AS errors, sum(duration) AS seconds FROM session GROUP BY user_id)"""


def _rates(s, d):
    t = sessions(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("tool").isin("error", "view")).alias("errors"), F.sum("duration").alias("seconds"))
    return A.rates(t).drop("seconds").withColumn("rps", F.round("rps", 6))


query("simulation_rates", f"""{RATES} SELECT user_id, total, failed, errors, failed / total AS error_rate, (total - failed) / total AS success_rate, CASE WHEN errors = 0 THEN 1.0 ELSE 1 - failed / errors END AS recovery_rate,
round(CASE WHEN seconds <= 0 THEN 0.0 ELSE total / seconds END, 6) AS rps FROM t""")(_rates)
query("assertions", f"""{SES}, m AS (SELECT tool AS metric, avg(duration) AS value FROM session GROUP BY tool), a AS (SELECT * FROM (VALUES ('view', 'lt', 60.0), ('error', 'gte', 10.0), ('click', 'neq', 0.0), ('none', 'eq', 1.0)) t(metric, op, threshold))
SELECT metric, op, threshold::DOUBLE AS threshold, value, coalesce(CASE op WHEN 'lt' THEN value < threshold WHEN 'gte' THEN value >= threshold WHEN 'neq' THEN value <> threshold WHEN 'eq' THEN value = threshold END, false) AS holds FROM a LEFT JOIN m USING (metric)""")(
    lambda s, d: A.assertions(sessions(s, d).groupBy(F.col("tool").alias("metric")).agg(F.avg("duration").alias("value")), s.sql("SELECT * FROM VALUES ('view', 'lt', 60D), ('error', 'gte', 10D), ('click', 'neq', 0D), ('none', 'eq', 1D) AS t(metric, op, threshold)")))
query("pass_rate", f"{SES} SELECT user_id, count(*) AS total, count(*) FILTER (passed) AS passed, CAST(round(count(*) FILTER (passed) / count(*) * 100) AS BIGINT) AS score FROM session GROUP BY user_id")(lambda s, d: A.pass_rate(sessions(s, d), "passed", "user_id"))
query("suite_groups", f"{SES} SELECT suite, list(id ORDER BY ts DESC, id DESC) AS ids, max(ts) AS latest, count(*) AS n FROM session GROUP BY suite")(lambda s, d: A.suite_groups(sessions(s, d)))
query("latest_per_tool", f"{SES} SELECT tool, id, ts FROM session QUALIFY row_number() OVER (PARTITION BY tool ORDER BY ts DESC, id DESC) = 1")(lambda s, d: L.latest(sessions(s, d), "tool").select("tool", "id", "ts"))
query("retention", f"{SES} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS n FROM session) WHERE n <= 5")(lambda s, d: L.retain(sessions(s, d), "user_id", 5).select("id"))
query("session_page", f"{SES} SELECT id, tool, ts FROM session ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100")(lambda s, d: sessions(s, d).select("id", "tool", "ts").orderBy(F.desc("ts"), F.desc("id")).offset(100).limit(50))
query("cwd_scope", f"{SES} SELECT id FROM session WHERE cwd = '/work/u3' OR cwd LIKE '/work/u3/%'")(lambda s, d: sessions(s, d).filter(S.under(F.col("cwd"), "/work/u3")).select("id"))
query("session_summaries", f"{SES} SELECT s.id, s.tool, c.c_name AS owner, json_extract_string(e.props, '$.k') AS k FROM session s LEFT JOIN customer c ON s.user_id = c.c_custkey LEFT JOIN events e ON s.id = e.event_id")(
    lambda s, d: sessions(s, d).join(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("owner")), "user_id", "left").join(table(s, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k")), "id", "left").select("id", "tool", "owner", "k"))
query("run_step_counts", "SELECT count(*) AS steps, count(DISTINCT l_orderkey) AS runs, count(DISTINCT l_suppkey) AS sessions FROM lineitem JOIN orders ON l_orderkey = o_orderkey")(
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("steps"), F.countDistinct("l_orderkey").alias("runs"), F.countDistinct("l_suppkey").alias("sessions")))
query("runs_without_steps", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey"))
query("runs_with_steps", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey"))
query("arm_metrics", """WITH s AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS bytes, turn * 2 + 1 AS wall, turn >= 2 AS useful FROM conversations), p AS (SELECT *, sum(wall) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM s)
SELECT conv_id, count(*) AS calls, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(wall) AS BIGINT) AS wall, CAST(min(so_far) FILTER (useful) AS BIGINT) AS to_useful FROM p GROUP BY conv_id""")(
    lambda s, d: A.arm_metrics(table(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("bytes"), (F.col("turn") * 2 + 1).alias("wall"), (F.col("turn") >= 2).alias("useful")), "conv_id", "turn"))

query("agent_filters", f"{SIG} SELECT rule_id, file_path, line, ordinal, severity FROM signal WHERE severity IN ('critical', 'high') AND category = 'security' AND file_path LIKE 'src/p1%' ORDER BY ordinal, line, file_path, rule_id LIMIT 100")(
    lambda s, d: P.agent_filter(signals(s, d), ["errors-only", "category:security", "file:src/p1", "top:5", "top:100"], ["ordinal", "line", "file_path", "rule_id"]).select("rule_id", "file_path", "line", "ordinal", "severity"))
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
query("risk_order", f"{SIG} SELECT ordinal, line, severity, CAST({RANK} AS INT) AS rank FROM signal ORDER BY {RANK}, category, rule_id, file_path, line, col, source, ordinal LIMIT 200")(
    lambda s, d: signals(s, d).withColumn("rank", S.severity_rank(F.col("severity"))).orderBy("rank", "category", "rule_id", "file_path", "line", "col", "source", "ordinal").limit(200).select("ordinal", "line", "severity", "rank"))
query("check_counts", f"{SIG} SELECT source, count(*) FILTER (severity IN ('critical', 'high')) AS errors, count(*) FILTER (severity NOT IN ('critical', 'high')) AS warnings, count(DISTINCT file_path) AS files, 'fail' AS verdict FROM signal GROUP BY source")(lambda s, d: A.check_counts(signals(s, d), "source"))
query("recipe_totals", f"{SIG} SELECT rule_id, category, count(*) AS n FROM signal GROUP BY ALL")(lambda s, d: signals(s, d).groupBy("rule_id", "category").agg(F.count(F.lit(1)).alias("n")))
query("group_counts", f"{SIG} SELECT file_path, count(*) AS n, (SELECT count(DISTINCT file_path) > 500 FROM signal) AS truncated FROM signal GROUP BY file_path ORDER BY file_path LIMIT 500")(lambda s, d: A.group_counts(signals(s, d), "file_path"))
query("keyset_page", "SELECT o_orderkey, true AS more FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")(lambda s, d: L.keyset_page(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 100))
query("stable_keys", f"{OC} SELECT occ_id, file_path || '|' || lpad(CAST(line AS VARCHAR), 16, '0') || '|' || name AS sort_key FROM occ")(lambda s, d: occurrences(s, d).select("occ_id", F.concat_ws("|", "file_path", F.lpad(F.col("line").cast("string"), 16, "0"), "name").alias("sort_key")))
query("bounded_catalog", f"{OC} SELECT occ_id, so_far FROM (SELECT occ_id, CAST(sum(size) OVER (ORDER BY size DESC, occ_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM occ) WHERE so_far <= 20000")(
    lambda s, d: L.within_bytes(occurrences(s, d), [F.desc("size"), F.col("occ_id")], "size", 20000).select("occ_id", "so_far"))
query("correlation_groups", f"""{OC}, m AS (SELECT DISTINCT kind, file_path AS value, occ_id AS id, size AS risk FROM occ), g AS (SELECT kind, value, list_sort(list(DISTINCT id)) AS ids, arg_min(id, risk * 10000000 + id) AS "primary", min(risk) AS risk FROM m GROUP BY ALL HAVING count(DISTINCT id) >= 2)
SELECT kind, value, ids, "primary", risk FROM g QUALIFY row_number() OVER (PARTITION BY ids ORDER BY kind, value) = 1""")(lambda s, d: A.correlation_groups(occurrences(s, d).select("kind", F.col("file_path").alias("value"), F.col("occ_id").alias("id"), F.col("size").alias("risk"))))
query("ranked_functions", f"{OC} SELECT occ_id, CAST(end_line - line + 1 AS BIGINT) AS lines FROM occ ORDER BY lines DESC, occ_id LIMIT 100")(lambda s, d: occurrences(s, d).select("occ_id", (F.col("end_line") - F.col("line") + 1).cast("long").alias("lines")).orderBy(F.desc("lines"), "occ_id").limit(100))
query("confidence_summary", f"{OC} SELECT count(*) FILTER (kind LIKE 'ECONOMY%') AS high, count(*) FILTER (kind LIKE 'SMALL%') AS medium, count(*) FILTER (NOT (kind LIKE 'ECONOMY%' OR kind LIKE 'SMALL%')) AS low, CAST(sum(size) AS BIGINT) AS estimate FROM occ")(
    lambda s, d: A.confidence_summary(occurrences(s, d).select(F.when(F.col("kind").startswith("ECONOMY"), "high").when(F.col("kind").startswith("SMALL"), "medium").alias("confidence"), F.col("size").alias("estimate"))))
query("reduction_rank", f"{OC} SELECT occ_id FROM occ WHERE size >= 10 ORDER BY size DESC, kind, occ_id LIMIT 100")(lambda s, d: occurrences(s, d).filter(F.coalesce(F.col("size") >= 10, F.lit(True))).orderBy(F.desc("size"), "kind", "occ_id").limit(100).select("occ_id"))

DUP = f"{OC}, dup AS (SELECT body_hash, count(*) AS n, min(file_path || ':' || CAST(line AS VARCHAR) || ':' || name || ':' || CAST(occ_id AS VARCHAR)) AS anchor, count(DISTINCT package) AS packages, max(size) AS size FROM occ WHERE size >= 20 GROUP BY body_hash HAVING count(*) >= 2)"


def _cands(s, d):
    return occurrences(s, d).withColumn("site", F.concat_ws(":", "file_path", F.col("line").cast("string"), "name", F.col("occ_id").cast("string")))


def _eligible(s, d):
    """A quarter of the functions are arrows; a sixth say their own count of lines."""
    kind = F.when(F.col("occ_id") % 4 == 1, "arrow").otherwise(F.col("kind"))
    rows = _cands(s, d).withColumns({"kind": kind, "body_lines": F.when(F.col("occ_id") % 6 == 0, F.col("size") % 9)})
    return C.exact_groups(C.long_enough(C.eligible(rows)), min_size=20)


query("exact_duplicates", f"{DUP} SELECT * FROM dup")(lambda s, d: C.exact_groups(_cands(s, d), min_size=20))
query("eligible_duplicates", f"""{OC} SELECT body_hash, count(*) AS n, min(file_path || ':' || CAST(line AS VARCHAR) || ':' || name || ':' || CAST(occ_id AS VARCHAR)) AS anchor, count(DISTINCT package) AS packages, max(size) AS size
FROM occ WHERE NOT in_test AND occ_id % 4 <> 1 AND CASE WHEN occ_id % 6 = 0 THEN size % 9 ELSE size * 12 + 1 END >= 5 AND size >= 20 GROUP BY body_hash HAVING count(*) >= 2""")(lambda s, d: _eligible(s, d))
query("duplicate_loc", f"{DUP} SELECT body_hash, CAST(size * (n - 1) AS BIGINT) AS lines FROM dup")(lambda s, d: C.duplicate_lines(C.exact_groups(_cands(s, d), min_size=20)).select("body_hash", "lines"))
query("cross_package_duplicates", f"{OC} SELECT body_hash, count(*) AS n, array_to_string(list_sort(list(DISTINCT package)), ',') AS packages FROM occ GROUP BY body_hash HAVING count(DISTINCT package) >= 3 AND arg_min(size, file_path || ':' || CAST(line AS VARCHAR) || ':' || name || ':' || CAST(occ_id AS VARCHAR)) >= 8")(
    lambda s, d: C.cross_package_groups(_cands(s, d), min_anchor=8).select("body_hash", "n", F.array_join("packages", ",").alias("packages")))
query("duplicate_documents", r"SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body_hash, count(*) AS n, min(doc_id) AS anchor FROM documents GROUP BY 1 HAVING count(*) >= 2")(
    lambda s, d: table(s, d, "documents").groupBy(F.sha2(C.normalized(F.col("text")), 256).alias("body_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("anchor")).filter("n >= 2"))


def _signed(s, d):
    """Different document bodies; copies are one candidate, named by their smallest id."""
    body = C.normalized(F.coalesce(F.col("text"), F.lit("")))
    rows = table(s, d, "documents").select("doc_id", body.alias("body"), F.sha2(body, 256).alias("hash")).groupBy("hash").agg(F.min("doc_id").alias("id"), F.min_by("body", "doc_id").alias("body"))
    return saved(rows.select("id", "hash", C.signature(F.col("body")).alias("sig")).filter("sig is not null"))


def _pairs(s, d):
    return C.near_pairs(_signed(s, d))


query("near_coverage")(lambda s, d: C.near_coverage(_signed(s, d)))
query("near_duplicates")(_pairs)
query("near_duplicate_clusters")(lambda s, d: C.cluster_rows(_pairs(s, d)))

RULES = "(VALUES " + ", ".join(f"('{r.slug}', '{r.pattern}', '{r.severity}')" for r in R.LINE_RULES) + ") r(slug, pattern, severity)"


def _lines(s, d):
    return P.lines_of(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text")


query("regex_check", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number FROM documents)
SELECT doc_id AS id, number, slug, severity, len(regexp_extract_all(content, pattern)) AS matches FROM l, {RULES} WHERE regexp_matches(content, pattern)""")(
    lambda s, d: R.line_checks(_lines(s, d)).select("id", F.col("number").cast("long").alias("number"), "slug", "severity", F.col("matches").cast("long").alias("matches")))
query("all_line_checks", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number FROM documents)
SELECT doc_id AS id, number, slug, severity, 1 + length(string_split(regexp_replace(content, pattern, chr(1) || '\\0'), chr(1))[1]) AS col, len(regexp_extract_all(content, pattern)) AS matches
FROM l, {RULES} WHERE regexp_matches(content, pattern)""")(
    lambda s, d: R.line_checks(_lines(s, d)).select("id", *(F.col(c).cast("long").alias(c) for c in ("number", "col", "matches")), "slug", "severity"))
query("file_length", "SELECT doc_id AS id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS lines, CASE WHEN lines > 40 THEN 'error' WHEN lines > 20 THEN 'warning' ELSE 'ok' END AS status FROM documents")(lambda s, d: R.file_length(table(s, d, "documents"), "doc_id", "text", 20, 40))


def _directives(s, d):
    rows = _lines(s, d).filter(F.col("content").contains("License")).select("id", "number")
    return rows.withColumn("scope", F.when(F.col("number") <= 2, "file").otherwise("next"))


_LINES = """l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number FROM documents)"""
_SUPPRESSED = f"""WITH {_LINES},
v AS (SELECT id, number FROM l WHERE contains(content, 'License')),
passed AS (SELECT id, number, EXISTS (SELECT 1 FROM v x WHERE x.id = v.id AND x.number = v.number + 1) AS a,
  EXISTS (SELECT 1 FROM v x WHERE x.id = v.id AND x.number = v.number + 2) AS b, EXISTS (SELECT 1 FROM v x WHERE x.id = v.id AND x.number = v.number + 3) AS c FROM v),
meant AS (SELECT DISTINCT id, number + 1 + CASE WHEN a AND b AND c THEN 3 WHEN a AND b THEN 2 WHEN a THEN 1 ELSE 0 END AS number FROM passed WHERE number > 2)
SELECT l.id, l.number, EXISTS (SELECT 1 FROM v WHERE v.id = l.id AND v.number <= 2) OR EXISTS (SELECT 1 FROM meant m WHERE m.id = l.id AND m.number = l.number) AS suppressed FROM l"""


def _suppressions(s, d):
    return P.suppressed(_lines(s, d).select("id", "number"), _directives(s, d), ["id"]).select("id", F.col("number").cast("long").alias("number"), "suppressed")


query("suppressions", _SUPPRESSED)(_suppressions)
_Q = "''"  # a quote inside an SQL string
_ONE, _TWO, _BACK = rf"{_Q}(?:[^{_Q}\\]|\\.)*{_Q}", r'"(?:[^"\\]|\\.)*"', r"(?s:`(?:[^`\\]|\\.)*`)"
query("strip_literals", rf"""SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_ONE}', '{_Q}{_Q}', 'g'), '{_TWO}', '""', 'g'), '{_BACK}', '``', 'g'), '//[^\n]*', '', 'g') AS code
FROM documents""")(lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("id"), S.strip_literals(F.col("text")).alias("code")))
query("blank_literals", rf"""WITH p AS (SELECT doc_id AS id, regexp_extract_all(text, '{_ONE}|{_TWO}|{_BACK}|//[^\n]*|(?s:/\*.*?\*/)|[^{_Q}"`/]+|(?s:.)') AS pieces FROM documents)
SELECT id, array_to_string(list_transform(pieces, lambda x: CASE WHEN length(x) > 1 AND x[1] IN (chr(39), '"', '`') THEN x[1] || regexp_replace(x[2:-2], '[^\n]', ' ', 'g') || x[1]
  WHEN x[1:2] IN ('//', '/*') THEN regexp_replace(x, '[^\n]', ' ', 'g') ELSE x END), '') AS code FROM p""")(
    lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("id"), S.blank_literals(F.col("text")).alias("code")))
query("directive_inventory", "SELECT doc_id AS id, count(*) AS directives, bool_or(length(x) < 45) AS weak FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE contains(x, 'License') GROUP BY doc_id")(
    lambda s, d: _lines(s, d).filter(F.col("content").contains("License")).groupBy("id").agg(F.count(F.lit(1)).alias("directives"), F.bool_or(F.length("content") < 45).alias("weak")))
query("cycle_suppression", f"WITH {SIGNAL} SELECT rule_id, count(*) AS n FROM signal WHERE file_path NOT IN (SELECT file_path FROM signal WHERE severity = 'critical' AND line = 1) GROUP BY rule_id")(
    lambda s, d: signals(s, d).join(signals(s, d).filter("severity = 'critical' and line = 1").select("file_path").distinct(), "file_path", "left_anti").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")))
query("restrict_to_changed", f"{SIG} SELECT ordinal, line FROM signal WHERE file_path IN (SELECT 'src/p' || CAST(p_partkey AS VARCHAR) || '.ts' FROM part WHERE p_size = 7)")(
    lambda s, d: signals(s, d).join(table(s, d, "part").filter("p_size = 7").select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("file_path")), "file_path", "left_semi").select("ordinal", "line"))
query("detection_quality", """WITH c AS (SELECT lang, quality = 0 AS expected, text LIKE '%!!%' AS actual FROM documents JOIN labels USING (doc_id)), q AS (SELECT lang, count(*) FILTER (expected AND actual) AS tp, count(*) FILTER (NOT expected AND actual) AS fp, count(*) FILTER (expected AND NOT actual) AS fn, count(*) FILTER (NOT expected AND NOT actual) AS tn FROM c GROUP BY lang)
SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr FROM q""")(
    lambda s, d: A.detection_quality(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("lang", (F.col("quality") == 0).alias("expected"), F.col("text").contains("!!").alias("actual")), "lang"))
query("file_fan_out", f"{OC}, e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity <= 3) SELECT a.file_path AS importer, count(DISTINCT b.file_path) AS n, CASE WHEN count(DISTINCT b.file_path) > 4 THEN 'error' WHEN count(DISTINCT b.file_path) > 2 THEN 'warning' ELSE 'ok' END AS status FROM e JOIN occ a ON e.src = a.occ_id JOIN occ b ON e.dst = b.occ_id GROUP BY a.file_path")(
    lambda s, d: R.fan_out(call_edges(s, d).join(occurrences(s, d).select(F.col("occ_id").alias("src"), F.col("file_path").alias("importer")), "src").join(occurrences(s, d).select(F.col("occ_id").alias("dst"), F.col("file_path").alias("target")), "dst"), 2, 4))
query("import_resolution", f"{OC}, k AS (SELECT DISTINCT file_path AS path FROM occ) SELECT DISTINCT file_path AS importer, replace(file_path, '.ts', '') AS target, file_path AS resolved FROM occ")(
    lambda s, d: J.resolve_imports(occurrences(s, d).select(F.col("file_path").alias("importer"), S.strip_extension(F.col("file_path")).alias("target")).distinct(), occurrences(s, d).select(F.col("file_path").alias("path")).distinct()))
query("semantic_references", f"{OC} SELECT o.occ_id, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status FROM occ o LEFT JOIN (SELECT body_hash, count(*) AS n, min(occ_id) AS target FROM occ WHERE exported GROUP BY body_hash) e USING (body_hash)")(
    lambda s, d: J.unique_exports(occurrences(s, d).select("occ_id", "body_hash"), occurrences(s, d).filter("exported").select("body_hash", F.col("occ_id").alias("target")), ["body_hash"]).drop("body_hash"))


def _stitched(s, d):
    """A third of the functions has edges of its own; a function's column is its number, as two can begin on one line."""
    occ = occurrences(s, d).withColumn("column", F.col("occ_id"))
    own = occ.filter("occ_id % 3 = 0").select("body_hash", "file_path", "line", "column", F.col("occ_id").alias("edges"))
    by_hash = occ.groupBy("body_hash").agg(F.min("occ_id").alias("edges"))
    return J.stitch(occ.select("occ_id", "body_hash", "file_path", "line", "column"), own, by_hash).select("occ_id", "edges")


query("stitched_edges", f"{OC} SELECT occ_id, CASE WHEN occ_id % 3 = 0 THEN occ_id ELSE (SELECT min(x.occ_id) FROM occ x WHERE x.body_hash = o.body_hash) END AS edges FROM occ o")(
    lambda s, d: _stitched(s, d))
query("unused_config", "SELECT DISTINCT p_brand AS property FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity = 50 AND l_discount = 0.1)")(
    lambda s, d: table(s, d, "part").select(F.col("p_brand").alias("property")).distinct().join(table(s, d, "part").join(table(s, d, "lineitem").filter("l_quantity = 50 and l_discount = 0.1"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("property")), "property", "left_anti"))
query("target_files", r"SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages WHERE regexp_matches(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '^(?:en|de)/[^/]*$') AND NOT regexp_matches(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '^.*1[^/]*\.html$')")(
    lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path")).filter(F.col("path").rlike(S.glob_pattern("{en,de}/*")) & ~F.col("path").rlike(S.glob_pattern("**1*.html"))))
query("target_membership", r"SELECT page_id, t.name FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages), (VALUES ('english', '^en/'), ('html', '\.html$'), ('german', '^de/')) t(name, pattern) WHERE regexp_matches(path, pattern)")(
    lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path")).select("page_id", F.explode(F.filter(F.array(*[F.when(F.col("path").rlike(p), n) for n, p in (("english", "^en/"), ("html", r"\.html$"), ("german", "^de/"))]), lambda x: x.isNotNull())).alias("name")))
query("package_of", f"{OC} SELECT occ_id, regexp_extract(file_path, '^packages/([^/]+)/', 1) AS package FROM occ")(lambda s, d: occurrences(s, d).select("occ_id", S.package_of_path(F.col("file_path")).alias("package")))
query("specifier_package", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '@' || regexp_extract(url, '://([^/]*)', 1) || '/' || 'x' ELSE regexp_extract(url, '://([^/]*)', 1) END AS package FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", S.package_of_specifier(F.concat(F.when(F.col("page_id") % 2 == 0, "@").otherwise(""), F.regexp_extract("url", "://([^/]*)", 1), F.lit("/x/y"))).alias("package")))
query("severity_map", "SELECT l_orderkey, CASE WHEN l_quantity / 5 >= 9 THEN 'critical' WHEN l_quantity / 5 >= 7 THEN 'high' WHEN l_quantity / 5 >= 4 THEN 'medium' ELSE 'low' END AS severity FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", S.cvss_severity((F.col("l_quantity") / 5).cast("string")).alias("severity")))
query("path_functions", f"{OC} SELECT occ_id, regexp_replace(file_path, '/[^/]*$', '') AS dir, replace(file_path, '.ts', '') AS stem, replace(file_path, '/src', '') AS joined, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM occ")(
    lambda s, d: occurrences(s, d).select("occ_id", S.parent_dir(F.col("file_path")).alias("dir"), S.strip_extension(F.col("file_path")).alias("stem"), S.normalize_path(F.replace("file_path", F.lit("/src/"), F.lit("/src/./../"))).alias("joined"), S.slug(F.col("name")).alias("slug")))
query("content_fingerprints", "SELECT page_id, sha256(url || chr(10) || 'rule' || chr(10) || html) AS fingerprint FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", S.content_fingerprint(F.col("url"), F.lit("rule"), F.col("html")).alias("fingerprint")))
query("fnv_fingerprints", """WITH c AS (SELECT page_id, list_transform(list_filter(string_split(url, ''), lambda x: x <> ''), lambda x: CAST(ord(x) AS BIGINT)) AS codes FROM pages)
SELECT page_id, lpad(printf('%x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), codes), lambda h, x: xor(h, x) * 16777619 % 4294967296)), 8, '0') AS fingerprint FROM c""")(
    lambda s, d: table(s, d, "pages").select("page_id", S.fnv1a(F.col("url")).alias("fingerprint")))
query("fuzzy_rank")(lambda s, d: occurrences(s, d).select("occ_id", "name", S.fuzzy_score(F.col("name"), "re").alias("score")).filter("score > 0").orderBy(F.desc("score"), "occ_id"))
query("file_roles", f"{OC} SELECT occ_id, 'source' AS roles FROM occ")(lambda s, d: occurrences(s, d).select("occ_id", F.array_join(S.file_roles(F.col("file_path")), ",").alias("roles")))
query("valid_edges", "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 >= 1 AND o_orderstatus <> 'P'")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.array(F.col("o_orderpriority")).alias("to"), (F.col("o_orderkey") % 13).alias("line"), F.lit(0).alias("column"), F.when(F.col("o_orderstatus") == "P", "bogus").otherwise("static").alias("resolution")).filter(P.valid_edge()).select("o_orderkey"))
query("sarif_round_trip", f"{SIG} SELECT rule_id, file_path, line, greatest(col, 1) AS col, CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE severity END AS severity FROM signal")(
    lambda s, d: I.sarif_signals(signals(s, d).select(F.to_json(F.struct(F.array(F.struct(F.array(I.sarif_result(F.col("rule_id"), F.col("severity"), F.lit("m"), F.col("file_path"), F.col("line"), F.col("col"))).alias("results"))).alias("runs"))).alias("value"))).select("rule_id", "file_path", "line", "col", "severity"))
query("json_envelope", f"""{SIG} SELECT source, '{{"errors":' || count(*) FILTER (severity IN ('critical', 'high')) || ',"warnings":' || count(*) FILTER (severity NOT IN ('critical', 'high')) || ',"verdict":"fail"}}' AS json FROM signal GROUP BY source""")(lambda s, d: I.envelope(signals(s, d), "source"))
query("catalog_ids", f"{OC} SELECT occ_id, 'sym:' || substr(sha256(package || chr(10) || file_path || chr(10) || name), 1, 16) AS symbol FROM occ")(lambda s, d: occurrences(s, d).select("occ_id", I.symbol_id(F.col("package"), F.col("file_path"), F.col("name")).alias("symbol")))
query("suite_order", f"{SES} SELECT id, max(ts) OVER (PARTITION BY suite) AS suite_latest FROM session")(lambda s, d: sessions(s, d).select("id", F.max("ts").over(W.Window.partitionBy("suite")).alias("suite_latest")))
