"""Queries that put findings of several sources together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import correlation as K
from codeloom.plans.registry import query
from codeloom.plans.shared import shared_root
from codeloom.sources.adapters import SIGNAL, signals
from codeloom.sources.baselines import BaselineStore

#: Findings: every line of an order is one; those of lines 2 name a function, and all files lie in one package.
FINDING = f"""{SIGNAL}, finding AS (
  SELECT ordinal * 8 + line AS ref, source, rule_id, file_path, line, col, severity, line = 1 AS is_new, col % 50 AS dependents,
         'fp' || CAST(ordinal % 5000 AS VARCHAR) AS fingerprint, ordinal AS step_index, line AS signal_index, CASE WHEN line = 2 THEN 'fn' || CAST(col % 40 AS VARCHAR) END AS qualified_name,
         CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS weight
  FROM signal)"""
KEYED = f"""{FINDING}, keyed AS (
  SELECT 'fingerprint' AS kind, 0 AS kind_weight, fingerprint AS value, finding.* FROM finding
  UNION ALL SELECT 'symbol', 2, qualified_name, finding.* FROM finding WHERE qualified_name IS NOT NULL
  UNION ALL SELECT 'rule-location', 3, rule_id || '|' || file_path || '|' || CAST(line AS VARCHAR) || '|' || CAST(col AS VARCHAR), finding.* FROM finding
  UNION ALL SELECT 'file-range', 4, file_path || ':' || CAST(line AS VARCHAR) || ':' || CAST(col AS VARCHAR), finding.* FROM finding
  UNION ALL SELECT 'package', 5, 'src', finding.* FROM finding
  UNION ALL SELECT 'file', 6, file_path, finding.* FROM finding)"""
ORDER = "weight, NOT is_new, -dependents, source, file_path, line, col, rule_id, fingerprint, step_index, signal_index, ref"
GROUPS = f"""WITH {KEYED}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY {ORDER}) AS place FROM keyed
), g AS (
  SELECT kind, value, kind_weight, min(weight) AS weight, bool_or(is_new) AS is_new, max(dependents) AS dependents, count(*) AS n, CAST(min(ref) FILTER (place = 1) AS BIGINT) AS "primary",
         list(CAST(ref AS BIGINT) ORDER BY place) FILTER (place <= 10) AS members, list(ref ORDER BY ref) AS whole
  FROM placed GROUP BY kind, value, kind_weight HAVING count(*) >= 2
), based AS (
  SELECT *, 'corr-' || kind || '-' || trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM g
), named AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || CAST(row_number() OVER w AS VARCHAR) END AS id FROM based WINDOW w AS (PARTITION BY base ORDER BY kind_weight, value))
SELECT id, kind, value, CASE kind WHEN 'file-range' THEN 'medium' WHEN 'package' THEN 'low' WHEN 'file' THEN 'low' ELSE 'high' END AS confidence,
       CASE weight WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, is_new, dependents, n, "primary\""""


def findings(s: SparkSession, d: str) -> DataFrame:
    line, none = F.col("line"), F.lit(None).cast("string")
    return signals(s, d).select(
        (F.col("ordinal") * 8 + line).alias("ref"), "source", "rule_id", "file_path", "line", "col", "severity", (line == 1).alias("is_new"), (F.col("col") % 50).alias("dependents"),
        F.concat(F.lit("fp"), (F.col("ordinal") % 5000).cast("string")).alias("fingerprint"), F.col("ordinal").alias("step_index"), line.alias("signal_index"),
        F.when(line == 2, F.concat(F.lit("fn"), (F.col("col") % 40).cast("string"))).alias("qualified_name"), none.alias("body_hash"), none.alias("scc_id"), F.lit(None).cast("array<string>").alias("packages"), none.alias("package"),
    )


SHOWN_ORDER = "weight, NOT is_new, kind_weight, -len(members), id"
query("correlations", f"{GROUPS}, members FROM named QUALIFY row_number() OVER (PARTITION BY list_sort(members) ORDER BY {SHOWN_ORDER}) = 1")(lambda s, d: K.groups(findings(s, d), group_limit=None))
query("top_correlations", f"{GROUPS}, members FROM named QUALIFY row_number() OVER (PARTITION BY list_sort(members) ORDER BY {SHOWN_ORDER}) = 1 ORDER BY {SHOWN_ORDER} LIMIT 20")(lambda s, d: K.groups(findings(s, d)))
query("correlations_by_whole_sets", f"{GROUPS} FROM named QUALIFY row_number() OVER (PARTITION BY n, whole ORDER BY weight, NOT is_new, kind_weight, -n, id) = 1")(lambda s, d: K.groups(findings(s, d), None, None))
query("correlation_entities", f"""WITH {KEYED}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY {ORDER}) AS spot, count(*) OVER (PARTITION BY kind, value) AS n FROM keyed
), e AS (
  SELECT kind, value, n, spot * 10 + 1 AS spot, 'fingerprint' AS entity_kind, fingerprint AS entity_id FROM ordered
  UNION ALL SELECT kind, value, n, spot * 10 + 2, 'file', file_path FROM ordered
  UNION ALL SELECT kind, value, n, spot * 10 + 3, 'file-range', file_path || ':' || CAST(line AS VARCHAR) || ':' || CAST(col AS VARCHAR) FROM ordered
  UNION ALL SELECT kind, value, n, spot * 10 + 4, 'symbol', qualified_name FROM ordered WHERE qualified_name IS NOT NULL
  UNION ALL SELECT kind, value, n, spot * 10 + 5, 'package', 'src' FROM ordered
), seen AS (SELECT kind, value, entity_kind, entity_id, min(spot) AS spot FROM e WHERE n >= 2 GROUP BY ALL)
SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind, value ORDER BY spot) AS INTEGER) AS place, entity_kind, entity_id FROM seen
QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY spot) <= 12""")(lambda s, d: K.group_entities(findings(s, d)))


def _saved_baseline(s: SparkSession, d: str) -> DataFrame:
    """All findings are saved, then those of three lines of each order in their place."""
    store = BaselineStore(s, f"{shared_root(s)}/codeloom/baselines-{uuid.uuid4().hex}")
    rows = signals(s, d).select(F.concat_ws("|", "rule_id", "file_path").alias("fingerprint"), F.col("severity").alias("payload"), (F.col("ordinal") * 8 + F.col("line")).alias("ordinal"), "line")
    store.save("fit", rows)
    store.save("fit", rows.filter("line <= 3"))
    store.prune()
    return store.load("fit")


query("saved_baseline", f"""WITH {SIGNAL} SELECT rule_id || '|' || file_path AS fingerprint, severity AS payload FROM signal WHERE line <= 3
QUALIFY row_number() OVER (PARTITION BY rule_id, file_path ORDER BY ordinal * 8 + line DESC, severity DESC) = 1""")(_saved_baseline)
