"""Queries over what packages export to each other, and over the layers of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import exports as X
from codeloom.plans.registry import query, table
from codeloom.sources import targets as T
from codeloom.sources.adapters import OCC, occurrences

#: Every line of an order calls a name of a package: of an unknown one, by a path, by a file of the package, or by its root.
CALL = f"""{OCC}, call AS (
  SELECT l_orderkey AS ref, 'n' || CAST(l_partkey % 40 AS VARCHAR) AS name, 'Brand#' || CAST(1 + l_suppkey % 5 AS VARCHAR) || CAST(1 + l_partkey % 5 AS VARCHAR) AS brand, l_linenumber, l_partkey, l_quantity
  FROM lineitem
), called AS (
  SELECT *, CASE l_linenumber WHEN 1 THEN 'unknown/pkg' WHEN 2 THEN './near' WHEN 3 THEN brand || '/f' || CAST(l_partkey % 50 AS VARCHAR) ELSE brand END AS specifier FROM call
), export AS (SELECT package, 'n' || CAST(occ_id % 40 AS VARCHAR) AS name, occ_id AS target, file_path, regexp_extract(file_path, '([^/]*)\\.ts$', 1) AS stem, kind FROM occ WHERE exported
), known AS (SELECT DISTINCT package FROM occ
), shown AS (
  SELECT *, l_linenumber > 2 AND brand IN (FROM known) AND (brand NOT LIKE '%5' OR l_linenumber > 3 OR (l_partkey % 50 BETWEEN 10 AND 18) OR l_partkey % 50 = 1) AS mapped FROM called)"""
#: Packages whose name ends with 5 show their root and the files f1 and f10 to f18 only.
SURFACE = [(".", True), ("./f1*", True), ("./f19", False)]


def _calls(s: SparkSession, d: str) -> DataFrame:
    part = F.col("l_partkey")
    brand = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 5 + 1).cast("string"), (part % 5 + 1).cast("string"))
    n = F.col("l_linenumber")
    specifier = F.when(n == 1, "unknown/pkg").when(n == 2, "./near").when(n == 3, F.concat(brand, F.lit("/f"), (part % 50).cast("string"))).otherwise(brand)
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("ref"), F.concat(F.lit("n"), (part % 40).cast("string")).alias("name"), specifier.alias("specifier"), "l_quantity", "l_partkey")


def _exports(s: SparkSession, d: str) -> DataFrame:
    return occurrences(s, d).filter("exported").select("package", F.concat(F.lit("n"), (F.col("occ_id") % 40).cast("string")).alias("name"), F.col("occ_id").alias("target"), "file_path", "kind")


def _surface(s: SparkSession, d: str) -> DataFrame:
    shown = F.explode(F.array(*[F.struct(F.lit(p).alias("subpath"), F.lit(a).alias("allowed")) for p, a in SURFACE]))
    return occurrences(s, d).select("package").distinct().filter("package like '%5'").select("package", shown.alias("s")).select("package", "s.*")


query("specifier_packages", f"WITH {CALL} SELECT DISTINCT specifier, brand AS package, CASE WHEN l_linenumber = 3 THEN './f' || CAST(l_partkey % 50 AS VARCHAR) END AS subpath FROM shown WHERE mapped")(
    lambda s, d: X.specifier_packages(_calls(s, d), occurrences(s, d), _surface(s, d)))
query("export_links", f"""WITH {CALL}, counted AS (
  SELECT c.*, (SELECT count(*) FROM export e WHERE e.package = c.brand AND e.name = c.name) AS n FROM shown c
), linked AS (
  SELECT c.ref, c.name, c.specifier, c.l_linenumber, c.mapped, c.n, min(e.target) AS one, count(e.target) FILTER (e.stem = 'f' || CAST(c.l_partkey % 50 AS VARCHAR)) AS there, min(e.target) FILTER (e.stem = 'f' || CAST(c.l_partkey % 50 AS VARCHAR)) AS in_file, c.l_partkey, c.rowid_
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM counted) c LEFT JOIN export e ON e.package = c.brand AND e.name = c.name GROUP BY ALL
), t AS (SELECT *, CASE WHEN mapped AND n = 1 THEN one WHEN mapped AND l_linenumber = 3 AND there = 1 THEN in_file END AS target FROM linked)
SELECT ref, name, specifier, target, CASE WHEN l_linenumber = 2 THEN 'local' WHEN NOT mapped THEN 'external' WHEN n = 0 THEN 'missing' WHEN target IS NULL THEN 'ambiguous' ELSE 'linked' END AS link FROM t""")(
    lambda s, d: X.link_exported(_calls(s, d), _exports(s, d), occurrences(s, d), _surface(s, d)).drop("l_quantity", "l_partkey"))


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    part, few = F.col("l_partkey"), F.col("l_quantity") <= 5
    kinds = occurrences(s, d).select(F.col("occ_id").alias("l_partkey"), "kind")
    # a tenth of the references have a target already, half of those one that is declared no more
    given = F.when(few, F.when(part % 2 == 0, part).otherwise(-part))
    references = _calls(s, d).join(kinds, "l_partkey").select("ref", "name", "specifier", F.when(F.col("l_quantity") < 49, F.col("kind")).alias("kind"), given.alias("target"))
    declared = occurrences(s, d).select(F.col("occ_id").alias("declaration"), "package", F.concat(F.lit("n"), (F.col("occ_id") % 40).cast("string")).alias("name"), "kind", "exported")
    return X.reconcile_references(references, declared, occurrences(s, d), _surface(s, d))


query("reconciled_references", f"""WITH {CALL}, refs AS (
  SELECT c.ref, c.name, c.specifier, c.l_linenumber, c.brand, c.mapped, CASE WHEN c.l_quantity < 49 THEN o.kind END AS kind, CASE WHEN c.l_quantity <= 5 THEN CASE WHEN c.l_partkey % 2 = 0 THEN c.l_partkey ELSE -c.l_partkey END END AS given
  FROM shown c JOIN occ o ON o.occ_id = c.l_partkey
), index AS (SELECT package, name, kind, count(*) AS n, min(target) AS one FROM export GROUP BY ALL
), s AS (
  SELECT r.*, CASE WHEN given < 0 THEN 'unresolved:target-missing-after-merge' WHEN given IS NOT NULL THEN 'kept' WHEN l_linenumber = 2 THEN 'local' WHEN NOT mapped THEN 'external:external-or-unmapped-specifier'
    WHEN r.kind IS NULL THEN 'unresolved:cross-package-join-incomplete-descriptor' WHEN n = 1 THEN 'workspace-export-index' WHEN n > 1 AND l_linenumber > 3 THEN 'ambiguous:cross-package-join-ambiguous' ELSE 'unresolved:cross-package-join-not-found' END AS state, one
  FROM refs r LEFT JOIN index i ON i.package = r.brand AND i.name = r.name AND i.kind = r.kind)
SELECT ref, name, specifier, kind, CASE WHEN given IS NULL AND mapped THEN brand END AS package, CASE state WHEN 'kept' THEN given WHEN 'workspace-export-index' THEN one END AS target,
       split_part(state, ':', 1) AS basis, CASE WHEN contains(state, ':') THEN split_part(state, ':', 2) END AS reason FROM s""")(_reconciled)

TARGETS = [T.Target("english", ("en/**",), ("**/*1.html",)), T.Target("html", ("**/*.html", "de/**"), ("fr/**",)), T.Target("short", ("{en,de}/*",))]
PATHS = """p AS (SELECT DISTINCT '/site/' || path AS file_path, path FROM (SELECT rtrim(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/') AS path FROM pages)), m AS (
  SELECT file_path, 'english' AS target FROM p WHERE path LIKE 'en/%' AND NOT path LIKE '%1.html'
  UNION ALL SELECT file_path, 'html' FROM p WHERE (path LIKE '%.html' OR path LIKE 'de/%') AND NOT path LIKE 'fr/%'
  UNION ALL SELECT file_path, 'short' FROM p WHERE regexp_matches(path, '^(en|de)/[^/]*$')), kept AS (
  SELECT DISTINCT * FROM m WHERE NOT regexp_matches(file_path, '/(node_modules|dist|[.]git)/') AND NOT regexp_matches(file_path, '/[^/]*7[.]html$'))"""


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(F.concat(F.lit("/site/"), F.regexp_replace(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), "/+$", "")).alias("file_path"))


query("target_layers", f"WITH {PATHS} SELECT * FROM kept")(lambda s, d: T.memberships(_files(s, d), "/site", TARGETS, ("**/*7.html",)))
query("bounded_target_membership", f"""WITH {PATHS} SELECT file_path, list_sort(list(target))[:2] AS targets, count(*) > 2 AS targets_capped, (SELECT count(DISTINCT file_path) FROM kept) > 200 AS capped
FROM kept GROUP BY file_path ORDER BY file_path LIMIT 200""")(lambda s, d: T.bounded_memberships(_files(s, d), "/site", TARGETS, ("**/*7.html",), 200, 2))
