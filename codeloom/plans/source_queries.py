"""Queries over source texts: places of matches, imports read from texts, undeclared packages, reports of other tools.

The texts are written from the rows of ``lineitem``, one file for each supplier; the SQL twins never parse them, they say
from the rows what has to be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import rules as R
from codeloom.operators import text_checks as T
from codeloom.plans.registry import query, table
from codeloom.plans.shared import saved
from codeloom.sources import ingest as I

RULES = "(VALUES " + ", ".join(f"('{r.slug}', '{r.pattern}', '{r.severity}')" for r in R.LINE_RULES) + ") r(slug, pattern, severity)"
LINES = """l AS (
  SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number
  FROM documents)"""

query("regex_matches", rf"""WITH {LINES}, hits AS (
  SELECT id, number, slug, severity, string_split(regexp_replace(content, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS parts
  FROM l, {RULES}
  WHERE regexp_matches(content, pattern) AND NOT regexp_matches(trim(content), '^(//|/\*|\*($|[ /*]))')
), placed AS (
  SELECT id, number, slug, severity, parts, unnest(range(2, len(parts) + 1)) AS i FROM hits)
SELECT id, number AS line, slug AS type, severity, split_part(parts[i], chr(2), 1) AS match,
       CAST(1 + list_sum(list_transform(parts[1:i - 1], lambda x: length(replace(x, chr(2), '')))) AS BIGINT) AS "column"
FROM placed""")(lambda s, d: _all_rules(s, d, False))
query("first_match_of_line", rf"""WITH {LINES}, hits AS (
  SELECT id, number, slug, severity, row_number() OVER (PARTITION BY id, number ORDER BY list_position([{", ".join(f"'{r.slug}'" for r in R.LINE_RULES)}], slug)) AS place,
         string_split(regexp_replace(content, pattern, chr(1) || '\0' || chr(2)), chr(1)) AS parts
  FROM l, {RULES}
  WHERE regexp_matches(content, pattern) AND NOT regexp_matches(trim(content), '^(//|/\*|\*($|[ /*]))'))
SELECT id, number AS line, slug AS type, severity, split_part(parts[2], chr(2), 1) AS match, CAST(1 + length(parts[1]) AS BIGINT) AS "column"
FROM hits WHERE place = 1""")(lambda s, d: _all_rules(s, d, True))


def _all_rules(s: SparkSession, d: str, one: bool) -> DataFrame:
    check = T.PatternCheck("line-rules", tuple(T.Pattern(r.slug, r.pattern, r.severity) for r in R.LINE_RULES), one_per_line=one)
    found = T.regex_list_check(table(s, d, "documents"), check, "doc_id")
    return found.select("id", F.col("line").cast("long").alias("line"), "type", "severity", "match", F.col("column").cast("long").alias("column"))


PLACE = "'packages/p' || CAST({0} % 7 AS VARCHAR) || '/src/s' || CAST({0} AS VARCHAR) || '.ts'"
#: What each line of the files says; ``kind`` decides which of six forms it has.
WRITTEN = f"""written AS (
  SELECT a.l_suppkey AS s, b.l_suppkey AS t, a.l_partkey % 25 AS k, (a.l_orderkey + a.l_linenumber) % 6 AS kind, {PLACE.format("a.l_suppkey")} AS file_path,
         row_number() OVER (PARTITION BY a.l_suppkey ORDER BY a.l_orderkey, a.l_linenumber, b.l_suppkey, a.l_partkey) AS line
  FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
MANIFEST = """manifest AS (
  SELECT DISTINCT 'packages/p' || CAST(s_suppkey % 7 AS VARCHAR) AS directory, 'pkg-' || CAST(s_nationkey AS VARCHAR) AS dependency, s_nationkey % 4 = 0 AS dev
  FROM supplier)"""


def source_files(s: SparkSession, d: str) -> DataFrame:
    """file_path, text."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("t"))
    pairs = rows.join(after, ["l_orderkey", "l_linenumber"])
    path = F.concat(F.lit("../../p"), (F.col("t") % 7).cast("string"), F.lit("/src/s"), F.col("t").cast("string"))
    pkg = F.concat(F.lit("pkg-"), (F.col("l_partkey") % 25).cast("string"))
    forms = [("import {{ a }} from '{}';", path), ("export * from '{}.js';", path), ("// import b from '{}';", path), ('const s = "import c from \'{}\'";', path), ("const d = require('{}/sub');", pkg), ('import type {{ E }} from "{}";', pkg)]
    kind, said = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.lit(None).cast("string")
    for k, (form, name) in enumerate(forms):
        said = F.when(kind == k, F.concat(*(x for y in zip(map(F.lit, form.replace("{{", "{").replace("}}", "}").split("{}")), (name, F.lit(""))) for x in y))).otherwise(said)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "t", "l_partkey", said.alias("said")))), lambda x: x["said"])
    own = F.col("l_suppkey")
    file = F.concat(F.lit("packages/p"), (own % 7).cast("string"), F.lit("/src/s"), own.cast("string"), F.lit(".ts"))
    return pairs.groupBy(file.alias("file_path")).agg(F.array_join(lines, "\n").alias("text"))


def manifests(s: SparkSession, d: str) -> DataFrame:
    package = F.concat(F.lit("p"), (F.col("s_suppkey") % 7).cast("string"))
    section = F.when(F.col("s_nationkey") % 4 == 0, "devDependencies").otherwise("dependencies")
    return table(s, d, "supplier").select(F.concat(F.lit("packages/"), package).alias("directory"), package.alias("name"), section.alias("section"), F.concat(F.lit("pkg-"), F.col("s_nationkey").cast("string")).alias("dependency"))


SPECIFIER = """CASE kind WHEN 0 THEN '../../p' || CAST(t % 7 AS VARCHAR) || '/src/s' || CAST(t AS VARCHAR) WHEN 1 THEN '../../p' || CAST(t % 7 AS VARCHAR) || '/src/s' || CAST(t AS VARCHAR) || '.js'
  WHEN 4 THEN 'pkg-' || CAST(k AS VARCHAR) || '/sub' ELSE 'pkg-' || CAST(k AS VARCHAR) END"""
query("import_places", f"WITH {WRITTEN} SELECT file_path, line, {SPECIFIER} AS specifier, CASE kind WHEN 4 THEN 'require' ELSE 'static' END AS form FROM written WHERE kind IN (0, 1, 4, 5)")(
    lambda s, d: T.imports(source_files(s, d)).withColumn("line", F.col("line").cast("long")))
query("import_edges", f"WITH {WRITTEN} SELECT DISTINCT file_path AS importer, {PLACE.format('t')} AS target FROM written WHERE kind < 2 AND t IN (SELECT s FROM written)")(
    lambda s, d: T.import_edges(source_files(s, d)))
query("imported_packages_of_texts", f"""WITH {WRITTEN}
SELECT DISTINCT file_path, CASE WHEN kind < 2 THEN 'p' || CAST(t % 7 AS VARCHAR) ELSE 'pkg-' || CAST(k AS VARCHAR) END AS package
FROM written WHERE kind IN (4, 5) OR kind < 2 AND t IN (SELECT s FROM written)""")(lambda s, d: _packages(s, d))
query("phantom_dependencies", f"""WITH {WRITTEN}, {MANIFEST}
SELECT file_path, line, 'pkg-' || CAST(k AS VARCHAR) AS package, CASE WHEN m.dependency IS NULL THEN 'undeclared' ELSE 'dev only' END AS reason
FROM written w LEFT JOIN manifest m ON m.directory = 'packages/p' || CAST(w.s % 7 AS VARCHAR) AND m.dependency = 'pkg-' || CAST(k AS VARCHAR)
WHERE kind IN (4, 5) AND coalesce(m.dev, true) AND w.s % 7 IN (SELECT s_suppkey % 7 FROM supplier)""")(
    lambda s, d: T.phantom_dependencies(source_files(s, d), manifests(s, d)).withColumn("line", F.col("line").cast("long")))


def _packages(s: SparkSession, d: str) -> DataFrame:
    files = saved(source_files(s, d))
    found = T.resolve_specifiers(saved(T.imports(files).select("file_path", "specifier")), files.select("file_path"))
    return T.imported_packages(found, files.select("file_path", F.split("file_path", "/")[1].alias("package")))


def _reports(s: SparkSession, d: str) -> DataFrame:
    """One report of issues for each supplier; every fifth is cut off in its middle."""
    rows = table(s, d, "lineitem")
    place = F.struct(F.concat(F.lit("s"), F.col("l_partkey").cast("string"), F.lit(".go")).alias("Filename"), F.col("l_linenumber").alias("Line"), F.col("l_orderkey").alias("Column"))
    severity = F.when(F.col("l_quantity") > 35, "error").when(F.col("l_quantity") > 15, "warning").otherwise("info")
    issue = F.struct(F.col("l_linestatus").alias("FromLinter"), F.col("l_returnflag").alias("Text"), severity.alias("Severity"), place.alias("Pos"))
    text = F.to_json(F.struct(F.collect_list(issue).alias("Issues")))
    found = rows.groupBy("l_suppkey").agg(text.alias("value"))
    return found.select(F.when(F.col("l_suppkey") % 5 == 0, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value"))


query("tool_reports", """SELECT 'golangci-lint' AS source, l_linestatus AS rule_id, 's' || CAST(l_partkey AS VARCHAR) || '.go' AS file_path, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_orderkey >= 1 THEN l_orderkey END AS col,
  l_returnflag AS message, CASE WHEN l_quantity > 35 THEN 'high' WHEN l_quantity > 15 THEN 'medium' ELSE 'low' END AS severity
FROM lineitem WHERE l_suppkey % 5 <> 0""")(lambda s, d: I.tool_signals(_reports(s, d), "golangci-lint"))
query("report_rejects", "SELECT 'malformed JSON' AS reason, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey % 5 = 0 HAVING n > 0")(lambda s, d: I.tool_rejects(_reports(s, d), "golangci-lint"))
