"""Readers for findings of other tools, and writers for signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as S

SARIF = "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,properties:struct<`security-severity`:string>>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:long,startColumn:long>>>>>>>>"

#: Tools that write SARIF 2.1.0.
SARIF_TOOLS = ("ast-grep", "cppcheck", "dependency-check", "pmd", "semgrep", "spotbugs", "trivy")
#: Free text that holds credentials, and what takes their place.
CREDENTIALS = (
    (r"(?i)(\b[a-z][a-z0-9+.-]*://)([^@/\s:]+):([^@/\s]+)@", "$1$2:***@"),
    (r"(?i)\b(bearer|basic)\s+([\w.~+/=-]{4,})", "$1 ***"),
    (r"""(?i)\b(password|passwd|pwd|token|api[_-]?key|secret)\b(["']?\s*[:=]\s*["']?)(\S+)""", "$1$2***"),
)


def redacted(text: Column) -> Column:
    """Free text without the credentials of addresses, authorisation schemes and assignments."""
    for pattern, instead in CREDENTIALS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def preview(secret: Column) -> Column:
    """The first four characters of a secret, none of a short one."""
    return F.when(F.length(secret) > 4, F.concat(F.substring(secret, 1, 4), F.lit("\u2026"))).when(F.length(secret) > 0, "\u2026")


def sarif_signals(docs: DataFrame, text: str = "value") -> DataFrame:
    """One signal for each result of SARIF documents (one document a row)."""
    runs = docs.select(F.explode(F.from_json(text, SARIF)["runs"]).alias("run"))
    rows = runs.select(F.col("run.tool.driver.name").alias("source"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    place = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    rule = F.get(F.filter("rules", lambda x: x["id"] == F.col("r.ruleId")), F.lit(0))
    score = rule["properties"]["security-severity"]
    severity = F.when(score.isNotNull(), S.cvss_severity(score)).otherwise(S.level_severity(F.col("r.level")))
    return rows.select("source", F.col("r.ruleId").alias("rule_id"), place["artifactLocation"]["uri"].alias("file_path"), S.coordinate(place["region"]["startLine"]).alias("line"), S.coordinate(place["region"]["startColumn"]).alias("col"), F.col("r.message.text").alias("message"), severity.alias("severity"))


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    return sarif_signals(spark.read.text(path, wholetext=True))


def tool_signals(docs: DataFrame, tool: str, text: str = "value") -> DataFrame:
    """Signals of a tool's reports, one report a row; ``tool_rejects`` counts what has another shape."""
    if tool in SARIF_TOOLS:
        return sarif_signals(docs, text)
    return TOOLS[tool](docs.select(F.col(text).alias("value")))


def tool_rejects(docs: DataFrame, tool: str, text: str = "value") -> DataFrame:
    """reason, n: reports that are no JSON or have another shape, entries that are no objects, and lines that are no JSON.

    Null and blank reports count as such, too; tools that write lines may write other text between them.
    """
    rows = docs.select(F.col(text).alias("value"))
    if tool in LINE_TOOLS:
        lines = rows.select(F.explode(F.split(F.coalesce("value", F.lit("")), r"\r?\n")).alias("line")).filter(F.trim("line").rlike(r"^[{\[]"))
        found = lines.select(F.when(F.try_parse_json("line").isNull(), "malformed line").alias("reason"))
        empty = rows.filter(F.coalesce(F.trim("value"), F.lit("")) == "").select(F.lit("no report").alias("reason"))
        return found.unionByName(empty).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    place, kind = SHAPES["sarif" if tool in SARIF_TOOLS else tool]
    rows = rows.select(_as_list(F.col("value")).alias("value")) if tool == "ruff" else rows
    v = rows.select("value", F.try_parse_json("value").alias("v"))
    top = F.try_variant_get("v", place, "variant") if place != "$" else F.col("v")
    v = v.withColumn("top", top).withColumn("shape", F.schema_of_variant("top"))
    ok = F.col("shape").startswith("ARRAY")
    absent = F.col("top").isNull() | (F.col("shape") == "VOID")
    whole = F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "no report").when(F.col("v").isNull(), "malformed JSON").when(absent & F.lit(kind == "optional") & F.schema_of_variant("v").startswith("OBJECT"), None).when(absent | ~ok, "unexpected shape")
    entries = v.filter(ok).select(F.explode(F.try_variant_get("top", "$", "array<variant>")).alias("e"))
    odd = entries.select(F.when(F.coalesce(~F.schema_of_variant("e").startswith("OBJECT"), F.lit(True)), "entry is no object").alias("reason"))
    return v.select(whole.alias("reason")).unionByName(odd).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _signal(source: str, rule: Column, path: Column, line: Column, col: Column, message: Column, severity: Column) -> list[Column]:
    place = [path.alias("file_path"), S.coordinate(line.cast("long")).alias("line"), S.coordinate(col.cast("long")).alias("col")]
    return [F.lit(source).alias("source"), rule.alias("rule_id"), *place, message.alias("message"), severity.alias("severity")]


def pip_audit_signals(docs: DataFrame) -> DataFrame:
    """One signal for each vulnerability of a dependency, and one for each dependency that was skipped."""
    schema = "dependencies array<struct<name:string,version:string,skip_reason:string,vulns:array<struct<id:string,description:string>>>>"
    deps = docs.select(F.explode(F.from_json("value", schema)["dependencies"]).alias("d")).filter("d is not null")
    none, empty = F.lit(None), F.lit("")
    skipped = deps.filter("d.skip_reason is not null")
    skipped = skipped.select(*_signal("pip-audit", F.lit("pip-audit-skipped-dependency"), empty, none, none, F.col("d.skip_reason"), F.lit("medium")))
    found = deps.select("d", F.explode("d.vulns").alias("v")).filter("v is not null")
    rule, name = F.coalesce("v.id", F.lit("pip-vulnerability")), F.coalesce("d.name", F.lit("dependency"))
    label = F.concat(name, F.coalesce(F.concat(F.lit("@"), "d.version"), empty))
    message = F.concat(F.coalesce("v.description", rule), F.lit(" ("), label, F.lit(")"))
    return skipped.unionByName(found.select(*_signal("pip-audit", rule, empty, none, none, message, F.lit("high"))))


def _json_lines(docs: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are no objects give none."""
    lines = docs.select(F.explode(F.split("value", "\n")).alias("line")).filter(F.trim("line").startswith("{"))
    return lines.select(F.from_json("line", schema).alias("x"))


def clippy_signals(docs: DataFrame) -> DataFrame:
    """One signal for each compiler message with a span, at its primary one."""
    span = "struct<is_primary:boolean,file_name:string,line_start:long,column_start:long>"
    schema = f"reason string, message struct<message:string,level:string,code:struct<code:string>,spans:array<{span}>>"
    rows = _json_lines(docs, schema).filter("x.reason = 'compiler-message'").select("x.message.*")
    primary = F.coalesce(F.get(F.filter("spans", lambda s: s["is_primary"]), F.lit(0)), F.get("spans", F.lit(0)))
    rows = rows.withColumn("at", primary).filter("message is not null and at is not null")
    severity = F.coalesce(S.label_severity(F.col("level")), F.lit("medium"))
    rule, path = F.coalesce("code.code", F.lit("clippy")), F.coalesce("at.file_name", F.lit(""))
    return rows.select(*_signal("cargo-clippy", rule, path, F.col("at.line_start"), F.col("at.column_start"), F.col("message"), severity))


def govulncheck_signals(docs: DataFrame) -> DataFrame:
    """One signal for each vulnerability that a report finds, at a trace that calls it if there is one, with the advisory's summary."""
    frame = "struct<function:string,position:struct<filename:string,line:long,column:long>>"
    schema = f"osv struct<id:string,summary:string>, finding struct<osv:string,trace:array<{frame}>>"
    report = docs.select(F.xxhash64("value").alias("report"), "value")
    lines = report.select("report", F.posexplode(F.split("value", "\n")).alias("at", "line")).filter(F.trim("line").startswith("{"))
    rows = lines.select("report", "at", F.from_json("line", schema).alias("x"))
    advisories = rows.filter("x.osv.id is not null").groupBy("report", F.col("x.osv.id").alias("osv")).agg(F.max_by("x.osv.summary", "at").alias("summary"))
    calls = F.exists("trace", lambda f: f["function"].isNotNull())
    found = rows.filter("x.finding.osv is not null").select("report", "at", "x.finding.*").withColumn("reachable", F.coalesce(calls, F.lit(False)))
    best = F.min_by(F.struct("trace", "reachable"), F.struct(~F.col("reachable"), F.col("at"))).alias("f")
    rows = found.groupBy("report", "osv").agg(best).select("report", "osv", "f.*").join(advisories, ["report", "osv"], "left")
    rows = rows.withColumn("place", F.get(F.filter("trace", lambda f: f["position"]["filename"].isNotNull()), F.lit(0))["position"])
    summary = F.coalesce("summary", F.concat(F.lit("Go vulnerability detected ("), "osv", F.lit(")")))
    message = F.concat(summary, F.when(F.col("reachable"), "").otherwise(" (imported, not called)"))
    severity = F.when(F.col("reachable"), "high").otherwise("medium")
    return rows.select(*_signal("govulncheck", F.col("osv"), F.coalesce("place.filename", F.lit("")), F.col("place.line"), F.col("place.column"), message, severity))


def _entries(docs: DataFrame, place: str) -> DataFrame:
    """The objects of a list in JSON reports, as variants ``e``, with the report ``v``."""
    v = docs.select(F.try_parse_json("value").alias("v")).filter("v is not null")
    rows = v.select("v", F.explode(F.try_variant_get("v", place, "array<variant>")).alias("e"))
    return rows.filter(F.schema_of_variant("e").startswith("OBJECT"))


def _get(place: str, kind: str = "string", of: str = "e") -> Column:
    return F.try_variant_get(of, f"$.{place}", kind)


def gitleaks_signals(docs: DataFrame) -> DataFrame:
    """One signal for each secret; no part of it but a short preview is ever in a message."""
    rule, secret = F.coalesce(_get("RuleID"), F.lit("gitleaks-secret")), _get("Secret")
    text = redacted(F.coalesce(_get("Description"), F.concat(F.lit("Secret detected ("), rule, F.lit(")"))))
    text = F.when(F.length(secret) > 0, F.replace(text, secret, preview(secret))).otherwise(text)
    return _entries(docs, "$").select(*_signal("gitleaks", rule, F.coalesce(_get("File"), F.lit("")), _get("StartLine", "long"), _get("StartColumn", "long"), text, F.lit("high")))


def golangci_signals(docs: DataFrame) -> DataFrame:
    """One signal for each issue, and for the errors and warnings of a report about itself."""
    none, tool = F.lit(None), F.lit("golangci-lint")
    rule = F.coalesce(_get("FromLinter"), tool)
    severity = F.coalesce(S.label_severity(_get("Severity")), F.lit("medium"))
    issues = _entries(docs, "$.Issues").select(*_signal("golangci-lint", rule, F.coalesce(_get("Pos.Filename"), F.lit("")), _get("Pos.Line", "long"), _get("Pos.Column", "long"), F.coalesce(_get("Text"), rule), severity))
    own = docs.select(F.try_parse_json("value").alias("e")).select(_get("Report.Error").alias("text")).filter("trim(text) <> ''")
    own = own.select(*_signal("golangci-lint", F.lit("golangci-lint-report-error"), F.lit(""), none, none, F.col("text"), F.lit("high")))
    warned = _entries(docs, "$.Report.Warnings").filter(_get("Text").isNotNull())
    warned = warned.select(*_signal("golangci-lint", F.lit("golangci-lint-report-warning"), F.lit(""), none, none, _get("Text"), F.lit("medium")))
    return issues.unionByName(own).unionByName(warned)


def osv_signals(docs: DataFrame) -> DataFrame:
    """One signal for each vulnerability of a package: by the score of its group, else by its label."""
    results = _entries(docs, "$.results").select(_get("source.path").alias("path"), F.explode(_get("packages", "array<variant>")).alias("p"))
    rows = results.select("path", "p", F.explode(_get("vulnerabilities", "array<variant>", "p")).alias("e")).filter(F.schema_of_variant("e").startswith("OBJECT"))
    rule = F.coalesce(_get("id"), F.lit("osv-vulnerability"))
    groups = F.coalesce(F.try_variant_get("p", "$.groups", "array<struct<ids:array<string>,max_severity:string>>"), F.array())
    rows = rows.withColumn("rule", rule).withColumn("groups", groups)
    score = F.get(F.filter("groups", lambda g: F.array_contains(F.coalesce(g["ids"], F.array().cast("array<string>")), F.col("rule")) & (F.length(g["max_severity"]) > 0)), F.lit(0))["max_severity"]
    label = S.label_severity(_get("database_specific.severity"))
    severity = F.when(score.try_cast("double").isNotNull(), S.cvss_severity(score)).otherwise(F.coalesce(label, F.lit("medium")))
    name, version = _get("package.name", of="p"), _get("package.version", of="p")
    about = F.when(name.isNull(), "").otherwise(F.concat(F.lit(" ("), name, F.coalesce(F.concat(F.lit("@"), version), F.lit("")), F.lit(")")))
    return rows.select(*_signal("osv-scanner", F.col("rule"), F.coalesce("path", F.lit("")), F.lit(None), F.lit(None), F.concat(F.coalesce(_get("summary"), F.col("rule")), about), severity))


def deny_signals(docs: DataFrame) -> DataFrame:
    """One signal for each diagnostic with a message, at its first label."""
    lines = docs.select(F.explode(F.split("value", r"\r?\n")).alias("line")).select(F.try_parse_json(F.trim("line")).alias("v"))
    lines = lines.filter(F.schema_of_variant("v").startswith("OBJECT") & (F.coalesce(_get("type", of="v"), F.lit("diagnostic")) == "diagnostic"))
    rows = lines.select(F.coalesce(_get("fields", "variant", "v"), F.col("v")).alias("e")).filter(_get("message").isNotNull())
    advisory = _get("advisory.id")
    code = F.coalesce(_get("code.code"), F.when(~F.schema_of_variant(_get("code", "variant")).startswith("OBJECT"), _get("code")))
    rule = F.coalesce(F.when(advisory != "", advisory), code, F.lit("cargo-deny"))
    label = F.lower(F.trim(F.coalesce(_get("severity"), _get("level"))))
    severity = F.when(label == "bug", "high").otherwise(F.coalesce(S.label_severity(label), F.lit("medium")))
    return rows.select(*_signal("cargo-deny", rule, F.coalesce(_get("labels[0].span"), F.lit("")), _get("labels[0].line", "long"), _get("labels[0].column", "long"), _get("message"), severity))


def bandit_signals(docs: DataFrame) -> DataFrame:
    """One signal for each result (columns from 1), and one for each file that could not be read."""
    rule = F.coalesce(_get("test_id"), _get("test_name"), F.lit("bandit"))
    column = F.when(_get("col_offset", "long") >= 0, _get("col_offset", "long") + 1)
    severity = F.coalesce(S.label_severity(_get("issue_severity")), F.lit("medium"))
    found = _entries(docs, "$.results").select(*_signal("bandit", rule, F.coalesce(_get("filename"), F.lit("")), _get("line_number", "long"), column, F.coalesce(_get("issue_text"), rule), severity))
    reason = F.coalesce(_get("reason"), F.lit("Bandit could not analyze this file"))
    return found.unionByName(_entries(docs, "$.errors").select(*_signal("bandit", F.lit("bandit-error"), F.coalesce(_get("filename"), F.lit("")), F.lit(None), F.lit(None), reason, F.lit("medium"))))


def _as_list(value: Column) -> Column:
    """A JSON array as it is, and lines of JSON values as one."""
    lines = F.filter(F.split(value, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.when(F.ltrim(value).startswith("{"), F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))).otherwise(value)


def ruff_signals(docs: DataFrame) -> DataFrame:
    """One signal for each diagnostic of an array, or of JSON lines."""
    docs = docs.select(_as_list(F.col("value")).alias("value"))
    rule = F.coalesce(_get("code"), F.lit("ruff"))
    severity = F.coalesce(S.label_severity(_get("severity")), F.lit("medium"))
    return _entries(docs, "$").select(*_signal("ruff", rule, F.coalesce(_get("filename"), F.lit("")), _get("location.row", "long"), _get("location.column", "long"), F.coalesce(_get("message"), rule), severity))


TOOLS = {
    "pip-audit": pip_audit_signals, "cargo-clippy": clippy_signals, "govulncheck": govulncheck_signals, "gitleaks": gitleaks_signals, "golangci-lint": golangci_signals,
    "osv-scanner": osv_signals, "cargo-deny": deny_signals, "bandit": bandit_signals, "ruff": ruff_signals,
}
#: Tools that write a JSON value a line; for the others, where the list of their findings stands and whether it may be absent.
LINE_TOOLS = ("cargo-clippy", "cargo-deny", "govulncheck")
SHAPES = {
    "sarif": ("$.runs", "needed"), "gitleaks": ("$", "needed"), "golangci-lint": ("$.Issues", "optional"), "osv-scanner": ("$.results", "optional"),
    "pip-audit": ("$.dependencies", "needed"), "bandit": ("$.results", "needed"), "ruff": ("$", "needed"),
}


def sarif_result(rule: Column, severity: Column, message: Column, path: Column, line: Column, col: Column) -> Column:
    """A SARIF result of one signal, as a struct."""
    level = F.when(S.is_error(severity), "error").when(severity == "medium", "warning").otherwise("note")
    region = F.struct(F.greatest(line, F.lit(1)).alias("startLine"), F.greatest(col, F.lit(1)).alias("startColumn"))
    uri = F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    prints = F.struct(S.fingerprint(rule, path, line, col).alias("primary"))
    return F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations"), prints.alias("partialFingerprints"))


def write_results(signals: DataFrame, folder: str) -> None:
    """SARIF results as JSON lines, one file a partition."""
    signals.select(F.to_json(sarif_result(*[F.col(c) for c in ("rule_id", "severity", "message", "file_path", "line", "col")])).alias("value")).write.text(folder)


def envelope(signals: DataFrame, by: str) -> DataFrame:
    """A JSON envelope with counts and verdict for each group."""
    err = S.is_error(F.col("severity"))
    out = signals.groupBy(by).agg(F.count_if(err).alias("errors"), F.count_if(~err).alias("warnings"))
    return out.select(by, F.to_json(F.struct(F.col("errors"), F.col("warnings"), S.verdict(F.col("errors"), F.col("warnings")).alias("verdict"))).alias("json"))


def symbol_id(package: Column, path: Column, name: Column) -> Column:
    return F.concat(F.lit("sym:"), F.substring(F.sha2(F.concat_ws("\n", package, path, name), 256), 1, 16))


def edge_id(src: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("\n", src, dst), 256), 1, 16))


def write_coupling(coupling: DataFrame, folder: str) -> None:
    """All package edges (caller, callee, calls) as CSV files with headers."""
    coupling.select("caller", "callee", "calls").write.mode("overwrite").option("header", True).csv(folder)


def read_coupling(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).schema("caller string, callee string, calls long").csv(folder)
