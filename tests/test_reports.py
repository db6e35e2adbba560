"""Reports of other tools: their own formats, what is rejected, and secrets that stay out."""

from __future__ import annotations

import json

import pytest

from codeloom.sources import ingest


@pytest.fixture
def read(spark):
    def run(tool, *reports):
        docs = spark.createDataFrame([(r if r is None or isinstance(r, str) else json.dumps(r),) for r in reports], "value string")
        found = {tuple(r) for r in ingest.tool_signals(docs, tool).collect()}
        return found, {r.reason: r.n for r in ingest.tool_rejects(docs, tool).collect()}

    return run


def test_gitleaks(read):
    secret = "AKIAVERYSECRET"
    report = [{"RuleID": "aws", "Description": f"key {secret} token=abc123", "Secret": secret, "Match": f"x={secret}", "File": "a.env", "StartLine": 3, "StartColumn": 7}, {}, 5]
    found, rejects = read("gitleaks", report, "[]", "{}", "no json", None)
    assert found == {("gitleaks", "aws", "a.env", 3, 7, "key AKIA… token=***", "high"), ("gitleaks", "gitleaks-secret", "", None, None, "Secret detected (gitleaks-secret)", "high")}
    assert rejects == {"entry is no object": 1, "unexpected shape": 1, "malformed JSON": 1, "no report": 1}


def test_golangci(read):
    report = {"Issues": [{"FromLinter": "govet", "Text": "shadow", "Severity": "error", "Pos": {"Filename": "a.go", "Line": 4, "Column": 2}}, {}], "Report": {"Error": "boom", "Warnings": [{"Tag": "t", "Text": "careful"}]}}
    found, rejects = read("golangci-lint", report, {"Issues": None}, {}, {"Issues": 3}, "[]")
    assert found == {
        ("golangci-lint", "govet", "a.go", 4, 2, "shadow", "high"), ("golangci-lint", "golangci-lint", "", None, None, "golangci-lint", "medium"),
        ("golangci-lint", "golangci-lint-report-error", "", None, None, "boom", "high"), ("golangci-lint", "golangci-lint-report-warning", "", None, None, "careful", "medium"),
    }
    assert rejects == {"unexpected shape": 2}


def test_osv(read):
    package = {"package": {"name": "p", "version": "1"}, "groups": [{"ids": ["A"], "max_severity": "9.1"}], "vulnerabilities": [{"id": "A", "summary": "bad"}, {"id": "B", "database_specific": {"severity": "MODERATE"}}, {}]}
    found, rejects = read("osv-scanner", {"results": [{"source": {"path": "lock"}, "packages": [package]}]}, {"results": []})
    assert found == {
        ("osv-scanner", "A", "lock", None, None, "bad (p@1)", "critical"), ("osv-scanner", "B", "lock", None, None, "B (p@1)", "medium"),
        ("osv-scanner", "osv-vulnerability", "lock", None, None, "osv-vulnerability (p@1)", "medium"),
    }
    assert rejects == {}


def test_cargo_deny(read):
    lines = [{"type": "diagnostic", "fields": {"severity": "error", "message": "m", "code": "vulnerability", "advisory": {"id": "RUSTSEC-1"}, "labels": [{"span": "a 1.0", "line": 5, "column": 2}]}}, {"type": "summary", "fields": {"message": "no"}}, {"message": "bare", "code": {"code": "banned"}, "severity": "bug"}, {"type": "diagnostic", "fields": {"code": "x"}}]
    found, rejects = read("cargo-deny", "log line\n" + "\r\n".join(map(json.dumps, lines)) + "\n{broken", "")
    assert found == {("cargo-deny", "RUSTSEC-1", "a 1.0", 5, 2, "m", "high"), ("cargo-deny", "banned", "", None, None, "bare", "high")}
    assert rejects == {"malformed line": 1, "no report": 1}


def test_python_tools(read):
    found, rejects = read("bandit", {"results": [{"test_id": "B1", "issue_severity": "HIGH", "issue_text": "t", "filename": "a.py", "line_number": 2, "col_offset": 0}], "errors": [{"filename": "b.py", "reason": "syntax"}]}, {"other": 1})
    assert found == {("bandit", "B1", "a.py", 2, 1, "t", "high"), ("bandit", "bandit-error", "b.py", None, None, "syntax", "medium")} and rejects == {"unexpected shape": 1}
    found, rejects = read("ruff", [{"code": "F401", "message": "unused", "filename": "a.py", "location": {"row": 1, "column": 8}}])
    assert found == {("ruff", "F401", "a.py", 1, 8, "unused", "medium")} and rejects == {}


def test_sarif_tools(read):
    report = {"runs": [{"tool": {"driver": {"name": "cppcheck"}}, "results": [{"ruleId": "r", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.c"}, "region": {"startLine": 1}}}]}]}]}
    found, rejects = read("cppcheck", report, {"findings": []})
    assert found == {("cppcheck", "r", "a.c", 1, None, "m", "high")} and rejects == {"unexpected shape": 1}
    assert len(ingest.SARIF_TOOLS) + len(ingest.TOOLS) == 16
