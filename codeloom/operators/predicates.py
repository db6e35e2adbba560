"""Filters over occurrences, signals, sessions and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions import scalars as S
from codeloom.operators.text_checks import inside


def source_filter(scope: str = "all", generated: str = "include", packages: tuple = (), kinds: tuple = (), exact_file: str | None = None, prefix: str | None = None, test_globs: tuple = ()) -> Column:
    """AND of source scope, generated policy, packages, kinds, exact file and path prefix."""
    test = F.col("in_test")
    for g in test_globs:
        test = test | F.col("file_path").rlike(S.glob_pattern(g))
    wanted = {"all": [], "production": [~test], "test": [test]}[scope] + {"include": [], "exclude": [~F.col("generated")], "only": [F.col("generated")]}[generated]
    wanted += [F.col("package").isin(*packages)] * bool(packages) + [F.col("kind").isin(*kinds)] * bool(kinds)
    wanted += [F.col("file_path") == exact_file] * (exact_file is not None) + ([S.under(F.col("file_path"), prefix)] if prefix is not None else [])
    return reduce(lambda a, b: a & b, wanted, F.lit(True))


def agent_filter(signals: DataFrame, tokens: list[str], order: list[str]) -> DataFrame:
    """errors-only, warnings-only, high-impact, category:, source:, file: (plain prefix), top:N (the last wins)."""
    top = None
    for t in tokens:
        name, _, value = t.partition(":")
        simple = {"errors-only": S.is_error(F.col("severity")), "warnings-only": ~S.is_error(F.col("severity")), "high-impact": F.col("severity") == "critical"}
        if t in simple:
            signals = signals.filter(simple[t])
        elif name in ("category", "source") and value:
            signals = signals.filter(F.col(name) == value)
        elif name == "file" and value:
            signals = signals.filter(F.col("file_path").startswith(value))
        elif name == "top" and value.isdigit() and int(value) > 0:
            top = int(value)
        else:
            raise ValueError(f"unknown filter {t}")
    return signals.orderBy(*order).limit(top) if top else signals


def symbol_match(occ: DataFrame, text: str, how: str = "substring") -> DataFrame:
    name = F.col("name")
    match = {"substring": F.contains(F.lower(name), F.lit(text.lower())), "exact": name == text, "qualified": F.concat_ws(".", "file_path", name) == text}[how]
    return occ.filter(match & (F.col("kind") != "module-init"))


def spans_at(occ: DataFrame, probes: DataFrame) -> DataFrame:
    """Occurrences whose lines hold a probe (file_path, at)."""
    return inside(occ, probes, ["file_path"], "line", "end_line", "at")


def valid_edge(most_targets: int = 10_000, longest: int = 128) -> Column:
    """A call with known targets, positive line, and known resolution."""
    hash_ok = lambda h: (F.length(h) <= longest) & ~h.rlike(r"[\x00-\x1f\x7f]")
    resolutions = ("static", "import", "method", "constructor", "dynamic-string", "syntactic", "external", "unknown")
    return (F.size("to") <= most_targets) & F.forall("to", hash_ok) & (F.col("line") >= 1) & (F.col("column") >= 0) & F.col("resolution").isin(*resolutions)


def lines_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, number (from 1) and content of each line."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text), "\n")).alias("number", "content")).withColumn("number", F.col("number") + 1)


def suppressed(findings: DataFrame, directives: DataFrame, keys: list[str], skip: int = 3, check: str | None = None) -> DataFrame:
    """Findings with a flag: a file directive within the first 50 lines, or a next-line directive that means their line.

    ``keys`` name a file.  A next-line directive means the line behind it; where that is a directive itself, up to ``skip``
    such lines are passed.  With ``check`` (a column of both sides), directives count for their own check only, but those
    of other checks are passed too.
    """
    file, keys = keys, [*keys, *([check] if check else [])]
    files = directives.filter("scope = 'file' and number <= 50").select(*keys, F.lit(True).alias("by_file")).distinct()
    order = W.Window.partitionBy(*file).orderBy("number")
    lines = directives.select(*file, "number").distinct()
    passed, run = F.lit(0), F.lit(True)
    for k in range(1, skip + 1):
        run = run & F.coalesce(F.lead("number", k).over(order) == F.col("number") + k, F.lit(False))
        passed = passed + run.cast("int")
    meant = lines.withColumn("passed", passed).join(directives.filter("scope = 'next'"), [*file, "number"]).select(*keys, (F.col("number") + 1 + F.col("passed")).alias("number"), F.lit(True).alias("by_line")).distinct()
    out = findings.join(files, keys, "left").join(meant, [*keys, "number"], "left")
    return out.withColumn("suppressed", F.coalesce("by_file", F.lit(False)) | F.coalesce("by_line", F.lit(False))).drop("by_file", "by_line")


def confidence_floor(least: str, categories: tuple[str, ...] = (), confidence: str = "confidence", category: str = "category") -> Column:
    """Rows of at least that confidence and of one of the categories (none given: any); rows without these values pass."""
    ranks = {"low": 1, "medium": 2, "high": 3}
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair)), F.col(confidence))
    keep = F.coalesce(rank >= ranks[least], F.lit(True))
    return keep & F.coalesce(F.col(category).isin(*categories), F.lit(True)) if categories else keep
