"""Graph rules and text checks; each gives signal rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.scalars import glob_pattern
from codeloom.operators.clones import cross_package_groups, exact_groups
from codeloom.operators.joins import nested_spans
from codeloom.operators.text_checks import inside
from codeloom.plans.shared import saved, spread

#: The rules, in the order of their registry, and the recipes that select some of them.
GRAPH_RULES = (
    "orphan-subtree", "duplicated-function-body", "near-duplicate-function-body", "no-side-effect-path", "test-only-reachable", "always-throws-branch",
    "large-function", "wide-function", "high-blast-untested", "cycle", "unexpected-coupling",
)
RECIPES = {
    "default": GRAPH_RULES,
    "dead-code": ("orphan-subtree", "test-only-reachable"),
    "agent-risk": ("high-blast-untested", "cycle", "large-function", "wide-function"),
    "agent-final": GRAPH_RULES,
}


def run_recipe(recipe: str, rules: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """The signals of a recipe's rules, as far as ``rules`` has them; each gives rule_id, occ_id, severity, message.

    Each rule is run by itself and its signals are written to the shared folder: one that fails becomes one signal of
    high severity, and the others still count.
    """
    out = spark.createDataFrame([], "rule_id string, occ_id long, severity string, message string")
    for name in RECIPES[recipe]:
        if name not in rules:
            continue
        try:
            found = saved(rules[name]().select("rule_id", F.col("occ_id").cast("long").alias("occ_id"), "severity", "message"))
        except Exception as e:  # any failure of a rule is a finding about the rule
            found = spark.createDataFrame([(f"graph:{name}", None, "high", f"error: {type(e).__name__}")], out.schema)
        out = out.unionByName(found)
    return out


def duplicate_signals(cands: DataFrame, min_size: int = 200, packages: int = 3, min_anchor: int = 80) -> DataFrame:
    """One signal for each body that many packages share, and one for each copy but the first of all other groups.

    cands: site (unique), occ_id, body_hash, package, size.
    """
    rule = F.lit("graph:duplicated-function-body").alias("rule_id")
    rows = cands.dropDuplicates(["site"])
    wide = cross_package_groups(rows, packages=packages, min_anchor=min_anchor)
    first = rows.select("body_hash", F.col("site").alias("anchor"), "occ_id")
    shared = wide.join(spread(first), ["body_hash", "anchor"]).select(rule, "occ_id", F.lit("low").alias("severity"), F.concat_ws(" ", F.lit("shared by"), F.size("packages").cast("string"), F.lit("packages:"), F.array_join("packages", ", ")).alias("message"))
    rest = exact_groups(rows, min_size=min_size).join(spread(wide), "body_hash", "left_anti").select("body_hash", "anchor")
    large = rows.filter(F.coalesce(F.col("size") >= min_size, F.lit(True)))
    copies = large.join(spread(rest), "body_hash").filter("site <> anchor").select(rule, "occ_id", F.lit("low").alias("severity"), F.concat_ws(" ", F.lit("same body as"), "anchor").alias("message"))
    return shared.unionByName(copies)


def near_duplicate_signals(clusters: DataFrame) -> DataFrame:
    """One signal for each cluster (anchor, size, similarity) of near copies."""
    text = F.concat_ws(" ", F.col("size").cast("string"), F.lit("near copies, similarity"), F.format_number("similarity", 2))
    return clusters.select(F.lit("graph:near-duplicate-function-body").alias("rule_id"), F.col("anchor").alias("occ_id"), F.lit("low").alias("severity"), text.alias("message"))


@dataclass(frozen=True)
class Selector:
    """Which checks to run: all, explicit names, globs, or tags."""

    kind: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


#: Selections of the named check recipes that need no list of checks.
CHECK_RECIPES = {
    "default": Selector("all"),
    "pre-release": Selector("all"),
    "nightly-full": Selector("all"),
    "ci": Selector("all", (), ("testing/flaky-*", "performance/*")),
    "agent-risk": Selector("pattern", ("architecture/*", "security/*")),
    "agent-final": Selector("all"),
}


def resolve_checks(checks: DataFrame, selector: Selector, disabled: tuple[str, ...] = (), include_disabled: tuple[str, ...] = ()) -> DataFrame:
    """Checks (slug, tags, disabled) that a selector takes and that are not disabled, or are forced.

    Slugs may carry a namespace (``pack:slug``).  A bare name means the one check that ends in it, none if several do;
    globs see the slug, the bare slug, and the bare slug behind each tag (``tag/slug``).
    """
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    rows = checks.withColumn("bare", F.element_at(F.split("slug", ":"), -1))
    keys = F.concat(F.array("slug", "bare"), F.transform(tags, lambda t: F.concat_ws("/", t, "bare")))

    def any_glob(globs: tuple[str, ...]) -> Column:
        return F.exists(keys, lambda k: k.rlike("|".join(map(glob_pattern, globs)))) if globs else F.lit(False)

    def tagged(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(tags, F.array(*map(F.lit, names))) if names else F.lit(False)

    def named(names: tuple[str, ...]) -> Column:
        return F.col("slug").isin(*names) | F.col("bare").isin(*names)

    if selector.kind == "explicit":
        same = rows.groupBy("bare").agg(F.count(F.lit(1)).alias("same"))
        rows = rows.join(same, "bare").filter(F.col("slug").isin(*selector.include) | (F.col("bare").isin(*selector.include) & (F.col("same") == 1))).drop("same")
    elif selector.kind == "pattern":
        rows = rows.filter(any_glob(selector.include) & ~any_glob(selector.exclude))
    elif selector.kind == "tags":
        rows = rows.filter(tagged(selector.include) & ~tagged(selector.exclude))
    elif selector.kind == "all":
        rows = rows.filter(~any_glob(selector.exclude))
    else:
        raise ValueError(f"unknown selector {selector.kind}")
    off = F.coalesce(F.col("disabled"), F.lit(False)) | named(disabled)
    return rows.filter(~off | named(include_disabled)).drop("bare")


def rule_signals(rows: DataFrame, rule: str, severity: Column, message: Column) -> DataFrame:
    return rows.filter(severity.isNotNull()).select(F.lit(f"graph:{rule}").alias("rule_id"), "occ_id", severity.alias("severity"), message.alias("message"))


def large_function(occ: DataFrame, medium: int = 300, high: int = 500) -> DataFrame:
    lines = F.col("end_line") - F.col("line") + 1
    severity = F.when((F.col("kind") == "module-init") | F.col("in_test"), None).when(lines > high, "high").when(lines > medium, "medium")
    return rule_signals(occ, "large-function", severity, F.concat(lines.cast("string"), F.lit(" lines")))


def wide_function(occ: DataFrame, medium: int = 5, high: int = 7) -> DataFrame:
    n = F.col("params")
    return rule_signals(occ, "wide-function", F.when(F.col("in_test"), None).when(n > high, "high").when(n > medium, "medium"), F.concat(n.cast("string"), F.lit(" parameters")))


def orphans(occ: DataFrame, reached: DataFrame, exported: bool = False, tests: bool = False) -> DataFrame:
    rows = occ.join(spread(reached.select(F.col("node").alias("occ_id"))), "occ_id", "left_anti").filter("kind <> 'module-init'")
    rows = rows if exported else rows.filter("not exported")
    return rule_signals(rows if tests else rows.filter("not in_test"), "orphan-subtree", F.lit("medium"), F.lit("not reachable"))


def entry_points(occ: DataFrame, edges: DataFrame) -> DataFrame:
    """module-init, conventional names, and exported without a caller other than itself."""
    names = ("main", "run", "start", "register", "initialize", "init", "bootstrap")
    called = edges.filter("src <> dst").select(F.col("dst").alias("occ_id")).distinct().withColumn("called", F.lit(True))
    rows = occ.join(spread(called), "occ_id", "left")
    return rows.filter((F.col("kind") == "module-init") | F.col("name").isin(*names) | (F.col("exported") & F.col("called").isNull())).select(F.col("occ_id").alias("node"))


def test_only(occ: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Not reached from production entries, with callers, all of which lie in test files."""
    callers = edges.join(spread(occ.select(F.col("occ_id").alias("src"), "in_test")), "src").groupBy(F.col("dst").alias("occ_id")).agg(F.bool_and("in_test").alias("only_tests"))
    rows = occ.filter("not exported and not in_test and not generated and kind <> 'module-init'").join(spread(reached.select(F.col("node").alias("occ_id"))), "occ_id", "left_anti")
    return rule_signals(rows.join(spread(callers.filter("only_tests")), "occ_id", "left_semi"), "test-only-reachable", F.lit("low"), F.lit("only tests reach it"))


def high_blast(occ: DataFrame, scores: DataFrame, test_reachable: DataFrame, medium: float = 75, high: float = 150) -> DataFrame:
    rows = occ.filter("not in_test").join(spread(scores.withColumnRenamed("node", "occ_id")), "occ_id").join(spread(test_reachable.select(F.col("node").alias("occ_id"))), "occ_id", "left_anti")
    return rule_signals(rows, "high-blast-untested", F.when(F.col("score") >= high, "high").when(F.col("score") >= medium, "medium"), F.concat(F.lit("blast "), F.col("score").cast("string")))


def cycles(components: DataFrame, occ: DataFrame, pairs: bool = False) -> DataFrame:
    """One row for each component of more than one node: size, anchor, whether it crosses packages, severity."""
    rows = components.join(spread(occ.select(F.col("occ_id").alias("node"), "package", "in_test")), "node")
    out = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("anchor"), (F.countDistinct("package") > 1).alias("crosses"), F.bool_and("in_test").alias("tests"))
    severity = F.when(F.col("tests"), None).when(F.col("crosses"), "high").when(F.col("size") >= 3, "medium").when(F.lit(pairs), "low")
    return out.filter("size > 1").withColumn("severity", severity).filter("severity is not null").drop("tests")


def pure_functions(occ: DataFrame, edges: DataFrame, impure: DataFrame) -> DataFrame:
    """Nodes that reach no side-effecting node: one reverse search from the impure ones."""
    from codeloom.operators.graph import reachable

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return occ.join(spread(reachable(back, impure).select(F.col("node").alias("occ_id"))), "occ_id", "left_anti")


#: Texts of calls that have an effect, by kind, and return types that carry no value.
EFFECTS = (
    r"\b(?:console|logger|log|fs\.|http\.|fetch|process\.exit|throw\s+new)\b",
    r"\.(?:push|pop|shift|unshift|splice|fill|sort|reverse|copyWithin|set|add|delete|clear|append|write|emit)\s*\(",
    r"\b(?:record|report|track|emit|instrument|audit)[A-Z][A-Za-z0-9]*\s*\(",
    r"\bwith[A-Za-z0-9]*[Ss]pan\s*\(",
    r"\b(?:logger|log|metric|metrics|tracer|trace|span)\b",
)
NO_VALUE = ("void", "undefined", "never", "promise<void>", "()", "none")


def no_side_effect_path(occ: DataFrame, calls: DataFrame, effects: tuple[str, ...] = EFFECTS, min_calls: int = 2, min_span: int = 10) -> DataFrame:
    """Exported functions without an effect on any path whose value every caller throws away.

    occ: occ_id, kind, in_test, exported, line, end_line, return_type (null: unknown); calls: src, dst (null: not
    resolved), text, discarded (null: unknown).  One caller that uses the value clears a function; if nothing is known of
    any caller, the value counts as thrown away.
    """
    effect = F.lit(False)
    for pattern in effects:
        effect = effect | F.col("text").rlike(pattern)
    impure = calls.filter(effect).select(F.col("src").alias("node")).distinct()
    own = calls.groupBy(F.col("src").alias("occ_id")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("dst").isNotNull()).alias("resolved")).filter((F.col("n") >= min_calls) & F.col("resolved"))
    told = calls.filter("dst is not null").groupBy(F.col("dst").alias("occ_id")).agg(F.count_if("discarded").alias("dropped"), F.count("discarded").alias("known"))
    dead = told.filter("known = dropped")
    value = ~F.coalesce(F.lower(F.trim("return_type")).isin(*NO_VALUE), F.lit(False))
    rows = occ.filter((F.col("kind") != "module-init") & ~F.col("in_test") & F.col("exported") & (F.col("end_line") - F.col("line") + 1 >= min_span) & value)
    rows = rows.join(spread(own), "occ_id", "left_semi").join(spread(dead), "occ_id", "left_semi")
    edges = calls.filter("dst is not null").select("src", "dst").distinct()
    return rule_signals(pure_functions(rows, edges, impure), "no-side-effect-path", F.lit("low"), F.lit("its value is thrown away"))


def unexpected_coupling(mutual: DataFrame, components: DataFrame, occ: DataFrame) -> DataFrame:
    """Package pairs that call each other (a, b, there, back) with the number of cycles that span both."""
    inside = components.join(occ.select(F.col("occ_id").alias("node"), "package"), "node").select("component", "package").distinct()
    a, b = (inside.select("component", F.col("package").alias(n)) for n in "ab")
    spans = mutual.select("a", "b").join(a, "a").join(b, ["component", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("cycles"))
    return mutual.join(spans, ["a", "b"], "left").withColumn("cycles", F.coalesce("cycles", F.lit(0))).withColumn("severity", F.lit("high"))


def always_throws(calls: DataFrame, pattern: str = r"^throw\b|^raise\b|\bthrow[A-Z]\w*\(") -> DataFrame:
    """Owners all of whose calls (owner, text) match the pattern."""
    return calls.groupBy("owner").agg(F.bool_and(F.col("text").rlike(pattern)).alias("all_throw"), F.count(F.lit(1)).alias("edges")).filter("all_throw").drop("all_throw")


#: Fixed value: the text of a call that throws.
THROWS = r"^\s*throw\s+(?:new\s+)?[A-Z]\w*"


def always_throws_signals(occ: DataFrame, calls: DataFrame, created: DataFrame, pattern: str = THROWS) -> DataFrame:
    """A signal for each occurrence whose own control flow only throws.

    ``calls``: owner, text, line; ``created``: body_hash of callables that some scope only creates.  Module initialisers,
    test files and created callables are left out, and so are calls on the lines of a function nested in the owner.
    """
    own = occ.filter("kind <> 'module-init' and not in_test").join(created.select("body_hash").distinct(), "body_hash", "left_anti")
    sites = calls.select("owner", "text", F.col("line").alias("at")).join(own, F.col("owner") == F.col("occ_id"))
    lines = occ.select(F.col("occ_id").alias("inner"), F.col("line").alias("inner_line"), F.col("end_line").alias("inner_end"))
    nested = nested_spans(occ).join(lines, "inner").select(F.col("outer").alias("occ_id"), "inner_line", "inner_end")
    within = inside(nested, sites.select("occ_id", "at").distinct(), ["occ_id"], "inner_line", "inner_end", "at").select("occ_id", "at").distinct()
    left = sites.join(within, ["occ_id", "at"], "left_anti")
    found = left.groupBy("occ_id", "name", "file_path", "line").agg(F.bool_and(F.col("text").rlike(pattern)).alias("throws"), F.count(F.lit(1)).alias("edge_count")).filter("throws")
    fixed = [F.lit("graph:always-throws-branch").alias("rule_id"), F.lit("low").alias("severity"), F.lit("quality").alias("category")]
    return found.select(*fixed, "occ_id", "file_path", "line", F.concat("name", F.lit(" appears to always throw.")).alias("message"), "edge_count")


@dataclass(frozen=True)
class LineRule:
    slug: str
    pattern: str
    severity: str


#: Regex-shaped checks.
LINE_RULES = (
    LineRule("no-todo-comments", r"\b(TODO|FIXME|XXX|OPTIMIZE)\b", "warning"),
    LineRule("no-eval", r"\beval\(", "error"),
    LineRule("no-console-log", r"\bconsole\.log\(", "warning"),
    LineRule("no-any-types", r":\s*any\b", "warning"),
    LineRule("no-skipped-tests", r"\b(it|test|describe)\.skip\(", "warning"),
    LineRule("no-deprecated-tags", r"@deprecated\b", "warning"),
    LineRule("sql-injection", r"(?i)select .* from .*\+ *[a-z]", "error"),
    LineRule("python-no-bare-except", r"^\s*except\s*:", "error"),
    LineRule("go-no-fmt-print", r"\bfmt\.Print(ln|f)?\(", "warning"),
    LineRule("java-no-print-stack-trace", r"\.printStackTrace\(", "warning"),
    LineRule("rust-no-dbg-macro", r"\bdbg!\(", "warning"),
    LineRule("pii-exposure-in-logs", r"(?i)log.*(password|ssn|email)", "error"),
    LineRule("license-line", r"Released under the \w+ License", "warning"),
    LineRule("shouting", r"[A-Z]{4,}!!", "warning"),
)


def line_checks(lines: DataFrame, rules: tuple[LineRule, ...] = LINE_RULES) -> DataFrame:
    """Matches of each rule in each line (id, number, content): 1-based column of the first match and the number."""
    hits = F.filter(F.array(*[F.struct(F.lit(r.slug).alias("slug"), F.lit(r.severity).alias("severity"), F.regexp_instr("content", F.lit(r.pattern)).alias("col"), F.regexp_count("content", F.lit(r.pattern)).alias("matches")) for r in rules]), lambda h: h["matches"] > 0)
    return lines.select("id", "number", F.explode(hits).alias("h")).select("id", "number", "h.*")


def file_length(docs: DataFrame, id_col: str, text: str, warn: int = 400, error: int = 800) -> DataFrame:
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return docs.select(F.col(id_col).alias("id"), n.cast("long").alias("lines"), F.when(n > error, "error").when(n > warn, "warning").otherwise("ok").alias("status"))


def fan_out(imports: DataFrame, warn: int = 15, error: int = 30) -> DataFrame:
    out = imports.groupBy("importer").agg(F.countDistinct("target").alias("n"))
    return out.withColumn("status", F.when(F.col("n") > error, "error").when(F.col("n") > warn, "warning").otherwise("ok"))
