"""Checks over source texts: lists of patterns with the place of every match, imports read from texts, and a check over all files.

Places count characters (code points), from 1.  Texts are scanned with column expressions only: a match is marked where it
stands, the marked text is cut at the marks, and the lengths of the parts give the places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions import scalars as S
from codeloom.plans.shared import saved, spread

#: Characters that stand for no text; where a text holds one, it counts as an unknown character.
_BEGIN, _END, _UNKNOWN = "\ufdd0", "\ufdd1", "\ufffd"
BLANKS = r"(?U)^[\s\ufeff]+|[\s\ufeff]+$"


@dataclass(frozen=True)
class Pattern:
    """A pattern of a check; with ``every`` all matches of a line count, else the first."""

    slug: str
    pattern: str
    severity: str = "warning"
    message: str = ""
    every: bool = True


@dataclass(frozen=True)
class PatternCheck:
    """Patterns that are tried in order on each line of a text.

    ``filter``: raw; strip (no string contents and line comments; columns are those of what is left) or blank (contents
    and comments are spaces, so columns are those of the text).  Comment lines are passed over unless ``comments``;
    ``tests`` says whether test files are read; with ``one_per_line``, only the first match of the first pattern counts.
    """

    slug: str
    patterns: tuple[Pattern, ...]
    filter: str = "raw"
    comments: bool = False
    tests: bool = True
    one_per_line: bool = False


def comment_line(line: Column) -> Column:
    """A line that is a comment by itself: // or /*, or the * of a block's next line."""
    text = F.regexp_replace(line, BLANKS, "")
    return text.startswith("//") | text.startswith("/*") | text.rlike(r"^\*(?:$|[ /*])")


def test_file(path: Column) -> Column:
    """Files of tests by their names; declaration files are none."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    test = path.rlike(r"__tests__/") | path.rlike(r"\.(?:test|spec)\.(?:tsx?|jsx?|mts|cts)$")
    return test & ~path.rlike(r"\.d\.[cm]?ts$")


def _ascii_bounds(pattern: str) -> str:
    """The pattern with word bounds that see ASCII letters only, as ``\\w`` does, on every Java version."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\b", r"\1(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))", pattern)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern in a text, in order: array of (column from 1, match)."""
    pattern = _ascii_bounds(pattern)
    clean = F.translate(text, _BEGIN + _END, _UNKNOWN * 2)
    parts = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{_BEGIN}$0{_END}")), _BEGIN)
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, part: Column) -> Column:
        n = F.length(part) - F.when(part.contains(_END), 1).otherwise(0)
        return F.struct((s["next"] + n).alias("next"), F.array_append(s["at"], s["next"]).alias("at"))

    at = F.aggregate(parts, start, step)["at"]
    found = F.zip_with(at, parts, lambda a, p: F.struct(a.alias("column"), F.substring_index(p, _END, 1).alias("match")))
    return F.when(clean.rlike(pattern), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(F.slice(found, 1, 0))


def regex_list_check(files: DataFrame, check: PatternCheck, id_col: str, path_col: str | None = None, text_col: str = "text") -> DataFrame:
    """One row for each match: id, line, column, check, type (of the pattern), severity, message, match.

    A null text has no lines, an empty one has one without matches.
    """
    if check.filter not in ("raw", "strip", "blank"):
        raise ValueError(f"unknown filter {check.filter}")
    if not check.patterns:
        raise ValueError(f"check {check.slug} has no pattern")
    rows = files if check.tests or path_col is None else files.filter(~F.coalesce(test_file(F.col(path_col)), F.lit(False)))
    text = {"raw": lambda t: t, "strip": S.strip_literals, "blank": S.blank_literals}[check.filter](F.col(text_col))
    lines = rows.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("number", "content"))
    lines = lines if check.comments else lines.filter(~comment_line(F.col("content")))

    def hits(p: Pattern) -> Column:
        found = matches(F.col("content"), p.pattern)
        found = found if p.every and not check.one_per_line else F.slice(found, 1, 1)
        named = [F.lit(x).alias(n) for n, x in (("type", p.slug), ("severity", p.severity), ("message", p.message))]
        return F.transform(found, lambda m: F.struct(m["column"].alias("column"), *named, m["match"].alias("match")))

    every = F.concat(*map(hits, check.patterns))
    every = F.slice(every, 1, 1) if check.one_per_line else every
    lines = lines.filter(reduce(Column.__or__, (F.col("content").rlike(_ascii_bounds(p.pattern)) for p in check.patterns)))
    out = lines.select("id", (F.col("number") + 1).alias("line"), F.explode(every).alias("h"))
    return out.select("id", "line", F.lit(check.slug).alias("check"), "h.*")


_STRING = "|".join(S.STRINGS.values())
#: A clause that names a module by a string.
_CLAUSE = rf"""(?:import|export)(?:[\p{{L}}\w$\s{{}},*]*?[\s}},*]from)?\s*(?:{_STRING})|(?:import|require)\s*\(\s*(?:{_STRING})"""
_NAME = r"""(['"`])([^'"`]*)\1$"""


def without_comments(text: Column) -> Column:
    """The text with its strings, and with the line ends of its comments only."""
    pieces = F.regexp_extract_all(text, F.lit(f"{_STRING}|{S.LINE_COMMENT}|{S.BLOCK_COMMENT}|[^'\"`/]++|(?s:.)"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.substring(p, 1, 2).isin("//", "/*"), F.concat(F.lit(" "), F.regexp_replace(p, r"[^\n]", ""))).otherwise(p)), "")


def imports(files: DataFrame, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """file_path, specifier, form (static, dynamic or require), line: modules that each text imports, one row for each place.

    Imports in strings and comments are none, and names that are put together at run time are unknown.  Regular
    expressions with quotes in them can be mistaken for strings.  A text is reduced to its clauses and line ends in one
    pass, so work grows with its length.
    """
    code = without_comments(F.translate(F.col(text_col), _BEGIN + _END, _UNKNOWN * 2))
    words = rf"{_CLAUSE}|{_STRING}|[\p{{L}}\w$.]++|[^\p{{L}}\w$.'\"`]++|(?s:.)"
    clause = lambda p: p.rlike(rf"^(?:{_CLAUSE})$")
    pieces = F.transform(F.regexp_extract_all(code, F.lit(words), F.lit(0)), lambda p: F.when(clause(p), F.concat(F.lit(_BEGIN), p, F.lit(_END))).otherwise(F.regexp_replace(p, r"[^\n]", "")))
    rows = files.filter(F.col(text_col).rlike("import|export|require")).select(F.monotonically_increasing_id().alias("row"), F.col(path_col).alias("file_path"), F.array_join(pieces, "").alias("left"))
    ends = lambda c: F.length(F.regexp_replace(c, r"[^\n]", ""))
    parts = rows.select("row", "file_path", F.posexplode(F.split("left", _BEGIN)).alias("place", "part"))
    before = F.sum(ends(F.col("part"))).over(W.Window.partitionBy("row").orderBy("place").rowsBetween(W.Window.unboundedPreceding, -1))
    found = parts.withColumn("before", before).filter("place > 0").withColumn("clause", F.substring_index("part", _END, 1))
    name = F.regexp_extract("clause", _NAME, 2)
    form = F.when(F.col("clause").startswith("require"), "require").when(F.col("clause").rlike(r"^import\s*\("), "dynamic").otherwise("static")
    # A clause begins with the last keyword before its name.
    lead = F.when(F.col("clause").rlike(r"^(?:import|require)\s*\("), "").otherwise(F.regexp_replace("clause", _NAME, ""))
    ahead = F.regexp_extract(lead, r"(?s)^.*(?<![\w$])(?=(?:import|export)(?![\w$]))", 0)
    found = found.select("file_path", name.alias("specifier"), form.alias("form"), (F.col("before") + ends(ahead) + 1).cast("int").alias("line"), F.col("clause").endswith("`").alias("template"))
    # A template is a name only where nothing is put in, and never in a static import.
    return found.filter("specifier <> '' and not (template and (form = 'static' or instr(specifier, '${') > 0))").drop("template")


def resolve_specifiers(found: DataFrame, known: DataFrame) -> DataFrame:
    """Relative imports (file_path, specifier) with the first known file (``known``: file_path) they can mean: target, or null.

    Candidates in order: the path itself; .ts or .tsx for .js, .tsx for .jsx; and for a name without extension the
    usual ones, as a file and as an index file.  They follow from the path that is meant, so each path is tried once,
    whatever the number of its importers.  Other imports stand under their own file in the join, not all under null; the
    imports, many and much alike (64 MB of a shuffle hold millions), are streamed past a hash table and not sorted.
    """
    path = S.normalize_path(F.concat_ws("/", S.parent_dir(F.col("file_path")), F.col("specifier")))
    rows = found.withColumn("__base", F.when(F.col("file_path").isNotNull() & F.col("specifier").startswith("."), path))
    ends = [(".js", ".ts"), (".js", ".tsx"), (".jsx", ".tsx")]
    more = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    bare = ~F.col("base").rlike(r"[^/.][^/]*\.[^/]*$")
    forms = [F.col("base"), *(F.when(F.col("base").endswith(a), F.concat(F.expr(f"left(base, length(base) - {len(a)})"), F.lit(b))) for a, b in ends), *(F.when(bare, F.concat("base", F.lit(e))) for e in more)]
    tried = rows.select(F.col("__base").alias("base")).filter("base is not null").distinct().select("base", F.posexplode(F.array(*forms)).alias("rank", "path")).filter("path is not null")
    hit = tried.join(known.select(F.col("file_path").alias("path")).distinct(), "path").groupBy("base").agg(F.min_by("path", "rank").alias("target"))
    hit = hit.select(F.col("base").alias("__key"), F.lit(True).alias("__relative"), "target")
    keyed = rows.withColumn("__key", F.coalesce("__base", "file_path")).withColumn("__relative", F.col("__base").isNotNull())
    return keyed.join(hit.hint("shuffle_hash"), ["__key", "__relative"], "left").select("file_path", "specifier", *(c for c in found.columns if c not in ("file_path", "specifier")), "target")


def import_edges(files: DataFrame, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """importer, target: files that static imports of a file reach inside the project."""
    found = imports(files, path_col, text_col).filter("form = 'static'")
    known = files.select(F.col(path_col).alias("file_path"))
    return resolve_specifiers(found, known).filter("target is not null").select(F.col("file_path").alias("importer"), "target").distinct()


def imported_packages(found: DataFrame, packages: DataFrame) -> DataFrame:
    """file_path, package: what each file imports (``found``: file_path, specifier, target), by the first that is known:

    the package of the resolved file (``packages``: file_path, package), or the package that a bare specifier names, be it
    one of ``packages`` or not.
    """
    return _import_packages(found, packages).filter("package is not null").distinct()


def _import_packages(found: DataFrame, packages: DataFrame) -> DataFrame:
    """file_path, package or null: one row for each import.

    Imports without a target stand under their own file in the join: under null, all of them would go to one task.
    """
    of_file = packages.select(F.col("file_path").alias("key"), F.col("package").alias("of_target"), F.lit(True).alias("resolved"))
    bare = F.when(~F.col("specifier").rlike(r"^[./]"), S.package_of_specifier(F.col("specifier")))
    keyed = found.select("file_path", bare.alias("name"), F.coalesce("target", "file_path").alias("key"), F.col("target").isNotNull().alias("resolved"))
    rows = keyed.join(of_file.hint("shuffle_hash"), ["key", "resolved"], "left")
    return rows.select("file_path", F.coalesce("of_target", "name").alias("package"))


#: Modules that a JavaScript runtime has itself; the second ones only with the prefix node:.
RUNTIME_MODULES = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain",
    "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline",
    "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)
PREFIXED_MODULES = ("sea", "sqlite", "test", "test/reporters")


def package_name(specifier: Column) -> Column:
    """Package that an import needs: null for paths, for the runtime's own modules, and for a scope without a name."""
    plain = F.regexp_replace(specifier, "^node:", "")
    root = F.element_at(F.split(plain, "/"), 1)
    own = plain.isin(*RUNTIME_MODULES) | root.isin(*RUNTIME_MODULES) | (specifier.startswith("node:") & (plain.isin(*PREFIXED_MODULES) | root.isin(*PREFIXED_MODULES)))
    return F.when(specifier.rlike(r"^[./]") | own | specifier.rlike("^@[^/]*$"), None).otherwise(S.package_of_specifier(specifier))


def phantom_dependencies(files: DataFrame, manifests: DataFrame, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """file_path, line, package, reason: imports that the nearest manifest doesn't declare, one row for each place.

    manifests: directory, name (of the package itself), section (dependencies, peerDependencies, optionalDependencies or
    devDependencies), dependency; one row for each declared name, or one with a null section.  Files below no manifest
    are passed over, and so is the package's own name.  devDependencies count for test files and for tools' configurations
    only: elsewhere the reason is "dev only", not "undeclared".
    """
    found = saved(imports(files, path_col, text_col).withColumn("package", package_name(F.col("specifier"))).filter("package is not null"))
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    places = found.select("file_path").distinct().select("file_path", F.explode(above).alias("directory"))
    homes = manifests.groupBy("directory").agg(F.max("name").alias("name"))
    nearest = places.join(homes, "directory").groupBy("file_path").agg(F.max_by(F.struct("directory", "name"), F.length("directory")).alias("home")).select("file_path", "home.*")
    declared = manifests.filter("dependency is not null").groupBy("directory", F.col("dependency").alias("package")).agg(F.bool_or(F.col("section") != "devDependencies").alias("shipped"))
    rows = found.join(nearest, "file_path").filter(~F.col("package").eqNullSafe(F.col("name"))).join(declared, ["directory", "package"], "left")
    dev = test_file(F.col("file_path")) | F.col("file_path").rlike(r"(?:^|/)[^/]+\.config\.(?:ts|tsx|js|jsx|mts|cts|mjs|cjs)$")
    reason = F.when(F.col("shipped").isNull(), "undeclared").when(~F.col("shipped") & ~dev, "dev only")
    return rows.select("file_path", "line", "package", reason.alias("reason")).filter("reason is not null")


def levels_above(lo: Column, hi: Column, levels: int = 31) -> Column:
    """A range of whole numbers >= 0 as the few aligned blocks (level, block) that make it up, two a level at most."""
    size = lambda k: F.pow(F.lit(2.0), k)
    low, high = (lambda k: F.ceil(lo / size(k)).cast("long")), (lambda k: F.floor((hi + 1) / size(k)).cast("long"))
    ends = lambda k: F.array(F.when(low(k) % 2 == 1, low(k)), F.when(high(k) % 2 == 1, high(k) - 1))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.when(low(k) < high(k), F.transform(F.array_compact(ends(k)), lambda b: F.struct(k.alias("level"), b.alias("block")))))
    return F.flatten(F.array_compact(blocks))


def inside(spans: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, at: str) -> DataFrame:
    """Joins spans with the points that lie in them (``keys`` equal, lo <= at <= hi), without comparing all of a key.

    A span is cut into aligned blocks, a point lies in one block of each level: equal blocks meet in a plain join, so work
    grows with spans and points (times some tens) and with what is found.  Both sides' other columns must differ.
    """
    cut = spans.filter(F.col(lo) <= F.col(hi)).withColumn("b", F.explode(levels_above(F.greatest(F.col(lo).cast("long"), F.lit(0)), F.col(hi).cast("long"))))
    most = spans.agg(F.max(F.col(hi).cast("long") - F.col(lo).cast("long")).alias("longest")).select(F.coalesce(F.ceil(F.log2(F.greatest("longest", F.lit(0)) + 2)), F.lit(0)).cast("int")).scalar()
    levels = points.filter(F.col(at) >= 0).withColumn("most", most).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("most")))).drop("most")
    levels = levels.withColumn("block", F.expr(f"shiftright(cast(`{at}` as long), level)"))
    return cut.select("*", "b.level", "b.block").drop("b").join(spread(levels), [*keys, "level", "block"]).drop("level", "block")
