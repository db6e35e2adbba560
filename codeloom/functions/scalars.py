"""Scalar functions as column expressions."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.shared import ship

#: Order of severities, and native labels by severity.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
LABELS = {"critical": ("critical", "blocker"), "high": ("high", "error", "major"), "medium": ("medium", "moderate", "warning"), "low": ("low", "info", "note", "minor")}
SARIF_LEVELS = {"error": "high", "warning": "medium", "note": "low"}


def package_of_specifier(s: Column) -> Column:
    """Package name of an import: two parts for a scoped one, else the first."""
    parts = F.split(s, "/")
    return F.when(s.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))


def package_of_path(path: Column) -> Column:
    found = F.regexp_extract(path, "^packages/([^/]+)/", 1)
    return F.when(found != "", found).otherwise("<unknown>")


def parent_dir(path: Column) -> Column:
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def normalize_path(path: Column) -> Column:
    """Resolve . and .. segments of a relative path."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when((part == "") | (part == "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.filter(F.split(path, "/"), lambda p: F.lit(True)), F.array().cast("array<string>"), step), "/")


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(tsx|ts|jsx|js|mjs|cjs|mts|cts)$", "")


def slug(s: Column, longest: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)


def fnv1a(s: Column) -> Column:
    """FNV-1a over code points, 32 bits, as eight hex digits."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        low = (x % 65536) * 16777619
        high = F.floor(x / 65536) * 16777619 % 65536 * 65536
        return (low + high) % 4294967296
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step)), 8, "0"))


def fingerprint(rule: Column, path: Column, line: Column, col: Column) -> Column:
    return F.concat_ws("|", rule, path, F.coalesce(line, F.lit(0)).cast("string"), F.coalesce(col, F.lit(0)).cast("string"))


def content_fingerprint(path: Column, rule: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws("\n", path, rule, message), 256)


def cvss_severity(score: Column) -> Column:
    s = score.try_cast("double")
    return F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").otherwise("low")


def level_severity(level: Column) -> Column:
    out = F.lit("medium")
    for k, v in SARIF_LEVELS.items():
        out = F.when(F.lower(level) == k, v).otherwise(out)
    return F.when(level.isNull(), F.lit("medium")).otherwise(out)


def label_severity(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, names in LABELS.items():
        out = F.when(F.lower(label).isin(*names), k).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for k, v in SEVERITY_RANK.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def is_error(severity: Column) -> Column:
    return severity.isin("critical", "high")


def verdict(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "fail").when(warnings > 0, "warn").otherwise("pass")


def baseline_state(raw: Column) -> Column:
    return F.when(raw == "new", "added").when(raw == "existing", "unchanged").otherwise(raw)


def coordinate(c: Column) -> Column:
    return F.when(c >= 1, c)


def safe_path(path: Column) -> Column:
    return (F.length(path) > 0) & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.rlike(r"[\x00-\x1f\\]")


def under(path: Column, prefix: str) -> Column:
    """Equal to the prefix or below it."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def file_roles(path: Column) -> Column:
    tokens = F.split(F.lower(path), r"[/._-]")
    has = lambda *names: F.arrays_overlap(tokens, F.array(*map(F.lit, names)))
    return F.filter(F.array(F.when(has("test", "tests", "spec", "fixtures"), "test"), F.when(has("generated", "gen"), "generated"), F.when(has("docs", "md"), "docs"), F.when(has("json", "yml", "yaml", "toml"), "config"), F.when(has("ts", "js", "py", "go", "rs", "java"), "source")), lambda r: r.isNotNull())


def glob_pattern(glob: str, dot: bool = True) -> str:
    """Regular expression of a path glob (**, *, ?, {a,b}); without ``dot``, wildcards match no name that begins with a dot."""
    return f"^{_glob(glob, dot, True)}$"


def _glob(glob: str, dot: bool, start: bool) -> str:
    """``start``: the glob begins a name."""
    out, i = "", 0
    while i < len(glob):
        c, shown = glob[i], "" if dot or not start else r"(?!\.)"
        if glob.startswith("**/", i):
            out, i = out + ("(?:.*/)?" if dot else r"(?:(?!\.)[^/]+/)*"), i + 3
        elif glob.startswith("**", i):
            out, i, start = out + (".*" if dot else shown + r"(?:[^/]|/(?!\.))*"), i + 2, False
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out, i, start = out + "(?:" + "|".join(_glob(x, dot, start) for x in glob[i + 1 : end].split(",")) + ")", end + 1, False
        else:
            out += {"*": shown + "[^/]*", "?": shown + "[^/]"}.get(c, "\\" + c if c in r".+()[]^$|\{}" else c)
            i, start = i + 1, c == "/"
    return out


#: String literals by their quote (possessive, so that long ones need no stack), and comments.
STRINGS = {"'": r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", '"': r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "`": r"(?s:`[^`\\]*+(?:\\.[^`\\]*+)*+`)"}
LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*", r"(?s:/\*.*?\*/)"


def strip_literals(text: Column) -> Column:
    """Code with empty strings and without line comments; strings go first, so that // in one is no comment."""
    for quote, pattern in STRINGS.items():
        text = F.regexp_replace(text, pattern, quote * 2)
    return F.regexp_replace(text, LINE_COMMENT, "")


def blank_literals(text: Column) -> Column:
    """Code of the same length and lines, with spaces for what strings hold and for comments."""
    kinds = [*STRINGS.values(), LINE_COMMENT, BLOCK_COMMENT, r"[^'\"`/]++", "(?s:.)"]
    pieces = F.regexp_extract_all(text, F.lit("|".join(kinds)), F.lit(0))

    def blank(x: Column) -> Column:
        string = (F.length(x) > 1) & F.substring(x, 1, 1).isin(*STRINGS)
        inside = F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"[^\n]", " ")
        comment = F.substring(x, 1, 2).isin("//", "/*")
        return F.when(string, F.concat(F.substring(x, 1, 1), inside, F.substring(x, 1, 1))).when(comment, F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)

    return F.array_join(F.transform(pieces, blank), "")


def fuzzy_score(text: Column, wanted: str) -> Column:
    """Score of a subsequence match (0: none): a point a letter, more when letters follow each other."""
    start = F.struct(F.lit(0).alias("next"), F.lit(0).alias("score"), F.lit(-2).alias("last"), F.lit(0).alias("at"))
    letters = F.array(*[F.lit(c) for c in wanted.lower()])

    def step(s: Column, c: Column) -> Column:
        hit = (s["next"] < len(wanted)) & (c == F.get(letters, s["next"]))
        return F.struct((s["next"] + hit.cast("int")).alias("next"), (s["score"] + F.when(hit & (s["last"] == s["at"] - 1), 3).when(hit, 1).otherwise(0)).alias("score"), F.when(hit, s["at"]).otherwise(s["last"]).alias("last"), (s["at"] + 1).alias("at"))

    done = F.aggregate(F.split(F.lower(text), ""), start, step)
    return F.when(done["next"] == len(wanted), done["score"]).otherwise(0)


#: Bounds of metadata that is passed on.
JSON_STRING, JSON_ITEMS, JSON_KEYS, JSON_DEPTH = 500, 10, 16, 3


def bounded_value(value, depth: int = 0) -> tuple:
    """(value,) cut to the bounds, or () where nothing is left: too deep, not finite, or an empty container."""
    if value is None or isinstance(value, bool):
        return (value,)
    if isinstance(value, str):
        return (value[:JSON_STRING],)
    if isinstance(value, (int, float)):
        return (value,) if math.isfinite(value) else ()
    if depth >= JSON_DEPTH:
        return ()
    if isinstance(value, list):
        found = [x for v in value[:JSON_ITEMS] for x in bounded_value(v, depth + 1)]
    else:
        found = {k: x for k, v in list(value.items())[:JSON_KEYS] for x in bounded_value(v, depth + 1)}
    return (found,) if found else ()


def _bounded_texts(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            left = bounded_value(json.loads(text)) if text is not None else ()
        except (ValueError, RecursionError):
            left = ()
        return json.dumps(left[0], ensure_ascii=False, separators=(",", ":")) if left else None

    return texts.map(one)


def bounded_json(text: Column) -> Column:
    """JSON with strings, arrays, objects and depth cut to fixed bounds; null for what is no JSON or leaves nothing.

    Keys come and go by name, so no schema fits: an Arrow-batched function.
    """
    ship(SparkSession.active())
    return F.pandas_udf(_bounded_texts, "string")(text)
