"""Lookups between occurrences, edges, files and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions import scalars as S
from codeloom.operators.text_checks import inside


def known_targets(edges: DataFrame, occ: DataFrame) -> DataFrame:
    return edges.join(occ.select(F.col("occ_id").alias("dst")), "dst", "left_semi")


def imported_packages(calls: DataFrame, occ: DataFrame) -> DataFrame:
    """Packages that each calling file reaches: file_path, package."""
    a = calls.join(occ.select(F.col("occ_id").alias("src"), "file_path"), "src")
    return a.join(occ.select(F.col("occ_id").alias("dst"), "package"), "dst").select("file_path", "package").distinct()


def resolve_callee(calls: DataFrame, occ: DataFrame, imports: DataFrame) -> DataFrame:
    """One occurrence for each call (src, to_hash): same package first, then an imported one, then any; lowest name wins.

    Columns: src, to_hash, callee, tier (0 unique, 1 same package, 2 imported, 3 any).  The lowest twin of each body is
    found once for each package and once for all, so a call meets one row a package and never all twins of its target.
    """
    lowest = F.min(F.struct("name", F.col("occ_id").alias("callee")))
    near = occ.groupBy(F.col("body_hash").alias("to_hash"), "package").agg(lowest.alias("best"), F.count(F.lit(1)).alias("n"))
    far = near.groupBy("to_hash").agg(F.min("best").alias("far"), F.sum("n").alias("twins"))
    home = occ.select(F.col("occ_id").alias("src"), F.col("package").alias("own"), F.col("file_path").alias("own_file"))
    rows = calls.join(home, "src").join(far, "to_hash").join(near.select("to_hash", F.col("package").alias("own"), F.col("best").alias("near")), ["to_hash", "own"], "left")
    tier = F.when(F.col("twins") == 1, 0).when(F.col("near").isNotNull(), 1)
    rows = rows.select("src", "to_hash", "own_file", "far", "near", tier.alias("tier"))
    open_ = rows.filter("tier is null").join(imports.select(F.col("file_path").alias("own_file"), "package").distinct(), "own_file")
    found = open_.join(near, ["to_hash", "package"]).groupBy("src", "to_hash").agg(F.min("best").alias("imported"))
    rows = rows.join(found, ["src", "to_hash"], "left")
    best = F.when(F.col("tier") == 0, F.col("far")).otherwise(F.coalesce("near", "imported", "far"))
    tier = F.coalesce("tier", F.when(F.col("imported").isNotNull(), 2).otherwise(3))
    return rows.select("src", "to_hash", best["callee"].alias("callee"), tier.alias("tier"))


def directories(path: str) -> F.Column:
    """All directories above a path, '' included."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def longest_prefix_owner(files: DataFrame, roots: DataFrame, default: str) -> DataFrame:
    """file_path and owner: the name of the longest root directory above it (roots: dir, name)."""
    above = files.select("file_path", F.explode(directories("file_path")).alias("dir"))
    owned = above.join(roots, "dir").groupBy("file_path").agg(F.max_by("name", F.length("dir")).alias("owner"))
    return files.select("file_path").join(owned, "file_path", "left").select("file_path", F.coalesce("owner", F.lit(default)).alias("owner"))


def stitch(owners: DataFrame, exact: DataFrame, by_hash: DataFrame) -> DataFrame:
    """Edges of an owner by its full key (body_hash, file_path, line, column), else by its hash.

    Without the column, twins on one line would get each other's edges.
    """
    a = owners.join(exact.withColumnRenamed("edges", "own_edges"), ["body_hash", "file_path", "line", "column"], "left")
    return a.join(by_hash.withColumnRenamed("edges", "hash_edges"), "body_hash", "left").withColumn("edges", F.coalesce("own_edges", "hash_edges")).drop("own_edges", "hash_edges")


def merge_incremental(cached: DataFrame, closure: DataFrame, walked: DataFrame, key: str) -> DataFrame:
    """Cached rows outside the closure, and the newly walked rows."""
    return cached.join(closure.select(key), key, "left_anti").unionByName(walked)


def unique_exports(references: DataFrame, exports: DataFrame, keys: list[str]) -> DataFrame:
    """References with the target of a unique export; ambiguous ones are downgraded."""
    counted = exports.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    out = references.join(counted, keys, "left")
    return out.select(*references.columns, F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unknown").alias("status"))


def constrain_edges(candidates: DataFrame, reachable: DataFrame) -> DataFrame:
    """Guessed edges (src, dst, guessed, own, package, in_test) keep a target only in a reachable package, and not in
    another package's test file; edges that are not guessed stay."""
    ok = candidates.join(reachable.select(F.col("file_path").alias("own_file"), "package", F.lit(True).alias("near")), ["own_file", "package"], "left")
    same = F.col("package") == F.col("own")
    return ok.filter(~F.col("guessed") | ((same | F.coalesce("near", F.lit(False))) & (same | ~F.col("in_test")))).drop("near")


def resolve_imports(imports: DataFrame, known: DataFrame, extensions: tuple[str, ...] = ("", ".ts", ".tsx", ".js", "/index.ts", "/index.js")) -> DataFrame:
    """Relative imports (importer, target: joined path) to the first known file: importer, target, resolved."""
    forms = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat("target", F.lit(e)).alias("path")) for i, e in enumerate(extensions)])
    tried = imports.select("importer", "target", F.explode(forms).alias("c")).select("importer", "target", "c.rank", "c.path")
    return tried.join(known.select("path"), "path").groupBy("importer", "target").agg(F.min_by("path", "rank").alias("resolved"))


def nested_spans(occ: DataFrame) -> DataFrame:
    """outer, inner: inner begins strictly after outer begins, and ends within it, in one file."""
    outer = occ.select("file_path", F.col("occ_id").alias("outer"), (F.col("line") + 1).alias("first"), F.col("end_line").alias("last"))
    inner = occ.select("file_path", F.col("occ_id").alias("inner"), F.col("line").alias("at"), F.col("end_line").alias("inner_end"))
    return inside(outer, inner, ["file_path"], "first", "last", "at").filter("inner_end <= last").select("outer", "inner")


#: A dynamic import with a literal path, and what may stand behind a path without its extension.
DYNAMIC_IMPORT = r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)"""
ENTRY_FORMS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js")


def dynamic_import_entries(calls: DataFrame, occ: DataFrame) -> DataFrame:
    """Exported occurrences (node) of files that a call (file_path, text) imports dynamically by a relative path.

    Paths that leave the project, and those of packages, lead nowhere.
    """
    spec = calls.select("file_path", F.regexp_extract("text", DYNAMIC_IMPORT, 1).alias("spec")).filter(F.col("spec").startswith("."))
    target = S.normalize_path(F.concat_ws("/", S.parent_dir(F.col("file_path")), F.col("spec")))
    targets = spec.select(target.alias("target")).filter("target <> '..' and target not like '../%'").distinct()
    base = S.strip_extension(F.col("target"))
    files = targets.select(F.explode(F.array("target", *[F.concat(base, F.lit(e)) for e in ENTRY_FORMS])).alias("file_path")).distinct()
    return occ.filter("exported").join(files, "file_path", "left_semi").select(F.col("occ_id").alias("node"))
