"""Links between packages: import specifiers to packages, called names and references to what a package exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars as S


def specifier_packages(specifiers: DataFrame, packages: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """specifier, package, subpath (``./rest``, null for the root): distinct bare specifiers that name a known package.

    packages: package.  surface: package, subpath (with one ``*`` at most), allowed; of a package that has rows there,
    the equal entry decides, else the one that fits with most in front of its star; specifiers that fit none name nothing.  Other packages show all.
    """
    bare = specifiers.select("specifier").filter("specifier <> '' and not specifier rlike '^[./]'").distinct()
    package = S.package_of_specifier(F.col("specifier"))
    rest = F.expr("substring(specifier, length(package) + 2)")
    found = bare.withColumn("package", package).join(packages.select("package").distinct(), "package")
    found = found.select("specifier", "package", F.when(rest != "", F.concat(F.lit("./"), rest)).alias("subpath"))
    if surface is None:
        return found
    parts = F.split(F.col("shown"), r"\*", 2)
    asked = F.coalesce("subpath", F.lit("."))
    star = (F.size(parts) == 2) & asked.startswith(parts[0]) & asked.endswith(F.try_element_at(parts, F.lit(2))) & (F.length(asked) >= F.length("shown") - 1)
    shown = surface.select("package", F.col("subpath").alias("shown"), "allowed")
    closed = found.join(shown, "package").groupBy("specifier", "package", "subpath").agg(F.max_by("allowed", F.when(asked == F.col("shown"), 2**31 - 1).when(star, F.length(parts[0]))).alias("allowed"))
    # max_by passes over entries that don't fit, as their order is null
    return closed.filter("allowed").drop("allowed").unionByName(found.join(shown.select("package").distinct(), "package", "left_anti"))


def link_exported(calls: DataFrame, exports: DataFrame, packages: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """calls (specifier, name and others) with target and link.

    exports: package, name, target, file_path.  The only export of that name is the target.  Of several, the only one
    whose file is the subpath (without its extension, or as an index file) is; else the call stays open, as a missing edge
    does less harm than a wrong one.  link: linked, ambiguous, missing (not exported), external (no known package) or
    local (a path, or no specifier).
    """
    stem = lambda c: F.regexp_replace(c, r"\.[A-Za-z0-9]+$", "")
    known = specifier_packages(calls, packages, surface).withColumn("stem", stem(F.regexp_replace("subpath", r"^\./", "")))
    named = exports.groupBy("package", "name").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("only"))
    several = exports.join(named.filter("n > 1").select("package", "name"), ["package", "name"], "left_semi")
    parts = F.split(stem(F.col("file_path")), "/")
    tails = lambda p, first: F.when(F.size(p) >= first, F.transform(F.sequence(F.lit(first), F.size(p)), lambda k: F.array_join(F.slice(p, k, F.size(p) - k + 1), "/")))
    folder = F.when(F.element_at(parts, -1) == "index", tails(F.slice(parts, 1, F.size(parts) - 1), 2))
    ends = F.array_distinct(F.concat(tails(parts, 1), F.coalesce(folder, F.array().cast("array<string>"))))
    at_file = several.select("package", "name", "target", F.explode(ends).alias("stem")).groupBy("package", "name", "stem").agg(F.count(F.lit(1)).alias("there"), F.min("target").alias("in_file"))
    rows = calls.join(known, "specifier", "left").join(named, ["package", "name"], "left").join(at_file, ["package", "name", "stem"], "left")
    target = F.when(F.col("n") == 1, F.col("only")).when(F.col("there") == 1, F.col("in_file"))
    local = F.coalesce(F.col("specifier") == "", F.lit(True)) | F.col("specifier").rlike("^[./]")
    link = F.when(local, "local").when(F.col("package").isNull(), "external").when(F.col("n").isNull(), "missing").when(target.isNull(), "ambiguous").otherwise("linked")
    return rows.select(*calls.columns, target.alias("target"), link.alias("link"))


def reconcile_references(references: DataFrame, declarations: DataFrame, packages: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """References between packages finished against all declarations: with package, target, basis and reason.

    references: target (or null), specifier, name, kind and others; declarations: declaration, package, name, kind,
    exported.  A target that is still declared stays (basis ``kept``); one that is gone is given up.  Without a target,
    the only exported declaration of (package, name, kind) is taken.  Several make a reference to the root ambiguous.
    """
    ids = declarations.select(F.col("declaration").alias("target")).distinct().withColumn("there", F.lit(True))
    index = declarations.filter("exported").groupBy("package", "name", "kind").agg(F.min("declaration").alias("first"), F.max("declaration").alias("last"))
    rows = references.join(ids, "target", "left").join(specifier_packages(references, packages, surface), "specifier", "left").join(index, ["package", "name", "kind"], "left")
    given, one = F.col("target").isNotNull(), F.col("first") == F.col("last")
    gone = given & F.col("there").isNull()
    relative = F.coalesce(F.col("specifier") == "", F.lit(True)) | F.col("specifier").startswith(".")
    whole = F.col("name").isNotNull() & F.col("kind").isNotNull()
    said = lambda basis, reason=None: F.struct(F.lit(basis).alias("basis"), F.lit(reason).cast("string").alias("reason"))
    state = (
        F.when(gone, said("unresolved", "target-missing-after-merge"))
        .when(given, said("kept"))
        .when(relative, said("local"))
        .when(F.col("package").isNull(), said("external", "external-or-unmapped-specifier"))
        .when(~whole, said("unresolved", "cross-package-join-incomplete-descriptor"))
        .when(one, said("workspace-export-index"))
        .when(F.col("first").isNotNull() & F.col("subpath").isNull(), said("ambiguous", "cross-package-join-ambiguous"))
        .otherwise(said("unresolved", "cross-package-join-not-found"))
    )
    rest = [c for c in references.columns if c != "target"]
    rows = rows.withColumn("s", state)
    target = F.when(F.col("s.basis") == "kept", F.col("target")).when(F.col("s.basis") == "workspace-export-index", F.col("first"))
    return rows.select(*rest, F.when(~given, F.col("package")).alias("package"), target.alias("target"), "s.basis", "s.reason")
