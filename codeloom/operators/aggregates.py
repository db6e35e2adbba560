"""Coupling, metrics, ratings and other aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions import scalars as S
from codeloom.operators import ranks as Q


def package_coupling(edges: DataFrame, occ: DataFrame) -> DataFrame:
    """Calls for each (caller package, callee package)."""
    a, b = (occ.select(F.col("occ_id").alias(k), F.col("package").alias(n)) for k, n in (("src", "caller"), ("dst", "callee")))
    return edges.join(a, "src").join(b, "dst").groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"))


def coupling_degrees(coupling: DataFrame) -> DataFrame:
    out = coupling.groupBy(F.col("caller").alias("package")).agg(F.countDistinct("callee").alias("fan_out"))
    into = coupling.groupBy(F.col("callee").alias("package")).agg(F.countDistinct("caller").alias("fan_in"))
    return out.join(into, "package", "full").select("package", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_out", "fan_in")])


def coupling_matrix(coupling: DataFrame, packages: list[str]) -> DataFrame:
    return coupling.groupBy("caller").pivot("callee", packages).agg(F.sum("calls")).na.fill(0)


def mutual_packages(coupling: DataFrame) -> DataFrame:
    """Pairs that call each other: a < b, calls in both directions."""
    a = coupling.select(F.col("caller").alias("a"), F.col("callee").alias("b"), F.col("calls").alias("there")).filter("a < b")
    b = coupling.select(F.col("callee").alias("a"), F.col("caller").alias("b"), F.col("calls").alias("back"))
    return a.join(b, ["a", "b"])


def latency_snapshot(rows: DataFrame, value: str, *by: str, limit: int = 100_000) -> DataFrame:
    """count, mean and interpolated p50, p95, p99 (exact, for groups of any size); zeros where there are no values."""
    group = F.struct(F.lit(1).alias("all"), *by).alias("g")
    totals = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    ranks = Q.quantiles(rows, value, list(by), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, limit)
    out = totals.join(ranks.select(group, "p50", "p95", "p99"), "g", "left")
    return out.select(*[F.col("g")[b].alias(b) for b in by], "n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "p50", "p95", "p99")])


def rates(totals: DataFrame) -> DataFrame:
    """totals: total, failed, errors, seconds.  Rates with the guards for empty runs."""
    total, failed, errors, seconds = (F.col(c) for c in ("total", "failed", "errors", "seconds"))
    return totals.withColumns({
        "error_rate": F.when(total == 0, 1.0).otherwise(F.try_divide(failed, total)),
        "success_rate": F.when(total == 0, 0.0).otherwise(F.try_divide(total - failed, total)),
        "recovery_rate": F.when(errors == 0, 1.0).otherwise(1 - F.try_divide(failed, errors)),
        "rps": F.when(seconds <= 0, 0.0).otherwise(F.try_divide(total, seconds)),
    })


def assertions(metrics: DataFrame, asserted: DataFrame) -> DataFrame:
    """metrics (metric, value) against asserted (metric, op, threshold): holds."""
    v, t = F.col("value"), F.col("threshold")
    holds = F.coalesce(*[F.when(F.col("op") == o, c) for o, c in {"lt": v < t, "lte": v <= t, "gt": v > t, "gte": v >= t, "eq": v == t, "neq": v != t}.items()], F.lit(False))
    return asserted.join(metrics, "metric", "left").select("metric", "op", "threshold", "value", holds.alias("holds"))


def pass_rate(rows: DataFrame, passed: str, *by: str) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("total"), F.count_if(passed).alias("passed"), F.when(n == 0, 100).otherwise(F.round(F.count_if(passed) / n * 100)).cast("long").alias("score"))


def check_counts(signals: DataFrame, *by: str) -> DataFrame:
    err = S.is_error(F.col("severity"))
    out = signals.groupBy(*by).agg(F.count_if(err).alias("errors"), F.count_if(~err).alias("warnings"), F.countDistinct("file_path").alias("files"))
    return out.withColumn("verdict", S.verdict(F.col("errors"), F.col("warnings")))


def detection_quality(cases: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and false positive rate; null where a denominator is zero."""
    e, a = F.col("expected"), F.col("actual")
    out = cases.groupBy(*by).agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"), F.count_if(~e & ~a).alias("tn"))
    ratio = lambda x, y: F.try_divide(F.col(x), F.col(x) + F.col(y))
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "fpr": ratio("fp", "tn")})


def group_counts(rows: DataFrame, key: str, cap: int = 500) -> DataFrame:
    """Counts of the ``cap`` lowest keys, and whether there are more."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    more = counts.agg((F.count(F.lit(1)) > cap).alias("truncated")).first()[0]
    return counts.orderBy(key).limit(cap).withColumn("truncated", F.lit(bool(more)))


def suite_groups(sessions: DataFrame) -> DataFrame:
    """One row for each suite: sessions newest first."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("ts", "id")), asc=False), lambda s: s["id"])
    return sessions.groupBy("suite").agg(items.alias("ids"), F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n"))


def correlation_groups(members: DataFrame) -> DataFrame:
    """members: kind, value, id, risk.  Groups of two or more with their primary; of equal member sets the first stays."""
    groups = members.groupBy("kind", "value").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min_by("id", F.struct("risk", "id")).alias("primary"), F.min("risk").alias("risk")).filter("size(ids) >= 2")
    first = W.Window.partitionBy("ids").orderBy("kind", "value")
    return groups.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def arm_metrics(steps: DataFrame, arm: str, order: str) -> DataFrame:
    """calls, bytes, wall time, and time up to the first useful step of each arm."""
    so_far = F.sum("wall").over(W.Window.partitionBy(arm).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0))
    return steps.withColumn("so_far", so_far).groupBy(arm).agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes").alias("bytes"), F.sum("wall").alias("wall"), F.min(F.when(F.col("useful"), F.col("so_far"))).alias("to_useful"))


def confidence_summary(rows: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return rows.agg(F.count_if(c == "high").alias("high"), F.count_if(c == "medium").alias("medium"), F.count_if(~c.isin("high", "medium") | c.isNull()).alias("low"), F.coalesce(F.sum("estimate"), F.lit(0)).alias("estimate"))


def unit_table(units: DataFrame, signals: DataFrame) -> DataFrame:
    """One row for each unit (unit, passed, failed_with, duration): status, errors, warnings.  signals: source, is_error."""
    counts = signals.groupBy(F.col("source").alias("unit")).agg(F.count_if("is_error").alias("errors"), F.count_if(~F.col("is_error")).alias("warnings"))
    status = F.when(F.col("failed_with").isNotNull(), "ERROR").when(F.col("passed"), "PASS").otherwise("FAIL")
    zero = F.lit(0).cast("long")
    return units.join(counts, "unit", "left").select("unit", status.alias("status"), F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), "duration")


def unit_summary(rows: DataFrame) -> DataFrame:
    """Totals of a unit table; a unit that failed with an error counts as failed."""
    return rows.agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") != "PASS").alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("errors", "warnings", "duration")))


def median(rows: DataFrame, by: str, value: str, limit: int = 100_000) -> DataFrame:
    """The exact median of each group; of an even number, the mean of the middle pair; null where there are no values."""
    found = Q.quantiles(rows, value, [by], {"median": 0.5}, limit)
    return rows.select(F.col(by).alias("key")).distinct().join(found, F.col("key").eqNullSafe(F.col(by)), "left").select(F.col("key").alias(by), "median")
