"""Exact ranks of groups of any size: values are counted in ever narrower intervals, no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.plans.shared import saved

#: Parts into which a round cuts an interval, and how precise the cuts are (ranks are exact all the same).
PARTS, ACCURACY = 500, 5_000
_STATE = ["g", "k", "lo", "hi", "below", "inside"]


def kth_values(rows: DataFrame, value: str, by: list[str], wanted: DataFrame, limit: int = 100_000) -> DataFrame:
    """The k-th smallest value (double; k from 0) of each group: the columns ``by``, k, value.

    wanted: the columns ``by``, k.  Ranks that a group does not have give no row, nulls and NaN are no values, and null
    is a key like any other.  A rank lies in an interval with an exact count below it.  Each round cuts the interval
    around the rank at approximate quantiles, counts exactly, and keeps the part that holds the rank, until it has one
    value or at most ``limit`` rows; only those are ordered.  A round keeps about a hundredth of the rows.
    """
    group = F.struct(F.lit(1).alias("all"), *by).alias("g")
    data = rows.select(group, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    size = data.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.lit(0).cast("long").alias("below"), F.count("v").alias("inside"))
    state = saved(wanted.select(group, "k").distinct().join(size, "g").filter("k >= 0 and k < inside").select(_STATE))
    open_ = (F.col("lo") < F.col("hi")) & (F.col("inside") > limit)
    while not state.filter(open_).isEmpty():
        state = saved(state.filter(~open_).unionByName(_narrower(data, state.filter(open_))))
    few = _within(data, state.filter("lo < hi")).groupBy("g", "k", "below", "v").agg(F.count("v").alias("n"))
    through = F.col("below") + F.sum("n").over(W.Window.partitionBy("g", "k").orderBy("v"))
    ordered = few.withColumn("after", through).filter("k < after and k >= after - n").select("g", "k", "v")
    found = state.filter("lo = hi").select("g", "k", F.col("lo").alias("v")).unionByName(ordered)
    return found.select(*[F.col("g")[b].alias(b) for b in by], "k", F.col("v").alias("value"))


def _within(data: DataFrame, state: DataFrame) -> DataFrame:
    return data.join(state, "g").filter("v >= lo and v <= hi")


def _narrower(data: DataFrame, state: DataFrame) -> DataFrame:
    """The part of each interval that holds its rank; a part lacks at least one value of its interval."""
    cuts = _within(data, state).groupBy("g", "k").agg(F.percentile_approx("v", [i / PARTS for i in range(PARTS + 1)], ACCURACY).alias("cuts"))
    part = F.floor((F.col("k") - F.col("below")) / F.col("inside") * PARTS).cast("int")
    left, right = F.col("cuts")[F.greatest(part - 1, F.lit(0))], F.col("cuts")[F.least(part + 2, F.lit(PARTS))]
    cells = _within(data, state.join(cuts, ["g", "k"]).select(*_STATE, left.alias("left"), right.alias("right")))
    v = F.col("v")
    cell = F.when(v < F.col("left"), 0).when(v == F.col("left"), 1).when(v < F.col("right"), 2).when(v == F.col("right"), 3).otherwise(4)
    counts = cells.groupBy("g", "k", "below", cell.alias("cell")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("inside"))
    start = F.col("below") + F.sum("inside").over(W.Window.partitionBy("g", "k").orderBy("cell")) - F.col("inside")
    return counts.withColumn("below", start).filter("k >= below and k < below + inside").select(_STATE)


def quantiles(rows: DataFrame, value: str, by: list[str], wanted: dict[str, float], limit: int = 100_000) -> DataFrame:
    """Interpolated quantiles by name, one row for each group that has a value: the columns ``by`` and the names."""
    sizes = saved(rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.struct(F.lit(1).alias("all"), *by).alias("g")).agg((F.count(value) - 1).alias("last")))
    spots = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col("last") * F.lit(q)).alias("at")) for n, q in wanted.items()]))
    places = sizes.select("g", spots.alias("s")).select("g", "s.name", "s.at")
    ranks = places.select("g", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k"))
    found = kth_values(rows, value, by, ranks.select(*[F.col("g")[b].alias(b) for b in by], "k"), limit).select(F.struct(F.lit(1).alias("all"), *by).alias("g"), "k", "value")
    low, high = (found.select("g", F.col("k").alias(k), F.col("value").alias(v)) for k, v in (("below", "low"), ("above", "high")))
    both = places.withColumns({"below": F.floor("at"), "above": F.ceil("at")}).join(low, ["g", "below"]).join(high, ["g", "above"])
    out = both.groupBy("g").agg(*[F.max(F.when(F.col("name") == n, _between())).alias(n) for n in wanted])
    return out.select(*[F.col("g")[b].alias(b) for b in by], *wanted)


def _between() -> Column:
    at, low, high = F.col("at"), F.col("low"), F.col("high")
    return F.when(low == high, low).otherwise((F.col("above") - at) * low + (at - F.col("below")) * high)


def nearest_rank(rows: DataFrame, value: str, by: list[str], name: str, q: float, limit: int = 100_000) -> DataFrame:
    """The smallest value whose share of the group's values up to it is at least q: the columns ``by`` and the name."""
    sizes = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count(value).alias("n"))
    wanted = sizes.select(*by, F.greatest(F.ceil(F.col("n") * F.lit(q)) - 1, F.lit(0)).alias("k"))
    return kth_values(rows, value, by, wanted, limit).select(*by, F.col("value").alias(name))
