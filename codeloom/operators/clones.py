"""Clone detection over candidate bodies."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.plans.shared import saved, ship

#: Fixed values of the signature: slots, bands, gram length, mixing constant.  SEED names the hash functions of an installation.
SLOTS, BANDS, GRAM, MIX, SEED = 128, 8, 5, 0x45D9F3B, "codeloom-minhash-perm:"


def normalized(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, r"(?U)\s+", " "))


#: Kinds that are never worth sharing, and the least lines of a body.
UNSHARED_KINDS, MIN_LINES = ("arrow", "function-expression", "module-init"), 5


def eligible(cands: DataFrame) -> DataFrame:
    """Candidates (kind, in_test) that could be shared; unknown kinds could, tests' own functions are not."""
    return cands.filter(F.coalesce(~F.col("kind").isin(*UNSHARED_KINDS), F.lit(True)) & ~F.coalesce("in_test", F.lit(False)))


def long_enough(cands: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Candidates of ``min_lines`` lines or more, by ``body_lines`` where it is there and known, else by line and end_line."""
    span = F.col("end_line") - F.col("line") + 1
    return cands.filter((F.coalesce("body_lines", span) if "body_lines" in cands.columns else span) >= min_lines)


def exact_groups(cands: DataFrame, hash_col: str = "body_hash", min_size: int = 200) -> DataFrame:
    """Groups of two or more equal bodies that are large enough (or of unknown size), with their anchor."""
    rows = cands.dropDuplicates(["site"]).filter(F.coalesce(F.col("size") >= min_size, F.lit(True)))
    return rows.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("anchor"), F.countDistinct("package").alias("packages"), F.max("size").alias("size")).filter("n >= 2")


def cross_package_groups(cands: DataFrame, hash_col: str = "body_hash", packages: int = 3, min_anchor: int = 80) -> DataFrame:
    """Groups over several packages, whatever their size unless the anchor is known to be small."""
    rows = cands.dropDuplicates(["site"]).filter("package is not null and package <> ''")
    out = rows.groupBy(hash_col).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("package")).alias("packages"), F.min("site").alias("anchor"), F.min_by("size", "site").alias("anchor_size"))
    return out.filter((F.size("packages") >= packages) & F.coalesce(F.col("anchor_size") >= min_anchor, F.lit(True)))


def duplicate_lines(groups: DataFrame, span: str = "size") -> DataFrame:
    return groups.withColumn("lines", F.col(span) * (F.col("n") - 1))


@lru_cache
def seeds(slots: int = SLOTS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{SEED}{i}".encode()).digest()[:4], "little") for i in range(slots)]


def grams(text: str, gram: int = GRAM) -> set[str]:
    """Distinct character grams; a short text is one gram, an empty one none."""
    return {text[i : i + gram] for i in range(max(1, len(text) - gram + 1))} if text else set()


def minhash(text: str, slots: int = SLOTS) -> list[int] | None:
    """The smallest mixed hash of the grams in each slot; a gram's hash is the first four bytes of its SHA-256."""
    least = _least(text, slots)
    return None if least is None else least.tolist()


#: Characters whose grams are held at once, and grams that are mixed at once; a long text needs no more memory than that.
PIECE, SLICE = 65_536, 1_024


def _least(text: str, slots: int) -> np.ndarray | None:
    least, mask = None, np.array(seeds(slots), np.uint32)[None, :]
    for at in range(0, max(1, len(text) - GRAM + 1), PIECE):
        base = np.frombuffer(b"".join(hashlib.sha256(g.encode()).digest()[:4] for g in grams(text[at : at + PIECE + GRAM - 1])), "<u4")
        for i in range(0, len(base), SLICE):
            x = base[i : i + SLICE, None] ^ mask
            for _ in range(2):
                x ^= x >> np.uint32(16)
                x *= np.uint32(MIX)
            x ^= x >> np.uint32(16)
            few = x.min(axis=0)
            least = few if least is None else np.minimum(least, few)
    return None if least is None else least.astype(np.int64)


def _signatures(text: pd.Series) -> pd.Series:
    return pd.Series([_least(t or "", SLOTS) for t in text], dtype=object)


def signature(text: Column) -> Column:
    """MinHash signatures, in Arrow batches (as an expression, 128 slots over each gram would be rebuilt for each row)."""
    ship(SparkSession.active())
    return F.pandas_udf(_signatures, "array<bigint>")(text)


def _banded(cands: DataFrame, bands: int, slots: int) -> DataFrame:
    """id, band, key: one row for each band of a signature."""
    if slots % bands:
        raise ValueError("bands must divide the slots")
    rows = slots // bands
    return cands.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.array_join(F.slice(F.transform("sig", lambda x: x.cast("string")), k * rows + 1, F.lit(rows)), ","))).alias("band", "key"))


def near_coverage(cands: DataFrame, bands: int = BANDS, slots: int = SLOTS, bucket_cap: int = 256) -> DataFrame:
    """One row that tells whether ``near_pairs`` looked at all of its buckets: complete, reason, buckets, capped, left_out."""
    sizes = _banded(cands, bands, slots).groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"))
    over = F.greatest(F.col("m") - bucket_cap, F.lit(0))
    out = sizes.agg(F.count(F.lit(1)).alias("buckets"), F.count_if(over > 0).alias("capped"), F.coalesce(F.sum(over), F.lit(0)).alias("left_out"))
    return out.select((F.col("capped") == 0).alias("complete"), F.when(F.col("capped") > 0, "lsh-bucket-cap").alias("reason"), "*")


def near_pairs(cands: DataFrame, threshold: float = 0.85, bands: int = BANDS, slots: int = SLOTS, bucket_cap: int = 256) -> DataFrame:
    """Pairs (a, b, similarity) of different bodies that share a band; of a bucket the first ``bucket_cap`` by id count.

    cands: id, hash, sig.  The cap is part of the operator's result, as are equal languages where a column lang exists.
    """
    banded = _banded(cands, bands, slots)
    n = F.row_number().over(W.Window.partitionBy("band", "key").orderBy("id"))
    kept = saved(banded.withColumn("n", n).filter(F.col("n") <= bucket_cap).drop("n"))
    a, b = kept.withColumnRenamed("id", "a"), kept.withColumnRenamed("id", "b")
    pairs = a.join(b, ["band", "key"]).filter("a < b").select("a", "b").distinct()
    x = cands.select(F.col("id").alias("a"), F.col("hash").alias("ha"), F.col("sig").alias("sa"), *[F.col(c).alias(f"{c}_a") for c in cands.columns if c == "lang"])
    y = cands.select(F.col("id").alias("b"), F.col("hash").alias("hb"), F.col("sig").alias("sb"), *[F.col(c).alias(f"{c}_b") for c in cands.columns if c == "lang"])
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda p, q: p == q), lambda e: e)) / F.lit(float(slots))
    out = pairs.join(x, "a").join(y, "b").filter("ha <> hb")
    if "lang" in cands.columns:
        out = out.filter("lang_a = lang_b")
    return out.select("a", "b", same.alias("similarity")).filter(F.col("similarity") >= threshold)


def clusters(pairs: DataFrame) -> DataFrame:
    """node, cluster (smallest node) of the pairs' connected components."""
    both = saved(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("cluster")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("cluster").alias("heard"))
        told = saved(labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("cluster", "heard").alias("cluster"), F.col("cluster").alias("was")))
        labels = told.drop("was")
        if told.filter("cluster <> was").isEmpty():
            return labels


def cluster_rows(pairs: DataFrame, cap: int = 50, hashes: DataFrame | None = None) -> DataFrame:
    """One row for each cluster: size, anchor, members, best similarity, and whether it had more than ``cap`` members.

    Of a larger cluster the lowest ``cap`` nodes stay, or, if no pair lies within them, those with the most pairs.  What
    the cut leaves may fall apart: of its components the largest is given, then the one of highest similarity, then of
    the lowest anchor.  With ``hashes`` (node, hash), exact_members are the members whose hash another member shares.
    """
    of = saved(clusters(pairs))
    edges = saved(pairs.join(of, pairs["a"] == of["node"]).select("cluster", "a", "b", "similarity"))
    degree = edges.select("cluster", F.explode(F.array("a", "b")).alias("node")).groupBy("cluster", "node").agg(F.count(F.lit(1)).alias("degree"))

    def within(ranked: DataFrame, *order: Column) -> DataFrame:
        n = F.row_number().over(W.Window.partitionBy("cluster").orderBy(*order))
        kept = ranked.withColumn("n", n).filter(F.col("n") <= cap).select("node")
        return edges.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").join(kept.withColumnRenamed("node", "b"), "b", "left_semi").select("cluster", "a", "b", "similarity")

    lowest = saved(within(of, F.col("node")))
    hubs = within(degree, F.desc("degree"), F.col("node")).join(lowest.select("cluster").distinct(), "cluster", "left_anti")
    left = saved(lowest.unionByName(hubs))
    parts = saved(clusters(left).withColumnRenamed("cluster", "part"))
    members = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("anchor"), F.array_sort(F.collect_list("node")).alias("members"))  # ``cap`` nodes at most
    best = left.join(parts, left["a"] == parts["node"]).groupBy("cluster", "part").agg(F.max("similarity").alias("similarity"))
    first = F.row_number().over(W.Window.partitionBy("cluster").orderBy(F.desc("size"), F.desc("similarity"), "anchor"))
    large = of.groupBy("cluster").agg((F.count(F.lit(1)) > cap).alias("capped"))
    out = best.join(members, "part").withColumn("n", first).filter("n = 1").join(large, "cluster")
    columns = ["cluster", "size", "anchor", "members", "similarity", "capped"]
    if hashes is None:
        return out.select(*columns)
    shared = parts.join(hashes.select("node", "hash"), "node").groupBy("part", "hash").agg(F.collect_list("node").alias("same")).filter("size(same) > 1")
    exact = shared.groupBy("part").agg(F.array_sort(F.flatten(F.collect_list("same"))).alias("exact_members"))
    return out.join(exact, "part", "left").select(*columns, F.coalesce("exact_members", F.array().cast("array<long>")).alias("exact_members"))
