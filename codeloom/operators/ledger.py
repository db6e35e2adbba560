"""Baselines, fingerprints, run ledger, paging and ranking."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.functions import scalars as S
from codeloom.plans.shared import saved


def stamp_fingerprints(signals: DataFrame, ordinal: list[str]) -> DataFrame:
    """The first row of a fingerprint keeps it; later ones get #1, #2, ..."""
    base = S.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line"), F.col("col"))
    n = F.row_number().over(W.Window.partitionBy("base").orderBy(*ordinal)) - 1
    return signals.withColumn("base", base).withColumn("n", n).withColumn("fingerprint", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("#", "base", F.col("n").cast("string")))).drop("base", "n")


def diff_baseline(current: DataFrame, baseline: DataFrame, strict: bool = True) -> DataFrame:
    """fingerprint, state (added, unchanged, resolved).

    Strict: a missing or repeated fingerprint is an error; else such rows are left out.
    """
    if strict:
        for name, side in (("current", current), ("baseline", baseline)):
            bad = side.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("fingerprint is null or n > 1")
            if not bad.isEmpty():
                raise ValueError(f"{name} has missing or repeated fingerprints")
    else:
        current, baseline = (x.filter("fingerprint is not null").dropDuplicates(["fingerprint"]) for x in (current, baseline))
    a, b = current.select("fingerprint", F.lit(True).alias("now")), baseline.select("fingerprint", F.lit(True).alias("then"))
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    return a.join(b, "fingerprint", "full").select("fingerprint", state.alias("state"))


def save_baseline(stored: DataFrame, tool: str, rows: DataFrame) -> DataFrame:
    """``stored`` with all entries of the tool replaced; of rows with one fingerprint the last (by ordinal) wins."""
    last = rows.groupBy("fingerprint").agg(F.max_by("payload", "ordinal").alias("payload"))
    return stored.filter(F.col("tool") != tool).unionByName(last.select(F.lit(tool).alias("tool"), "fingerprint", "payload"))


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Rows replace stored ones of equal keys; without ``replace`` the stored ones stay."""
    old, new = (stored.join(rows.select(*keys), keys, "left_anti"), rows) if replace else (stored, rows.join(stored.select(*keys), keys, "left_anti"))
    return old.unionByName(new)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose mark differs or that only one side has."""
    a, b = before.withColumnRenamed("mark", "old"), after.withColumnRenamed("mark", "new")
    return a.join(b, "path", "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified").alias("status"))


def divergence(a: Column, b: Column, cosmetic: Column, verdict: Column) -> Column:
    return F.when(a.eqNullSafe(b), "none").when(verdict, "verdict-changing").when(cosmetic, "cosmetic").otherwise("sub-verdict")


def latest(sessions: DataFrame, by: str) -> DataFrame:
    n = F.row_number().over(W.Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id")))
    return sessions.withColumn("n", n).filter("n = 1").drop("n")


def retain(sessions: DataFrame, by: str, keep: int, cutoff: str | None = None) -> DataFrame:
    """The newest ``keep`` rows of each group, none older than the cutoff."""
    n = F.row_number().over(W.Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id")))
    out = sessions.withColumn("n", n).filter(F.col("n") <= keep).drop("n")
    return out.filter(F.col("ts") >= F.lit(cutoff).cast("timestamp")) if cutoff else out


def keyset_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows behind a key, and whether more follow."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie in 1..500")
    page = (rows.filter(F.col(key) > after) if after is not None else rows).orderBy(key).limit(limit + 1)
    n = F.row_number().over(W.Window.orderBy(key))  # limit + 1 rows at most
    return page.withColumn("n", n).withColumn("more", F.max("n").over(W.Window.partitionBy()) > limit).filter(F.col("n") <= limit).drop("n")


def query_digest(query: dict) -> str:
    """The same for equal queries, whatever the order of their fields."""
    return hashlib.sha256(json.dumps(query, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def _sealed(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:32]


def encode_cursor(after, digest: str, generation: str) -> str:
    body = {"v": 1, "after": after, "query": digest, "generation": generation}
    return base64.urlsafe_b64encode(json.dumps(body | {"seal": _sealed(body)}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, digest: str, generation: str):
    """The key to go on after; a cursor that is damaged, or of another query or generation, is an error."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        seal = body.pop("seal")
        good = seal == _sealed(body) and body["v"] == 1 and body["query"] == digest and body["generation"] == generation
    except (ValueError, KeyError, AttributeError, TypeError):
        good = False
    if not good:
        raise ValueError("cursor-invalid")
    return body["after"]


def read_page(rows: DataFrame, key: str, query: dict, generation: str, limit: int = 50, cursor: str | None = None) -> tuple[DataFrame, str | None, int]:
    """A page of a named query by its unique key: the rows, the cursor of the next page (None at the end), all rows' number."""
    digest = query_digest(query)
    after = decode_cursor(cursor, digest, generation) if cursor else None
    page = saved(keyset_page(rows, key, after, limit))
    last = page.groupBy().agg(F.max(key).alias("last"), F.bool_or("more").alias("more")).first()
    return page.drop("more"), encode_cursor(last.last, digest, generation) if last.more else None, rows.count()


def within_bytes(rows: DataFrame, order: list[Column], size: str, budget: int) -> DataFrame:
    """The longest prefix in the given order whose sizes (not negative) fit the budget, with the running sum so_far.

    Rows are ranged by the order; sums of the ranges give each one's begin, and ranges that begin behind the budget are
    not sorted at all.
    """
    ranged = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))  # ranges are sampled: fix them
    sums = ranged.groupBy("part").agg(F.sum(size).alias("m"))
    before = sums.select("part", (F.sum("m").over(W.Window.orderBy("part")) - F.col("m")).alias("before"))  # a row a partition
    inside = ranged.join(F.broadcast(before.filter(F.col("before") <= budget)), "part")
    w = W.Window.partitionBy("part").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return inside.withColumn("so_far", F.col("before") + F.sum(size).over(w)).filter(F.col("so_far") <= budget).drop("part", "before")


def chunk_by_count(files: DataFrame, order: str, size: int) -> DataFrame:
    """Chunk numbers of sorted files, by a distributed rank: counts per range partition, then row numbers inside."""
    ranged = saved(files.repartitionByRange(order).withColumn("part", F.spark_partition_id()))  # ranges are sampled: fix them
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    before = counts.select("part", (F.sum("m").over(W.Window.orderBy("part")) - F.col("m")).alias("before"))  # a row a partition
    n = F.row_number().over(W.Window.partitionBy("part").orderBy(order))
    return ranged.withColumn("n", n).join(F.broadcast(before), "part").withColumn("chunk", F.floor((F.col("before") + F.col("n") - 1) / size)).drop("part", "n", "before")


def chunk_by_depth(path: str, depth: int = 2) -> Column:
    return F.array_join(F.slice(F.split(F.col(path), "/"), 1, depth), "/")
