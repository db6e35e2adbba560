"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks; every block is indexed once and all queries run past it, so that a task holds one block and
no vector is copied.  In a block, each dimension's postings are cut into segments by quantised value.  For a query, segments of all dimensions are processed by descending impact (the largest
product that a segment allows), adding exact products to accumulators.  After m of D postings of a vector, its score is
at most accumulator + (D - m) * impact of the next segment.  The k-th best exact score among the leaders is a bound from
below; processing stops once few vectors can still reach it, or all postings are done, and those are rescored exactly.
The k best of every block are ranked together.

Results for odd input: vectors null or with null or non-finite components take no part; vectors of different lengths are
compared over their common places; a query never meets its own row, but does meet others with its id; null ids are no
queries and come last among ties; with fewer than k candidates all are given; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.llm._common import saved, ship

LAST = np.iinfo(np.int64).max


class ImpactIndex:
    """Segments of postings of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray, levels: int = 8) -> None:
        self.vectors = vectors
        n, dims = vectors.shape
        self.places, self.values, dim, low, high = [], [], [], [], []
        for d in range(dims):
            order = np.argsort(vectors[:, d], kind="stable")
            value = vectors[order, d]
            width = max(1, (int(value[-1]) - int(value[0])) // levels + 1)
            cuts = [0, *(np.flatnonzero(np.diff((value - value[0]) // width)) + 1).tolist(), n]
            for a, b in zip(cuts[:-1], cuts[1:]):
                self.places.append(order[a:b])
                self.values.append(value[a:b])
                dim.append(d)
                low.append(value[a])
                high.append(value[b - 1])
        self.dim, self.low, self.high = np.array(dim), np.array(low), np.array(high)

    def top(self, query: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray, check_from: float = 0.4, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows but ``own`` (a mask); ties to smaller ``ids``."""
        n, dims = self.vectors.shape
        weight = query[self.dim]
        impact = np.maximum(weight * self.low, weight * self.high)
        order = np.argsort(-impact, kind="stable")
        total, done = np.zeros(n, np.int64), np.zeros(n, np.int64)
        checks = {int(len(order) * (check_from + (1 - check_from) * i / rounds)) for i in range(rounds)}
        possible = np.flatnonzero(~own)
        for at, s in enumerate(order.tolist()):
            if at in checks:
                left = np.flatnonzero(~own)
                leaders = left[np.argpartition(-total[left], 2 * k)[: 2 * k]] if len(left) > 2 * k else left
                exact = np.sort(self.vectors[leaders] @ query)
                if len(exact) >= k:
                    possible = left[total[left] + (dims - done[left]) * impact[s] >= exact[-k]]
                    if len(possible) <= max(4 * k, n // 6):
                        break
            places = self.places[s]
            total[places] += self.values[s] * weight[s]
            done[places] += 1
        else:
            left = np.flatnonzero(~own)
            bound = np.sort(total[left])[-k] if len(left) >= k else None
            possible = left if bound is None else left[total[left] >= bound]
        scores = self.vectors[possible] @ query
        best = np.lexsort((ids[possible], -scores))[:k]
        return possible[best], scores[best]


def top_k(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where the SQL condition ``is_query`` holds."""
    ship(vectors.sparkSession)
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    e = F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("e")
    table = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(F.expr(is_query), F.lit(False)).alias("q"), e).filter(F.col("e").isNotNull() & finite)
    table = saved(table.select(F.monotonically_increasing_id().alias("row"), "vec_id", "q", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v")), "vectors")
    n = table.count()
    blocks = max(1, ceil(n / rows))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long")
    asked = table.filter("q").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("q"), "row", "vec_id", "v")
    held = table.select(block.alias("block"), F.lit(False).alias("q"), "row", "vec_id", "v")
    dealt = asked.unionByName(held).repartition(blocks, "block").sortWithinPartitions("block", "q")  # rows before queries
    names = ["query", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, index, row, ids = None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            vs = batch.column("v")
            flat, at = np.asarray(vs.flatten()), np.concatenate([[0], np.cumsum(np.asarray(vs.value_lengths()))])
            for i, (b, asked, own, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "q", "row", "vec_id")))):
                if b != now:
                    now, held, index = b, [], None
                v = flat[at[i] : at[i + 1]]
                if not asked:
                    held.append((own, name, v.copy()))
                    continue
                if index is None and held:
                    matrix = np.zeros((len(held), max(len(r[2]) for r in held)), np.int64)
                    for k_, r in enumerate(held):
                        matrix[k_, : len(r[2])] = r[2]
                    row, ids = np.array([r[0] for r in held]), np.array([LAST if r[1] is None else r[1] for r in held])
                    index = ImpactIndex(matrix)
                if index is not None:
                    query = np.zeros(index.vectors.shape[1], np.int64)
                    query[: len(v)] = v[: len(query)]
                    places, scores = index.top(query, k, row == own, ids)
                    out += [(own, name, held[p][1], s) for p, s in zip(places.tolist(), scores.tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=names)

    found = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    place = F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
