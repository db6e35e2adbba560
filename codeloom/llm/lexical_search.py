"""Ranked lexical search: TPUT (three phases, uniform threshold) over term-partitioned postings.

Postings of the terms that occur in any item are written by ranges of (term, impact), so that a list lies together, its
highest impacts first.  An item's score is the sum over its terms of weight * impact, both whole numbers.

1. The heads of all lists, ``k`` postings each, give partial scores; an item's k-th best one, t, is a lower bound.
2. Every list of an item with m lists is fetched down to the uniform threshold t / m.  Fetched postings meet in blocks of
   documents, where the partial scores of all items are summed.  What a list has not sent is below the threshold, so a
   document's score is at most its partial score and the threshold for each list that did not send it.  Documents stay
   that can reach the k-th best partial score of their block, and then of all blocks.
3. Exact scores of the documents that stay are looked up in the postings, and the k best are ranked.

The documents of a block are bounded, and so is what is sent to tasks: hashes of at most ``MOST`` terms (with more, all
postings are written and joined with them), and ``MOST`` (item, term) pairs at a time (items beyond make further groups,
each with phases of its own).  Terms are known by two 64-bit hashes.

Results for odd input: null and empty texts have no term: such a document does not count in N and is never found, such an
item gets no rows; rows that repeat an id are documents, or items, of their own, ties go by row after doc_id (null last);
very long texts are read whole; where no document has a term, or there are no items, there are no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.llm._arrow import slices
from codeloom.llm._common import saved, ship
from codeloom.llm.shingles import _LOWER, U, bounds, hashed

MOST, BLOCK, SLICE = 1 << 20, 8192, 1 << 20
#: Bytes that are in no term: ASCII but letters and digits.
_GAPS = np.arange(256) < 128
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_OTHER = ((np.arange(256) * 167 + 13) % 256).astype(np.uint8)
_TERMS = "row long, id long, n long, terms array<struct<h1:long, h2:long, tf:long>>"
_TERM = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("tf", pa.int64())])


def _counted(data: np.ndarray, at: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """Number of terms of each text; text, hashes and count of each different (known) term in it, in order of texts."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(len(at) - 1, np.int64), none, none, none, none
    begin, end = bounds(data, at, _GAPS)
    n = np.diff(np.searchsorted(begin, at))
    text = np.repeat(np.arange(len(n)), n)
    lower = _LOWER[data]
    h1, h2 = (hashed(x, begin, end).view(np.int64) for x in (lower, _OTHER[lower]))
    if known is not None:
        place = np.minimum(np.searchsorted(known[0], h1), max(len(known[0]) - 1, 0))
        hit = np.flatnonzero((known[0][place] == h1) & (known[1][place] == h2)) if len(known[0]) else none
        text, h1, h2 = text[hit], h1[hit], h2[hit]
    order = np.lexsort((h2, h1, text))
    text, h1, h2 = text[order], h1[order], h2[order]
    new = np.append(True, (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(text)]
    first = np.flatnonzero(new)
    return n, text[first], h1[first], h2[first], np.diff(np.append(first, len(text)))


def counted(rows: DataFrame, id_col: str, text_col: str, known=None) -> DataFrame:
    """row, id, n (terms with repeats) and the different terms of each text that has any; only ``known`` ones, if given (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                n, text, *term = _counted(data, at, known.value if known else None)
                full = np.flatnonzero(n)
                ends = np.searchsorted(text, full, "right")
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                terms = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in term], fields=list(_TERM)))
                names = [part.column(c).take(pa.array(full)) for c in ("row", "id")]
                yield pa.RecordBatch.from_arrays([*names, pa.array(n[full]), terms], names=["row", "id", "n", "terms"])

    ship(rows.sparkSession)
    named = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, _TERMS)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """To all tasks if it has ``MOST`` rows at most (of some 24 bytes), else joined by shuffling."""
    return F.broadcast(df) if rows <= MOST else df.hint("merge")


def postings(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists (h1, h2, row, impact), weights of terms (h1, h2, w), and the ids of rows (row, doc_id)."""
    terms = asked.select("h1", "h2").distinct()
    several = terms.count()
    known = None
    if several <= MOST:
        found = sorted((r.h1, r.h2) for r in terms.collect())
        known = docs.sparkSession.sparkContext.broadcast(tuple(np.array([t[i] for t in found], np.int64) for i in (0, 1)))
    index = saved(counted(docs, id_col, text_col, known), "terms")
    texts, words = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = index.select("row", "n", F.explode("terms").alias("t")).select("row", "n", "t.*")
    if known is None:
        each = each.join(terms.hint("merge"), ["h1", "h2"], "left_semi")
    length = 50 + F.expr(f"(50 * n * {texts}L) div {max(words, 1)}L")
    impact = F.expr("(1000000000 * tf) div (1000 * tf + 20 * length)")
    weight = F.floor(1000 * F.log((2.0 * texts + 2) / (2 * F.count(F.lit(1)) + 1))).cast("long")
    weights = saved(each.groupBy("h1", "h2").agg(weight.alias("w")).filter("w > 0"), "weights")
    lists = each.withColumn("length", length).select("h1", "h2", "row", impact.alias("impact")).filter("impact > 0")
    lists = lists.join(_sent(weights.select("h1", "h2"), several), ["h1", "h2"], "left_semi")
    lists = saved(lists.repartitionByRange("h1", "h2", F.desc("impact")).sortWithinPartitions("h1", "h2", F.desc("impact")), "lists")
    return lists, weights, index.select("row", F.col("id").alias("doc_id"))


def _best(rows: DataFrame, key: str, by: list[Column], k: int) -> DataFrame:
    """The k first rows of each key, with their place."""
    return rows.withColumn("place", F.row_number().over(W.Window.partitionBy(key).orderBy(*by))).filter(F.col("place") <= k)


def lower_bounds(lists: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: item, bound (0 where fewer than ``k`` documents are in the heads)."""
    heads = lists.withColumn("place", F.row_number().over(W.Window.partitionBy("h1", "h2").orderBy(F.desc("impact"), "row"))).filter(F.col("place") <= k)
    partial = heads.join(pairs.hint("merge"), ["h1", "h2"]).groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("partial"))
    return _best(partial, "item", [F.desc("partial")], k).groupBy("item").agg(F.when(F.count(F.lit(1)) == k, F.min("partial")).otherwise(0).alias("bound"))


def _summed(dealt: DataFrame, asked: tuple[np.ndarray, ...], k: int) -> DataFrame:
    """Phase 2 in blocks: item, row, partial, most (no score is higher) of the documents that can be among the best.

    ``asked``: item, term, weight, bound and number of lists, one entry for each pair, in the order of items.
    """
    sent = dealt.sparkSession.sparkContext.broadcast(asked)

    def scored(rows: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> pa.RecordBatch:
        item, term, weight, bound, lists = sent.value
        names, place = np.unique(rows, return_inverse=True)
        starts = np.append(np.flatnonzero(np.append(True, terms[1:] != terms[:-1])), len(terms))
        at = {t: (a, b) for t, a, b in zip(terms[starts[:-1]].tolist(), starts[:-1].tolist(), starts[1:].tolist())}
        cuts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)]):
            t, m = int(bound[a]), int(lists[a])
            partial, missing = np.zeros(len(names), np.int64), np.full(len(names), m, np.int64)
            for p in range(a, b):
                if (span := at.get(int(term[p]))) is None:
                    continue
                value = impact[span[0] : span[1]] * weight[p]
                hit = np.flatnonzero(value * m >= t)
                where = place[span[0] : span[1]][hit]
                partial[where] += value[hit]
                missing[where] -= 1
            some = np.flatnonzero(partial)
            least = max(t, int(np.partition(partial[some], -k)[-k]) if len(some) >= k else 0)
            most = partial[some] + missing[some] * (max(t - 1, 0) // m)
            stay = some[most >= least]
            out.append((np.full(len(stay), item[a]), names[stay], partial[stay], most[most >= least]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["item", "row", "partial", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for batch in batches:
            block, *columns = (np.asarray(batch.column(c)) for c in ("block", "row", "term", "impact"))
            starts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(starts[:-1], starts[1:]):
                if a < b and block[a] != now:
                    if held:
                        yield scored(*np.concatenate(held, axis=1))
                    held, now = [], block[a]
                held.append(np.vstack([x[a:b] for x in columns]))
        if held:
            yield scored(*np.concatenate(held, axis=1))

    return dealt.mapInArrow(run, "item long, row long, partial long, most long")


def _found(lists: DataFrame, pairs: DataFrame, blocks: int, k: int) -> DataFrame:
    """item, row, score of at least the ``k`` best documents of each item; ``pairs``: item, h1, h2, w, ``MOST`` rows at most."""
    bounds_ = lower_bounds(lists, pairs, k)
    m = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    terms = saved(pairs.select("h1", "h2").distinct().withColumn("term", F.monotonically_increasing_id()), "numbers")
    pairs = pairs.join(m, "item").join(bounds_, "item").join(terms, ["h1", "h2"])
    pairs = saved(pairs.select("item", "h1", "h2", "term", "w", "bound", "m"), "thresholds")
    asked = pairs.select("item", "term", "w", "bound", "m").orderBy("item", "term").toArrow()
    asked = tuple(np.asarray(asked.column(c)).astype(np.int64) for c in ("item", "term", "w", "bound", "m"))

    # The lowest threshold of all items that have the term; each item applies its own to what is fetched.
    least = pairs.groupBy("h1", "h2", "term").agg(F.min(F.ceil(F.col("bound") / (F.col("m") * F.col("w")) - 1e-6)).alias("least"))
    fetched = lists.join(F.broadcast(least), ["h1", "h2"]).filter("impact >= least")
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    dealt = fetched.select(block.alias("block"), "row", "term", "impact").repartition(blocks, "block").sortWithinPartitions("block", "term")
    summed = saved(_summed(dealt, asked, k), "summed")
    second = _best(summed, "item", [F.desc("partial")], k).groupBy("item").agg(F.when(F.count(F.lit(1)) == k, F.min("partial")).otherwise(0).alias("second"))
    stay = saved(summed.join(second, "item").filter("most >= second").select("item", "row"), "stay")

    looked_up = lists.join(_sent(stay, stay.count()), "row").join(F.broadcast(pairs.select("item", "h1", "h2", "w")), ["item", "h1", "h2"])
    return looked_up.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    found = saved(counted(items, item_id_col, item_text_col), "items")
    asked = found.select(F.col("row").alias("item"), F.explode("terms").alias("t")).select("item", "t.h1", "t.h2")
    lists, weights, ids = postings(docs, asked, id_col, text_col)
    pairs = saved(asked.join(weights, ["h1", "h2"]), "pairs")
    several = pairs.count()
    blocks = max(1, ceil(ids.count() / BLOCK))
    if several <= MOST:
        scores = _found(lists, pairs, blocks, k)
    else:
        groups = ceil(2 * several / MOST)
        group = F.pmod(F.xxhash64("item"), F.lit(groups))
        scores = None
        for g in range(groups):
            part = saved(_found(lists, pairs.filter(group == g), blocks, k), "scores")
            scores = part if scores is None else scores.unionByName(part)
    ranked = _best(scores.join(ids, "row"), "item", [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], k)
    return ranked.join(found.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")


OP12_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), tf AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), sizes AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS words FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * texts + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, texts
), lengths AS (
  SELECT doc_id, 50 + ((50 * n * texts) // words) AS m FROM sizes, corpus
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id)
  GROUP BY item_id, doc_id HAVING score > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scores QUALIFY rank <= 50
"""
