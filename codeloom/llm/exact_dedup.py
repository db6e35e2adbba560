"""Exact deduplication through an extendible-hash index on shared files (DataFrame functions only).

Every text is normalised by deleting ASCII white space and hashed; the different hashes and their counts are saved.  A
directory of hash prefixes is doubled, splitting overfull buckets, until none holds more than ``capacity`` different
hashes; every bucket owns one range of keys.  Rows are dealt to owner tasks by the bucket that the directory names.  An
owner sorts each of its buckets by hash and text and compares every text with the one before it, byte by byte: one that
differs opens the next entry of the chain of its hash.  A hash of more than ``hot`` rows has several owners, each with a
part of its rows; the texts that each of them found, one for each entry, meet in a last owner, which compares and chains
them in the same way.  The index is written to the shared folder.  Rows find their entry by bucket, hash and place in the
chain; no digest decides about equality.

Results for odd input: null and white-space-only texts are the empty text; a null id sorts after all others and is
kept only where every copy has a null id; rows that repeat id and text share one decision in ``exact_groups``, while
``drop_copies`` decides by a key of each row and leaves one row of every group; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.llm._common import keyed, saved

SPACES = " \t\n\x0b\x0c\r"
_TOP = 9223372036854775807


def without_space(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _hash(norm: Column, hash_bits: int) -> Column:
    h = F.xxhash64(norm)
    return h if hash_bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)


def grow_directory(counts: dict[int, int], bits: int, capacity: int) -> list[int]:
    """Double a directory until every bucket holds ``capacity`` entries at most, or ``bits`` are used.

    ``counts``: entries by the first ``bits`` bits of the hash.  Returns the bucket number of each directory slot; the
    slots are the hash prefixes in order, so every bucket owns one range of keys.
    """
    level = [dict(counts)]  # entries by the first bits, bits - 1, ... 0 bits
    for _ in range(bits):
        above: dict[int, int] = {}
        for p, n in level[-1].items():
            above[p >> 1] = above.get(p >> 1, 0) + n
        level.append(above)
    depth, slots = 0, [(0, 0)]  # (local depth, prefix)
    while depth < bits and any(d == depth and level[bits - d].get(p, 0) > capacity for d, p in slots):
        depth += 1
        doubled = []
        for i, (d, p) in enumerate(x for x in slots for _ in range(2)):
            split = d == depth - 1 and level[bits - d].get(p, 0) > capacity
            doubled.append((depth, i) if split else (d, p))
        slots = doubled
    number = {b: i for i, b in enumerate(dict.fromkeys(slots))}
    return [number[b] for b in slots]


def directory(keys: DataFrame, capacity: int | None) -> tuple[DataFrame, int]:
    """The directory (slot, bucket) for ``keys`` (hash, unique), and its depth; without ``capacity``, 65,536 buckets or so at most.

    The driver holds the number of entries of about eight prefixes a bucket, never more; the directory has no other
    limit.  Prefixes that are still overfull then (a hash spreads keys evenly, so only few alike keys can be the cause)
    stay one bucket with long chains.
    """
    spark, n = keys.sparkSession, keys.count()
    capacity = capacity or max(4096, n >> 16)
    bits = max(1, min(62, (max(1, n) * 8 // capacity).bit_length()))
    counts = {r[0]: r[1] for r in keys.groupBy(F.shiftrightunsigned("hash", 64 - bits).alias("prefix")).count().collect()}
    slots = grow_directory(counts, bits, capacity)
    rows = ", ".join(map(str, slots)) if len(slots) <= 4096 else None
    if rows is None:
        found = spark.createDataFrame(list(enumerate(slots)), "slot long, bucket int")
    else:
        found = spark.range(1).select(F.posexplode(F.split(F.lit(rows), ", "))).select(F.col("pos").cast("long").alias("slot"), F.col("col").cast("int").alias("bucket"))
    return found, len(slots).bit_length() - 1


def _in_buckets(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket that the directory names for their hash."""
    slot = F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")
    # 12 bytes a slot: 12 MB at most are sent along; a larger directory is joined by shuffling.
    sized = F.broadcast(slots) if depth <= 20 else slots.hint("merge")
    return rows.withColumn("slot", slot).join(sized, "slot").drop("slot")


def _chained(owner: list[str], text: str) -> tuple[Column, Column]:
    """In each owner's rows, sorted by ``text``: whether a text differs from the one before it, and its place in the chain.

    The window of the second one refers to a column ``differs``.
    """
    rows = W.Window.partitionBy(*owner).orderBy(text)
    differs = F.coalesce(F.lag(text).over(rows) != F.col(text), F.lit(True))
    return differs, F.sum(F.col("differs").cast("int")).over(rows.rowsBetween(W.Window.unboundedPreceding, 0)).cast("int")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, hash_bits: int = 64, hot: int = 4096, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The index, one row for each different normalised text, and the keys of all rows with their entries.

    Index: bucket, hash, chain (place among entries of one hash), text_sha256 (binary), keep_id, group_size, and with
    ``row_col``, a key of each row, keep_row: one row of those that have the largest size and keep_id.
    Keys: doc_id (of ``row_col``, if given), bucket, hash, chain.
    """
    norm = without_space(F.col(text_col))
    size = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("decimal(10,0)")
    backwards = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - F.col(id_col).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"), F.lit(0).cast("decimal(1,0)"))
    # One decimal holds (size, smallest id first), so that the aggregate keeps a fixed-width buffer.
    order = (size * F.expr("cast('100000000000000000000' as decimal(21,0))") + backwards.cast("decimal(20,0)")).cast("decimal(38,0)")
    keys = saved(docs.select(_hash(norm, hash_bits).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "keys")
    slots, depth = directory(keys, capacity)
    parts = keys.filter(F.col("n") > hot).select("hash", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    parts = F.broadcast(parts) if parts.count() <= 1 << 17 else parts.hint("merge")  # 12 bytes each

    rows = docs.select(F.col(row_col or id_col).alias("doc_id"), _hash(norm, hash_bits).alias("hash"), norm.alias("norm"), order.alias("order"), F.monotonically_increasing_id().alias("deal"))
    rows = _in_buckets(rows, slots, depth).join(parts, "hash", "left").withColumn("part", F.coalesce(F.pmod("deal", "parts"), F.lit(0)).cast("int"))
    owned = rows.repartition("bucket", "part")
    differs, place = _chained(["bucket", "part", "hash"], "norm")
    owned = owned.withColumn("differs", differs).withColumn("place", place)
    owned = saved(owned.select("doc_id", "bucket", "hash", "part", "place", "order", "differs", F.when(F.col("differs"), F.unhex(F.sha2("norm", 256))).alias("sha"), F.when(F.col("differs") & F.col("parts").isNotNull(), F.col("norm")).alias("norm")), "owned")

    local = ["bucket", "hash", "part", "place"]
    differs, chain = _chained(["bucket", "hash"], "norm")
    met = owned.filter("differs and norm is not null").select(*local, "norm").withColumn("differs", differs).withColumn("chain", chain)
    met = saved(met.select(*local, "chain"), "met")
    chained = owned.drop("norm").join(met.hint("merge"), local, "left").withColumn("chain", F.coalesce("chain", "place")).drop("part", "place")
    # At most one entry of a text in each part: the digest that stays is any of them, they are of equal bytes.
    entry = ["bucket", "hash", "chain"]
    best = [F.max("order").alias("best"), F.count(F.lit(1)).alias("group_size"), *([F.max_by("doc_id", "order").alias("keep_row")] if row_col else [])]
    back = F.expr("best % cast('100000000000000000000' as decimal(21,0))")
    keep = F.when(back > 0, (F.lit(_TOP).cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)") - back).cast("long"))
    digests = chained.filter("differs").groupBy(*entry).agg(F.min("sha").alias("text_sha256"))
    entries = chained.groupBy(*entry).agg(*best).join(digests.hint("merge"), entry)
    index = saved(entries.select(*entry, "text_sha256", keep.alias("keep_id"), "group_size", *(["keep_row"] if row_col else [])), "index")
    return index, chained.select("doc_id", *entry)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index_options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
    index, rows = build_index(docs, id_col, text_col, **index_options)
    found = rows.join(index.select("bucket", "hash", "chain", "text_sha256", "keep_id", "group_size").hint("merge"), ["bucket", "hash", "chain"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index_options) -> DataFrame:
    """``docs`` with one row of those whose texts are copies of one another; all columns stay."""
    rows, names = keyed(docs)
    index, _ = build_index(rows, *(names[docs.columns.index(c)] for c in (id_col, text_col)), **index_options, row_col="row")
    kept = index.select(F.col("keep_row").alias("row")).hint("merge")  # one plan at every size
    return rows.join(kept, "row", "left_semi").select(*names).toDF(*docs.columns)


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
