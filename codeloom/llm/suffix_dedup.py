"""Removal of repeated byte strings by blockwise suffix sorting, one bucket of aligned suffixes at a time.

Cover sample.  A window of ``length`` bytes has one anchor, the place whose ``GRAM`` bytes have the smallest hash in it.
Equal windows have equal anchors at equal places, so, like a difference cover, the sample meets any two equal windows at
a common offset; unlike a fixed cover it takes about two places in ``length``, and two suffixes that do not share an
anchor's bytes never have to meet.

Buckets.  An anchor's context is what the windows that have it hold.  1. Contexts (as 128-bit hashes) are counted for each
anchor key: a context that occurs twice is repeated as a whole.  2. Only contexts that occur once, under a key that other
contexts have too, are compared as bytes.  Buckets of one key are dealt to tasks in order and sorted: the right parts
from the anchor on, and the reversed left parts, each by blocks of ``COVER`` bytes whose ties are resolved by the ranks
of the next cover place, computed from the far end.  Neighbours' common prefixes give, for each window, a class of its
left and one of its right part; a window is repeated if both classes are those of another one.  Tasks hold some thousand
contexts at a time.  3. A bucket of more than ``bucket`` contexts is split before it is sorted: by ranges of the place
that the anchor has in a window, and in each range by the bytes that all its windows must share.  Equal windows stay
together, and contexts that share no more than the anchor part.  Ranges shrink until every bucket can be sorted, or a
range is one place: there, equal windows are equal rows and are grouped by their bytes.
All repeated windows of a text are joined, cut out, and the rest is hashed.

A row is named by two 64-bit hashes of its id and text.  Context hashes are polynomials modulo 2**64, which texts of
1,024 bytes and more can be made to defeat; contexts are shorter than twice ``length``.

Results for odd input: null is the empty text; a text shorter than ``length`` bytes loses nothing; rows that repeat id and
text are repeats of each other; null ids stay null; very long texts are read in one piece, in memory that grows with the
longest of them; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._arrow import slices
from codeloom.llm._common import saved, ship
from codeloom.llm.shingles import U, mix, powers, prefix_sums

GRAM, COVER, SLICE, HELD, PARTS = 64, 40, 1 << 20, 3000, 8
NAME = ("r1", "r2")
_OTHER = mix(np.arange(1, 257, dtype=U)).astype(np.uint8)


def sliding(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width] for each i with a whole window."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: its place, text, most and least bytes between a window's begin and the
    anchor, key, and two hashes of the bytes that these windows hold."""
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none, none.astype(U), none.astype(U), none.astype(U))
    if len(data) < length:
        return empty
    s, t = prefix_sums(data), prefix_sums(_OTHER[data])
    back = powers(len(data) + 1)[1]
    n = len(data) - GRAM + 1
    key = mix((s[GRAM:] - s[:n]) * back[:n])
    bits = U(max(24, len(data).bit_length()))
    # The smallest key of a window, the leftmost of equal ones.
    least = sliding(key >> bits << bits | np.arange(n, dtype=U), length - GRAM + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    begin = np.flatnonzero(text[: len(least)] == text[length - 1 : length - 1 + len(least)])
    if not len(begin):
        return empty
    place = (least[begin] & ((U(1) << bits) - U(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    place, low, high = place[first], begin[first], begin[last] + length
    most, fewest = place - low, place - high + length
    shape = U(1000003) * most.astype(U) + fewest.astype(U)
    one, two = (mix(mix((x[high] - x[low]) * back[low]) + shape) for x in (s, t))
    return place, text[place], most, fewest, key[place], one, two


def _ranks(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ranks of (first, row) by blocks of COVER bytes, from the last block to the first."""
    n, width = rows.shape
    rank = np.zeros(n, np.int64)
    for c in range(width - COVER, -1, -COVER):
        block = np.unique(np.ascontiguousarray(rows[:, c : c + COVER]).view(f"V{COVER}").ravel(), return_inverse=True)[1]
        rank = np.unique(block.astype(np.int64) * n + rank, return_inverse=True)[1].astype(np.int64)
    return np.unique(np.unique(first, return_inverse=True)[1].astype(np.int64) * n + rank, return_inverse=True)[1]


def _classes(parts: list[bytes], key: np.ndarray, width: int) -> np.ndarray:
    """class[i, j]: equal for rows of one key whose first j bytes are equal (where both have so many)."""
    rows = np.zeros((len(parts), -(-width // COVER) * COVER), np.uint8)
    for i, p in enumerate(parts):
        rows[i, : len(p)] = np.frombuffer(p, np.uint8)
    size = np.array([len(p) for p in parts])
    order = np.lexsort((size, _ranks(rows, key)))
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common[key[order[1:]] != key[order[:-1]]] = -1
    steps = np.vstack([np.zeros((1, width + 1), np.int32), (common[:, None] < np.arange(width + 1)[None, :]).astype(np.int32)])
    out = np.empty((len(parts), width + 1), np.int32)
    out[order] = np.cumsum(steps, axis=0, dtype=np.int32)
    return out


def repeated_windows(key: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """[i, o]: the window that begins o bytes before anchor i occurs around another anchor of the same key.

    ``left`` is what stands before the anchor, reversed; ``right`` what begins with it.  Windows lie inside these, and o
    between ``low`` and ``high``.
    """
    n, o = len(key), np.arange(length - GRAM + 1)
    before, after = _classes(left, key, length - GRAM), _classes(right, key, length)
    valid = (o[None, :] <= np.array([len(x) for x in left])[:, None]) & (length - o[None, :] <= np.array([len(x) for x in right])[:, None])
    valid &= (o[None, :] >= low[:, None]) & (o[None, :] <= high[:, None])
    row, column = np.nonzero(valid)
    code = (column * n + before[row, column]) * n + after[row, length - column]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    hit = np.zeros(len(code), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    out = np.zeros(valid.shape, bool)
    out[row[hit], column[hit]] = True
    return out


def _spans(hit: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of each run of repeated windows."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return row, pos[row] - last, pos[row] - first + length


def _sample(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                place, own, most, fewest, *hashes = anchors(data, at, length)
                rows_of = [pa.array(np.asarray(part.column(c))[own]) for c in NAME]
                yield pa.RecordBatch.from_arrays([*rows_of, *(pa.array(x.astype(np.int32)) for x in (place - at[own], most, fewest)), *(pa.array(x.view(np.int64)) for x in hashes)], names=[*NAME, "pos", "most", "fewest", "key", "c1", "c2"])

    return rows.select(*NAME, "text").mapInArrow(run, "r1 long, r2 long, pos int, most int, fewest int, key long, c1 long, c2 long")


_PLACED = "key long, r1 long, r2 long, pos int, low int, high int, before binary, after binary"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=[f.split()[0] for f in _PLACED.split(", ")])


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """Bytes around the anchors that have to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out: list[tuple] = []
            for r1, r2, text, marks in zip(*(batch.column(c) for c in (*NAME, "text", "marks"))):
                if (r1.as_py(), r2.as_py()) == before:
                    continue  # rows of one name follow each other, and one of them speaks for all
                before = (r1.as_py(), r2.as_py())
                data = (text.as_py() or "").encode()
                for m in marks.as_py():
                    if m["compare"]:
                        p = m["pos"]
                        out.append((m["key"], r1.as_py(), r2.as_py(), p, 0, length - GRAM, data[p - m["most"] : p][::-1], data[p : p - m["fewest"] + length]))
            yield _placed(out)

    return texts.select(*NAME, "text", "marks").mapInArrow(run, _PLACED)


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    def spans(held: list[tuple]) -> pa.RecordBatch:
        low, high = (np.array([r[i] for r in held]) for i in (4, 5))
        hit = repeated_windows(np.array([r[0] for r in held]), [r[6] for r in held], [r[7] for r in held], low, high, length)
        row, begin, end = _spans(hit, np.array([r[3] for r in held], np.int64), length)
        names = [pa.array(np.array([r[i] for r in held])[row], pa.int64()) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([*names, pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=[*NAME, "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= HELD and row[0] != held[-1][0]:
                    yield spans(held)
                    held = []
                held.append(row)
        if held:
            yield spans(held)

    return contexts.repartition("key").sortWithinPartitions("key", *NAME, "pos").mapInArrow(run, _SPANS)


_SPANS = "r1 long, r2 long, begin long, end long"


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """Each context once for each part of its range of places, under a key of the bytes that all windows there share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, r1, r2, pos, low, high, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                width = -(-(high - low + 1) // PARTS)
                for a in range(low, high + 1, width):
                    b = min(a + width - 1, high)
                    if len(before) >= a and len(after) >= length - b:
                        name = hashlib.blake2b(b"%d %d %d " % (key, a, b) + before[:a] + after[: length - b], digest_size=8).digest()
                        out.append((int.from_bytes(name, "little", signed=True), r1, r2, pos, a, b, before[:b], after[: length - a]))
            yield _placed(out)

    return contexts.mapInArrow(run, _PLACED)


def _compared(contexts: DataFrame, length: int, bucket: int) -> DataFrame:
    """Spans of the repeated windows of all contexts."""
    spans = contexts.sparkSession.createDataFrame([], _SPANS)
    while True:
        fullness = saved(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "fullness")
        spans = spans.unionByName(_sorted_buckets(contexts.join(fullness.filter(F.col("m").between(2, bucket)).select("key").hint("merge"), "key", "left_semi"), length))
        full = fullness.filter(F.col("m") > bucket).select("key")
        if full.isEmpty():
            return spans
        rest = contexts.join(full.hint("merge"), "key", "left_semi")
        single = rest.filter("low = high")
        often = single.groupBy("low", "before", "after").count().filter("count > 1").select("low", "before", "after")
        begin = F.col("pos").cast("long") - F.col("low")
        spans = spans.unionByName(single.join(often.hint("merge"), ["low", "before", "after"]).select(*NAME, begin.alias("begin"), (begin + length).alias("end")))
        contexts = saved(_split(rest.filter("low < high"), length), "split")


def _cut(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, text, marks, more in zip(*(batch.column(c) for c in ("doc_id", "text", "marks", "spans"))):
                data = (text.as_py() or "").encode()
                spans = [(s["begin"], s["end"]) for s in more.as_py() or ()]
                for m in marks.as_py() or ():
                    if m["whole"]:
                        spans.append((m["pos"] - m["most"], m["pos"] - m["fewest"] + length))
                kept, at, runs = [], 0, 0
                for begin, end in sorted(spans):
                    if begin > at or not runs:
                        kept.append(data[at:begin])
                        runs += 1
                    at = max(at, end)
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((name.as_py(), len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, bucket: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ship(docs.sparkSession)
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    docs = docs.select(own.alias("doc_id"), text.alias("text"), F.xxhash64(own, text).alias("r1"), F.xxhash64(text, F.lit("row"), own).alias("r2"))
    sample = saved(_sample(docs, length), "anchors")
    contexts = saved(sample.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("holder")), "contexts")
    keys = contexts.groupBy("key").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different")).filter("all > 1")
    shared = contexts.join(keys.hint("merge"), "key").select("key", "c1", "c2", "n", "holder", "different")
    # Of a context that occurs more than once, that of one row is compared with others (or of rows that repeat it).
    marks = sample.join(shared.hint("merge"), ["key", "c1", "c2"]).select(*NAME, F.struct("pos", "most", "fewest", "key", (F.col("n") > 1).alias("whole"), ((F.col("different") > 1) & (F.col("r1") == F.col("holder"))).alias("compare")).alias("mark"))
    marks = marks.groupBy(*NAME).agg(F.collect_set("mark").alias("marks"))  # of rows that repeat each other, once
    joined = docs.join(marks.hint("merge"), list(NAME), "left")
    some = F.col("marks").isNotNull()
    joined = saved(joined.select("doc_id", *NAME, F.octet_length("text").cast("long").alias("n_bytes"), F.when(~some, F.sha2("text", 256)).alias("sha"), F.when(some, F.col("text")).alias("text"), "marks"), "marked")

    compared = saved(_contexts(joined.filter(F.exists("marks", lambda m: m["compare"])), length), "compared")
    spans = saved(_compared(compared, length, bucket), "spans")
    spans = spans.groupBy(*NAME).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    texts = joined.filter("marks is not null").select(*NAME, "doc_id", "text", "marks")
    cut = _cut(texts.join(spans.hint("merge"), list(NAME), "left").select("doc_id", "text", "marks", "spans"), length)
    clean = joined.filter("marks is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return cut.unionByName(clean)
