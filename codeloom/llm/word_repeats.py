"""Removal of repeated word spans through a compacted de Bruijn graph over words.

An edge is a window of ``window`` words; it leads from the node of its first ``window - 1`` words to that of its last.

1. Edges by contexts.  Each window has a least ``GRAM``-word hash, its key; neighbouring windows with the same one are a
   context, written as one row (key, two hashes of all its words, place, number of edges, the words before and behind).
   Equal contexts are counted; a key that only one document has can belong to no repeated edge.
2. A key with a single context is a path of edges that never part.  Where a key has several, the edges of each different
   context are written out once, by the first row that holds it, and grouped by their hashes.
   Every edge gets its source coordinate, the smallest (doc_id, row, place) of all its occurrences, and whether one and
   the same word precedes, and one follows, all of them; the begin and the end of a document count as words of their own.
3. Compaction.  Two edges in a row are joined where the first has one follower and the second one predecessor.  All
   occurrences of a joined path then run through the whole of it, so its edges' source coordinates follow each other, and
   paths are found as runs of these in one pass.
4. Paths are joined with the contexts, and these with the sample, which gives every occurrence of every path.  Where its
   source coordinate is of a smaller doc_id, the occurrence is a repeat.
5. Verification.  Texts that hold paths are read again and cut; a digest of the words of every path, at its source
   coordinate and at each occurrence, must be the same, or the job fails: two different spans share all hashes then.

Equal texts (as word sequences) are known by their SHA-256: only the rows of the smallest doc_id among them are joined
with paths; the others lose all their words, if they have a window.

Results for odd input: null and white-space-only texts have no words; a text shorter than a window loses nothing; rows
that repeat a doc_id are one document, so its windows never count against each other; a null id counts as larger than all
others, and stays null; very long texts are read in one piece, in memory that grows with the longest of them; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from codeloom.llm._arrow import slices
from codeloom.llm._common import release, saved, ship
from codeloom.llm.shingles import U, bounds, hashed, mix, powers
from codeloom.llm.suffix_dedup import sliding

GRAM, SLICE = 12, 1 << 20
NAME = ("doc", "r")
LAST = 9223372036854775807
BLANK = r"[\x20\x09-\x0D]+"


#: Other values for bytes, each its own, for the second hash of a word.
_OTHER = ((np.arange(256) * 167 + 13) % 256).astype(np.uint8)


class _Words:
    """Two hashes of each word of some texts, and of runs of words."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        begin, end = bounds(data, at) if len(data) else (np.zeros(0, np.int64),) * 2
        self.n, self.before = len(begin), np.searchsorted(begin, at)
        self.hashes = (hashed(data, begin, end), hashed(_OTHER[data], begin, end)) if self.n else (np.zeros(0, U),) * 2
        up, self.back = powers(self.n + 1)
        self.sums = tuple(np.concatenate([np.zeros(1, U), np.cumsum(w * up[: self.n], dtype=U)]) for w in self.hashes)

    def runs(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words from ``begin`` to ``end``."""
        return tuple(mix((s[end] - s[begin]) * self.back[begin]) for s in self.sums)


def contexts(w: _Words, window: int) -> dict[str, np.ndarray]:
    """Of each run of windows with one key: text, place and number of windows, key, hashes, words before and behind (0: none)."""
    names = ("text", "pos", "n", "key", "c1", "c2", "prev", "next")
    gram = min(GRAM, window)
    if w.n < window:
        return {k: np.zeros(0, np.int64) for k in names}
    begins = np.arange(w.n - gram + 1)
    key = w.runs(begins, begins + gram)[0]
    bits = U(max(24, w.n.bit_length()))
    # The smallest key of a window, the leftmost of equal ones.
    least = sliding(key >> bits << bits | begins.astype(U), window - gram + 1)
    text = np.repeat(np.arange(len(w.before) - 1), np.diff(w.before))
    begin = np.flatnonzero(text[: len(least)] == text[window - 1 : window - 1 + len(least)])
    if not len(begin):
        return {k: np.zeros(0, np.int64) for k in names}
    place = (least[begin] & ((U(1) << bits) - U(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    low, high, place = begin[first], begin[last], place[first]
    own, n, end = text[low], high - low + 1, high + window
    shape = (U(1000003) * (place - low).astype(U) + n.astype(U)) * U(0x9E3779B97F4A7C15)
    c1, c2 = (mix(x + shape) for x in w.runs(low, end))
    one = w.hashes[0]
    prev = np.where(low > w.before[own], one[np.maximum(low - 1, 0)], U(0))
    behind = np.where(end < w.before[own + 1], one[np.minimum(end, w.n - 1)], U(0))
    return dict(zip(names, (own, low - w.before[own], n, key[place], c1, c2, prev, behind)))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_SAMPLE = "doc long, r long, pos int, n int, key long, c1 long, c2 long, prev long, next long"


def _sample(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                c = contexts(_Words(data, at), window)
                own = [pa.array(np.asarray(part.column(k))[c["text"]]) for k in NAME]
                short = [pa.array(c[k].astype(np.int32)) for k in ("pos", "n")]
                yield pa.RecordBatch.from_arrays([*own, *short, *(_long(c[k]) for k in ("key", "c1", "c2", "prev", "next"))], names=[f.split()[0] for f in _SAMPLE.split(", ")])

    return docs.select(*NAME, "text").mapInArrow(run, _SAMPLE)


_EDGES = "key long, e1 long, e2 long, c1 long, c2 long, at int, doc long, r long, pos int, last long, pmin long, pmax long, nmin long, nmax long"


def _edges(texts: DataFrame, window: int) -> DataFrame:
    """The edges of the contexts in ``marks``, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                w = _Words(data, at)
                marks = part.column("marks")
                own = np.repeat(np.arange(part.num_rows), np.asarray(marks.value_lengths()))
                fields = dict(zip((f.name for f in marks.type.value_type), (np.asarray(x) for x in marks.flatten().flatten())))
                n = fields["n"].astype(np.int64)
                mark = np.repeat(np.arange(len(own)), n)
                step = np.arange(len(mark)) - np.repeat(np.cumsum(n) - n, n)
                pos = fields["pos"][mark] + step
                begin = w.before[own[mark]] + pos
                e1, e2 = w.runs(begin, begin + window)
                one = w.hashes[0].view(np.int64)
                before, behind = one[np.maximum(begin - 1, 0)], one[np.minimum(begin + window, max(w.n - 1, 0))]
                head, tail = step == 0, step == n[mark] - 1
                ends = {k: np.where(head if k[0] == "p" else tail, fields[k][mark], before if k[0] == "p" else behind) for k in ("pmin", "pmax", "nmin", "nmax")}
                names = {k: np.asarray(part.column(k))[own[mark]] for k in NAME}
                columns = {"key": fields["key"][mark], "e1": e1.view(np.int64), "e2": e2.view(np.int64), "c1": fields["c1"][mark], "c2": fields["c2"][mark], "at": step.astype(np.int32), **names, "pos": pos.astype(np.int32), "last": fields["last"][mark], **ends}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))

    return texts.select(*NAME, "text", "marks").mapInArrow(run, _EDGES)


def _paths(pieces: DataFrame) -> DataFrame:
    """``pieces`` (own, n, prev, next, ...) with the path each belongs to: its source coordinate and length; ``off``: where in it."""
    rows = W.Window.partitionBy("own.doc", "own.r").orderBy("own.pos")
    joins = (F.lag("own.pos").over(rows) + F.lag("n").over(rows) == F.col("own.pos")) & F.lag("next").over(rows).isNotNull() & F.col("prev").isNotNull()
    begin = F.when(F.coalesce(joins, F.lit(False)), None).otherwise(F.col("own.pos"))
    found = pieces.withColumn("begin", begin).withColumn("begin", F.last("begin", True).over(rows.rowsBetween(W.Window.unboundedPreceding, 0)))
    path = F.struct(F.col("own.doc").alias("doc"), F.col("own.r").alias("r"), F.col("begin").alias("pos"))
    return found.select("*", path.alias("path"), (F.col("own.pos") - F.col("begin")).alias("off"))


def _graph(sample: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """key, c1, c2, rel, n, path, off: each run of a path's edges in each context, for paths of at least two documents."""
    agg = [F.min("prev").alias("pmin"), F.max("prev").alias("pmax"), F.min("next").alias("nmin"), F.max("next").alias("nmax")]
    own = F.min(F.struct("doc", "r", "pos")).alias("own")
    found = saved(sample.groupBy("key", "c1", "c2").agg(own, F.max("doc").alias("last"), F.max("n").alias("n"), *agg), "contexts")
    keys = found.groupBy("key").agg(F.min("own.doc").alias("lo"), F.max("last").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi")
    shared = saved(found.join(keys.select("key", "m").hint("merge"), "key"), "shared")
    release(found)

    alone = shared.filter("m = 1")
    several = shared.filter("m > 1").select(F.col("own.doc").alias("doc"), F.col("own.r").alias("r"), F.struct(F.col("own.pos").alias("pos"), "n", "key", "c1", "c2", "last", "pmin", "pmax", "nmin", "nmax").alias("mark"))
    marks = several.groupBy(*NAME).agg(F.collect_list("mark").alias("marks"))  # of one row: as many as its windows at most
    edges = saved(_edges(docs.join(marks.hint("merge"), list(NAME)), window), "edges")
    both = [F.min("pmin").alias("pmin"), F.max("pmax").alias("pmax"), F.min("nmin").alias("nmin"), F.max("nmax").alias("nmax")]
    grouped = edges.groupBy("key", "e1", "e2").agg(own, F.max("last").alias("last"), *both).filter("own.doc <> last")
    one = [F.when((F.col(f"{k}min") == F.col(f"{k}max")) & (F.col(f"{k}min") != 0), F.col(f"{k}min")).alias(name) for k, name in (("p", "prev"), ("n", "next"))]
    pieces = grouped.select("key", "e1", "e2", "own", F.lit(1).alias("n"), *one).unionByName(alone.select("key", F.col("c1").alias("e1"), F.col("c2").alias("e2"), "own", "n", *one))
    paths = saved(_paths(pieces).select("key", "e1", "e2", "n", "path", "off"), "paths")

    whole = alone.select("key", "c1", "c2").join(paths.hint("merge"), (alone["key"] == paths["key"]) & (alone["c1"] == paths["e1"]) & (alone["c2"] == paths["e2"]))
    whole = whole.select(alone["key"], "c1", "c2", F.lit(0).alias("rel"), "n", "path", "off")
    met = edges.select("key", "e1", "e2", "c1", "c2", "at").join(paths.hint("merge"), ["key", "e1", "e2"])
    met = met.groupBy("key", "c1", "c2", "path", (F.col("at") - F.col("off")).alias("shift")).agg(F.min("at").alias("rel"), (F.max("at") - F.min("at") + 1).alias("n"), F.min("off").alias("off"))
    met = saved(whole.unionByName(met.select(*whole.columns)), "met")
    release(shared, edges, paths)
    return met


_CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, proofs array<struct<doc:long, r:long, pos:int, digest:long>>"
_PROOF = pa.struct([("doc", pa.int64()), ("r", pa.int64()), ("pos", pa.int32()), ("digest", pa.int64())])


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """Texts without their repeated words, and a digest of the words of each path that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "text", SLICE):
                out: list[list] = [[] for _ in range(5)]
                for doc_id, text, spans in zip(*(part.column(c) for c in ("doc_id", "text", "spans"))):
                    tokens = text.as_py().encode().split()
                    cover, proofs = np.zeros(len(tokens) + 1, np.int64), []
                    for s in spans.as_py():
                        begin, end = s["begin"], s["begin"] + s["n"] + window - 1
                        digest = hashlib.blake2b(b" ".join(tokens[begin:end]), digest_size=8).digest()
                        proofs.append(s["path"] | {"digest": int.from_bytes(digest, "little", signed=True)})
                        if s["repeat"]:
                            cover[begin] += 1
                            cover[end] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = b" ".join([tokens[i] for i in np.flatnonzero(~gone).tolist()])
                    for column, value in zip(out, (doc_id.as_py(), len(tokens), int(gone.sum()), hashlib.sha256(kept).hexdigest(), proofs)):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_PROOF))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "proofs"])

    return texts.select("doc_id", "text", "spans").mapInArrow(run, _CUT)


def _occurrences(sample: DataFrame, graph: DataFrame) -> DataFrame:
    """doc, r, begin, n, path, repeat: where each path begins in each row, and its own source coordinate."""
    found = sample.select(*NAME, "pos", "key", "c1", "c2").join(graph.hint("merge"), ["key", "c1", "c2"])
    found = found.select(*NAME, "path", (F.col("pos") + F.col("rel") - F.col("off")).alias("begin"), (F.col("off") + F.col("n")).alias("n"))
    repeat = F.col("path.doc") < F.col("doc")
    source = (F.col("path.doc") == F.col("doc")) & (F.col("path.r") == F.col("r")) & (F.col("path.pos") == F.col("begin"))
    # A path may lie in several contexts: the last of them ends it.
    return found.filter(repeat | source).groupBy(*NAME, "path", "begin").agg(F.max("n").alias("n")).withColumn("repeat", repeat)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""
    ship(docs.sparkSession)
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    docs = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("r"), text.alias("text"))
    joined = F.btrim(F.regexp_replace("text", BLANK, " "))
    size = F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1).cast("long")
    rows = saved(docs.select("doc_id", *NAME, size.alias("n_words"), F.sha2(joined, 256).alias("sha")), "rows")
    sample = saved(_sample(docs, window), "sample")
    graph = _graph(sample, docs, window)
    occurrences = _occurrences(sample, graph)

    first = rows.groupBy("sha").agg(F.min("doc").alias("first"))
    rows = saved(rows.join(first.hint("merge"), "sha"), "rows")
    kept = rows.filter((F.col("doc") == F.col("first")) & (F.col("n_words") >= window)).select(*NAME)
    spans = occurrences.join(kept.hint("merge"), list(NAME), "left_semi").groupBy(*NAME).agg(F.collect_list(F.struct("begin", "n", "repeat", "path")).alias("spans"))  # of one row
    spans = saved(spans, "spans")
    release(sample, graph)
    cut = saved(_cut(docs.join(spans.hint("merge"), list(NAME)), window), "cut")

    proofs = cut.select(F.explode("proofs").alias("p")).select("p.*")
    if not proofs.groupBy("doc", "r", "pos").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").isEmpty():
        raise RuntimeError("two different spans of words share all their hashes")
    whole = rows.join(spans.select(*NAME).hint("merge"), list(NAME), "left_anti")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= window)
    removed = F.when(copy, F.col("n_words")).otherwise(F.lit(0).cast("long"))
    whole = whole.select("doc_id", "n_words", removed.alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"))
    return cut.drop("proofs").unionByName(whole)
