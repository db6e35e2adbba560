"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every text becomes its set of word shingles and a MinHash signature; texts with equal sets form one class at once.
2. Signatures of the classes are cut into bands; classes that share a band meet in a bucket.
3. Each bucket pairs its members with its smallest one.  Signatures of a pair are compared batch by batch; the pair is
   pruned as soon as the posterior probability that its similarity reaches the threshold falls below ``miss``.
   Survivors are verified exactly on full sets.  Verified links make components, survivors make (larger) families.
4. A family with several components has untried pairs.  Its members are dealt into blocks, a large component into blocks
   of its own; a cell of two blocks compares members of different components by the same pruning and verification and
   stops at what its own links have joined, so it returns fewer links than it has members.  Blocks of one component never
   meet.
5. Buckets with members of several families are compared between families in the same way.
Pairs inside one component cannot change the result and are never made, so groups of copies cost time in proportion to
their size.

Banding leaves a pair at the threshold out with probability (1 - t**rows)**bands (7e-6 for 0.85 and 16 bands of 4).

Results for odd input: null, empty and white-space-only texts have the empty set and are linked with nothing; rows with
a null id are not linked by similarity and are kept only as their own component where all equal sets have null ids;
rows that repeat an id share its component; an empty table gives no rows; other columns are never read.  This holds for
``near_groups``; ``drop_near_copies`` groups by a key of each row, so repeated and null ids are rows like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._arrow import slices
from codeloom.llm._common import keyed, saved, ship
from codeloom.llm.components import components
from codeloom.llm.shingles import U, mix, sets

SLICE, ROWS, STEP, BLOCK = 1 << 20, 4, 16, 128


def permutations(slots: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, slots, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, slots, dtype=np.uint32)


def signatures(found: list[np.ndarray], slots: int) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row each."""
    at = np.cumsum([0, *map(len, found)])
    x = (np.concatenate(found) >> U(32)).astype(np.uint32) if found else np.zeros(0, np.uint32)
    out = np.empty((len(found), slots), np.uint32)
    for k, (a, b) in enumerate(zip(*permutations(slots))):
        out[:, k] = np.minimum.reduceat(x * a + b, at[:-1]) if found else 0
    return out


def fewest_matches(threshold: float, miss: float, slots: int) -> dict[int, int]:
    """After n compared slots: the fewest matches with which a pair stays.

    With a uniform prior, the posterior probability that the similarity reaches t after m of n matches is that of at
    most m successes in n + 1 trials of chance t.
    """
    out = {}
    for n in range(STEP, slots + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                out[n] = m
                break
    return out


def _sketch(docs: DataFrame, width: int, slots: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                found = sets(data, at, width)
                full = [i for i, s in enumerate(found) if len(s)]
                sig = signatures([found[i] for i in full], slots)
                marks = np.zeros((len(found), 2), np.int64)
                raw: list = [None] * len(found)
                for row, i in enumerate(full):
                    marks[i] = np.array([found[i].sum(), mix(found[i] ^ U(0x5851F42D4C957F2D)).sum()], U).view(np.int64)
                    raw[i] = sig[row].tobytes()
                columns = [part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary")


def _bands(classes: DataFrame, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, bands, ROWS).astype(U)
                key = np.broadcast_to(np.arange(bands, dtype=U), sig.shape[:2])
                for k in range(ROWS):
                    key = mix(key + sig[:, :, k] * U(0x9E3779B97F4A7C15))
                rep = np.repeat(np.asarray(batch.column("rep")), bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep)], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _surviving(x: np.ndarray, y: np.ndarray, fewest: dict[int, int]) -> np.ndarray:
    """Which rows of two signature tables stay after all batches of slots."""
    alive, seen = np.arange(len(x)), np.zeros(len(x), np.int32)
    for n in sorted(fewest):
        seen = seen + (x[alive, n - STEP : n] == y[alive, n - STEP : n]).sum(axis=1)
        stay = seen >= fewest[n]
        alive, seen = alive[stay], seen[stay]
    return alive


def _prune(pairs: DataFrame, classes: DataFrame, fewest: dict[int, int]) -> DataFrame:
    """Pairs (a, b) that the posterior bounds do not rule out."""
    one = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stay = pa.array(_surviving(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), fewest))
                yield batch.select(["a", "b"]).take(stay)

    return pairs.join(two, "b").join(one, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= per_cent * union.

    The members of a centre a are dealt out in parts of about BLOCK rows; each part gets the centre's text once.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    members = pairs.join(parts, "a").join(texts, pairs["b"] == texts["id"]).select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("place"), "b", "text")
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts, F.col("a") == texts["id"]).select("a", "part", F.lit(0).alias("place"), F.col("a").alias("b"), "text")
    dealt = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, []
        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                links = []
                rows = zip(*(part.column(c).to_pylist() for c in ("a", "part", "place", "b")), sets(data, at, width))
                for a, p, place, b, s in rows:
                    if place == 0:
                        own = [*own, s] if centre == (a, p) else [s]
                        centre = (a, p)
                        continue
                    for c in own:
                        both = len(np.intersect1d(c, s, assume_unique=True))
                        if len(s) and 100 * both >= per_cent * (len(c) + len(s) - both):
                            links.append((a, b))
                            break
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _inside(placed: DataFrame, classes: DataFrame, texts: DataFrame, fewest: dict[int, int], width: int, per_cent: int) -> DataFrame:
    """Links between members of different kinds in each group; ``placed``: grp, rep, kind, component.

    Pairs of one component are skipped, and so are those that links found in the cell have joined by then.
    """
    sizes = placed.groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("all"), F.sum(F.when(F.col("m") < BLOCK, F.col("m")).otherwise(0)).alias("small")).filter("k > 1 and all > 2")
    whole = F.col("m") >= BLOCK
    parts = F.ceil(F.when(whole, F.col("m")).otherwise(F.col("small")) / BLOCK).cast("int")
    dealt = placed.join(sizes.join(mixed.select("grp", "small"), "grp"), ["grp", "kind"])
    dealt = saved(dealt.select("grp", "rep", "kind", "component", F.when(whole, F.col("kind")).alias("pure"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part")), "dealt")
    blocks = dealt.select("grp", "pure", "part").distinct()
    one, two = (blocks.select("grp", *(F.col(c).alias(f"{c}{k}") for c in ("pure", "part"))) for k in (1, 2))
    rank1, rank2 = (F.struct(F.coalesce(f"pure{k}", F.lit(-1)), f"part{k}") for k in (1, 2))
    apart = F.col("pure1").isNull() | F.col("pure2").isNull() | (F.col("pure1") != F.col("pure2"))
    cells = saved(one.join(two, "grp").filter((rank1 <= rank2) & apart).withColumn("cell", F.monotonically_increasing_id()), "cells")
    ends = cells.select("grp", "cell", F.col("pure1").alias("pure"), F.col("part1").alias("part")).union(cells.select("grp", "cell", "pure2", "part2")).distinct()
    same = (dealt["grp"] == ends["grp"]) & (dealt["part"] == ends["part"]) & dealt["pure"].eqNullSafe(ends["pure"])
    rows = dealt.join(ends, same).select("cell", "kind", "component", "rep")
    rows = rows.join(classes, "rep").join(texts, F.col("rep") == F.col("id")).select("cell", "kind", "component", "rep", "sig", "text").repartition("cell").sortWithinPartitions("cell", "rep")

    def links(held: list[tuple]) -> Iterator[tuple[int, int]]:
        sig = np.frombuffer(b"".join(r[4] for r in held), np.uint32).reshape(len(held), -1)
        root = {r[2]: r[2] for r in held}

        def top(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        kind = np.array([r[1] for r in held])
        p, q = np.nonzero(np.triu(kind[:, None] != kind[None, :], 1))
        stay = _surviving(sig[p], sig[q], fewest)
        p, q = p[stay], q[stay]
        order = np.argsort(-(sig[p] == sig[q]).sum(axis=1), kind="stable")
        for x, y in zip(p[order].tolist(), q[order].tolist()):
            a, b = top(held[x][2]), top(held[y][2])
            if a != b:
                s, t = held[x][5], held[y][5]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= per_cent * (len(s) + len(t) - both):
                    root[max(a, b)] = min(a, b)
                    yield held[x][3], held[y][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            if found := list(links(held)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                for row in zip(*(part.column(k).to_pylist() for k in range(5)), sets(data, at, width)):
                    if held and row[0] != held[0][0]:
                        yield from out()
                        held = []
                    held.append(row)
        if held:
            yield from out()

    return rows.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, per_cent: int = 80, bands: int = 24, miss: float = 1e-6) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    slots = bands * ROWS
    fewest = fewest_matches(per_cent / 100, miss, slots)
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    sketch = saved(_sketch(docs, width, slots), "sketch")
    equal = sketch.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    joined = sketch.filter("n > 0").join(equal, ["f1", "f2", "n"])
    members = saved(joined.select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")), "members")
    classes = members.filter("sig is not null").select("rep", "sig")

    banded = saved(_bands(classes, bands), "bands")
    buckets = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("m")).filter("centre <> last")
    grouped = saved(banded.join(buckets.drop("last"), "key"), "buckets")
    ids = grouped.select(F.col("rep").alias("id")).distinct()
    texts = saved(docs.join(ids.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")  # one plan at every size
    star = saved(_prune(grouped.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), classes, fewest), "pairs")
    links = saved(_verify(star, texts, width, per_cent), "links")
    groups = components(links)

    families = components(star).withColumnRenamed("component", "family")
    component = F.coalesce("component", "rep").alias("component")
    inside = families.join(groups, "node", "left").select(F.col("family").alias("grp"), F.col("node").alias("rep"), F.coalesce("component", "node").alias("kind"), F.coalesce("component", "node").alias("component"))

    # Buckets whose members are of several families, and more than the pairs with their centre.
    kinds = grouped.filter("m > 2").join(families, grouped["rep"] == families["node"], "left").select("key", "rep", F.coalesce("family", "rep").alias("kind"))
    across = kinds.join(groups, kinds["rep"] == groups["node"], "left").select(F.col("key").alias("grp"), "rep", "kind", component)
    found = [_inside(saved(x, "placed"), classes, texts, fewest, width, per_cent) for x in (inside, across)]
    found = saved(found[0].unionByName(found[1]), "links")
    if not found.isEmpty():
        groups = components(links.unionByName(found))

    linked = members.join(groups, members["rep"] == groups["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    empty = sketch.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id (null last); all columns stay."""
    rows, names = keyed(docs)
    own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    groups = near_groups(rows, "row", text, **options).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", F.col(own).cast("long").alias("id"))
    kept = groups.join(ids.hint("merge"), "row").groupBy("component_id").agg(F.coalesce(F.min_by("row", "id"), F.min("row")).alias("row"))
    return rows.join(kept.select("row").hint("merge"), "row", "left_semi").select(*names).toDF(*docs.columns)
