"""Quality classifier: n-gram indicators scaled by log-count ratios, and a linear hinge-loss model on them.

Fitting.  At most ``sample`` labelled documents of the folds that may be learned from are taken, those with the smallest
hash of their id, and of these as many as have ``sample_bytes`` of text together (a bounded sample, these parameters are
its bounds; rows that repeat an id count once); their texts' n-gram buckets are made on the executors.
Log-count ratios r = log(p / q) come from smoothed indicator counts of the two classes; a document is the unit vector
of r over its n-grams, plus a constant.  The dual of the hinge loss is solved by coordinate descent.  A fifth of the sample
is left out of that and fits the logistic curve that turns margins into scores.

Scoring reads every row and whole text, on the executors, with the weights sent along (2**18 numbers, fixed size).

Results for odd input: null, empty and very short texts have no n-grams and get the score of the constant; rows without
a label, with a null id or a null quality are never learned from; a document with several labels counts with their mean
(1 from one half on); with fewer than two labelled classes every score is the share of label 1 (0.5 without labels);
repeated rows each get a row; very long texts are scored whole, in memory that grows with the longest of them, and leave
the sample where they exceed its bytes; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._arrow import slices
from codeloom.llm._common import numbered, ship
from codeloom.llm.ngrams import BITS, Indicators, hashed
from codeloom.llm.vocabulary import HELD, vocabulary

SLICE = 1 << 21


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


@dataclass
class Model:
    """score = logistic(slope * margin + shift); margin = (weight . r over the n-grams) / |r over them| + bias."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def __post_init__(self) -> None:
        self.products = (self.ratio * self.weight).astype(np.float32)
        self.squares = (self.ratio * self.ratio).astype(np.float32)

    def margin(self, grams: np.ndarray) -> float:
        norm = float(self.squares[grams].sum()) ** 0.5
        return float(self.products[grams].sum()) / norm + self.bias if norm else self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.asarray(margin, float) + self.shift, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int = 64 << 20) -> list:
    """Rows (label columns, grams) of the sample; ``labels``: doc_id and one row for each labelled document."""
    ship(docs.sparkSession)
    ids = labels.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = {r.doc_id: r for r in ids.collect()}  # in the order of their hashes

    def picked(names: list[int]) -> DataFrame:
        wanted = docs.sparkSession.createDataFrame([(i,) for i in names], "doc_id long")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        return rows.join(F.broadcast(wanted), "doc_id")  # ``sample`` rows at most

    sizes = dict(picked(list(found)).groupBy("doc_id").agg(F.max(F.octet_length("text"))).collect()) if found else {}
    names, held = [], 0
    for i in found:
        if i in sizes and held + sizes[i] <= sample_bytes:
            names.append(i)
            held += sizes[i]
    schema = "doc_id long, grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            for part, data, at in slices(batch, "text", SLICE):
                grams = [indicators.of(hashed(data[a:b])).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(grams, pa.binary())], names=["doc_id", "grams"])

    if not names:
        return []
    once = picked(names).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = [(found[r.doc_id], np.frombuffer(r.grams, np.int32)) for r in once.mapInArrow(run, schema).collect()]
    return sorted(rows, key=lambda r: r[0].doc_id)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int = 7, least: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on unit vectors of ``ratio`` and a constant; returns weights and bias.

    Minimises |w|**2 / 2 + sum_i c_i max(0, 1 - y_i w.x_i) with c_i so that both classes weigh alike, until a whole round
    moves no coordinate by more than ``least`` of its bound.
    """
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = []
    for g in rows:
        v = ratio[g]
        n = float(np.sqrt(v @ v))
        values.append(v / n if n else v)
    share = max(1.0, len(y)) / 2
    most_of = {s: c * share / max(1, int((y == s).sum())) for s in (-1.0, 1.0)}
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            g, v, s = rows[i], values[i], y[i]
            most = most_of[s]
            gradient = s * (float(w[g] @ v) + bias) - 1
            if (alpha[i] == 0 and gradient >= 0) or (alpha[i] == most and gradient <= 0):
                continue
            new = min(max(0.0, alpha[i] - gradient / (float(v @ v) + 1)), most)
            step = (new - alpha[i]) * s
            alpha[i] = new
            w[g] += step * v
            bias += step
            moved = max(moved, abs(step) / most)
        if moved <= least:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins with labels 0/1, by Newton steps with a light ridge."""
    if not 0 < y.sum() < len(y):
        return 2.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, r = np.maximum(p * (1 - p), 1e-9), p - y
        ga, gb = float(r @ margin) + 0.01 * a, float(r.sum()) + 0.01 * b
        haa, hab, hbb = float(d @ margin**2) + 0.01, float(d @ margin), float(d.sum()) + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return (a, b) if a > 0 else (2.0, 0.0)


def fit(rows: list[np.ndarray], y01: np.ndarray, c: float = 1.0, epochs: int = 30) -> Model:
    """Fit on rows of n-gram buckets with labels 0/1."""
    y01 = np.asarray(y01, float)
    if not len(y01) or y01.min() == y01.max():
        share = min(max(float(y01.mean()) if len(y01) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    learn = np.arange(len(rows)) % 5 != 0
    if len(np.unique(y01[learn])) < 2:
        learn[:] = True
    counts = np.ones((2, 1 << BITS))
    for g, y, use in zip(rows, y01, learn):
        if use:
            counts[int(y), g] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    own = np.flatnonzero(learn)
    weight, bias = descend([rows[i] for i in own], y01[own] * 2 - 1, ratio, c, epochs)
    model = Model(ratio.astype(np.float32), weight.astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(~learn) if not learn.all() else own
    model.slope, model.shift = logistic_curve(np.array([model.margin(rows[i]) for i in rest]), y01[rest])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model:
    """Learn ``labels.quality`` from the folds that are not held out."""
    marks = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = labelled_sample(docs, marks.filter(fold(F.col("doc_id")) != 1), sample)
    return fit([g for _, g in rows], np.array([r.y for r, _ in rows]))


def scored(batches: Iterator[pa.RecordBatch], models: list[Model], names: list[str], more: tuple[str, ...], tokenizer: str | None = None, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Batches with the columns ``more``, with a tokenizer n_tokens of the column ``__text``, and each model's score of it."""
    indicators = Indicators()
    rows = np.column_stack([x for m in models for x in (m.products, m.squares)])  # a gram's numbers stand together
    bias = np.array([m.bias for m in models])
    for batch in batches:
        for part, data, at in slices(batch, "__text", SLICE):
            margins = np.empty((len(models), len(at) - 1))
            for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                grams = indicators.of(hashed(data[a:b]))
                sums = (np.ones(len(grams), np.float32) @ rows.take(grams, axis=0)).astype(float)
                norms = np.sqrt(sums[1::2])
                margins[:, i] = np.divide(sums[::2], norms, out=np.zeros(len(models)), where=norms > 0) + bias
            columns = [part.column(c) for c in more]
            tokens = [pa.array(vocabulary(tokenizer, held).counts([t or "" for t in part.column("__text").to_pylist()]), pa.int64())] if tokenizer else []
            columns += [*tokens, *(pa.array(m.score(margins[k]), pa.float64()) for k, m in enumerate(models))]
            yield pa.RecordBatch.from_arrays(columns, names=[*more, *(["n_tokens"] if tokenizer else []), *names])


def scores(docs: DataFrame, models: list[Model], names: list[str], more: tuple[str, ...] = (), tokenizer: str | None = None, held: int = HELD) -> DataFrame:
    """The columns ``more`` of every row of ``docs``, with a tokenizer file its n_tokens, and each model's score under its name."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(models)  # a fixed size: 2**18 buckets for each model
    kept = docs.select(*more, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), *(["n_tokens long"] if tokenizer else []), *(f"`{n}` double" for n in names)])
    return kept.mapInArrow(lambda batches: scored(batches, sent.value, names, more, tokenizer, held), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels, sample)
    out = scores(docs, [model], ["score"], ("doc_id",))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """``docs`` without the rows that are predicted to be of low quality; all columns stay."""
    rows, names = numbered(docs, "text")
    found = scores(rows, [train(docs, labels, sample)], ["score"], tuple(names))
    return found.filter(F.col("score") >= 0.5).select(*names).toDF(*docs.columns)
