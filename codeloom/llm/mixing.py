"""Mixing to target weights with soft membership.

A classifier learned on the labelled table gives every document a posterior over domains (toxic; else of high or low
quality).  Rates r >= 0 then minimise

    1/2 gap' M gap + ridge/2 sum_i n_i / T (r_i - 1)^2   with gap_k = sum_i r_i n_i p_ik / T - t_k

for n_i tokens (of the tokenizer file given), T their sum over all documents, target shares t_k, and M the inverse of the
matrix sum_i n_i / T p_i p_i' + ridge I (with it the curvature is at most 1, so steps of length 1 are safe, and where no
rate meets its bound few are enough; a domain that hardly any text belongs to cannot outweigh the others' targets).  The method is projected gradient descent with momentum, in the metric weighted by n_i / T.
One step only needs the K sums over all documents, a distributed aggregation; a document's rate follows from its own
posterior and the K-vectors of the steps so far, which are all that the driver keeps.  Where ``steps`` steps leave a target
by more than the tolerance, the limit for a ridge of 0 is solved instead: rates max(0, 1 + p_i . dual), with damped Newton
steps on the K-vector ``dual`` by sums of the same kind.  No rate has an upper bound.  Targets that no rates can meet (all
domains alike, say) get the nearest rates that were found, ``residual`` (the largest gap of a share) and a warning;
``shares`` are the shares that were reached.

Results for odd input: null and empty texts have no tokens and get rates by their posterior (that of the classifiers'
constants); without labels all domains are alike; repeated rows count and are mixed each; very long texts are read whole;
an empty table, or one without tokens, has rate 1 everywhere; other columns are carried, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import numbered, saved, ship
from codeloom.llm.quality import Model, fit, labelled_sample, scored, scores
from codeloom.llm.vocabulary import HELD

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.88, "low": 0.10, "toxic": 0.02}


@dataclass
class Descent:
    """Gradients of the steps so far; replays the rate of documents from their posteriors.  ``dual``, if any, decides alone."""

    ridge: float = 1e-3
    gaps: list[np.ndarray] = field(default_factory=list)
    dual: np.ndarray | None = None
    residual: float = 0.0
    shares: dict[str, float] = field(default_factory=dict)

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after the last step, and the extrapolated point where the next gradient is taken."""
        if self.dual is not None:
            r = np.maximum(1 + p @ self.dual, 0.0)
            return r, r
        r = ahead = np.ones(len(p))
        t = 1.0
        for e in self.gaps:
            new = np.maximum(ahead - (p @ e + self.ridge * (ahead - 1)) / (1 + self.ridge), 0.0)
            t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            ahead = new + (before - 1) / t * (new - r)
            r = new
        return r, ahead


def domain_models(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> list[Model]:
    """One model for each domain, learned on a bounded sample of labelled documents."""
    marks = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.when(F.max("toxic") == 1, 2).when(F.max("quality") == 1, 0).otherwise(1).alias("domain"))
    rows = labelled_sample(docs, marks, sample)
    of = np.array([r.domain for r, _ in rows])
    return [fit([g for _, g in rows], (of == k).astype(float)) for k in range(len(DOMAINS))]


def _posteriors(columns: list[pa.Array]) -> np.ndarray:
    p = np.column_stack([np.asarray(c) for c in columns]) + 1e-9
    return p / p.sum(axis=1, keepdims=True)


def solve(table: DataFrame, targets: dict[str, float], steps: int = 40, tolerance: float = 1e-3, ridge: float = 1e-3) -> Descent:
    """Fit rates on ``table``: n_tokens and a score for each domain, for every document."""
    wanted = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    descent = Descent(ridge)
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    metric = None
    k = len(DOMAINS)
    schema = ", ".join([*(f"{at}{i} double" for at in "ra" for i in range(k)), *(f"m{i} double" for i in range(k * k))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(2 * k + k * k)
        for batch in batches:
            p, n = _posteriors([batch.column(d) for d in DOMAINS]), np.asarray(batch.column("n_tokens"), float)
            r, ahead = descent.rates(p)
            whole += np.concatenate([(n * r) @ p, (n * ahead) @ p, ((p * n[:, None]).T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in whole], names=[c.split()[0] for c in schema.split(", ")])

    ship(table.sparkSession)
    for step in range(steps + 1 if total else 0):
        found = np.array(table.select("n_tokens", *DOMAINS).mapInArrow(sums, schema).groupBy().sum().first(), float) / total
        metric = np.linalg.inv(found[2 * k :].reshape(k, k) + ridge * np.eye(k)) if metric is None else metric
        descent.shares = dict(zip(DOMAINS, found[:k].tolist()))
        descent.residual = float(np.abs(found[:k] - wanted).max())
        if descent.residual <= tolerance or step == steps:
            break
        descent.gaps.append(np.round(metric @ (found[k : 2 * k] - wanted), 12))
    if descent.residual > tolerance:
        descent = _newton(table, wanted, total, tolerance, descent)
    if descent.residual > tolerance:
        warnings.warn(f"mixing targets are not met: a share is off by {descent.residual:.4f}", stacklevel=2)
    return descent


def _newton(table: DataFrame, wanted: np.ndarray, total: int, tolerance: float, best: Descent, largest: float = 1e6) -> Descent:
    """``best``, or rates of least squared distance from 1 that are nearer to ``wanted``; ends where ``dual`` diverges or no step helps."""
    k = len(DOMAINS)
    schema = ", ".join(f"s{i} double" for i in range(k + k * k + 1))

    def at(dual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gap of each share, curvature, and the value that the steps lower."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.zeros(k + k * k + 1)
            for batch in batches:
                p, n = _posteriors([batch.column(d) for d in DOMAINS]), np.asarray(batch.column("n_tokens"), float)
                r = np.maximum(1 + p @ dual, 0.0)
                whole += np.concatenate([(n * r) @ p, ((p * (n * (r > 0))[:, None]).T @ p).ravel(), [(n * r * r).sum() / 2]])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in whole], names=[c.split()[0] for c in schema.split(", ")])

        found = np.array(table.select("n_tokens", *DOMAINS).mapInArrow(sums, schema).groupBy().sum().first(), float) / total
        return found[:k] - wanted, found[k:-1].reshape(k, k), found[-1] - dual @ wanted

    dual, damping, idle = np.zeros(k), 1e-3, 0
    gap, curve, value = at(dual)
    while best.residual > tolerance and idle < 8:  # so many steps without a hundredth of gain: no rates are nearer
        step = np.linalg.solve(curve + damping * np.eye(k), -gap)
        if np.abs(dual + step).max() > largest or damping > largest or np.abs(step).max() <= 1e-12 * (1 + np.abs(dual).max()):
            break
        new = at(dual + step)
        if new[2] >= value:
            damping, idle = damping * 10, idle + 1
            continue
        dual, damping, (gap, curve, value) = dual + step, max(damping / 10, 1e-12), new
        residual = float(np.abs(gap).max())
        idle = 0 if residual < 0.99 * best.residual else idle + 1
        if not idle:  # lesser gains come from ever larger duals, whose rates differ with the last digits of a posterior
            best = Descent(best.ridge, dual=dual, residual=residual, shares=dict(zip(DOMAINS, (gap + wanted).tolist())))
    return best


def posteriors(docs: DataFrame, models: list[Model], tokenizer: str, more: tuple[str, ...], held: int = HELD) -> DataFrame:
    return scores(docs, models, list(DOMAINS), more, tokenizer, held)


def rated(batches: Iterator[pa.RecordBatch], descent: Descent) -> Iterator[pa.RecordBatch]:
    """Batches with normalised posteriors and the column rate."""
    for batch in batches:
        p = _posteriors([batch.column(d) for d in DOMAINS])
        columns = dict(zip(batch.schema.names, batch.columns)) | {d: pa.array(p[:, k]) for k, d in enumerate(DOMAINS)}
        columns["rate"] = pa.array(descent.rates(p)[0])
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def copies(rate, row):
    """A whole number of copies whose mean is the rate; rows that repeat an id, or have none, are drawn each by its own."""
    chance = F.pmod(F.xxhash64(F.lit("mixing"), row), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("int")


def mix(docs: DataFrame, labels: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, sample: int = 6000, held: int = HELD) -> DataFrame:
    """doc_id, n_tokens, posterior of each domain, rate, copies of every row."""
    table = saved(posteriors(docs, domain_models(docs, labels, sample), tokenizer, ("doc_id",), held), "posteriors")
    descent = solve(table, targets or TARGETS)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema), "rate double"])
    out = table.mapInArrow(lambda batches: rated(batches, descent), schema)
    return out.withColumn("copies", copies(F.col("rate"), F.monotonically_increasing_id()))


def resample(docs: DataFrame, labels: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, sample: int = 6000, strict: float | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says; all columns stay.  Fails if a share is off by more than ``strict``, if given."""
    models = domain_models(docs, labels, sample)
    descent = solve(saved(posteriors(docs, models, tokenizer, ()), "posteriors"), targets or TARGETS)
    if strict is not None and descent.residual > strict:
        raise ValueError(f"mixing targets are not met: a share is off by {descent.residual:.4f}, {strict} is allowed")
    sent = docs.sparkSession.sparkContext.broadcast(models)  # a fixed size
    rows, more = numbered(docs)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "rate double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rated(scored(batches, sent.value, list(DOMAINS), more), descent):
            yield batch.select([*more, "rate"])

    n = copies(F.col("rate"), F.monotonically_increasing_id())
    rows = rows.select("*", F.col(more[docs.columns.index("text")]).alias("__text")).mapInArrow(run, schema)
    return rows.select(*more, F.explode(F.array_repeat(F.lit(1), n)).alias("copy")).select(*more).toDF(*docs.columns)
