"""Gaussian mixtures with full covariances, fitted by expectation maximisation over the whole table.

Any number of mixtures (starts, component counts, seeds, slices of the table) advance in the same passes. A pass reads the staged vectors once:
each task sums responsibilities, first and second moments in Arrow batches, and the sums of the parts are added on the executors; what reaches the
driver is components x dimensions^2 / 2 numbers per mixture and pass, whatever the number of rows and parts. Second moments are taken about the components' current
means, so that no digits cancel. Covariances get a floor on their diagonal, which keeps starved components regular.

Starts come from k-means: centres are drawn by k-means++ from a bounded sample of the vectors, those of the smallest hash, and moved over all of them.
Rows with a null or non-finite input take no part.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.sources.stage import stage

C = F.col
FLOOR = 1e-6
MAX_ITER = 300
TOLERANCE = 1e-3
CENTRE_ROUNDS = 30
SEED_ROWS = 4096  # sample from which first centres are drawn
BATCH = 4096  # rows at a time


@dataclass
class Mixture:
    """A mixture and how its fit went; ``logs`` holds the mean log-likelihood of each pass."""
    k: int
    seed: int
    slice: int | None = None
    weights: np.ndarray | None = None
    means: np.ndarray | None = None
    covariances: np.ndarray | None = None
    rows: int = 0
    logs: list[float] = field(default_factory=list)
    iterations: int = 0
    converged: bool = False
    occupancy: np.ndarray | None = None

    @property
    def log_likelihood(self) -> float:
        return self.logs[-1] * self.rows

    def factors(self) -> np.ndarray:
        """Upper factors P of the precisions, with P P^T the inverse covariance."""
        return np.stack([np.linalg.inv(np.linalg.cholesky(c)).T for c in self.covariances])

    def parameters(self) -> dict:
        return dict(weights=self.weights.tolist(), means=self.means.tolist(), precisions_cholesky=self.factors().tolist())


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """log(weight x density) of each row and component."""
    out = np.empty((len(x), len(weights)))
    for j, (w, m, p) in enumerate(zip(weights, means, factors)):
        y = (x - m) @ p
        out[:, j] = math.log(w) + np.log(np.diag(p)).sum() - 0.5 * ((y * y).sum(1) + x.shape[1] * math.log(2 * math.pi))
    return out


def responsibilities(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each row and component, and the row's log-likelihood."""
    top = logs.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    return np.exp(logs - total[:, None]), total


def _moments(x: np.ndarray, r: np.ndarray, about: np.ndarray, log_sum: float) -> np.ndarray:
    """log-likelihood, rows, then per component: weight, hard count, first and second moments (one triangle) about ``about``."""
    hard = np.bincount(r.argmax(1), minlength=r.shape[1])
    upper = np.triu_indices(x.shape[1])
    parts = [np.array([log_sum, len(x)]), r.sum(0), hard]
    for j, m in enumerate(about):
        y = x - m
        parts += [r[:, j] @ y, ((y * r[:, j:j + 1]).T @ y)[upper]]
    return np.concatenate(parts)


def _pass(rows: DataFrame, width: Sequence[int], sums) -> list[np.ndarray]:
    """Sums of all rows, one array per mixture; ``sums(x, slices)`` gives those of a batch.

    There are as many parts as cores at most. Each mixture's sums of the parts are added on the executors, in the order of the parts' numbers, so the
    driver gets one array per mixture, whatever the number of rows and parts.
    """
    def per_part(batches):
        from pyspark import TaskContext

        total = [np.zeros(w) for w in width]
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                b = batch.slice(lo, BATCH)
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                for t, s in zip(total, sums(x, b.column(1).to_numpy(zero_copy_only=False))):
                    t += s
        part = TaskContext.get().partitionId()
        for i, s in enumerate(total):
            yield _packed(i, part, s)

    def added(batches):
        at, total = None, None
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if i == at:
                    total += np.frombuffer(s)
                    continue
                if at is not None:
                    yield _packed(at, 0, total)
                at, total = i, np.frombuffer(s).copy()
        if at is not None:
            yield _packed(at, 0, total)

    kind, cores = "mixture int, part int, sums binary", rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(cores).mapInArrow(per_part, kind)
    parts = parts.repartition(min(len(width), cores), "mixture").sortWithinPartitions("mixture", "part").mapInArrow(added, kind)
    found = {r["mixture"]: np.frombuffer(r["sums"]) for r in parts.collect()}
    return [found.get(i, np.zeros(w)) for i, w in enumerate(width)]


def _packed(mixture: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([mixture], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["mixture", "part", "sums"])


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each centre is drawn with a chance in proportion to the squared distance from those before."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        near = np.min([((sample - c) ** 2).sum(1) for c in centres], 0)
        total = near.sum()
        centres.append(sample[rng.choice(len(sample), p=near / total) if total > 0 else rng.integers(len(sample))])
    return np.stack(centres)


def maximise(m: Mixture, sums: np.ndarray, about: np.ndarray, floor: float) -> None:
    """New weights, means and covariances from the sums of a pass."""
    k, d = about.shape
    weight = sums[2:2 + k] + 10 * np.finfo(float).eps
    moments = sums[2 + 2 * k:].reshape(k, d + d * (d + 1) // 2)
    shift = moments[:, :d] / weight[:, None]
    i, j = np.triu_indices(d)
    second = np.empty((k, d, d))
    second[:, i, j] = second[:, j, i] = moments[:, d:] / weight[:, None]
    m.rows = int(sums[1])
    m.means = about + shift
    m.covariances = second - shift[:, :, None] * shift[:, None, :]
    m.covariances = m.covariances + floor * np.eye(d)
    m.weights = weight / weight.sum()


def vectors(df: DataFrame, features: Sequence[str], slice_col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(x, slice, *keep) staged: the inputs as one array; rows with a null or non-finite input are left out."""
    x = F.array(*[C(f).cast("double") for f in features])
    ready = df.select(x.alias("x"), (C(slice_col) if slice_col else F.lit(0)).cast("int").alias("slice"), *keep)
    return stage(ready.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))))


def fit_all(rows: DataFrame, wanted: Sequence[Mixture], *, floor: float = FLOOR, max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> list[Mixture]:
    """Fits all mixtures on staged ``vectors`` in common passes. A mixture with a slice learns from the rows of that slice only.

    It stops when the mean log-likelihood changes by less than ``tol`` (converged) or after ``max_iter`` iterations. Too few rows are refused.
    """
    sample = rows.orderBy(F.xxhash64("x"), "x").limit(SEED_ROWS)
    slices = {m.slice for m in wanted}
    first = {s: np.array([r["x"] for r in (sample if s is None else rows.filter(C("slice") == s).orderBy(F.xxhash64("x"), "x").limit(SEED_ROWS)).collect()]) for s in slices}
    for m in wanted:
        if len(first[m.slice]) < m.k:
            raise ValueError("a mixture needs at least as many rows as components")
    d = next(iter(first.values())).shape[1]
    width = lambda m: 2 + 2 * m.k + m.k * (d + d * (d + 1) // 2)
    own = lambda m, x, s: x if m.slice is None else x[s == m.slice]

    # centres, over all rows
    centres = [first_centres(first[m.slice], m.k, m.seed) for m in wanted]
    live = list(range(len(wanted)))
    for _ in range(CENTRE_ROUNDS):
        def near(x, s, live=tuple(live), centres=tuple(centres)):
            for i in live:
                y, c = own(wanted_keys[i], x, s), centres[i]
                at = ((y[:, None] - c) ** 2).sum(2).argmin(1) if len(y) * c.size < 1 << 22 else (-2 * y @ c.T + (c * c).sum(1)).argmin(1)
                yield np.concatenate([np.bincount(at, minlength=len(c)), *[y[at == j].sum(0) for j in range(len(c))]])

        wanted_keys = [Mixture(m.k, m.seed, m.slice) for m in wanted]
        found = _pass(rows, [wanted[i].k * (1 + d) for i in live], near)
        moved = []
        for i, sums in zip(live, found):
            k, n = wanted[i].k, sums[:wanted[i].k]
            new = np.where(n[:, None] > 0, sums[k:].reshape(k, d) / np.maximum(n, 1)[:, None], centres[i])
            if np.abs(new - centres[i]).max() > 1e-12:
                moved.append(i)
            centres[i] = new
        live = moved
        if not live:
            break

    def hard(x, s, centres=tuple(centres)):
        for m, c in zip(wanted_keys, centres):
            y = own(m, x, s)
            r = np.zeros((len(y), m.k))
            r[np.arange(len(y)), (-2 * y @ c.T + (c * c).sum(1)).argmin(1)] = 1
            yield _moments(y, r, c, 0.0)

    for m, c, sums in zip(wanted, centres, _pass(rows, [width(m) for m in wanted], hard)):
        maximise(m, sums, c, floor)

    live = list(wanted)
    while live:
        known = [(Mixture(m.k, m.seed, m.slice), m.weights, m.means, m.factors()) for m in live]

        def expected(x, s, known=known):
            for m, w, means, p in known:
                y = own(m, x, s)
                r, logs = responsibilities(log_densities(y, w, means, p)) if len(y) else (np.zeros((0, m.k)), np.zeros(0))
                yield _moments(y, r, means, logs.sum())

        going = []
        for m, sums in zip(live, _pass(rows, [width(m) for m in live], expected)):
            m.rows = int(sums[1])
            m.logs.append(float(sums[0] / sums[1]))
            m.occupancy = sums[2 + m.k:2 + 2 * m.k].astype(np.int64)
            m.converged = len(m.logs) > 1 and abs(m.logs[-1] - m.logs[-2]) < tol
            if m.converged or m.iterations >= max_iter:
                continue
            maximise(m, sums, m.means, floor)
            m.iterations += 1
            going.append(m)
        live = going
    return list(wanted)


def labelled(rows: DataFrame, mixtures: Sequence[Mixture], names: Sequence[str]) -> DataFrame:
    """``rows`` (from ``vectors``) with the likeliest component of each mixture."""
    known = [(m.weights, m.means, m.factors()) for m in mixtures]
    fields = [f for f in rows.schema.fields if f.name != "x"]
    at = rows.columns.index("x")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                b = batch.slice(lo, BATCH)
                x = b.column(at).flatten().to_numpy().reshape(b.num_rows, -1)
                said = [pa.array(log_densities(x, *k).argmax(1).astype(np.int32)) for k in known]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], *said], names=[*[f.name for f in fields], *names])

    return rows.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], *[f"{n} int" for n in names]]))
