"""Centroid clustering with Walsh-Hadamard progressive search, exact in integers.

Vectors become integers, floor(scale * x), and their Walsh-Hadamard coefficients, in the order of sign changes: the sum first, then coarse
differences, fine ones last. The transform is exact and keeps distances up to the factor ``dim``. To assign a vector, the coarse coefficients of
the differences to all centroids are accumulated; the nearest so far is finished over all coefficients and gives a bound; the other centroids go
on in doubling blocks of finer coefficients, and a centroid goes as soon as its partial sum is strictly above the bound, so that ties stay. Those
that finish all coefficients have exact distances. Rounds add the coefficients of each cluster in the tasks; only k x dim sums reach the driver,
where the inverse transform and floor(sum / count) give the next centroids. Rounds end early only when no centroid moves any more.

Defined cases: vectors that are null, of another dimension, or hold null or non-finite components take no part; ties go to the smaller
centroid; rows with equal ids are vectors of their own, drawn in the order of their components, null ids last; fewer vectors than centroids give
fewer centroids; clusters without vectors keep their centroid; an empty table gives an empty result. Components of any finite size are exact:
those beyond 2^24 go through Python integers instead of 64-bit ones; a distance or inertia that 64 bits can't hold is null. Only the id and
vector columns are read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import C
from barloom.sources.stage import stage

DIM = 64
SAFE = 1 << 24  # components up to here have squared coefficient differences within 64 bits
COARSE = 8  # coefficients that all centroids accumulate
PAIRS = 1 << 16  # vector-centroid pairs at a time
LIMB_BITS = 40
LIMBS = 6


def by_sign_changes(dim: int) -> np.ndarray:
    """Rows of the butterfly transform in the order of their sign changes (bit-reversed Gray code)."""
    bits = dim.bit_length() - 1
    gray = [i ^ (i >> 1) for i in range(dim)]
    return np.array([int(format(g, f"0{bits}b")[::-1], 2) if bits else 0 for g in gray])


def walsh(v: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, coarse to fine; applied twice it multiplies by the dimension."""
    out, dim, half = v.copy(), v.shape[1], 1
    while half < dim:
        pair = out.reshape(len(v), dim // (2 * half), 2, half)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(v), dim)
        half *= 2
    return out[:, by_sign_changes(dim)]


def nearest(x: np.ndarray, centroids: np.ndarray, coarse: int = COARSE) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and dim x squared distance of each row, both given as coefficients."""
    n, k, dim = len(x), len(centroids), x.shape[1]
    block = min(coarse, dim)
    partial = np.stack([((x[:, :block] - c[:block]) ** 2).sum(1) for c in centroids], 1)
    guess = partial.argmin(1)
    bound = partial[np.arange(n), guess] + ((x[:, block:] - centroids[guess, block:]) ** 2).sum(1)
    row, cen = np.nonzero((partial <= bound[:, None]) & (np.arange(k) != guess[:, None]))
    total = partial[row, cen]
    while block < dim and len(row):
        to = min(2 * block, dim)
        total = total + ((x[row, block:to] - centroids[cen, block:to]) ** 2).sum(1)
        live = total <= bound[row]
        row, cen, total, block = row[live], cen[live], total[live], to
    best, label = bound.copy(), guess.copy()
    if len(row):
        full = np.full((n, k), None, object) if x.dtype == object else np.full((n, k), np.iinfo(np.int64).max)
        if x.dtype == object:
            full[:] = max(bound.max(), total.max()) + 1
        full[row, cen], full[np.arange(n), guess] = total, bound
        label = full.argmin(1)
        best = full[np.arange(n), label]
    return label, best


def coefficients(rows: DataFrame, id_col: str, vector_col: str, scale: int, dim: int) -> DataFrame:
    """(vec_id, w array<long>, big array<double>): coefficients, or the integer components where they are beyond ``SAFE``; staged."""
    v = C(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = rows.filter(good).select(C(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x * F.lit(float(scale))).alias("v"))

    def run(batches):
        for batch in (b.slice(lo, 8192) for b in batches for lo in range(0, b.num_rows, 8192)):
            v = np.floor(batch.column(1).flatten().to_numpy().reshape(-1, dim))
            big = (np.abs(v) > SAFE).any(1)
            w = walsh(np.where(big[:, None], 0, v).astype(np.int64))
            ends = pa.array(np.arange(0, dim * len(v) + 1, dim, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(w.ravel()), mask=pa.array(big)), pa.ListArray.from_arrays(ends, pa.array(v.ravel()), mask=pa.array(~big))],
                                             names=["vec_id", "w", "big"])

    return stage(ints.mapInArrow(run, "vec_id long, w array<long>, big array<double>"))


def _exact(big: pa.Array, dim: int) -> np.ndarray:
    """Coefficients of large components as Python integers."""
    return walsh(np.array([int(x) for x in big.flatten().to_pylist()], object).reshape(-1, dim))


def _parts(batch: pa.RecordBatch, centroids: list[list[int]], dim: int):
    """(row numbers, coefficients, centroids) of the batch's vectors, in 64-bit integers where both allow it."""
    inside = max((abs(x) for c in centroids for x in c), default=0) <= SAFE * dim
    held = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    step = max(1, PAIRS // max(1, len(centroids)))
    for mask, column in ((held, 1), (~held, 2)):
        at = np.flatnonzero(mask)
        for lo in range(0, len(at), step):
            rows = at[lo:lo + step]
            lists = batch.column(column).take(pa.array(rows))
            x = _exact(lists, dim) if column == 2 else lists.flatten().to_numpy().reshape(-1, dim)
            if column == 1 and inside:
                yield rows, x, np.array(centroids, np.int64).reshape(-1, dim)
            else:
                yield rows, x.astype(object), np.array(centroids, object).reshape(-1, dim)


def cluster_sums(vectors: DataFrame, centroids: list[list[int]], dim: int, coarse: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of coefficients per cluster; sums travel as limbs of ``LIMB_BITS`` bits, the last one signed."""
    def run(batches):
        count, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
        for batch in batches:
            for _, x, cen in _parts(batch, centroids, dim):
                label, _ = nearest(x, cen, coarse)
                for c in np.unique(label).tolist():
                    own = x[label == c]
                    count[c] += len(own)
                    sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(0))]
        rows = [(c, i, count[c], [(s >> (LIMB_BITS * l)) & ((1 << LIMB_BITS) - 1) if l < LIMBS - 1 else s >> (LIMB_BITS * l) for l in range(LIMBS)])
                for c in range(len(centroids)) if count[c] for i, s in enumerate(sums[c])]
        yield pa.RecordBatch.from_pydict({"c": pa.array([r[0] for r in rows], pa.int32()), "i": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64()),
                                          **{f"l{l}": pa.array([r[3][l] for r in rows], pa.int64()) for l in range(LIMBS)}})

    limbs = [f"l{l}" for l in range(LIMBS)]
    found = vectors.mapInArrow(run, "c int, i int, n long, " + ", ".join(f"{l} long" for l in limbs)).groupBy("c", "i").agg(F.sum("n").alias("n"), *[F.sum(l).alias(l) for l in limbs])
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.collect():
        out.setdefault(r["c"], (int(r["n"]), [0] * dim))[1][r["i"]] = sum(int(r[l]) << (LIMB_BITS * k) for k, l in enumerate(limbs))
    return out


def walsh_back(w: list[int]) -> list[int]:
    """The butterfly of coefficients given coarse to fine: ``dim`` times the components."""
    plain = np.zeros((1, len(w)), object)
    plain[0, by_sign_changes(len(w))] = w
    out = walsh(plain)
    back = np.zeros(len(w), object)
    back[by_sign_changes(len(w))] = out[0]
    return back.tolist()


def fit_centroids(vectors: DataFrame, k: int, rounds: int, seed: int, dim: int, coarse: int = COARSE) -> list[list[int]]:
    """Components of the centroids after so many rounds over staged ``vectors``."""
    drawn = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), C("vec_id").cast("string")), 256).asc_nulls_last(), "w", "big").limit(k).collect()
    centroids = [[x // dim for x in walsh_back(r["w"])] if r["w"] is not None else [int(x) for x in r["big"]] for r in drawn]
    for _ in range(rounds if centroids else 0):
        sums = cluster_sums(vectors, [walsh(np.array([c], object))[0].tolist() for c in centroids], dim, coarse)
        moved = [[s // dim // sums[c][0] for s in walsh_back(sums[c][1])] if c in sums else own for c, own in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding", coarse: int = COARSE) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    if dim & (dim - 1) or dim < 1:
        raise ValueError("the transform needs a dimension that is a power of two")
    vectors = coefficients(rows, id_col, vector_col, scale, dim)
    centroids = fit_centroids(vectors, k, rounds, seed, dim, coarse)
    turned = [walsh(np.array([c], object))[0].tolist() for c in centroids]

    def run(batches):
        for batch in batches:
            label, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for at, x, cen in _parts(batch, turned, dim):
                label[at], best = nearest(x, cen, coarse)
                distance[at] = [int(d) // dim for d in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array([d if d < 1 << 63 else None for d in distance], pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = stage(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"))
    total = lambda: F.when(F.count_if(C("distance").isNull()) == 0, F.sum(C("distance").cast("decimal(38,0)"))).alias("x")
    per = {r["cluster"]: r["x"] for r in assigned.groupBy("cluster").agg(total()).collect()}
    whole = None if any(x is None for x in per.values()) else sum(map(int, per.values()))
    fits = lambda x: None if x is None or int(x) >= 1 << 63 else int(x)
    facts = [(c, fits(per[c]), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(per)]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 10) -> str:
    near = lambda c: f"SELECT vec_id, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM (SELECT x.vec_id, y.c AS cluster, sum((x.x - y.x) * (x.x - y.x))::BIGINT AS d FROM x JOIN {c} y USING (i) GROUP BY 1, 2)) WHERE r = 1"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near(f'c{r}')})")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, o.x) AS x FROM c{r} o LEFT JOIN (SELECT cluster AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY 1, 2) USING (c, i))")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(1, 65)) AS i FROM v),
c0 AS MATERIALIZED (SELECT c, i, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v QUALIFY c < 8) JOIN x USING (vec_id)),
{", ".join(steps)}, f AS MATERIALIZED ({near(f"c{rounds}")}),
g AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM f JOIN g ON c = cluster"""


SQL = _sql()
