"""Expectation maximisation against plain NumPy, and the registered mixture queries."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import mixtures as X, models as M

SF = "/root/testdata/sf0.001"
V = ["a", "b", "c"]


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double").repartition(parts)


def blobs(n=300, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal([0, 0, 0], [1, 0.3, 0.5], (n, 3)), rng.normal([6, 1, 0], 0.7, (n, 3)), rng.normal([0, 8, 3], 0.4, (n // 2, 3))])


def step(x, m):
    """One plain iteration: posteriors by direct densities, then weighted means and covariances in two passes."""
    dens = np.stack([w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, mu, c in zip(m.weights, m.means, m.covariances)], 1)
    r = dens / dens.sum(1, keepdims=True)
    n = r.sum(0)
    mu = r.T @ x / n[:, None]
    cov = np.stack([((x - a).T * r[:, j]) @ (x - a) / n[j] for j, a in enumerate(mu)]) + X.FLOOR * np.eye(x.shape[1])
    return n / n.sum(), mu, cov, np.log(dens.sum(1)).mean()


def test_each_iteration_is_the_plain_one(spark):
    x = blobs()
    rows = X.vectors(table(spark, x), V)
    fits = [X.fit_all(rows, [X.Mixture(3, 7), X.Mixture(4, 8)], max_iter=t, tol=0.0) for t in (0, 1, 2, 5, 6)]
    for before, after in ((0, 1), (1, 2), (3, 4)):
        for a, b in zip(fits[before], fits[after]):
            w, mu, cov, log = step(x, a)
            assert np.allclose(b.weights, w) and np.allclose(b.means, mu) and np.allclose(b.covariances, cov)
            assert a.logs[-1] == pytest.approx(log)
    for m in fits[-1]:
        assert all(q >= p - 1e-9 for p, q in zip(m.logs, m.logs[1:])) and not m.converged and m.occupancy.sum() == len(x)


def test_parts_and_missing_rows_do_not_matter(spark):
    x = blobs(80)
    d = table(spark, x, 90)  # more parts than are added at once
    odd = spark.createDataFrame([(9000, None, 1.0, 1.0), (9001, float("nan"), 1.0, 1.0), (9002, float("inf"), 1.0, 1.0)], d.schema)
    model, info = M.gmm_fit(d.unionByName(odd), V, 3, n_init=2)
    again, other = M.gmm_fit(table(spark, x, 2), V, 3, n_init=2)
    assert info["n"] == len(x) and info["converged"] and np.allclose(model.means, again.means) and info["bic"] == pytest.approx(other["bic"])
    sizes = sorted(np.round(model.weights * len(x)))
    assert sizes == [40, 80, 80]
    p = M.gmm_parameters(3, 3)
    assert info["aic"] == pytest.approx(2 * p - 2 * info["log_likelihood"]) and info["bic"] == pytest.approx(p * np.log(len(x)) - 2 * info["log_likelihood"])
    scored = M.frozen_gmm_score(table(spark, x), V, M.model_parameters(model)).orderBy("i").collect()
    labels = [r.l for r in X.labelled(X.vectors(table(spark, x), V, keep=["i"]), [model], ["l"]).orderBy("i").collect()]
    assert labels == [r.state for r in scored]


def test_starved_and_equal_rows_stay_regular(spark):
    x = np.repeat([[0.0, 0, 0], [1.0, 1, 1]], 20, 0)
    rows = M.select_k(table(spark, x), V, range(2, 6), n_init=2).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.k)] == [2, 3, 4, 5] and rows == sorted(rows, key=lambda r: r.bic)
    with pytest.raises(ValueError):
        M.gmm_fit(table(spark, x[:2]), V, 3)
    with pytest.raises(ValueError):
        M.gmm_fit(table(spark, x), V, 11)


def test_label_stability(spark):
    x = blobs(100)
    rng = np.random.default_rng(4)
    got = M.label_stability(table(spark, rng.permutation(x)), V, 3, order=["i"], seeds=range(3), slices=2, n_init=2).collect()
    assert {(r.seed_a, r.seed_b, r.scope) for r in got} == {(a, b, s) for a, b in ((0, 1), (0, 2), (1, 2)) for s in ("ALL", "0", "1")} | {(0, 0, "FIT_0"), (0, 0, "FIT_1")}
    assert all(r.ari > 0.95 for r in got) and {r.n for r in got if r.scope == "ALL" or r.scope.startswith("FIT")} == {len(x)}


@pytest.mark.parametrize("name, rows", [("j08_gmm_fit", 1), ("j09_select_k", 9), ("j10_label_stability", 54)])
def test_registered_mixtures_run_with_all_settings(spark, name, rows):
    from barloom.catalog import load
    got = load().queries[name](spark, SF).collect()
    assert len(got) == rows
    if name != "j10_label_stability":
        assert all(np.isfinite(r.bic) and r.n == 500 for r in got)


def test_driver_gets_one_sum_per_mixture_whatever_the_parts(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    got, plain = [], DataFrame.collect

    def collect(d):
        rows = plain(d)
        got.extend(len(r["sums"]) for r in rows if "sums" in d.columns)
        return rows

    monkeypatch.setattr(DataFrame, "collect", collect)
    sent = []
    for parts in (2, 40):
        got.clear()
        X.fit_all(X.vectors(table(spark, blobs(80), parts), V).repartition(parts), [X.Mixture(2, 1), X.Mixture(3, 1)], max_iter=1, tol=0.0)
        sent.append(sorted(got)[-2:])  # the largest sums: moments of both mixtures
        assert sum(n == max(got) for n in got) == 3  # one per pass over moments
    assert sent[0] == sent[1]
