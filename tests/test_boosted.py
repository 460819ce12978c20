"""The boosted fit on weighted cells against Spark's learner on the rows themselves."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models as M

C = F.col


def rows(n, seed=2):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 12, n), rng.integers(0, 6, n), rng.integers(0, 5, n)
    y = 3.0 * a - b * b + 4.0 * (c == 3) + rng.normal(size=n)
    return [(i, None if i % 11 == 0 else float(p), float(q), int(r), float(t), i % 13 != 5) for i, (p, q, r, t) in enumerate(zip(a, b, c, y))]


def plain(encoded):
    """Spark's learner, a row each, on the same inputs."""
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    from pyspark.ml.regression import GBTRegressor
    seen = encoded.filter("observed")
    middle = seen.approxQuantile("a", [0.5], 0.001)[0]
    x = lambda d: d.select("*", F.coalesce("a", F.lit(middle)).alias("af"), C("a").isNull().cast("double").alias("am"), C("b").isNull().cast("double").alias("bm"), C("c").cast("double").alias("cd"))
    codes = VectorAssembler(inputCols=["cd"], outputCol="codes")
    index = VectorIndexer(inputCol="codes", outputCol="cx", maxCategories=5, handleInvalid="keep").fit(codes.transform(x(seen)))
    put = VectorAssembler(inputCols=["af", "b", "am", "bm", "cx"], outputCol="features")
    ready = lambda d: put.transform(index.transform(codes.transform(x(d))))
    return GBTRegressor(labelCol="y", predictionCol="predicted", maxBins=32, **M.BOOST | {"maxIter": 6}).fit(ready(seen)).transform(ready(encoded))


@pytest.mark.parametrize("n", [2500, 120, 18])
def test_cells_fit_as_their_rows(spark, monkeypatch, n):
    from pyspark.ml.regression import GBTRegressor
    d = spark.createDataFrame(rows(n), "id long, a double, b double, c int, y double, observed boolean").repartition(3).cache()
    want = {r.id: r.predicted for r in plain(d).collect()}
    fit, learnt = GBTRegressor._fit, []
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, x: learnt.append(x.count()) or fit(self, x))
    model, _ = M.fit_boosted_regression(d, ["a", "b"], ["c"], maxIter=6)
    got = {r.id: r.predicted for r in M.predict(model, d, ["a", "b"], ["c"]).collect()}
    assert learnt == [d.filter("observed").select("a", "b", "c").distinct().count()]
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
