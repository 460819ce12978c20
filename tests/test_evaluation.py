"""Regression evaluation by counted cells."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models as M

C = F.col


def test_copies_are_counted_once_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a, p = rng.integers(0, 30, 200) / 4, rng.integers(0, 9, 200) / 2
    rows = [("m", float(x), float(y)) for x, y in zip(a, p)] + [("m", None, 1.0), (None, 2.0, 2.0), (None, 3.0, 1.0), (None, 3.0, 4.0)]
    d = spark.createDataFrame(rows, "model string, y double, predicted double")
    ranked, ranks = [], M.value_ranks
    monkeypatch.setattr(M, "value_ranks", lambda x, *rest: ranked.append(x.count()) or ranks(x, *rest))
    got = {r.model: r for r in M.evaluate_regression(d).collect()}
    seven = {r.model: r for r in M.evaluate_regression(d.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(7)))).drop("i")).collect()}
    cells = d.filter("y is not null").distinct().count()
    assert ranked == [4 * cells, 4 * cells]
    r = p - a
    for some, times in ((got, 1), (seven, 7)):
        m = some["m"]
        assert m.observed == 200 * times and some[None].observed == 3 * times
        assert (m.actual_median, m.prediction_median) == (pytest.approx(np.median(a)), pytest.approx(np.median(p)))
        assert (m.residual_median, m.median_absolute_error) == (pytest.approx(np.median(r)), pytest.approx(np.median(abs(r))))
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        assert m.spearman == pytest.approx(np.corrcoef(rank(a), rank(p))[0, 1])
