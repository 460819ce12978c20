"""Ordered scans must not depend on chunk or bucket sizes."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import windows as X
from barloom.operators.timeline import add_halo, index_bars, number_rows, running

STEP = 900


def walk(n=600, seed=1, holes=(100, 101, 250, 400), symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 0.3, n))
    open_ = np.r_[100, close[:-1]]
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * STEP, unit="s")
    d = pd.DataFrame(dict(symbol=symbol, ts=ts, open=open_, high=np.maximum(open_, close) + 0.1, low=np.minimum(open_, close) - 0.1, close=close, tick_volume=1))
    return d.drop(index=list(holes)).reset_index(drop=True)


@pytest.fixture(scope="module")
def bars(spark):
    return pd.concat([walk(), walk(seed=2, symbol="B", holes=(5,))])


@pytest.mark.parametrize("bucket", [7, 64, 5000])
def test_index_matches_pandas(spark, bars, bucket):
    got = index_bars(spark.createDataFrame(bars), STEP, bucket_rows=bucket).select("symbol", "ts", "pos", "seg", "seg_pos").toPandas().sort_values(["symbol", "ts"])
    for _, g in bars.groupby("symbol"):
        cut = g.ts.diff().dt.total_seconds().gt(STEP)
        seg = cut.cumsum()
        mine = got[got.symbol == g.symbol.iloc[0]]
        assert mine.pos.tolist() == list(range(len(g)))
        assert mine.seg.tolist() == seg.tolist()
        assert mine.seg_pos.tolist() == g.groupby(seg).cumcount().tolist()


def test_halo_covers_neighbours(spark):
    d = spark.range(100).select(F.col("id").alias("pos"))
    rows = add_halo(d, back=15, ahead=4, chunk_rows=10).toPandas()
    assert rows.own.sum() == 100
    for c, g in rows.groupby("chunk"):
        if c < 10:
            assert set(range(max(0, c * 10 - 15), min(100, c * 10 + 14))) == set(g.pos)


def test_atr_equals_recursion_across_chunks(spark, bars):
    ix = index_bars(spark.createDataFrame(bars), STEP)
    got = X.with_atr(ix, 14, chunk_rows=64).toPandas().sort_values(["symbol", "pos"])
    for _, g in got.groupby(["symbol", "seg"]):
        g = g.sort_values("pos")
        prev = g.close.shift()
        tr = pd.concat([g.high - g.low, (g.high - prev).abs(), (g.low - prev).abs()], axis=1).max(axis=1)
        value = None
        for i, (t, a) in enumerate(zip(tr, g.atr)):
            if i == 14:
                value = tr.iloc[1:15].mean()
            elif i > 14:
                value = (value * 13 + t) / 14
            assert (pd.isna(a) and value is None) or a == pytest.approx(value, rel=1e-12)


def test_features_do_not_depend_on_chunks_or_future(spark, bars):
    sdf = spark.createDataFrame(bars)
    cut = pd.Timestamp("2024-01-05")
    full = X.base_features(index_bars(sdf, STEP), 4096).toPandas().set_index(["symbol", "ts"]).sort_index()
    small = X.base_features(index_bars(sdf, STEP, bucket_rows=50), 70).toPandas().set_index(["symbol", "ts"]).sort_index()
    # later bars change, earlier rows must not
    bent = bars.copy()
    late = bent.ts >= cut
    for c in ("open", "high", "low", "close"):
        bent.loc[late, c] *= 3
    early = X.base_features(index_bars(spark.createDataFrame(bent), STEP), 4096).toPandas().set_index(["symbol", "ts"]).sort_index()
    num = full.select_dtypes("number").columns
    pd.testing.assert_frame_equal(full[num], small[num], rtol=1e-10)
    keep = full.index.get_level_values(1) < cut
    pd.testing.assert_frame_equal(full.loc[keep, num], early.loc[keep, num], rtol=1e-12)


def test_running_kinds(spark):
    n = 500
    rng = np.random.default_rng(3)
    p = pd.DataFrame(dict(k="x", pos=np.arange(n), v=rng.integers(-5, 6, n).astype(float)))
    p.loc[rng.random(n) < 0.6, "v"] = np.nan
    d = spark.createDataFrame(p).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = running(d, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "q": ("prev", F.col("v"))}, by=("k",), chunk_rows=17).toPandas().sort_values("pos")
    f = p.v.ffill()
    assert got.s.fillna(0).tolist() == p.v.fillna(0).cumsum().tolist()
    assert got.m.fillna(-9).tolist() == p.v.cummax().ffill().fillna(-9).tolist()
    assert got.l.fillna(-9).tolist() == f.fillna(-9).tolist()
    assert got.q.fillna(-9).tolist() == f.shift().fillna(-9).tolist()


def test_number_rows_with_a_hot_value(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("day"), "id")
    got = number_rows(d, ["day", "id"]).toPandas().sort_values("idx")
    assert got.idx.tolist() == list(range(3000))
    assert got[["day", "id"]].apply(tuple, axis=1).is_monotonic_increasing
