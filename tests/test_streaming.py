"""Streaming twins replayed file by file equal their batch parents."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import windows as X
from barloom.operators.timeline import index_bars
from barloom.streaming import live as L
from test_timeline import STEP, walk


@pytest.fixture
def files(spark, tmp_path):
    p = walk(200, holes=(60, 61, 130))
    for i in range(4):
        spark.createDataFrame(p.iloc[i * 50:(i + 1) * 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return p, str(tmp_path / "in")


def source(spark, p, path):
    return spark.readStream.schema(spark.createDataFrame(p).schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def test_live_state_equals_batch(spark, files):
    p, path = files
    got = L.run_to_table(L.live_state(source(spark, p, path), STEP)).toPandas().sort_values("ts")
    want = X.with_atr(index_bars(spark.createDataFrame(p), STEP)).toPandas().sort_values("ts")
    assert got.seg.tolist() == want.seg.tolist() and got.seg_pos.tolist() == want.seg_pos.tolist() and not got.late.any()
    assert got.atr.fillna(-1).tolist() == pytest.approx(want.atr.fillna(-1).tolist())


def test_live_state_orders_within_delay_and_flags_late_bars(spark, tmp_path):
    p = walk(120, holes=(40, 41)).assign(state=lambda d: (d.close > d.close.shift()).map({True: "up", False: "down"}))
    rows = p.index.to_numpy().copy()
    rows[10:14] = rows[10:14][::-1]  # out of order inside the delay
    rows = [*rows[:60], *rows[60:80][::-1], *rows[80:]]
    late = p.iloc[[5]]
    path = str(tmp_path / "in")
    for i, part in enumerate((p.loc[rows[:60]], pd.concat([p.loc[rows[60:90]], late, p.loc[rows[82:84]]]), p.loc[rows[90:]])):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
    got = L.run_to_table(L.live_state(source(spark, p, path), STEP, delay=30 * STEP)).toPandas().sort_values("ts")
    done = p[p.ts <= p.ts.max() - pd.Timedelta(seconds=30 * STEP)]
    on_time = got[~got.late]
    assert on_time.ts.tolist() == done.ts.tolist()
    want = X.with_atr(index_bars(spark.createDataFrame(done), STEP)).toPandas().sort_values("ts")
    assert on_time.seg.tolist() == want.seg.tolist() and on_time.atr.fillna(-1).tolist() == pytest.approx(want.atr.fillna(-1).tolist())
    assert sorted(got[got.late].ts) == sorted([late.ts.iloc[0], *p.loc[rows[82:84]].ts])
    age, state, seg = 0, None, None
    for r in on_time.itertuples():
        age = age + 1 if (r.seg, r.state) == (seg, state) else 1
        assert r.state_age == age and (age > 1 or r.previous_state == (state if r.seg == seg else None))
        seg, state = r.seg, r.state


def test_live_state_timer_releases_waiting_bars(spark, tmp_path):
    p = walk(20, holes=())
    path = str(tmp_path / "in")
    spark.createDataFrame(p).coalesce(1).write.parquet(path)
    out = str(tmp_path / "out")
    q = (L.live_state(source(spark, p, path), STEP, delay=1000 * STEP, idle=1).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start())
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if (tmp_path / "out").exists() and spark.read.schema(L.LIVE_SCHEMA).parquet(out).count() == len(p):
                break
        assert spark.read.schema(L.LIVE_SCHEMA).parquet(out).count() == len(p)
    finally:
        q.stop()


def test_touch_sessions(spark, files):
    p, path = files
    price = float(p.close.median())
    levels = spark.createDataFrame([("A", "L1", price)], "symbol string, level_key string, level_price double").withColumn("available_at", F.lit("2024-01-01").cast("timestamp"))
    got = L.run_to_table(L.touch_sessions(source(spark, p, path), levels, STEP, "0 seconds")).toPandas().sort_values("first_ts")
    t = p[(p.low <= price) & (price <= p.high)]
    runs = t.groupby(t.ts.diff().dt.total_seconds().gt(STEP).cumsum()).ts.agg(["min", "count"])
    done = runs[runs["min"] + pd.to_timedelta(runs["count"] * STEP, unit="s") <= p.ts.max()]
    assert got.first_ts.tolist() == done["min"].tolist() and got.touched_bars.tolist() == done["count"].tolist()


def test_archive_stream(spark, files, tmp_path):
    p, path = files
    out, bad = str(tmp_path / "archive"), str(tmp_path / "bad")
    q = L.archive_stream(source(spark, p, path), out, bad, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == len(p)
