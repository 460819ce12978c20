"""Wall-clock blocks and sessions across daylight-saving changes."""
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.calendar import FRAMES, BlockConfig, parse_ts, resolve_block
from barloom.operators.blocks import SESSIONS, anchored_blocks, completed_sessions, expected_window, session_window
from barloom.operators.timeline import index_bars

NY = ZoneInfo("America/New_York")


def grid(spark, start, hours, minutes=15):
    n = hours * 60 // minutes
    ts = pd.Timestamp(start) + pd.to_timedelta(range(n), unit="s") * 60 * minutes
    p = pd.DataFrame(dict(symbol="A", ts=ts, open=1.0, high=2.0, low=0.5, close=1.5))
    return spark.createDataFrame(p)


@pytest.mark.parametrize("start", ["2024-03-09 12:00", "2024-11-02 12:00"])
@pytest.mark.parametrize("frame", ["NY_H1", "NY_H3", "NY_H4", "NY_D1"])
def test_blocks_follow_wall_time(spark, start, frame):
    cfg = FRAMES[frame]
    got = grid(spark, start, 48).withColumns(resolve_block("ts", cfg)).toPandas()
    for r in got.itertuples():
        wall = r.ts.to_pydatetime().replace(tzinfo=timezone.utc).astimezone(NY)
        index = (wall.hour * 60 + wall.minute) // cfg.minutes
        begin = datetime(wall.year, wall.month, wall.day) + timedelta(minutes=index * cfg.minutes)
        bound = lambda t: t.replace(tzinfo=NY, fold=0).astimezone(timezone.utc).replace(tzinfo=None)
        assert r.block_index == index
        assert r.block_start.to_pydatetime() == bound(begin)
        assert r.block_end.to_pydatetime() == bound(begin + timedelta(minutes=cfg.minutes))


@pytest.mark.parametrize("start,short", [("2024-03-09 05:00", 23), ("2024-11-02 04:00", 25)])
def test_complete_day_counts_true_hours(spark, start, short):
    bars = index_bars(grid(spark, start, 96), 900)
    days = anchored_blocks(bars, 900, FRAMES["NY_D1"]).toPandas()
    assert short * 4 in days.bar_count.tolist()


@pytest.mark.parametrize("start", ["2024-03-10 00:00", "2024-11-03 00:00"])
def test_expected_window_is_over_and_latest(spark, start):
    cfg = FRAMES["NY_H1"]
    d = grid(spark, start, 24).select(F.col("ts").alias("t")).withColumns(expected_window(F.col("t"), cfg)).toPandas()
    assert (d.block_end <= d.t).all() and (d.block_start < d.block_end).all()
    assert ((d.t - d.block_end) < pd.Timedelta(hours=2)).all()


def test_nonexistent_session_boundary_is_null(spark):
    from barloom.operators.blocks import Session
    s = Session("X", "America/New_York", 150, 600)  # starts 02:30 local
    d = spark.sql("SELECT date'2024-03-10' AS d UNION ALL SELECT date'2024-03-11'").withColumns(session_window(F.col("d"), s)).orderBy("d").toPandas()
    assert pd.isna(d.start.iloc[0]) and not pd.isna(d.start.iloc[1])


def test_overnight_sessions(spark):
    from barloom.operators.blocks import Session
    bars = index_bars(grid(spark, "2024-01-01", 72), 900)
    got = completed_sessions(bars, 900, [Session("N", "UTC", 1320, 360)]).toPandas()
    assert len(got) == 2 and (got.bar_count == 32).all()


def test_parse_ts_gap_and_overlap(spark):
    rows = [("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-06-01 12:00:00",), ("2024-06-01T12:00:00Z",), ("junk",)]
    got = spark.createDataFrame(rows, "s string").select(parse_ts("s", zone="America/New_York").alias("t")).toPandas().t
    assert got.isna().tolist() == [True, True, False, False, True]
    assert got[2] == pd.Timestamp("2024-06-01 16:00") and got[3] == pd.Timestamp("2024-06-01 12:00")
    ms = spark.createDataFrame([("1700000000123",), ("1.5",)], "s string").select(parse_ts("s", "EPOCH_MS").alias("t")).toPandas().t
    assert ms[0] == pd.Timestamp(1700000000123, unit="ms") and pd.isna(ms[1])


def test_block_config_validates():
    with pytest.raises(ValueError):
        BlockConfig(minutes=100)
