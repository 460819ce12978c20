"""Level events against a direct bar-by-bar reading of the rules."""
import pytest
from pyspark.sql import functions as F

from barloom.operators import labels, levels as L, swings as S
from barloom.operators.blocks import anchored_blocks
from barloom.operators.timeline import index_bars
from barloom.plans.event_table import build_event_table
from barloom.sources.stage import stage
from test_timeline import STEP, walk

PRESETS = (("NEAR", -0.5), ("FAR", -3.0))


@pytest.fixture(scope="module")
def indexed(spark):
    return stage(index_bars(spark.createDataFrame(walk(300, seed=4, holes=(150,))), STEP))


def brute(bars, levels, horizon):
    out = set()
    for seg, g in bars.groupby("seg"):
        g = g.sort_values("pos").reset_index(drop=True)
        g = g.iloc[:max(0, len(g) - horizon)]
        for l in levels[levels.seg == seg].itertuples():
            h = g[g.ts >= l.available_at]
            state = ["ABOVE" if lo > l.level_price else "BELOW" if hi < l.level_price else "TOUCH" for lo, hi in zip(h.low, h.high)]
            runs = []
            for i, s in enumerate(state):
                if not runs or runs[-1][0] != s:
                    runs.append([s, i])
            k = 0
            for j, (s, i) in enumerate(runs):
                if s == "TOUCH":
                    before = runs[j - 1][0] if j else "START"
                    if j + 1 < len(runs):
                        out.add((l.level_id, l.block_start, int(h.pos.iloc[runs[j + 1][1]]), f"{before}_TOUCH_{runs[j + 1][0]}", k, None))
                    k += 1
            for n in (4, 8, 16, 32):
                if len(state) >= n and "TOUCH" not in state[:n]:
                    out.add((l.level_id, l.block_start, int(h.pos.iloc[n - 1]), None, None, n))
    return out


@pytest.mark.parametrize("horizon", [4, 32])
def test_anchors_match_bar_by_bar(spark, indexed, horizon):
    from barloom.plans.event_table import level_events
    prefix = L.neighbour_bars(indexed, horizon, 64)
    levels = L.explode_levels(L.geometry_instances(anchored_blocks(prefix, STEP), PRESETS)).toPandas()
    got = level_events(indexed, STEP, levels=PRESETS, horizon=horizon, chunk_rows=64).toPandas()
    none = lambda v: None if v is None or v != v else v
    mine = {(r.level_id, r.block_start, int(r.pos), none(r.pattern_code), none(r.pattern_index), none(r.checkpoint_bars)) for r in got.itertuples()}
    want = brute(indexed.toPandas(), levels, horizon)
    assert len(mine) == len(got) and mine == want and len(want) > 50


def test_event_table_never_hosts_an_event_without_outcomes(spark, indexed):
    t = build_event_table(indexed, STEP, horizons=(1, 4), chunk_rows=128, levels=PRESETS)
    assert t.filter("`y.h4.end_close` is null or `y.h1.first_open` is null").count() == 0
    assert t.count() > 0 and len([c for c in t.columns if c.startswith("x.")]) > 120


def trade(spark, rows, **kw):
    """Three M1 bars and one intent."""
    bars = spark.createDataFrame([("E", i, 1704067200 + 60 * i, *r) for i, r in enumerate(rows)],
                                 "symbol string, pos long, s long, open double, high double, low double, close double, spread double")
    bars = bars.withColumn("ts", F.timestamp_seconds("s")).withColumn("prev_ts", F.when(F.col("pos") > 0, F.timestamp_seconds(F.col("s") - 60)))
    base = dict(intent_id="i", direction="LONG", entry_type="NEXT_OPEN", stop=99.0, target=102.0, limit_price=None)
    base.update(kw)
    it = spark.createDataFrame([("E", base["intent_id"], base["direction"], base["entry_type"], 1704067200, base["stop"], base["target"], base["limit_price"], 1.0)],
                               "symbol string, intent_id string, direction string, entry_type string, s long, stop double, target double, limit_price double, quantity double"
                               ).withColumn("signal_ts", F.timestamp_seconds("s")).drop("s")
    return labels.label_intents(it, labels.execution_bars(bars, 60), 60).first()


def test_label_truths(spark):
    flat = (100.0, 100.5, 99.5, 100.0, 0.0)
    assert trade(spark, [flat, (100.0, 102.5, 99.5, 102.0, 0.0)]).exit_reason == "TAKE_PROFIT"
    both = trade(spark, [flat, (100.0, 103.0, 98.0, 100.0, 0.0)])
    assert (both.exit_reason, both.exit_price, both.net_r) == ("SAME_BAR_AMBIGUOUS_SL_FIRST", 99.0, -1.0)
    gap = trade(spark, [flat, (97.0, 98.0, 96.0, 97.5, 0.0)])
    assert (gap.exit_reason, gap.exit_price) == ("GAP_THROUGH_SL", 97.0)
    assert trade(spark, [flat, flat]).status == "OPEN"
    short = trade(spark, [flat, (100.0, 100.8, 99.5, 100.0, 0.5)], direction="SHORT", stop=101.0, target=98.0)
    assert short.exit_reason == "STOP_LOSS"  # ask high 101.3 reaches the stop
    assert trade(spark, [flat], stop=101.0).rejection_reason == "INVALID_STOP_LOSS"
    assert trade(spark, [flat], entry_type="STOP").rejection_reason == "UNSUPPORTED_ENTRY_TYPE"
    assert trade(spark, [flat, (99.8, 100.0, 99.2, 99.9, 0.0)], entry_type="LIMIT", limit_price=99.3).entry_price == 99.3


def test_strict_pivots(spark):
    rows = [("E", i, float(h), float(h) - 1) for i, h in enumerate([1, 2, 5, 2, 1, 5, 5, 1, 0.5])]
    d = spark.createDataFrame(rows, "symbol string, pos long, high double, low double").withColumns(
        {"seg": F.lit(0).cast("long"), "seg_pos": F.col("pos"), "ts": F.timestamp_seconds(F.col("pos") * 60)})
    got = [(r.kind, r.pos) for r in S.confirmed_swings(d, chunk_rows=4).collect()]
    assert sorted(got) == [("HIGH", 2), ("LOW", 4)]


def test_transitions_stop_at_missing_bars(spark):
    from barloom.operators.outcomes import transition_outcomes
    rows = [("A", 0 if p < 12 else 1, p, p % 3) for p in range(20) if p != 5]
    d = spark.createDataFrame(rows, "symbol string, seg long, pos long, state long").withColumn("ts", F.timestamp_seconds(F.col("pos") * 900))
    want = {p: None if {p + 1, p + 2} <= set(range(20)) - {5} and (p >= 12 or p < 10) else "insufficient_future_observations" if p >= 18 else "gap_or_segment_boundary" for p in range(20) if p != 5}
    for chunk in (4, 7, 100):
        got = {r.pos: r.exclusion for r in transition_outcomes(d, [2], chunk_rows=chunk).collect()}
        assert got == want
