"""Counted overlaps and summed ranges against plain loops."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import joins as J

T0 = dt.datetime(2024, 1, 1)
C = F.col


def at(minutes):
    return T0 + dt.timedelta(minutes=int(minutes))


@pytest.mark.parametrize("part", [4, 37, 65536])
def test_overlap_counts_equal_the_pairs(spark, part):
    rng = np.random.default_rng(3)
    rows = []
    for symbol, n, last in (("A", 150, 60), ("B", 40, 5), (None, 12, 20)):  # many equal instants in B
        for i, (s, w) in enumerate(zip(rng.integers(0, last, n), rng.integers(0, 12, n))):
            rows.append((symbol, int(i * 7 % 1009), at(s), at(s + w)))  # some are empty
    got = {(r.symbol, r.id): (r.smaller, r.larger) for r in J.overlap_counts(
        spark.createDataFrame(rows, "symbol string, id long, s timestamp, e timestamp"), ["symbol"], id="id", start="s", end="e", part=part).collect()}
    full = [r for r in rows if r[2] < r[3]]
    want = {}
    for g, i, s, e in full:
        meets = [j for h, j, s2, e2 in full if h == g and j != i and s < e2 and s2 < e]
        want[g, i] = (sum(j < i for j in meets), sum(j > i for j in meets))
    assert got == want


def test_overlapping_sources_form_no_pairs(spark, tmp_path):
    """One catalog of 3,000 intervals that all overlap: 4.5 million pairs, none of which may be a row of the plan."""
    n = 3000
    o = spark.range(2 * n).select(F.lit("1-URGENT").alias("o_orderpriority"), (C("id") % n).alias("o_custkey"),
                                  F.timestamp_seconds(F.lit(800000000) + F.floor(C("id") / n) * 86400 * 400 + C("id") % n).alias("o_orderdate"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    from barloom.catalog import load
    q = load().queries["q10_source_overlap_pairs"](spark, str(tmp_path))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "a_id" not in plan and "b_id" not in plan
    r = q.collect()
    ids = np.arange(n)
    assert [tuple(x) for x in r] == [("1-URGENT", n * (n - 1) // 2, int((ids * (n - 1 - ids)).sum()), int((ids * ids).sum()))]


@pytest.mark.parametrize("part", [4, 41, 65536])
def test_range_summary_equals_the_join(spark, part):
    rng = np.random.default_rng(5)
    points = [(s, at(m), None if rng.random() < 0.1 else float(v)) for s, n in (("A", 200), ("B", 30), (None, 5)) for m, v in zip(rng.integers(0, 90, n), rng.normal(size=n))]
    points += [("C", at(m), None) for m in range(5)] + [("A", None, 9.0), ("A", at(200), float("nan"))]
    ranges = [(i % 50, s, at(m), at(m + w)) for s in ("A", "B", "C", "D", None) for i, (m, w) in enumerate(zip(rng.integers(-5, 95, 60), rng.integers(0, 70, 60)))]
    ranges += [(70, "A", at(150), at(250)), (71, "A", at(-9), None)]
    p = spark.createDataFrame(points, "symbol string, ts timestamp, v double")
    r = spark.createDataFrame(ranges, "rid long, symbol string, s timestamp, e timestamp")
    key = lambda d: sorted(map(str, d.select("rid", "symbol", "s", "e", "n", "high").collect()))
    numbered = r.withColumn("i", F.monotonically_increasing_id())
    want = J.range_join(p, numbered, ["symbol"], ts="ts", start="s", end="e", bucket_seconds=600).groupBy("i", "rid", "symbol", "s", "e").agg(F.count("*").alias("n"), F.max("v").alias("high"))
    assert key(J.range_summary(p, r, ["symbol"], "v", ts="ts", start="s", end="e", part=part)) == key(want)


def test_crowded_half_hours_form_no_pairs(spark, tmp_path):
    """4,000 ticks within a minute: 8 million (range, tick) pairs."""
    n = 4000
    e = spark.range(n).select(C("id").alias("event_id"), F.timestamp_millis(F.lit(1700000000000) + C("id")).alias("ts"), (C("id") * 2).alias("user_id"), F.lit("view").alias("event_type"),
                              C("id").cast("double").alias("value"), F.lit("").alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    from barloom.catalog import load
    q = load().queries["f05_range_join"](spark, str(tmp_path))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "_b" not in plan and "1800" not in plan  # the buckets of the range join
    assert {(r.rid, r.ticks, r.high) for r in q.collect()} == {(i, n - i, n + 99.0) for i in range(n)}
