"""Numbering shuffles rows once, scopes follow one shuffle, figures without order need none."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ledger as G
from barloom.operators.timeline import number_rows


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_numbers_come_from_the_place_in_the_sorted_partition(spark):
    d = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("day"), "id", F.lit("x").alias("note"))
    n = number_rows(d, ["day", "id"], drop=["note"])
    assert n.columns == ["day", "id", "idx"] and plan(n).count("Window [") == 1  # over one row per partition
    rows = sorted(n.collect(), key=lambda r: r.idx)
    assert [r.idx for r in rows] == list(range(5000)) and [(r.day, r.id) for r in rows] == sorted((r.day, r.id) for r in rows)
    assert number_rows(d.limit(0), ["day", "id"]).count() == 0


def trades(spark, n=3000):
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(900)).cast("int"))
    return spark.range(n).select(F.col("id").cast("string").alias("trade_id"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("symbol"), F.when(F.col("id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
                                 day.alias("exit_ts"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) - 4).cast("double").alias("net_r"), F.when(F.col("id") % 5 == 0, "REJECTED").otherwise("CLOSED").alias("status"))


def test_scopes_follow_one_shuffle_of_the_path(spark):
    path = G.resolved_path(trades(spark), drop=["trade_id"])
    got = {(r.scope, r.scope_key): r.max_drawdown_r for r in G.breakdown(path).collect()}
    rows = sorted(path.collect(), key=lambda r: r.idx)
    for key, keep in {("ALL", "ALL"): lambda r: True, ("SYMBOL", "A"): lambda r: r.symbol == "A", ("YEAR", "2021"): lambda r: r.exit_ts.year == 2021, ("DIRECTION", "LONG"): lambda r: r.direction == "LONG"}.items():
        eq = np.r_[0.0, np.cumsum([r.net_r for r in rows if keep(r)])]
        assert got[key] == pytest.approx((np.maximum.accumulate(eq) - eq).max())
    exchanges = re.findall(r"Exchange hashpartitioning\(scope#\d+, scope_key#\d+, _k", plan(G.breakdown(path)))
    assert not exchanges


def test_rates_need_no_order(spark):
    t = trades(spark)
    rates = G.resolved_rates(G.resolved(t), ["symbol"])
    assert "Window" not in plan(rates) and "rangepartitioning" not in plan(rates)
    whole = G.ledger_summary(t, ["symbol"]).select(*rates.columns)
    assert sorted(map(tuple, rates.collect())) == sorted(map(tuple, whole.collect()))
