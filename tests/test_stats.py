"""Rank statistics against brute force, over several parts."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import joins as J, ledger as G, stats as S, timeline


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(7)
    p = pd.DataFrame(dict(g=rng.choice(["a", "b", "b", "b"], 900), v=rng.normal(size=900).round(2), left=rng.random(900) < 0.3))
    p.loc[::3, "v"] = 0.25  # a third of the rows share one value
    return p, spark.createDataFrame(p)


def test_quantiles_match_numpy(data):
    p, d = data
    got = S.quantiles(d, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas().set_index("g")
    for g, x in p.groupby("g"):
        assert got.loc[g, ["a", "b", "c"]].tolist() == pytest.approx(np.quantile(x.v, [0.1, 0.5, 0.93]).tolist())


def test_comparison_matches_pairs(data):
    p, d = data
    got = S.compare_cohorts(d, ["g"], F.col("left"), "v").toPandas().set_index("g")
    for g, x in p.groupby("g"):
        a, b = x.v[x.left].to_numpy(), x.v[~x.left].to_numpy()
        greater = (a[:, None] > b[None, :]).sum()
        less = (a[:, None] < b[None, :]).sum()
        assert got.loc[g, "greater"] == greater and got.loc[g, "less"] == less
        assert got.loc[g, "cliffs_delta"] == pytest.approx((greater - less) / (len(a) * len(b)))
        assert got.loc[g, "left_median"] == pytest.approx(np.median(a))


def test_concurrency_matches_pairs(spark):
    rng = np.random.default_rng(5)
    start = rng.integers(0, 60, 200)
    p = pd.DataFrame(dict(id=range(200), symbol=rng.choice(list("xyz"), 200), entry_ts=pd.to_datetime("2024-01-01") + pd.to_timedelta(start, unit="D")))
    p["exit_ts"] = p.entry_ts + pd.to_timedelta(rng.integers(0, 9, 200), unit="D")  # some have no length
    got = J.concurrent_trades(spark.createDataFrame(p)).toPandas().set_index("id").overlaps
    for r in p.itertuples():
        other = p[(p.symbol != r.symbol) & (p.entry_ts < r.exit_ts) & (r.entry_ts < p.exit_ts)]
        assert got[r.id] == len(other), r


def test_busy_hour_is_many_chunks(spark):
    rng = np.random.default_rng(6)
    quiet = rng.integers(0, 3 * 365 * 86400, 1000)
    busy = 400 * 86400 + rng.integers(0, 3600, 9000)  # nine tenths of one symbol lie in an hour
    start = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.r_[quiet, busy], unit="s")
    p = pd.DataFrame(dict(id=range(10000), symbol="x", entry_ts=start, exit_ts=start + pd.to_timedelta(rng.integers(1, 900, 10000), unit="s")))
    p.loc[::2, "symbol"] = "y"
    d = spark.createDataFrame(p)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts this small would be put together
    try:
        sizes = [r["count"] for r in timeline.equal_depth(d.withColumn("_o", F.unix_micros("entry_ts")), [], "_o").groupBy("_chunk").count().collect()]
        got = J.concurrent_trades(d).toPandas().set_index("id").overlaps
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 4 * np.median(sizes)
    for r in p.sample(300, random_state=1).itertuples():
        other = p[(p.symbol != r.symbol) & (p.entry_ts < r.exit_ts) & (r.entry_ts < p.exit_ts)]
        assert got[r.id] == len(other), r
    left = d.select("id", "symbol", F.col("entry_ts").alias("ts"))
    back = J.asof_join(left, d.select("symbol", "exit_ts"), ["symbol"], ["exit_ts"], right_ts="exit_ts").toPandas().set_index("id").exit_ts
    for r in p.sample(300, random_state=2).itertuples():
        done = p[(p.symbol == r.symbol) & (p.exit_ts <= r.entry_ts)].exit_ts
        assert (pd.isna(back[r.id]) and done.empty) or back[r.id] == done.max()


def test_path_metrics_and_detail(spark):
    rng = np.random.default_rng(11)
    r = rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0], 700)
    d = spark.createDataFrame(pd.DataFrame(dict(ledger="L", idx=range(700), net_r=r)))
    eq = np.r_[0, np.cumsum(r)]
    dd = np.maximum.accumulate(eq) - eq
    best = {s: max(len(x) for x in "".join("1" if k else "0" for k in (r * s > 0)).split("0")) for s in (1, -1)}
    m = G.path_metrics(d, ["ledger"], chunk_rows=33).first()
    assert (m.max_drawdown_r, m.longest_win_streak, m.longest_loss_streak) == (pytest.approx(dd.max()), best[1], best[-1])
    x = G.drawdown_detail(d, chunk_rows=33).first()
    i = int(np.argmax(dd))
    s = int(np.argmax(eq[:i + 1]))
    rec = next((j for j in range(i + 1, 701) if eq[j] >= eq[s]), None)
    assert (x.trough, x.start, x.recovery) == (i, s, rec)
    assert x.longest_duration == max(j - int(np.argmax(eq[:j + 1])) for j in range(701))


def test_first_hit_matches_scan(spark):
    rng = np.random.default_rng(2)
    n = 9000  # three tree levels
    c = 100 + np.cumsum(rng.normal(0, 0.2, n))
    b = pd.DataFrame(dict(symbol="A", pos=range(n), low=c - 0.1, high=c + 0.1, ask_low=c, ask_high=c + 0.2))
    q = pd.DataFrame(dict(symbol="A", id=range(300), start=rng.integers(0, n, 300), up=rng.uniform(95, 130, 300)))
    bars = spark.createDataFrame(b)
    got = J.first_hit(spark.createDataFrame(q), J.extreme_tree(bars), "start", lambda x: x["high"] >= F.col("up")).toPandas().set_index("id").hit_pos
    for r in q.itertuples():
        hits = np.flatnonzero(b.high.to_numpy()[r.start:] >= r.up)
        assert (pd.isna(got[r.id]) and not len(hits)) or got[r.id] == r.start + hits[0]


def test_near_duplicates_match_pairs(spark):
    rng = np.random.default_rng(9)
    specs = {i: {k: str(rng.integers(0, 3)) for k in rng.choice(list("abcd"), rng.integers(2, 5), replace=False)} for i in range(60)}
    rows = [("f", i, k, v) for i, s in specs.items() for k, v in s.items()]
    got = {(r.a, r.b): r.differing for r in J.near_duplicates(spark.createDataFrame(rows, "family string, spec_id long, path string, value string")).collect()}
    first = {}
    for i, s in specs.items():
        first.setdefault(tuple(sorted(s.items())), i)
    want = {}
    for x, i in first.items():
        for y, j in first.items():
            diff = sum(dict(x).get(k) != dict(y).get(k) for k in set(dict(x)) | set(dict(y)))
            if i < j and 0 < diff <= 2:
                want[(i, j)] = diff
    assert got == want


def test_scan_of_many_conditions_matches_a_plain_one(spark):
    """A field with 150 conditions, some of them without a value, and the pairs of two small fields."""
    rng = np.random.default_rng(6)
    p = pd.DataFrame(dict(e=rng.choice(["x", "y"], 1500), f=rng.integers(0, 150, 1500), g=rng.choice(["u", "v", "w"], 1500), h=rng.choice(["s", "t"], 1500), t=rng.integers(0, 40, 1500).astype(float)))
    p.loc[p.f == 7, "t"] = np.nan
    p.loc[::11, "t"] = np.nan
    d = spark.createDataFrame([(r.e, int(r.f), r.g, r.h, None if np.isnan(r.t) else r.t) for r in p.itertuples()], "e string, f int, g string, h string, t double")

    def plain(l, r):
        a, b = l.t.dropna().to_numpy(), r.t.dropna().to_numpy()
        gt, tie = int((a[:, None] > b).sum()), int((a[:, None] == b).sum())
        pairs = len(a) * len(b)
        mid = lambda v: float(np.median(v)) if len(v) else None
        return (len(l), len(r), len(a), len(b), mid(a), mid(b), float(gt), float(tie), pytest.approx((2 * gt + tie - pairs) / pairs) if pairs else None)

    said = lambda r: (r.left_rows, r.right_rows, r.left_observed, r.right_observed, r.left_median, r.right_median, r.greater, r.ties, r.cliffs_delta)
    got = {(r.event, r.cond): said(r) for r in S.scan_single(d, "e", ["f"], ["t"]).collect()}
    want = {(e, f'["int","{f}"]'): plain(x[x.f == f], x[x.f != f]) for e, x in p.groupby("e") for f in x.f.unique()}
    assert got == want and len(got) > 250
    got = {(r.event, r.a, r.b, r.versus): said(r) for r in S.scan_pairs(d, "e", ["g", "h"], ["t"]).collect()}
    text = lambda v: f'["string","{v}"]'
    want = {}
    for e, x in p.groupby("e"):
        for g in "uvw":
            for h in "st":
                both = (x.g == g) & (x.h == h)
                for versus, rest in (("EVENT", ~both), ("LEFT", (x.g == g) & ~both), ("RIGHT", (x.h == h) & ~both)):
                    want[(e, text(g), text(h), versus)] = plain(x[both], x[rest])
    assert got == want
