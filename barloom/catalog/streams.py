"""Group M: streaming twins replayed over the event table."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import M15, TICKS, bars_sql, ep, indexed
from barloom.catalog.windows import base
from barloom.streaming import live as L

C = F.col


def tick_stream(s, sf):
    """The events table as a file stream, mapped like the batch ticks."""
    s.conf.set("spark.sql.session.timeZone", "UTC")
    e = s.readStream.schema(s.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    return e.select(C("event_id").alias("seq"), C("ts").cast("timestamp").alias("ts"), F.concat(F.lit("S"), (C("user_id") % 2).cast("string")).alias("symbol"),
                    F.round(C("value") + 100.0, 2).alias("bid"), F.round(C("value") + 100.0 + (C("event_id") % 5) * 0.01, 2).alias("ask"))


def bar_stream(s, sf):
    """The stored bar table as a file stream."""
    stored = indexed(s, sf, M15)
    return s.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])


def register(cat):
    @cat.add("m01_stream_bars", f"WITH {bars_sql(M15)}, e AS (SELECT epoch_ms(max(ts)) - 600000 AS w FROM events) SELECT symbol, {ep('ts')} AS ts, open, high, low, close, tick_volume, spread FROM b, e WHERE epoch_ms(ts) + 900000 <= w")
    def _(s, sf): return L.run_to_table(L.stream_bars(tick_stream(s, sf), M15), "bars")

    @cat.add("m04_sliding_range", f"WITH {TICKS}, e AS (SELECT epoch_ms(max(ts)) - 600000 AS w FROM events), g AS (SELECT symbol, (floor(epoch(ts) / 900) * 900)::BIGINT - k.k * 900 AS s, bid FROM fx_ticks, (VALUES (0), (1), (2), (3)) k(k)) SELECT symbol, s AS from_ts, s + 3600 AS to_ts, max(bid) AS high, min(bid) AS low, round(max(bid) - min(bid), 6) AS range, count(*) AS ticks FROM g, e WHERE (s + 3600) * 1000 <= w GROUP BY symbol, s")
    def _(s, sf): return L.run_to_table(L.sliding_range(tick_stream(s, sf), "60 minutes", "15 minutes"), "slide")

    W = "(PARTITION BY symbol, seg ORDER BY pos)"
    AGE = f"st AS (SELECT *, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS state FROM a), ch AS (SELECT *, lag(state) OVER {W} AS p FROM st), rn AS (SELECT *, sum(CASE WHEN p = state THEN 0 ELSE 1 END) OVER {W} AS run FROM ch)"

    @cat.add("m03_live_state", f"{base()}, {AGE} SELECT symbol, {ep('ts')} AS ts, close, seg, seg_pos, round(atr, 6) AS atr, state, first_value(p) OVER r AS previous_state, row_number() OVER r AS state_age, false AS late FROM rn WINDOW r AS (PARTITION BY symbol, seg, run ORDER BY pos)")
    def _(s, sf):
        b = bar_stream(s, sf)
        state = F.when(C("close") > C("open"), "up").when(C("close") < C("open"), "down").otherwise("flat")
        return L.run_to_table(L.live_state(b.withColumn("state", state), M15), "live")
