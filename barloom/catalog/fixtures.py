"""Check inputs derived from the given tables, once per engine.

Spark builders return DataFrames; the SQL strings are the leading CTEs of an oracle.
Timestamps leave the checks as epoch seconds, doubles rounded, counts as BIGINT.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.timeline import index_bars
from barloom.sources.stage import stage

H1, M15 = 3600, 900
CHUNK = 512  # small on purpose: the checks must cross chunk edges


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("symbol"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "A").otherwise("B").alias("feed"),
        F.round(F.col("value") + 100.0, 2).alias("bid"),
        F.round(F.col("value") + 100.0 + (F.col("event_id") % 5) * 0.01, 2).alias("ask"))


def bars(spark, sf, step=H1, by=("symbol",)) -> DataFrame:
    from barloom.sources.ticks import ticks_to_bars
    return ticks_to_bars(ticks(spark, sf), step, keys=by, price="BID")


_STAGED: dict[tuple, DataFrame] = {}


def staged(spark, sf, name: str, make) -> DataFrame:
    """Bar tables are built once per session and table set, as a stored bar table would be."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _STAGED[key] = stage(make(), "symbol", "ts")
    return _STAGED[key]


def indexed(spark, sf, step=H1) -> DataFrame:
    """Numbered bars; small buckets so that the checks cross bucket edges."""
    made = staged(spark, sf, f"bars{step}", lambda: bars(spark, sf, step))
    return staged(spark, sf, f"indexed{step}", lambda: index_bars(made, step, bucket_rows=200))


def dirty(spark, sf) -> DataFrame:
    """H1 bars with injected faults keyed by row number (see FIXTURES.md)."""
    b = indexed(spark, sf).withColumn("n", F.col("pos") + 1)
    n = F.col("n")
    base = b.select(
        "symbol", F.when(n % 31 == 0, F.col("ts") + F.expr("INTERVAL 7 MINUTES")).otherwise(F.col("ts")).alias("ts"),
        F.when(n % 29 == 0, -1.0).otherwise(F.col("open")).alias("open"),
        F.when(n % 23 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low", "close", "tick_volume", F.lit(0).alias("copy"), (n * 10).alias("seq"))
    same = b.filter(n % 17 == 0).select("symbol", "ts", "open", "high", "low", "close", "tick_volume", F.lit(1).alias("copy"), (n * 10 + 1).alias("seq"))
    other = b.filter(n % 19 == 0).select("symbol", "ts", "open", "high", "low", (F.col("close") + 1).alias("close"),
                                         "tick_volume", F.lit(2).alias("copy"), (n * 10 + 2).alias("seq"))
    return base.unionByName(same).unionByName(other)


def trades(spark, sf) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), day.cast("string")).alias("trade_id"),
        F.col("l_returnflag").alias("symbol"),
        F.when(F.col("l_linestatus") == "F", "LONG").otherwise("SHORT").alias("direction"),
        day.alias("entry_ts"), F.date_add(day, F.col("l_quantity").cast("int")).alias("exit_ts"),
        F.round((F.lit(0.05) - F.col("l_discount")) * F.col("l_quantity") / 10, 4).alias("net_r"),
        F.when(F.col("l_tax") >= 0.08, "REJECTED").otherwise("CLOSED").alias("status"))


def states(spark, sf) -> DataFrame:
    """H1 bars with an efficiency-ratio state 0..2 cut at fixed ratios."""
    from barloom.operators.windows import with_lags
    b = indexed(spark, sf)
    b = with_lags(b, chunk_rows=CHUNK)
    er = F.round(F.col("er_8"), 6)
    return (b.filter(F.col("er_8").isNotNull())
            .select("symbol", "seg", "pos", "seg_pos", "ts", "open", "high", "low", "close", er.alias("er"),
                    F.when(er < 0.1, 0).when(er < 0.25, 1).otherwise(2).alias("state")))


TICKS = """fx_ticks AS (
 SELECT event_id AS seq, ts, concat('S', cast(user_id % 2 AS varchar)) AS symbol,
        CASE WHEN event_type IN ('click','view','signup') THEN 'A' ELSE 'B' END AS feed,
        round(value + 100.0, 2) AS bid, round(value + 100.0 + (event_id % 5) * 0.01, 2) AS ask FROM events)"""


def bars_sql(step: int = H1, by: str = "symbol", name: str = "b") -> str:
    bucket = f"make_timestamp(CAST(floor(epoch(ts) / {step}) AS BIGINT) * {step} * 1000000)"
    return f"""{TICKS}, {name} AS (
 SELECT {by}, {bucket} AS ts, arg_min(bid, seq) AS open, max(bid) AS high, min(bid) AS low,
        arg_max(bid, seq) AS close, count(*) AS tick_volume, arg_max(round(ask - bid, 2), seq) AS spread
 FROM fx_ticks GROUP BY {by}, {bucket})"""


def indexed_sql(step: int = H1) -> str:
    """bars plus pos, seg, seg_pos under the any-gap rule, as CTE ``x``."""
    return f"""{bars_sql(step)}, g AS (
 SELECT *, row_number() OVER w - 1 AS pos, lag(ts) OVER w AS prev_ts,
        CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > {step} THEN 1 ELSE 0 END AS cut
 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)), g2 AS (
 SELECT *, CAST(sum(cut) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS seg FROM g), x AS (
 SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY ts) - 1 AS seg_pos FROM g2)"""


DIRTY = f"""{bars_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM b), dirty AS (
 SELECT symbol, CASE WHEN n % 31 = 0 THEN ts + INTERVAL 7 MINUTE ELSE ts END AS ts,
        CASE WHEN n % 29 = 0 THEN -1.0 ELSE open END AS open, CASE WHEN n % 23 = 0 THEN low - 1 ELSE high END AS high,
        low, close, tick_volume, 0 AS copy, n * 10 AS seq FROM n
 UNION ALL SELECT symbol, ts, open, high, low, close, tick_volume, 1, n * 10 + 1 FROM n WHERE n % 17 = 0
 UNION ALL SELECT symbol, ts, open, high, low, close + 1, tick_volume, 2, n * 10 + 2 FROM n WHERE n % 19 = 0)"""

TRADES = """t AS (
 SELECT concat_ws('-', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar), cast(l_partkey AS varchar),
                  cast(l_suppkey AS varchar), cast(cast(l_shipdate AS date) AS varchar)) AS trade_id,
        l_returnflag AS symbol, CASE WHEN l_linestatus = 'F' THEN 'LONG' ELSE 'SHORT' END AS direction,
        cast(l_shipdate AS date) AS entry_ts, cast(l_shipdate AS date) + cast(l_quantity AS int) AS exit_ts,
        round((0.05::DOUBLE - l_discount) * l_quantity / 10, 4) AS net_r,
        CASE WHEN l_tax >= 0.08 THEN 'REJECTED' ELSE 'CLOSED' END AS status FROM lineitem)"""

STATES = f"""{indexed_sql()}, s0 AS (
 SELECT *, abs(close - lag(close) OVER w) AS d1, abs(close - lag(close, 8) OVER w) AS d8 FROM x
 WINDOW w AS (PARTITION BY symbol, seg ORDER BY pos)), s1 AS (
 SELECT *, sum(d1) OVER (PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS path FROM s0), s2 AS (
 SELECT *, round(CASE WHEN seg_pos >= 8 THEN CASE WHEN path = 0 THEN 0 ELSE d8 / path END END, 6) AS er FROM s1), s AS (
 SELECT symbol, seg, pos, seg_pos, ts, open, high, low, close, er,
        CASE WHEN er < 0.1 THEN 0 WHEN er < 0.25 THEN 1 ELSE 2 END AS state FROM s2 WHERE er IS NOT NULL)"""


def ep(col: str) -> str:
    return f"CAST(epoch({col}) AS BIGINT)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, cast integers to BIGINT and timestamps to epoch seconds."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "timestamp":
            c = F.unix_seconds(c)
        out.append(c.alias(f.name))
    return df.select(*out)


class Catalog:
    """Named queries with their optional SQL twins."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None, digits: int = 6):
        def wrap(fn):
            self.queries[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
            if sql:
                self.sql[name] = sql
            return fn
        return wrap
