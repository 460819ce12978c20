"""Ticks: bars, inventories, feed normalisation and binary hour decoding."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.timeline import running


def floor_ts(ts: str | Column, step: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_seconds(c) / F.lit(step)) * step)


def ticks_to_bars(ticks: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), price: str = "BID",
                  spread_stats: bool = False) -> DataFrame:
    """OHLC, tick count and last spread per bucket; ties keep source order (``seq``).

    Every aggregate is combinable, so ticks are reduced before the shuffle and a hot
    symbol costs one row per bucket and map task.
    """
    px = {"BID": F.col("bid"), "ASK": F.col("ask"), "MID": (F.col("bid") + F.col("ask")) / 2}[price]
    spread = F.col("ask") - F.col("bid")
    aggs = [F.min_by(px, "seq").alias("open"), F.max(px).alias("high"), F.min(px).alias("low"),
            F.max_by(px, "seq").alias("close"), F.count("*").alias("tick_volume"), F.max_by(spread, "seq").alias("spread")]
    if spread_stats:
        aggs += [F.min_by(spread, "seq").alias("spread_open"), F.min(spread).alias("spread_min"),
                 F.max(spread).alias("spread_max"), F.avg(spread).alias("spread_mean")]
    return (ticks.withColumn("_bucket", floor_ts("ts", step)).groupBy(*keys, "_bucket").agg(*aggs)
            .withColumnRenamed("_bucket", "ts"))


def mark_partial_boundary(bars: DataFrame, ticks: DataFrame, step: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Flag buckets not fully inside [ceil(first tick), floor(last tick))."""
    ends = ticks.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    lower = F.ceil(F.unix_micros("_first") / F.lit(step * 1_000_000)) * step
    upper = F.floor(F.unix_micros("_last") / F.lit(step * 1_000_000)) * step
    at = F.unix_seconds("ts")
    return (bars.join(ends, list(keys)).withColumn("partial_boundary", (at < lower) | (at >= upper))
            .drop("_first", "_last"))


def tick_faults(ticks: DataFrame, keys: Sequence[str] = ("symbol",), bucket_seconds: int = 3600) -> DataFrame:
    """Counts of crossed quotes, invalid prices and backward timestamps in source order.

    ``seq`` is the source position; the predecessor is found inside position buckets
    with one summary row per bucket for the edges.
    """
    keys = list(keys)
    size = 65536
    t = ticks.withColumn("_b", F.floor(F.col("seq") / F.lit(size)))
    inner = W.partitionBy(*keys, "_b").orderBy("seq")
    edge = (t.groupBy(*keys, "_b").agg(F.max_by("ts", "seq").alias("_last"))
            .withColumn("_edge", F.lag("_last").over(W.partitionBy(*keys).orderBy("_b"))).drop("_last"))
    prev = F.coalesce(F.lag("ts").over(inner), F.col("_edge"))
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = t.join(edge, [*keys, "_b"]).withColumn("_prev", prev)
    ok = lambda c: F.col(c).isNotNull() & (F.col(c) > 0)
    return t.groupBy(*keys).agg(
        F.count("*").alias("ticks"), bad(F.col("ask") < F.col("bid")).alias("crossed"),
        bad(~(ok("bid") & ok("ask"))).alias("invalid"), bad(F.col("ts") < F.col("_prev")).alias("backward"),
        bad(F.col("ts") == F.col("_prev")).alias("duplicate_ts"))


def tick_hour_manifest(ticks: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Counts, ends, repeated timestamps, spread statistics and a content digest per hour.

    A repeated timestamp is counted as ticks minus distinct timestamps, with a first
    aggregation per timestamp so no hour is collected anywhere.
    """
    keys = list(keys)
    spread = F.col("ask") - F.col("bid")
    digest = F.xxhash64("seq", "ts", "bid", "ask")
    per_ts = (ticks.withColumn("hour", floor_ts("ts", 3600)).groupBy(*keys, "hour", "ts")
              .agg(F.count("*").alias("n"), F.min(spread).alias("lo"), F.max(spread).alias("hi"),
                   F.sum(spread).alias("total"), F.bit_xor(digest).alias("digest")))
    return (per_ts.groupBy(*keys, "hour")
            .agg(F.sum("n").alias("ticks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.sum(F.col("n") - 1).alias("duplicate_ts"), F.min("lo").alias("spread_min"),
                 F.max("hi").alias("spread_max"), F.sum("total").alias("spread_sum"),
                 F.bit_xor("digest").alias("digest")))


def tick_month_manifest(hours: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return (hours.withColumn("month", F.date_format("hour", "yyyy-MM")).groupBy(*keys, "month")
            .agg(F.count("*").alias("hours"), F.sum("ticks").alias("ticks"), F.min("first_ts").alias("first_ts"),
                 F.max("last_ts").alias("last_ts"), F.sum("duplicate_ts").alias("duplicate_ts"),
                 F.min("spread_min").alias("spread_min"), F.max("spread_max").alias("spread_max"),
                 (F.sum("spread_sum") / F.sum("ticks")).alias("spread_mean"), F.bit_xor("digest").alias("digest")))


# fixed values of the flagged feed: flag bits and its clock shift
FLAG_BID, FLAG_ASK, FEED_SHIFT_HOURS = 2, 4, 3


def normalise_flagged_feed(raw: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Flagged quotes to plain ticks: carry unflagged sides forward and shift the clock.

    Input: keys, ts, seq, bid, ask (null when absent), flags.  Adds ``fault``:
    FLAGGED_MISSING when a flagged side has no value, UNFLAGGED_CHANGE when an
    unflagged side carries a different value.
    """
    has = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    t = raw.withColumn("ts", F.col("ts") - F.expr(f"INTERVAL {FEED_SHIFT_HOURS} HOURS"))
    t = running(t, {"bid_now": ("last", F.col("bid")), "ask_now": ("last", F.col("ask")),
                    "bid_old": ("prev", F.col("bid")), "ask_old": ("prev", F.col("ask"))},
                by=keys, order="seq", chunk_rows=65536)
    missing = (has(FLAG_BID) & F.col("bid").isNull()) | (has(FLAG_ASK) & F.col("ask").isNull())
    changed = (~has(FLAG_BID) & (F.col("bid") != F.col("bid_old"))) | (~has(FLAG_ASK) & (F.col("ask") != F.col("ask_old")))
    return t.select(*keys, "seq", "ts", "flags", F.col("bid_now").alias("bid"), F.col("ask_now").alias("ask"),
                    F.when(missing, "FLAGGED_MISSING").when(changed, "UNFLAGGED_CHANGE").alias("fault"))


# fixed values of the binary hour format: big-endian ms, ask, bid, ask volume, bid volume; price scale
HOUR_RECORD = [("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")]
HOUR_SCALE = 100000.0
HOUR_PRICE_RANGE = (10000, 500000)
HOUR_PATH = r"(?P<symbol>[A-Z0-9]+)/(?P<y>\d{4})/(?P<m>\d{2})/(?P<d>\d{2})/(?P<h>\d{2})h_ticks\.bi5$"
HOUR_SCHEMA = ("path string, symbol string, hour timestamp, seq long, ts timestamp, bid double, ask double, "
               "bid_volume double, ask_volume double, fault string")


def _decode_hours(batches):
    import lzma
    import re
    import numpy as np
    import pandas as pd
    dtype = np.dtype(HOUR_RECORD)
    empty = dict(seq=None, ts=None, bid=None, ask=None, bid_volume=None, ask_volume=None)
    for batch in batches:
        for path, content in zip(batch.path, batch.content):
            m = re.search(HOUR_PATH, path)
            if m is None:
                yield pd.DataFrame([dict(path=path, symbol=None, hour=None, **empty, fault="BAD_PATH")])
                continue
            # months are zero-based in the path layout
            hour = pd.Timestamp(int(m["y"]), int(m["m"]) + 1, int(m["d"]), int(m["h"]))
            head = dict(path=path, symbol=m["symbol"], hour=hour)
            fault, rec = None, np.empty(0, dtype)
            try:
                raw = lzma.decompress(bytes(content), format=lzma.FORMAT_ALONE) if len(content) else b""
                if len(raw) % dtype.itemsize:
                    fault = "TRUNCATED"
                else:
                    rec = np.frombuffer(raw, dtype)
            except lzma.LZMAError:
                fault = "NOT_LZMA"
            if fault is None and len(rec):
                if (rec["ms"] >= 3_600_000).any():
                    fault = "OUT_OF_HOUR"
                elif (np.diff(rec["ms"].astype("i8")) < 0).any():
                    fault = "BACKWARD"
                elif (rec["ask"] < rec["bid"]).any():
                    fault = "CROSSED"
                elif (np.minimum(rec["bid"], rec["ask"]) < HOUR_PRICE_RANGE[0]).any() or (
                        np.maximum(rec["bid"], rec["ask"]) > HOUR_PRICE_RANGE[1]).any():
                    fault = "PRICE_RANGE"
                elif not all((np.isfinite(rec[v]) & (rec[v] >= 0)).all() for v in ("ask_volume", "bid_volume")):
                    fault = "VOLUME"
            elif fault is None:
                fault = "EMPTY"
            if fault is not None:
                yield pd.DataFrame([dict(**head, **empty, fault=fault)])
                continue
            yield pd.DataFrame(dict(
                path=path, symbol=m["symbol"], hour=hour, seq=np.arange(len(rec), dtype="i8"),
                ts=hour + pd.to_timedelta(rec["ms"].astype("i8"), unit="ms"), bid=rec["bid"] / HOUR_SCALE,
                ask=rec["ask"] / HOUR_SCALE, bid_volume=rec["bid_volume"].astype("f8"),
                ask_volume=rec["ask_volume"].astype("f8"), fault=None))


def read_hour_blobs(spark, path: str) -> DataFrame:
    """Decode LZMA hour files; one bounded file is one record, bad files become a fault row.

    An empty hour is a fault only while the market is open.
    """
    from barloom.functions.calendar import fx_closure
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.bi5").load(path).select("path", "content"))
    rows = files.mapInPandas(_decode_hours, HOUR_SCHEMA)
    return rows.filter(~(F.coalesce(F.col("fault") == "EMPTY", F.lit(False)) & fx_closure("hour")))
