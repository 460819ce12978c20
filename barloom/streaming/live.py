"""Streaming twins of the batch operators; each equals its batch parent on replay."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

C = F.col


def stream_bars(ticks: DataFrame, step: int, delay: str = "10 minutes") -> DataFrame:
    """Completed bars in append mode: a bar is emitted once, when the watermark passes its end.

    Later ticks are dropped by the watermark and counted by the query (``late_ticks``).
    """
    spread = C("ask") - C("bid")
    w = F.window("ts", f"{step} seconds")
    return (ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("w"))
            .agg(F.min_by("bid", "seq").alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"),
                 F.max_by("bid", "seq").alias("close"), F.count("*").alias("tick_volume"), F.max_by(spread, "seq").alias("spread"))
            .select("symbol", C("w.start").alias("ts"), "open", "high", "low", "close", "tick_volume", "spread"))


def late_ticks(query) -> int:
    """Rows the watermark dropped so far."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def sliding_range(ticks: DataFrame, length: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    """High, low and range over sliding event-time windows."""
    return (ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length, slide).alias("w"))
            .agg(F.max("bid").alias("high"), F.min("bid").alias("low"), F.count("*").alias("ticks"))
            .select("symbol", C("w.start").alias("from_ts"), C("w.end").alias("to_ts"), "high", "low", (C("high") - C("low")).alias("range"), "ticks"))


def touch_sessions(bars: DataFrame, levels: DataFrame, step: int, delay: str = "1 hour") -> DataFrame:
    """Touch episodes of active levels as session windows with a gap of one bar.

    ``levels`` is static: symbol, level_key, level_price, available_at.  Touches are found
    by price bucket (one unit wide), as in the batch join.
    """
    b = bars.withWatermark("ts", delay).withColumn("_p", F.explode(F.sequence(F.floor("low"), F.floor("high"))))
    l = levels.withColumn("_p", F.floor("level_price"))
    hit = b.join(l, ["symbol", "_p"]).filter((C("low") <= C("level_price")) & (C("level_price") <= C("high")) & (C("ts") >= C("available_at")))
    return (hit.groupBy("symbol", "level_key", F.session_window("ts", f"{step} seconds").alias("w"))
            .agg(F.count("*").alias("touched_bars"))
            .select("symbol", "level_key", C("w.start").alias("first_ts"), C("w.end").alias("touch_end"), "touched_bars"))


LIVE_SCHEMA = ("symbol string, ts timestamp, close double, seg long, seg_pos long, atr double, state string, previous_state string, "
               "state_age long, late boolean")
BAR = "ts timestamp, high double, low double, close double, state string"
POINT = "last long, newest long, close double, seg long, pos long, tr_sum double, atr double, state string, previous string, age long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LiveState(StatefulProcessor):
    """Continues one symbol's segment, Wilder ATR and state age bar by bar.

    Bars wait in list state until the symbol's newest bar is ``delay`` seconds ahead, so bars may come out of order by
    that much; with ``idle`` a processing-time timer releases what waits once a symbol is quiet.  A bar at or before the
    last released one comes out at once, flagged late, and changes nothing.
    """

    def __init__(self, step: int, period: int, delay: int, idle: int | None):
        self.step, self.period, self.delay, self.idle = step, period, delay, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.point = handle.getValueState("point", POINT)
        self.waiting = handle.getListState("waiting", BAR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd
        came = pd.concat(list(rows))[["ts", "high", "low", "close", "state"]].sort_values("ts", kind="stable")
        seconds = came.ts.astype("datetime64[s]").astype("int64")
        point = self._point()
        late = came[seconds <= point[0]] if point[0] is not None else came[:0]
        newest = max(int(seconds.max()), point[1] if point[1] is not None else int(seconds.max()))
        came = came[seconds > point[0]] if point[0] is not None else came
        held = [tuple(r) for r in self.waiting.get()] + list(came.itertuples(index=False, name=None))
        if self.idle:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle * 1000)
        yield self._frame(key, self._release(point, newest, held, newest - self.delay) + [(r.ts, r.close, None, None, None, r.state, None, None, True) for r in late.itertuples()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        point = self._point()
        yield self._frame(key, self._release(point, point[1], [tuple(r) for r in self.waiting.get()], point[1]))

    def close(self) -> None:
        pass

    def _point(self) -> list:
        return list(self.point.get()) if self.point.exists() else [None, None, 0.0, 0, -1, 0.0, 0.0, None, None, 0]

    def _release(self, point: list, newest: int, held: list, until: int) -> list:
        """Rows of the bars up to ``until``; the others go back into list state. Of bars with one instant the first counts, the others are late."""
        last, _, close, seg, pos, total, atr, state, previous, age = point
        out, rest = [], []
        for ts, high, low, price, now_state in sorted(held, key=lambda r: r[0]):
            now = int(ts.timestamp())
            if now > until:
                rest.append((ts, high, low, price, now_state))
                continue
            if now == last:
                out.append((ts, price, None, None, None, now_state, None, None, True))
                continue
            if last is None or now - last > self.step:
                seg, pos, total, atr, state, previous, age = seg + (last is not None), -1, 0.0, 0.0, None, None, 0
            pos += 1
            if pos:
                tr = max(high - low, abs(high - close), abs(low - close))
                total += tr if pos <= self.period else 0.0
                atr = total / self.period if pos == self.period else (atr * (self.period - 1) + tr) / self.period if pos > self.period else 0.0
            if pos and now_state == state:
                age += 1
            else:
                previous, state, age = state if pos else None, now_state, 1
            last, close = now, float(price)
            out.append((ts, close, seg, pos, atr if pos >= self.period and atr > 0 else None, state, previous, age, False))
        self.point.update((last, newest, close, seg, pos, total, atr, state, previous, age))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        return out

    def _frame(self, key, rows: list):
        import pandas as pd
        d = pd.DataFrame(rows, columns=["ts", "close", "seg", "seg_pos", "atr", "state", "previous_state", "state_age", "late"])
        d.insert(0, "symbol", key[0])
        return d.astype({"seg": "Int64", "seg_pos": "Int64", "state_age": "Int64", "atr": "float64", "close": "float64", "late": "bool"})


def live_state(bars: DataFrame, step: int, period: int = 14, delay: int = 0, idle: int | None = None) -> DataFrame:
    """Segment, position, Wilder ATR, state with its age and predecessor per symbol, carried in RocksDB between batches.

    ``bars`` need symbol, ts, high, low, close and may have a ``state``.  ``late`` marks bars that came too late to count
    (see ``LiveState``); they are rows of the result, so nothing is skipped in silence.  A change of segment starts a new age.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    state = C("state").cast("string") if "state" in bars.columns else F.lit(None).cast("string")
    rows = bars.filter("ts is not null").select("symbol", "ts", *[C(c).cast("double").alias(c) for c in ("high", "low", "close")], state.alias("state"))
    return rows.groupBy("symbol").transformWithStateInPandas(LiveState(step, period, delay, idle), LIVE_SCHEMA, "append", "ProcessingTime" if idle else "None")


def archive_stream(bars: DataFrame, path: str, quarantine: str, checkpoint: str, delay: str = "1 day"):
    """Writer that merges each micro-batch into the monthly archive; a replayed batch changes nothing.

    Copies inside the watermark are dropped on their whole content, so differing
    observations still meet in the merge and go to quarantine.
    """
    from barloom.sources.files import write_bars_monthly
    unique = bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(bars.columns)
    return (unique.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, _id: write_bars_monthly(batch, path, quarantine) and None))


def run_to_table(stream: DataFrame, name: str = "out", mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet table of the shared folder and read it back."""
    import uuid
    from barloom.sources.stage import shared_dir
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/data")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
