"""Causal window features over (symbol, segment), computed chunk by chunk.

Each ``*_cols`` function takes the ordered window of a chunk and returns plain
columns; ``seg_pos`` decides whether enough history exists, so a row's value never
depends on where its chunk starts.  ``back`` of the enclosing ``chunked`` call must
cover the longest look-back used.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.functions.calendar import local, session_flags, weekday
from barloom.functions.scalars import candle_geometry, direction_of, finite, safe_ratio, sign_of
from barloom.operators.timeline import CHUNK_ROWS, chunked, index_bars, running
from barloom.sources.stage import stage

C = F.col


def after(n: int, value: Column) -> Column:
    """Value only when the row has ``n`` predecessors in its segment."""
    return F.when(C("seg_pos") >= n, value)


def add(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.withColumns(cols)


# ---- volatility -------------------------------------------------------------

def true_range(w: W) -> Column:
    prev = F.lag("close").over(w)
    return after(1, F.greatest(C("high") - C("low"), F.abs(C("high") - prev), F.abs(C("low") - prev)))


def atr_back(period: int) -> int:
    """Rows after which an exponential average has forgotten its start (below 1e-16)."""
    return math.ceil(37 / -math.log((period - 1) / period)) + 2 * period if period > 1 else 2


def wilder_atr(w: W, period: int = 14, tr: str = "true_range") -> Column:
    """Wilder average: mean of the first ``period`` true ranges, then (atr (p-1) + tr) / p.

    The recurrence is linear, so inside a chunk it is a scaled running sum
    a^o * sum(b * a^-o); older terms outside the halo weigh less than one ulp.
    """
    a = (period - 1) / period
    seed = F.avg(tr).over(w.rowsBetween(-(period - 1), 0))
    if period == 1:
        y = C(tr)
    else:
        b = F.when(C("seg_pos") == period, seed).when(C("seg_pos") > period, C(tr) / period)
        y = F.pow(F.lit(a), C("o")) * F.sum(b * F.pow(F.lit(1 / a), C("o"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.when((C("seg_pos") >= period) & (y > 0) & finite(y), y)


def check_atr_range(period: int, rows: int) -> None:
    if period > 1 and rows * -math.log((period - 1) / period) > 690:
        raise ValueError("chunk too long for this period; lower chunk_rows")


def weak_rank_pct(w: W, x: str | Column, n: int = 100, full: bool = True) -> Column:
    """100 * share of the last n values not above the current one."""
    x = C(x) if isinstance(x, str) else x
    seen = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
    rank = F.size(F.filter(seen, lambda v: v <= x)) * F.lit(100.0) / F.size(seen)
    return F.when(x.isNotNull() & ((F.size(seen) == n) if full else F.lit(True)), rank)


# ---- path and trend ---------------------------------------------------------

def displacement(w: W, h: int) -> Column:
    return after(h, C("close") - F.lag("close", h).over(w))


def path_length(w: W, n: int, step: str = "abs_step") -> Column:
    return F.sum(step).over(w.rowsBetween(-(n - 1), 0))


def efficiency(w: W, n: int, zero_path: float | None = 0.0) -> Column:
    """abs(displacement) / path; ``zero_path`` is the value on a flat path."""
    path = path_length(w, n)
    return after(n, F.when(path == 0, F.lit(zero_path).cast("double")).otherwise(F.abs(displacement(w, n)) / path))


def realized_vol(w: W, n: int) -> Column:
    return after(n, F.sqrt(F.sum(C("log_step") * C("log_step")).over(w.rowsBetween(-(n - 1), 0))))


def ratio_change(w: W, x: str, lag: int) -> Column:
    old = F.lag(x, lag).over(w)
    return after(lag, F.when(old > 0, C(x) / old - 1))


def ols_slope(w: W, n: int, shift: int = 0) -> Column:
    """Least-squares close slope per bar over n bars ending ``shift`` bars ago."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    return after(n - 1 + shift, F.regr_slope(C("close"), C("o").cast("double")).over(frame))


def prior_extremes(w: W, n: int) -> tuple[Column, Column]:
    frame = w.rowsBetween(-n, -1)
    return after(n, F.max("high").over(frame)), after(n, F.min("low").over(frame))


def prior_range_pos(w: W, n: int) -> Column:
    hi, lo = prior_extremes(w, n)
    return F.when(hi == lo, 0.5).otherwise((C("close") - lo) / (hi - lo))


def rolling_range(w: W, h: int) -> dict[str, Column]:
    """High, low, position and age of extremes over h bars; ties take the latest bar."""
    f = w.rowsBetween(-(h - 1), 0)
    hi, lo = F.max("high").over(f), F.min("low").over(f)
    hi_at = F.max(F.struct(C("high"), C("pos")))
    lo_at = F.max(F.struct((-C("low")).alias("x"), C("pos")))
    return {
        "rolling_high": after(h - 1, hi), "rolling_low": after(h - 1, lo),
        "rolling_range_price": after(h - 1, hi - lo), "close_position_in_range": after(h - 1, safe_ratio(C("close") - lo, hi - lo)),
        "distance_from_rolling_high_price": after(h - 1, hi - C("close")),
        "distance_from_rolling_low_price": after(h - 1, C("close") - lo),
        "bars_since_rolling_high": after(h - 1, C("pos") - hi_at.over(f)["pos"]),
        "bars_since_rolling_low": after(h - 1, C("pos") - lo_at.over(f)["pos"]),
    }


def momentum_change(w: W, h: int) -> dict[str, Column]:
    """Recent h bars against the h bars before them."""
    now = displacement(w, h)
    before = after(2 * h, F.lag("close", h).over(w) - F.lag("close", 2 * h).over(w))
    now, before = after(2 * h, now), before
    s1, s0 = after(2 * h, ols_slope(w, h + 1)), ols_slope(w, h + 1, h)
    return {
        "recent_displacement_price": now, "preceding_displacement_price": before,
        "recent_to_preceding_displacement_ratio": safe_ratio(now, before),
        "recent_regression_slope": s1, "preceding_regression_slope": s0,
        "recent_to_preceding_slope_ratio": safe_ratio(s1, s0),
        "displacement_sign_changed": after(2 * h, (now != 0) & (before != 0) & ((now > 0) != (before > 0))),
    }


def with_steps(df: DataFrame, w: W) -> DataFrame:
    prev = F.lag("close").over(w)
    return add(df, {"true_range": true_range(w), "abs_step": after(1, F.abs(C("close") - prev)),
                    "log_step": after(1, F.ln(C("close") / prev)), "simple_return": after(1, C("close") / prev - 1)})


def with_atr(df: DataFrame, period: int = 14, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    back = atr_back(period)
    check_atr_range(period, chunk_rows + back)
    return chunked(df, lambda d, w: add(d.withColumn("true_range", true_range(w)), {"atr": wilder_atr(w, period)}),
                   back, 0, chunk_rows)


def with_lags(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Short-history features that need no ATR."""
    def fn(d, w):
        d = with_steps(d, w)
        hi, lo = prior_extremes(w, 12)
        return add(d, {"er_4": efficiency(w, 4), "er_8": efficiency(w, 8), "er_16": efficiency(w, 16),
                       "directional_8": efficiency(w, 8, None), "rv_16": realized_vol(w, 16), "slope_4": ols_slope(w, 4),
                       "slope_16": ols_slope(w, 16), "range_pos_16": prior_range_pos(w, 16),
                       "prior_high_12": hi, "prior_low_12": lo,
                       "breakout_high_12": C("close") > hi, "breakout_low_12": C("close") < lo,
                       "return_mean_8": after(8, F.avg("simple_return").over(w.rowsBetween(-7, 0))),
                       "return_median_8": after(8, F.percentile("simple_return", 0.5).over(w.rowsBetween(-7, 0))),
                       "return_sd_8": after(8, F.stddev_pop("simple_return").over(w.rowsBetween(-7, 0)))})
    return chunked(df, fn, 32, 0, chunk_rows)


# ---- higher timeframes and the feature table ---------------------------------

def resample_complete(bars: DataFrame, source_step: int, step: int, keys=("symbol", "seg")) -> DataFrame:
    """Higher-timeframe bars, only where every source bar of the bucket exists.

    Aggregates are combinable, so the shuffle carries one row per bucket and map task.
    """
    if step % source_step:
        raise ValueError("target must be a multiple of the source step")
    extra = [F.sum(c).alias(c) for c in ("tick_volume", "real_volume") if c in bars.columns]
    extra += [F.max_by("spread", "ts").alias("spread")] if "spread" in bars.columns else []
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / F.lit(step)) * step)
    return (bars.withColumn("_b", bucket).groupBy(*keys, "_b")
            .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", "ts").alias("close"), *extra, F.count("*").alias("_n"))
            .filter(C("_n") == step // source_step).drop("_n").withColumnRenamed("_b", "ts"))


def higher_state(bars: DataFrame, source_step: int, step: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Completed higher-timeframe bars with direction, er_8, atr_change_4 and slope_atr_8."""
    hi = index_bars(stage(resample_complete(bars, source_step, step)), step, parent="seg")
    back = atr_back(14) + 16
    check_atr_range(14, chunk_rows + back)

    def fn(d, w):
        d = with_steps(d, w)
        d = d.withColumn("atr", wilder_atr(w))
        return add(d, {"er_8": efficiency(w, 8), "atr_change_4": ratio_change(w, "atr", 4),
                       "slope_atr_8": safe_ratio(ols_slope(w, 8), C("atr")), "direction": sign_of()})
    return chunked(hi, fn, back, 0, chunk_rows).select(
        "symbol", "seg", "ts", "direction", "er_8", "atr_change_4", "slope_atr_8")


def asof_context(bars: DataFrame, contexts: list[tuple[DataFrame, int, dict[str, str]]], step: int,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Attach, per (table, its step, renames), the latest row that ended by each bar's close.

    Buckets are regular, so the newest candidate is an equi-join; older values are
    carried forward inside the segment for bars whose own bucket is missing.
    """
    joined, carried, names = bars, {}, []
    for i, (ctx, ctx_step, renames) in enumerate(contexts):
        start = F.floor((F.unix_seconds("ts") + step) / F.lit(ctx_step)) * ctx_step - ctx_step
        value = ctx.select("symbol", "seg", F.unix_seconds("ts").alias(f"_at{i}"),
                           F.struct(*[C(k).alias(v) for k, v in renames.items()]).alias(f"_v{i}"))
        joined = joined.withColumn(f"_at{i}", start).join(value, ["symbol", "seg", f"_at{i}"], "left")
        carried[f"_ctx{i}"] = ("last", C(f"_v{i}"))
        names += [C(f"_ctx{i}")[v].alias(v) for v in renames.values()]
    return running(joined, carried, by=("symbol", "seg"), chunk_rows=chunk_rows).select(*bars.columns, *names)


# fixed values: ordered state-vector inputs and the optional context columns
STATE_FEATURES = ("er_4", "er_16", "rv_16", "atr_change_1", "atr_change_8", "slope_atr_4", "slope_atr_16", "range_pos_16",
                  "h1_er_8", "h1_atr_change_4", "h1_slope_atr_8", "h3_er_8", "h3_atr_change_4", "h3_slope_atr_8")
OPTIONAL_FEATURES = ("h1_er_8", "h1_atr_change_4", "h1_slope_atr_8", "h3_er_8", "h3_atr_change_4", "h3_slope_atr_8")


def base_features(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All bar-timeframe features of the feature table in one pass over the chunks."""
    back = atr_back(14) + 128
    check_atr_range(14, chunk_rows + back)

    def fn(d, w):
        d = with_steps(d, w)
        d = d.withColumn("atr_14", wilder_atr(w))
        atr, (hi, lo) = C("atr_14"), prior_extremes(w, 12)
        return add(d, {
            **candle_geometry(),
            "atr_percentile_100": weak_rank_pct(w, "atr_14"), "range_percentile_100": weak_rank_pct(w, C("high") - C("low")),
            "displacement_4_atr": safe_ratio(displacement(w, 4), atr), "displacement_8_atr": safe_ratio(displacement(w, 8), atr),
            "er_4": efficiency(w, 4), "er_16": efficiency(w, 16), "rv_16": realized_vol(w, 16),
            "atr_change_1": ratio_change(w, "atr_14", 1), "atr_change_8": ratio_change(w, "atr_14", 8),
            "slope_atr_4": safe_ratio(ols_slope(w, 4), atr), "slope_atr_16": safe_ratio(ols_slope(w, 16), atr),
            "range_pos_16": prior_range_pos(w, 16), "prior_high_12": hi, "prior_low_12": lo,
            "breakout_high_12": C("close") > hi, "breakout_low_12": C("close") < lo})
    return chunked(df, fn, back, 0, chunk_rows).drop("true_range", "abs_step", "log_step", "simple_return")


def universal_features(indexed: DataFrame, step: int, chunk_rows: int = CHUNK_ROWS, as_of=None,
                       zone: str = "America/New_York") -> DataFrame:
    """The flat causal feature table: one row per completed bar, labelled by its close."""
    if as_of is not None:
        indexed = indexed.filter(F.unix_seconds("ts") + step <= F.unix_seconds(F.lit(as_of).cast("timestamp")))
    contexts = [(stage(higher_state(indexed, step, seconds, chunk_rows)), seconds,
                 {"direction": f"completed_{tf}_direction", "er_8": f"{tf}_er_8",
                  "atr_change_4": f"{tf}_atr_change_4", "slope_atr_8": f"{tf}_slope_atr_8"})
                for tf, seconds in (("h1", 3600), ("h3", 10800))]
    df = base_features(asof_context(indexed, contexts, step, chunk_rows), chunk_rows)
    close_ts = F.timestamp_seconds(F.unix_seconds("ts") + step)
    df = df.withColumn("close_ts", close_ts)
    df = add(df, {"analysis_hour": F.hour(local("close_ts", zone)), "weekday": weekday("close_ts"), **session_flags("close_ts")})
    required = [c for c in ("body_ratio", "close_location", "atr_14", "atr_percentile_100", "range_percentile_100",
                            "displacement_4_atr", "displacement_8_atr", "er_4", "er_16", "rv_16", "atr_change_1",
                            "atr_change_8", "slope_atr_4", "slope_atr_16", "range_pos_16", "prior_high_12", "prior_low_12",
                            "breakout_high_12", "breakout_low_12", "completed_h1_direction", "completed_h3_direction")]
    ready = C(required[0]).isNotNull()
    for c in required[1:]:
        ready = ready & C(c).isNotNull()
    return df.withColumn("feature_ready", ready)


def state_vector(features: DataFrame, names=STATE_FEATURES) -> DataFrame:
    """Rows where every state input exists, with the ordered vector."""
    return features.dropna(subset=list(names)).withColumn("state_vector", F.array(*[C(n) for n in names]))


# ---- point-in-time snapshot ---------------------------------------------------

def snapshot_features(df: DataFrame, step: int, horizons=(4, 8, 12, 24), period: int = 14, long: int = 50,
                      history: int = 250, chunk_rows: int = CHUNK_ROWS, block_minutes: int = 180) -> DataFrame:
    """Wide point-in-time table plus ``values`` and ``missing`` maps per bar close."""
    from barloom.functions.calendar import calendar_features
    back = max(atr_back(period) + history, atr_back(long), 2 * max(horizons) + 1)
    check_atr_range(min(period, long), chunk_rows + back)
    names: list[str] = []

    def put(out, prefix, cols):
        for k, v in cols.items():
            out[f"{prefix}{k}"] = v.cast("double")

    def fn(d, w):
        d = with_steps(d, w)
        d = add(d, {"atr": wilder_atr(w, period), "atr_long": wilder_atr(w, long)})
        atr, out = C("atr"), {}
        tr = lambda n: w.rowsBetween(-(n - 1), 0)
        put(out, "volatility.", {
            "atr_pct": safe_ratio(atr, C("close")),
            "tr_mean_short": after(period, F.avg("true_range").over(tr(period))),
            "tr_median_short": after(period, F.percentile("true_range", 0.5).over(tr(period))),
            "tr_mean_long": after(long, F.avg("true_range").over(tr(long))),
            "tr_median_long": after(long, F.percentile("true_range", 0.5).over(tr(long))),
            "short_long_atr_ratio": safe_ratio(atr, C("atr_long")),
            "atr_percentile": weak_rank_pct(w, "atr", history, full=False)})
        for h in horizons:
            move, slope = displacement(w, h), ols_slope(w, h + 1)
            put(out, f"h{h}.", {
                "displacement_price": move, "absolute_displacement_price": F.abs(move),
                "displacement_pct": safe_ratio(move, C("close") - move), "displacement_atr": safe_ratio(move, atr),
                "regression_slope_price_per_bar": slope, "regression_slope_atr": safe_ratio(slope, atr),
                "directional_efficiency": efficiency(w, h, None)})
            rr = rolling_range(w, h)
            put(out, f"h{h}.", {**rr, "rolling_range_atr": safe_ratio(rr["rolling_range_price"], atr),
                                "distance_from_rolling_high_atr": safe_ratio(rr["distance_from_rolling_high_price"], atr),
                                "distance_from_rolling_low_atr": safe_ratio(rr["distance_from_rolling_low_price"], atr)})
            mc = momentum_change(w, h)
            put(out, f"h{h}.momentum_change.", {
                **mc, "recent_minus_preceding_displacement_atr":
                    safe_ratio(mc["recent_displacement_price"] - mc["preceding_displacement_price"], atr)})
            r = w.rowsBetween(-(h - 1), 0)
            put(out, f"h{h}.", {"mean_candle_return": after(h, F.avg("simple_return").over(r)),
                                "median_candle_return": after(h, F.percentile("simple_return", 0.5).over(r)),
                                "realized_close_volatility": after(h, F.stddev_pop("simple_return").over(r))})
        out["volatility.atr"] = atr
        names.extend(out)
        return add(d, out)

    wide = chunked(df, fn, back, 0, chunk_rows)
    wide = wide.withColumn("close_ts", F.timestamp_seconds(F.unix_seconds("ts") + step))
    cal = {f"calendar.{k}": v.cast("double") for k, v in calendar_features("close_ts", block_minutes).items()}
    wide = add(wide, cal)
    names.extend(cal)
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[C(f"`{n}`") for n in names]))
    return (wide.withColumn("_all", pairs)
            .withColumn("values", F.map_filter("_all", lambda k, v: v.isNotNull()))
            .withColumn("missing", F.transform_values(F.map_filter("_all", lambda k, v: v.isNull()),
                                                      lambda k, v: F.lit("insufficient_history")))
            .drop("_all"))


# ---- trend and impulse measurements, block signal --------------------------------

def trend_measures(df: DataFrame, lookback: int = 8, period: int = 14, minimum: float = 1.0,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Net move from the first open to the last close of the look-back, against ATR."""
    need = max(lookback, period + 1) - 1
    back = max(atr_back(period), lookback)
    check_atr_range(period, chunk_rows + back)

    def fn(d, w):
        d = add(d, {"true_range": true_range(w)})
        d = add(d, {"atr": wilder_atr(w, period)})
        move = C("close") - F.first("open").over(w.rowsBetween(-(lookback - 1), 0))
        ok = (C("seg_pos") >= need) & C("atr").isNotNull()
        strength = F.abs(move) / C("atr")
        strong = ok & (strength >= minimum)
        return add(d, {
            "trend": F.when(strong & (move > 0), "BULLISH").when(strong & (move < 0), "BEARISH").otherwise("NO_TREND"),
            "net_move": F.when(ok, move).otherwise(0.0), "strength": F.when(ok, strength),
            "momentum_long": F.coalesce(strong & (move > 0), F.lit(False)),
            "momentum_short": F.coalesce(strong & (move < 0), F.lit(False))})
    return chunked(df, fn, back, 0, chunk_rows)


def impulse_anchors(df: DataFrame, lookback: int = 8, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Long and short impulse start/end inside the look-back.

    Long: the lowest low (earliest on ties) that is followed by a higher high, and the
    first bar reaching that high; short mirrors it.
    """
    def pick(d, w, start, end, better):
        frame = w.rowsBetween(-(lookback - 1), 0)
        # candidates as (start value, index); the extreme after each start bar
        seq = F.collect_list(F.struct(start.alias("s"), end.alias("e"), C("ts").alias("t"))).over(frame)
        idx = F.sequence(F.lit(1), F.size(seq) - 1)
        def cand(i):
            later = F.slice(seq, i + 1, F.size(seq) - i)
            top = F.array_max(F.transform(later, lambda x: x["e"]))
            first = F.array_min(F.transform(F.filter(later, lambda x: x["e"] == top), lambda x: x["t"]))
            me = F.element_at(seq, i)
            return F.struct(me["s"].alias("s"), i.alias("i"), me["t"].alias("from_ts"), first.alias("to_ts"), top.alias("e"))
        good = F.filter(F.transform(idx, cand), lambda x: x["e"] + x["s"] * better > 0)
        return F.when(C("seg_pos") >= lookback - 1, F.array_min(good))

    def fn(d, w):
        # signs turn both cases into: smallest s, largest later e with e > low
        d = add(d, {"_long": pick(d, w, C("low"), C("high"), F.lit(-1)),
                    "_short": pick(d, w, -C("high"), -C("low"), F.lit(-1))})
        return add(d, {
            "long_from": C("_long")["from_ts"], "long_to": C("_long")["to_ts"], "long_low": C("_long")["s"], "long_high": C("_long")["e"],
            "short_from": C("_short")["from_ts"], "short_to": C("_short")["to_ts"],
            "short_high": -C("_short")["s"], "short_low": -C("_short")["e"]}).drop("_long", "_short")
    return chunked(df, fn, lookback, 0, chunk_rows)


# fixed values of the block signal: level depth, stop and target in pips, life in hours
SIGNAL_DEPTH, SIGNAL_STOP_PIPS, SIGNAL_TARGET_PIPS, SIGNAL_HOURS = 3.0, 40.0, 5.0, 3


def block_signal(df: DataFrame, step: int, bars: int = 12, pip: float = 0.0001, require_contiguous: bool = False,
                 chunk_rows: int = CHUNK_ROWS, zone: str = "America/New_York") -> DataFrame:
    """Limit long below the last block's body at each local three-hour boundary."""
    df = df.withColumn("hist_seg", C("seg")) if require_contiguous else df.withColumn("hist_seg", F.lit(0))

    def fn(d, w):
        whole = W.partitionBy("symbol", "chunk", "hist_seg").orderBy("pos").rowsBetween(-(bars - 1), 0)
        return add(d, {"block_open": F.first("open").over(whole), "n_back": F.count("*").over(whole)})
    out = chunked(df, fn, bars, 0, chunk_rows).withColumn("decision_ts", F.timestamp_seconds(F.unix_seconds("ts") + step))
    wall = local("decision_ts", zone)
    out = out.filter((C("n_back") == bars) & (F.minute(wall) == 0) & (F.second(wall) == 0) & (F.hour(wall) % 3 == 0)
                     & (C("block_open") != C("close")))
    mid = (C("block_open") + C("close")) / 2
    entry = mid - SIGNAL_DEPTH * (F.greatest("block_open", "close") - mid)
    return out.select("symbol", "decision_ts", "block_open", C("close").alias("block_close"), entry.alias("entry"),
                      (entry - SIGNAL_STOP_PIPS * pip).alias("stop"), (entry + SIGNAL_TARGET_PIPS * pip).alias("target"),
                      (C("decision_ts") + F.expr(f"INTERVAL {SIGNAL_HOURS} HOURS")).alias("expires_ts"))
