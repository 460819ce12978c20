"""Group E: window features."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import CHUNK, H1, M15, STATES, TRADES, ep, indexed, indexed_sql, states, trades
from barloom.functions.scalars import safe_ratio
from barloom.operators import windows as X
from barloom.operators.timeline import chunked

C = F.col
SEG = "(PARTITION BY symbol, seg ORDER BY pos)"


def atr_sql(step=M15, period=14, src="x"):
    return f"""tr AS (SELECT *, CASE WHEN seg_pos >= 1 THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
   CASE WHEN seg_pos >= 1 THEN abs(close - lag(close) OVER w) END AS d1, CASE WHEN seg_pos >= 1 THEN ln(close / lag(close) OVER w) END AS lr,
   CASE WHEN seg_pos >= 1 THEN close / lag(close) OVER w - 1 END AS ret
 FROM {src} WINDOW w AS {SEG}), sd AS (
 SELECT *, CASE WHEN seg_pos = {period} THEN avg(tr) OVER (PARTITION BY symbol, seg ORDER BY pos ROWS {period - 1} PRECEDING) END AS seed FROM tr), rec AS (
 SELECT symbol, seg, seg_pos, seed AS v FROM sd WHERE seg_pos = {period}
 UNION ALL SELECT s.symbol, s.seg, s.seg_pos, (r.v * {period - 1} + s.tr) / {period} FROM rec r
 JOIN sd s ON s.symbol = r.symbol AND s.seg = r.seg AND s.seg_pos = r.seg_pos + 1), a AS (
 SELECT sd.*, CASE WHEN rec.v > 0 THEN rec.v END AS atr FROM sd LEFT JOIN rec USING (symbol, seg, seg_pos))"""


def base(step=M15):
    return f"WITH RECURSIVE {indexed_sql(step)}, {atr_sql(step)} "


def win(spark, sf, make, back=32, step=M15, atr=False):
    def fn(d, w):
        d = X.with_steps(d, w)
        if atr:
            d = d.withColumn("atr", X.wilder_atr(w))
        return X.add(d, make(w))
    names = []
    def make_names(w, real=make):
        cols = real(w)
        names[:] = list(cols)
        return cols
    make = make_names
    out = chunked(indexed(spark, sf, step), fn, back + (X.atr_back(14) if atr else 0), 0, CHUNK)
    return out.select("symbol", "ts_s" if "ts_s" in out.columns else F.unix_seconds("ts").alias("ts_s"), *names)


def sel(body, frm="a", digits=6):
    return f"SELECT symbol, {ep('ts')} AS ts_s, {body} FROM {frm}"


def r6(x):
    return f"round({x}, 6)"


def g(n, x):
    return f"CASE WHEN seg_pos >= {n} THEN {x} END"


def fr(a, b="CURRENT ROW"):
    return f"OVER (PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN {a} AND {b})"


def register(cat):
    @cat.add("e01_true_range", base() + sel("round(tr, 6) AS true_range"))
    def _(s, sf): return win(s, sf, lambda w: {"true_range": C("true_range")})

    @cat.add("e02_wilder_atr", base() + sel("round(atr, 6) AS atr"))
    def _(s, sf): return win(s, sf, lambda w: {"atr": C("atr")}, atr=True)

    @cat.add("e03_weak_rank_pct", base(H1).rstrip() + f""", l AS (SELECT symbol, ts, seg_pos, high - low AS rng, atr,
        list(high - low) {fr('99 PRECEDING')} AS l, list(atr) FILTER (atr IS NOT NULL) {fr('99 PRECEDING')} AS la FROM a)
        SELECT symbol, {ep('ts')} AS ts_s, round(CASE WHEN len(l) = 100 THEN 100.0 * len(list_filter(l, lambda v: v <= rng)) / 100 END, 6) AS range_rank,
        round(CASE WHEN len(la) = 100 THEN 100.0 * len(list_filter(la, lambda v: v <= atr)) / 100 END, 6) AS atr_rank FROM l""")
    def _(s, sf):
        return win(s, sf, lambda w: {"range_rank": X.weak_rank_pct(w, C("high") - C("low")), "atr_rank": X.weak_rank_pct(w, "atr")},
                   100, H1, True)

    @cat.add("e04_tr_mean_median", base(H1) + sel(",".join(
        f"round({g(n, f'{f} {fr(f'{n-1} PRECEDING')}')}, 6) AS tr_{k}_{n}" for n in (14, 50)
        for k, f in (("mean", "avg(tr)"), ("median", "quantile_cont(tr, 0.5)")))))
    def _(s, sf):
        return win(s, sf, lambda w: {f"tr_{k}_{n}": X.after(n, f.over(w.rowsBetween(-(n - 1), 0))) for n in (14, 50)
                                     for k, f in (("mean", F.avg("true_range")), ("median", F.percentile("true_range", 0.5)))}, 64, H1)

    @cat.add("e05_displacement_atr", base() + sel(",".join(
        f"round({g(h, f'(close - lag(close, {h}) OVER w) / atr')}, 6) AS displacement_{h}_atr" for h in (4, 8))) + f" WINDOW w AS {SEG}")
    def _(s, sf):
        return win(s, sf, lambda w: {f"displacement_{h}_atr": safe_ratio(X.displacement(w, h), C("atr")) for h in (4, 8)}, atr=True)

    er = lambda n, z: g(n, f"CASE WHEN sum(d1) {fr(f'{n-1} PRECEDING')} = 0 THEN {z} ELSE abs(close - lag(close, {n}) OVER w) / sum(d1) {fr(f'{n-1} PRECEDING')} END")

    @cat.add("e06_efficiency_ratio", base() + sel(f"round({er(4, 0.0)}, 6) AS er_4, round({er(16, 0.0)}, 6) AS er_16, round({er(4, 'NULL')}, 6) AS directional_4") + f" WINDOW w AS {SEG}")
    def _(s, sf):
        return win(s, sf, lambda w: {"er_4": X.efficiency(w, 4), "er_16": X.efficiency(w, 16), "directional_4": X.efficiency(w, 4, None)})

    @cat.add("e07_realized_vol", base() + sel(f"round({g(16, f'sqrt(sum(lr * lr) {fr("15 PRECEDING")})')}, 6) AS rv_16, "
                                             f"round({g(8, f'stddev_pop(ret) {fr("7 PRECEDING")}')}, 6) AS close_vol_8"))
    def _(s, sf):
        return win(s, sf, lambda w: {"rv_16": X.realized_vol(w, 16),
                                     "close_vol_8": X.after(8, F.stddev_pop("simple_return").over(w.rowsBetween(-7, 0)))})

    @cat.add("e08_atr_change", base() + sel(",".join(f"round(atr / lag(atr, {k}) OVER w - 1, 6) AS atr_change_{k}" for k in (1, 8))) + f" WINDOW w AS {SEG}")
    def _(s, sf):
        return win(s, sf, lambda w: {f"atr_change_{k}": X.ratio_change(w, "atr", k) for k in (1, 8)}, atr=True)

    @cat.add("e09_ols_slope", base() + sel(",".join(
        f"round({g(n-1, f'regr_slope(close, pos) {fr(f'{n-1} PRECEDING')}')}, 6) AS slope_{n}, round({g(n-1, f'regr_slope(close, pos) {fr(f'{n-1} PRECEDING')} / atr')}, 6) AS slope_atr_{n}" for n in (4, 16))))
    def _(s, sf):
        return win(s, sf, lambda w: {k: v for n in (4, 16) for k, v in (
            (f"slope_{n}", X.ols_slope(w, n)), (f"slope_atr_{n}", safe_ratio(X.ols_slope(w, n), C("atr"))))}, atr=True)

    @cat.add("e10_horizon_trend", base() + f"SELECT symbol, {ep('ts')} AS ts_s, round(d, 6) AS move, round(abs(d), 6) AS abs_move, round(d / p, 6) AS pct, round(d / atr, 6) AS move_atr, round(sl, 6) AS slope, round(e, 6) AS efficiency FROM ("
             f"SELECT *, {g(8, 'close - lag(close, 8) OVER w')} AS d, lag(close, 8) OVER w AS p, {g(8, f'regr_slope(close, pos) {fr("8 PRECEDING")}')} AS sl, {er(8, 'NULL')} AS e FROM a WINDOW w AS {SEG})")
    def _(s, sf):
        def make(w):
            d = X.displacement(w, 8)
            return {"move": d, "abs_move": F.abs(d), "pct": safe_ratio(d, C("close") - d), "move_atr": safe_ratio(d, C("atr")),
                    "slope": X.ols_slope(w, 9), "efficiency": X.efficiency(w, 8, None)}
        return win(s, sf, make, atr=True)

    f7 = fr("7 PRECEDING")

    @cat.add("e11_rolling_range", base() + f"""SELECT symbol, {ep('ts')} AS ts_s, round(hi, 6) AS rolling_high, round(lo, 6) AS rolling_low,
        round(hi - lo, 6) AS rolling_range_price, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END, 6) AS close_position_in_range,
        round(hi - close, 6) AS distance_from_rolling_high_price, round(close - lo, 6) AS distance_from_rolling_low_price,
        CASE WHEN seg_pos >= 7 THEN q.pos - (SELECT max(y.pos) FROM a y WHERE y.symbol = q.symbol AND y.seg = q.seg AND y.pos BETWEEN q.pos - 7 AND q.pos AND y.high = q.hi) END AS bars_since_rolling_high,
        CASE WHEN seg_pos >= 7 THEN q.pos - (SELECT max(y.pos) FROM a y WHERE y.symbol = q.symbol AND y.seg = q.seg AND y.pos BETWEEN q.pos - 7 AND q.pos AND y.low = q.lo) END AS bars_since_rolling_low
        FROM (SELECT *, {g(7, f'max(high) {f7}')} AS hi, {g(7, f'min(low) {f7}')} AS lo FROM a) q""")
    def _(s, sf): return win(s, sf, lambda w: X.rolling_range(w, 8))

    @cat.add("e12_prior_range_pos", base() + f"SELECT symbol, {ep('ts')} AS ts_s, round(CASE WHEN hi = lo THEN 0.5 ELSE (close - lo) / (hi - lo) END, 6) AS range_pos_16 FROM (SELECT *, {g(16, f'max(high) {fr("16 PRECEDING", "1 PRECEDING")}')} AS hi, {g(16, f'min(low) {fr("16 PRECEDING", "1 PRECEDING")}')} AS lo FROM a)")
    def _(s, sf): return win(s, sf, lambda w: {"range_pos_16": X.prior_range_pos(w, 16)})

    @cat.add("e13_prior_structure", base() + f"SELECT symbol, {ep('ts')} AS ts_s, hi AS prior_high_12, lo AS prior_low_12, close > hi AS breakout_high_12, close < lo AS breakout_low_12 FROM (SELECT *, {g(12, f'max(high) {fr("12 PRECEDING", "1 PRECEDING")}')} AS hi, {g(12, f'min(low) {fr("12 PRECEDING", "1 PRECEDING")}')} AS lo FROM a)")
    def _(s, sf):
        def make(w):
            hi, lo = X.prior_extremes(w, 12)
            return {"prior_high_12": hi, "prior_low_12": lo, "breakout_high_12": C("close") > hi, "breakout_low_12": C("close") < lo}
        return win(s, sf, make)

    @cat.add("e14_momentum_change", base() + f"""SELECT symbol, {ep('ts')} AS ts_s, round(n, 6) AS recent_displacement_price, round(b, 6) AS preceding_displacement_price,
        round(CASE WHEN b <> 0 THEN n / b END, 6) AS recent_to_preceding_displacement_ratio, round(s1, 6) AS recent_regression_slope, round(s0, 6) AS preceding_regression_slope,
        CASE WHEN abs(s0) > 1e-9 THEN round(s1 / s0, 4) END AS slope_ratio, CASE WHEN seg_pos >= 8 THEN n <> 0 AND b <> 0 AND (n > 0) <> (b > 0) END AS displacement_sign_changed
        FROM (SELECT *, {g(8, 'close - lag(close, 4) OVER w')} AS n, {g(8, 'lag(close, 4) OVER w - lag(close, 8) OVER w')} AS b,
        {g(8, f'regr_slope(close, pos) {fr("4 PRECEDING")}')} AS s1, {g(8, f'regr_slope(close, pos) {fr("8 PRECEDING", "4 PRECEDING")}')} AS s0 FROM a WINDOW w AS {SEG})""")
    def _(s, sf):
        def make(w):
            m = X.momentum_change(w, 4)
            ratio = m.pop("recent_to_preceding_slope_ratio")
            m["slope_ratio"] = F.when(F.abs(m["preceding_regression_slope"]) > 1e-9, F.round(ratio, 4))
            return m
        return win(s, sf, make)

    @cat.add("e15_return_stats", base() + sel(f"round({g(8, f'avg(ret) {f7}')}, 6) AS mean_return, round({g(8, f'quantile_cont(ret, 0.5) {f7}')}, 6) AS median_return"))
    def _(s, sf):
        f = lambda w: w.rowsBetween(-7, 0)
        return win(s, sf, lambda w: {"mean_return": X.after(8, F.avg("simple_return").over(f(w))),
                                     "median_return": X.after(8, F.percentile("simple_return", 0.5).over(f(w)))})

    ctx = lambda tf, sec: f"""c{tf} AS (SELECT symbol, seg, make_timestamp(CAST(floor(epoch(ts) / {sec}) AS BIGINT) * {sec} * 1000000) AS b,
       arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM x GROUP BY 1, 2, 3 HAVING count(*) = {sec} / {M15}),
      i{tf} AS (SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY b) - 1 AS seg_pos, row_number() OVER (PARTITION BY symbol ORDER BY b) - 1 AS pos FROM c{tf})"""

    def hi_sql(tf, sec):
        core = atr_sql(src=f"i{tf}")
        for n in ("tr", "sd", "rec", "a"):
            core = core.replace(f" {n} AS (", f" {tf}{n} AS (").replace(f"FROM {n} ", f"FROM {tf}{n} ").replace(f"JOIN {n} ", f"JOIN {tf}{n} ")
        core = core.replace("tr AS (SELECT *", f"{tf}tr AS (SELECT *", 1).replace("FROM tr)", f"FROM {tf}tr)").replace("sd.*", f"{tf}sd.*").replace("rec.v", f"{tf}rec.v").replace("rec USING", f"rec USING")
        core = core.replace("LEFT JOIN rec", f"LEFT JOIN {tf}rec").replace("FROM sd LEFT", f"FROM {tf}sd LEFT").replace("FROM sd WHERE", f"FROM {tf}sd WHERE").replace("FROM rec r", f"FROM {tf}rec r").replace("JOIN sd s", f"JOIN {tf}sd s")
        return f"""{ctx(tf, sec)}, {core}, {tf}c AS (SELECT symbol, seg, b + INTERVAL {sec} SECOND AS e, sign(close - open)::BIGINT AS dir, {er(8, 0.0)} AS er8,
           atr / lag(atr, 4) OVER w - 1 AS ac4, {g(7, f'regr_slope(close, pos) {fr("7 PRECEDING")} / atr')} AS sl8 FROM {tf}a WINDOW w AS {SEG})"""

    rank = lambda x: f"CASE WHEN len(list({x}) FILTER ({x} IS NOT NULL) {fr('99 PRECEDING')}) = 100 THEN 1.0 * list_sum(list_transform(list({x}) {fr('99 PRECEDING')}, lambda v: CASE WHEN v <= {x} THEN 1 ELSE 0 END)) END"
    uni = f"""WITH RECURSIVE {indexed_sql(M15)}, {atr_sql()}, {hi_sql('h', 3600)}, {hi_sql('k', 10800)}, f AS (
      SELECT a.*, high - low AS candle_range, abs(close - open) AS body_size, CASE WHEN high > low THEN abs(close - open) / (high - low) END AS body_ratio,
       high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, (open + close) / 2 AS body_midpoint,
       CASE WHEN high > low THEN (close - low) / (high - low) END AS close_location, sign(close - open)::BIGINT AS candle_direction,
       {g(4, 'close - lag(close, 4) OVER w')} / atr AS displacement_4_atr, {g(8, 'close - lag(close, 8) OVER w')} / atr AS displacement_8_atr,
       {er(4, 0.0)} AS er_4, {er(16, 0.0)} AS er_16, {g(16, f'sqrt(sum(lr * lr) {fr("15 PRECEDING")})')} AS rv_16,
       atr / lag(atr, 1) OVER w - 1 AS atr_change_1, atr / lag(atr, 8) OVER w - 1 AS atr_change_8,
       {g(3, f'regr_slope(close, pos) {fr("3 PRECEDING")}')} / atr AS slope_atr_4, {g(15, f'regr_slope(close, pos) {fr("15 PRECEDING")}')} / atr AS slope_atr_16,
       {g(16, f'max(high) {fr("16 PRECEDING", "1 PRECEDING")}')} AS h16, {g(16, f'min(low) {fr("16 PRECEDING", "1 PRECEDING")}')} AS l16,
       {g(12, f'max(high) {fr("12 PRECEDING", "1 PRECEDING")}')} AS prior_high_12, {g(12, f'min(low) {fr("12 PRECEDING", "1 PRECEDING")}')} AS prior_low_12,
       list(high - low) {fr('99 PRECEDING')} AS lr_, list(atr) FILTER (atr IS NOT NULL) {fr('99 PRECEDING')} AS la_,
       ts + INTERVAL {M15} SECOND AS close_ts FROM a WINDOW w AS {SEG}), m AS (
      SELECT f.*, CASE WHEN len(lr_) = 100 THEN 1.0::DOUBLE * len(list_filter(lr_, lambda v: v <= candle_range)) END AS range_percentile_100,
       CASE WHEN len(la_) = 100 AND atr IS NOT NULL THEN 1.0::DOUBLE * len(list_filter(la_, lambda v: v <= atr)) END AS atr_percentile_100,
       CASE WHEN h16 = l16 THEN 0.5 ELSE (close - l16) / (h16 - l16) END AS range_pos_16,
       extract(hour FROM (close_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS analysis_hour, isodow(close_ts) - 1 AS weekday,
       extract(hour FROM (close_ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London') BETWEEN 8 AND 16 AS london_active,
       extract(hour FROM (close_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') BETWEEN 8 AND 16 AS new_york_active FROM f)"""
    plain = ("candle_range body_size body_ratio upper_wick lower_wick body_midpoint close_location displacement_4_atr displacement_8_atr "
             "er_4 er_16 rv_16 atr_change_1 atr_change_8 slope_atr_4 slope_atr_16 range_pos_16 prior_high_12 prior_low_12 range_percentile_100 atr_percentile_100").split()
    uni_sel = f"""SELECT m.symbol, {ep('m.close_ts')} AS close_ts, {', '.join(f'round(m.{c}, 6) AS {c}' for c in plain)}, round(m.atr, 6) AS atr_14, candle_direction,
      close > prior_high_12 AS breakout_high_12, close < prior_low_12 AS breakout_low_12,
      hc.dir AS completed_h1_direction, round(hc.er8, 6) AS h1_er_8, round(hc.ac4, 6) AS h1_atr_change_4, round(hc.sl8, 6) AS h1_slope_atr_8,
      kc.dir AS completed_h3_direction, round(kc.er8, 6) AS h3_er_8, round(kc.ac4, 6) AS h3_atr_change_4, round(kc.sl8, 6) AS h3_slope_atr_8,
      CAST(analysis_hour AS BIGINT) AS analysis_hour, CAST(weekday AS BIGINT) AS weekday, london_active, new_york_active, london_active AND new_york_active AS london_new_york_overlap,
      (m.body_ratio IS NOT NULL AND m.close_location IS NOT NULL AND m.atr_percentile_100 IS NOT NULL AND m.range_percentile_100 IS NOT NULL AND m.displacement_8_atr IS NOT NULL
       AND m.er_16 IS NOT NULL AND m.rv_16 IS NOT NULL AND m.atr_change_8 IS NOT NULL AND m.slope_atr_16 IS NOT NULL AND m.range_pos_16 IS NOT NULL AND m.prior_high_12 IS NOT NULL
       AND hc.dir IS NOT NULL AND kc.dir IS NOT NULL) AS feature_ready
      FROM m ASOF LEFT JOIN hc ON m.symbol = hc.symbol AND m.seg = hc.seg AND m.close_ts >= hc.e ASOF LEFT JOIN kc ON m.symbol = kc.symbol AND m.seg = kc.seg AND m.close_ts >= kc.e"""

    drop = ("open", "high", "low", "close", "tick_volume", "spread", "ts", "prev_ts", "pos", "seg", "seg_pos")

    @cat.add("e21_universal_features", uni + uni_sel)
    def _(s, sf): return X.universal_features(indexed(s, sf, M15), M15, CHUNK).drop(*drop)

    vec = ", ".join(f"round({c}, 6)" for c in X.STATE_FEATURES)

    uni_h1 = uni.replace(indexed_sql(M15), indexed_sql(H1)).replace(f" / {M15}", f" / {H1}").replace(f"INTERVAL {M15} SECOND", f"INTERVAL {H1} SECOND")

    @cat.add("e22_state_vector", f"{uni_h1}, o AS ({uni_sel}) SELECT symbol, close_ts, " + ", ".join(f"{c} AS v{i:02d}" for i, c in enumerate(X.STATE_FEATURES))
             + " FROM o WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in X.STATE_FEATURES))
    def _(s, sf):
        v = X.state_vector(X.universal_features(indexed(s, sf), H1, CHUNK))
        return v.select("symbol", "close_ts", *[C("state_vector")[i].alias(f"v{i:02d}") for i in range(len(X.STATE_FEATURES))])

    @cat.add("e28_trend_momentum", base() + f"""SELECT symbol, {ep('ts')} AS ts_s, CASE WHEN s >= 1 AND mv > 0 THEN 'BULLISH' WHEN s >= 1 AND mv < 0 THEN 'BEARISH' ELSE 'NO_TREND' END AS trend,
        round(coalesce(mv, 0), 6) AS net_move, round(s, 6) AS strength, coalesce(s >= 1 AND mv > 0, false) AS momentum_long, coalesce(s >= 1 AND mv < 0, false) AS momentum_short
        FROM (SELECT *, abs(mv) / atr AS s FROM (SELECT *, CASE WHEN seg_pos >= 14 AND atr IS NOT NULL THEN close - first_value(open) {f7} END AS mv FROM a))""")
    def _(s, sf):
        return X.trend_measures(indexed(s, sf, M15), chunk_rows=CHUNK).select(
            "symbol", F.unix_seconds("ts").alias("ts_s"), "trend", "net_move", "strength", "momentum_long", "momentum_short")

    def imp(side):
        s, e, opp = ("low", "high", ">") if side == "long" else ("high", "low", "<")
        best, agg = ("ASC", "max") if side == "long" else ("DESC", "min")
        return f"""p{side} AS (SELECT q.symbol, q.pos, f.pos AS fp, f.ts AS from_ts, f.{s} AS sv, {agg}(l.{e}) AS ev
          FROM x q JOIN x f ON f.symbol = q.symbol AND f.seg = q.seg AND f.pos BETWEEN q.pos - 7 AND q.pos - 1
          JOIN x l ON l.symbol = q.symbol AND l.seg = q.seg AND l.pos BETWEEN f.pos + 1 AND q.pos WHERE q.seg_pos >= 7 GROUP BY ALL HAVING {agg}(l.{e}) {opp} f.{s}),
        r{side} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, pos ORDER BY sv {best}, fp) AS rn FROM p{side}) WHERE rn = 1),
        z{side} AS (SELECT r.symbol, r.pos, r.from_ts, r.sv, r.ev, min(l.ts) AS to_ts FROM r{side} r JOIN x l ON l.symbol = r.symbol AND l.pos BETWEEN r.fp + 1 AND r.pos AND l.{e} = r.ev GROUP BY ALL)"""

    @cat.add("e28_impulse_anchors", f"""WITH {indexed_sql(M15)}, {imp('long')}, {imp('short')} SELECT x.symbol, {ep('x.ts')} AS ts_s, {ep('a.from_ts')} AS long_from, {ep('a.to_ts')} AS long_to, a.sv AS long_low, a.ev AS long_high,
        {ep('b.from_ts')} AS short_from, {ep('b.to_ts')} AS short_to, b.sv AS short_high, b.ev AS short_low FROM x LEFT JOIN zlong a USING (symbol, pos) LEFT JOIN zshort b USING (symbol, pos)""")
    def _(s, sf):
        return X.impulse_anchors(indexed(s, sf, M15), chunk_rows=CHUNK).select(
            "symbol", F.unix_seconds("ts").alias("ts_s"), "long_from", "long_to", "long_low", "long_high",
            "short_from", "short_to", "short_high", "short_low")

    @cat.add("e29_block_fib_signal", f"""WITH {indexed_sql(M15)}, q AS (SELECT *, first_value(open) OVER w AS bo, count(*) OVER w AS n, ts + INTERVAL {M15} SECOND AS d FROM x
        WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS 11 PRECEDING)), l AS (SELECT *, (d AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, (bo + close) / 2 AS mid FROM q)
        SELECT symbol, {ep('d')} AS decision_ts, bo AS block_open, close AS block_close, round(mid - 3 * (greatest(bo, close) - mid), 6) AS entry,
        round(mid - 3 * (greatest(bo, close) - mid) - 40 * 0.0001, 6) AS stop, round(mid - 3 * (greatest(bo, close) - mid) + 5 * 0.0001, 6) AS target, {ep('d')} + 10800 AS expires_ts
        FROM l WHERE n = 12 AND extract(minute FROM ny) = 0 AND extract(hour FROM ny) % 3 = 0 AND bo <> close""")
    def _(s, sf): return X.block_signal(indexed(s, sf, M15), M15, chunk_rows=CHUNK)

    snap = [("atr", "round(atr, 6)"), ("tr_mean_short", f"round({g(14, f'avg(tr) {fr("13 PRECEDING")}')}, 6)"),
            ("h4_displacement_price", f"round({g(4, 'close - lag(close, 4) OVER w')}, 6)"),
            ("h8_rolling_high", g(7, f"max(high) {f7}")), ("h12_mean_candle_return", f"round({g(12, f'avg(ret) {fr("11 PRECEDING")}')}, 6)"),
            ("atr_rank", f"round(CASE WHEN atr IS NOT NULL THEN 100.0 * list_sum(list_transform(list(atr) FILTER (atr IS NOT NULL) {fr('249 PRECEDING')}, lambda v: CASE WHEN v <= atr THEN 1 ELSE 0 END)) / len(list(atr) FILTER (atr IS NOT NULL) {fr('249 PRECEDING')}) END, 6)")]

    @cat.add("e30_market_snapshot", base(H1) + f"""SELECT symbol, {ep('ts')} + 3600 AS close_ts, {', '.join(f'{b} AS {k}' for k, b in snap)},
        CASE WHEN atr IS NULL THEN 'insufficient_history' END AS atr_missing, extract(hour FROM ts + INTERVAL 1 HOUR)::DOUBLE AS utc_hour FROM a WINDOW w AS {SEG}""".replace(
        snap[-1][1], "round(CASE WHEN atr IS NOT NULL THEN 100.0 * len(list_filter(la, lambda v: v <= atr)) / len(la) END, 6)").replace(
        " FROM a WINDOW", f" FROM (SELECT *, list(atr) FILTER (atr IS NOT NULL) {fr('249 PRECEDING')} AS la FROM a) WINDOW"))
    def _(s, sf):
        m = X.snapshot_features(indexed(s, sf, H1), H1, chunk_rows=CHUNK)
        v = lambda k: F.try_element_at("values", F.lit(k))
        return m.select("symbol", "close_ts", v("volatility.atr").alias("atr"), v("volatility.tr_mean_short").alias("tr_mean_short"),
                        v("h4.displacement_price").alias("h4_displacement_price"), v("h8.rolling_high").alias("h8_rolling_high"),
                        v("h12.mean_candle_return").alias("h12_mean_candle_return"), v("volatility.atr_percentile").alias("atr_rank"),
                        F.try_element_at("missing", F.lit("volatility.atr")).alias("atr_missing"), v("calendar.utc_hour").alias("utc_hour"))
