"""Group D: per-row expressions."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import H1, M15, TRADES, bars, bars_sql, ep, indexed, indexed_sql, table, trades
from barloom.functions import scalars as S

C = F.col


def register(cat):
    @cat.add("d01_candle_geometry", f"WITH {bars_sql(M15)} SELECT symbol, {ep('ts')} AS ts, round(high - low, 6) AS candle_range, round(abs(close - open), 6) AS body_size, round(CASE WHEN high > low THEN abs(close - open) / (high - low) END, 6) AS body_ratio, round(high - greatest(open, close), 6) AS upper_wick, round(least(open, close) - low, 6) AS lower_wick, round((open + close) / 2, 6) AS body_midpoint, round(CASE WHEN high > low THEN (close - low) / (high - low) END, 6) AS close_location, sign(close - open)::BIGINT AS candle_direction FROM b")
    def _(s, sf): return indexed(s, sf, M15).select("symbol", "ts", *[v.alias(k) for k, v in S.candle_geometry().items()])

    @cat.add("d02_safe_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 6) AS r FROM lineitem")
    def _(s, sf):
        return table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.safe_ratio("l_discount", "l_tax").alias("r"))

    @cat.add("d03_project_levels", f"WITH {bars_sql(M15)} SELECT symbol, {ep('ts')} AS ts, l.level_id, l.coordinate, round(open + l.coordinate * (open - close), 6) + 0.0 AS level_price, CASE WHEN close > open THEN 'BULLISH' WHEN close < open THEN 'BEARISH' ELSE 'FLAT' END AS direction FROM b, (VALUES ('NEG_3_0', -3.0::DOUBLE), ('NEG_3_3', -3.3::DOUBLE), ('NEG_3_5', -3.5::DOUBLE)) l(level_id, coordinate)")
    def _(s, sf):
        return indexed(s, sf, M15).withColumn("l", F.explode(S.project_levels())).select("symbol", "ts", "l.*", S.direction_of().alias("direction"))

    level = "prev_close"
    ms = {"close_distance": "close - p", "range_distance": "CASE WHEN low > p THEN low - p WHEN high < p THEN high - p ELSE 0 END", "penetration_above": "greatest(0.0, high - p)", "penetration_below": "greatest(0.0, p - low)"}

    @cat.add("d05_measure_level", f"WITH {indexed_sql(H1)}, y AS (SELECT *, lag(close) OVER (PARTITION BY symbol, seg ORDER BY pos) AS p, high - low AS atr FROM x) SELECT symbol, {ep('ts')} AS ts, "
             + ", ".join(f"round(CASE WHEN p IS NOT NULL THEN {v} END, 6) AS {k}_price, round(CASE WHEN p IS NOT NULL AND atr <> 0 THEN ({v}) / atr END, 6) AS {k}_atr" for k, v in ms.items()) + " FROM y")
    def _(s, sf):
        from barloom.operators.timeline import chunked
        d = chunked(indexed(s, sf), lambda x, w: x.withColumns({"p": F.lag("close").over(w), "atr": C("high") - C("low")}), 1, 0, 512)
        return d.select("symbol", "ts", *[v.alias(k) for k, v in S.measure_level("p", "atr").items()])

    @cat.add("d06_candle_shape", f"WITH {bars_sql(M15)} SELECT symbol, {ep('ts')} AS ts, CASE WHEN close > open THEN 'BULLISH' WHEN close < open THEN 'BEARISH' ELSE 'FLAT' END AS direction, round((high - low) / abs(close), 6) AS range_fraction, round(CASE WHEN high > low THEN abs(close - open) / (high - low) END, 6) AS body_to_range, round(CASE WHEN high > low THEN (close - low) / (high - low) END, 6) AS close_location FROM b")
    def _(s, sf): return indexed(s, sf, M15).select("symbol", "ts", *[v.alias(k) for k, v in S.candle_shape(C("close")).items()])

    @cat.add("d07_trade_costs", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.0, l_tax * 100 - 2) * 0.01 * l_quantity, 6) AS spread_cost, round(3.5 * l_quantity * 2, 6)::DOUBLE AS commission_cost, round(0.02 * l_quantity, 6) AS slippage_cost FROM lineitem")
    def _(s, sf):
        d = table(s, sf, "lineitem").withColumn("sp", C("l_tax") * 100 - 2)
        cost = S.trade_costs(S.spread_distance("BAR", bar_spread="sp", point=0.01), "l_quantity", commission_mode="PER_LOT_SIDE", commission=3.5, slippage=0.02)
        return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[v.alias(k) for k, v in cost.items()])

    @cat.add("d08_posterior_scores", """WITH p AS (SELECT event_id, [value / (value + 5 + user_id % 7), 5 / (value + 5 + user_id % 7), (user_id % 7) / (value + 5 + user_id % 7)] AS p FROM events)
        SELECT event_id, round(list_max(p), 6) AS max_posterior, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 6) AS margin, round(list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)), 6) AS entropy FROM p""")
    def _(s, sf):
        t = C("value") + 5 + C("user_id") % 7
        e = table(s, sf, "events").select("event_id", F.array(C("value") / t, F.lit(5.0) / t, (C("user_id") % 7) / t).alias("p"))
        return e.select("event_id", *[v.alias(k) for k, v in S.posterior_scores(C("p")).items()])

    z = S.normal_quantile(0.975)

    @cat.add("d09_wilson_interval", f"""WITH {TRADES}, g AS (SELECT symbol, direction, year(exit_ts) AS y, count(*) FILTER (net_r > 0) AS w, count(*) FILTER (net_r <> 0) AS n FROM t GROUP BY 1, 2, 3), p AS (SELECT *, w / n AS p, {z!r}::DOUBLE AS z FROM g)
        SELECT symbol, direction, y, w, n, round(CASE WHEN n > 0 THEN greatest(0.0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)) END, 6) AS wilson_low, round(CASE WHEN n > 0 THEN least(1.0, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)) END, 6) AS wilson_high FROM p""")
    def _(s, sf):
        g = trades(s, sf).groupBy("symbol", "direction", F.year("exit_ts").alias("y")).agg(F.count_if(C("net_r") > 0).alias("w"), F.count_if(C("net_r") != 0).alias("n"))
        return g.withColumns(S.wilson_interval("w", "n"))

    @cat.add("d10_typed_category", """SELECT event_type, '["string","' || event_type || '"]' AS as_text, '["int","' || (user_id % 3) || '"]' AS as_int, count(*) AS n FROM events GROUP BY ALL""")
    def _(s, sf):
        e = table(s, sf, "events").select("event_type", S.typed_category("string", "event_type").alias("as_text"), S.typed_category("int", C("user_id") % 3).alias("as_int"))
        return e.groupBy("event_type", "as_text", "as_int").agg(F.count("*").alias("n"))

    @cat.add("d11_fingerprint", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS fingerprint FROM nation""")
    def _(s, sf):
        return table(s, sf, "nation").select("n_nationkey", S.fingerprint(["n_regionkey", "n_name", "n_nationkey"]).alias("fingerprint"))
