"""Group A: sources and sinks."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import DIRTY, H1, M15, TICKS, bars, bars_sql, dirty, ep, indexed, indexed_sql, ticks
from barloom.functions.calendar import parse_ts
from barloom.operators.joins import overlapping_intervals
from barloom.sources import files as A, ticks as K

C = F.col


def register(cat):
    @cat.add("a02_parse_ts", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS iso, epoch_us(ts) // 1000000 AS ms, CAST(floor(epoch(ts)) AS BIGINT) + 5 * 3600 AS ny FROM events")
    def _(s, sf):
        e = s.read.parquet(f"{sf}/events.parquet").select("event_id", C("ts").cast("timestamp").alias("ts"))
        iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return e.select("event_id", parse_ts(F.concat(iso, F.lit("Z"))).alias("iso"),
                        parse_ts(F.unix_millis("ts").cast("string"), "EPOCH_MS").alias("ms"), parse_ts(iso, zone="America/New_York").alias("ny"))

    @cat.add("a03_tick_bars", f"WITH {bars_sql(M15)}, e AS (SELECT symbol, min(ts) AS f, max(ts) AS l FROM fx_ticks GROUP BY 1) "
             f"SELECT b.symbol, {ep('b.ts')} AS ts, open, high, low, close, tick_volume, spread, epoch(b.ts) < ceil(epoch(f) / 900) * 900 OR epoch(b.ts) >= floor(epoch(l) / 900) * 900 AS partial_boundary FROM b JOIN e USING (symbol)")
    def _(s, sf):
        t = ticks(s, sf)
        return K.mark_partial_boundary(K.ticks_to_bars(t, M15), t, M15)

    @cat.add("a03_tick_faults", f"WITH {TICKS}, l AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM fx_ticks) SELECT symbol, count(*) AS ticks, count(*) FILTER (ask < bid) AS crossed, count(*) FILTER (NOT (bid > 0 AND ask > 0)) AS invalid, count(*) FILTER (ts < p) AS backward, count(*) FILTER (ts = p) AS duplicate_ts FROM l GROUP BY 1")
    def _(s, sf): return K.tick_faults(ticks(s, sf))

    def flagged(s, sf):
        b, a = F.when(C("seq") % 3 != 0, C("bid")), F.when(C("seq") % 5 != 0, C("ask"))
        flags = F.when(C("seq") % 3 != 0, 2).otherwise(0) + F.when((C("seq") % 5 != 0) & (C("seq") % 7 != 0), 4).otherwise(0) + F.when(C("seq") % 30 == 0, 2).otherwise(0)
        return ticks(s, sf).select("symbol", "seq", "ts", b.alias("bid"), a.alias("ask"), flags.alias("flags"))

    @cat.add("a04_normalise_feed", f"""WITH {TICKS}, f AS (SELECT symbol, seq, ts - INTERVAL 3 HOUR AS ts, CASE WHEN seq % 3 <> 0 THEN bid END AS bid, CASE WHEN seq % 5 <> 0 THEN ask END AS ask,
        CASE WHEN seq % 3 <> 0 THEN 2 ELSE 0 END + CASE WHEN seq % 5 <> 0 AND seq % 7 <> 0 THEN 4 ELSE 0 END + CASE WHEN seq % 30 = 0 THEN 2 ELSE 0 END AS flags FROM fx_ticks), g AS (
        SELECT *, last_value(bid IGNORE NULLS) OVER w AS bn, last_value(ask IGNORE NULLS) OVER w AS an, last_value(bid IGNORE NULLS) OVER p AS bo, last_value(ask IGNORE NULLS) OVER p AS ao FROM f
        WINDOW w AS (PARTITION BY symbol ORDER BY seq), p AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT symbol, seq, {ep('ts').replace('CAST(epoch(ts)', 'CAST(floor(epoch(ts))')} AS ts, CAST(flags AS BIGINT) AS flags, bn AS bid, an AS ask,
        CASE WHEN (flags & 2 > 0 AND bid IS NULL) OR (flags & 4 > 0 AND ask IS NULL) THEN 'FLAGGED_MISSING' WHEN (flags & 2 = 0 AND bid <> bo) OR (flags & 4 = 0 AND ask <> ao) THEN 'UNFLAGGED_CHANGE' END AS fault FROM g""")
    def _(s, sf): return K.normalise_flagged_feed(flagged(s, sf))

    hours = f"""WITH {TICKS}, h AS (SELECT symbol, date_trunc('hour', ts) AS hour, count(*) AS ticks, min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(DISTINCT ts) AS duplicate_ts,
        min(round(ask - bid, 2)) AS spread_min, max(round(ask - bid, 2)) AS spread_max, sum(round(ask - bid, 2)) AS ss FROM fx_ticks GROUP BY 1, 2)"""
    fl = lambda c: f"CAST(floor(epoch({c})) AS BIGINT)"

    @cat.add("a06_tick_hour_manifest", f"{hours} SELECT symbol, {ep('hour')} AS hour, ticks, {fl('first_ts')} AS first_ts, {fl('last_ts')} AS last_ts, duplicate_ts, spread_min, spread_max, round(ss, 6) AS spread_sum FROM h")
    def _(s, sf): return K.tick_hour_manifest(ticks(s, sf)).drop("digest")

    @cat.add("a06_tick_month_manifest", f"{hours} SELECT symbol, strftime(hour, '%Y-%m') AS month, count(*) AS hours, CAST(sum(ticks) AS BIGINT) AS ticks, {fl('min(first_ts)')} AS first_ts, {fl('max(last_ts)')} AS last_ts, CAST(sum(duplicate_ts) AS BIGINT) AS duplicate_ts, min(spread_min) AS spread_min, max(spread_max) AS spread_max, round(sum(ss) / sum(ticks), 6) AS spread_mean FROM h GROUP BY 1, 2")
    def _(s, sf): return K.tick_month_manifest(K.tick_hour_manifest(ticks(s, sf))).drop("digest")

    @cat.add("a07_ticks_to_m1", f"""WITH {TICKS}, m AS (SELECT *, (bid + ask) / 2 AS px, round(ask - bid, 2) AS sp FROM fx_ticks)
        SELECT symbol, {ep("date_trunc('minute', ts)")} AS ts, round(arg_min(px, seq), 6) AS open, round(max(px), 6) AS high, round(min(px), 6) AS low, round(arg_max(px, seq), 6) AS close, count(*) AS tick_volume,
        arg_max(sp, seq) AS spread, arg_min(sp, seq) AS spread_open, min(sp) AS spread_min, max(sp) AS spread_max, round(avg(sp), 6) AS spread_mean FROM m GROUP BY symbol, date_trunc('minute', ts)""")
    def _(s, sf): return K.ticks_to_bars(ticks(s, sf), 60, price="MID", spread_stats=True)

    merge = f"WITH {DIRTY}, g AS (SELECT symbol, ts, count(*) AS copies, count(DISTINCT (open, high, low, close, tick_volume)) AS kinds, any_value(close) AS close FROM dirty GROUP BY 1, 2)"

    @cat.add("a08_merge_bars", f"{merge} SELECT symbol, {ep('ts')} AS ts, copies, close FROM g WHERE kinds = 1")
    def _(s, sf):
        return A.merge_bars(dirty(s, sf).drop("copy", "seq"))[0].select("symbol", "ts", "copies", "close")

    @cat.add("a08_merge_conflicts", f"{merge} SELECT symbol, {ep('ts')} AS ts, d.close, d.seq FROM dirty d JOIN g USING (symbol, ts) WHERE kinds > 1")
    def _(s, sf):
        d = dirty(s, sf)
        bad = A.merge_bars(d.drop("copy", "seq"))[1]
        return A.conflict_rows(d, bad).select("symbol", "ts", "close", "seq")

    @cat.add("a09_archive_increment", f"WITH {bars_sql(M15)} SELECT symbol, strftime(ts, '%Y-%m') AS month, count(*) AS bars, {ep('max(ts)')} AS last_ts FROM b WHERE epoch(ts) + 900 <= epoch(TIMESTAMP '2024-01-28 13:07:00') GROUP BY 1, 2")
    def _(s, sf):
        b = indexed(s, sf, M15).select("symbol", "ts", "open", "high", "low", "close", "tick_volume", "spread")
        old = A.chronological_slice(b, "2024-01-01", "2024-01-15 06:00:00", "OLD").drop("role")
        merged, bad, rev = A.archive_increment(old, b, "2024-01-28 13:07:00", step=M15)
        return merged.groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("bars"), F.max("ts").alias("last_ts"))

    @cat.add("a10_table_fingerprint")
    def _(s, sf):
        d = indexed(s, sf).withColumn("p", C("pos") * 2 + F.when(C("symbol") == "S1", 1).otherwise(0))
        return A.table_fingerprint(d, "p")

    @cat.add("a11_chronological_slice", f"WITH {indexed_sql(M15)} SELECT symbol, count(*) AS n, {ep('min(ts)')} AS first_ts, {ep('max(ts)')} AS last_ts, 'DISCOVERY' AS role FROM x WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
    def _(s, sf):
        return A.chronological_slice(indexed(s, sf, M15), "2024-01-05", "2024-01-20", "DISCOVERY").groupBy("symbol", "role").agg(
            F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    @cat.add("a12_warmup_tail", f"WITH {indexed_sql(M15)} SELECT symbol, {ep('ts')} AS ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM x) WHERE rn <= 50")
    def _(s, sf): return A.warmup_tail(indexed(s, sf, M15), 50).select("symbol", "ts", "close")

    @cat.add("a14_read_features", f"WITH {indexed_sql(M15)} SELECT symbol, {ep('ts')} AS ts, close FROM x WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
    def _(s, sf):
        path = indexed(s, sf, M15).inputFiles()[0].rsplit("/", 1)[0]
        return A.read_features(s, path, ["symbol", "ts", "close"], "2024-01-10", "2024-01-12")

    @cat.add("a13_event_view")
    def _(s, sf):
        from barloom.sources.stage import shared_dir
        import uuid
        return A.write_event_view(cat.event_table(s, sf), f"{shared_dir(s)}/view-{uuid.uuid4().hex}",
                                  ["x.event.pattern_code", "x.market.m15.volatility.atr", "x.session.london.active"])

    @cat.add("a15_export_features")
    def _(s, sf):
        from barloom.sources.stage import shared_dir
        import uuid
        return A.export_features(indexed(s, sf), H1, f"{shared_dir(s)}/features-{uuid.uuid4().hex}", chunk_rows=512)
