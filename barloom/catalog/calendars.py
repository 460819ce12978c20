"""Group C: resampling, blocks, sessions and calendar features."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import CHUNK, H1, M15, bars, bars_sql, ep, indexed, indexed_sql, table
from barloom.functions import calendar as K
from barloom.operators import blocks as B, windows as X

C = F.col
NYSQL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
to_utc = lambda x, z: f"((({x}) AT TIME ZONE '{z}') AT TIME ZONE 'UTC')"


def block_sql(minutes, src="x", name="bl", step=H1, keys="symbol, seg"):
    n = minutes * 60 // step
    return f"""{name}_n AS (SELECT *, {NYSQL} AS ny FROM {src}), {name}_i AS (SELECT *, CAST(ny AS date) AS d, CAST(floor((hour(ny) * 60 + minute(ny)) / {minutes}) AS BIGINT) AS i FROM {name}_n), {name} AS (
      SELECT {keys}, d, i, {to_utc(f"CAST(d AS timestamp) + i * INTERVAL {minutes} MINUTE", 'America/New_York')} AS bs, {to_utc(f"CAST(d AS timestamp) + (i + 1) * INTERVAL {minutes} MINUTE", 'America/New_York')} AS be,
      arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, count(*) AS n FROM {name}_i GROUP BY ALL HAVING count(*) = {n})"""


SESS = {"TOKYO": ("Asia/Tokyo", 9, 18), "LONDON": ("Europe/London", 8, 17), "NEW_YORK": ("America/New_York", 8, 17)}


def session_sql(src="x"):
    parts = []
    for name, (z, a, b) in SESS.items():
        loc = f"((ts AT TIME ZONE 'UTC') AT TIME ZONE '{z}')"
        parts.append(f"""SELECT symbol, seg, '{name}' AS session, CAST({loc} AS date) AS session_date, {to_utc(f"CAST(CAST({loc} AS date) AS timestamp) + INTERVAL {a} HOUR", z)} AS s, {to_utc(f"CAST(CAST({loc} AS date) AS timestamp) + INTERVAL {b} HOUR", z)} AS e,
          arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, count(*) AS n FROM {src} WHERE hour({loc}) >= {a} AND hour({loc}) < {b} GROUP BY ALL HAVING count(*) = {b - a}""")
    return "ss AS (SELECT *, high - low AS range, CASE WHEN close > open THEN 'BULLISH' WHEN close < open THEN 'BEARISH' ELSE 'FLAT' END AS direction FROM (" + " UNION ALL ".join(parts) + "))"


REL = """CASE WHEN o.open > r.high THEN 'ABOVE' WHEN o.open < r.low THEN 'BELOW' ELSE 'INSIDE' END AS observed_open_position, CASE WHEN o.close > r.high THEN 'ABOVE' WHEN o.close < r.low THEN 'BELOW' ELSE 'INSIDE' END AS observed_close_position,
  o.high > r.high AS traded_above_reference_high, o.low < r.low AS traded_below_reference_low, o.close > r.high AS closed_above_reference_high, o.close < r.low AS closed_below_reference_low,
  o.high > r.high AND o.close <= r.high AS high_excursion_returned_inside_by_close, o.low < r.low AND o.close >= r.low AS low_excursion_returned_inside_by_close, o.high <= r.high AND o.low >= r.low AS stayed_inside_reference_range,
  o.high > r.high AND o.low < r.low AS traded_both_sides_of_reference_range, round(CASE WHEN r.range > 0 THEN o.range / r.range END, 6) AS range_ratio, o.direction = r.direction AS same_direction,
  least(r.e, o.e) > greatest(r.s, o.s) AS overlaps_in_time, CASE WHEN least(r.e, o.e) > greatest(r.s, o.s) THEN (epoch(least(r.e, o.e)) - epoch(greatest(r.s, o.s))) / 60 ELSE 0.0::DOUBLE END AS overlap_minutes"""


def register(cat):
    @cat.add("c01_resample_complete", f"WITH {indexed_sql(M15)}, h AS (SELECT symbol, seg, date_trunc('hour', ts) AS t, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(tick_volume) AS BIGINT) AS tick_volume, arg_max(spread, ts) AS spread FROM x GROUP BY 1, 2, 3 HAVING count(*) = 4) SELECT symbol, seg, {ep('t')} AS ts, open, high, low, close, tick_volume, spread FROM h")
    def _(s, sf): return X.resample_complete(indexed(s, sf, M15), M15, H1)

    @cat.add("c02_resolve_block", f"""WITH n AS (SELECT event_id, {NYSQL} AS ny FROM events), i AS (SELECT *, CAST(floor(hour(ny) / 3) AS BIGINT) AS i FROM n)
        SELECT event_id, CAST(ny AS date) AS block_date, i AS block_index, 'C' || (i + 1) AS block_label, {ep(to_utc("CAST(CAST(ny AS date) AS timestamp) + i * INTERVAL 3 HOUR", "America/New_York"))} AS block_start, {ep(to_utc("CAST(CAST(ny AS date) AS timestamp) + (i + 1) * INTERVAL 3 HOUR", "America/New_York"))} AS block_end FROM i""")
    def _(s, sf):
        e = table(s, sf, "events").select("event_id", C("ts").cast("timestamp").alias("ts"))
        return e.withColumns(K.resolve_block("ts")).drop("ts", "local_start", "local_end")

    # whole-history blocks of order and ship dates cross every daylight-saving change of their years
    @cat.add("c02_resolve_block_dst", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS timestamp) + (l_partkey % 1440) * INTERVAL 1 MINUTE AS ts FROM lineitem), n AS (SELECT *, {NYSQL} AS ny FROM t), i AS (SELECT *, CAST(floor((hour(ny) * 60 + minute(ny)) / 60) AS BIGINT) AS i FROM n)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ny AS date) AS block_date, i AS block_index FROM i""")
    def _(s, sf):
        ts = C("l_shipdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (C("l_partkey") % 1440).cast("int"))
        li = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ts.alias("ts"))
        b = K.resolve_block("ts", K.FRAMES["NY_H1"])
        return li.withColumns({k: b[k] for k in ("block_date", "block_index")}).drop("ts")

    @cat.add("c03_anchored_blocks", f"WITH {indexed_sql(H1)}, {block_sql(180)} SELECT symbol, seg, d AS block_date, 'C' || (i + 1) AS block_label, i AS block_index, {ep('bs')} AS block_start, {ep('be')} AS block_end, open, high, low, close, n AS bar_count FROM bl")
    def _(s, sf): return B.anchored_blocks(indexed(s, sf), H1)

    @cat.add("c04_expected_window", f"WITH {bars_sql(M15)}, t AS (SELECT symbol, ts + INTERVAL 15 MINUTE AS t FROM b), n AS (SELECT *, date_trunc('hour', ((t - INTERVAL 1 MICROSECOND) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS ny FROM t), "
             f"w AS (SELECT symbol, t, CAST(CAST(ny AS date) AS timestamp) + CAST(floor(hour(ny) / 4) AS BIGINT) * INTERVAL 4 HOUR AS b FROM n) SELECT symbol, {ep('t')} AS close_ts, "
             f"CASE WHEN {to_utc('b + INTERVAL 4 HOUR', 'America/New_York')} <= t THEN {ep(to_utc('b', 'America/New_York'))} ELSE {ep(to_utc('b - INTERVAL 4 HOUR', 'America/New_York'))} END AS block_start, CASE WHEN {to_utc('b + INTERVAL 4 HOUR', 'America/New_York')} <= t THEN {ep(to_utc('b + INTERVAL 4 HOUR', 'America/New_York'))} ELSE {ep(to_utc('b', 'America/New_York'))} END AS block_end FROM w")
    def _(s, sf):
        d = indexed(s, sf, M15).select("symbol", (F.timestamp_seconds(F.unix_seconds("ts") + M15)).alias("close_ts"))
        return d.withColumns(B.expected_window(C("close_ts"), K.FRAMES["NY_H4"]))

    fr = {"NY_D1": 1440, "NY_H4": 240, "NY_H1": 60, "NY_H3": 180}

    def fsel(n, m):
        return f"LEFT JOIN b{n} {n} ON {n}.symbol = w.symbol AND {n}.seg = w.seg AND {n}.be <= w.t AND {n}.be > w.t - INTERVAL {m} MINUTE"

    @cat.add("c05_frame_context", f"WITH {indexed_sql(H1)}, " + ", ".join(block_sql(m, name=f"b{n}") for n, m in fr.items()) + f", w AS (SELECT *, ts + INTERVAL 1 HOUR AS t FROM x) SELECT w.symbol, {ep('w.t')} AS close_ts, "
             + ", ".join(f"{n}.open AS {n}_open, {n}.close AS {n}_close, {n}.i AS {n}_index" for n in fr) + " FROM w " + " ".join(fsel(n, m) for n, m in fr.items()))
    def _(s, sf):
        d = B.frame_context(indexed(s, sf), H1)
        return d.select("symbol", "close_ts", *[C(f"{n}.{f}").alias(f"{n}_{a}") for n in fr for f, a in (("open", "open"), ("close", "close"), ("block_index", "index"))])

    @cat.add("c06_session_windows", "SELECT DISTINCT CAST(l_shipdate AS date) AS d, " + ", ".join(
        f"{ep(to_utc(f'CAST(CAST(l_shipdate AS date) AS timestamp) + INTERVAL {a} HOUR', z))} AS {n.lower()}_start, {ep(to_utc(f'CAST(CAST(l_shipdate AS date) AS timestamp) + INTERVAL {b} HOUR', z))} AS {n.lower()}_end" for n, (z, a, b) in SESS.items()) + " FROM lineitem")
    def _(s, sf):
        d = table(s, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
        return d.withColumns({f"{x.name.lower()}_{k}": v for x in B.SESSIONS for k, v in B.session_window(C("d"), x).items()})

    @cat.add("c07_completed_sessions", f"WITH {indexed_sql(H1)}, {session_sql()} SELECT symbol, session, session_date, {ep('s')} AS start, {ep('e')} AS \"end\", open, high, low, close, round(range, 6) AS range, direction, n AS bar_count FROM ss")
    def _(s, sf): return B.completed_sessions(indexed(s, sf), H1).drop("seg")

    @cat.add("c08_compare_sessions", f"WITH {indexed_sql(H1)}, {session_sql()} SELECT r.symbol, r.session_date, {REL} FROM ss r JOIN ss o ON r.symbol = o.symbol AND r.seg = o.seg AND r.session_date = o.session_date WHERE r.session = 'LONDON' AND o.session = 'NEW_YORK'")
    def _(s, sf):
        d = B.completed_sessions(indexed(s, sf), H1)
        side = lambda n, a: d.filter(C("session") == n).select("symbol", "seg", "session_date", F.struct("open", "high", "low", "close", "range", "direction", "start", "end").alias(a))
        j = side("LONDON", "ref").join(side("NEW_YORK", "obs"), ["symbol", "seg", "session_date"])
        return j.select("symbol", "session_date", *[v.alias(k) for k, v in B.compare_sessions("ref", "obs").items()])

    def slot(n):
        z, a, b = SESS[n]
        return f"""{n.lower()}_q AS (SELECT symbol, seg, pos, t, CASE WHEN {to_utc(f'CAST(d AS timestamp) + INTERVAL {a} HOUR', z)} <= t THEN d ELSE d - 1 END AS d FROM (SELECT *, CAST((t AT TIME ZONE 'UTC') AT TIME ZONE '{z}' AS date) AS d FROM w)),
          {n.lower()}_a AS (SELECT *, {to_utc(f'CAST(d AS timestamp) + INTERVAL {a} HOUR', z)} <= t AND t < {to_utc(f'CAST(d AS timestamp) + INTERVAL {b} HOUR', z)} AS act FROM {n.lower()}_q),
          {n.lower()}_z AS (SELECT q.symbol, q.pos, q.act, s.* EXCLUDE (symbol, seg) FROM {n.lower()}_a q LEFT JOIN ss s ON s.session = '{n}' AND s.symbol = q.symbol AND s.seg = q.seg AND s.session_date = q.d AND NOT q.act)"""

    slots = f"WITH {indexed_sql(H1)}, {session_sql()}, w AS (SELECT *, ts + INTERVAL 1 HOUR AS t FROM x), " + ", ".join(slot(n) for n in SESS)

    @cat.add("c09_session_slots", slots + f" SELECT w.symbol, {ep('w.t')} AS close_ts, " + ", ".join(f"{n.lower()}_z.act AS {n.lower()}_active, NOT {n.lower()}_z.act AND {n.lower()}_z.session IS NULL AS {n.lower()}_missing, {n.lower()}_z.open AS {n.lower()}_open, {n.lower()}_z.direction AS {n.lower()}_direction" for n in SESS)
             + " FROM w " + " ".join(f"JOIN {n.lower()}_z ON {n.lower()}_z.symbol = w.symbol AND {n.lower()}_z.pos = w.pos" for n in SESS))
    def _(s, sf):
        d = B.session_slots(indexed(s, sf), H1)
        return d.select("symbol", "close_ts", *[c for n in SESS for c in (C(f"{n}_active").alias(f"{n.lower()}_active"), C(f"{n}_missing").alias(f"{n.lower()}_missing"),
                                                                         C(f"{n}.open").alias(f"{n.lower()}_open"), C(f"{n}.direction").alias(f"{n.lower()}_direction"))])

    @cat.add("c10_session_relationships", slots + " " + " UNION ALL ".join(
        f"SELECT w.symbol, {ep('w.t')} AS close_ts, '{a}_TO_{b}' AS relationship, {REL} FROM w JOIN {a.lower()}_z r ON r.symbol = w.symbol AND r.pos = w.pos JOIN {b.lower()}_z o ON o.symbol = w.symbol AND o.pos = w.pos WHERE r.session IS NOT NULL AND o.session IS NOT NULL"
        for a, b in (("TOKYO", "LONDON"), ("LONDON", "NEW_YORK"))))
    def _(s, sf):
        d = B.session_relationships(B.session_slots(indexed(s, sf), H1))
        from barloom.plans.event_table import RELATIONSHIP_FIELDS as RF
        item = F.explode(F.array(*[F.struct(F.lit(n).alias("relationship"), C(n).alias("r")) for n, _, _ in B.SESSION_PAIRS]))
        return d.select("symbol", "close_ts", item.alias("i")).filter("i.r is not null").select("symbol", "close_ts", "i.relationship", *[C(f"i.r.{f}").alias(f) for f in RF])

    @cat.add("c11_calendar_features", """SELECT event_id, hour(ts)::BIGINT AS utc_hour, minute(ts)::BIGINT AS utc_minute, (isodow(ts) - 1)::BIGINT AS utc_weekday, month(ts)::BIGINT AS utc_month, hour(ny)::BIGINT AS ny_hour, minute(ny)::BIGINT AS ny_minute,
        ((hour(ts) * 60 + minute(ts)) % 180)::BIGINT AS block_elapsed_minutes, round(((hour(ts) * 60 + minute(ts)) % 180) / 180::DOUBLE, 6) AS block_elapsed_fraction FROM (SELECT *, """ + NYSQL + " AS ny FROM events)")
    def _(s, sf):
        e = table(s, sf, "events").select("event_id", C("ts").cast("timestamp").alias("ts"))
        return e.withColumns(K.calendar_features("ts", 180)).drop("ts")

    @cat.add("c12_session_flags", "SELECT event_id, lo BETWEEN 8 AND 16 AS london_active, ny BETWEEN 8 AND 16 AS new_york_active, lo BETWEEN 8 AND 16 AND ny BETWEEN 8 AND 16 AS london_new_york_overlap FROM (SELECT event_id, hour(" + NYSQL + ") AS ny, hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London') AS lo FROM events)")
    def _(s, sf):
        e = table(s, sf, "events").select("event_id", C("ts").cast("timestamp").alias("ts"))
        return e.withColumns(K.session_flags("ts")).drop("ts")

    @cat.add("c13_timeframe_minutes", "WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'H' WHEN 2 THEN 'D' ELSE 'X' END AS u, p_size FROM part) SELECT p_partkey, (CASE u WHEN 'M' THEN 1 WHEN 'H' THEN 60 WHEN 'D' THEN 1440 END * p_size)::BIGINT AS minutes FROM t")
    def _(s, sf):
        unit = F.element_at(F.array(*[F.lit(x) for x in "MHDX"]), (C("p_size") % 4 + 1).cast("int"))
        p = table(s, sf, "part").select("p_partkey", F.concat(unit, C("p_size").cast("string")).alias("tf"))
        return p.select("p_partkey", K.timeframe_minutes_col("tf").alias("minutes"))
