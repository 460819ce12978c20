"""Group G: levels, touches, anchors, outcomes and the wide row (plus E16-E20 swings)."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import CHUNK, H1, M15, STATES, bars_sql, ep, indexed, indexed_sql, staged, states
from barloom.functions.scalars import candle_shape, measure_level, observe_level
from barloom.operators import blocks as B, levels as L, outcomes as O, swings as S, windows as X
from barloom.plans import event_table as T

C = F.col
HOR = 32


def parts(s, sf):
    """Prefix bars, placed levels and contacts of the H1 fixture."""
    bars = indexed(s, sf)
    prefix = L.neighbour_bars(bars, HOR, CHUNK)
    inst = L.geometry_instances(B.anchored_blocks(prefix, H1))
    placed = staged_levels(s, sf, "placed", lambda: L.place_levels(L.explode_levels(inst), prefix))
    contacts = staged_levels(s, sf, "contacts", lambda: L.level_contacts(placed, prefix))
    return bars, prefix, inst, placed, contacts


def staged_levels(s, sf, name, make):
    from barloom.catalog import fixtures as fx
    from barloom.sources.stage import stage
    key = (s.sparkContext.applicationId, sf, name)
    if key not in fx._STAGED:
        fx._STAGED[key] = stage(make())
    return fx._STAGED[key]


LEVELS = f"""WITH RECURSIVE {indexed_sql(H1)}, p AS (SELECT * FROM (SELECT *, lead(pos, {HOR}) OVER (PARTITION BY symbol, seg ORDER BY pos) AS far FROM x) WHERE far IS NOT NULL),
 lb0 AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM p), lb AS (
 SELECT *, CAST(floor(extract(hour FROM ny) / 3) AS BIGINT) AS block_index, CAST(ny AS date) AS block_date FROM lb0), bl AS (
 SELECT symbol, seg, block_date, block_index, 'C' || (block_index + 1) AS block_label, min(ts) AS block_start, max(ts) + INTERVAL 1 HOUR AS block_end,
   arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, count(*) AS bar_count FROM lb GROUP BY 1, 2, 3, 4 HAVING count(*) = 3), lv AS (
 SELECT bl.*, l.level_id, l.coordinate, bl.open + l.coordinate * (bl.open - bl.close) AS level_price FROM bl,
   (VALUES ('NEG_3_0', -3.0::DOUBLE), ('NEG_3_3', -3.3::DOUBLE), ('NEG_3_5', -3.5::DOUBLE)) l(level_id, coordinate)), ends AS (
 SELECT symbol, seg, max(pos) AS last_pos FROM p GROUP BY 1, 2), pl AS (
 SELECT lv.symbol, lv.seg, lv.block_date, lv.block_index, lv.block_label, lv.block_start, lv.block_end, lv.level_id, lv.coordinate, lv.level_price,
   p.pos AS start_pos, ends.last_pos, ends.last_pos - p.pos + 1 AS bars_observed
 FROM lv JOIN p ON p.symbol = lv.symbol AND p.seg = lv.seg AND p.ts = lv.block_end JOIN ends ON ends.symbol = lv.symbol AND ends.seg = lv.seg), ob AS (
 SELECT pl.*, p.pos, p.ts, p.open, p.high, p.low, p.close, CASE WHEN p.low > level_price THEN 'ABOVE' WHEN p.high < level_price THEN 'BELOW' ELSE 'TOUCH' END AS state
 FROM pl JOIN p ON p.symbol = pl.symbol AND p.seg = pl.seg AND p.pos >= pl.start_pos), o1 AS (
 SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY symbol, seg, block_start, level_id ORDER BY pos) THEN 0 ELSE 1 END AS cut FROM ob), o2 AS (
 SELECT *, sum(cut) OVER (PARTITION BY symbol, seg, block_start, level_id ORDER BY pos) - 1 AS run_index FROM o1), ru AS (
 SELECT symbol, seg, block_date, block_index, block_label, block_start, block_end, level_id, coordinate, level_price, start_pos, last_pos, run_index, any_value(state) AS state, min(pos) AS run_pos, count(*) AS bar_count,
   bool_or(high > level_price) AS ta, bool_or(low < level_price) AS tb FROM o2 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13), rw AS (
 SELECT *, lag(state) OVER v AS prev_state, lead(state) OVER v AS next_state, lag(bar_count) OVER v AS prev_count, lead(bar_count) OVER v AS next_count, lead(run_pos) OVER v AS next_pos
 FROM ru WINDOW v AS (PARTITION BY symbol, seg, block_start, level_id ORDER BY run_index)), pt AS (
 SELECT *, row_number() OVER (PARTITION BY symbol, seg, block_start, level_id ORDER BY run_index) - 1 AS pattern_index,
   CASE WHEN prev_state IS NULL AND next_state IS NULL THEN 'TOUCH_ONLY' ELSE coalesce(prev_state, 'START') || '_TOUCH_' || coalesce(next_state, 'END') END AS pattern_code
 FROM rw WHERE state = 'TOUCH'), sw AS (
 SELECT *, CASE WHEN pattern_code = 'BELOW_TOUCH_BELOW' AND ta THEN 'ABOVE' WHEN pattern_code = 'ABOVE_TOUCH_ABOVE' AND tb THEN 'BELOW' END AS sweep,
   CASE WHEN prev_state IS NOT NULL AND next_state IS NOT NULL THEN next_state END AS reclaim FROM pt), hi AS (
 SELECT symbol, seg, block_start, level_id, count(*) FILTER (state = 'TOUCH') AS touched_bars, min(pos - start_pos) FILTER (state = 'TOUCH') AS first_touch,
   max(pos - start_pos) FILTER (state = 'TOUCH') AS last_touch FROM ob GROUP BY 1, 2, 3, 4), an AS (
 SELECT symbol, seg, next_pos AS pos, 'TOUCH_TRANSITION' AS anchor_kind, block_start, level_id, level_price, block_label, block_index, coordinate, pattern_index, pattern_code, NULL::BIGINT AS checkpoint_bars, sweep, reclaim FROM sw WHERE next_pos IS NOT NULL
 UNION ALL SELECT pl.symbol, pl.seg, pl.start_pos + n.n - 1, 'UNTOUCHED_CHECKPOINT', pl.block_start, pl.level_id, pl.level_price, pl.block_label, pl.block_index, pl.coordinate, NULL, NULL, n.n, NULL, NULL
 FROM pl JOIN hi USING (symbol, seg, block_start, level_id), (VALUES (4), (8), (16), (32)) n(n) WHERE bars_observed >= n.n AND (first_touch IS NULL OR first_touch >= n.n))"""

def outcome_sql(h, src="x"):
    f = f"(PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    w = "(PARTITION BY symbol, seg ORDER BY pos)"
    whole = f"lead(pos, {h}) OVER {w} IS NOT NULL"
    g = lambda x: f"CASE WHEN {whole} THEN {x} END"
    hs, ls = f"list(high) OVER {f}", f"list(low) OVER {f}"
    return {
        "first_open": g(f"lead(open) OVER {w}"), "end_close": g(f"lead(close, {h}) OVER {w}"),
        "highest_high": g(f"max(high) OVER {f}"), "lowest_low": g(f"min(low) OVER {f}"),
        "close_change": f"round({g(f'lead(close, {h}) OVER {w} - close')}, 6)",
        "close_return_fraction": f"round({g(f'(lead(close, {h}) OVER {w} - close) / close')}, 6)",
        "max_upward_excursion": f"round({g(f'greatest(0.0, max(high) OVER {f} - close)')}, 6)",
        "max_downward_excursion": f"round({g(f'greatest(0.0, close - min(low) OVER {f})')}, 6)",
        "bars_to_highest_high": g(f"list_position({hs}, max(high) OVER {f}) - 1"),
        "bars_to_lowest_low": g(f"list_position({ls}, min(low) OVER {f}) - 1"),
    }


def swing_sql(step=M15):
    f = lambda a, b: f"(PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN {a} AND {b})"
    return f"""WITH RECURSIVE {indexed_sql(step)}, w0 AS (SELECT *, lead(pos, 2) OVER (PARTITION BY symbol, seg ORDER BY pos) AS c2, lead(ts, 2) OVER (PARTITION BY symbol, seg ORDER BY pos) AS confirm_ts,
      max(high) OVER {f('2 PRECEDING', '1 PRECEDING')} AS hb, max(high) OVER {f('1 FOLLOWING', '2 FOLLOWING')} AS ha,
      min(low) OVER {f('2 PRECEDING', '1 PRECEDING')} AS lb, min(low) OVER {f('1 FOLLOWING', '2 FOLLOWING')} AS la FROM x), sw AS (
      SELECT symbol, seg, 'HIGH' AS kind, pos, ts, high AS price, c2 AS confirm_pos, confirm_ts FROM w0 WHERE seg_pos >= 2 AND c2 IS NOT NULL AND high > hb AND high > ha
      UNION ALL SELECT symbol, seg, 'LOW', pos, ts, low, c2, confirm_ts FROM w0 WHERE seg_pos >= 2 AND c2 IS NOT NULL AND low < lb AND low < la), sl AS (
      SELECT *, lag(price) OVER k AS prior_price, CASE WHEN kind = 'HIGH' AND price > lag(price) OVER k THEN 'HH' WHEN kind = 'HIGH' AND price < lag(price) OVER k THEN 'LH'
        WHEN kind = 'LOW' AND price > lag(price) OVER k THEN 'HL' WHEN kind = 'LOW' AND price < lag(price) OVER k THEN 'LL' END AS label
      FROM sw WINDOW k AS (PARTITION BY symbol, seg, kind ORDER BY pos)), sc AS (
      SELECT *, coalesce(sum(CASE WHEN price > prior_price THEN 1 ELSE 0 END) OVER k, 0)::BIGINT AS rising, coalesce(sum(CASE WHEN price < prior_price THEN 1 ELSE 0 END) OVER k, 0)::BIGINT AS falling
      FROM sl WINDOW k AS (PARTITION BY symbol, seg, kind ORDER BY pos ROWS 6 PRECEDING))"""


def register(cat):
    @cat.add("e16_confirmed_swings", swing_sql() + f" SELECT symbol, seg, kind, {ep('ts')} AS ts, price, confirm_pos, {ep('confirm_ts')} AS confirm_ts FROM sw")
    def _(s, sf):
        return S.confirmed_swings(indexed(s, sf, M15), chunk_rows=CHUNK).select("symbol", "seg", "kind", "ts", "price", "confirm_pos", "confirm_ts")

    @cat.add("e17_swing_labels", swing_sql() + f" SELECT symbol, kind, {ep('ts')} AS ts, price, prior_price, label FROM sl")
    def _(s, sf):
        d = S.label_swings(S.confirmed_swings(indexed(s, sf, M15), chunk_rows=CHUNK), chunk_rows=CHUNK)
        return d.select("symbol", "kind", "ts", "price", "prior_price", "label")

    @cat.add("e18_structure_counts", swing_sql() + f" SELECT symbol, kind, {ep('ts')} AS ts, rising, falling FROM sc")
    def _(s, sf):
        d = S.label_swings(S.confirmed_swings(indexed(s, sf, M15), chunk_rows=CHUNK), chunk_rows=CHUNK)
        return S.structure_counts(d, 8, CHUNK).select("symbol", "kind", "ts", "rising", "falling")

    ctx = ", ".join(f"l{k}.{c} AS latest_{n}_{c2}" for k, n in (("h", "high"), ("l", "low")) for c, c2 in (("label", "label"), ("price", "price")))

    @cat.add("e20_swing_context", swing_sql() + f""", sh AS (SELECT * FROM sc WHERE kind = 'HIGH'), so AS (SELECT * FROM sc WHERE kind = 'LOW')
        SELECT x.symbol, {ep('x.ts')} AS ts, {ctx}, round(x.close - lh.price, 6) AS latest_high_distance_price, round(x.close - ll.price, 6) AS latest_low_distance_price,
        x.pos - lh.confirm_pos AS latest_high_bars_since_confirmation, x.pos - ll.confirm_pos AS latest_low_bars_since_confirmation,
        coalesce(lh.rising, 0) AS higher_high_count, coalesce(lh.falling, 0) AS lower_high_count, coalesce(ll.rising, 0) AS higher_low_count, coalesce(ll.falling, 0) AS lower_low_count
        FROM x ASOF LEFT JOIN sh lh ON lh.symbol = x.symbol AND lh.seg = x.seg AND lh.confirm_pos <= x.pos ASOF LEFT JOIN so ll ON ll.symbol = x.symbol AND ll.seg = x.seg AND ll.confirm_pos <= x.pos""")
    def _(s, sf):
        d = S.swing_context(indexed(s, sf, M15), atr=None, chunk_rows=CHUNK)
        return d.drop("open", "high", "low", "close", "tick_volume", "spread", "prev_ts", "pos", "seg", "seg_pos", "structure_break")

    # the automaton itself, bar by bar, as a recursive query
    @cat.add("e19_structure_breaks", swing_sql() + f""", cf AS (SELECT symbol, seg, confirm_pos AS pos, max(CASE WHEN kind = 'HIGH' THEN price END) AS hp, max(CASE WHEN kind = 'HIGH' THEN label END) AS hl, bool_or(kind = 'HIGH') AS nh,
          max(CASE WHEN kind = 'LOW' THEN price END) AS lp, max(CASE WHEN kind = 'LOW' THEN label END) AS ll, bool_or(kind = 'LOW') AS nl FROM sl GROUP BY 1, 2, 3), fb AS (
          SELECT x.symbol, x.seg, x.pos, x.ts, x.seg_pos, x.close, lag(x.close) OVER (PARTITION BY x.symbol, x.seg ORDER BY x.pos) AS pc, hp, hl, coalesce(nh, false) AS nh, lp, ll, coalesce(nl, false) AS nl FROM x LEFT JOIN cf USING (symbol, seg, pos)), st AS (
          SELECT symbol, seg, pos, ts, close, NULL::DOUBLE AS hp, NULL::VARCHAR AS hl, NULL::DOUBLE AS lp, NULL::VARCHAR AS ll, false AS hb, false AS lb, NULL::VARCHAR AS regime, NULL::VARCHAR AS brk FROM fb WHERE seg_pos = 0
          UNION ALL SELECT symbol, seg, pos, ts, close, hp, hl, lp, ll, hb OR up, lb OR dn, CASE WHEN up THEN 'BULLISH' WHEN dn THEN 'BEARISH' ELSE rg END,
            CASE WHEN up AND rg = 'BEARISH' THEN 'CHOCH_BULLISH' WHEN up THEN 'BOS_BULLISH' WHEN dn AND rg = 'BULLISH' THEN 'CHOCH_BEARISH' WHEN dn THEN 'BOS_BEARISH' END
          FROM (SELECT *, coalesce(NOT hb AND pc <= hp AND close > hp, false) AS up, coalesce(NOT lb AND pc >= lp AND close < lp, false) AS dn,
                CASE WHEN fresh AND hl = 'HH' AND ll = 'HL' THEN 'BULLISH' WHEN fresh AND hl = 'LH' AND ll = 'LL' THEN 'BEARISH' ELSE regime END AS rg
           FROM (SELECT f.symbol, f.seg, f.pos, f.ts, f.close, f.pc, CASE WHEN f.nh THEN f.hp ELSE r.hp END AS hp, CASE WHEN f.nh THEN f.hl ELSE r.hl END AS hl,
                 CASE WHEN f.nl THEN f.lp ELSE r.lp END AS lp, CASE WHEN f.nl THEN f.ll ELSE r.ll END AS ll, CASE WHEN f.nh THEN false ELSE r.hb END AS hb,
                 CASE WHEN f.nl THEN false ELSE r.lb END AS lb, r.regime, f.nh OR f.nl AS fresh FROM st r JOIN fb f ON f.symbol = r.symbol AND f.seg = r.seg AND f.pos = r.pos + 1)))
          SELECT symbol, {ep('ts')} AS ts, brk AS structure_break FROM st WHERE brk IS NOT NULL""")
    def _(s, sf):
        return S.structure_breaks(S.swing_context(indexed(s, sf, M15), atr=None, chunk_rows=CHUNK)).select("symbol", "ts", "structure_break")

    @cat.add("g01_geometry_instances", LEVELS + f" SELECT symbol, block_label, {ep('block_start')} AS block_start, {ep('block_end')} AS available_at, level_id, round(level_price, 6) AS level_price FROM lv")
    def _(s, sf):
        return L.explode_levels(parts(s, sf)[2]).select("symbol", "block_label", "block_start", "available_at", "level_id", "level_price")

    @cat.add("g02_available_levels", LEVELS + f" SELECT symbol, {ep('block_start')} AS block_start, {ep('block_end')} AS available_at, CASE WHEN close > open THEN 'BULLISH' WHEN close < open THEN 'BEARISH' ELSE 'FLAT' END AS direction FROM bl WHERE block_end <= TIMESTAMP '2024-01-20 00:00:00'")
    def _(s, sf):
        return L.available_levels(parts(s, sf)[2], "2024-01-20 00:00:00").select("symbol", "block_start", "available_at", "direction")

    @cat.add("g03_level_history", LEVELS + f" SELECT symbol, {ep('block_start')} AS block_start, level_id, bars_observed, touched_bars, first_touch, last_touch, (first_touch * 60)::DOUBLE AS minutes_to_first_touch FROM pl JOIN hi USING (symbol, seg, block_start, level_id)")
    def _(s, sf):
        b, p, i, placed, contacts = parts(s, sf)
        return L.level_history(placed, contacts, H1).select("symbol", "block_start", "level_id", "bars_observed", "touched_bars", "first_touch", "last_touch", "minutes_to_first_touch")

    @cat.add("g04_level_runs", LEVELS + f" SELECT symbol, {ep('block_start')} AS block_start, level_id, run_index::BIGINT AS run_index, state, run_pos - start_pos AS first_index, bar_count FROM rw")
    def _(s, sf):
        b, p, i, placed, contacts = parts(s, sf)
        return L.level_runs(placed, contacts).select("symbol", "block_start", "level_id", "run_index", "state", "first_index", "bar_count")

    @cat.add("g05_touch_episodes", LEVELS + f" SELECT symbol, {ep('block_start')} AS block_start, level_id, pattern_index AS episode, run_pos - start_pos AS first_index, bar_count, (60 * (run_pos - start_pos))::DOUBLE AS minutes_to_touch FROM pt")
    def _(s, sf):
        b, p, i, placed, contacts = parts(s, sf)
        return L.touch_patterns(L.level_runs(placed, contacts), H1).select(
            "symbol", "block_start", "level_id", C("pattern_index").alias("episode"), "first_index", "bar_count", "minutes_to_touch")

    @cat.add("g06_touch_patterns", LEVELS + f" SELECT symbol, {ep('block_start')} AS block_start, level_id, pattern_index, pattern_code, prev_count, next_count, CASE WHEN prev_state IS NOT NULL AND next_state IS NOT NULL THEN prev_state = next_state END AS same_side, CASE WHEN prev_state IS NOT NULL AND next_state IS NOT NULL THEN prev_state <> next_state END AS opposite_side FROM pt")
    def _(s, sf):
        b, p, i, placed, contacts = parts(s, sf)
        return L.touch_patterns(L.level_runs(placed, contacts), H1).select(
            "symbol", "block_start", "level_id", "pattern_index", "pattern_code", "prev_count", "next_count", "same_side", "opposite_side")

    @cat.add("g07_sweep_reclaim", LEVELS + " SELECT pattern_code, sweep, reclaim, count(*) AS n FROM sw GROUP BY 1, 2, 3")
    def _(s, sf):
        b, p, i, placed, contacts = parts(s, sf)
        return L.touch_patterns(L.level_runs(placed, contacts), H1).groupBy("pattern_code", "sweep", "reclaim").agg(F.count("*").alias("n"))

    @cat.add("g08_touch_anchors", LEVELS + f" SELECT an.symbol, {ep('p.ts')} + 3600 AS evidence_ts, level_id, {ep('block_start')} AS block_start, pattern_index, p.close AS reference FROM an JOIN p USING (symbol, seg, pos) WHERE anchor_kind = 'TOUCH_TRANSITION'")
    def _(s, sf):
        b, p, i, placed, contacts = parts(s, sf)
        a = L.touch_anchors(L.touch_patterns(L.level_runs(placed, contacts), H1))
        return a.join(p.select("symbol", "seg", "pos", "ts", "close"), ["symbol", "seg", "pos"]).select(
            "symbol", (F.unix_seconds("ts") + H1).alias("evidence_ts"), "level_id", "block_start", "pattern_index", C("close").alias("reference"))

    @cat.add("g09_untouched_anchors", LEVELS + f" SELECT an.symbol, {ep('p.ts')} + 3600 AS evidence_ts, level_id, {ep('block_start')} AS block_start, checkpoint_bars, p.close AS reference FROM an JOIN p USING (symbol, seg, pos) WHERE anchor_kind = 'UNTOUCHED_CHECKPOINT'")
    def _(s, sf):
        b, p, i, placed, contacts = parts(s, sf)
        a = L.untouched_anchors(L.level_history(placed, contacts, H1))
        return a.join(p.select("symbol", "seg", "pos", "ts", "close"), ["symbol", "seg", "pos"]).select(
            "symbol", (F.unix_seconds("ts") + H1).alias("evidence_ts"), "level_id", "block_start", "checkpoint_bars", C("close").alias("reference"))

    @cat.add("g10_forward_outcomes", "WITH " + indexed_sql(M15) + " " + " UNION ALL ".join(
        f"SELECT symbol, {ep('ts')} AS ts, {h} AS horizon, " + ", ".join(f"{v} AS {k}" for k, v in outcome_sql(h).items()) + " FROM x" for h in O.HORIZONS))
    def _(s, sf):
        d = O.forward_outcomes(indexed(s, sf, M15), chunk_rows=CHUNK)
        item = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), C(f"h{h}").alias("o")) for h in O.HORIZONS]))
        return d.select("symbol", "ts", item.alias("i")).select("symbol", "ts", "i.horizon", *[C(f"i.o.{f}").alias(f) for f in O.OUTCOME_FIELDS])

    def future(h):
        f = f"(PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        w = "(PARTITION BY symbol, seg ORDER BY pos)"
        ok = f"lead(pos, {h}) OVER {w} IS NOT NULL"
        g = lambda x: f"CASE WHEN {ok} THEN {x} END"
        move = f"lead(close, {h}) OVER {w} - close"
        return (f"SELECT symbol, {ep('ts')} AS ts, {h} AS horizon, CASE WHEN NOT ({ok}) THEN CASE WHEN seg < max(seg) OVER (PARTITION BY symbol) THEN 'gap_or_segment_boundary' ELSE 'end_of_data' END END AS exclusion, "
                f"round({g(f'lead(close, {h}) OVER {w} / close - 1')}, 6) AS signed_return, round({g(f'abs(lead(close, {h}) OVER {w} / close - 1)')}, 6) AS absolute_return, "
                f"round({g(f'max(high) OVER {f} - close')}, 6) AS mfe_up, round({g(f'close - min(low) OVER {f}')}, 6) AS mae_down, round({g(f'sqrt(sum(ls * ls) OVER {f})')}, 6) AS realized_volatility, "
                f"round({g(move)}, 6) AS close_change, {g(f'''CASE WHEN {move} > 0 THEN 'UP' WHEN {move} < 0 THEN 'DOWN' ELSE 'FLAT' END''')} AS direction FROM y")

    FUT = f"WITH {indexed_sql(M15)}, y AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol, seg ORDER BY pos)) AS ls FROM x) "

    @cat.add("g11_future_windows", FUT + " UNION ALL ".join(future(h) for h in O.FUTURE_HORIZONS))
    def _(s, sf):
        d = O.future_windows(indexed(s, sf, M15), chunk_rows=CHUNK)
        return d.select("symbol", "ts", "horizon", "exclusion", "signed_return", "absolute_return", "mfe_up", "mae_down", "realized_volatility", "close_change", "direction")

    def trans(h):
        w = "(PARTITION BY symbol, seg ORDER BY pos)"
        f = f"(PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        return f"""SELECT symbol, {ep('ts')} AS ts, {h} AS horizon, state, exclusion, CASE WHEN exclusion IS NULL THEN len(o) > 0 END AS transition, CASE WHEN exclusion IS NULL THEN o[1] END AS destination FROM (
          SELECT *, list_filter(l, lambda v: v <> state) AS o FROM (SELECT *, list(state) OVER {f} AS l, CASE WHEN lead(pos, {h}) OVER {w} IS NULL THEN
          CASE WHEN seg < max(seg) OVER (PARTITION BY symbol) THEN 'gap_or_segment_boundary' ELSE 'insufficient_future_observations' END END AS exclusion FROM s))"""

    @cat.add("g12_transition_outcomes", f"WITH {STATES} " + " UNION ALL ".join(trans(h) for h in O.FUTURE_HORIZONS))
    def _(s, sf):
        return O.transition_outcomes(states(s, sf), chunk_rows=CHUNK).select("symbol", "ts", "horizon", C("state").cast("bigint"), "exclusion", "transition", C("destination").cast("bigint"))

    def table(s, sf):
        return staged_levels(s, sf, "event_table", lambda: T.build_event_table(indexed(s, sf), H1, chunk_rows=CHUNK))

    cols = {"symbol": "meta.symbol", "evidence_ts": "meta.evidence_end_utc", "block_start": "meta.source_block_start_utc", "level_id": "x.geometry.level_id",
            "anchor_kind": "x.anchor_kind", "pattern_index": "meta.pattern_index", "checkpoint_bars": "x.event.checkpoint_bars"}
    key = "an.symbol, %s + 3600 AS evidence_ts, %s AS block_start, level_id, anchor_kind, pattern_index, checkpoint_bars" % (ep("x.ts"), ep("an.block_start"))

    @cat.add("g14_project_row", LEVELS + f", oc AS (SELECT symbol, seg, pos, " + ", ".join(f"{v} AS h{h}_{k}" for h in (1, 32) for k, v in outcome_sql(h).items()) + f" FROM x) SELECT {key}, round(level_price, 6) AS level_price, close AS reference_price, block_label, block_index, pattern_code, "
             + ", ".join(f"h{h}_{k}" for h in (1, 32) for k in O.OUTCOME_FIELDS) + " FROM an JOIN x USING (symbol, seg, pos) JOIN oc USING (symbol, seg, pos)")
    def _(s, sf):
        more = {"level_price": "meta.level_price", "reference_price": "meta.reference_price", "block_label": "x.geometry.source_block_label",
                "block_index": "x.geometry.source_block_index", "pattern_code": "x.event.pattern_code",
                **{f"h{h}_{k}": f"y.h{h}.{k}" for h in (1, 32) for k in O.OUTCOME_FIELDS}}
        return table(s, sf).select(*[C(f"`{v}`").alias(k) for k, v in {**cols, **more}.items()])

    d1 = """dn AS (SELECT *, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS date) AS d FROM x), dd AS (
        SELECT symbol, seg, d, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM dn GROUP BY 1, 2, 3 HAVING count(*) = 24), dx AS (
        SELECT symbol, seg, pos, CAST(((ts + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS date) - 1 AS d FROM x)"""

    @cat.add("g15_project_context", LEVELS + f", {d1} SELECT {key}, o AS prev_open, h AS prev_high, l AS prev_low, c AS prev_close, round(h - l, 6) AS prev_range, round(x.close - (h + l) / 2, 6) AS mid_distance, dd.o IS NOT NULL AS available, "
             "round(greatest(0.0, x.high - h), 6) AS high_penetration_above, sweep, reclaim, CASE WHEN x.close > x.open THEN 'BULLISH' WHEN x.close < x.open THEN 'BEARISH' ELSE 'FLAT' END AS shape, round((x.high - x.low) / x.close, 6) AS range_fraction "
             "FROM an JOIN x USING (symbol, seg, pos) JOIN dx USING (symbol, seg, pos) LEFT JOIN dd USING (symbol, seg, d)".replace("round(greatest(0.0, x.high - h), 6)", "round(CASE WHEN h IS NOT NULL THEN greatest(0.0, x.high - h) END, 6)"))
    def _(s, sf):
        p = "x.daily.previous."
        more = {**{f"prev_{k}": p + k for k in ("open", "high", "low", "close", "range")}, "mid_distance": p + "level.midpoint.close_distance_price", "available": p + "available",
                "high_penetration_above": p + "level.high.penetration_above_price", "sweep": "x.level_transition.sweep", "reclaim": "x.level_transition.reclaim",
                "shape": "x.base.direction", "range_fraction": "x.base.range_fraction"}
        return table(s, sf).select(*[C(f"`{v}`").alias(k) for k, v in {**cols, **more}.items()])

    @cat.add("g16_event_table", LEVELS + " SELECT symbol, anchor_kind, pattern_code, checkpoint_bars, level_id, count(*) AS events, count(DISTINCT pos) AS evidence_bars FROM an GROUP BY ALL")
    def _(s, sf):
        t = T.build_event_table(indexed(s, sf), H1, chunk_rows=CHUNK)
        return t.groupBy(C("`meta.symbol`").alias("symbol"), C("`x.anchor_kind`").alias("anchor_kind"), C("`x.event.pattern_code`").alias("pattern_code"),
                         C("`x.event.checkpoint_bars`").alias("checkpoint_bars"), C("`x.geometry.level_id`").alias("level_id")).agg(
            F.count("*").alias("events"), F.countDistinct("`meta.evidence_end_utc`").alias("evidence_bars"))

    @cat.add("g13_market_context", swing_sql(H1) + "," + LEVELS.split("WITH RECURSIVE ", 1)[1].split(", p AS (", 1)[1].replace("SELECT * FROM (SELECT *, lead", "SELECT * FROM (SELECT *, lead", 1).join([" p AS (", ""]).replace("), sw AS (", "), swp AS (").replace("FROM sw WHERE next_pos", "FROM swp WHERE next_pos")
             + f""", sh AS (SELECT * FROM sc WHERE kind = 'HIGH'), so AS (SELECT * FROM sc WHERE kind = 'LOW')
        SELECT {key}, sweep, reclaim, lh.label AS high_label, ll.label AS low_label, x.pos - lh.confirm_pos AS high_age, coalesce(lh.rising, 0) AS higher_high_count
        FROM an JOIN x USING (symbol, seg, pos) ASOF LEFT JOIN sh lh ON lh.symbol = an.symbol AND lh.seg = an.seg AND lh.confirm_pos <= x.pos ASOF LEFT JOIN so ll ON ll.symbol = an.symbol AND ll.seg = an.seg AND ll.confirm_pos <= x.pos""")
    def _(s, sf):
        m = "x.market.m15."
        more = {"sweep": "x.level_transition.sweep", "reclaim": "x.level_transition.reclaim", "high_label": m + "swing.high.label", "low_label": m + "swing.low.label",
                "high_age": m + "swing.high.bars_since_confirmation", "higher_high_count": m + "structure.higher_high_count"}
        return table(s, sf).select(*[C(f"`{v}`").alias(k) for k, v in {**cols, **more}.items()])
    cat.event_table = table

    @cat.add("d04_observe_level", LEVELS + f""" SELECT symbol, {ep('block_start')} AS block_start, level_id, {ep('ts')} AS ts, CASE WHEN open > level_price THEN 'ABOVE' WHEN open < level_price THEN 'BELOW' ELSE 'AT' END AS open_position,
        CASE WHEN close > level_price THEN 'ABOVE' WHEN close < level_price THEN 'BELOW' ELSE 'AT' END AS close_position, least(open, close) <= level_price AND level_price <= greatest(open, close) AS body_touched,
        high > level_price AS traded_above, low < level_price AS traded_below, high > level_price AND low < level_price AS straddled, (open > level_price AND close < level_price) OR (open < level_price AND close > level_price) AS body_crossed,
        NOT (least(open, close) <= level_price AND level_price <= greatest(open, close)) AS wick_only FROM ob WHERE state = 'TOUCH'""")
    def _(s, sf):
        b, p, i, placed, contacts = parts(s, sf)
        return L.observe_contacts(placed, contacts, p).select("symbol", "block_start", "level_id", "ts", "open_position", "close_position", "body_touched",
                                                              "traded_above", "traded_below", "straddled", "body_crossed", "wick_only")
