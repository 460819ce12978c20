"""Group H (cohorts, states, bootstraps) and E23-E24."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import CHUNK, H1, M15, STATES, TRADES, ep, indexed, indexed_sql, staged, states, table, trades
from barloom.functions.scalars import MIX_A, MIX_B, MIX_C, MIX_P, MIX_ROUNDS, mix_start
from barloom.operators import ledger as G, outcomes as O, resample as R, stats as S, windows as X

C = F.col
Q = lambda x, p: f"round(quantile_cont({x}, {p}), 6)"


def mix_sql(seed, *parts):
    y = f"((acc * {MIX_B} + (p % {MIX_P}) * {MIX_C} + 1) % {MIX_P})"
    items = ", ".join(f"CAST({x} AS BIGINT)" for x in (mix_start(seed), *parts, *MIX_ROUNDS))
    return f"(list_reduce([{items}], lambda acc, p: ({y} * {y} + {MIX_A}) % {MIX_P}) * {MIX_B} % {MIX_P})"


# lineitem as an event table: two event kinds, categorical and binned conditions, two targets
EV = """ev AS (SELECT l_linestatus AS event, l_returnflag AS flag, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber % 3 END AS grp, CASE WHEN l_tax < 0.04 THEN NULL ELSE l_quantity END AS t1, round(l_extendedprice / 1000) AS t2, l_discount AS disc, year(l_shipdate) AS y FROM lineitem)"""


def ev(s, sf):
    l = table(s, sf, "lineitem")
    return l.select(C("l_linestatus").alias("event"), C("l_returnflag").alias("flag"), F.when(C("l_linenumber") % 4 == 0, None).otherwise(C("l_linenumber") % 3).alias("grp"),
                    F.when(C("l_tax") < 0.04, None).otherwise(C("l_quantity")).alias("t1"), F.round(C("l_extendedprice") / 1000).alias("t2"),
                    C("l_discount").alias("disc"), F.year("l_shipdate").alias("y"))


DIST = lambda v: f"""count(*) AS n, count({v}) AS observed, count(*) - count({v}) AS missing, round(min({v}), 6) AS minimum, round(max({v}), 6) AS maximum, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS standard_deviation,
   {Q(v, .25)} AS q25, {Q(v, .5)} AS median, {Q(v, .75)} AS q75, count(*) FILTER ({v} < 0) AS negative_count, count(*) FILTER ({v} = 0) AS zero_count, count(*) FILTER ({v} > 0) AS positive_count,
   round(count(*) FILTER ({v} < 0) / count({v}), 6) AS negative_fraction, round(count(*) FILTER ({v} = 0) / count({v}), 6) AS zero_fraction, round(count(*) FILTER ({v} > 0) / count({v}), 6) AS positive_fraction"""

# value tables give pair counts: left rows times right rows below
CMP = """{name} AS (SELECT {by}, value, sum(l) AS l, sum(r) AS r FROM {src} WHERE value IS NOT NULL GROUP BY {by}, value), {name}_c AS (SELECT *, coalesce(sum(r) OVER (PARTITION BY {by} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ltr FROM {name}), {name}_p AS (
  SELECT {by}, sum(l * ltr) AS gt, sum(l * r) AS tie, sum(l) AS nl, sum(r) AS nr, sum(l * value) / nullif(sum(l), 0) AS ml, sum(r * value) / nullif(sum(r), 0) AS mr FROM {name}_c GROUP BY {by}), {name}_m AS (
  SELECT {by}, quantile_cont(value, 0.5) FILTER (l = 1) AS dl, quantile_cont(value, 0.5) FILTER (r = 1) AS dr, CAST(sum(l) AS BIGINT) AS lrows, CAST(sum(r) AS BIGINT) AS rrows FROM {src} GROUP BY {by})"""
CMP_SEL = """nl::BIGINT AS left_observed, nr::BIGINT AS right_observed, lrows AS left_rows, rrows AS right_rows, round(ml, 6) AS left_mean, round(mr, 6) AS right_mean, round(dl, 6) AS left_median, round(dr, 6) AS right_median, (nl * nr)::DOUBLE AS pair_count, gt::DOUBLE AS greater, tie::DOUBLE AS ties,
  (nl * nr - gt - tie)::DOUBLE AS less, round(ml - mr, 6) AS mean_difference, round(dl - dr, 6) AS median_difference, round((gt + 0.5 * tie) / nullif(nl * nr, 0), 6) AS superiority, round((2 * gt + tie - nl * nr) / nullif(nl * nr, 0), 6) AS cliffs_delta"""

SINGLE = f"""WITH {EV}, lg AS (SELECT event, target, value, field, cond FROM (SELECT event, unnest([{{'target': 't1', 'value': t1}}, {{'target': 't2', 'value': t2}}], recursive := true), flag, grp FROM ev), LATERAL (SELECT 'flag' AS field, '["string","' || flag || '"]' AS cond UNION ALL SELECT 'grp', CASE WHEN grp IS NULL THEN 'null' ELSE '["int","' || grp || '"]' END)),
 mn AS (SELECT DISTINCT event, field, cond AS of FROM lg), sp AS (SELECT lg.event, lg.field, lg.target, mn.of AS cond, value, CASE WHEN lg.cond = mn.of THEN 1 ELSE 0 END AS l, CASE WHEN lg.cond = mn.of THEN 0 ELSE 1 END AS r FROM lg JOIN mn ON mn.event = lg.event AND mn.field = lg.field), {CMP.format(name='v', by='event, field, cond, target', src='sp')}"""

PAIRS = f"""WITH {EV}, lg AS (SELECT event, unnest([{{'target': 't1', 'value': t1}}, {{'target': 't2', 'value': t2}}], recursive := true), '["string","' || flag || '"]' AS a, CASE WHEN grp IS NULL THEN 'null' ELSE '["int","' || grp || '"]' END AS b FROM ev),
 mn AS (SELECT DISTINCT event, a AS oa, b AS ob FROM lg), sp AS (SELECT lg.event, target, value, oa, ob, versus, CASE WHEN a = oa AND b = ob THEN 1 ELSE 0 END AS l, CASE WHEN a = oa AND b = ob THEN 0 ELSE 1 END AS r FROM lg JOIN mn ON mn.event = lg.event, (VALUES ('EVENT'), ('LEFT'), ('RIGHT')) q(versus)
   WHERE versus = 'EVENT' OR (versus = 'LEFT' AND a = oa) OR (versus = 'RIGHT' AND b = ob)), {CMP.format(name='v', by='event, oa, ob, target, versus', src='sp')}"""


def linked(s, sf):
    return staged(s, sf, "linked_states", lambda: S.with_previous_state(states(s, sf), H1, chunk_rows=CHUNK))


LINK = f"""{STATES}, lk AS (SELECT *, lag(state) OVER w AS p, coalesce(epoch(ts) - epoch(lag(ts) OVER w) = 3600 AND seg = lag(seg) OVER w, false) AS connected FROM s WINDOW w AS (PARTITION BY symbol ORDER BY pos)), lm AS (
 SELECT *, CASE WHEN connected THEN p END AS previous_state, CASE WHEN connected THEN 0 ELSE 1 END AS nb, CASE WHEN connected AND p = state THEN 0 ELSE 1 END AS nr FROM lk), ln AS (
 SELECT *, sum(nb) OVER (PARTITION BY symbol ORDER BY pos) AS blk, sum(nr) OVER (PARTITION BY symbol ORDER BY pos) AS run FROM lm), z AS (
 SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY pos) AS age, min(run) OVER (PARTITION BY symbol, blk) AS run0 FROM ln)"""


def outcome_trades(s, sf):
    """Closed trades with state 0..2 by quantity, profit, outcome and timestamps."""
    l = table(s, sf, "lineitem")
    return trades(s, sf).filter("status = 'CLOSED' and net_r <> 0").withColumns({
        "profit": C("net_r"), "outcome": F.when(C("net_r") > 0, "WIN").otherwise("LOSS"), "state": F.when(C("symbol") == "A", 0).when(C("symbol") == "N", 1).otherwise(2),
        "hold": F.datediff("exit_ts", "entry_ts"), "year": F.year("entry_ts")})


OT = f"{TRADES}, ot AS (SELECT *, net_r AS profit, CASE WHEN net_r > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome, CASE symbol WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS state, exit_ts - entry_ts AS hold, year(entry_ts) AS year FROM t WHERE status = 'CLOSED' AND net_r <> 0)"


def register(cat):
    @cat.add("e23_state_age", f"WITH {LINK} SELECT symbol, {ep('ts')} AS ts, state, previous_state, connected, age AS state_age, CASE WHEN run > run0 THEN age - 1 END AS bars_since_transition FROM z")
    def _(s, sf): return linked(s, sf).select("symbol", "ts", "state", "previous_state", "connected", "state_age", "bars_since_transition")

    RUNS = f"WITH {LINK}, rn AS (SELECT symbol, run, state, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS length FROM z GROUP BY 1, 2, 3)"

    @cat.add("e24_runs", f"{RUNS} SELECT symbol, state, {ep('first_ts')} AS first_ts, {ep('last_ts')} AS last_ts, length FROM rn")
    def _(s, sf): return S.runs_of(linked(s, sf)).drop("run_start")

    @cat.add("h01_outcome_distribution", f"WITH {EV} " + " UNION ALL ".join(f"SELECT '{t}' AS target, {DIST(t)} FROM ev" for t in ("t1", "t2")))
    def _(s, sf): return S.outcome_distribution(S.unpivot_targets(ev(s, sf), [], ["t1", "t2"]), ["target"], "value")

    @cat.add("h02_event_cohorts", "WITH e AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'TOUCH|' || l_returnflag ELSE 'UNTOUCHED|' || l_linenumber END AS cohort, l_quantity FROM lineitem) SELECT cohort, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM e GROUP BY 1")
    def _(s, sf):
        even = C("l_linenumber") % 2 == 0
        key = S.event_cohort(F.when(even, "TOUCH_TRANSITION").otherwise("UNTOUCHED_CHECKPOINT"), F.when(even, C("l_returnflag")), F.when(~even, C("l_linenumber")))
        return table(s, sf, "lineitem").groupBy(key.alias("cohort")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))

    @cat.add("h03_conditioned_cohorts", f"WITH {EV} SELECT event, flag, grp, {DIST('t1')} FROM ev GROUP BY 1, 2, 3")
    def _(s, sf): return S.conditioned_cohorts(ev(s, sf), "event", ["flag", "grp"], "t1")

    @cat.add("h04_numeric_bins", f"WITH {EV}, b AS (SELECT *, CASE WHEN t1 IS NULL THEN -1 WHEN t1 < 10 THEN 0 WHEN t1 < 25 THEN 1 WHEN t1 < 40 THEN 2 ELSE 3 END AS bin_index FROM ev) SELECT event, bin_index, t1 IS NULL AS missing, CASE bin_index WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 25.0 WHEN 3 THEN 40.0 END AS lower_bound, CASE bin_index WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 25.0 WHEN 2 THEN 40.0 END AS upper_bound, count(*) AS n, round(avg(t2), 6) AS mean_t2 FROM b GROUP BY 1, 2, 3")
    def _(s, sf):
        b = ev(s, sf).withColumns(S.numeric_bins("t1", [10, 25, 40]))
        return b.groupBy("event", "bin_index", "missing", "lower_bound", "upper_bound").agg(F.count("*").alias("n"), F.avg("t2").alias("mean_t2"))

    @cat.add("h05_cohort_compare", f"WITH {EV}, sp AS (SELECT event, t1 AS value, CASE WHEN disc > 0.05 THEN 1 ELSE 0 END AS l, CASE WHEN disc > 0.05 THEN 0 ELSE 1 END AS r FROM ev), {CMP.format(name='v', by='event', src='sp')} SELECT event, {CMP_SEL} FROM v_p JOIN v_m USING (event)")
    def _(s, sf): return S.compare_cohorts(ev(s, sf), ["event"], C("disc") > 0.05, "t1")

    @cat.add("h06_scan_single", f"{SINGLE} SELECT event, field, cond, target, {CMP_SEL} FROM v_p JOIN v_m USING (event, field, cond, target) WHERE rrows > 0")
    def _(s, sf): return S.scan_single(ev(s, sf), "event", ["flag", "grp"], ["t1", "t2"])

    @cat.add("h07_scan_pairs", f"{PAIRS} SELECT event, 'flag' AS f, 'grp' AS g, oa AS a, ob AS b, target, versus, {CMP_SEL} FROM v_p JOIN v_m USING (event, oa, ob, target, versus) WHERE rrows > 0")
    def _(s, sf): return S.scan_pairs(ev(s, sf), "event", ["flag", "grp"], ["t1", "t2"])

    @cat.add("h08_rank_candidates", f"""{SINGLE}, sc AS (SELECT 'SINGLE' AS kind, event, target, field || '=' || cond AS condition, abs((2 * gt + tie - nl * nr) / nullif(nl * nr, 0)) AS score, nl * nr AS pc, least(nl, nr) AS mo FROM v_p JOIN v_m USING (event, field, cond, target) WHERE rrows > 0 AND lrows >= 50)
        SELECT kind, event, target, condition, round(score, 6) AS score, pc::DOUBLE AS min_pairs, mo::BIGINT AS min_observed FROM sc ORDER BY round(score, 12) DESC, pc DESC, mo DESC, event, target, condition LIMIT 20""")
    def _(s, sf): return S.rank_candidates(S.scan_single(ev(s, sf), "event", ["flag", "grp"], ["t1", "t2"]), top_k=20, minimum_rows=50)

    @cat.add("h08_rank_interactions", f"""{PAIRS}, c AS (SELECT event, target, oa, ob, count(DISTINCT versus) AS k, min(abs((2 * gt + tie - nl * nr) / nullif(nl * nr, 0))) AS score, min(nl * nr) AS pc, min(least(nl, nr)) AS mo FROM v_p JOIN v_m USING (event, oa, ob, target, versus) WHERE rrows > 0 GROUP BY 1, 2, 3, 4)
        SELECT 'INTERACTION' AS kind, event, target, 'flag=' || oa || '&grp=' || ob AS condition, round(score, 6) AS score, pc::DOUBLE AS min_pairs, mo::BIGINT AS min_observed FROM c WHERE k = 3""")
    def _(s, sf):
        d = ev(s, sf)
        return S.rank_candidates(S.scan_single(d, "event", ["flag", "grp"], ["t1", "t2"]), S.scan_pairs(d, "event", ["flag", "grp"], ["t1", "t2"])).filter("kind = 'INTERACTION'")

    @cat.add("h09_state_profile", f"WITH {STATES}, n AS (SELECT state, count(*) AS rows, count(*) / sum(count(*)) OVER () AS occ FROM s GROUP BY 1) " + " UNION ALL ".join(f"SELECT state, '{f}' AS feature, round(avg({f}), 6) AS mean, {Q(f, .5)} AS median, {Q(f, .1)} AS p10, {Q(f, .9)} AS p90, any_value(rows) AS rows, round(any_value(occ), 6) AS occupancy FROM s JOIN n USING (state) GROUP BY 1" for f in ("er", "close")))
    def _(s, sf): return S.state_profile(states(s, sf), "state", ["er", "close"])

    @cat.add("h10_yearly_occupancy", f"WITH {OT} SELECT year AS period, count(*) FILTER (state = 0) AS state_0, count(*) FILTER (state = 1) AS state_1, count(*) FILTER (state = 2) AS state_2, count(*) FILTER (state = 3) AS state_3, count(*) AS rows FROM ot GROUP BY 1")
    def _(s, sf): return S.yearly_occupancy(outcome_trades(s, sf), "state", [0, 1, 2, 3], C("year"))

    MAT = f"WITH {LINK}, m AS (SELECT previous_state AS from_state, state AS to_state, count(*) AS n FROM z WHERE connected GROUP BY 1, 2), mp AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS probability FROM m)"

    @cat.add("h11_transition_matrix", f"{MAT} SELECT from_state, to_state, n, round(probability, 6) AS probability FROM mp")
    def _(s, sf): return S.transition_matrix(linked(s, sf))

    @cat.add("h12_run_length_stats", f"{MAT}, rn AS (SELECT symbol, run, state, count(*) AS length FROM z GROUP BY 1, 2, 3) SELECT rn.state, count(*) AS runs, round(avg(length), 6) AS mean, {Q('length', .5)} AS median, {Q('length', .9)} AS p90, max(length)::DOUBLE AS maximum, round(avg(length) * 60, 6) AS mean_minutes, round(any_value(probability), 6) AS self_transition FROM rn LEFT JOIN mp ON mp.from_state = rn.state AND mp.to_state = rn.state GROUP BY 1")
    def _(s, sf): return S.run_length_stats(S.runs_of(linked(s, sf)), S.transition_matrix(linked(s, sf)), 60)

    EFF = lambda src, by, v: f"SELECT {by}, a.g AS a, b.g AS b, a.n AS a_n, b.n AS b_n, round(a.m - b.m, 6) AS mean_difference, round(a.d - b.d, 6) AS median_difference, round(CASE WHEN a.n >= 2 AND b.n >= 2 AND pooled > 0 THEN (a.m - b.m) / sqrt(pooled) END, 6) AS cohens_d FROM {src} a JOIN {src} b USING ({by}) , LATERAL (SELECT ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled) WHERE a.g < b.g"

    @cat.add("h13_pairwise_effects", f"WITH {EV}, g AS (SELECT event, flag AS g, count(t1) AS n, avg(t1) AS m, var_samp(t1) AS v, quantile_cont(t1, 0.5) AS d FROM ev GROUP BY 1, 2) " + EFF("g", "event", "t1"))
    def _(s, sf): return S.pairwise_effects(ev(s, sf), ["event"], "flag", "t1")

    metrics = ["signed_return", "absolute_return", "mfe_up", "mae_down", "realized_volatility", "close_change"]

    def future(s, sf):
        return staged(s, sf, "future_states", lambda: O.future_windows(states(s, sf), chunk_rows=CHUNK))

    def fsql(h):
        f = f"(PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        w = "(PARTITION BY symbol, seg ORDER BY pos)"
        return f"SELECT state, {h} AS horizon, lead(close, {h}) OVER {w} / close - 1 AS signed_return, abs(lead(close, {h}) OVER {w} / close - 1) AS absolute_return, max(high) OVER {f} - close AS mfe_up, close - min(low) OVER {f} AS mae_down, sqrt(sum(ls * ls) OVER {f}) AS realized_volatility, lead(close, {h}) OVER {w} - close AS close_change, lead(pos, {h}) OVER {w} IS NOT NULL AS ok FROM y"

    FUT = f"WITH {STATES}, y AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol, seg ORDER BY pos)) AS ls FROM s), fw AS (" + " UNION ALL ".join(fsql(h) for h in O.FUTURE_HORIZONS) + "), fl AS (" + " UNION ALL ".join(f"SELECT state, horizon, '{m}' AS metric, {m} AS v FROM fw WHERE ok" for m in metrics) + ")"

    @cat.add("h14_state_future_summary", FUT + f" SELECT state, horizon, metric, count(v) AS observed, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS standard_deviation, {Q('v', .1)} AS p10, {Q('v', .25)} AS p25, {Q('v', .5)} AS median, {Q('v', .75)} AS p75, {Q('v', .9)} AS p90 FROM fl GROUP BY 1, 2, 3")
    def _(s, sf): return S.future_summary(future(s, sf), ["state", "horizon"], metrics)

    @cat.add("h14_direction_counts", FUT + " SELECT state, horizon, count(*) AS n, count(*) FILTER (close_change > 0) AS up, count(*) FILTER (close_change < 0) AS down, count(*) FILTER (close_change = 0) AS flat, round(count(*) FILTER (close_change > 0) / count(*), 6) AS up_fraction, round(count(*) FILTER (close_change < 0) / count(*), 6) AS down_fraction, round(count(*) FILTER (close_change = 0) / count(*), 6) AS flat_fraction FROM fw WHERE ok GROUP BY 1, 2")
    def _(s, sf): return S.direction_counts(future(s, sf), ["state", "horizon"])

    @cat.add("h15_hypothesis_check", FUT + ", m AS (SELECT horizon, metric, avg(v) FILTER (state = 0) AS m0, avg(v) FILTER (state = 1) AS m1, avg(v) FILTER (state = 2) AS m2 FROM fl WHERE metric IN ('absolute_return', 'realized_volatility') GROUP BY 1, 2) SELECT horizon, metric, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, CASE WHEN m0 > m1 AND m0 > m2 THEN 'YES' ELSE 'NO' END AS criterion, m0 IS NULL OR m1 IS NULL OR m2 IS NULL AS insufficient_evidence FROM m")
    def _(s, sf): return S.hypothesis_check(S.future_summary(future(s, sf), ["state", "horizon"], metrics), ["absolute_return", "realized_volatility"])

    @cat.add("h15_effect_ratios")
    def _(s, sf):
        w = S.unpivot_targets(future(s, sf).filter("exclusion is null"), ["horizon", "state"], metrics).withColumnRenamed("target", "metric")
        return S.effect_ratios(S.pairwise_effects(w, ["horizon", "metric"], "state", "value"))

    def trans(s, sf):
        return staged(s, sf, "transitions", lambda: O.transition_outcomes(linked(s, sf), step=H1, chunk_rows=CHUNK))

    def tsql(h):
        w = "(PARTITION BY symbol, seg ORDER BY pos)"
        f = f"(PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        return f"SELECT symbol, seg, blk, ts, state, er, age, horizon, ex, CASE WHEN ex IS NULL THEN len(o) > 0 END AS tr, CASE WHEN ex IS NULL THEN o[1] END AS dest FROM (SELECT *, {h} AS horizon, list_filter(l, lambda v: v <> state) AS o FROM (SELECT *, list(state) OVER {f} AS l, CASE WHEN lead(pos, {h}) OVER {w} IS NULL THEN CASE WHEN seg < max(seg) OVER (PARTITION BY symbol) THEN 'g' ELSE 'i' END END AS ex FROM z))"

    TR = f"WITH {LINK}, tw AS (" + " UNION ALL ".join(tsql(h) for h in O.FUTURE_HORIZONS) + "), ts AS (SELECT *, unnest(['ALL', state::VARCHAR]) AS scope FROM tw)"

    @cat.add("h16_transition_study", TR + " SELECT horizon, scope, count(*) FILTER (NOT tr) AS n_stay, count(*) FILTER (tr) AS n_transition, round(count(*) FILTER (tr) / nullif(count(tr), 0), 6) AS probability, " + ", ".join(f"round(count(*) FILTER (dest = {x}) / nullif(count(*) FILTER (tr), 0), 6) AS fraction_{x}" for x in range(3)) + ", count(*) FILTER (ex = 'g') AS gap_or_segment_boundary, count(*) FILTER (ex = 'i') AS insufficient_future_observations, 0::BIGINT AS period_end_boundary FROM ts GROUP BY 1, 2")
    def _(s, sf): return S.transition_study(trans(s, sf))

    @cat.add("h16_transition_comparisons", TR + ", q AS (SELECT horizon, scope, tr, unnest([{'target': 'er', 'value': er}, {'target': 'state_age', 'value': age::DOUBLE}], recursive := true) FROM ts WHERE tr IS NOT NULL), k AS (SELECT horizon, scope, target, CASE WHEN tr THEN 0 ELSE 1 END AS g, count(value) AS n, avg(value) AS m, var_samp(value) AS v, quantile_cont(value, 0.5) AS d FROM q GROUP BY 1, 2, 3, 4) SELECT * EXCLUDE (a, b) FROM (" + EFF("k", "horizon, scope, target", "v") + ")")
    def _(s, sf): return S.transition_comparisons(trans(s, sf), ["er", "state_age"])

    B = 2000

    LIM = lambda n, q, k: f"CASE WHEN contributing_blocks >= 2 AND {n} >= 2 THEN round({q}[1], 5) END AS {k}_low, CASE WHEN contributing_blocks >= 2 AND {n} >= 2 THEN round({q}[2], 5) END AS {k}_high, CASE WHEN contributing_blocks >= 2 THEN coalesce({n}, 0) ELSE 0 END AS {k}_defined"

    @cat.add("h17_block_bootstrap", TR + f""", vv AS (SELECT *, CAST(ts AS date) AS day FROM tw WHERE tr IS NOT NULL), bk AS (SELECT symbol, day, row_number() OVER (ORDER BY symbol, day) - 1 AS no FROM (SELECT DISTINCT symbol, day FROM vv)), nb AS (SELECT count(*) AS n FROM bk),
        dr AS (SELECT r.range AS rep, {mix_sql(42, 'r.range', 'bk.no')} % n AS no FROM bk, nb, range({B}) r), wt AS (SELECT rep, no, count(*) AS w FROM dr GROUP BY 1, 2), st AS (SELECT horizon, symbol, day, count(er) FILTER (tr) AS n1, coalesce(sum(er) FILTER (tr), 0) AS s1, coalesce(sum(er * er) FILTER (tr), 0) AS q1, count(er) FILTER (NOT tr) AS n0, coalesce(sum(er) FILTER (NOT tr), 0) AS s0, coalesce(sum(er * er) FILTER (NOT tr), 0) AS q0 FROM vv GROUP BY 1, 2, 3),
        rs AS (SELECT horizon, rep, sum(n0 * w)::DOUBLE AS n0, sum(s0 * w) AS s0, sum(q0 * w) AS q0, sum(n1 * w)::DOUBLE AS n1, sum(s1 * w) AS s1, sum(q1 * w) AS q1 FROM st JOIN bk USING (symbol, day) JOIN wt USING (no) GROUP BY 1, 2), rp AS (SELECT *, CASE WHEN n0 > 0 AND n1 > 0 THEN s1 / n1 - s0 / n0 END AS diff, CASE WHEN n0 >= 2 AND n1 >= 2 THEN ((q0 - s0 * s0 / n0) + (q1 - s1 * s1 / n1)) / (n0 + n1 - 2) END AS pooled FROM rs),
        re AS (SELECT *, CASE WHEN pooled > 0 THEN diff / sqrt(pooled) END AS d FROM rp), lim AS (SELECT horizon, quantile_cont(diff, [0.025, 0.975]) AS q, count(diff) AS n, quantile_cont(d, [0.025, 0.975]) AS e, count(d) AS m FROM re GROUP BY 1), gr AS (SELECT horizon, count(*) FILTER (n0 + n1 > 0) AS contributing_blocks FROM st GROUP BY 1)
        SELECT horizon, contributing_blocks, {LIM('n', 'q', 'difference')}, {LIM('m', 'e', 'cohens_d')} FROM gr LEFT JOIN lim USING (horizon)""", digits=5)
    def _(s, sf):
        d = trans(s, sf).filter("transition is not null").withColumn("day", F.to_date("ts"))
        return R.block_bootstrap_effects(d, ["horizon"], ["symbol", "day"], C("transition"), "er")

    @cat.add("h18_day_bootstrap", f"""WITH {OT}, bk AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS no FROM (SELECT DISTINCT entry_ts AS day FROM ot)), nb AS (SELECT count(*) AS n FROM bk), dr AS (SELECT r.range AS rep, {mix_sql(42, 'r.range', 'bk.no')} % n AS no FROM bk, nb, range({B}) r), wt AS (SELECT rep, no, count(*) AS w FROM dr GROUP BY 1, 2),
        os AS (SELECT *, unnest(['ALL', coalesce(st, 'UNMATCHED')]) AS scope FROM (SELECT *, CASE WHEN hold % 5 <> 0 THEN state::VARCHAR END AS st FROM ot)), st AS (SELECT symbol, scope, entry_ts AS day, count(*) AS n, sum(profit) AS s, count(*) FILTER (profit > 0) AS k, coalesce(sum(profit) FILTER (profit > 0), 0) AS sw, coalesce(sum(hold) FILTER (profit > 0), 0) AS hw, coalesce(sum(hold) FILTER (profit <= 0), 0) AS hl FROM os GROUP BY 1, 2, 3),
        rp AS (SELECT symbol, scope, rep, sum(n * w) AS n, sum(s * w) AS s, sum(k * w) AS k, sum(sw * w) AS sw, sum(hw * w) AS hw, sum(hl * w) AS hl FROM st JOIN bk USING (day) JOIN wt USING (no) GROUP BY 1, 2, 3),
        lg AS (SELECT symbol, scope, unnest([{{'statistic': 'win_rate', 'v': k / n}}, {{'statistic': 'expectancy', 'v': s / n}}, {{'statistic': 'win_loss_gap', 'v': CASE WHEN k > 0 AND k < n THEN sw / k - (s - sw) / (n - k) END}}, {{'statistic': 'hold_gap', 'v': CASE WHEN k > 0 AND k < n THEN hw / k - hl / (n - k) END}}], recursive := true) FROM rp),
        gr AS (SELECT symbol, scope, unnest([{{'statistic': 'win_rate', 'b': count(*)}}, {{'statistic': 'expectancy', 'b': count(*)}}, {{'statistic': 'win_loss_gap', 'b': least(count(*) FILTER (k > 0), count(*) FILTER (n > k))}}, {{'statistic': 'hold_gap', 'b': least(count(*) FILTER (k > 0), count(*) FILTER (n > k))}}], recursive := true) FROM st GROUP BY 1, 2), lm AS (SELECT symbol, scope, statistic, quantile_cont(v, [0.025, 0.975]) AS q, count(v) AS n FROM lg GROUP BY 1, 2, 3)
        SELECT symbol, scope, statistic, CASE WHEN b >= 2 AND n >= 2 THEN round(q[1], 6) END AS low, CASE WHEN b >= 2 AND n >= 2 THEN round(q[2], 6) END AS high, CASE WHEN b >= 2 THEN n ELSE 0 END AS defined, b AS contributing_blocks FROM gr JOIN lm USING (symbol, scope, statistic)""")
    def _(s, sf):
        t = outcome_trades(s, sf).withColumn("matched", F.when(C("hold") % 5 != 0, C("state")))
        return R.day_bootstrap_performance(t, ["symbol"], state="matched", metrics=["hold"])

    @cat.add("h21_state_by_outcome", f"WITH {OT} SELECT outcome, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY outcome), 6) AS share FROM ot GROUP BY 1, 2")
    def _(s, sf): return G.outcome_state_comparison(outcome_trades(s, sf), "outcome", "state", "hold")[0]

    @cat.add("h21_metric_by_outcome", f"WITH {OT} SELECT outcome, count(*) AS n, 0::BIGINT AS missing, round(avg(hold), 6) AS mean, {Q('hold', .5)} AS median FROM ot GROUP BY 1")
    def _(s, sf): return G.outcome_state_comparison(outcome_trades(s, sf), "outcome", "state", "hold")[1]

    @cat.add("h22_within_state_effects", f"""WITH {OT}, pe AS (SELECT unnest(['ALL', year::VARCHAR]) AS period, state, outcome, hold AS value FROM ot), sp AS (SELECT period, state, value, CASE WHEN outcome = 'LOSS' THEN 1 ELSE 0 END AS l, CASE WHEN outcome = 'LOSS' THEN 0 ELSE 1 END AS r FROM pe), {CMP.format(name='v', by='period, state', src='sp')},
        mo AS (SELECT period, state, var_samp(value) FILTER (l = 1) AS vl, var_samp(value) FILTER (r = 1) AS vr FROM sp GROUP BY 1, 2) SELECT period, state, {CMP_SEL}, round((1 - 3 / (4.0 * (nl + nr - 2) - 1)) * (ml - mr) / sqrt(((nl - 1) * vl + (nr - 1) * vr) / (nl + nr - 2)), 6) AS hedges_g FROM v_p JOIN v_m USING (period, state) JOIN mo USING (period, state)""")
    def _(s, sf):
        d = outcome_trades(s, sf).withColumn("period", F.explode(F.array(F.lit("ALL"), C("year").cast("string"))))
        return S.loss_win_effects(d, ["period", "state"], C("outcome") == "LOSS", "hold")

    STAB = f"WITH {OT}, pr AS (SELECT DISTINCT year AS period FROM ot), g AS (SELECT year AS period, state, count(*) AS n, count(*) FILTER (profit > 0) AS wins, sum(profit) AS net FROM ot GROUP BY 1, 2), st AS (SELECT state, sum(n) AS tn, sum(wins) AS tw, sum(net) AS tt FROM g GROUP BY 1), q AS (SELECT period, state, coalesce(n, 0) AS n, coalesce(wins, 0) AS wins, coalesce(net, 0) AS net, tn, tw, tt FROM pr CROSS JOIN st LEFT JOIN g USING (period, state))"

    @cat.add("h23_temporal_stability", f"{STAB} SELECT period, state, n, wins, round(wins / nullif(n, 0), 6) AS win_rate, round(net, 6) AS net, round(net / nullif(n, 0), 6) AS expectancy, (tn - n)::BIGINT AS rest_n, round((tw - wins) / nullif(tn - n, 0), 6) AS rest_win_rate, round((tt - net) / nullif(tn - n, 0), 6) AS rest_expectancy FROM q")
    def _(s, sf):
        t = outcome_trades(s, sf)
        return G.temporal_stability(t, "state", C("year"), t.select(C("year").alias("period")).distinct())

    @cat.add("h23_stability_signs", f"{STAB} SELECT state, count(*) FILTER (net > 0) AS positive_periods, count(*) FILTER (net < 0) AS negative_periods, count(*) FILTER (n > 0 AND net = 0) AS zero_periods, count(*) FILTER (n = 0) AS empty_periods FROM q GROUP BY 1")
    def _(s, sf):
        t = outcome_trades(s, sf)
        return G.stability_signs(G.temporal_stability(t, "state", C("year"), t.select(C("year").alias("period")).distinct()), "state")

    @cat.add("h24_distribution_drift", f"""WITH {OT}, d AS (SELECT symbol, hold AS value, year >= 2000 AS aft FROM ot), v AS (SELECT symbol, value, count(*) FILTER (NOT aft) AS l, count(*) FILTER (aft) AS r FROM d GROUP BY 1, 2), c AS (SELECT *, sum(l) OVER w / sum(l) OVER (PARTITION BY symbol) AS fl, sum(r) OVER w / sum(r) OVER (PARTITION BY symbol) AS fr FROM v WINDOW w AS (PARTITION BY symbol ORDER BY value)), k AS (SELECT symbol, max(abs(fl - fr)) AS ks FROM c GROUP BY 1),
        m AS (SELECT symbol, count(*) FILTER (NOT aft) AS bn, count(*) FILTER (aft) AS an, avg(value) FILTER (aft) - avg(value) FILTER (NOT aft) AS md, quantile_cont(value, .5) FILTER (aft) - quantile_cont(value, .5) FILTER (NOT aft) AS dd, (quantile_cont(value, .75) FILTER (aft) - quantile_cont(value, .25) FILTER (aft)) - (quantile_cont(value, .75) FILTER (NOT aft) - quantile_cont(value, .25) FILTER (NOT aft)) AS iq, sqrt((var_samp(value) FILTER (aft) + var_samp(value) FILTER (NOT aft)) / 2) AS sd FROM d GROUP BY 1)
        SELECT symbol, bn AS before_n, an AS after_n, round(md, 6) AS mean_difference, round(dd, 6) AS median_difference, round(iq, 6) AS iqr_difference, round(ks, 6) AS ks, round(md / sd, 6) AS standardized_mean_difference FROM m JOIN k USING (symbol)""")
    def _(s, sf): return S.distribution_drift(outcome_trades(s, sf), ["symbol"], C("year") >= 2000, "hold")

    @cat.add("h25_expectancy_decomposition", f"WITH {OT}, p AS (SELECT symbol, year >= 2000 AS aft, avg(profit) AS m, avg((profit > 0)::INT) AS w, avg(profit) FILTER (profit > 0) AS a, avg(profit) FILTER (profit <= 0) AS l FROM ot GROUP BY 1, 2) SELECT x.symbol, round(y.m - x.m, 6) AS change, round((y.w - x.w) * ((x.a + y.a) / 2 - (x.l + y.l) / 2), 6) AS win_probability, round((x.w + y.w) / 2 * (y.a - x.a), 6) AS average_winner, round((1 - (x.w + y.w) / 2) * (y.l - x.l), 6) AS average_loser FROM p x JOIN p y ON x.symbol = y.symbol AND NOT x.aft AND y.aft")
    def _(s, sf): return S.expectancy_decomposition(outcome_trades(s, sf), C("year") >= 2000, "profit", ["symbol"])

    @cat.add("h26_calendar_groups", f"WITH {OT}, k AS (SELECT unnest([{{'kind': 'hour', 'bucket': 0}}, {{'kind': 'weekday', 'bucket': isodow(entry_ts) - 1}}, {{'kind': 'month', 'bucket': month(entry_ts)}}], recursive := true), profit FROM ot), f AS (SELECT 'hour' AS kind, range AS bucket FROM range(24) UNION ALL SELECT 'weekday', range FROM range(7) UNION ALL SELECT 'month', range + 1 FROM range(12)), g AS (SELECT f.kind, f.bucket, count(k.profit) AS n, count(*) FILTER (k.profit < 0) AS losses FROM f LEFT JOIN k ON k.kind = f.kind AND k.bucket = f.bucket GROUP BY 1, 2) SELECT kind, bucket, n, losses, round(n / sum(n) OVER (PARTITION BY kind), 6) AS trade_share, round(losses / sum(losses) OVER (PARTITION BY kind), 6) AS loss_share FROM g")
    def _(s, sf): return G.calendar_groups(outcome_trades(s, sf).withColumn("entry_ts", C("entry_ts").cast("timestamp")))

    @cat.add("h27_observation_summary", f"{RUNS}, a AS (SELECT symbol, count(DISTINCT blk) AS blocks, count(*) FILTER (connected) AS pairs, count(*) FILTER (connected AND previous_state <> state) AS changes, count(er) AS observed, round(avg(er), 6) AS mean, {Q('er', .5)} AS median, {Q('er', .25)} AS q25, {Q('er', .75)} AS q75 FROM z GROUP BY 1) SELECT a.*, r.runs, r.mean_run FROM a JOIN (SELECT symbol, count(*) AS runs, round(avg(length), 6) AS mean_run FROM rn GROUP BY 1) r USING (symbol)")
    def _(s, sf): return S.observation_summary(linked(s, sf), S.runs_of(linked(s, sf)), "er")

    @cat.add("h28_feed_agreement", f"WITH {LINK}, fb AS (SELECT *, CASE WHEN pos % 10 = 0 THEN (state + 1) % 3 ELSE state END AS sb FROM z WHERE pos % 7 <> 0), j AS (SELECT z.symbol, z.state AS a, fb.sb AS b, z.connected AND z.previous_state <> z.state AS ca, coalesce(fb.sb <> fb.previous_state AND fb.connected, false) AS cb FROM z LEFT JOIN fb USING (symbol, pos)) SELECT symbol, count(b) AS \"both\", count(*) FILTER (b IS NULL) AS only_a, 0::BIGINT AS only_b, round(avg(CASE WHEN b IS NOT NULL THEN (a = b)::INT END), 6) AS agreement, "
             + ", ".join(f"count(*) FILTER (a = {x} AND b = {y}) AS c{x}{y}" for x in range(3) for y in range(3)) + ", round(count(*) FILTER (b IS NOT NULL AND ca AND cb) / nullif(count(*) FILTER (b IS NOT NULL AND (ca OR cb)), 0), 6) AS change_jaccard FROM j GROUP BY 1")
    def _(s, sf):
        z = linked(s, sf)
        sb = F.when(C("pos") % 10 == 0, (C("state") + 1) % 3).otherwise(C("state"))
        b = z.filter("pos % 7 <> 0").select("symbol", "pos", sb.alias("state_b"), F.coalesce((sb != C("previous_state")) & C("connected"), F.lit(False)).alias("change_b"))
        a = z.select("symbol", "pos", C("state").alias("state_a"), F.coalesce(C("connected") & (C("previous_state") != C("state")), F.lit(False)).alias("change_a"))
        return S.feed_agreement(a.join(b, ["symbol", "pos"], "full_outer").fillna(False, ["change_b"]))
