"""Group J (models) and the vector diagnoses H29-H30, H39."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import CHUNK, H1, M15, STATES, ep, indexed, indexed_sql, staged, states, table, ticks
from barloom.catalog.events import staged_levels
from barloom.catalog.windows import atr_sql
from barloom.operators import models as M, stats as S, windows as X

C = F.col
D = 64
V = [f"v{i:02d}" for i in range(D)]
# fixed values: a three-component mixture built from a rule
PARAMS = dict(weights=[0.5, 0.3, 0.2], means=[[((k * 7 + i * 3) % 5 - 2) * 0.05 for i in range(D)] for k in range(3)],
              precisions_cholesky=[[[(6.0 + (k + i) % 3) if i == j else (0.5 if j == i + 1 else 0.0) for j in range(D)] for i in range(D)] for k in range(3)])
VEC = "ve AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {v}" for i, v in enumerate(V)) + " FROM embeddings)"


def gmm_sql():
    import math
    out = []
    for k in range(3):
        terms = []
        for j in range(D):
            t = f"({V[j]} - {PARAMS['means'][k][j]!r}::DOUBLE) * {PARAMS['precisions_cholesky'][k][j][j]!r}::DOUBLE"
            if j:
                t += f" + ({V[j-1]} - {PARAMS['means'][k][j-1]!r}::DOUBLE) * 0.5::DOUBLE"
            terms.append(f"pow({t}, 2)")
        c = sum(math.log(PARAMS['precisions_cholesky'][k][i][i]) for i in range(D)) - D / 2 * math.log(2 * math.pi) + math.log(PARAMS['weights'][k])
        out.append(f"{c!r}::DOUBLE - ({' + '.join(terms)}) / 2 AS l{k}")
    return f"{VEC}, lg AS (SELECT *, {', '.join(out)} FROM ve), mx AS (SELECT *, greatest(l0, l1, l2) AS m FROM lg), po AS (SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS z FROM mx), pp AS (SELECT *, exp(l0 - m) / z AS p0, exp(l1 - m) / z AS p1, exp(l2 - m) / z AS p2, CASE WHEN l0 = m THEN 0 WHEN l1 = m THEN 1 ELSE 2 END AS state FROM po)"


def vectors(s, sf):
    return table(s, sf, "embeddings").select("vec_id", "label", *[C("embedding")[i].cast("double").alias(v) for i, v in enumerate(V)])


def matrix(s, sf):
    l = table(s, sf, "lineitem")
    e = l.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), F.when(C("l_tax") > 0.07, None).otherwise(C("l_quantity")).alias("qty"),
                 C("l_discount").alias("disc"), F.when(C("l_linenumber") == 3, None).otherwise(C("l_returnflag")).alias("flag"), C("l_linenumber").alias("line"),
                 F.when(C("l_tax") != 0.05, C("l_extendedprice")).alias("price"))
    return M.ml_matrix(e, ["qty", "disc"], ["flag", "line"], "price", ids=["row_id"])


NUM, CAT = ["qty", "disc"], ["flag", "line"]
MX = "e AS (SELECT CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity END AS qty, l_discount AS disc, CASE WHEN l_linenumber = 3 THEN NULL ELSE '[\"string\",\"' || l_returnflag || '\"]' END AS flag, '[\"int\",\"' || l_linenumber || '\"]' AS line, CASE WHEN l_tax <> 0.05 THEN l_extendedprice END AS y FROM lineitem)"


def fitted(s, sf):
    m = matrix(s, sf)
    enc = M.encode_categories(m, M.category_vocabulary(m, CAT), CAT)
    enc = staged_levels(s, sf, "encoded", lambda: enc)
    model, inputs = M.fit_boosted_regression(enc, NUM, CAT)
    return enc, model, inputs


def scored_bars(s, sf):
    def make():
        f = X.universal_features(indexed(s, sf), H1, CHUNK)
        p = dict(weights=[0.4, 0.35, 0.25], means=[[0.2, 0.1, 0.3], [0.4, 0.2, 0.4], [0.6, 0.3, 0.5]],
                 precisions_cholesky=[[[4.0, 0.3, 0.0], [0.0, 5.0, 0.2], [0.0, 0.0, 2.0]] for _ in range(3)])
        return M.assign_states(f, ["er_4", "er_16", "rv_16"], p, H1, CHUNK)
    return staged(s, sf, "scored", make)


def register(cat):
    @cat.add("j01_ml_matrix", f"WITH {MX} SELECT flag, line, y IS NOT NULL AS observed, count(*) AS n, count(qty) AS qty_n, round(sum(y), 2) AS y_sum FROM e GROUP BY 1, 2, 3", digits=2)
    def _(s, sf):
        return matrix(s, sf).groupBy("flag", "line", "observed").agg(F.count("*").alias("n"), F.count("qty").alias("qty_n"), F.sum("y").alias("y_sum"))

    @cat.add("j02_category_vocabulary", f"WITH {MX}, c AS (SELECT DISTINCT 'flag' AS field, flag AS category FROM e WHERE flag IS NOT NULL UNION SELECT DISTINCT 'line', line FROM e) SELECT field, category, row_number() OVER (PARTITION BY field ORDER BY category) + 1 AS code FROM c")
    def _(s, sf): return M.category_vocabulary(matrix(s, sf), CAT)

    @cat.add("j02_encode_categories", f"WITH {MX}, c AS (SELECT DISTINCT flag AS category FROM e WHERE flag IS NOT NULL AND flag <> '[\"string\",\"N\"]'), v AS (SELECT category, row_number() OVER (ORDER BY category) + 1 AS code FROM c) SELECT CASE WHEN flag IS NULL THEN 0 ELSE coalesce(code, 1) END AS flag, count(*) AS n FROM e LEFT JOIN v ON v.category = e.flag GROUP BY 1")
    def _(s, sf):
        m = matrix(s, sf)
        v = M.category_vocabulary(m.filter(C("flag") != '["string","N"]'), ["flag"])
        return M.encode_categories(m, v, ["flag"]).groupBy("flag").agg(F.count("*").alias("n"))

    @cat.add("j03_fit_predict_boosted")
    def _(s, sf):
        enc, model, _ = fitted(s, sf)
        return M.predict(model, enc, NUM, CAT).select("row_id", "predicted")

    @cat.add("j06_feature_clues")
    def _(s, sf):
        enc, model, inputs = fitted(s, sf)
        return M.feature_clues(s, model, inputs)

    @cat.add("j05_evaluate_regression", """WITH p AS (SELECT l_returnflag AS model, l_extendedprice AS a, l_quantity * 1000 AS p FROM lineitem), r AS (SELECT *, p - a AS r, rank() OVER (PARTITION BY model ORDER BY a) + (count(*) OVER (PARTITION BY model, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rp FROM p)
        SELECT model, count(*) AS observed, round(avg(a), 2) AS actual_mean, round(avg(p), 2) AS prediction_mean, round(avg(r), 2) AS residual_mean, round(avg(abs(r)), 2) AS mean_absolute_error, round(avg(r * r) / 1e6, 2) AS mse_m, round(sqrt(avg(r * r)), 2) AS root_mean_squared_error, min(a) AS actual_minimum, max(a) AS actual_maximum, min(p) AS prediction_minimum, max(p) AS prediction_maximum,
        round(1 - avg(r * r) / var_pop(a), 2) AS r_squared, round(corr(a, p), 2) + 0.0 AS pearson, round(quantile_cont(a, 0.5), 2) AS actual_median, round(quantile_cont(p, 0.5), 2) AS prediction_median, round(quantile_cont(r, 0.5), 2) AS residual_median, round(quantile_cont(abs(r), 0.5), 2) AS median_absolute_error, round(corr(ra, rp), 2) + 0.0 AS spearman FROM r GROUP BY 1""", digits=2)
    def _(s, sf):
        l = table(s, sf, "lineitem").select(C("l_returnflag").alias("model"), C("l_extendedprice").alias("y"), (C("l_quantity") * 1000).alias("predicted"))
        e = M.evaluate_regression(l)
        return e.withColumn("mse_m", C("mean_squared_error") / 1e6).drop("mean_squared_error")

    @cat.add("j07_standard_scaler", f"WITH {VEC} SELECT " + ", ".join(f"round(avg({v}), 6) AS mean_{v}, round(stddev_pop({v}), 6) AS scale_{v}" for v in V) + " FROM ve")
    def _(s, sf): return M.fit_scaler(vectors(s, sf), V)

    @cat.add("j07_apply_scaler", f"WITH {VEC}, m AS (SELECT " + ", ".join(f"avg({v}) AS m{v}, stddev_pop({v}) AS s{v}" for v in V) + " FROM ve) SELECT vec_id, " + ", ".join(f"round(({v} - m{v}) / s{v}, 6) AS z_{v}" for v in V[:4]) + " FROM ve, m")
    def _(s, sf):
        d = vectors(s, sf)
        return M.apply_scaler(d, M.fit_scaler(d, V), V).select("vec_id", *[f"z_{v}" for v in V[:4]])

    @cat.add("j08_gmm_fit")
    def _(s, sf):
        model, info = M.gmm_fit(vectors(s, sf), V, 3)
        return s.createDataFrame([tuple(info.values())], M.MIXTURES)

    @cat.add("j09_select_k")
    def _(s, sf): return M.select_k(vectors(s, sf), V, range(2, 11))

    @cat.add("j10_adjusted_rand", """WITH d AS (SELECT vec_id % 4 AS slice, label AS a, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS b FROM embeddings), n AS (SELECT slice, a, b, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2, 3), r AS (SELECT slice, sum(r * (r - 1) / 2) AS sr, sum(r) AS t FROM (SELECT slice, a, sum(n) AS r FROM n GROUP BY 1, 2) GROUP BY 1), c AS (SELECT slice, sum(c * (c - 1) / 2) AS sc FROM (SELECT slice, b, sum(n) AS c FROM n GROUP BY 1, 2) GROUP BY 1), k AS (SELECT slice, sum(n * (n - 1) / 2) AS sn FROM n GROUP BY 1)
        SELECT slice, t::BIGINT AS n, round((sn - sr * sc / (t * (t - 1) / 2)) / ((sr + sc) / 2 - sr * sc / (t * (t - 1) / 2)), 6) AS ari FROM r JOIN c USING (slice) JOIN k USING (slice)""")
    def _(s, sf):
        e = table(s, sf, "embeddings").select((C("vec_id") % 4).alias("slice"), C("label").alias("a"), F.when(C("vec_id") % 5 == 0, (C("label") + 1) % 10).otherwise(C("label")).alias("b"))
        return M.adjusted_rand(e, "a", "b")

    @cat.add("j10_label_stability")
    def _(s, sf): return M.label_stability(vectors(s, sf), V, 3, order=["vec_id"])

    @cat.add("j11_frozen_gmm_score", f"WITH {gmm_sql()} SELECT vec_id, round(p0, 6) AS p_0, round(p1, 6) AS p_1, round(p2, 6) AS p_2, state FROM pp")
    def _(s, sf): return M.frozen_gmm_score(vectors(s, sf), V, PARAMS).select("vec_id", "p_0", "p_1", "p_2", "state")

    @cat.add("j12_assign_states")
    def _(s, sf):
        return scored_bars(s, sf).select("symbol", "ts", "state", "max_posterior", "margin", "entropy", "state_age", "bars_since_transition", "delta_max_posterior")

    @cat.add("j13_posterior_confidence", f"WITH {gmm_sql()}, g AS (SELECT greatest(p0, p1, p2) AS mp, unnest([{{'scope': 'ALL', 'scope_key': 'ALL'}}, {{'scope': 'STATE', 'scope_key': state::VARCHAR}}, {{'scope': 'PERIOD', 'scope_key': (vec_id % 3)::VARCHAR}}], recursive := true) FROM pp) SELECT scope, scope_key, count(*) AS n, round(avg(mp), 6) AS mean, round(quantile_cont(mp, .5), 6) AS median, round(quantile_cont(mp, .1), 6) AS p10, round(quantile_cont(mp, .9), 6) AS p90, round(min(mp), 6) AS minimum FROM g GROUP BY 1, 2")
    def _(s, sf):
        d = M.frozen_gmm_score(vectors(s, sf), V, PARAMS).withColumn("max_posterior", F.greatest("p_0", "p_1", "p_2"))
        return M.posterior_confidence(d, period=C("vec_id") % 3)

    @cat.add("j14_replay_parity", "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 11 <> 0) AS compared, (SELECT count(*) FROM embeddings WHERE vec_id % 11 = 0) AS unpaired, (SELECT count(*) FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 7 = 0) AS diff_v00, 0::BIGINT AS diff_label")
    def _(s, sf):
        d = vectors(s, sf)
        again = d.filter("vec_id % 11 <> 0").withColumn("v00", C("v00") + F.when(C("vec_id") % 7 == 0, 1e-3).otherwise(1e-12))
        return M.replay_parity(d, again, ["vec_id"], ["v00", "label"])

    req = {"er_4": ("M15", 5), "er_16": ("M15", 17), "h1_x": ("H1", 4)}

    def diagnosed(s, sf):
        f = X.with_lags(indexed(s, sf, M15), CHUNK)
        h1_done = F.floor((F.unix_seconds("ts") + M15 - F.ceil((F.unix_seconds("ts") - C("seg_pos") * M15) / F.lit(3600)) * 3600) / F.lit(3600))
        close = F.timestamp_seconds(F.unix_seconds("ts") + M15)
        feats = f.select("symbol", "seg", close.alias("ts"), "er_4", F.when(C("pos") % 50 != 0, C("er_16")).alias("er_16"), F.when(h1_done >= 4, C("close")).alias("h1_x"))
        gaps = f.filter("seg_pos = 0 and prev_ts is not null").select("symbol", C("prev_ts").alias("previous_ts"), C("ts").alias("next_ts"))
        t = ticks(s, sf).select(C("seq").alias("event_id"), "symbol", C("ts").alias("entry_ts"))
        return M.missing_vector_diagnosis(t, feats, gaps, M15, requirements=req)

    @cat.add("h29_missing_vector_diagnosis", f"""WITH {indexed_sql(M15)}, y AS (SELECT *, epoch(min(ts) OVER (PARTITION BY symbol, seg)) AS s0, lag(ts) OVER (PARTITION BY symbol ORDER BY pos) AS pv, epoch(ts) + 900 AS cs FROM x), f AS (SELECT *, (cs - s0)::BIGINT // 900 AS m, greatest(0, floor((cs - ceil(s0 / 3600) * 3600) / 3600))::BIGINT AS h FROM y), gg AS (
        SELECT *, list_filter([CASE WHEN seg_pos < 4 THEN 'er_4' END, CASE WHEN seg_pos < 16 OR pos % 50 = 0 THEN 'er_16' END, CASE WHEN h < 4 THEN 'h1_x' END], lambda v: v IS NOT NULL) AS missing, list_filter([CASE WHEN seg_pos < 4 AND m < 5 THEN 'er_4' END, CASE WHEN (seg_pos < 16 OR pos % 50 = 0) AND m < 17 THEN 'er_16' END, CASE WHEN h < 4 THEN 'h1_x' END], lambda v: v IS NOT NULL) AS short FROM f),
        st AS (SELECT symbol, seg, min(CASE WHEN seg_pos = 0 THEN prev_ts END) AS gap_from, min(ts) AS opened FROM x GROUP BY 1, 2), e AS (SELECT event_id, concat('S', user_id % 2) AS symbol, floor(epoch(ts) / 900) * 900 AS req FROM events), j AS (SELECT e.*, gg.missing, gg.short, gg.m, gg.h, st.gap_from, st.opened FROM e LEFT JOIN gg ON gg.symbol = e.symbol AND gg.cs = e.req LEFT JOIN st ON st.symbol = gg.symbol AND st.seg = gg.seg),
        gp AS (SELECT symbol, epoch(prev_ts) AS a, epoch(ts) AS b FROM x WHERE epoch(ts) - epoch(prev_ts) > 900), k AS (SELECT j.*, gp.a, gp.b FROM j ASOF LEFT JOIN gp ON gp.symbol = j.symbol AND gp.a <= j.req - 900)
        SELECT event_id, CASE WHEN missing IS NOT NULL THEN CASE WHEN len(missing) = 0 THEN 'MATCHED' WHEN len(short) = len(missing) THEN CASE WHEN gap_from IS NOT NULL AND isodow(gap_from) = 5 AND isodow(opened) IN (7, 1) THEN 'WEEKLY_SEGMENT_WARMUP' WHEN gap_from IS NOT NULL THEN 'MIDWEEK_SEGMENT_WARMUP' ELSE 'INITIAL_SEGMENT_WARMUP' END ELSE 'SPECIFIC_FEATURE_INCOMPLETE' END
          WHEN a < req - 900 AND req - 900 < b THEN 'SOURCE_BAR_GAP' ELSE 'NO_FEATURE_ROW_AT_BOUNDARY' END AS reason, array_to_string(missing, ',') AS missing, m AS completed_m15, h AS completed_h1 FROM k""")
    def _(s, sf):
        return diagnosed(s, sf).select("event_id", "reason", F.array_join("missing", ",").alias("missing"), "completed_m15", "completed_h1")

    @cat.add("h39_coverage_reasons")
    def _(s, sf):
        d = staged_levels(s, sf, "diagnosed", lambda: diagnosed(s, sf).select("reason", "missing"))
        return S.coverage_reasons(d.filter("reason <> 'MATCHED'"), d.agg(F.count("*")).scalar())[0]

    HI = f"""ch AS (SELECT symbol, seg, make_timestamp(CAST(floor(epoch(ts) / 10800) AS BIGINT) * 10800 * 1000000) AS b, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM xx GROUP BY 1, 2, 3 HAVING count(*) = 3), x AS (SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY b) - 1 AS seg_pos, row_number() OVER (PARTITION BY symbol ORDER BY b) - 1 AS pos FROM ch)"""

    @cat.add("h30_warmup_trace", f"WITH RECURSIVE {indexed_sql(H1).replace(' x AS (', ' xx AS (')}, {HI}, {atr_sql()}, l AS (SELECT *, CASE WHEN seg_pos >= 4 THEN lag(atr, 4) OVER (PARTITION BY symbol, seg ORDER BY pos) END AS al FROM a), e AS (SELECT event_id, concat('S', user_id % 2) AS symbol, floor(epoch(ts) / 3600) * 3600 AS at FROM events), q AS (SELECT e.*, xx.seg, xx.seg_pos AS sp FROM e LEFT JOIN xx ON xx.symbol = e.symbol AND epoch(xx.ts) + 3600 = e.at) "
             "SELECT event_id, sp + 1 AS source_bars, CASE WHEN q.seg IS NOT NULL THEN coalesce(l.seg_pos + 1, 0) END AS completed_bars, CASE WHEN q.seg IS NOT NULL THEN greatest(0, 19 - coalesce(l.seg_pos + 1, 0)) END AS shortfall, round(atr, 6) AS atr, round(al, 6) AS atr_lag, CASE WHEN q.seg IS NULL THEN 'NO_SOURCE_BAR' WHEN l.seg_pos IS NULL THEN 'NO_COMPLETE_HIGHER_BAR' WHEN atr IS NULL THEN 'ATR_CURRENT_AND_LAG_NOT_SEEDED' WHEN al IS NULL THEN 'LAGGED_ATR_NOT_SEEDED' ELSE 'READY' END AS reason FROM q LEFT JOIN l ON l.symbol = q.symbol AND l.seg = q.seg AND epoch(l.b) = floor(q.at / 10800) * 10800 - 10800")
    def _(s, sf):
        t = ticks(s, sf).select(C("seq").alias("event_id"), "symbol", C("ts").alias("entry_ts"))
        return M.warmup_trace(t, indexed(s, sf), H1, chunk_rows=CHUNK).drop("symbol", "entry_ts")
