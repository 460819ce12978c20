"""Model matrices, vocabularies, boosted trees, mixtures, scoring and evaluation."""
from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.functions.scalars import posterior_scores
from barloom.operators import mixtures as EM
from barloom.operators.stats import flag_count, join_ns, outcome_distribution, rank_quantile, value_ranks, with_previous_state
from barloom.operators.timeline import number_rows
from barloom.sources.stage import stage

C = F.col

# fixed values: category codes of missing and unseen values
MISSING_CODE, UNKNOWN_CODE = 0, 1


def ml_matrix(events: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, ids: Sequence[str] = ()) -> DataFrame:
    """Typed cells (numeric as double, categorical as JSON [type, value]) plus target and observed mask."""
    kinds = dict(events.dtypes)
    num = [C(f"`{c}`").cast("double").alias(c) for c in numeric]
    cat = [F.when(C(f"`{c}`").isNotNull(), F.to_json(F.array(F.lit(kinds[c]), C(f"`{c}`").cast("string")))).alias(c) for c in categorical]
    y = C(f"`{target}`").cast("double")
    return events.select(*[C(f"`{c}`") for c in ids], *num, *cat, y.alias("y"), y.isNotNull().alias("observed"))


def category_vocabulary(matrix: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(field, category, code): sorted (type, value) categories numbered from 2 per field."""
    item = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), C(f"`{c}`").alias("category")) for c in categorical]))
    cats = matrix.select(item.alias("i")).select("i.*").filter("category is not null").distinct()
    n = number_rows(cats, ["field", "category"], "_i")
    first = n.groupBy("field").agg(F.min("_i").alias("_f"))
    return n.join(first, "field").select("field", "category", (C("_i") - C("_f") + 2).cast("int").alias("code"))


def encode_categories(matrix: DataFrame, vocabulary: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Frozen codes: 0 missing, 1 unknown; one equi-join per field, AQE broadcasts small vocabularies."""
    out = matrix
    for c in categorical:
        v = vocabulary.filter(C("field") == c).select(C("category").alias("_cat"), C("code").alias("_code"))
        code = F.when(C(f"`{c}`").isNull(), MISSING_CODE).otherwise(F.coalesce("_code", F.lit(UNKNOWN_CODE)))
        out = out.join(v, C(f"`{c}`") == C("_cat"), "left").withColumn(c, code).drop("_cat", "_code")
    return out


# fixed values: boosting settings
BOOST = dict(maxIter=64, stepSize=0.05, maxDepth=4, minInstancesPerNode=10, seed=1729)


def fit_boosted_regression(encoded: DataFrame, numeric: Sequence[str], categorical: Sequence[str], **settings):
    """Gradient-boosted trees; missing numerics become a median-imputed value plus an indicator.

    Every categorical input stays categorical, whatever its number of codes (``maxBins`` grows with
    the widest one), and every numeric input stays a number, however few values it has.

    Rows with equal inputs are one weighted row with their mean target: squared error has the same gradients, gains and leaves on both. A node's
    least number of rows becomes a least weight, so it still counts rows. Medians come from all rows.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler, VectorIndexer
    from pyspark.ml.regression import GBTRegressor
    safe = {c: f"n{i}" for i, c in enumerate(numeric)} | {c: f"c{i}" for i, c in enumerate(categorical)}
    named = ", ".join([f"CAST(`{c}` AS DOUBLE) AS {s}" for c, s in safe.items()]
                      + [f"CAST(`{c}` IS NULL AS DOUBLE) AS {safe[c]}_missing" for c in numeric])
    num = [safe[c] for c in numeric]
    stages = [SQLTransformer(statement=f"SELECT *, {named} FROM __THIS__")]
    if num:
        stages.append(Imputer(strategy="median", inputCols=num, outputCols=[f"{c}_filled" for c in num]))
    inputs = [f"{c}_filled" for c in num] + [f"{c}_missing" for c in num]
    observed, bins = encoded.filter("observed"), 32
    if categorical:
        # codes run from 0, so the highest bounds their number; one more is for codes not seen in the fit
        codes = 1 + max(v or 0 for v in observed.agg(*[F.max(f"`{c}`") for c in categorical]).first())
        bins = max(bins, int(codes) + 1)
        stages += [VectorAssembler(inputCols=[safe[c] for c in categorical], outputCol="codes"),
                   VectorIndexer(inputCol="codes", outputCol="categories", maxCategories=max(2, int(codes)), handleInvalid="keep")]
        inputs = [*inputs, "categories"]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    prepared = Pipeline(stages=stages).fit(observed)
    cells = stage(observed.groupBy(*[C(f"`{c}`") for c in safe]).agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("rows")))
    settings = {**BOOST, "maxBins": bins, **settings}
    # weights are whole, so half a row below the least number tells the same nodes apart
    rows, least = cells.agg(F.sum("rows")).first()[0] or 0, settings.pop("minInstancesPerNode")
    if rows < 2 * least:
        settings["maxDepth"] = 0
    elif least > 1:
        settings["minWeightFractionPerNode"] = (least - 0.5) / rows
    boosted = GBTRegressor(labelCol="y", featuresCol="features", predictionCol="predicted", weightCol="rows", **settings).fit(prepared.transform(cells))
    model = PipelineModel([*prepared.stages, boosted])
    model_inputs = [*numeric, *[f"{c} is missing" for c in numeric], *categorical]
    return model, model_inputs


def predict(model, encoded: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Predictions for a matrix with the fitted schema; a missing input column is an error."""
    lacking = set([*numeric, *categorical]) - set(encoded.columns)
    if lacking:
        raise ValueError(f"matrix lacks fitted columns: {sorted(lacking)}")
    return model.transform(encoded).select(*encoded.columns, "predicted")


def feature_clues(spark, model, inputs: Sequence[str]) -> DataFrame:
    """Gain share and split count per model input (a model-sized table, one row per input)."""
    trees = model.stages[-1]
    gains = trees.featureImportances.toArray()
    counts = [0] * len(inputs)
    for tree in trees.trees:
        for i in re.findall(r"If \(feature (\d+)", tree.toDebugString):
            counts[int(i)] += 1
    total = max(1, sum(counts))
    rows = [(n, float(g), int(c), c / total) for n, g, c in zip(inputs, gains, counts)]
    d = spark.createDataFrame(rows, "feature string, gain_fraction double, splits long, split_fraction double")
    w = lambda c: W.partitionBy(F.lit(0)).orderBy(F.desc(c), "feature")
    return d.withColumns({"gain_rank": F.row_number().over(w("gain_fraction")), "split_rank": F.row_number().over(w("splits"))})


def evaluate_regression(d: DataFrame, by: Sequence[str] = ("model",), actual: str = "y", predicted: str = "predicted") -> DataFrame:
    """Residual statistics, R2, Pearson and average-rank Spearman; constant inputs give null.

    Rows are counted once by distinct (actual, predicted); ranks and medians come from these cells
    and their distinct values, so ties never form a large group and copies cost nothing.
    """
    by = list(by)
    p = d.filter(C(actual).isNotNull()).select(*by, C(actual).cast("double").alias("a"), C(predicted).cast("double").alias("p"))
    p = p.withColumns({"r": C("p") - C("a"), "abs_r": F.abs(C("p") - C("a"))})
    g = p.groupBy(*by).agg(
        F.count("*").alias("observed"), F.avg("a").alias("actual_mean"), F.avg("p").alias("prediction_mean"), F.avg("r").alias("residual_mean"),
        F.avg("abs_r").alias("mean_absolute_error"), F.avg(C("r") * C("r")).alias("mean_squared_error"), F.var_pop("a").alias("_va"), F.var_pop("p").alias("_vp"),
        F.corr("a", "p").alias("_c"), F.min("a").alias("actual_minimum"), F.max("a").alias("actual_maximum"), F.min("p").alias("prediction_minimum"),
        F.max("p").alias("prediction_maximum"))
    flat = (C("_va") == 0) | (C("_vp") == 0)
    g = g.withColumns({"root_mean_squared_error": F.sqrt("mean_squared_error"), "r_squared": F.when(C("_va") > 0, 1 - C("mean_squared_error") / C("_va")),
                       "pearson": F.when(~flat, C("_c"))}).drop("_va", "_vp", "_c")
    # one rank pass for all four series
    cells = stage(p.groupBy(*by, "a", "p").agg(F.count("*").alias("w")))
    medians = {"a": "actual_median", "p": "prediction_median", "r": "residual_median", "abs_r": "median_absolute_error"}
    error = {"r": C("p") - C("a"), "abs_r": F.abs(C("p") - C("a"))}
    series = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), error.get(c, C(c)).alias("value")) for c in medians]))
    ranks = stage(value_ranks(cells.select(*by, "w", series.alias("_s")).select(*by, "w", "_s.series", "_s.value"), [*by, "series"], "value", {"n": C("w")}))
    middle = ranks.groupBy(*by, "series").agg(rank_quantile(0.5).alias("m"))
    g = join_ns(g, middle.groupBy(*by).agg(*[F.max(F.when(C("series") == c, C("m"))).alias(name) for c, name in medians.items()]), by)
    rank = lambda v: ranks.filter(C("series") == v).select(*by, C("_v").alias(v), (C("lt_n") + (C("n") + 1) / 2).alias(f"rank_{v}"))
    cells = join_ns(join_ns(cells, rank("a"), [*by, "a"]), rank("p"), [*by, "p"])
    n, x, y, w = F.sum("w"), C("rank_a"), C("rank_p"), C("w")
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    cov, vx, vy = F.sum(w * x * y) / n - mx * my, F.sum(w * x * x) / n - mx * mx, F.sum(w * y * y) / n - my * my
    s = cells.groupBy(*by).agg(F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("spearman"))
    return join_ns(g, s, by)


# ---- scaling and mixtures ----------------------------------------------------------------

def fit_scaler(df: DataFrame, features: Sequence[str], *, ts: str | None = None, start=None, end=None) -> DataFrame:
    """One row of mean_<f> and scale_<f> (population deviation, 1 for a constant).

    With a fit window, any row outside it fails the job instead of being dropped.
    """
    if ts is not None:
        inside = (C(ts) >= F.lit(start).cast("timestamp")) & (C(ts) < F.lit(end).cast("timestamp"))
        df = df.filter(F.when(inside, True).otherwise(F.raise_error(F.lit("row outside the fit window")).cast("boolean")))
    sd = {f: F.stddev_pop(f) for f in features}
    return df.agg(*[F.avg(f).alias(f"mean_{f}") for f in features], *[F.when(s == 0, 1.0).otherwise(s).alias(f"scale_{f}") for f, s in sd.items()])


def apply_scaler(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scaled columns ``z_<f>``; the one-row scaler enters as a scalar subquery."""
    row = scaler.select(F.struct("*").alias("s")).scalar()
    d = df.withColumn("_s", row)
    return d.select(*df.columns, *[((C(f) - C(f"_s.mean_{f}")) / C(f"_s.scale_{f}")).alias(f"z_{f}") for f in features])


def gmm_parameters(k: int, d: int) -> int:
    return k * d + k * d * (d + 1) // 2 + k - 1


MIXTURES = "k int, n long, log_likelihood double, bic double, aic double, min_occupancy double, iterations int, converged boolean"


def _fit_best(df: DataFrame, features: Sequence[str], ks: Sequence[int], n_init: int, seed: int, max_iter: int, tol: float, floor: float) -> list[tuple[EM.Mixture, dict]]:
    """For each k the likeliest of ``n_init`` starts and its diagnostics; all starts of all k share their passes."""
    if not all(2 <= k <= 10 for k in ks):
        raise ValueError("k must lie between 2 and 10")
    starts = [EM.Mixture(k, seed + i) for k in ks for i in range(n_init)]
    EM.fit_all(EM.vectors(df, features), starts, floor=floor, max_iter=max_iter, tol=tol)
    out = []
    for k in ks:
        m = max((x for x in starts if x.k == k), key=lambda x: x.logs[-1])
        p, ll = gmm_parameters(k, len(features)), m.log_likelihood
        out.append((m, dict(k=k, n=m.rows, log_likelihood=ll, bic=p * math.log(m.rows) - 2 * ll, aic=2 * p - 2 * ll, min_occupancy=float(m.occupancy.min() / m.rows),
                            iterations=m.iterations, converged=m.converged)))
    return out


def gmm_fit(df: DataFrame, features: Sequence[str], k: int, *, n_init: int = 5, seed: int = 42, max_iter: int = EM.MAX_ITER, tol: float = EM.TOLERANCE,
            floor: float = EM.FLOOR) -> tuple[EM.Mixture, dict]:
    """Best of ``n_init`` full-covariance fits; BIC, AIC, smallest occupancy of the hard labels, iterations and whether it converged."""
    return _fit_best(df, features, [k], n_init, seed, max_iter, tol, floor)[0]


def select_k(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 9), *, n_init: int = 5, seed: int = 42, max_iter: int = EM.MAX_ITER, tol: float = EM.TOLERANCE,
             floor: float = EM.FLOOR) -> DataFrame:
    """Diagnostics of the best fit for each k, best BIC first."""
    rows = [tuple(info.values()) for _, info in _fit_best(df, features, list(ks), n_init, seed, max_iter, tol, floor)]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[3]), MIXTURES)


def model_parameters(model: EM.Mixture) -> dict:
    """weights, means and precision Cholesky factors of a fitted mixture (model-sized)."""
    return model.parameters()


def frozen_gmm_score(df: DataFrame, features: Sequence[str], params: Mapping, prefix: str = "p_") -> DataFrame:
    """Posteriors and label from fixed parameters, as plain column arithmetic; nothing is fitted.

    ``features`` is the exact order of the parameters.  Rows with a null input get nulls.
    """
    d, k = len(features), len(params["weights"])
    logs = []
    for j in range(k):
        mu, pc = params["means"][j], params["precisions_cholesky"][j]
        quad = F.lit(0.0)
        for col in range(d):
            y = F.lit(0.0)
            for row in range(d):
                if pc[row][col]:
                    y = y + (C(features[row]) - float(mu[row])) * float(pc[row][col])
            quad = quad + F.pow(y, 2)
        const = sum(math.log(pc[i][i]) for i in range(d)) - d / 2 * math.log(2 * math.pi) + math.log(params["weights"][j])
        logs.append(F.lit(const) - quad / 2)
    # lambdas bind the component densities once; plain references would repeat them in every posterior
    def posterior(l):
        top = F.array_max(l)
        total = F.aggregate(l, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.struct(F.transform(l, lambda x: F.exp(x - top) / total).alias("p"), (F.array_position(l, top) - 1).cast("int").alias("state"))
    ready = C(features[0]).isNotNull()
    for f in features[1:]:
        ready = ready & C(f).isNotNull()
    out = df.withColumn("_g", F.when(ready, F.transform(F.array(F.array(*logs)), posterior)[0]))
    return out.select(*df.columns, *[C("_g.p")[j].alias(f"{prefix}{j}") for j in range(k)], C("_g.state").alias("state"))


def assign_states(features_df: DataFrame, features: Sequence[str], params: Mapping, step: int, chunk_rows: int = 4096) -> DataFrame:
    """Scored bars with max, margin, entropy, age, bars since transition and posterior changes."""
    k = len(params["weights"])
    s = frozen_gmm_score(features_df.dropna(subset=list(features)), features, params)
    s = stage(s.withColumns(posterior_scores(F.array(*[C(f"p_{j}") for j in range(k)]))))
    moved = [*[f"p_{j}" for j in range(k)], "max_posterior", "entropy"]
    s = with_previous_state(s, step, chunk_rows=chunk_rows, carry=moved)
    return s.withColumns({f"delta_{c}": F.when(C("connected"), C(c) - C(f"previous_{c}")) for c in moved}).drop(*[f"previous_{c}" for c in moved])


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ("slice",)) -> DataFrame:
    """Adjusted Rand index from the contingency counts."""
    by = list(by)
    n = df.groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    rows = n.groupBy(*by, a).agg(F.sum("n").alias("r")).groupBy(*by).agg(F.sum(two(C("r"))).alias("sr"), F.sum("r").alias("total"))
    cols = n.groupBy(*by, b).agg(F.sum("n").alias("c")).groupBy(*by).agg(F.sum(two(C("c"))).alias("sc"))
    cell = n.groupBy(*by).agg(F.sum(two(C("n"))).alias("sn"))
    j = join_ns(join_ns(rows, cols, by), cell, by)
    expected = C("sr") * C("sc") / two(C("total"))
    best = (C("sr") + C("sc")) / 2
    return j.select(*by, C("total").cast("long").alias("n"), F.when(best == expected, 1.0).otherwise((C("sn") - expected) / (best - expected)).alias("ari"))


def label_stability(df: DataFrame, features: Sequence[str], k: int, *, order: Sequence[str], seeds: Sequence[int] = range(5), slices: int = 4,
                    n_init: int = 5, max_iter: int = EM.MAX_ITER, tol: float = EM.TOLERANCE, floor: float = EM.FLOOR) -> DataFrame:
    """ARI of each pair of seeds, overall (scope ALL) and per chronological slice, and of fits on single slices (scope FIT_i) with the first seed's labels.

    Every fit labels all rows; all fits share their passes. Rows with a missing input are left out before the slices are cut.
    """
    d = number_rows(df.dropna(subset=list(features)), list(order))
    n = d.agg(F.count("*")).scalar()
    d = d.withColumn("slice", F.least(F.floor(C("idx") * slices / n), F.lit(slices - 1)).cast("int"))
    rows = EM.vectors(d, features, "slice")
    seeds = list(seeds)
    starts = [[EM.Mixture(k, 1000 * s + i, part) for i in range(n_init)] for part, s in [*((None, s) for s in seeds), *((i, seeds[0]) for i in range(slices))]]
    EM.fit_all(rows, [m for some in starts for m in some], floor=floor, max_iter=max_iter, tol=tol)
    best = [max(some, key=lambda m: m.logs[-1]) for some in starts]
    out = stage(EM.labelled(rows, best, [*[f"s{s}" for s in seeds], *[f"f{i}" for i in range(slices)]]))
    pair = lambda a, b, x, y, scopes: F.struct(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), C(x).alias("a"), C(y).alias("b"), F.array(*scopes).alias("scopes"))
    pairs = [pair(a, b, f"s{a}", f"s{b}", [F.lit("ALL"), C("slice").cast("string")]) for i, a in enumerate(seeds) for b in seeds[i + 1:]]
    fits = [pair(seeds[0], seeds[0], f"s{seeds[0]}", f"f{i}", [F.lit(f"FIT_{i}")]) for i in range(slices)]
    long = out.select(F.explode(F.array(*pairs, *fits)).alias("i")).select("i.seed_a", "i.seed_b", "i.a", "i.b", F.explode("i.scopes").alias("scope"))
    return adjusted_rand(long, "a", "b", ["seed_a", "seed_b", "scope"])


def posterior_confidence(scored: DataFrame, value: str = "max_posterior", state: str = "state", period: Column | None = None) -> DataFrame:
    """Distribution of the maximum posterior overall, per state and per period."""
    s = lambda name, key: F.struct(F.lit(name).alias("scope"), key.cast("string").alias("scope_key"))
    scopes = [s("ALL", F.lit("ALL")), s("STATE", C(state))] + ([s("PERIOD", period)] if period is not None else [])
    d = scored.withColumn("_s", F.explode(F.array(*scopes))).select("_s.*", value)
    return outcome_distribution(d, ["scope", "scope_key"], value, {"p10": 0.1, "median": 0.5, "p90": 0.9}).select(
        "scope", "scope_key", "n", "mean", "median", "p10", "p90", "minimum")


def replay_parity(saved: DataFrame, again: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Mismatch counts per column between stored and recomputed rows (nulls must agree)."""
    r = again.select(*keys, *[C(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_here"))
    l = saved.select(*keys, *columns, F.lit(True).alias("_there"))
    j = l.join(r, list(keys), "full_outer")
    def same(c):
        if dict(saved.dtypes)[c] in ("double", "float"):
            return (C(c).isNull() & C(f"_{c}").isNull()) | F.coalesce(F.abs(C(c) - C(f"_{c}")) <= tolerance, F.lit(False))
        return C(c).eqNullSafe(C(f"_{c}"))
    both = C("_here").isNotNull() & C("_there").isNotNull()
    return j.agg(flag_count(both).alias("compared"), flag_count(~both).alias("unpaired"), *[flag_count(both & ~same(c)).alias(f"diff_{c}") for c in columns])


# ---- diagnosis of missing vectors ----------------------------------------------------------

# fixed values: timeframe and look-back (completed bars) each state input needs
REQUIREMENTS = {"er_4": ("M15", 5), "er_16": ("M15", 17), "rv_16": ("M15", 17), "atr_change_1": ("M15", 16), "atr_change_8": ("M15", 23),
                "slope_atr_4": ("M15", 15), "slope_atr_16": ("M15", 16), "range_pos_16": ("M15", 17), "h1_er_8": ("H1", 9),
                "h1_atr_change_4": ("H1", 19), "h1_slope_atr_8": ("H1", 15), "h3_er_8": ("H3", 9), "h3_atr_change_4": ("H3", 19), "h3_slope_atr_8": ("H3", 15)}


def missing_vector_diagnosis(trades: DataFrame, features: DataFrame, gaps: DataFrame, step: int, *, entry: str = "entry_ts",
                             requirements: Mapping[str, tuple[str, int]] = REQUIREMENTS) -> DataFrame:
    """Why a trade has no complete vector at its boundary, with neighbours shown after classification.

    ``features``: symbol, seg, ts (bar close) and the inputs; ``gaps``: symbol, previous_ts,
    next_ts of bar opens.
    """
    from barloom.operators.joins import asof_join
    names = list(requirements)
    missing = F.array_compact(F.array(*[F.when(C(n).isNull(), F.lit(n)) for n in names]))
    f = features.select("symbol", "seg", "ts", missing.alias("missing"))
    starts = f.groupBy("symbol", "seg").agg((F.min(F.unix_seconds("ts")) - step).alias("start_s"))
    first = starts.groupBy("symbol").agg(F.min("start_s").alias("first_s"))
    g = gaps.select("symbol", F.unix_seconds("next_ts").alias("start_s"), C("previous_ts").alias("gap_from"))
    seg = starts.join(first, "symbol").join(g, ["symbol", "start_s"], "left")
    required = F.timestamp_seconds(F.floor(F.unix_seconds(entry) / F.lit(step)) * step)
    t = trades.withColumn("required_ts", required)
    j = t.join(f.withColumnRenamed("ts", "required_ts").withColumn("_row", F.lit(True)), ["symbol", "required_ts"], "left").join(seg, ["symbol", "seg"], "left")
    r = F.unix_seconds("required_ts")
    aligned = lambda s: F.ceil(C("start_s") / F.lit(s)) * s
    done = {"M15": F.floor((r - C("start_s")) / F.lit(step)), "H1": F.greatest(F.lit(0), F.floor((r - aligned(3600)) / F.lit(3600))),
            "H3": F.greatest(F.lit(0), F.floor((r - aligned(10800)) / F.lit(10800)))}
    j = j.withColumns({f"completed_{k.lower()}": F.when(C("_row"), v) for k, v in done.items()})
    need = lambda x: F.element_at(F.create_map(*[y for n, (tf, k) in requirements.items() for y in (F.lit(n), C(f"completed_{tf.lower()}") < k)]), x)
    j = j.withColumn("shortfall", F.filter("missing", lambda x: need(x)))
    warm = (F.size("missing") > 0) & (F.size("shortfall") == F.size("missing"))
    opened = F.timestamp_seconds("start_s")
    weekly = C("gap_from").isNotNull() & (F.weekday("gap_from") == 4) & F.weekday(opened).isin(6, 0)
    # a boundary inside a source gap: the newest gap start before the bar has not ended yet
    source = F.timestamp_seconds(F.unix_seconds("required_ts") - step)
    j = asof_join(j.withColumn("_open", source), gaps.select("symbol", "previous_ts", "next_ts"), ["symbol"], ["previous_ts", "next_ts"],
                  left_ts="_open", right_ts="previous_ts", prefix="gap_")
    in_gap = (C("gap_previous_ts") < C("_open")) & (C("_open") < C("gap_next_ts"))
    reason = (F.when(C("_row") & (F.size("missing") == 0), "MATCHED").when(C("_row") & warm, F.when(weekly, "WEEKLY_SEGMENT_WARMUP").when(
        C("gap_from").isNotNull(), "MIDWEEK_SEGMENT_WARMUP").otherwise("INITIAL_SEGMENT_WARMUP")).when(C("_row"), "SPECIFIC_FEATURE_INCOMPLETE")
        .when(in_gap, "SOURCE_BAR_GAP").otherwise("NO_FEATURE_ROW_AT_BOUNDARY"))
    j = j.withColumn("reason", reason)
    there = f.withColumnRenamed("ts", "row_ts")
    before = asof_join(j.withColumn("_b", C("required_ts") - F.expr("INTERVAL 1 MICROSECOND")), there, ["symbol"], ["row_ts"], left_ts="_b", right_ts="row_ts", prefix="previous_")
    both = asof_join(before.withColumn("_a", C("required_ts") + F.expr("INTERVAL 1 MICROSECOND")), there, ["symbol"], ["row_ts"], left_ts="_a", right_ts="row_ts", direction="forward", prefix="next_")
    return both.drop("_row", "_open", "_a", "_b", "gap_previous_ts", "gap_next_ts", "first_s")


def warmup_trace(trades: DataFrame, indexed: DataFrame, step: int, *, hours: int = 3, period: int = 14, lag: int = 4, entry: str = "entry_ts",
                 chunk_rows: int = 4096) -> DataFrame:
    """Per entry: completed higher bars in its segment, ATR now and ``lag`` bars ago, shortfall and reason."""
    from barloom.operators import windows as X
    from barloom.operators.timeline import chunked, index_bars
    seconds = hours * 3600
    hi = index_bars(X.resample_complete(indexed, step, seconds), seconds, parent="seg")
    def fn(d, w):
        d = d.withColumn("true_range", X.true_range(w))
        d = d.withColumn("atr", X.wilder_atr(w, period))
        return d.withColumn("atr_lag", X.after(lag, F.lag("atr", lag).over(w)))
    hi = chunked(hi, fn, X.atr_back(period) + lag, 0, chunk_rows).select(
        "symbol", "seg", F.unix_seconds("ts").alias("_hs"), (C("seg_pos") + 1).alias("completed"), "atr", "atr_lag")
    need = period + lag + 1
    at = F.floor(F.unix_seconds(entry) / F.lit(step)) * step
    b = indexed.select("symbol", "seg", (F.unix_seconds("ts") + step).alias("_at"), "seg_pos")
    t = trades.withColumn("_at", at).join(b, ["symbol", "_at"], "left")
    t = t.withColumn("_hs", F.floor(C("_at") / F.lit(seconds)) * seconds - seconds).join(hi, ["symbol", "seg", "_hs"], "left")
    done = F.coalesce("completed", F.lit(0))
    reason = (F.when(C("seg").isNull(), "NO_SOURCE_BAR").when(done == 0, "NO_COMPLETE_HIGHER_BAR").when(C("atr").isNull(), "ATR_CURRENT_AND_LAG_NOT_SEEDED")
              .when(C("atr_lag").isNull(), "LAGGED_ATR_NOT_SEEDED").otherwise("READY"))
    return t.select(*trades.columns, (C("seg_pos") + 1).alias("source_bars"), F.when(C("seg").isNotNull(), done).alias("completed_bars"),
                    F.when(C("seg").isNotNull(), F.greatest(F.lit(0), need - done)).alias("shortfall"), "atr", "atr_lag", reason.alias("reason"))
