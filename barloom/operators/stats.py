"""Cohort statistics, rank effects, scans, distribution comparisons and state studies."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.timeline import running
from barloom.sources.stage import stage

C = F.col


def flag_count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def join_ns(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; null is a group of its own here."""
    r = right.withColumnsRenamed({k: f"_ns_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_ns_{k}"]) for k in keys])
    return left.join(r, on, how).drop(*[f"_ns_{k}" for k in keys])


# ---- ranks and quantiles that no single task has to hold -------------------------------

def value_ranks(df: DataFrame, by: Sequence[str], value: str, weights: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct values per group with weights ``w``, weight below ``lt_w`` and total ``tot_w``.

    Equal values are pre-aggregated, so ties cost one row. The distinct values are range-partitioned over all groups and staged, so that parts are
    balanced whatever a group's size; ranks are part-local running sums plus the totals of the group's earlier parts.
    """
    by = list(by)
    weights = weights or {"n": F.lit(1)}
    names = list(weights)
    d = (df.filter(C(value).isNotNull()).withColumn("_v", C(value).cast("double"))
         .groupBy(*by, "_v").agg(*[F.sum(w).cast("long").alias(k) for k, w in weights.items()]))
    d = stage(d.repartitionByRange(*by, "_v").withColumn("_b", F.spark_partition_id()))
    inner = W.partitionBy(*by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*by)
    before = group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*by, "_b").agg(*[F.sum(k).alias(f"_t_{k}") for k in names])
    totals = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names],
                           *[F.sum(f"_t_{k}").over(group).alias(f"tot_{k}") for k in names])
    d = d.select("*", *[F.coalesce(F.sum(k).over(inner), F.lit(0)).alias(f"_i_{k}") for k in names])
    return join_ns(d, totals, [*by, "_b"]).select(
        *by, "_v", *names, *[(C(f"_i_{k}") + C(f"_o_{k}")).alias(f"lt_{k}") for k in names], *[f"tot_{k}" for k in names])


def rank_quantile(p: float, w: str = "n") -> Column:
    """Linear-interpolated quantile as an aggregate over ``value_ranks`` rows."""
    k = (C(f"tot_{w}") - 1) * F.lit(p)
    at = lambda r: F.max(F.when((C(f"lt_{w}") <= r) & (r < C(f"lt_{w}") + C(w)), C("_v")))
    lo, hi = at(F.floor(k)), at(F.ceil(k))
    return lo + F.max(k - F.floor(k)) * (hi - lo)


def weighted_mean(w: str = "n") -> Column:
    return F.when(F.max(f"tot_{w}") > 0, F.sum(C("_v") * C(w)) / F.max(f"tot_{w}"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    return value_ranks(df, by, value).groupBy(*by).agg(*[rank_quantile(p).alias(k) for k, p in probs.items()])


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def outcome_distribution(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float] = QUARTILES) -> DataFrame:
    """n, observed, missing, extremes, quantiles, mean, deviation, sign counts and fractions per group."""
    v = C(value).cast("double")
    seen = F.count(v)
    base = df.groupBy(*by).agg(
        F.count("*").alias("n"), seen.alias("observed"), (F.count("*") - seen).alias("missing"), F.min(v).alias("minimum"),
        F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.when(seen > 1, F.stddev_samp(v)).alias("standard_deviation"),
        *[flag_count(c).alias(f"{k}_count") for k, c in (("negative", v < 0), ("zero", v == 0), ("positive", v > 0))])
    for k in ("negative", "zero", "positive"):
        base = base.withColumn(f"{k}_fraction", F.when(C("observed") > 0, C(f"{k}_count") / C("observed")))
    return join_ns(base, quantiles(df, by, value, probs), by, "left")


def unpivot_targets(df: DataFrame, ids: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Long form (ids, target, value); nulls stay rows."""
    items = F.array(*[F.struct(F.lit(t).alias("target"), C(f"`{t}`").cast("double").alias("value")) for t in targets])
    return df.select(*ids, F.explode(items).alias("_t")).select(*ids, "_t.target", "_t.value")


# ---- cohorts -----------------------------------------------------------------------------

def event_cohort(kind: Column, pattern: Column, checkpoint: Column) -> Column:
    """Cohort key of an event; any other combination fails the job."""
    touch = (kind == "TOUCH_TRANSITION") & pattern.isNotNull() & checkpoint.isNull()
    quiet = (kind == "UNTOUCHED_CHECKPOINT") & pattern.isNull() & checkpoint.isNotNull()
    return (F.when(touch, F.concat(F.lit("TOUCH|"), pattern)).when(quiet, F.concat(F.lit("UNTOUCHED|"), checkpoint.cast("string")))
            .otherwise(F.raise_error(F.lit("invalid event fields")).cast("string")))


def conditioned_cohorts(df: DataFrame, event: str, fields: Sequence[str], target: str) -> DataFrame:
    """Distribution per event and condition values; null is its own group."""
    return outcome_distribution(df, [event, *fields], target)


def numeric_bins(value: str, cuts: Sequence[float]) -> dict[str, Column]:
    """Left-closed bins with bounds; nulls go to bin -1."""
    v = C(f"`{value}`").cast("double")
    index = F.when(v.isNull(), -1)
    for i, c in enumerate(cuts):
        index = index.when(v < c, i)
    index = index.otherwise(len(cuts))
    edge = F.array(*[F.lit(float(c)) for c in cuts])
    return {"bin_index": index, "missing": v.isNull(), "lower_bound": F.when(index > 0, F.get(edge, index - 1)),
            "upper_bound": F.when((index >= 0) & (index < len(cuts)), F.get(edge, index))}


# ---- two-cohort comparisons -----------------------------------------------------------------

def compare_weighted(df: DataFrame, by: Sequence[str], value: str = "value", left: str = "l", right: str = "r") -> DataFrame:
    """Rank-sum comparison of two cohorts per group from row weights ``l`` and ``r``.

    greater / tie / less pair counts, P(superiority), Cliff's delta, means and medians all
    come from one pass over distinct values; no pair of rows is ever formed.
    """
    counts = df.groupBy(*by).agg(F.sum(left).cast("long").alias("left_rows"), F.sum(right).cast("long").alias("right_rows"))
    ranks = value_ranks(df, by, value, {"l": C(left), "r": C(right)})
    pairs = (F.max("tot_l") * F.max("tot_r")).cast("double")
    greater, ties = F.sum(C("l") * C("lt_r")).cast("double"), F.sum(C("l") * C("r")).cast("double")
    g = ranks.groupBy(*by).agg(
        F.max("tot_l").alias("left_observed"), F.max("tot_r").alias("right_observed"), weighted_mean("l").alias("left_mean"),
        weighted_mean("r").alias("right_mean"), rank_quantile(0.5, "l").alias("left_median"), rank_quantile(0.5, "r").alias("right_median"),
        pairs.alias("pair_count"), greater.alias("greater"), ties.alias("ties"))
    out = join_ns(counts, g, by, "left").withColumns({
        "less": C("pair_count") - C("greater") - C("ties"), "mean_difference": C("left_mean") - C("right_mean"),
        "median_difference": C("left_median") - C("right_median")})
    some = C("pair_count") > 0
    return out.withColumns({"superiority": F.when(some, (C("greater") + C("ties") / 2) / C("pair_count")),
                            "cliffs_delta": F.when(some, (C("greater") - C("less")) / C("pair_count"))})


def compare_cohorts(df: DataFrame, by: Sequence[str], is_left: Column, value: str) -> DataFrame:
    """Two disjoint cohorts: rows where ``is_left`` is true against rows where it is false."""
    d = df.select(*by, C(f"`{value}`").cast("double").alias("value"), F.when(is_left, 1).otherwise(0).alias("l"),
                  F.when(~is_left, 1).otherwise(0).alias("r"))
    return compare_weighted(d, by)


def long_conditions(df: DataFrame, event: str, fields: Sequence[str], targets: Sequence[str], row: str | None = None) -> DataFrame:
    """(event, target, value, conds) with conds = array of (field, text of the typed value)."""
    kinds = {f: t for f, t in df.dtypes}
    cond = F.array(*[F.struct(F.lit(f).alias("field"), F.when(C(f"`{f}`").isNotNull(), F.to_json(F.array(
        F.lit(kinds[f]), C(f"`{f}`").cast("string")))).otherwise(F.lit("null")).alias("cond")) for f in fields])
    return unpivot_targets(df.withColumn("conds", cond), [event, "conds"], targets)


LOOKUP = 4096  # ranks of a bucket in which a rank is looked up


def values_at(ranks: DataFrame, asked: DataFrame, by: Sequence[str]) -> DataFrame:
    """``asked`` (by, rank, ...) with the value that holds the 0-based rank, by rank buckets; ``ranks`` are ``value_ranks`` rows."""
    span = F.sequence(F.floor(C("lt_n") / LOOKUP), F.floor((C("lt_n") + C("n") - 1) / LOOKUP))
    held = ranks.select(*by, "_v", "lt_n", "n", F.explode(span).alias("_at"))
    j = join_ns(asked.withColumn("_at", F.floor(C("rank") / LOOKUP)), held, [*by, "_at"])
    return j.filter((C("lt_n") <= C("rank")) & (C("rank") < C("lt_n") + C("n"))).drop("_at", "lt_n", "n")


def compare_rest(cells: DataFrame, universe: Sequence[str], cond: Sequence[str]) -> DataFrame:
    """Each condition of a universe against the universe's other rows, from counts ``n`` per (universe, condition, value).

    One rank index of the universe serves all its conditions: what lies below a value in the complement is what lies below it in the universe
    less what lies below it in the condition, so no count is ever copied to another condition. The complement's median is the universe's value
    at that rank, moved up by the condition's own values before it.
    """
    universe, own = list(universe), [*universe, *cond]
    cells = stage(cells.select(*own, "value", "n"))
    weight = {"n": C("n")}
    every = stage(value_ranks(cells, universe, "value", weight))
    mine = value_ranks(cells, own, "value", weight).withColumnsRenamed({"n": "_n", "lt_n": "_lt", "tot_n": "_own"})
    j = join_ns(mine, every, [*universe, "_v"])
    below, rest = C("lt_n") - C("_lt"), C("tot_n") - C("_own")
    k = {"lo": F.floor((rest - 1) / 2), "hi": F.ceil((rest - 1) / 2)}
    m = (C("_own") - 1) * 0.5
    at = lambda r: F.max(F.when((C("_lt") <= r) & (r < C("_lt") + C("_n")), C("_v")))
    g = j.groupBy(*own).agg(
        F.max("_own").alias("left_observed"), F.sum(C("_v") * C("_n")).alias("_sum"), (at(F.floor(m)) + F.max(m - F.floor(m)) * (at(F.ceil(m)) - at(F.floor(m)))).alias("left_median"),
        F.sum(C("_n") * below).cast("double").alias("greater"), F.sum(C("_n") * (C("n") - C("_n"))).cast("double").alias("ties"),
        *[F.coalesce(F.sum(F.when(below <= r, C("_n"))), F.lit(0)).alias(f"_{s}") for s, r in k.items()])
    whole = cells.groupBy(*universe).agg(F.sum("n").alias("_rows"), F.sum(F.when(C("value").isNotNull(), C("n"))).alias("_tot"), F.sum(C("value") * C("n")).alias("_all"))
    out = join_ns(join_ns(cells.groupBy(*own).agg(F.sum("n").alias("left_rows")), whole, universe), g, own, "left")
    none = F.when(C("_tot").isNotNull(), 0)
    out = stage(out.withColumns({"right_rows": C("_rows") - C("left_rows"), "left_observed": F.coalesce("left_observed", none).cast("long"), "greater": F.coalesce("greater", none.cast("double")),
                                 "ties": F.coalesce("ties", none.cast("double"))}).withColumn("right_observed", C("_tot") - C("left_observed")).filter("right_rows > 0"))
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("end"), (r((C("right_observed") - 1) / 2) + F.coalesce(f"_{s}", F.lit(0))).alias("rank")) for s, r in (("lo", F.floor), ("hi", F.ceil))]))
    asked = out.filter("right_observed > 0").select(*own, ends.alias("_e")).select(*own, "_e.*")
    middle = values_at(every, asked, universe).groupBy(*own).agg(F.avg("_v").alias("right_median"))
    some = C("pair_count") > 0
    out = join_ns(out, middle, own, "left").withColumns({
        "left_mean": F.when(C("left_observed") > 0, C("_sum") / C("left_observed")),
        "right_mean": F.when(C("right_observed") > 0, (C("_all") - F.coalesce("_sum", F.lit(0.0))) / C("right_observed")),
        "pair_count": (C("left_observed") * C("right_observed")).cast("double")})
    out = out.withColumns({"less": C("pair_count") - C("greater") - C("ties"), "mean_difference": C("left_mean") - C("right_mean"), "median_difference": C("left_median") - C("right_median")})
    return out.withColumns({"superiority": F.when(some, (C("greater") + C("ties") / 2) / C("pair_count")), "cliffs_delta": F.when(some, (C("greater") - C("less")) / C("pair_count"))}).select(
        *own, "left_rows", "right_rows", "left_observed", "right_observed", "left_mean", "right_mean", "left_median", "right_median", "pair_count", "greater", "ties", "less",
        "mean_difference", "median_difference", "superiority", "cliffs_delta")


def scan_single(df: DataFrame, event: str, fields: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Every condition value against its same-event complement, for every target.

    Rows are counted once per (event, target, field, condition, value); complements come by subtraction, so any number of conditions is linear.
    """
    cells = (long_conditions(df, event, fields, targets).select(C(event).alias("event"), "target", "value", F.explode("conds").alias("c"))
             .groupBy("event", "target", "c.field", "c.cond", "value").agg(F.count("*").alias("n")))
    return compare_rest(cells, ["event", "field", "target"], ["cond"])


def scan_pairs(df: DataFrame, event: str, fields: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Joint condition pairs against the event rest, left-only and right-only rows.

    The same counting as ``scan_single`` on pairs of fields; ``versus`` names the baseline, whose rows are the universe: the event, or the rows
    that share the left or the right condition.
    """
    two = F.flatten(F.transform("conds", lambda a: F.transform(F.filter("conds", lambda b: b["field"] > a["field"]), lambda b: F.struct(
        a["field"].alias("f"), b["field"].alias("g"), a["cond"].alias("a"), b["cond"].alias("b")))))
    cells = (long_conditions(df, event, sorted(fields), targets).select(C(event).alias("event"), "target", "value", F.explode(two).alias("c"))
             .groupBy("event", "target", "c.f", "c.g", "c.a", "c.b", "value").agg(F.count("*").alias("n")))
    # the part of the pair that a baseline shares is its universe's; null is no condition text
    item = lambda name, a, b: F.struct(F.lit(name).alias("versus"), a.alias("ua"), b.alias("ub"))
    null = F.lit(None).cast("string")
    each = F.explode(F.array(item("EVENT", null, null), item("LEFT", C("a"), null), item("RIGHT", null, C("b"))))
    cells = cells.withColumn("_u", each).select("*", "_u.*")
    return compare_rest(cells, ["event", "f", "g", "target", "versus", "ua", "ub"], ["a", "b"]).drop("ua", "ub")


def pair_candidates(pairs: DataFrame) -> DataFrame:
    """One row per pair with the three comparisons as structs (null baseline when empty)."""
    key = ["event", "f", "g", "a", "b", "target"]
    side = lambda v: F.max(F.when(C("versus") == v, F.struct("cliffs_delta", "pair_count", "left_rows", "right_rows", "left_observed", "right_observed"))).alias(f"vs_{v.lower()}")
    return pairs.groupBy(*key).agg(side("EVENT"), side("LEFT"), side("RIGHT")).filter("vs_event is not null")


def rank_candidates(single: DataFrame, pairs: DataFrame | None = None, *, top_k: int | None = None, minimum_rows: int = 1,
                    minimum_observed: int = 1, minimum_pairs: int = 1, minimum_delta: float = 0.0,
                    require_baselines: bool = True) -> DataFrame:
    """Candidates by the weakest of their comparisons; ordered by a total key, top k is a report limit."""
    comp = F.struct("cliffs_delta", "pair_count", "left_rows", "right_rows", "left_observed", "right_observed")
    s = single.select(F.lit("SINGLE").alias("kind"), "event", "target", F.concat_ws("=", "field", "cond").alias("condition"), F.array(comp).alias("cs"))
    if pairs is not None:
        p = pair_candidates(pairs)
        if require_baselines:
            p = p.filter("vs_left is not null and vs_right is not null")
        s = s.unionByName(p.select(F.lit("INTERACTION").alias("kind"), "event", "target",
                                   F.concat_ws("&", F.concat_ws("=", "f", "a"), F.concat_ws("=", "g", "b")).alias("condition"),
                                   F.array_compact(F.array("vs_event", "vs_left", "vs_right")).alias("cs")))
    ok = F.forall("cs", lambda c: (c["left_rows"] >= minimum_rows) & (c["right_rows"] >= minimum_rows) & (c["left_observed"] >= minimum_observed)
                  & (c["right_observed"] >= minimum_observed) & (c["pair_count"] >= minimum_pairs) & c["cliffs_delta"].isNotNull())
    low = lambda f: F.array_min(F.transform("cs", f))
    r = s.filter(ok).select("kind", "event", "target", "condition", low(lambda c: F.abs(c["cliffs_delta"])).alias("score"),
                            low(lambda c: c["pair_count"]).alias("min_pairs"),
                            low(lambda c: F.least(c["left_observed"], c["right_observed"])).alias("min_observed"))
    r = r.filter(C("score") >= minimum_delta).orderBy(F.desc(F.round("score", 12)), F.desc("min_pairs"), F.desc("min_observed"), "event", "target",
                                                      F.desc("kind"), "condition")
    return r.limit(top_k) if top_k else r


# ---- effects and drift ---------------------------------------------------------------------

def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = C(f"`{value}`").cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                               F.when(F.count(v) > 1, F.var_samp(v)).alias("variance"))


def cohens_d(n1, m1, v1, n0, m0, v0) -> Column:
    """Pooled sample-deviation effect; null below two rows or zero spread."""
    pooled = ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
    return F.when((n1 >= 2) & (n0 >= 2) & (pooled > 0), (m1 - m0) / F.sqrt(pooled))


def pairwise_effects(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Mean and median differences and Cohen's d for every pair of groups, from per-group summaries."""
    m = join_ns(moments(df, [*by, group], value), quantiles(df, [*by, group], value, {"median": 0.5}), [*by, group], "left")
    side = lambda s: m.select(*by, C(group).alias(s), *[C(c).alias(f"{s}_{c}") for c in ("n", "mean", "variance", "median")])
    j = side("a").join(side("b"), list(by)).filter("a < b")
    return j.select(*by, "a", "b", C("a_n"), C("b_n"), (C("a_mean") - C("b_mean")).alias("mean_difference"),
                    (C("a_median") - C("b_median")).alias("median_difference"),
                    cohens_d(C("a_n"), C("a_mean"), C("a_variance"), C("b_n"), C("b_mean"), C("b_variance")).alias("cohens_d"))


def loss_win_effects(df: DataFrame, by: Sequence[str], is_loss: Column, value: str) -> DataFrame:
    """Loss minus win: mean, median, Cliff's delta and Hedges' g per group."""
    c = compare_cohorts(df, by, is_loss, value)
    m = moments(df.withColumn("_side", is_loss), [*by, "_side"], value)
    one = lambda flag, s: m.filter(C("_side") == flag).select(*by, C("n").alias(f"{s}_n"), C("variance").alias(f"{s}_v"))
    j = join_ns(join_ns(c, one(True, "x"), by, "left"), one(False, "y"), by, "left")
    d = cohens_d(C("x_n"), C("left_mean"), C("x_v"), C("y_n"), C("right_mean"), C("y_v"))
    df_ = C("x_n") + C("y_n") - 2
    return j.withColumn("hedges_g", (1 - 3 / (4 * df_ - 1)) * d).drop("x_n", "x_v", "y_n", "y_v")


def distribution_drift(df: DataFrame, by: Sequence[str], is_after: Column, value: str) -> DataFrame:
    """After minus before: mean, median, IQR, equal-weight standardised difference and empirical KS."""
    d = df.select(*by, C(f"`{value}`").cast("double").alias("value"), F.when(is_after, 1).otherwise(0).alias("r"),
                  F.when(is_after, 0).otherwise(1).alias("l"))
    ranks = value_ranks(d, by, "value", {"l": C("l"), "r": C("r")})
    cdf = lambda w: (C(f"lt_{w}") + C(w)) / C(f"tot_{w}")
    iqr = lambda w: rank_quantile(0.75, w) - rank_quantile(0.25, w)
    g = ranks.groupBy(*by).agg(
        F.max("tot_l").alias("before_n"), F.max("tot_r").alias("after_n"), (weighted_mean("r") - weighted_mean("l")).alias("mean_difference"),
        (rank_quantile(0.5, "r") - rank_quantile(0.5, "l")).alias("median_difference"), (iqr("r") - iqr("l")).alias("iqr_difference"),
        F.max(F.abs(cdf("l") - cdf("r"))).alias("ks"))
    v = lambda w: F.var_samp(F.when(C(w) == 1, C("value")))
    s = d.groupBy(*by).agg(F.sqrt((v("l") + v("r")) / 2).alias("_sd"))
    return join_ns(g, s, by).withColumn("standardized_mean_difference", F.when(C("_sd") > 0, C("mean_difference") / C("_sd"))).drop("_sd")


def expectancy_decomposition(df: DataFrame, is_after: Column, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact symmetric split of the expectancy change into win probability, winner and loser parts."""
    v = C(value).cast("double")
    def part(cond, s):
        x = F.when(cond, v)
        return [F.avg(x).alias(f"{s}_mean"), F.avg(F.when(cond & v.isNotNull(), (v > 0).cast("double"))).alias(f"{s}_wr"),
                F.avg(F.when(cond & (v > 0), v)).alias(f"{s}_win"), F.avg(F.when(cond & (v <= 0), v)).alias(f"{s}_loss")]
    g = df.groupBy(*by).agg(*part(~is_after, "a"), *part(is_after, "b"))
    p = (C("a_wr") + C("b_wr")) / 2
    return g.select(*by, (C("b_mean") - C("a_mean")).alias("change"),
                    ((C("b_wr") - C("a_wr")) * ((C("a_win") + C("b_win")) / 2 - (C("a_loss") + C("b_loss")) / 2)).alias("win_probability"),
                    (p * (C("b_win") - C("a_win"))).alias("average_winner"), ((1 - p) * (C("b_loss") - C("a_loss"))).alias("average_loser"))


# ---- state studies ---------------------------------------------------------------------------

def state_profile(df: DataFrame, state: str, features: Sequence[str]) -> DataFrame:
    """Occupancy and mean, median, p10, p90 of every feature per state."""
    long = unpivot_targets(df, [state], features).withColumnRenamed("target", "feature")
    stats = outcome_distribution(long, [state, "feature"], "value", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    n = df.groupBy(state).agg(F.count("*").alias("rows"))
    share = n.withColumn("occupancy", C("rows") / F.sum("rows").over(W.partitionBy(F.lit(0))))
    return stats.select(state, "feature", "mean", "median", "p10", "p90").join(share, state)


def yearly_occupancy(df: DataFrame, state: str, states: Sequence[int], period: Column) -> DataFrame:
    """Rows per period with one zero-filled column per state."""
    counts = [flag_count(C(state) == s).alias(f"state_{s}") for s in states]
    return df.groupBy(period.alias("period")).agg(*counts, F.count("*").alias("rows"))


def with_previous_state(states: DataFrame, step: int, state: str = "state", chunk_rows: int = 4096, carry: Sequence[str] = ()) -> DataFrame:
    """Previous connected state (exact step, same segment), age, bars since change and block id; ``carry`` adds previous_<column>."""
    both = F.struct(C("ts"), C(state).alias("s"), C("seg"), *carry)
    d = running(states, {"_p": ("prev", both)}, by=("symbol",), chunk_rows=chunk_rows)
    linked = F.coalesce((F.unix_seconds("ts") - F.unix_seconds("_p.ts") == step) & (C("_p.seg") == C("seg")), F.lit(False))
    d = d.withColumns({"connected": linked, "previous_state": F.when(linked, C("_p.s")),
                       **{f"previous_{c}": C(f"_p.{c}") for c in carry}}).drop("_p")
    change = C("connected") & (C("previous_state") != C(state))
    start, moved = ~C("connected"), ~C("connected") | change
    d = d.withColumns({"_start": F.when(start, C("pos")), "_run": F.when(moved, C("pos")), "_chg": F.when(change, C("pos"))})
    d = running(d, {"block_start": ("last", C("_start")), "run_start": ("last", C("_run")), "change_at": ("last", C("_chg"))},
                by=("symbol",), chunk_rows=chunk_rows)
    return d.withColumns({
        "state_age": C("pos") - C("run_start") + 1,
        "bars_since_transition": F.when(C("change_at") >= C("block_start"), C("pos") - C("change_at"))}).drop("_start", "_run", "_chg", "change_at")


def runs_of(states: DataFrame, state: str = "state") -> DataFrame:
    """Maximal runs of connected equal states (input: ``with_previous_state``)."""
    return states.groupBy("symbol", "run_start", state).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("length"))


def transition_matrix(states: DataFrame, state: str = "state") -> DataFrame:
    """Counts and row probabilities over connected pairs."""
    g = states.filter("connected").groupBy(C("previous_state").alias("from_state"), C(state).alias("to_state")).agg(F.count("*").alias("n"))
    return g.withColumn("probability", C("n") / F.sum("n").over(W.partitionBy("from_state")))


def run_length_stats(runs: DataFrame, matrix: DataFrame, minutes: int, state: str = "state") -> DataFrame:
    d = outcome_distribution(runs, [state], "length", {"median": 0.5, "p90": 0.9})
    stay = matrix.filter("from_state = to_state").select(C("from_state").alias(state), C("probability").alias("self_transition"))
    return d.select(state, C("n").alias("runs"), "mean", "median", "p90", "maximum",
                    (C("mean") * minutes).alias("mean_minutes")).join(stay, state, "left")


def future_summary(windows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per group and metric: distribution of the measured windows."""
    probs = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    long = unpivot_targets(windows.filter("exclusion is null"), list(by), metrics)
    return outcome_distribution(long, [*by, "target"], "value", probs).select(
        *by, C("target").alias("metric"), "observed", "mean", "standard_deviation", *probs)


def exclusion_counts(windows: DataFrame, by: Sequence[str], reasons: Sequence[str]) -> DataFrame:
    return windows.groupBy(*by).agg(*[flag_count(C("exclusion") == r).alias(r) for r in reasons], flag_count(C("exclusion").isNull()).alias("measured"))


def direction_counts(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    w = windows.filter("exclusion is null")
    g = w.groupBy(*by).agg(F.count("*").alias("n"), *[flag_count(C("direction") == d).alias(d.lower()) for d in ("UP", "DOWN", "FLAT")])
    return g.withColumns({f"{d}_fraction": C(d) / C("n") for d in ("up", "down", "flat")})


def hypothesis_check(summary: DataFrame, metrics: Sequence[str], state: str = "state") -> DataFrame:
    """Does state 0 have a larger mean than states 1 and 2, per horizon and metric."""
    p = summary.filter(C("metric").isin(list(metrics))).groupBy("horizon", "metric").pivot(state, [0, 1, 2]).agg(F.first("mean"))
    enough = C("0").isNotNull() & C("1").isNotNull() & C("2").isNotNull()
    yes = enough & (C("0") > C("1")) & (C("0") > C("2"))
    return p.select("horizon", "metric", C("0").alias("mean_0"), C("1").alias("mean_1"), C("2").alias("mean_2"),
                    F.when(yes, "YES").otherwise("NO").alias("criterion"), (~enough).alias("insufficient_evidence"))


def effect_ratios(effects: DataFrame) -> DataFrame:
    """|d(signed)| / |d(magnitude)| per horizon and state pair, undefined on a zero comparator."""
    p = effects.groupBy("horizon", "a", "b").pivot("metric", ["signed_return", "absolute_return", "realized_volatility"]).agg(F.first("cohens_d"))
    ratio = lambda m: F.when(C(m) != 0, F.abs(C("signed_return")) / F.abs(C(m)))
    return p.select("horizon", "a", "b", ratio("absolute_return").alias("absolute_return_ratio"), ratio("realized_volatility").alias("realized_volatility_ratio"))


def transition_study(outcomes: DataFrame, state: str = "state", states: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Per horizon for all rows and per state: stays, transitions, probability, destinations, exclusions."""
    reasons = ("gap_or_segment_boundary", "insufficient_future_observations", "period_end_boundary")
    g = outcomes.groupingSets([[C("horizon")], [C("horizon"), C(state)]], "horizon", state).agg(
        F.grouping(state).alias("_all"), flag_count(C("transition") == F.lit(False)).alias("n_stay"), flag_count(C("transition")).alias("n_transition"),
        *[flag_count(C("destination") == s).alias(f"to_{s}") for s in states], *[flag_count(C("exclusion") == r).alias(r) for r in reasons])
    n = C("n_stay") + C("n_transition")
    return g.select("horizon", F.when(C("_all") == 1, "ALL").otherwise(C(state).cast("string")).alias("scope"), "n_stay", "n_transition",
                    F.when(n > 0, C("n_transition") / n).alias("probability"),
                    *[F.when(C("n_transition") > 0, C(f"to_{s}") / C("n_transition")).alias(f"fraction_{s}") for s in states], *reasons)


def transition_comparisons(outcomes: DataFrame, predictors: Sequence[str], state: str = "state") -> DataFrame:
    """Transition against stay rows per horizon, scope and predictor: n, means, medians, Cohen's d."""
    d = outcomes.filter(C("transition").isNotNull()).withColumn("scope", F.explode(F.array(F.lit("ALL"), C(state).cast("string"))))
    return pairwise_effects(unpivot_targets(d, ["horizon", "scope", "transition"], predictors).withColumn(
        "side", F.when(C("transition"), "0_TRANSITION").otherwise("1_STAY")), ["horizon", "scope", "target"], "side", "value").drop("a", "b")


def observation_summary(states: DataFrame, runs: DataFrame, metric: str, by: str = "symbol", state: str = "state") -> DataFrame:
    """Blocks, connected pairs, runs and a metric's distribution per key."""
    a = states.groupBy(by).agg(F.countDistinct("block_start").alias("blocks"), flag_count(C("connected")).alias("pairs"),
                               flag_count(C("connected") & (C("previous_state") != C(state))).alias("changes"))
    r = runs.groupBy(by).agg(F.count("*").alias("runs"), F.avg("length").alias("mean_run"))
    m = outcome_distribution(states, [by], metric).select(by, "observed", "mean", "median", "q25", "q75")
    return a.join(r, by).join(m, by)


def feed_agreement(j: DataFrame, a: str = "state_a", b: str = "state_b", states: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Agreement of two state feeds over bars both have: counts, confusion cells, change Jaccard."""
    both = C(a).isNotNull() & C(b).isNotNull()
    cells = [flag_count(both & (C(a) == x) & (C(b) == y)).alias(f"c{x}{y}") for x in states for y in states]
    either, joint = C("change_a") | C("change_b"), C("change_a") & C("change_b")
    return j.groupBy("symbol").agg(flag_count(both).alias("both"), flag_count(C(b).isNull()).alias("only_a"), flag_count(C(a).isNull()).alias("only_b"),
                                   F.avg(F.when(both, (C(a) == C(b)).cast("double"))).alias("agreement"), *cells,
                                   (flag_count(both & joint) / F.nullif(flag_count(both & either), F.lit(0))).alias("change_jaccard"))


def coverage_reasons(unmatched: DataFrame, total: int | Column, reason: str = "reason", missing: str = "missing") -> tuple[DataFrame, DataFrame]:
    """Share of each reason and of each missing feature."""
    r = unmatched.groupBy(reason).agg(F.count("*").alias("n")).withColumn("share", C("n") / total)
    f = unmatched.withColumn("feature", F.explode(missing)).groupBy("feature").agg(F.count("*").alias("n")).withColumn("share", C("n") / total)
    return r, f
