"""Trade-ledger paths, summaries, concentration, sensitivity and criteria."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.functions.scalars import wilson_interval
from barloom.operators.stats import flag_count, join_ns, outcome_distribution, quantiles
from barloom.operators.timeline import number_rows, running

C = F.col
DAYS_PER_YEAR = 365.2425


def resolved(trades: DataFrame, value: str = "net_r") -> DataFrame:
    """Closed trades with a result, in no order."""
    return trades.filter((C("status") == "CLOSED") & C(value).isNotNull())


def resolved_path(trades: DataFrame, order: Sequence[str] = ("exit_ts", "trade_id"), value: str = "net_r", drop: Sequence[str] = ()) -> DataFrame:
    """Closed trades with a result, numbered in exit order (``idx``), without the columns ``drop``."""
    return number_rows(resolved(trades, value), order, drop=drop)


def _chunk(rows: int) -> Column:
    return F.floor(C("idx") / F.lit(rows))


def path_metrics(path: DataFrame, by: Sequence[str], value: str = "net_r", chunk_rows: int = 4096) -> DataFrame:
    """Maximum drawdown (peak floored at zero) and longest win and loss streak per group.

    A chunk of the path is reduced to its sum, extremes, inner drawdown and edge streaks;
    chunk rows combine by prefix sums, so the path is never scanned by one task. A path
    that comes with its chunk numbers (``_k``) keeps them, and its partitioning by them.
    """
    by = list(by)
    part = [*by, "_k"]
    v = C(value)
    inner = W.partitionBy(*part).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    d = path if "_k" in path.columns else path.withColumn("_k", _chunk(chunk_rows))
    d = d.select(*part, "idx", value).withColumns({"_eq": F.sum(v).over(inner), "_n": F.count("*").over(inner)})
    d = d.withColumns({"_peak": F.max("_eq").over(inner), "_lw": F.max(F.when(v > 0, None).otherwise(C("_n"))).over(inner),
                       "_ll": F.max(F.when(v < 0, None).otherwise(C("_n"))).over(inner)})
    zero = F.lit(0)
    k = d.groupBy(*part).agg(
        F.sum(v).alias("t"), F.count("*").alias("n"), F.min("_eq").alias("lo"), F.max("_eq").alias("hi"), F.max(C("_peak") - C("_eq")).alias("dd"),
        *[x for s, ok, last in (("w", v > 0, "_lw"), ("l", v < 0, "_ll")) for x in (
            F.max(C("_n") - F.coalesce(C(last), zero)).alias(f"best_{s}"), F.max(last).alias(f"last_{s}"),
            F.min(F.when(ok, None).otherwise(C("_n"))).alias(f"first_{s}"))])
    before = W.partitionBy(*by).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    k = k.withColumns({"_b": F.coalesce(F.sum("t").over(before), F.lit(0.0)), "_c": F.coalesce(F.sum("n").over(before), zero)})
    k = k.withColumns({"_h": F.greatest(F.lit(0.0), F.coalesce(F.max(C("_b") + C("hi")).over(before), F.lit(0.0))),
                       **{f"_p{s}": F.coalesce(F.max(C("_c") + C(f"last_{s}")).over(before), zero) for s in "wl"}})
    head = lambda s: C("_c") - C(f"_p{s}") + F.coalesce(C(f"first_{s}") - 1, C("n"))
    return k.groupBy(*by).agg(
        F.max(F.greatest("dd", C("_h") - (C("_b") + C("lo")), F.lit(0.0))).alias("max_drawdown_r"),
        *[F.max(F.greatest(C(f"best_{s}"), head(s))).alias(n) for s, n in (("w", "longest_win_streak"), ("l", "longest_loss_streak"))])


def drawdown_detail(path: DataFrame, by: Sequence[str] = ("ledger",), value: str = "net_r", chunk_rows: int = 4096) -> DataFrame:
    """Maximum drawdown with start, trough and recovery trade and the longest stretch below a peak.

    Trade counts include the zero start: position j is the equity after j trades.
    """
    from barloom.sources.stage import stage
    by = list(by)
    kw = dict(by=by, order="idx", chunk_rows=chunk_rows)
    eq = stage(running(path.select(*by, "idx", value), {"equity": ("sum", C(value))}, **kw).withColumn("j", C("idx") + 1))
    top = F.struct(C("equity").alias("e"), (-C("j")).alias("at"))
    start = F.struct(F.lit(0.0).alias("e"), F.lit(0).cast("long").alias("at"))
    d = running(eq, {"_top": ("max", top)}, **kw).withColumn("top", F.greatest(C("_top"), start))
    d = d.withColumns({"dd": C("top.e") - C("equity"), "peak_at": -C("top.at"), "below": C("j") + C("top.at")})
    g = d.groupBy(*by).agg(F.max("dd").alias("max_drawdown_r"), F.max_by(F.struct("j", "peak_at", C("top.e").alias("peak")), F.struct("dd", -C("j"))).alias("_m"),
                           F.max("below").alias("longest_duration"))
    none = C("max_drawdown_r") <= 0
    g = g.select(*by, F.when(none, 0.0).otherwise(C("max_drawdown_r")).alias("max_drawdown_r"), "longest_duration",
                 F.when(none, 0).otherwise(C("_m.j")).alias("trough"), F.when(none, 0).otherwise(C("_m.peak_at")).alias("start"), C("_m.peak").alias("_peak"))
    back = eq.join(g, by).filter((C("j") > C("trough")) & (C("equity") >= C("_peak"))).groupBy(*by).agg(F.min("j").alias("recovery"))
    return g.join(back, by, "left").drop("_peak")


def lag1_autocorrelation(path: DataFrame, by: Sequence[str] = ("ledger",), value: str = "net_r", chunk_rows: int = 4096) -> DataFrame:
    """Lag-1 correlation of R and of its sign; null below three trades or without variance."""
    d = running(path, {"_p": ("prev", C(value))}, by=list(by), order="idx", chunk_rows=chunk_rows).filter("_p is not null")
    ok = lambda a, b: (F.count("*") >= 2) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    sa, sb = F.signum("_p"), F.signum(value)
    return d.groupBy(*by).agg(F.when(ok(C("_p"), C(value)), F.corr("_p", value)).alias("lag1_r"), F.when(ok(sa, sb), F.corr(sa, sb)).alias("lag1_outcome"))


def resolved_rates(trades: DataFrame, by: Sequence[str] = ("ledger",), value: str = "net_r") -> DataFrame:
    """Counts, sums, profit factor, frequency and rates of resolved trades: one pass over them in any order."""
    v = C(value)
    at = F.unix_micros(C("exit_ts").cast("timestamp"))
    days = (F.max(at) - F.min(at)) / 86_400_000_000
    years = F.when(F.count("*") > 1, F.greatest(F.lit(1.0), days)).otherwise(DAYS_PER_YEAR) / DAYS_PER_YEAR
    gain, loss = F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)), F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0))
    g = trades.groupBy(*by).agg(
        F.count("*").alias("resolved_trades"), flag_count(v > 0).alias("wins"), flag_count(v < 0).alias("losses"), flag_count(v == 0).alias("breakeven"),
        F.sum(v).alias("net_r"), F.avg(v).alias("average_r"),
        F.when(loss < 0, gain / F.abs(loss)).when(gain > 0, None).otherwise(0.0).alias("profit_factor"), (F.count("*") / years).alias("trades_per_year"))
    return g.withColumns({"win_rate": C("wins") / C("resolved_trades"), "loss_rate": C("losses") / C("resolved_trades")})


def ledger_summary(trades: DataFrame, by: Sequence[str] = ("ledger",), *, path: DataFrame | None = None, value: str = "net_r") -> DataFrame:
    """Counts, rates over resolved trades, R sums, profit factor, drawdown, streaks and frequency."""
    by = list(by)
    path = resolved_path(trades, value=value) if path is None else path
    counts = trades.groupBy(*by).agg(F.count("*").alias("total_trade_intents"), flag_count(C("status") == "REJECTED").alias("rejected_trades"))
    g = resolved_rates(path, by, value)
    med = quantiles(path, by, value, {"median_r": 0.5})
    out = join_ns(join_ns(join_ns(counts, g, by, "left"), med, by, "left"), path_metrics(path, by, value), by, "left")
    return out.withColumn("executed_trades", C("total_trade_intents") - C("rejected_trades"))


def with_scopes(df: DataFrame) -> DataFrame:
    """One copy per reporting scope: ALL, YEAR, SYMBOL, DIRECTION."""
    s = lambda name, key: F.struct(F.lit(name).alias("scope"), key.cast("string").alias("scope_key"))
    return df.withColumn("_s", F.explode(F.array(s("ALL", F.lit("ALL")), s("YEAR", F.year("exit_ts")), s("SYMBOL", C("symbol")),
                                                 s("DIRECTION", C("direction"))))).select("*", "_s.*").drop("_s")


def breakdown(path: DataFrame, value: str = "net_r", minimum_group: int = 1) -> DataFrame:
    """Profile per year, symbol, direction and overall; win rate over wins plus losses."""
    d, by, v = with_scopes(path), ["scope", "scope_key"], C(value)
    gain, loss = F.sum(F.when(v > 0, v)), -F.sum(F.when(v < 0, v))
    g = d.groupBy(*by).agg(F.count("*").alias("trades"), flag_count(v > 0).alias("wins"), flag_count(v < 0).alias("losses"), flag_count(v == 0).alias("breakeven"),
                           F.avg(v).alias("average_r"), F.sum(v).alias("total_r"), F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"))
    decided = C("wins") + C("losses")
    g = g.withColumns({"win_rate": F.when(decided > 0, C("wins") / decided),
                       "interpretation": F.when(C("trades") >= minimum_group, "REPORTABLE").otherwise("INSUFFICIENT_FOR_INTERPRETATION")})
    # the rows of all scopes follow one shuffle of the path by its chunks
    own = path.select("idx", value, "exit_ts", "symbol", "direction").withColumn("_k", _chunk(4096)).repartition("_k")
    return g.join(path_metrics(with_scopes(own), by, value).select(*by, "max_drawdown_r"), by)


# fixed values: sample-size labels of the evidence profile
SAMPLE_LABELS = {"VERY_SMALL": 30, "SMALL": 100, "MODERATE": 300}


def evidence_profile(trades: DataFrame, by: Sequence[str] = ("ledger",), value: str = "net_r", confidence: float = 0.95,
                     wide: float = 0.2) -> DataFrame:
    """Sample counts, payoff, break-even win rate of binary outcomes, Wilson interval and warnings."""
    ok = (C("status") == "CLOSED") & C(value).isNotNull()
    v = F.when(ok, C(value))
    g = trades.groupBy(*by).agg(
        F.count("*").alias("attempts"), flag_count(C("status") != "REJECTED").alias("valid"), flag_count(C("status") == "REJECTED").alias("rejected"),
        F.count(v).alias("resolved"), flag_count(v > 0).alias("wins"), flag_count(v < 0).alias("losses"), flag_count(v == 0).alias("breakevens"),
        flag_count(ok & (C("direction") == "LONG")).alias("long_trades"), flag_count(ok & (C("direction") == "SHORT")).alias("short_trades"),
        F.avg(F.when(v > 0, v)).alias("average_win"), F.avg(F.when(v < 0, v)).alias("average_loss"),
        F.min(F.when(v > 0, v)).alias("_w0"), F.max(F.when(v > 0, v)).alias("_w1"), F.min(F.when(v < 0, v)).alias("_l0"), F.max(F.when(v < 0, v)).alias("_l1"))
    binary = (C("_w0") == C("_w1")) & (C("_l0") == C("_l1"))
    label = F.lit("LARGE")
    for name, limit in reversed(SAMPLE_LABELS.items()):
        label = F.when(C("resolved") < limit, name).otherwise(label)
    g = g.withColumns({"payoff_ratio": C("average_win") / -C("average_loss"), "break_even_win_rate": F.when(binary, -C("_l0") / (C("_w0") - C("_l0"))),
                       "sample_label": label, **wilson_interval("wins", C("wins") + C("losses"), confidence)})
    small = F.when(C("sample_label").isin("VERY_SMALL", "SMALL"), F.concat("sample_label", F.lit("_SAMPLE")))
    broad = F.when(C("wilson_high") - C("wilson_low") > wide, "WIDE_WIN_RATE_INTERVAL")
    return g.withColumn("warnings", F.array_join(F.array_compact(F.array(small, broad)), ",")).drop("_w0", "_w1", "_l0", "_l1")


def concentration(path: DataFrame, by: Sequence[str] = ("ledger",), value: str = "net_r") -> DataFrame:
    """Shares of the best year and symbol in positive R, top-trade contributions, total without the best.

    Top sums use distinct values with their multiplicity: the k best trades are the values
    whose count from the top stays within k.
    """
    from barloom.operators.stats import value_ranks
    by = list(by)
    r = value_ranks(path, by, value)
    above = C("tot_n") - C("lt_n") - C("n")
    take = lambda k: F.sum(C("_v") * F.greatest(F.lit(0), F.least(C("n"), k - above)))
    total = F.sum(C("_v") * C("n"))
    tenth = F.greatest(F.lit(1), F.ceil(C("tot_n") * F.lit(0.1)))
    share = lambda k: F.when(total != 0, take(k) / total)
    g = r.groupBy(*by).agg(share(F.lit(1)).alias("top_1_contribution"), share(F.least(F.lit(5), C("tot_n"))).alias("top_5_contribution"),
                           share(tenth).alias("top_10_percent_contribution"), (total - F.max("_v")).alias("total_without_best"))
    def best(key, name):
        s = path.groupBy(*by, key.alias("_k")).agg(F.sum(value).alias("_t")).withColumn("_p", F.greatest(F.lit(0.0), "_t"))
        return s.groupBy(*by).agg(F.when(F.sum("_p") > 0, F.max("_p") / F.sum("_p")).alias(name))
    return g.join(best(F.year("exit_ts"), "best_year_share"), by).join(best(C("symbol"), "largest_symbol_share"), by)


def parameter_sensitivity(variants: DataFrame, by: Sequence[str] = ("parameter",)) -> DataFrame:
    """CLIFF_LIKE / BROADLY_STABLE / VARIABLE over registered variants (a short list per parameter)."""
    w = W.partitionBy(*by).orderBy("parameter_value")
    d = variants.withColumn("_d", F.abs(C("expectancy") - F.lag("expectancy").over(w)))
    g = d.groupBy(*by).agg(F.count("*").alias("variants"), F.max("_d").alias("max_step"), F.min("expectancy").alias("_min"),
                           F.greatest(F.abs(F.percentile("expectancy", 0.5)), F.lit(0.1)).alias("scale"))
    status = (F.when(C("variants") < 3, "INSUFFICIENT_EVIDENCE").when(C("max_step") > C("scale") * 1.5, "CLIFF_LIKE")
              .when((C("_min") >= 0) & (C("max_step") <= C("scale") * 0.5), "BROADLY_STABLE").otherwise("VARIABLE"))
    return g.withColumn("status", status).drop("_min")


def cost_sensitivity(scenarios: DataFrame, by: Sequence[str] = ("ledger",)) -> DataFrame:
    """COST_FRAGILE when a scenario harsher than BASELINE has no positive expectancy."""
    g = scenarios.groupBy(*by).agg(F.max(F.when(C("name") == "BASELINE", C("adversity_rank"))).alias("_b"),
                                   F.collect_list(F.struct("adversity_rank", "expectancy")).alias("_s"))
    bad = F.exists("_s", lambda x: (x["adversity_rank"] > C("_b")) & (x["expectancy"] <= 0))
    return g.select(*by, F.when(C("_b").isNull(), "NO_BASELINE").when(bad, "COST_FRAGILE").otherwise("SURVIVES_REGISTERED_STRESS").alias("status"))


def criteria_check(metrics: DataFrame, criteria: Mapping[str, float], by: Sequence[str] = ("ledger",)) -> DataFrame:
    """One row per known criterion: required, actual, result."""
    # fixed values: criterion names and the metric they test
    fields = {"minimum_win_rate": "win_rate", "minimum_wilson_lower_bound": "wilson_low", "minimum_net_r": "net_r", "minimum_trades_per_year": "trades_per_year"}
    items = [F.struct(F.lit(k).alias("criterion"), F.lit(float(v)).alias("required"), C(fields[k]).cast("double").alias("actual"))
             for k, v in sorted(criteria.items()) if k in fields]
    d = metrics.select(*by, F.explode(F.array(*items)).alias("c")).select(*by, "c.*")
    return d.withColumn("result", F.when(C("actual").isNull(), "INCONCLUSIVE").when(C("actual") >= C("required"), "CRITERION_MET").otherwise("CRITERION_NOT_MET"))


# ---- performance by group, period and calendar -----------------------------------------------

def _cash(v: Column) -> Column:
    """Exact decimal sum in cents."""
    return F.round(F.sum(v.cast("decimal(18,6)")), 2).cast("double")


def performance_by(trades: DataFrame, by: Sequence[str], value: str = "profit") -> DataFrame:
    v = C(value)
    return trades.groupBy(*by).agg(F.count("*").alias("n"), flag_count(v > 0).alias("wins"), flag_count(v < 0).alias("losses"),
                                   F.avg((v > 0).cast("double")).alias("win_rate"), F.avg(v).alias("expectancy"), _cash(v).alias("net"))


def performance_cube(trades: DataFrame, a: str, b: str, value: str = "profit") -> DataFrame:
    """N, win rate, expectancy, net over all combinations of two keys and their totals."""
    v = C(value)
    g = trades.cube(a, b).agg(F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"), F.count("*").alias("n"), flag_count(v > 0).alias("wins"),
                              F.avg((v > 0).cast("double")).alias("win_rate"), F.avg(v).alias("expectancy"), _cash(v).alias("net"))
    name = lambda k, f: F.when(C(f) == 1, "ALL").otherwise(C(k).cast("string")).alias(k)
    return g.select(name(a, "_ga"), name(b, "_gb"), "n", "wins", "win_rate", "expectancy", "net")


def temporal_stability(trades: DataFrame, state: str, period: Column, periods: DataFrame, value: str = "profit") -> DataFrame:
    """Period x state performance with zero-filled cells and leave-one-period-out totals."""
    v = C(value)
    g = trades.groupBy(period.alias("period"), state).agg(F.count("*").alias("n"), flag_count(v > 0).alias("wins"), F.sum(v).alias("net"))
    states = trades.groupBy(state).agg(F.count("*").alias("_n"), flag_count(v > 0).alias("_w"), F.sum(v).alias("_t"))
    menu = trades.agg(F.sort_array(F.collect_set(state))).scalar()
    grid = periods.select("period", F.explode(menu).alias(state)).join(states, state)
    d = join_ns(grid, g, ["period", state], "left").fillna(0, ["n", "wins"]).fillna(0.0, ["net"])
    rest = C("_n") - C("n")
    return d.select("period", state, "n", "wins", F.when(C("n") > 0, C("wins") / C("n")).alias("win_rate"), "net",
                    F.when(C("n") > 0, C("net") / C("n")).alias("expectancy"), rest.alias("rest_n"),
                    F.when(rest > 0, (C("_w") - C("wins")) / rest).alias("rest_win_rate"), F.when(rest > 0, (C("_t") - C("net")) / rest).alias("rest_expectancy"))


def stability_signs(stability: DataFrame, state: str) -> DataFrame:
    """Periods with positive, negative and zero expectancy per state."""
    return stability.groupBy(state).agg(flag_count(C("net") > 0).alias("positive_periods"), flag_count(C("net") < 0).alias("negative_periods"),
                                        flag_count((C("n") > 0) & (C("net") == 0)).alias("zero_periods"), flag_count(C("n") == 0).alias("empty_periods"))


def calendar_groups(trades: DataFrame, ts: str = "entry_ts", value: str = "profit") -> DataFrame:
    """Shares of trades and losses per hour, weekday and month, zero-filled."""
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.cast("int").alias("bucket"))
    d = trades.withColumn("_k", F.explode(F.array(key("hour", F.hour(ts)), key("weekday", F.weekday(ts)), key("month", F.month(ts)))))
    g = d.groupBy("_k.kind", "_k.bucket").agg(F.count("*").alias("n"), flag_count(C(value) < 0).alias("losses"))
    spark = trades.sparkSession
    full = spark.range(43).select(F.when(C("id") < 24, "hour").when(C("id") < 31, "weekday").otherwise("month").alias("kind"),
                                  F.when(C("id") < 24, C("id")).when(C("id") < 31, C("id") - 24).otherwise(C("id") - 30).cast("int").alias("bucket"))
    out = full.join(g, ["kind", "bucket"], "left").fillna(0)
    w = W.partitionBy("kind")
    share = lambda c: F.when(F.sum(c).over(w) > 0, C(c) / F.sum(c).over(w))
    return out.withColumns({"trade_share": share("n"), "loss_share": share("losses")})


def outcome_state_comparison(trades: DataFrame, outcome: str, state: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """State shares per outcome, and the metric's mean, median and missing count per outcome."""
    n = trades.groupBy(outcome, state).agg(F.count("*").alias("n"))
    share = n.withColumn("share", C("n") / F.sum("n").over(W.partitionBy(outcome)))
    return share, outcome_distribution(trades, [outcome], metric).select(outcome, "n", "missing", "mean", "median")


def fill_profile(trades: DataFrame, pip: float, by: Sequence[str] = ("state", "outcome")) -> DataFrame:
    """Signed price move in pips and holding minutes per group."""
    side = F.when(C("direction") == "LONG", 1).otherwise(-1)
    d = trades.withColumns({"pips": side * (C("exit_price") - C("entry_price")) / pip,
                            "minutes": (F.unix_seconds("exit_ts") - F.unix_seconds("entry_ts")) / 60.0})
    a = outcome_distribution(d, by, "pips").select(*by, "n", C("mean").alias("mean_pips"), C("median").alias("median_pips"))
    b = outcome_distribution(d, by, "minutes").select(*by, C("mean").alias("mean_minutes"), C("median").alias("median_minutes"))
    return join_ns(a, b, list(by))
