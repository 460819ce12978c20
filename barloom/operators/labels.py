"""Rule intents, entries, first-touch labels and the trade ledger."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.functions.scalars import spread_distance, trade_costs
from barloom.operators.joins import asof_join, extreme_tree, first_hit
from barloom.operators.timeline import running

C = F.col


def predicate(spec: Mapping, known: Sequence[str] | None = None) -> Column:
    """Column of a condition tree {op, field, value} / {op, args}; evaluated by Catalyst.

    Null rules: ordered comparisons with null are false, NE and NOT_IN with null are true
    unless null itself is excluded, EQ null means is-null, and null in IN matches null.
    """
    op = spec["op"]
    if op in ("AND", "OR", "NOT"):
        parts = [predicate(a, known) for a in spec["args"]]
        if op == "NOT":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if op == "AND" else (out | p)
        return out
    field = spec["field"]
    if known is not None and field not in known:
        raise ValueError(f"unknown field {field!r}")
    c, v = C(f"`{field}`"), spec["value"]
    if op in ("EQ", "NE"):
        hit = c.isNull() if v is None else c.eqNullSafe(F.lit(v))
        return hit if op == "EQ" else ~hit
    if op in ("IN", "NOT_IN"):
        values = [x for x in v if x is not None]
        hit = F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)
        if None in v:
            hit = hit | c.isNull()
        return hit if op == "IN" else ~hit
    compare = {"GT": c > F.lit(v), "GTE": c >= F.lit(v), "LT": c < F.lit(v), "LTE": c <= F.lit(v)}
    if op not in compare:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(compare[op], F.lit(False))


# fixed values: kinds accepted by the ordered and the equality operators
ORDERED_KINDS = ("double", "float", "int", "bigint", "date", "timestamp")


def check_conditions(spec: Mapping, df: DataFrame) -> None:
    """Every field exists and ordered comparisons meet an ordered type."""
    if spec["op"] in ("AND", "OR", "NOT"):
        for a in spec["args"]:
            check_conditions(a, df)
        return
    kinds = dict(df.dtypes)
    if spec["field"] not in kinds:
        raise ValueError(f"unknown field {spec['field']!r}")
    if spec["op"] in ("GT", "GTE", "LT", "LTE") and kinds[spec["field"]] not in ORDERED_KINDS:
        raise ValueError(f"{spec['op']} needs an ordered field, {spec['field']!r} is {kinds[spec['field']]}")


def intents_from_rules(view: DataFrame, rules: Sequence[Mapping], pip: float, *, symbol: str = "symbol", ts: str = "ts",
                       price: str = "reference_price", row: str = "row_index") -> DataFrame:
    """One intent per (row, matching rule); the scan of the view happens once.

    rule: rule_id, direction, conditions, stop_pips, target_r, entry_type.  Stops and
    targets with impossible geometry are dropped.
    """
    items = []
    for i, r in enumerate(rules):
        check_conditions(r["conditions"], view)
        items.append(F.when(predicate(r["conditions"]), F.struct(
            F.lit(i).alias("rule_order"), F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["direction"]).alias("direction"),
            F.lit(float(r["stop_pips"])).alias("stop_pips"), F.lit(float(r["target_r"])).alias("target_r"),
            F.lit(r.get("entry_type", "NEXT_OPEN")).alias("entry_type"))))
    m = view.withColumn("_r", F.explode(F.array_compact(F.array(*items)))).select("*", "_r.*").drop("_r")
    side = F.when(C("direction") == "LONG", 1).otherwise(-1)
    risk = C("stop_pips") * pip
    out = m.select(
        F.concat(F.lit("intent-"), F.substring(F.sha2(F.concat_ws("|", C("rule_id"), C(symbol), C(row).cast("string")), 256), 1, 24)).alias("intent_id"),
        C(row).alias("row_index"), "rule_order", "rule_id", C(symbol).alias("symbol"), "direction", C(ts).alias("signal_ts"),
        "entry_type", C(price).alias("signal_price"), (C(price) - side * risk).alias("stop"),
        (C(price) + side * risk * C("target_r")).alias("target"), F.lit(1.0).alias("quantity"))
    ordered = F.when(C("direction") == "LONG", (C("stop") < C("signal_price")) & (C("signal_price") < C("target"))).otherwise(
        (C("target") < C("signal_price")) & (C("signal_price") < C("stop")))
    return out.filter(ordered & (C("stop") > 0) & (C("target") > 0))


def execution_bars(indexed: DataFrame, step: int, *, spread_mode: str = "BAR", fixed_spread: float = 0.0,
                   point: float = 1.0) -> DataFrame:
    """Bars with ask extremes and a running count of market gaps, numbered by ``pos``."""
    s = spread_distance(spread_mode, fixed=fixed_spread, point=point)
    gap = F.when(F.unix_seconds("ts") - F.unix_seconds("prev_ts") > step, 1).otherwise(0).cast("long")
    b = running(indexed.withColumn("spread_price", s), {"gaps": ("sum", gap)}, by=("symbol",))
    return b.select("symbol", "pos", "ts", "open", "high", "low", "close", "spread_price", "gaps",
                    (C("high") + C("spread_price")).alias("ask_high"), (C("low") + C("spread_price")).alias("ask_low"))


def label_intents(intents: DataFrame, bars: DataFrame, step: int, *, commission_mode: str = "ZERO", commission: float = 0.0,
                  slippage: float = 0.0) -> DataFrame:
    """Ledger rows: rejection, entry, first stop or target touch, costs and R multiples.

    Entries: NEXT_OPEN first bar opening at or after the signal, CLOSE the bar closing at
    the signal, LIMIT the first bar from the signal that reaches the price before expiry.
    """
    for c, kind in (("limit_price", "double"), ("expires_ts", "timestamp")):
        if c not in intents.columns:
            intents = intents.withColumn(c, F.lit(None).cast(kind))
    tree = extreme_tree(bars)
    copies = intents.groupBy("intent_id").agg(F.count("*").alias("_copies"))
    extent = bars.groupBy("symbol").agg(F.min("ts").alias("_from"), (F.max(F.unix_seconds("ts")) + step).alias("_to"), F.max("pos").alias("_last"))
    d = intents.join(copies, "intent_id").join(extent, "symbol", "left")
    d = asof_join(d, bars, ["symbol"], ["pos"], left_ts="signal_ts", direction="forward", prefix="next_")
    at_close = bars.select("symbol", (F.unix_seconds("ts") + step).alias("_close_s"), C("pos").alias("_close_pos"))
    d = d.withColumn("_close_s", F.unix_seconds("signal_ts")).join(at_close, ["symbol", "_close_s"], "left")
    long = C("direction") == "LONG"
    limit = C("entry_type") == "LIMIT"
    d = d.withColumn("_limit_from", F.when(limit, C("next_pos")))
    d = first_hit(d, tree, "_limit_from", lambda x: F.when(long, x["low"] <= C("limit_price")).otherwise(x["high"] >= C("limit_price")), "_limit_pos")
    d = d.withColumn("entry_pos", F.when(C("entry_type") == "NEXT_OPEN", C("next_pos")).when(C("entry_type") == "CLOSE", C("_close_pos"))
                     .when(limit, C("_limit_pos")))
    eb = bars.select("symbol", C("pos").alias("entry_pos"), F.struct("ts", "open", "close", "spread_price", "gaps").alias("eb"))
    d = d.join(eb, ["symbol", "entry_pos"], "left")
    # an expired limit never fills
    expired = limit & C("expires_ts").isNotNull() & (C("eb.ts") >= C("expires_ts"))
    d = d.withColumn("entry_pos", F.when(~F.coalesce(expired, F.lit(False)), C("entry_pos")))
    price = F.when(C("entry_type") == "NEXT_OPEN", C("eb.open")).when(C("entry_type") == "CLOSE", C("eb.close")).otherwise(C("limit_price"))
    side = F.when(long, 1.0).otherwise(-1.0)
    d = d.withColumns({"entry_price": F.when(C("entry_pos").isNotNull(), price)})
    d = d.withColumns({
        "entry_ts": F.when(C("entry_pos").isNotNull(), F.when(C("entry_type") == "CLOSE", C("signal_ts")).otherwise(C("eb.ts"))),
        "risk": side * (C("entry_price") - C("stop"))})
    reason = (F.when(C("_copies") > 1, "DUPLICATE_TRADE_INTENT_ID").when(C("_from").isNull(), "SYMBOL_DATA_NOT_FOUND")
              .when(~C("entry_type").isin("NEXT_OPEN", "CLOSE", "LIMIT"), "UNSUPPORTED_ENTRY_TYPE")
              .when((C("signal_ts") < C("_from")) | (F.unix_seconds("signal_ts") > C("_to")), "SIGNAL_OUTSIDE_DATASET")
              .when(C("entry_pos").isNull(), F.when(C("entry_type") == "NEXT_OPEN", "MISSING_NEXT_OPEN_EXECUTION_CANDLE").otherwise("IMPOSSIBLE_SIGNAL_TIMESTAMP"))
              .when(C("risk") <= 0, "INVALID_STOP_LOSS").when(side * (C("target") - C("entry_price")) <= 0, "INVALID_TAKE_PROFIT"))
    d = d.withColumn("rejection_reason", reason)
    live = C("rejection_reason").isNull()
    d = d.withColumn("_from_pos", F.when(live, C("entry_pos") + F.when(C("entry_type") == "CLOSE", 1).otherwise(0)))
    hit = lambda x: F.when(long, (x["low"] <= C("stop")) | (x["high"] >= C("target"))).otherwise(
        (x["ask_high"] >= C("stop")) | (x["ask_low"] <= C("target")))
    d = first_hit(d, tree, "_from_pos", hit, "exit_pos")
    xb = bars.select("symbol", C("pos").alias("exit_pos"), F.struct("ts", "open", "high", "low", "spread_price", "gaps").alias("xb"))
    lb = bars.select("symbol", C("pos").alias("_last"), C("gaps").alias("_last_gaps"))
    d = d.join(xb, ["symbol", "exit_pos"], "left").join(lb, ["symbol", "_last"], "left")
    ask = F.when(long, 0.0).otherwise(C("xb.spread_price"))
    o, h, l = (C(f"xb.{k}") + ask for k in ("open", "high", "low"))
    gap_stop = F.when(long, o <= C("stop")).otherwise(o >= C("stop"))
    gap_target = F.when(long, o >= C("target")).otherwise(o <= C("target"))
    stop_hit = F.when(long, l <= C("stop")).otherwise(h >= C("stop"))
    target_hit = F.when(long, h >= C("target")).otherwise(l <= C("target"))
    closed = C("exit_pos").isNotNull()
    exit_reason = (F.when(~live, "REJECTED").when(~closed, "END_OF_DATA").when(gap_stop, "GAP_THROUGH_SL")
                   .when(gap_target, "GAP_BEYOND_TP_CONSERVATIVE").when(stop_hit & target_hit, "SAME_BAR_AMBIGUOUS_SL_FIRST")
                   .when(stop_hit, "STOP_LOSS").otherwise("TAKE_PROFIT"))
    exit_price = F.when(closed, F.when(gap_stop, o).when(gap_target, C("target")).when(stop_hit, C("stop")).otherwise(C("target")))
    d = d.withColumns({"exit_reason": exit_reason, "exit_price": exit_price, "exit_ts": C("xb.ts"),
                       "status": F.when(~live, "REJECTED").when(closed, "CLOSED").otherwise("OPEN"),
                       "bars_held": F.when(live, F.when(closed, C("exit_pos") - C("entry_pos") + 1).otherwise(C("_last") - C("entry_pos") + 1)),
                       "market_gap_count": F.when(live, F.coalesce(C("xb.gaps"), C("_last_gaps")) - C("eb.gaps"))})
    costs = trade_costs(C("eb.spread_price"), commission_mode=commission_mode, commission=commission, slippage=slippage)
    d = d.withColumns({"gross_pnl": F.when(closed, (C("exit_price") - C("entry_price")) * side * C("quantity")),
                       **{k: F.when(closed, v) for k, v in costs.items()}})
    net = C("gross_pnl") - C("spread_cost") - C("commission_cost") - C("slippage_cost")
    d = d.withColumns({"net_pnl": net, "gross_r": C("gross_pnl") / (C("risk") * C("quantity"))})
    d = d.withColumn("net_r", C("net_pnl") / (C("risk") * C("quantity")))
    trade = F.concat(F.lit("trade-"), F.substring(F.sha2("intent_id", 256), 1, 24))
    return d.select(trade.alias("trade_id"), "intent_id", "symbol", "direction", "entry_type", "signal_ts", "stop", "target", "quantity",
                    F.when(live, C("entry_ts")).alias("entry_ts"), F.when(live, C("entry_price")).alias("entry_price"), "exit_ts", "exit_price",
                    "exit_reason", "rejection_reason", "status", "gross_pnl", "spread_cost", "commission_cost", "slippage_cost", "net_pnl",
                    "gross_r", "net_r", "bars_held", "market_gap_count", F.when(live, C("risk")).alias("risk"))
