"""Confirmed pivots, labels, structure counts, breaks and per-bar swing context."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from barloom.functions.scalars import safe_ratio
from barloom.operators.timeline import CHUNK_ROWS, chunked, running
from barloom.sources.stage import stage

C = F.col


def confirmed_swings(bars: DataFrame, left: int = 2, right: int = 2, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Strict extremes against ``left`` and ``right`` bars, visible ``right`` bars later.

    One row per pivot: symbol, seg, kind, pos, seg_pos, ts, price, confirm_pos, confirm_ts.
    """
    def fn(d, w):
        before, later = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
        whole = (C("seg_pos") >= left) & F.lead("pos", right).over(w).isNotNull()
        return d.withColumns({
            "_hi": whole & (C("high") > F.max("high").over(before)) & (C("high") > F.max("high").over(later)),
            "_lo": whole & (C("low") < F.min("low").over(before)) & (C("low") < F.min("low").over(later)),
            "confirm_ts": F.lead("ts", right).over(w)})
    d = chunked(bars.select("symbol", "seg", "pos", "seg_pos", "ts", "high", "low"), fn, left, right, chunk_rows)
    kinds = F.array(F.when(C("_hi"), F.struct(F.lit("HIGH").alias("kind"), C("high").alias("price"))),
                    F.when(C("_lo"), F.struct(F.lit("LOW").alias("kind"), C("low").alias("price"))))
    return (d.filter("_hi or _lo").withColumn("_k", F.explode(F.array_compact(kinds)))
            .select("symbol", "seg", "_k.kind", "pos", "seg_pos", "ts", "_k.price",
                    (C("pos") + right).alias("confirm_pos"), "confirm_ts"))


def label_swings(swings: DataFrame, as_of=None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """HH/LH and HL/LL against the previous pivot of the same kind; equal prices give null."""
    if as_of is not None:
        swings = swings.filter(C("confirm_ts") <= F.lit(as_of).cast("timestamp"))
    d = running(swings, {"prior_price": ("prev", C("price")), "nth": ("sum", F.lit(1).cast("long"))},
                by=("symbol", "seg", "kind"), chunk_rows=chunk_rows)
    up, down = C("price") > C("prior_price"), C("price") < C("prior_price")
    high = C("kind") == "HIGH"
    return d.withColumn("label", F.when(high & up, "HH").when(high & down, "LH").when(~high & up, "HL").when(~high & down, "LL"))


def structure_counts(labels: DataFrame, window: int = 8, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rising and falling consecutive pairs among the latest ``window`` pivots of a kind.

    ``nth`` numbers the pivots of a kind in a segment, so the frame is bounded and chunks apply.
    """
    d = labels.withColumns({"_pos": C("pos"), "pos": C("nth") - 1})

    def fn(x, w):
        frame = W.partitionBy("symbol", "seg", "kind", "chunk").orderBy("pos").rowsBetween(-(window - 2), 0)
        rise = F.coalesce(F.sum(F.when(C("price") > C("prior_price"), 1)).over(frame), F.lit(0))
        fall = F.coalesce(F.sum(F.when(C("price") < C("prior_price"), 1)).over(frame), F.lit(0))
        return x.withColumns({"rising": rise, "falling": fall})
    return (chunked(d, fn, window, 0, chunk_rows).withColumn("pos", C("_pos")).drop("_pos", "nth"))


def swing_events(bars: DataFrame, left: int = 2, right: int = 2, window: int = 8,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per confirming bar: both kinds' pivot (label, price, pos, counts) as structs."""
    c = structure_counts(label_swings(confirmed_swings(bars, left, right, chunk_rows), chunk_rows=chunk_rows), window, chunk_rows)
    pivot = F.struct("price", "label", C("pos").alias("pivot_pos"), "confirm_pos", "rising", "falling")
    return (c.groupBy("symbol", "seg", C("confirm_pos").alias("pos"))
            .agg(F.max(F.when(C("kind") == "HIGH", pivot)).alias("new_high"),
                 F.max(F.when(C("kind") == "LOW", pivot)).alias("new_low")))


def swing_context(bars: DataFrame, left: int = 2, right: int = 2, window: int = 8, atr: str | None = "atr",
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Latest confirmed pivots, counts and structure break of every bar.

    A break is the first close across the latest pivot.  Which breaks happen does not
    depend on the regime, only their name does, so the automaton reduces to carried
    last values: regime events are confirmations of an HH+HL or LH+LL pair and breaks.
    """
    by = ("symbol", "seg")
    kw = dict(by=by, chunk_rows=chunk_rows)
    # both stages are narrow; they keep later scans from repeating the pivot search
    events = stage(swing_events(bars, left, right, window, chunk_rows))
    narrow = bars.select(*by, "pos", "close").join(events, [*by, "pos"], "left")
    narrow = running(narrow, {"hi": ("last", C("new_high")), "lo": ("last", C("new_low")), "prev_close": ("prev", C("close"))}, **kw)
    up = (C("prev_close") <= C("hi.price")) & (C("close") > C("hi.price"))
    down = (C("prev_close") >= C("lo.price")) & (C("close") < C("lo.price"))
    pair = F.when((C("hi.label") == "HH") & (C("lo.label") == "HL"), "BULLISH").when(
        (C("hi.label") == "LH") & (C("lo.label") == "LL"), "BEARISH")
    fresh = C("new_high").isNotNull() | C("new_low").isNotNull()
    state = stage(narrow.select(*by, "pos", "hi", "lo", F.when(up, C("hi.pivot_pos")).alias("up"),
                                F.when(down, C("lo.pivot_pos")).alias("down"), F.when(fresh, pair).alias("pair")))
    # a pivot breaks once: a cross counts only if the last crossed pivot is another one
    thin = state.filter("up is not null or down is not null or pair is not null").select(*by, "pos", "up", "down", "pair")
    thin = running(thin, {"up0": ("prev", C("up")), "down0": ("prev", C("down"))}, **kw)
    thin = thin.withColumn("broke", F.when(C("up").isNotNull() & ~C("up").eqNullSafe(C("up0")), "UP").when(
        C("down").isNotNull() & ~C("down").eqNullSafe(C("down0")), "DOWN"))
    after_break = F.when(C("broke") == "UP", "BULLISH").when(C("broke") == "DOWN", "BEARISH")
    thin = running(thin, {"old": ("prev", F.coalesce(after_break, C("pair")))}, **kw)
    regime = F.coalesce("pair", "old")
    kind = (F.when((C("broke") == "UP") & (regime == "BEARISH"), "CHOCH_BULLISH").when(C("broke") == "UP", "BOS_BULLISH")
            .when((C("broke") == "DOWN") & (regime == "BULLISH"), "CHOCH_BEARISH").when(C("broke") == "DOWN", "BOS_BEARISH"))
    breaks = thin.filter("broke is not null").select(*by, "pos", kind.alias("structure_break"))
    d = bars.join(state.select(*by, "pos", "hi", "lo"), [*by, "pos"], "left").join(breaks, [*by, "pos"], "left")
    zero = lambda c: F.coalesce(C(c), F.lit(0)).cast("long")
    out = {"higher_high_count": zero("hi.rising"), "lower_high_count": zero("hi.falling"),
           "higher_low_count": zero("lo.rising"), "lower_low_count": zero("lo.falling")}
    for kind, s in (("high", "hi"), ("low", "lo")):
        gap = C("close") - C(f"{s}.price")
        out[f"latest_{kind}_label"] = C(f"{s}.label")
        out[f"latest_{kind}_price"] = C(f"{s}.price")
        out[f"latest_{kind}_distance_price"] = gap
        if atr:
            out[f"latest_{kind}_distance_atr"] = safe_ratio(gap, atr)
        out[f"latest_{kind}_bars_since_confirmation"] = C("pos") - C(f"{s}.confirm_pos")
    return d.select(*bars.columns, *[v.alias(k) for k, v in out.items()], "structure_break")


def structure_breaks(context: DataFrame) -> DataFrame:
    return context.filter("structure_break is not null").select("symbol", "seg", "pos", "ts", "structure_break")
