"""Forward outcomes of bars and states, computed once per bar in bounded frames."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from barloom.operators.timeline import CHUNK_ROWS, chunked

C = F.col
HORIZONS = (1, 4, 8, 16, 32)
FUTURE_HORIZONS = (1, 2, 4, 8, 12)


def forward_outcomes(bars: DataFrame, horizons=HORIZONS, reference: str = "close", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Outcome structs ``h<n>`` measured over the n bars that follow a bar.

    A struct is null unless all n bars exist in the segment.  Excursions are clamped at
    zero and ties of an extreme take the earliest bar.
    """
    def fn(d, w):
        out, ref = {}, C(reference)
        for h in horizons:
            f = w.rowsBetween(1, h)
            whole = F.lead("pos", h).over(w).isNotNull()
            top = F.max(F.struct(C("high"), (-C("pos")).alias("at"))).over(f)
            bottom = F.min(F.struct(C("low"), C("pos").alias("at"))).over(f)
            change = F.lead("close", h).over(w) - ref
            out[f"h{h}"] = F.when(whole, F.struct(
                F.lead("open", 1).over(w).alias("first_open"), F.lead("close", h).over(w).alias("end_close"),
                top["high"].alias("highest_high"), bottom["low"].alias("lowest_low"), change.alias("close_change"),
                F.when(ref != 0, change / ref).alias("close_return_fraction"),
                F.greatest(F.lit(0.0), top["high"] - ref).alias("max_upward_excursion"),
                F.greatest(F.lit(0.0), ref - bottom["low"]).alias("max_downward_excursion"),
                (-top["at"] - C("pos") - 1).alias("bars_to_highest_high"),
                (bottom["at"] - C("pos") - 1).alias("bars_to_lowest_low")))
        return d.withColumns(out)
    return chunked(bars, fn, 0, max(horizons), chunk_rows)


# fixed values: the ten measured outcome fields
OUTCOME_FIELDS = ("first_open", "end_close", "highest_high", "lowest_low", "close_change", "close_return_fraction",
                  "max_upward_excursion", "max_downward_excursion", "bars_to_highest_high", "bars_to_lowest_low")


def _cut_reason(w: W, h: int, at_end: str):
    """Why the h following bars are not all in the segment; null when they are."""
    across = W.partitionBy("symbol", "chunk").orderBy("pos").rowsBetween(1, h)
    return F.when(F.lead("pos", h).over(w).isNull(),
                  F.when(F.max("seg").over(across) != C("seg"), "gap_or_segment_boundary").otherwise(at_end))


def future_windows(bars: DataFrame, horizons=FUTURE_HORIZONS, pip: float | None = None,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Long table (bar, horizon): unclamped MFE/MAE, returns, volatility, direction or reason.

    Reasons: end_of_data in the last segment, gap_or_segment_boundary in earlier ones,
    missing_reference for a null close.
    """
    def fn(d, w):
        d = d.withColumn("_step", F.ln(C("close") / F.lag("close").over(w)))
        items = []
        for h in horizons:
            f, ref = w.rowsBetween(1, h), C("close")
            reason = F.when(ref.isNull(), "missing_reference").otherwise(_cut_reason(w, h, "end_of_data"))
            move = F.lead("close", h).over(w) - ref
            ok = lambda v: F.when(reason.isNull(), v)
            measured = {"signed_return": F.lead("close", h).over(w) / ref - 1, "mfe_up": F.max("high").over(f) - ref,
                        "mae_down": ref - F.min("low").over(f), "realized_volatility": F.sqrt(F.sum(C("_step") * C("_step")).over(f)),
                        "close_change": move}
            measured["absolute_return"] = F.abs(measured["signed_return"])
            measured["direction"] = F.when(move > 0, "UP").when(move < 0, "DOWN").otherwise("FLAT")
            if pip:
                measured.update({f"{k}_pips": measured[k] / pip for k in ("close_change", "mfe_up", "mae_down")})
            fields = [F.lit(h).alias("horizon"), reason.alias("exclusion"), *[ok(v).alias(k) for k, v in measured.items()]]
            items.append(F.struct(*fields))
        return d.withColumn("_f", F.array(*items))
    d = chunked(bars, fn, 1, max(horizons), chunk_rows)
    return d.withColumn("_x", F.explode("_f")).select(*bars.columns, "_x.*")


def transition_outcomes(states: DataFrame, horizons=FUTURE_HORIZONS, state: str = "state", step: int = 900,
                        period_end=None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Long table (row, horizon): does the state change in the next h bars, and to what first.

    Bars without a state may lack inside a segment, so frames go by position. A row whose h following bars are not all there is excluded: for
    want of observations if it can reach the symbol's last row without a break, else because of a gap.
    """
    last = states.groupBy("symbol").agg(F.max("pos").alias("_last"))

    def fn(d, w):
        items = []
        for h in horizons:
            nxt = F.collect_list(state).over(w.rangeBetween(1, h))
            other = F.filter(nxt, lambda x: x != C(state))
            n = F.count("*").over(w.rangeBetween(1, h))
            reason = F.when(n < h, F.when(n == C("_last") - C("pos"), "insufficient_future_observations").otherwise("gap_or_segment_boundary"))
            if period_end is not None:
                late = F.unix_seconds("ts") + h * step >= F.unix_seconds(F.lit(period_end).cast("timestamp"))
                reason = F.when(late, "period_end_boundary").otherwise(reason)
            items.append(F.struct(F.lit(h).alias("horizon"), reason.alias("exclusion"),
                                  F.when(reason.isNull(), F.size(other) > 0).alias("transition"),
                                  F.when(reason.isNull(), F.get(other, F.lit(0))).alias("destination")))
        return d.withColumn("_f", F.array(*items))
    d = chunked(states.join(last, "symbol"), fn, 0, max(horizons), chunk_rows)
    return d.withColumn("_x", F.explode("_f")).select(*states.columns, "_x.*")
