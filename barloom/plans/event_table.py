"""The wide event table: level events with context, and outcomes as separate targets."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from barloom.functions.calendar import FRAMES, NY_3H, BlockConfig
from barloom.functions.scalars import COMMON_LEVELS, candle_shape, measure_level
from barloom.operators import blocks as B, levels as L, outcomes as O, swings as S, windows as X
from barloom.operators.timeline import CHUNK_ROWS
from barloom.sources.stage import stage

C = F.col

# fixed values: role prefixes and context field lists of the wide row
RELATIONSHIP_FIELDS = ("observed_open_position", "observed_close_position", "traded_above_reference_high",
                       "traded_below_reference_low", "closed_above_reference_high", "closed_below_reference_low",
                       "high_excursion_returned_inside_by_close", "low_excursion_returned_inside_by_close",
                       "stayed_inside_reference_range", "traded_both_sides_of_reference_range", "range_ratio",
                       "same_direction", "overlaps_in_time", "overlap_minutes")
MARKET_FIELDS = {
    "volatility.atr": "atr_14", "volatility.atr_percentile_100": "atr_percentile_100",
    "volatility.range_percentile_100": "range_percentile_100", "structure.prior_high_12": "prior_high_12",
    "structure.prior_low_12": "prior_low_12", "structure.breakout_high_12": "breakout_high_12",
    "structure.breakout_low_12": "breakout_low_12", "structure.higher_high_count": "higher_high_count",
    "structure.lower_high_count": "lower_high_count", "structure.higher_low_count": "higher_low_count",
    "structure.lower_low_count": "lower_low_count",
    **{f"swing.{k}.{f}": f"latest_{k}_{f}" for k in ("high", "low")
       for f in ("label", "price", "distance_price", "distance_atr", "bars_since_confirmation")},
    "structure.break_kind": "structure_break"}
BREAK_KINDS = ("BOS_BULLISH", "BOS_BEARISH", "CHOCH_BULLISH", "CHOCH_BEARISH")


def level_events(bars: DataFrame, step: int, *, cfg: BlockConfig = NY_3H, levels=COMMON_LEVELS, family: str = "COMMON",
                 horizon: int = 32, checkpoints=(4, 8, 16, 32), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Touch transitions and untouched checkpoints of every projected level.

    The last ``horizon`` bars of a segment host no event, so every outcome exists.
    """
    prefix = L.neighbour_bars(bars, horizon, chunk_rows)
    blocks = B.anchored_blocks(prefix, step, cfg)
    placed = stage(L.place_levels(L.explode_levels(L.geometry_instances(blocks, levels, family)), prefix))
    contacts = stage(L.level_contacts(placed, prefix))
    patterns = L.touch_patterns(L.level_runs(placed, contacts), step)
    history = L.level_history(placed, contacts, step)
    return L.all_anchors(patterns, history, checkpoints)


def bar_context(bars: DataFrame, step: int, *, frames=FRAMES, sessions=B.SESSIONS, horizons=O.HORIZONS,
                swing=(2, 2, 8), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Everything an event may know at a bar close, plus the outcomes that follow it.

    Contexts depend on the bar alone, so they are computed once per bar, not per event.
    """
    keep = ["symbol", "seg", "pos", "seg_pos", "ts", "open", "high", "low", "close"]
    feats = ["atr_14", "atr_percentile_100", "range_percentile_100", "prior_high_12", "prior_low_12", "breakout_high_12", "breakout_low_12"]
    d = X.base_features(bars.select(*keep), chunk_rows).select(*keep, *feats)
    d = S.swing_context(d, *swing, atr="atr_14", chunk_rows=chunk_rows)
    d = O.forward_outcomes(d, horizons, chunk_rows=chunk_rows)
    d = B.frame_context(d, step, frames, source=bars)
    return B.session_relationships(B.session_slots(d, step, sessions, source=bars))


def project_events(events: DataFrame, context: DataFrame, step: int, *, frames=FRAMES, sessions=B.SESSIONS,
                   pairs=B.SESSION_PAIRS, horizons=O.HORIZONS) -> DataFrame:
    """Join events to their evidence bar and name columns meta.* / x.* / y.*."""
    e = events.join(context, ["symbol", "seg", "pos"])
    ref = C("close")
    out = {"meta.symbol": C("symbol"), "meta.segment": C("seg"), "meta.evidence_end_utc": C("close_ts"),
           "meta.geometry_available_at_utc": C("available_at"), "meta.source_local_trading_date": C("block_date"),
           "meta.source_block_start_utc": C("block_start"), "meta.source_block_end_utc": C("block_end"),
           "meta.outcome_anchor_id": C("anchor_id"), "meta.base_minutes": F.lit(step // 60), "meta.reference_price": ref,
           "meta.level_price": C("level_price"), "meta.pattern_index": C("pattern_index"),
           "x.anchor_kind": C("anchor_kind"), "x.geometry.family_id": C("family_id"),
           "x.geometry.source_block_label": C("block_label"), "x.geometry.source_block_index": C("block_index"),
           "x.geometry.level_id": C("level_id"), "x.geometry.coordinate": C("coordinate"),
           "x.event.pattern_code": C("pattern_code"), "x.event.checkpoint_bars": C("checkpoint_bars")}
    put = lambda prefix, cols: out.update({f"{prefix}{k}": v for k, v in cols.items()})
    put("x.m15." if step == 900 else "x.base.", candle_shape(ref))
    for name in frames:
        s = lambda f: C(f"{name}.{f}")
        put(f"x.mtf.{name.lower()}.", {"available": C(name).isNotNull(), "block_label": s("block_label"), "block_index": s("block_index"),
                                       **candle_shape(ref, s("open"), s("high"), s("low"), s("close"))})
    for x in sessions:
        s = lambda f: C(f"{x.name}.{f}")
        put(f"x.session.{x.name.lower()}.", {"available": C(x.name).isNotNull(), "active": C(f"{x.name}_active"),
                                             "missing_completed": C(f"{x.name}_missing"),
                                             **candle_shape(ref, s("open"), s("high"), s("low"), s("close"))})
    for name, _, _ in pairs:
        put(f"x.relationship.{name.lower()}.", {"available": C(name).isNotNull(), **{f: C(f"{name}.{f}") for f in RELATIONSHIP_FIELDS}})
    put("x.market.m15.", {"available": F.lit(True), **{k: C(v) for k, v in MARKET_FIELDS.items()},
                          **{f"structure.{k.lower()}": F.coalesce(C("structure_break") == k, F.lit(False)) for k in BREAK_KINDS}})
    put("x.level_transition.", {"sweep": C("sweep"), "reclaim": C("reclaim")})
    if "NY_D1" in frames:
        day = lambda f: C(f"NY_D1.{f}")
        mid = (day("high") + day("low")) / 2
        put("x.daily.previous.", {"available": C("NY_D1").isNotNull(), **{f: day(f) for f in ("open", "high", "low", "close")},
                                  "range": day("high") - day("low"), "midpoint": mid})
        for f in ("open", "high", "low", "close", "midpoint"):
            put(f"x.daily.previous.level.{f}.", measure_level(mid if f == "midpoint" else day(f), "atr_14"))
    for h in horizons:
        put(f"y.h{h}.", {f: C(f"h{h}.{f}") for f in O.OUTCOME_FIELDS})
    return e.select(*[v.alias(k) for k, v in out.items()])


def build_event_table(bars: DataFrame, step: int, *, horizons=O.HORIZONS, chunk_rows: int = CHUNK_ROWS, **kw) -> DataFrame:
    """Segment-local end-to-end build on indexed bars."""
    events = level_events(bars, step, horizon=max(horizons), chunk_rows=chunk_rows, **kw)
    context = bar_context(bars, step, horizons=horizons, chunk_rows=chunk_rows)
    return project_events(events, context, step, horizons=horizons)


# fixed values: total order of events
EVENT_ORDER = ("meta.symbol", "meta.evidence_end_utc", "meta.source_block_start_utc", "x.geometry.family_id", "x.geometry.level_id",
               "x.anchor_kind", "meta.pattern_index", "x.event.checkpoint_bars")


def field_catalog(events: DataFrame) -> list[tuple[str, str, str]]:
    """(field, role, kind) of every column; the role is its prefix."""
    roles = {"meta": "IDENTITY", "x": "PREDICTOR", "y": "TARGET"}
    out = []
    for f in events.schema.fields:
        role = roles.get(f.name.split(".")[0])
        if role is None:
            raise ValueError(f"column without a role: {f.name}")
        out.append((f.name, role, f.dataType.simpleString()))
    return out


# fixed values: name tokens that mark an outcome and may not appear in predictor inputs
OUTCOME_TOKENS = ("win", "loss", "winner", "loser", "profit", "pnl", "tp", "sl", "mfe", "mae", "future", "result")


def predictors_only(df: DataFrame) -> DataFrame:
    """``df`` if its role catalogue holds predictors alone and none of them is named after an outcome."""
    named = re.compile(rf"(?i)(?<![a-z0-9])(?:{'|'.join(OUTCOME_TOKENS)})(?![a-z0-9])")
    for name, role, _ in field_catalog(df):
        if role != "PREDICTOR":
            raise ValueError(f"{name} has the role {role}, a predictor frame takes PREDICTOR columns only")
        if named.search(name):
            raise ValueError(f"{name} is named after an outcome")
    return df
