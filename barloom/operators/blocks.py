"""Wall-clock blocks, higher-frame context, sessions and their relationships."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.calendar import FRAMES, LONDON, NY, NY_3H, TOKYO, BlockConfig, local, resolve_block
from barloom.functions.scalars import direction_of

C = F.col


def _price_aggs():
    return [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.count("*").alias("bar_count")]


def anchored_blocks(bars: DataFrame, step: int, cfg: BlockConfig = NY_3H, decision=None,
                    keys=("symbol", "seg")) -> DataFrame:
    """Blocks whose true UTC duration is filled bar by bar and over by the decision time.

    Bars are unique on the grid, so count, first and last open prove completeness.
    """
    if decision is not None:
        bars = bars.filter(F.unix_seconds("ts") + step <= F.unix_seconds(F.lit(decision).cast("timestamp")))
    b = bars.withColumns(resolve_block("ts", cfg))
    g = (b.groupBy(*keys, "block_start", "block_end", "block_date", "block_label", "block_index")
         .agg(*_price_aggs(), F.min("ts").alias("_first"), F.max("ts").alias("_last")))
    seconds = F.unix_seconds("block_end") - F.unix_seconds("block_start")
    full = ((C("bar_count") * step == seconds) & (C("_first") == C("block_start"))
            & (F.unix_seconds("_last") + step == F.unix_seconds("block_end")))
    return g.filter(full).drop("_first", "_last")


def expected_window(decision: Column, cfg: BlockConfig) -> dict[str, Column]:
    """UTC bounds of the block that should have completed last at ``decision``.

    The block of the instant itself counts when it is over (repeated hours); otherwise
    the block holding the microsecond before its start.
    """
    here = resolve_block(decision, cfg)
    before = resolve_block(here["block_start"] - F.expr("INTERVAL 1 MICROSECOND"), cfg)
    over = (here["block_start"] < here["block_end"]) & (here["block_end"] <= decision)
    return {k: F.when(over, here[k]).otherwise(before[k]) for k in ("block_start", "block_end")}


def frame_context(bars: DataFrame, step: int, frames: dict[str, BlockConfig] = FRAMES, source: DataFrame | None = None) -> DataFrame:
    """Per bar close, the expected completed block of every frame as a struct; missing stays null."""
    source = bars if source is None else source
    out = bars.withColumn("close_ts", F.timestamp_seconds(F.unix_seconds("ts") + step))
    for name, cfg in frames.items():
        w = expected_window(C("close_ts"), cfg)
        blocks = anchored_blocks(source, step, cfg).select(
            "symbol", "seg", C("block_start").alias("_s"), C("block_end").alias("_e"),
            F.struct("open", "high", "low", "close", "block_label", "block_index", "block_start", "block_end").alias(name))
        out = out.withColumns({"_s": w["block_start"], "_e": w["block_end"]}).join(
            blocks, ["symbol", "seg", "_s", "_e"], "left").drop("_s", "_e")
    return out


@dataclass(frozen=True)
class Session:
    name: str
    zone: str
    start_minute: int
    end_minute: int


# fixed values: the three standard sessions in local minutes and the two compared pairs
SESSIONS = (Session("TOKYO", TOKYO, 540, 1080), Session("LONDON", LONDON, 480, 1020), Session("NEW_YORK", NY, 480, 1020))
SESSION_PAIRS = (("TOKYO_TO_LONDON", "TOKYO", "LONDON"), ("LONDON_TO_NEW_YORK", "LONDON", "NEW_YORK"))


def session_window(date: Column, s: Session) -> dict[str, Column]:
    """UTC bounds of a session on a local date; null when a boundary does not exist."""
    overnight = 1 if s.end_minute < s.start_minute else 0
    at = lambda days, m: F.date_add(date, days).cast("timestamp") + F.expr(f"INTERVAL {m} MINUTES")
    lo, hi = at(0, s.start_minute), at(overnight, s.end_minute)
    start, end = F.to_utc_timestamp(lo, s.zone), F.to_utc_timestamp(hi, s.zone)
    real = (local(start, s.zone) == lo) & (local(end, s.zone) == hi) & (start < end)
    return {"start": F.when(real, start), "end": F.when(real, end)}


def completed_sessions(bars: DataFrame, step: int, sessions=SESSIONS, decision=None, keys=("symbol", "seg")) -> DataFrame:
    """Sessions with every grid bar present.

    A bar belongs to the session of its own or the previous local date, so membership
    is arithmetic on the bar: one explode over sessions and one combinable aggregation.
    """
    if decision is not None:
        bars = bars.filter(F.unix_seconds("ts") + step <= F.unix_seconds(F.lit(decision).cast("timestamp")))
    cand = []
    for s in sessions:
        for back in ((0, 1) if s.end_minute < s.start_minute else (0,)):
            day = F.date_sub(F.to_date(local("ts", s.zone)), back)
            w = session_window(day, s)
            inside = (C("ts") >= w["start"]) & (C("ts") < w["end"])
            cand.append(F.when(inside, F.struct(F.lit(s.name).alias("session"), day.alias("session_date"),
                                                w["start"].alias("start"), w["end"].alias("end"))))
    b = bars.withColumn("_m", F.explode(F.array_compact(F.array(*cand)))).select("*", "_m.*").drop("_m")
    g = b.groupBy(*keys, "session", "session_date", "start", "end").agg(*_price_aggs())
    full = C("bar_count") * step == F.unix_seconds("end") - F.unix_seconds("start")
    return g.filter(full).withColumns({"range": C("high") - C("low"), "direction": direction_of()})


def compare_sessions(ref: str, obs: str) -> dict[str, Column]:
    """The relationship flags of an observed session against a reference (struct columns)."""
    r, o = (lambda f: C(f"{ref}.{f}")), (lambda f: C(f"{obs}.{f}"))
    place = lambda v: F.when(v > r("high"), "ABOVE").when(v < r("low"), "BELOW").otherwise("INSIDE")
    above, below = o("high") > r("high"), o("low") < r("low")
    lo = F.greatest(F.unix_seconds(r("start")), F.unix_seconds(o("start")))
    hi = F.least(F.unix_seconds(r("end")), F.unix_seconds(o("end")))
    cols = {
        "observed_open_position": place(o("open")), "observed_close_position": place(o("close")),
        "traded_above_reference_high": above, "traded_below_reference_low": below,
        "closed_above_reference_high": o("close") > r("high"), "closed_below_reference_low": o("close") < r("low"),
        "high_excursion_returned_inside_by_close": above & (o("close") <= r("high")),
        "low_excursion_returned_inside_by_close": below & (o("close") >= r("low")),
        "stayed_inside_reference_range": ~above & ~below, "traded_both_sides_of_reference_range": above & below,
        "range_ratio": F.when(r("range") > 0, o("range") / r("range")),
        "same_direction": r("direction") == o("direction"), "overlaps_in_time": hi > lo,
        "overlap_minutes": F.greatest(hi - lo, F.lit(0)) / 60.0,
    }
    both = C(ref).isNotNull() & C(obs).isNotNull()
    return {k: F.when(both, v) for k, v in cols.items()}


def session_slots(bars: DataFrame, step: int, sessions=SESSIONS, source: DataFrame | None = None) -> DataFrame:
    """Per bar close and session: the relevant window, its state and completed summary.

    Adds struct columns named after the session plus ``<name>_active`` and
    ``<name>_missing``.  Today's window is relevant once started, else yesterday's.
    """
    source = bars if source is None else source
    done = completed_sessions(source, step, sessions)
    out = bars if "close_ts" in bars.columns else bars.withColumn("close_ts", F.timestamp_seconds(F.unix_seconds("ts") + step))
    for s in sessions:
        day = F.to_date(local("close_ts", s.zone))
        today, last = session_window(day, s), session_window(F.date_sub(day, 1), s)
        started = today["start"] <= C("close_ts")
        summary = done.filter(C("session") == s.name).select(
            "symbol", "seg", C("session_date").alias("_d"),
            F.struct("open", "high", "low", "close", "range", "direction", "start", "end", "session_date").alias("_s"))
        out = out.withColumns({"_d": F.when(started, day).otherwise(F.date_sub(day, 1)),
                               "_from": F.when(started, today["start"]).otherwise(last["start"]),
                               "_to": F.when(started, today["end"]).otherwise(last["end"])})
        active = (C("_from") <= C("close_ts")) & (C("close_ts") < C("_to"))
        out = out.join(summary, ["symbol", "seg", "_d"], "left").withColumns({
            f"{s.name}_active": active, s.name: F.when(~active, C("_s")),
            f"{s.name}_missing": ~active & C("_s").isNull()}).drop("_d", "_from", "_to", "_s")
    return out


def session_relationships(slots: DataFrame, pairs=SESSION_PAIRS) -> DataFrame:
    """Relationship struct per pair; null when either side is missing."""
    out = slots
    for name, ref, obs in pairs:
        cols = compare_sessions(ref, obs)
        both = C(ref).isNotNull() & C(obs).isNotNull()
        out = out.withColumn(name, F.when(both, F.struct(*[v.alias(k) for k, v in cols.items()])))
    return out
