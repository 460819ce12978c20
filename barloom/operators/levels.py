"""Projected levels and their touches without a level x bar product.

A level never expires inside its segment, so joining every level to every later bar
grows with the square of the segment.  Here bars and levels meet in price buckets:
a bar is copied to the buckets its range (and the jump from the previous bar) covers,
a level sits in one.  The bucket width is the symbol's mean covered range, so the
copies add up to about two per bar, and the join yields only real contacts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from barloom.functions.scalars import COMMON_LEVELS, direction_of, observe_level, project_levels
from barloom.operators.timeline import CHUNK_ROWS, chunked

C = F.col
LEVEL_KEY = ("symbol", "seg", "block_start", "level_id")


def geometry_instances(blocks: DataFrame, levels=COMMON_LEVELS, family: str = "COMMON") -> DataFrame:
    """One instance per completed block with its projected levels; usable from block end."""
    return blocks.withColumns({"family_id": F.lit(family), "available_at": C("block_end"), "body_move": C("close") - C("open"),
                               "direction": direction_of(), "levels": project_levels("open", "close", levels)})


def available_levels(instances: DataFrame, at) -> DataFrame:
    return instances.filter(C("available_at") <= F.lit(at).cast("timestamp")).orderBy("available_at", "block_start", "symbol")


def explode_levels(instances: DataFrame) -> DataFrame:
    return (instances.withColumn("_l", F.explode("levels"))
            .select("symbol", "seg", "family_id", "block_date", "block_label", "block_index", "block_start", "block_end",
                    "available_at", "_l.level_id", "_l.coordinate", "_l.level_price"))


def neighbour_bars(bars: DataFrame, horizon: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Bars with the ranges of their neighbours; the last ``horizon`` bars of a segment are dropped.

    The successor of the last kept bar is not visible.
    """
    def fn(d, w):
        far = F.lead("pos", horizon + 1).over(w).isNotNull()
        d = d.withColumns({"prev_high": F.lag("high").over(w), "prev_low": F.lag("low").over(w),
                           "next_high": F.when(far, F.lead("high").over(w)), "next_low": F.when(far, F.lead("low").over(w))})
        return d.withColumn("_usable", F.lead("pos", horizon).over(w).isNotNull() if horizon else F.lit(True))
    return chunked(bars, fn, 1, horizon + 1, chunk_rows).filter("_usable").drop("_usable")


def segment_ends(bars: DataFrame) -> DataFrame:
    """Last bar position and time per segment."""
    return bars.groupBy("symbol", "seg").agg(F.max("pos").alias("last_pos"), F.max("ts").alias("last_ts"))


def level_contacts(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """(level, bar) pairs where the bar touches the level or jumps across it.

    ``bars`` carry prev_high/prev_low of the previous usable bar of the segment.  The
    first contact bar of a level ignores the jump from before it became available.
    """
    lo, hi = F.least("low", F.coalesce("prev_high", "low")), F.greatest("high", F.coalesce("prev_low", "high"))
    widths = (bars.groupBy("symbol").agg(F.avg(hi - lo).alias("_mean"))
              .select("symbol", F.when(C("_mean") > 0, C("_mean")).otherwise(F.lit(1.0)).alias("_w")))
    b = (bars.join(widths, "symbol")
         .withColumn("_p", F.explode(F.sequence(F.floor(lo / C("_w")), F.floor(hi / C("_w")))))
         .select("symbol", "seg", "_p", "pos", C("ts").alias("bar_ts"), "high", "low", "prev_high", "prev_low",
                 "next_high", "next_low"))
    l = levels.join(widths, "symbol").withColumn("_p", F.floor(C("level_price") / C("_w"))).drop("_w")
    price, first = C("level_price"), C("bar_ts") == C("available_at")
    touch = (C("low") <= price) & (price <= C("high"))
    jump = ~first & (((C("prev_low") > price) & (C("high") < price)) | ((C("prev_high") < price) & (C("low") > price)))
    return (l.join(b, ["symbol", "seg", "_p"]).filter((C("bar_ts") >= C("available_at")) & (touch | jump))
            .select(*LEVEL_KEY, "pos", "high", "low", "next_high", "next_low", touch.alias("touched"),
                    (C("high") > price).alias("above"), (C("low") < price).alias("below"),
                    (C("pos") - C("start_pos")).alias("bar_index")))


def place_levels(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """Levels whose first bar exists, with that bar's position and the last usable bar of the segment.

    Segments have no holes, so these two positions also prove that every grid bar is present.
    """
    starts = bars.select("symbol", "seg", C("ts").alias("available_at"), C("pos").alias("start_pos"),
                         C("high").alias("first_high"), C("low").alias("first_low"))
    return (levels.join(starts, ["symbol", "seg", "available_at"])
            .join(segment_ends(bars), ["symbol", "seg"]).withColumn("bars_observed", C("last_pos") - C("start_pos") + 1))


def level_history(placed: DataFrame, contacts: DataFrame, step: int) -> DataFrame:
    """Touch counts and first/last touch per level over all observed bars."""
    t = (contacts.filter("touched").groupBy(*LEVEL_KEY)
         .agg(F.count("*").alias("touched_bars"), F.min("bar_index").alias("first_touch"), F.max("bar_index").alias("last_touch")))
    return (placed.join(t, list(LEVEL_KEY), "left")
            .withColumns({"touched_bars": F.coalesce("touched_bars", F.lit(0)).cast("long"),
                          "minutes_to_first_touch": C("first_touch") * (step / 60)}))


def level_runs(placed: DataFrame, contacts: DataFrame) -> DataFrame:
    """Maximal ABOVE / TOUCH / BELOW runs per level with their neighbours.

    The state can change only at the first bar, at a touch, after a touch or at a jump,
    so runs come from contact rows; everything after the one shuffle on the level key
    keeps that partitioning.
    """
    by = W.partitionBy(*LEVEL_KEY).orderBy("pos")
    c = placed.join(contacts, list(LEVEL_KEY), "left")
    adjacent = lambda shift, gap: F.coalesce((shift("pos").over(by) == C("pos") + gap) & shift("touched").over(by), F.lit(False))
    c = c.withColumns({"_first": F.row_number().over(by) == 1, "_joined": adjacent(F.lag, -1), "_goes_on": adjacent(F.lead, 1)})
    c = c.withColumn("_touch_no", F.sum(F.when(C("touched") & ~C("_joined"), 1).otherwise(0)).over(by))
    episode = W.partitionBy(*LEVEL_KEY, "_touch_no")
    hit = lambda f: F.max(F.when(C("touched"), C(f))).over(episode)
    c = c.withColumns({"_above": hit("above"), "_below": hit("below")})
    price = C("level_price")
    no = F.lit(None).cast("boolean")
    point = lambda pos, state, above=no, below=no: F.struct(pos.alias("p"), state.alias("state"), above.alias("above"), below.alias("below"))
    touched = F.coalesce(C("touched"), F.lit(False))
    side = lambda h, l: F.when(C(l) > price, "ABOVE").otherwise("BELOW")
    points = F.array(
        F.when(C("_first") & ~((C("first_low") <= price) & (price <= C("first_high"))), point(C("start_pos"), side("first_high", "first_low"))),
        F.when(touched & ~C("_joined"), point(C("pos"), F.lit("TOUCH"), C("_above"), C("_below"))),
        F.when(touched & ~C("_goes_on") & (C("pos") < C("last_pos")), point(C("pos") + 1, side("next_high", "next_low"))),
        F.when(C("pos").isNotNull() & ~touched, point(C("pos"), side("high", "low"))))
    r = (c.withColumn("_pt", F.explode(F.array_compact(points)))
         .select(*placed.columns, C("_pt.p").alias("run_pos"), "_pt.state", C("_pt.above").alias("traded_above"),
                 C("_pt.below").alias("traded_below")))
    order = W.partitionBy(*LEVEL_KEY).orderBy("run_pos")
    end = F.coalesce(F.lead("run_pos").over(order), C("last_pos") + 1)
    r = r.withColumns({"run_index": (F.row_number().over(order) - 1).cast("long"), "bar_count": end - C("run_pos"),
                       "prev_state": F.lag("state").over(order), "next_state": F.lead("state").over(order),
                       "next_pos": F.lead("run_pos").over(order)})
    return r.withColumns({"prev_count": F.lag("bar_count").over(order), "next_count": F.lead("bar_count").over(order),
                          "first_index": C("run_pos") - C("start_pos")})


def touch_patterns(runs: DataFrame, step: int) -> DataFrame:
    """Touch runs with code, side flags, neighbour lengths, offsets and sweep / reclaim."""
    touches = W.partitionBy(*LEVEL_KEY).orderBy("run_pos")
    before, after = F.coalesce("prev_state", F.lit("START")), F.coalesce("next_state", F.lit("END"))
    both = C("prev_state").isNotNull() & C("next_state").isNotNull()
    code = F.when(C("prev_state").isNull() & C("next_state").isNull(), "TOUCH_ONLY").otherwise(F.concat_ws("_", before, F.lit("TOUCH"), after))
    t = runs.filter(C("state") == "TOUCH").withColumns({
        "pattern_index": (F.row_number().over(touches) - 1).cast("long"), "pattern_code": code,
        "same_side": F.when(both, C("prev_state") == C("next_state")), "opposite_side": F.when(both, C("prev_state") != C("next_state")),
        "minutes_to_touch": C("first_index") * (step / 60)})
    is_ = lambda v: C("pattern_code") == v
    sweep = F.when(is_("BELOW_TOUCH_BELOW") & C("traded_above"), "ABOVE").when(is_("ABOVE_TOUCH_ABOVE") & C("traded_below"), "BELOW")
    return t.withColumns({"sweep": sweep, "reclaim": F.when(both, C("next_state"))})


def touch_anchors(patterns: DataFrame) -> DataFrame:
    """Evidence is the first bar after a touch run; a run that ends the history has none."""
    return (patterns.filter("next_pos is not null")
            .withColumns({"anchor_kind": F.lit("TOUCH_TRANSITION"), "pos": C("next_pos"),
                          "anchor_id": F.concat(F.lit("TOUCH_TRANSITION_"), C("pattern_index").cast("string")),
                          "checkpoint_bars": F.lit(None).cast("int")}))


def untouched_anchors(history: DataFrame, checkpoints=(4, 8, 16, 32)) -> DataFrame:
    """Levels whose first n observed bars never touch them."""
    clear = lambda n: (C("bars_observed") >= n) & (C("first_touch").isNull() | (C("first_touch") >= n))
    return (history.withColumn("checkpoint_bars", F.explode(F.array_compact(F.array(*[F.when(clear(n), F.lit(n)) for n in checkpoints]))))
            .withColumns({"anchor_kind": F.lit("UNTOUCHED_CHECKPOINT"), "pos": C("start_pos") + C("checkpoint_bars") - 1,
                          "anchor_id": F.concat(F.lit("UNTOUCHED_CHECKPOINT_"), C("checkpoint_bars").cast("string")),
                          "pattern_index": F.lit(None).cast("long"), "pattern_code": F.lit(None).cast("string"),
                          "sweep": F.lit(None).cast("string"), "reclaim": F.lit(None).cast("string")}))


# fixed values: identity columns shared by both anchor kinds
ANCHOR_COLUMNS = ("symbol", "seg", "pos", "anchor_kind", "anchor_id", "family_id", "block_date", "block_label", "block_index",
                  "block_start", "block_end", "available_at", "level_id", "coordinate", "level_price", "pattern_index",
                  "pattern_code", "checkpoint_bars", "sweep", "reclaim")


def all_anchors(patterns: DataFrame, history: DataFrame, checkpoints=(4, 8, 16, 32)) -> DataFrame:
    return touch_anchors(patterns).select(*ANCHOR_COLUMNS).unionByName(
        untouched_anchors(history, checkpoints).select(*ANCHOR_COLUMNS))


def observe_contacts(placed: DataFrame, contacts: DataFrame, bars: DataFrame) -> DataFrame:
    """Full per-bar facts (positions, body touch, wick only, ...) of the touched bars."""
    b = bars.select("symbol", "seg", "pos", "ts", "open", "high", "low", "close")
    t = contacts.filter("touched").select(*LEVEL_KEY, "pos", "bar_index")
    return placed.select(*LEVEL_KEY, "level_price").join(t, list(LEVEL_KEY)).join(b, ["symbol", "seg", "pos"]).withColumns(observe_level())
