"""As-of, interval, first-hit, near-duplicate and ledger joins as equi-joins and scans."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.timeline import number_rows, running
from barloom.sources.stage import stage

C = F.col
FAN = 64
PART = 65536  # intervals or instants that one task orders


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df``; a repeated key fails the job instead of multiplying a join."""
    n = F.count("*")
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(n.alias("_n"), *[F.any_value(c).alias(c) for c in cols])
    return g.withColumn("_ok", F.when(C("_n") > 1, F.raise_error(F.lit("right side of a many-to-one join is not unique"))).otherwise(True)).filter(
        "_ok is null or _ok").select(*df.columns)


def attach_state(trades: DataFrame, states: DataFrame, step: int = 900, entry: str = "entry_ts",
                 key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Left join of trades to the state at the floor of the entry time; status says matched or not."""
    floor = F.timestamp_seconds(F.floor(F.unix_seconds(entry) / F.lit(step)) * step)
    t = trades.withColumn("required_ts", floor)
    s = states.withColumnRenamed("ts", "required_ts").withColumn("_hit", F.lit(True))
    out = t.join(s, [*key, "required_ts"], "left")
    return out.withColumn("match_status", F.when(C("_hit"), "MATCHED").otherwise("NO_COMPLETE_VECTOR_AT_BOUNDARY")).drop("_hit")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], *, left_ts: str = "ts",
              right_ts: str = "ts", direction: str = "backward", prefix: str = "") -> DataFrame:
    """Latest right row at or before (or first at or after) each left row, of any age.

    Both sides meet in one time-ordered stream; the carried value is a two-level scan over chunks of equal depth, so
    neither a symbol nor its busiest day is ordered in one task.
    """
    sign = 1 if direction == "backward" else -1
    order = lambda ts, side: F.unix_micros(ts) * (2 * sign) + side
    v = F.struct(*[C(c) for c in values])
    u = (left.select(*by, order(left_ts, 1).alias("_o"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(
        right.select(v.alias("v")).schema["v"].dataType).alias("_v"))
        .unionByName(right.select(*by, order(right_ts, 0).alias("_o"), F.lit(None).cast(
            left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_l"), v.alias("_v"))))
    out = running(u, {"_m": ("last", C("_v"))}, by=by, order="_o", chunk_rows=None)
    return out.filter("_l is not null").select("_l.*", *[C("_m")[c].alias(f"{prefix}{c}") for c in values])


def range_join(points: DataFrame, ranges: DataFrame, by: Sequence[str], *, ts: str, start: str, end: str,
               bucket_seconds: int = 86400) -> DataFrame:
    """Points inside half-open ranges: ranges are cut into time buckets, then an equi-join and the exact test."""
    p = points.withColumn("_b", F.floor(F.unix_seconds(ts) / F.lit(bucket_seconds)))
    first = F.floor(F.unix_seconds(start) / F.lit(bucket_seconds))
    last = F.floor((F.unix_micros(end) - 1) / F.lit(bucket_seconds * 1_000_000))
    r = ranges.filter(C(start) < C(end)).withColumn("_b", F.explode(F.sequence(first, last)))
    return p.join(r, [*by, "_b"]).filter((C(ts) >= C(start)) & (C(ts) < C(end))).drop("_b")


def range_summary(points: DataFrame, ranges: DataFrame, by: Sequence[str], value: str, *, ts: str, start: str, end: str, part: int = PART) -> DataFrame:
    """(columns of ``ranges``, n, high): how many points lie in each half-open range and their highest value; ranges without points are left out.

    No (point, range) pair is formed. Points and the ends of ranges meet in one order by instant, cut into chunks of ``part`` rows. A range within
    a chunk is answered there; a longer one from what its end chunks hold of it and from maxima over 1, 2, 4, ... chunks between them.
    """
    by, kept = list(by), ranges.columns
    known = lambda *cols: reduce(lambda a, b: a & b, [C(c).isNotNull() for c in [*by, *cols]])
    r = stage(ranges.filter((C(start) < C(end)) & known(start, end)).withColumn("_r", F.monotonically_increasing_id()))
    none = F.lit(None).cast("long")
    # an end of a range stands before the points at its instant; kind 0 starts, 1 ends, 2 is a point
    ends = F.explode(F.array(*[F.struct(F.unix_micros(c).alias("t"), F.lit(k).alias("kind")) for k, c in enumerate((start, end))]))
    e = (r.select(*by, "_r", ends.alias("_v")).select(*by, "_v.*", "_r", F.lit(None).cast("double").alias("v"))
         .unionByName(points.filter(known(ts)).select(*by, F.unix_micros(ts).alias("t"), F.lit(2).alias("kind"), none.alias("_r"), C(value).cast("double").alias("v"))))
    e = number_rows(e, [*by, "t", "kind", "_r", "v"], "pos").withColumns({
        "chunk": F.floor(C("pos") / F.lit(part)).cast("long"), "valued": C("v").isNotNull().cast("long"), "nans": F.coalesce(F.isnan("v"), F.lit(False)).cast("long")})
    counts = ("n", "valued", "nans")  # NaN is the highest value, and pandas takes it for null

    def within(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("pos")
        kind, v, chunk = d["kind"].to_numpy(), d["v"].to_numpy(), d["chunk"].iloc[0]
        point = kind == 2
        v = np.where(np.isnan(v), -np.inf, v)
        before = {"n": np.r_[0, np.cumsum(point)]} | {c: np.r_[0, np.cumsum(d[c].to_numpy())] for c in counts[1:]}
        tops = [v]
        while 2 << len(tops) <= 2 * len(v):
            half = 1 << (len(tops) - 1)
            tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
        marks = d[~point].assign(at=np.flatnonzero(~point)).pivot(index="_r", columns="kind", values="at").reindex(columns=[0, 1])
        first, last = marks[0].isna().to_numpy(), marks[1].isna().to_numpy()
        lo, hi = marks[0].fillna(0).to_numpy(np.int64), marks[1].fillna(len(v)).to_numpy(np.int64)
        high, level = np.full(len(lo), -np.inf), np.frexp(np.maximum(hi - lo, 1))[1] - 1
        for k in np.unique(level):
            at = (level == k) & (hi > lo)
            high[at] = np.maximum(tops[k][lo[at]], tops[k][hi[at] - (1 << k)])
        return pd.DataFrame({"_r": marks.index.to_numpy(np.int64), **{c: b[hi] - b[lo] for c, b in before.items()}, "high": high,
                             "from": pd.Series(np.where(last, chunk + 1, -1)), "to": pd.Series(np.where(first, chunk, -1))})

    parts = e.groupBy(*by, "chunk").applyInPandas(within, "_r long, n long, valued long, nans long, high double, from long, to long")
    parts = parts.groupBy("_r").agg(*[f(c).alias(c) for f, c in (*((F.sum, c) for c in counts), (F.max, "high"), (F.max, "from"), (F.max, "to"))])
    d = stage(r.join(parts, "_r"))
    # chunks between: numbered without holes per key, so leads reach 1, 2, 4, ... chunks on
    sums = e.groupBy(*by, "chunk").agg(F.sum((C("kind") == 2).cast("long")).alias("n"), F.sum("valued").alias("valued"), F.sum("nans").alias("nans"),
                                           F.coalesce(F.max(F.when(C("nans") == 0, C("v"))), F.lit(float("-inf"))).alias("_0"))
    line = W.partitionBy(*by).orderBy("chunk")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumns({f"_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in counts})
    levels = max(1, sums.groupBy(*by).count().agg(F.max("count")).first()[0] or 1).bit_length()
    for k in range(1, levels):
        sums = sums.withColumn(f"_{k}", F.greatest(f"_{k - 1}", F.coalesce(F.lead(f"_{k - 1}", 1 << (k - 1)).over(line), F.lit(float("-inf")))))
    sums = stage(sums.select(*by, "chunk", *[f"_{c}" for c in counts], F.array(*[C(f"_{k}") for k in range(levels)]).alias("tops")))
    far = C("from") < C("to")
    level = F.floor(F.log2((C("to") - C("from") + F.lit(0.5)))).cast("int")
    at = lambda tag, key: (sums.select(*[C(c).alias(f"_{tag}_{c}") for c in by], C("chunk").alias(f"_{tag}_chunk"), F.struct(*[f"_{c}" for c in counts], "tops").alias(tag)),
                           reduce(lambda a, b: a & b, [C(c) == C(f"_{tag}_{c}") for c in by]) & (C(key) == C(f"_{tag}_chunk")))
    d = d.withColumns({"_k": F.when(far, level), "_a": F.when(far, C("from")), "_z": F.when(far, C("to")), "_m": F.when(far, C("to") - F.pow(F.lit(2), level).cast("long"))})
    long = d.filter(far)
    for tag, key in (("lo", "_a"), ("hi", "_z"), ("mid", "_m")):
        long = long.join(*at(tag, key))
    long = long.withColumns({c: C(c) + C(f"hi._{c}") - C(f"lo._{c}") for c in counts} | {
                             "high": F.greatest("high", F.get("lo.tops", "_k"), F.get("mid.tops", "_k"))})
    cols = [*kept, *counts, "high"]
    out = d.filter(~far).select(*cols).unionByName(long.select(*cols)).filter("n > 0")
    return out.select(*kept, "n", F.when(C("nans") > 0, float("nan")).when(C("valued") > 0, C("high")).alias("high"))


def intervals_with_points(gaps: DataFrame, points: DataFrame, by: Sequence[str], *, lo: str, hi: str, ts: str = "ts") -> DataFrame:
    """Flag intervals that strictly contain a point, by comparing running point counts at both ends."""
    p = points.select(*by, C(ts).alias("_t")).distinct()
    counted = running(p.withColumn("_us", F.unix_micros("_t")), {"n": ("sum", F.lit(1).cast("long"))}, by=by, order="_us", chunk_rows=None)
    g = gaps.withColumn("_before_hi", C(hi) - F.expr("INTERVAL 1 MICROSECOND"))
    g = asof_join(g, counted, by, ["n"], left_ts=lo, right_ts="_t", prefix="lo_")
    g = asof_join(g, counted, by, ["n"], left_ts="_before_hi", right_ts="_t", prefix="hi_")
    inside = F.coalesce(C("hi_n"), F.lit(0)) > F.coalesce(C("lo_n"), F.lit(0))
    return g.withColumn("contains_point", inside).drop("_before_hi", "lo_n", "hi_n")


def overlapping_intervals(a: DataFrame, by: Sequence[str], *, id: str, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """Distinct pairs of overlapping intervals (strict on both ends) for interval catalogs.

    The pair is produced in the bucket of the later start only, so no pair repeats.
    """
    span = lambda s, e: F.sequence(F.floor(F.unix_seconds(s) / F.lit(bucket_seconds)),
                                   F.floor((F.unix_micros(e) - 1) / F.lit(bucket_seconds * 1_000_000)))
    x = a.filter(C(start) < C(end)).withColumn("_b", F.explode(span(start, end)))
    l = x.select(*by, "_b", C(id).alias("a_id"), C(start).alias("a_s"), C(end).alias("a_e"))
    r = x.select(*by, "_b", C(id).alias("b_id"), C(start).alias("b_s"), C(end).alias("b_e"))
    home = F.floor(F.unix_seconds(F.greatest("a_s", "b_s")) / F.lit(bucket_seconds)) == C("_b")
    return (l.join(r, [*by, "_b"]).filter((C("a_id") < C("b_id")) & (C("a_s") < C("b_e")) & (C("b_s") < C("a_e")) & home)
            .select(*by, "a_id", "b_id"))


def _beyond(pos: np.ndarray, rank: np.ndarray, n: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per asking row, the weight ``n`` of rows later in ``pos`` with a higher, and with a lower, rank.

    Ranks are split bit by bit: the first bit in which two ranks differ tells which is higher, so each bit is one stable sort and running sums.
    """
    more, less = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    order = np.argsort(pos, kind="stable")
    rank = rank - rank.min()
    for bit in range(int(rank.max()).bit_length()):
        at = order[np.argsort(rank[order] >> (bit + 1), kind="stable")]
        group, one = rank[at] >> (bit + 1), (rank[at] >> bit & 1).astype(bool)
        last = np.searchsorted(group, group, "right") - 1
        for out, there in ((more, one), (less, ~one)):
            total = np.cumsum(np.where(there, n[at], 0))
            out[at] += np.where(there, 0, total[last] - total)
    return more[asks], less[asks]


def overlap_counts(a: DataFrame, by: Sequence[str], *, id: str, start: str, end: str, part: int = PART) -> DataFrame:
    """(by, id, smaller, larger): with how many intervals of smaller and of larger id each interval overlaps (strict on both ends).

    No pair is formed. Ids are unique per ``by``. Of the intervals with a larger id, those that start at or after my end or end at or before my
    start are taken off. They are counted over ids in blocks and instants in chunks of ``part`` rows each: within a block by instant, within a
    chunk by block, and the rest from sums per (chunk, block). So each task orders a bounded number of rows, whatever overlaps.
    """
    by = list(by)
    x = number_rows(a.filter(C(start) < C(end)).select(*by, id, F.unix_micros(start).alias("_s"), F.unix_micros(end).alias("_e")), [*by, id], "_i")
    # side 0 looks for starts from my end on, side 1 (time reversed) for ends up to my start; a row that asks stands before those at its instant
    event = lambda side, point, t: F.struct(F.lit(side).alias("side"), F.lit(point).alias("n"), t.alias("t"))
    events = F.explode(F.array(event(0, 0, C("_e")), event(0, 1, C("_s")), event(1, 0, -C("_s")), event(1, 1, -C("_e"))))
    e = x.select(*by, "_i", events.alias("_v")).select(*by, "_v.side", "_v.t", C("_v.n").cast("long").alias("n"), "_i")
    e = number_rows(e, [*by, "side", "t", "n", "_i"], "pos").withColumns({
        "chunk": F.floor(C("pos") / F.lit(part)).cast("long"), "block": F.floor(C("_i") / F.lit(part)).cast("long")})
    line = [*by, "side"]
    # weight of each block in the chunks after a chunk, where it is not 0: it changes only at chunks that hold the block
    cells = e.filter("n = 1").groupBy(*line, "block", "chunk").agg(F.sum("n").alias("n"))
    in_block = W.partitionBy(*line, "block").orderBy("chunk")
    cells = cells.join(e.groupBy(*line).agg(F.min("chunk").alias("first")).withColumnsRenamed({c: f"_l_{c}" for c in line}),
                       [C(c).eqNullSafe(C(f"_l_{c}")) for c in line]).select(
        *line, "block", "chunk", F.coalesce(F.lag("chunk").over(in_block), C("first")).alias("from"),
        F.sum("n").over(in_block.rowsBetween(0, W.unboundedFollowing)).alias("n"))
    after = cells.filter("from < chunk").withColumn("part", F.explode(F.sequence("from", C("chunk") - 1)))
    none = F.lit(None).cast("long")
    rows = (e.select(*line, F.lit("block").alias("kind"), C("block").alias("part"), "pos", C("_i").alias("rank"), "n", "_i")
            .unionByName(e.select(*line, F.lit("chunk").alias("kind"), C("chunk").alias("part"), "pos", C("block").alias("rank"), "n", "_i"))
            .unionByName(after.select(*line, F.lit("chunk").alias("kind"), "part", F.lit((1 << 63) - 1).alias("pos"), C("block").alias("rank"), "n", none.alias("_i"))))

    def count(d: pd.DataFrame) -> pd.DataFrame:
        asks = (d["n"] == 0).to_numpy()
        more, less = _beyond(d["pos"].to_numpy(), d["rank"].to_numpy(), d["n"].to_numpy(), asks)
        return pd.DataFrame({"_i": d["_i"][asks].astype("int64"), "more": more, "less": less})

    apart = rows.groupBy(*line, "kind", "part").applyInPandas(count, "_i long, more long, less long").groupBy("_i").agg(F.sum("more").alias("_more"), F.sum("less").alias("_less"))
    group = x.groupBy(*by).agg(F.min("_i").alias("_first"), F.count("*").alias("_n")).withColumnsRenamed({c: f"_g_{c}" for c in by})
    d = x.join(apart, "_i").join(group, [C(c).eqNullSafe(C(f"_g_{c}")) for c in by])
    return d.select(*by, id, (C("_i") - C("_first") - C("_less")).alias("smaller"), (C("_first") + C("_n") - 1 - C("_i") - C("_more")).alias("larger"))


def concurrent_trades(trades: DataFrame, *, start: str = "entry_ts", end: str = "exit_ts", group: str = "symbol") -> DataFrame:
    """Per trade, how many trades of other groups overlap it (strict on both ends).

    No pairs are formed: overlaps = starts before my end - ends up to my start, once over
    all groups and once in my own, from running counts per distinct day or instant, scanned in chunks of equal depth.
    """
    point = trades.select(group, F.explode(F.array(
        F.struct(C(start).alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e"), (C(start) == C(end)).cast("int").alias("z")),
        F.struct(C(end).alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit(0).alias("z")))).alias("p"))
    sums = (point.groupBy(group, "p.t").agg(F.sum("p.s").alias("s"), F.sum("p.e").alias("e"), F.sum("p.z").alias("z")))
    sums = sums.withColumn("g", F.explode(F.array(C(group), F.lit("*")))).groupBy("g", "t").agg(
        *[F.sum(c).alias(c) for c in "sez"])
    is_date = dict(trades.dtypes)[start] == "date"
    axis = F.unix_date("t") if is_date else F.unix_micros("t")
    c = running(sums.withColumn("_o", axis.cast("long")), {"cs": ("sum", C("s")), "ce": ("sum", C("e"))}, by=("g",), order="_o", chunk_rows=None)
    c = c.select("g", "t", (C("cs") - C("s")).alias("starts_before"), C("ce").alias("ends_upto"), "z")
    out = trades
    for tag, g in (("all", F.lit("*")), ("own", C(group))):
        at_end = c.select(C("g").alias("_g"), C("t").alias(end), C("starts_before").alias(f"_{tag}_s"))
        at_start = c.select(C("g").alias("_g"), C("t").alias(start), C("ends_upto").alias(f"_{tag}_e"), C("z").alias(f"_{tag}_z"))
        out = out.withColumn("_g", g).join(at_end, ["_g", end]).join(at_start, ["_g", start]).drop("_g")
    still = (C(start) == C(end)).cast("int")
    count = lambda tag: C(f"_{tag}_s") - C(f"_{tag}_e") + still * C(f"_{tag}_z")
    return out.select(*trades.columns, (count("all") - count("own")).alias("overlaps"))


def overlap_summary(counted: DataFrame) -> DataFrame:
    return counted.agg(F.count("*").alias("trades"), F.sum((C("overlaps") > 0).cast("long")).alias("overlapping_trades"),
                       (F.sum((C("overlaps") > 0).cast("long")) / F.count("*")).alias("overlapping_share"),
                       (F.max("overlaps") + 1).alias("maximum_concurrent"))


# ---- first passage ------------------------------------------------------------------

def extreme_tree(bars: DataFrame, key: str = "symbol") -> list[DataFrame]:
    """64-ary tree of price extremes: level k packs up to 64 nodes per parent row.

    ``bars`` need key, pos, ts, open, high, low, ask_high, ask_low.  The depth follows the
    largest position, so the top level has one parent per symbol.
    """
    top = bars.agg(F.max("pos")).first()[0] or 0
    node = bars.select(key, C("pos").alias("id"), "low", "high", "ask_low", "ask_high")
    levels = []
    while True:
        packed = (node.withColumn("parent", F.floor(C("id") / F.lit(FAN)).cast("long")).groupBy(key, "parent")
                  .agg(F.array_sort(F.collect_list(F.struct("id", "low", "high", "ask_low", "ask_high"))).alias("items")))
        levels.append(packed)
        if top < FAN:
            return levels
        top //= FAN
        node = packed.select(key, C("parent").alias("id"), *[
            f(C(f"items.{c}")).alias(c) for c, f in
            (("low", F.array_min), ("high", F.array_max), ("ask_low", F.array_min), ("ask_high", F.array_max))])


def first_hit(queries: DataFrame, tree: list[DataFrame], start: str, cond: Callable[[Column], Column], name: str = "hit_pos",
              key: str = "symbol") -> DataFrame:
    """Position of the first bar at or after ``start`` whose extremes satisfy ``cond``.

    Going up, each level looks only at later siblings under the same parent; going down,
    only at the children of the node found.  Every step is one equi-join on (key, parent)
    and an array filter, so a query meets at most 64 nodes per level.
    """
    first = lambda items, ok: F.array_min(F.transform(F.filter(items, ok), lambda x: x["id"]))
    d = queries
    # misses get distinct negative keys: one shared null key would skew the join
    # (hashed over the whole row: rows without a start would otherwise share one)
    plain = [C(f"`{c}`") for c, kind in queries.dtypes if "map<" not in kind and kind != "variant"]
    spread = -1 - F.pmod(F.xxhash64(*plain), F.lit(1 << 20))

    def look(d, level, parent, ok, out):
        parent = F.coalesce(parent, spread)
        t = tree[level].select(key, C("parent").alias("_parent"), C("items").alias("_items"))
        return (d.withColumn("_parent", parent).join(t, [key, "_parent"], "left")
                .withColumn(out, first(C("_items"), ok)).drop("_parent", "_items"))
    for k in range(len(tree)):
        at = F.floor(C(start) / F.lit(FAN ** k)).cast("long")
        later = (lambda x: x["id"] >= at) if k == 0 else (lambda x: x["id"] > at)
        # rows resolved on a lower level look up nothing
        parent = F.floor(C(start) / F.lit(FAN ** (k + 1))).cast("long")
        done = F.lit(False)
        for j in range(k):
            done = done | C(f"_up{j}").isNotNull()
        d = look(d, k, F.when(~done, parent), lambda x: later(x) & cond(x), f"_up{k}")
    for k in range(len(tree) - 1, 0, -1):
        d = look(d, k - 1, C(f"_up{k}"), cond, "_down").withColumn(f"_up{k - 1}", F.coalesce(f"_up{k - 1}", "_down")).drop("_down")
    return d.withColumn(name, C("_up0")).drop(*[f"_up{k}" for k in range(len(tree))])


# ---- exclusion, near duplicates, ledgers ---------------------------------------------

def unseen(candidates: DataFrame, memory: DataFrame, key: str = "candidate_id") -> DataFrame:
    return candidates.join(memory.select(key).distinct(), key, "left_anti")


def exposed(candidates: DataFrame, exposure: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(exposure.select(*keys).distinct(), list(keys), "left_semi")


def near_duplicates(leaves: DataFrame, max_diff: int = 2, family: str = "family", spec: str = "spec_id") -> DataFrame:
    """Distinct specs of one family that differ in one to ``max_diff`` (1 or 2) leaves.

    A leaf differs when its value differs or one side lacks it.  Such a pair is equal once
    at most ``max_diff`` leaves are masked on each side, so masked digests meet by equality
    and the exact count is tested after.  Copies of a spec are one row with their number.
    """
    if max_diff not in (1, 2):
        raise ValueError(f"max_diff is {max_diff}, masks hold one or two leaves")
    kv = F.struct("path", "value")
    whole = leaves.groupBy(family, spec).agg(F.array_sort(F.collect_list(kv)).alias("kv"))
    groups = whole.groupBy(family, "kv").agg(F.min(spec).alias("rep"), F.count("*").alias("copies"))
    paths = F.transform("kv", lambda x: x["path"])
    none = F.array(F.array().cast("array<string>"))
    one = F.transform(paths, lambda p: F.array(p))
    two = F.flatten(F.transform(paths, lambda p: F.transform(F.filter(paths, lambda q: q > p), lambda q: F.array(p, q))))
    combos = F.concat(none, one, two) if max_diff >= 2 else F.concat(none, one)
    keyed = groups.withColumn("_drop", F.explode(combos))
    rest = F.filter("kv", lambda x: ~F.array_contains(C("_drop"), x["path"]))
    keyed = keyed.select(family, "rep", "kv", "copies", F.sha2(F.to_json(rest), 256).alias("mask"))
    side = lambda s: keyed.select(family, "mask", C("rep").alias(s), C("kv").alias(f"{s}_kv"), C("copies").alias(f"{s}_n"))
    pairs = side("a").join(side("b"), [family, "mask"]).filter("a < b")
    changed = F.array_union(F.array_except("a_kv", "b_kv"), F.array_except("b_kv", "a_kv"))
    diff = F.size(F.array_distinct(F.transform(changed, lambda x: x["path"])))
    return (pairs.withColumn("differing", diff).filter(C("differing").between(1, max_diff)).dropDuplicates([family, "a", "b"])
            .select(family, "a", "b", "differing", "a_n", "b_n"))


def pair_deals(deals: DataFrame, *, account: str = "account", seq: str = "deal_seq", size: int = 65536) -> DataFrame:
    """Pair each opening deal with the next deal; anything but in-out alternation is a fault.

    Cash is DECIMAL: profit is the sum of both sides.  The neighbour comes from position
    buckets, with one edge row per bucket.
    """
    row = F.struct("deal_id", "entry", "ts", "price", "cash", "side")
    d = deals.withColumns({"_b": F.floor(C(seq) / F.lit(size)), "_r": row})
    order = W.partitionBy(account, "_b").orderBy(seq)
    edge = (d.groupBy(account, "_b").agg(F.min_by("_r", seq).alias("_f"), F.max_by("_r", seq).alias("_l")))
    by = W.partitionBy(account).orderBy("_b")
    edge = edge.withColumns({"_nf": F.lead("_f").over(by), "_pl": F.lag("_l").over(by)}).drop("_f", "_l")
    d = d.join(edge, [account, "_b"]).withColumns({"_n": F.coalesce(F.lead("_r").over(order), "_nf"),
                                                   "_p": F.coalesce(F.lag("_r").over(order), "_pl")})
    fault = (F.when((C("entry") == "in") & (C("_n").isNull()), "OPEN_AT_END")
             .when((C("entry") == "in") & (C("_n.entry") != "out"), "OVERLAPPING_ENTRY")
             .when((C("entry") == "out") & (C("_p").isNull() | (C("_p.entry") != "in")), "EXIT_WITHOUT_ENTRY"))
    pair_ok = (C("entry") == "in") & fault.isNull()
    profit = C("cash") + C("_n.cash")
    return d.withColumn("fault", fault).filter(pair_ok | fault.isNotNull()).select(
        account, C("deal_id").alias("entry_deal"), C("ts").alias("entry_ts"), C("price").alias("entry_price"),
        F.when(pair_ok, C("_n.deal_id")).alias("exit_deal"), F.when(pair_ok, C("_n.ts")).alias("exit_ts"),
        F.when(pair_ok, C("_n.price")).alias("exit_price"), F.when(pair_ok, profit).alias("profit"),
        F.when(pair_ok, F.when(profit > 0, "WIN").when(profit < 0, "LOSS").otherwise("ZERO")).alias("outcome"), "fault")


def balance_faults(deals: DataFrame, *, account: str = "account", seq: str = "deal_seq", size: int = 65536) -> DataFrame:
    """Deals whose stated balance differs from the exact running sum of cash."""
    r = running(deals, {"running_balance": ("sum", C("cash"))}, by=(account,), order=seq, chunk_rows=size)
    return r.filter(C("running_balance") != C("balance"))


def reconcile_cash(ledger: DataFrame, deals: DataFrame, *, tolerance: float = 1e-9) -> DataFrame:
    """Ledger rows against both of their deals: gross, commission, swap sums within tolerance."""
    side = lambda tag: deals.select(C("deal_id").alias(f"{tag}_deal"), F.struct("gross", "commission", "swap").alias(tag))
    j = ledger.join(side("entry"), "entry_deal", "left").join(side("exit"), "exit_deal", "left")
    total = lambda f: C(f"entry.{f}") + C(f"exit.{f}")
    ok = F.lit(True)
    for f in ("gross", "commission", "swap"):
        ok = ok & (F.abs(C(f) - total(f)) <= tolerance)
    return j.withColumn("reconciled", F.coalesce(ok, F.lit(False))).drop("entry", "exit")
