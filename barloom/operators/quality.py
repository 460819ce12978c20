"""Cleaning, gap inventories, integrity reports and provider comparisons."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.functions.calendar import WeekProfile, classify_gap, weekday
from barloom.functions.scalars import finite
from barloom.operators.stats import join_ns, quantiles
from barloom.operators.timeline import epoch, index_bars, running

C = F.col
PRICES = ("open", "high", "low", "close")


def row_fault(step: int, optional: Sequence[str] = ("tick_volume", "spread", "real_volume"), available: Sequence[str] = ()) -> Column:
    """First matching fault label of a raw bar, or VALID."""
    bad_price = ~finite(C("open"))
    nonpos = C("open") <= 0
    for p in PRICES[1:]:
        bad_price, nonpos = bad_price | ~finite(C(p)), nonpos | (C(p) <= 0)
    shape = (C("high") < F.greatest("open", "close")) | (C("low") > F.least("open", "close")) | (C("high") < C("low"))
    out = (F.when(C("ts").isNull(), "INVALID_TIMESTAMP").when(bad_price, "NONFINITE_PRICE").when(nonpos, "NONPOSITIVE_PRICE")
           .when(shape, "INVALID_OHLC").when(F.unix_micros("ts") % (step * 1_000_000) != 0, "OFF_GRID"))
    for c in optional:
        if c in available:
            v = C(c).cast("double")
            out = out.when(v.isNotNull() & (~finite(v) | (v < 0)), "OTHER_INVALID")
    return out.otherwise("VALID")


def sanitize(raw: DataFrame, step: int, *, seq: str = "seq", keys: Sequence[str] = ("symbol",), salt: int = 16) -> DataFrame:
    """Classify raw rows; exactly one VALID row survives per identical timestamp group.

    Copies at one timestamp are reduced to one summary row by combinable aggregates
    (count, smallest and largest payload hash, first valid source row), never collected.
    The summaries of repeated timestamps are salted so that one huge copy group is
    spread over ``salt`` join tasks.
    """
    keys = list(keys)
    payload = [c for c in (*PRICES, "tick_volume", "spread", "real_volume") if c in raw.columns]
    d = raw.withColumns({"_fault": row_fault(step, available=raw.columns),
                         "_hash": F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)})
    groups = (d.filter("ts is not null").groupBy(*keys, "ts")
              .agg(F.count("*").alias("_n"), F.min("_hash").alias("_h0"), F.max("_hash").alias("_h1"),
                   F.min(F.when(C("_fault") == "VALID", C(seq))).alias("_first"))
              .filter("_n > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))))
    d = d.withColumn("_salt", F.pmod(F.xxhash64(seq), F.lit(salt)).cast("int"))
    d = d.join(groups, [*keys, "ts", "_salt"], "left")
    label = (F.when(C("_n").isNull(), C("_fault")).when(C("_h0") != C("_h1"), "DUPLICATE_CONFLICT")
             .when((C("_fault") == "VALID") & (C(seq) != C("_first")), "DUPLICATE_IDENTICAL").otherwise(C("_fault")))
    return d.withColumn("classification", label).select(*raw.columns, "classification")


def audit_rows(classified: DataFrame) -> DataFrame:
    """Excluded rows with their original observation as JSON."""
    original = F.to_json(F.struct(*[C(c) for c in classified.columns if c != "classification"]), {"ignoreNullFields": "false"})
    return classified.withColumn("original_observation", F.when(C("classification") != "VALID", original))


def gap_inventory(classified: DataFrame, step: int, *, profile: WeekProfile = WeekProfile(), reset_minutes: int = 1,
                  continue_weekend: bool = True, reset_exclusion: bool = True, keys: Sequence[str] = ("symbol",),
                  bucket_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(segmented valid bars, gap table) of classified rows.

    A gap that contains an unreliable excluded timestamp always resets.  That test needs
    no range join: excluded rows are flagged events in the same ordered scan, and the
    count of events before each bar is a prefix sum.  A row without a timestamp could lie
    anywhere: every retained bar of its key is then a segment of its own, while the gap
    table keeps the segments that the located rows give.
    """
    keys = list(keys)
    valid = classified.filter(C("classification") == "VALID")
    bad = classified.filter(~C("classification").isin("VALID", "DUPLICATE_IDENTICAL") & C("ts").isNotNull())
    bucket = F.floor(epoch() / F.lit(step * bucket_rows))
    # distinct excluded instants strictly between two bars, as running counts
    marks = bad.select(*keys, "ts").distinct().withColumn("_bad", F.lit(1)).unionByName(
        valid.select(*keys, "ts").distinct().withColumn("_bad", F.lit(0)))
    marks = marks.groupBy(*keys, "ts").agg(F.max("_bad").alias("_bad"), F.min("_bad").alias("_only"))
    marks = _excluded_before(marks, keys, bucket)
    bars = valid.join(marks, [*keys, "ts"])

    def missing(prev, cur):
        return F.floor((F.unix_micros(cur["ts"]) - F.unix_micros(prev["ts"])) / F.lit(step * 1_000_000)) - 1

    def reset(prev, cur):
        kind = classify_gap(prev["ts"], cur["ts"], step, profile)
        hole = missing(prev, cur)
        weekend = kind == "EXPECTED_WEEKEND"
        hit = (cur["excluded"] > prev["excluded"]) if reset_exclusion else F.lit(False)
        go_on = (weekend & F.lit(continue_weekend))
        return (hole > 0) & (hit | (~go_on & (weekend | (hole * (step // 60) >= reset_minutes))))

    seg = index_bars(bars, step, keys=keys, reset=reset, carry=("excluded",), bucket_rows=bucket_rows)
    back = seg.select(*keys, C("ts").alias("prev_ts"), C("excluded").alias("_pe"))
    holes = seg.filter((F.unix_micros("ts") - F.unix_micros("prev_ts")) >= 2 * step * 1_000_000).join(back, [*keys, "prev_ts"])
    gaps = holes.select(
        *keys, C("prev_ts").alias("previous_ts"), C("ts").alias("next_ts"),
        (F.floor((F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(step * 1_000_000)) - 1).alias("missing_slots"),
        ((F.unix_micros("ts") - F.unix_micros("prev_ts")) / 60e6).alias("duration_minutes"),
        classify_gap("prev_ts", "ts", step, profile).alias("classification"),
        (C("excluded") > C("_pe")).alias("invalid_bar_exclusion"), (C("seg_pos") == 0).alias("reset"),
        C("seg").alias("next_segment_id"))
    unlocatable = classified.filter("classification = 'INVALID_TIMESTAMP'").select(*keys).distinct().withColumn("_lost", F.lit(True))
    seg = seg.join(unlocatable, keys, "left").withColumns({"seg": F.when(C("_lost"), C("pos")).otherwise(C("seg")), "seg_pos": F.when(C("_lost"), 0).otherwise(C("seg_pos"))})
    return seg.drop("excluded", "_lost"), gaps


def _excluded_before(marks: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Excluded-only instants before each instant, by bucket sums plus bucket offsets."""
    m = marks.withColumns({"_b": bucket, "_x": (C("_bad") * C("_only")).cast("long")})
    inner = W.partitionBy(*keys, "_b").orderBy("ts")
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    off = m.groupBy(*keys, "_b").agg(F.sum("_x").alias("_s")).select(
        *keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    return (m.withColumn("_l", F.sum("_x").over(inner)).join(off, [*keys, "_b"])
            .filter(C("_only") == 0).select(*keys, "ts", (C("_l") + C("_o")).alias("excluded")))


def weekend_closure(prev: Column, cur: Column) -> Column:
    """Friday from 20:00 to Sunday 20-23 or Monday up to 02:59, at most three days."""
    span = F.unix_seconds(cur) - F.unix_seconds(prev)
    return ((weekday(prev) == 4) & (F.hour(prev) >= 20) & (span <= 3 * 86400)
            & (((weekday(cur) == 6) & F.hour(cur).between(20, 23)) | ((weekday(cur) == 0) & (F.hour(cur) <= 2))))


def _previous(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Add ``prev_ts`` of distinct instants with bucket-edge carry."""
    d = df.withColumn("_b", bucket)
    inner = W.partitionBy(*keys, "_b").orderBy("ts")
    edges = d.groupBy(*keys, "_b").agg(F.max("ts").alias("_m"))
    edges = edges.withColumn("_e", F.lag("_m").over(W.partitionBy(*keys).orderBy("_b"))).drop("_m")
    return d.join(edges, [*keys, "_b"]).withColumn("prev_ts", F.coalesce(F.lag("ts").over(inner), "_e")).drop("_b", "_e")


def integrity_audit(raw: DataFrame, step: int, *, seq: str = "seq", keys: Sequence[str] = ("symbol",),
                    required: Sequence[str] = ("ts", *PRICES, "tick_volume"), bucket_rows: int = 4096) -> DataFrame:
    """Issue rows (category, code, ts, detail count) per key."""
    keys = list(keys)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    nulls = C(required[0]).isNull()
    for c in required[1:]:
        nulls = nulls | C(c).isNull()
    shape = row_fault(step)
    # order faults: a source position whose predecessor is later in time
    size = 65536
    o = raw.select(*keys, seq, "ts").withColumn("_b", F.floor(C(seq) / F.lit(size)))
    edge = o.groupBy(*keys, "_b").agg(F.max_by("ts", seq).alias("_m")).withColumn(
        "_e", F.lag("_m").over(W.partitionBy(*keys).orderBy("_b"))).drop("_m")
    back = (o.join(edge, [*keys, "_b"]).withColumn("_p", F.coalesce(F.lag("ts").over(W.partitionBy(*keys, "_b").orderBy(seq)), "_e"))
            .groupBy(*keys).agg(count(C("ts") < C("_p")).alias("out_of_order")))
    dup = raw.groupBy(*keys, "ts").agg((F.count("*") - 1).alias("_d")).groupBy(*keys).agg(F.sum("_d").alias("duplicate_timestamp"))
    facts = raw.groupBy(*keys).agg(
        count(nulls).alias("null_values"), count(shape.isin("NONFINITE_PRICE", "NONPOSITIVE_PRICE", "INVALID_OHLC")).alias("invalid_ohlc"),
        count(C("tick_volume") < 0).alias("invalid_volume_or_spread"))
    facts = facts.join(back, keys).join(dup, keys)
    names = ["null_values", "duplicate_timestamp", "out_of_order", "invalid_ohlc", "invalid_volume_or_spread"]
    errors = (facts.unpivot(keys, names, "code", "n").filter("n > 0")
              .select(*keys, F.lit("confirmed_data_error").alias("category"), "code", F.lit(None).cast("timestamp").alias("ts"), "n"))
    t = _previous(raw.select(*keys, "ts").filter("ts is not null").distinct(), keys, F.floor(epoch() / F.lit(step * bucket_rows)))
    gap = F.unix_micros("ts") - F.unix_micros("prev_ts")
    holes = t.filter(gap > step * 1_000_000).select(
        *keys, F.when(weekend_closure(C("prev_ts"), C("ts")), "expected_market_closure").otherwise("suspicious_gap").alias("category"),
        F.lit("missing_interval").alias("code"), "ts", F.floor(gap / F.lit(1_000_000)).alias("n"))
    return errors.unionByName(holes)


def integrity_status(issues: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    has = lambda v: F.max(F.when(C("category") == v, 1).otherwise(0)) == 1
    return issues.groupBy(*keys).agg(F.when(has("confirmed_data_error"), "error").when(has("suspicious_gap"), "warning")
                                     .otherwise("clean").alias("status"), F.count("*").alias("issues"))


def gap_report(indexed: DataFrame, step: int, large_minutes: int = 1440, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Expected and unexplained gap counts, missing slots and large gaps per key."""
    missing = F.floor((F.unix_seconds("ts") - F.unix_seconds("prev_ts")) / F.lit(step)) - 1
    g = indexed.withColumn("_m", F.when(missing > 0, missing)).withColumn("_exp", weekend_closure(C("prev_ts"), C("ts")))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return g.groupBy(*keys).agg(
        F.count("*").alias("rows"), n(C("_m").isNotNull() & C("_exp")).alias("expected_gaps"),
        n(C("_m").isNotNull() & ~C("_exp")).alias("unexplained_gaps"), F.coalesce(F.sum("_m"), F.lit(0)).alias("missing_slots"),
        n(~C("_exp") & ((C("_m") + 1) * (step // 60) >= large_minutes)).alias("large_gaps"))


def import_counters(ticks: DataFrame, *, file: str = "file", key: Sequence[str] = ("symbol", "ts", "bid", "ask")) -> DataFrame:
    """Row, invalid, crossed, rejected, duplicate and cross-file counters of an import, per symbol.

    A quote is invalid without an instant or with a null, non-finite or non-positive price, crossed if valid with ask below bid; both are rejected.
    Events repeat when the whole key does. The first aggregation runs per event key, so repeated events never meet in one task.
    """
    good = lambda c: C(c).isNotNull() & ~F.isnan(c) & (C(c) > 0) & (C(c) < float("inf"))
    valid = C("ts").isNotNull() & good("bid") & good("ask")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per_key = ticks.groupBy(*key).agg(F.count("*").alias("n"), n(~valid).alias("invalid"), n(valid & (C("ask") < C("bid"))).alias("crossed"),
                                      F.min(file).alias("f0"), F.max(file).alias("f1"))
    rejected = F.sum("invalid") + F.sum("crossed")
    return per_key.groupBy("symbol").agg(
        F.sum("n").alias("rows_read"), F.sum("invalid").alias("invalid_quotes"), F.sum("crossed").alias("crossed_quotes"),
        rejected.alias("rows_rejected"), (F.sum("n") - rejected).alias("rows_accepted"),
        F.sum(C("n") - 1).alias("duplicate_events"), F.sum(F.when(C("f0") != C("f1"), 1).otherwise(0)).alias("cross_file_keys"))


def compare_providers(a: DataFrame, b: DataFrame, pip: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Outer join of two bar feeds with signed, absolute and pip differences per column."""
    j = (a.select(*keys, "ts", F.struct(*PRICES).alias("a")).join(
        b.select(*keys, "ts", F.struct(*PRICES).alias("b")), [*keys, "ts"], "full_outer"))
    diff = {}
    for p in PRICES:
        d = C(f"a.{p}") - C(f"b.{p}")
        diff[f"{p}_diff"], diff[f"{p}_abs"], diff[f"{p}_pips"] = d, F.abs(d), d / pip
    presence = F.when(C("b").isNull(), "left_only").when(C("a").isNull(), "right_only").otherwise("both")
    return j.withColumns({**diff, "presence": presence})


def provider_summary(j: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = C("presence") == "both"
    sgn = lambda s: F.signum(C(f"{s}.close") - C(f"{s}.open"))
    ra, rb = (F.when(both, C(f"{s}.high") - C(f"{s}.low")) for s in "ab")
    flat = (F.stddev_pop(ra) == 0) | (F.stddev_pop(rb) == 0)
    middle = quantiles(j.filter("close_abs IS NOT NULL"), keys, "close_abs", {"close_median": 0.5, "close_p95": 0.95})
    sums = j.groupBy(*keys).agg(
        n(both).alias("matched"), n(C("presence") == "left_only").alias("missing_right"), n(C("presence") == "right_only").alias("missing_left"),
        F.avg(F.when(both, (sgn("a") == sgn("b")).cast("double"))).alias("direction_agreement"),
        F.when(~flat, F.corr(ra, rb)).alias("range_correlation"), F.max("close_abs").alias("close_max"))
    return join_ns(sums, middle, keys, "left")


def history_extent(indexed: DataFrame, step: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    gap = (F.unix_seconds("ts") - F.unix_seconds("prev_ts")) > step
    return indexed.groupBy(*keys).agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count("*").alias("rows"),
                                      F.sum(F.when(gap, 1).otherwise(0)).alias("gaps"))


def monthly_gap_minutes(gaps: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Gap minutes clipped to calendar months and split by class."""
    first, last = F.date_trunc("month", "previous_ts"), F.date_trunc("month", "next_ts")
    m = gaps.withColumn("month", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))))
    lo = F.greatest("previous_ts", "month")
    hi = F.least(C("next_ts"), C("month") + F.expr("INTERVAL 1 MONTH"))
    return (m.withColumn("_s", F.unix_seconds(hi) - F.unix_seconds(lo)).filter("_s > 0")
            .groupBy(*keys, F.date_format("month", "yyyy-MM").alias("month"), "classification")
            .agg(F.count("*").alias("gaps"), (F.sum("_s") / 60).alias("gap_minutes")))


def monthly_coverage(features: DataFrame, vector: Sequence[str], partial: Column | None = None,
                     keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Candles, partial candles, first complete vector and nulls per feature and month."""
    whole = C(vector[0]).isNotNull()
    for v in vector[1:]:
        whole = whole & C(v).isNotNull()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return features.groupBy(*keys, F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("candles"), n(partial if partial is not None else F.lit(False)).alias("partial"),
        n(whole).alias("complete_vectors"), F.min(F.when(whole, C("ts"))).alias("first_complete"),
        *[n(C(v).isNull()).alias(f"null_{v}") for v in vector])


def duplicate_content(files: DataFrame, digest: str = "digest") -> DataFrame:
    """Digests that occur in more than one file."""
    return files.groupBy(digest).agg(F.count("*").alias("files"), F.min("file").alias("first_file")).filter("files > 1")


def split_segments(df: DataFrame, seg: str = "segment_id", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Segment ids that appear in more than one run of the time order (should be none)."""
    keys = list(keys)
    r = running(df.withColumn("_s", C(seg)), {"_old": ("prev", C("_s"))}, by=keys)
    starts = r.filter(C("_old").isNull() | (C("_old") != C("_s")))
    return starts.groupBy(*keys, C("_s").alias(seg)).agg(F.count("*").alias("runs")).filter("runs > 1")


def verify_hash_chain(log: DataFrame, *, seq: str = "seq", content: str = "content", prev: str = "previous_hash",
                      entry: str = "entry_hash", genesis: str = "0" * 64, size: int = 65536) -> DataFrame:
    """Rows whose link or recomputed hash is wrong; every check is independent per row."""
    d = log.withColumn("_b", F.floor(C(seq) / F.lit(size)))
    edge = d.groupBy("_b").agg(F.max_by(entry, seq).alias("_m")).withColumn(
        "_e", F.lag("_m").over(W.partitionBy(F.lit(0)).orderBy("_b"))).drop("_m")
    link = F.coalesce(F.lag(entry).over(W.partitionBy("_b").orderBy(seq)), C("_e"), F.lit(genesis))
    ok_hash = F.sha2(F.concat(C(prev), C(content)), 256) == C(entry)
    d = d.join(edge, "_b").withColumn("fault", F.when(C(prev) != link, "BROKEN_LINK").when(~ok_hash, "BAD_HASH"))
    return d.filter("fault is not null").drop("_b", "_e")
