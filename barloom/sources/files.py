"""Declared-mapping file reads, pruned feature reads and the bar archive."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barloom.functions.calendar import parse_ts

C = F.col
BAR_COLUMNS = ("open", "high", "low", "close", "tick_volume", "spread", "real_volume")


def read_market_files(spark: SparkSession, paths: Sequence[str], mapping: Mapping[str, str], *, fmt: str = "csv",
                      ts_format: str = "ISO", zone: str = "UTC", header: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """Read CSV / CSV.GZ / Parquet with a declared mapping {target: source}.

    Values stay strings in ``raw`` for audit; typed columns use try-casts, and every row
    keeps its file and position for deterministic ordering.
    """
    wanted = list(dict.fromkeys(mapping.values()))
    if fmt == "csv":
        columns = list(header or wanted)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("sep", sep)
              .option("mode", "PERMISSIVE").csv(list(paths)))
    else:
        df = spark.read.parquet(*paths)
    raw = F.struct(*[C(f"`{c}`").cast("string").alias(c) for c in wanted])
    out = {}
    for target, source in mapping.items():
        text = C(f"`{source}`").cast("string")
        out[target] = parse_ts(text, ts_format, zone) if target == "ts" else text if target == "symbol" else text.try_cast("double")
    return df.select(*[v.alias(k) for k, v in out.items()], raw.alias("raw"), C("_metadata.file_path").alias("file"),
                     F.monotonically_increasing_id().alias("seq"))


def read_features(spark: SparkSession, path: str, columns: Sequence[str], start=None, end=None, ts: str = "ts") -> DataFrame:
    """Column-pruned read with the time range pushed into the scan."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(C(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(C(ts) < F.lit(end).cast("timestamp"))
    return df.select(*columns)


def merge_bars(parts: DataFrame, keys: Sequence[str] = ("symbol", "ts"), columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): identical copies collapse, differing observations conflict.

    One combinable aggregation per key: smallest and largest observation are equal exactly
    when all copies agree.
    """
    cols = list(columns or [c for c in parts.columns if c not in keys])
    row = F.struct(*cols)
    g = parts.groupBy(*keys).agg(F.min(row).alias("_lo"), F.max(row).alias("_hi"), F.count("*").alias("copies"))
    same = C("_lo").eqNullSafe(C("_hi"))
    merged = g.filter(same).select(*keys, "_lo.*", "copies")
    bad = g.filter(~same).select(*keys, "copies")
    return merged, bad


def conflict_rows(parts: DataFrame, conflicts: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """All observations at conflicting keys, for the quarantine table."""
    return parts.join(conflicts.select(*keys), list(keys), "left_semi")


def write_bars_monthly(parts: DataFrame, path: str, quarantine: str, keys: Sequence[str] = ("symbol", "ts")) -> int:
    """Idempotent merge into symbol/year/month Parquet; a batch with conflicts is not written.

    Only the touched months are read and replaced (dynamic partition overwrite); the
    merged batch is staged first, because its months are read and overwritten.
    """
    from barloom.sources.stage import stage
    spark = parts.sparkSession
    month = lambda d: d.withColumns({"year": F.year("ts"), "month": F.month("ts")})
    cols = [c for c in parts.columns if c not in keys]
    try:
        old = spark.read.schema(month(parts).schema).parquet(path)
        touched = month(parts).select("symbol", "year", "month").distinct()
        old = old.join(touched, ["symbol", "year", "month"], "left_semi").select(*parts.columns)
        both = old.unionByName(parts)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        both = parts
    merged, bad = merge_bars(both, keys, cols)
    conflicts = bad.count()
    if conflicts:
        conflict_rows(both, bad, keys).write.mode("append").parquet(quarantine)
        return conflicts
    ready = stage(month(merged.drop("copies")))
    (ready.repartition("symbol", "year", "month").sortWithinPartitions("symbol", "year", "month", "ts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol", "year", "month").parquet(path))
    return 0


def completed_only(bars: DataFrame, as_of, step: int = 60) -> DataFrame:
    """Bars closed at or before the cut-off."""
    return bars.filter(F.unix_seconds("ts") + step <= F.unix_seconds(F.lit(as_of).cast("timestamp")))


def archive_increment(archive: DataFrame, fetched: DataFrame, as_of, *, step: int = 60, overlap_minutes: int = 60,
                      keys: Sequence[str] = ("symbol", "ts")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, conflicts, revisions) after adding completed fetched bars.

    Only fetched rows from ``overlap_minutes`` before the archive's end of each symbol
    count; a month's revision is a digest of its content, independent of row order.
    """
    ends = archive.groupBy("symbol").agg(F.max("ts").alias("_end"))
    new = completed_only(fetched, as_of, step).join(ends, "symbol", "left")
    new = new.filter(C("_end").isNull() | (F.unix_seconds("ts") >= F.unix_seconds("_end") - overlap_minutes * 60)).drop("_end")
    merged, bad = merge_bars(archive.unionByName(new.select(*archive.columns)), keys)
    content = F.xxhash64(*[c for c in merged.columns if c != "copies"])
    rev = merged.groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("bars"), F.bit_xor(content).alias("revision"))
    return merged, bad, rev


def table_fingerprint(df: DataFrame, pos: str, chunk_rows: int = 1024) -> DataFrame:
    """SHA-256 of an ordered table: row digests, chunk digests, digest of chunk digests.

    A chunk holds at most ``chunk_rows`` digests, and the last level one per chunk, so the
    result does not depend on partitioning; levels repeat until one row remains, four times
    at least.  Reads the last position first to know how many levels that takes.
    """
    cols = [C(f"`{c}`") for c in df.columns]
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}), 256)
    level = df.select(C(pos).cast("long").alias("p"), row.alias("h"), F.lit(1).cast("long").alias("n"))
    last, levels = df.agg(F.max(C(pos).cast("long"))).first()[0] or 0, 4
    while chunk_rows ** levels <= last:
        levels += 1
    for _ in range(levels):
        level = (level.groupBy(F.floor(C("p") / F.lit(chunk_rows)).alias("p"))
                 .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("h"),
                      F.sum("n").alias("n")))
    return level.select(C("n").alias("rows"), C("h").alias("fingerprint"))


def chronological_slice(df: DataFrame, start, end, role: str, ts: str = "ts") -> DataFrame:
    """Half-open UTC slice tagged with its role."""
    return df.filter((C(ts) >= F.lit(start).cast("timestamp")) & (C(ts) < F.lit(end).cast("timestamp"))).withColumn("role", F.lit(role))


def warmup_tail(indexed: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last n bars per key: positions make it a filter against one maximum per key."""
    last = indexed.groupBy(*keys).agg(F.max("pos").alias("_last"))
    return indexed.join(last, list(keys)).filter(C("pos") > C("_last") - n).drop("_last")


def write_event_view(events: DataFrame, path: str, predictors: Sequence[str]) -> DataFrame:
    """Compact zstd table for rule evaluation: identity, reference and predictors, never targets.

    The row index is the rank in time order.
    """
    from barloom.operators.timeline import number_rows
    from barloom.plans.event_table import EVENT_ORDER, predictors_only
    predictors_only(events.select(*[C(f"`{c}`") for c in predictors]))
    base = ["meta.symbol", "meta.evidence_end_utc", "meta.reference_price", "x.anchor_kind", "x.geometry.family_id",
            "x.geometry.level_id", "meta.level_price"]
    order = ["`meta.evidence_end_utc`", *[f"`{c}`" for c in EVENT_ORDER if c != "meta.evidence_end_utc"]]
    n = number_rows(events, order, "row_index")
    view = n.select("row_index", *[C(f"`{c}`") for c in dict.fromkeys([*base, *predictors])])
    (view.repartitionByRange("row_index").sortWithinPartitions("row_index").write.mode("overwrite")
     .option("compression", "zstd").parquet(path))
    return events.sparkSession.read.parquet(path)


def export_features(indexed: DataFrame, step: int, path: str, *, minimum_ready: int = 5, **kw) -> DataFrame:
    """Feature table of a slice with lineage and fingerprint; too few ready rows is an error."""
    from barloom.operators.windows import universal_features
    f = universal_features(indexed, step, **kw)
    f.write.mode("overwrite").option("compression", "zstd").partitionBy("symbol").parquet(path)
    spark = indexed.sparkSession
    out = spark.read.parquet(path)
    if out.filter("feature_ready").limit(minimum_ready).count() < minimum_ready:
        raise ValueError(f"fewer than {minimum_ready} ready feature rows")
    return (out.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("close_ts").alias("first"), F.max("close_ts").alias("last"),
                                        F.sum(C("feature_ready").cast("long")).alias("ready"),
                                        F.bit_xor(F.xxhash64(*[c for c in out.columns])).alias("fingerprint")))
