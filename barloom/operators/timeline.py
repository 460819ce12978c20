"""Ordered scans over long time series without one-task-per-symbol windows.

A bar table has few symbols, so ``Window.partitionBy('symbol')`` would send a
third of the data to one task.  Everything ordered is built from three steps:

* ``index_bars``   numbers rows and continuity segments with two-level prefix
  sums: time buckets first, then one summary row per bucket.
* ``chunked``      cuts the numbered rows into fixed-size chunks and copies a
  bounded halo of neighbours into each chunk, so any bounded row frame is exact
  inside ``(symbol, chunk, seg)``.
* ``running``      unbounded running aggregates: chunk-local window plus the
  carry of the earlier chunks' summaries.

A bar is unique per (symbol, ts) on a grid, so a bucket of ``bucket_rows`` grid
steps can never hold more rows than that.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 4096
KEYS = ("symbol",)


def epoch(ts: str | Column = "ts") -> Column:
    return F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)


def any_gap(step: int) -> Callable[[Column, Column], Column]:
    """Default continuity rule: any missing slot starts a new segment."""
    return lambda prev, cur: (epoch(cur["ts"]) - epoch(prev["ts"])) > step


def index_bars(bars: DataFrame, step: int, *, keys: Sequence[str] = KEYS,
               reset: Callable[[Column, Column], Column] | None = None,
               parent: str | None = None, carry: Sequence[str] = (),
               bucket_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``prev_ts, pos, seg, seg_pos`` (0-based) to unique, on-grid bars.

    ``pos`` counts bars of a key, ``seg`` counts continuity segments and
    ``seg_pos`` restarts in each segment.  ``reset(prev, cur)`` sees structs of ts
    and the ``carry`` columns; ``parent`` keeps an existing segment column instead.
    The rows are shuffled once, on (keys, time bucket); only one summary row per
    bucket is ordered per key.
    """
    if parent:
        carry = [*carry, parent]
        reset = lambda prev, cur: prev[parent] != cur[parent]
    reset = reset or any_gap(step)
    keys = list(keys)
    part = [*keys, "_bucket"]
    by_time = W.partitionBy(*part).orderBy("ts")
    rows = (bars.withColumn("_bucket", F.floor(epoch() / F.lit(step * bucket_rows)))
            .withColumn("_k", F.struct("ts", *carry))
            .withColumn("_prev", F.lag("_k").over(by_time))
            .withColumn("_n", F.row_number().over(by_time))
            .withColumn("_cut", F.coalesce(reset(F.col("_prev"), F.col("_k")), F.lit(False)).cast("long"))
            .withColumn("_cuts", F.sum("_cut").over(by_time))
            .withColumn("_at", F.max(F.when(F.col("_cut") == 1, F.col("_n") - 1)).over(by_time)))
    order = W.partitionBy(*keys).orderBy("_bucket")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    new = (F.col("_head") == 1) | F.col("_prev_last").isNull()
    buckets = (rows.groupBy(*part)
               .agg(F.count("*").alias("_size"), F.min_by("_k", "ts").alias("_first"), F.max_by("_k", "ts").alias("_last"),
                    F.sum("_cut").alias("_inner"), F.max("_at").alias("_inner_at"))
               .withColumn("_prev_last", F.lag("_last").over(order))
               .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
               .withColumn("_head", F.coalesce(reset(F.col("_prev_last"), F.col("_first")), F.lit(False)).cast("long"))
               .withColumn("_seg0", F.coalesce(F.sum(F.col("_inner") + F.col("_head")).over(before), F.lit(0)) + F.col("_head"))
               .withColumn("_start", F.coalesce(F.col("_inner_at") + F.col("_offset"), F.when(new, F.col("_offset"))))
               .withColumn("_start0", F.when(new, F.col("_offset")).otherwise(F.max("_start").over(before)))
               .select(*part, "_prev_last", "_offset", "_seg0", "_start0"))
    pos = F.col("_offset") + F.col("_n") - 1
    seg = F.col(parent) if parent else F.col("_seg0") + F.col("_cuts")
    out = (rows.join(buckets, part)
           .withColumn("pos", pos.cast("long"))
           .withColumn("seg", seg.cast("long"))
           .withColumn("seg_pos", (pos - F.coalesce(F.col("_at") + F.col("_offset"), F.col("_start0"))).cast("long"))
           .withColumn("prev_ts", F.coalesce("_prev", "_prev_last")["ts"]))
    return out.drop("_bucket", "_k", "_prev", "_n", "_cut", "_cuts", "_at", "_prev_last", "_offset", "_seg0", "_start0")


def add_halo(df: DataFrame, back: int = 0, ahead: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk``, ``own`` and the in-chunk offset ``o``; edge rows are copied to neighbours.

    A row joins every chunk whose rows, widened by ``back`` and ``ahead``, contain it:
    about ``(back + ahead) / chunk_rows`` extra rows, whatever the data.
    """
    home = F.floor(F.col("pos") / F.lit(chunk_rows)).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - ahead) / F.lit(chunk_rows))).cast("long")
    last = F.floor((F.col("pos") + back) / F.lit(chunk_rows)).cast("long")
    chunk = F.explode(F.sequence(first, last)) if back or ahead else home
    return (df.withColumn("chunk", chunk).withColumn("own", F.col("chunk") == home)
            .withColumn("o", F.col("pos") - F.col("chunk") * chunk_rows + back))


def chunk_window(keys: Sequence[str] = KEYS) -> W:
    return W.partitionBy(*keys, "chunk", "seg").orderBy("pos")


def chunked(df: DataFrame, fn: Callable[[DataFrame, W], DataFrame], back: int = 0, ahead: int = 0,
            chunk_rows: int = CHUNK_ROWS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Run bounded-frame window code ``fn(df, window)`` on overlapping chunks.

    All windows share the partitioning (keys, chunk, seg), so Spark shuffles once
    however many features ``fn`` adds.  Rows that belong to a neighbour are dropped.
    """
    out = fn(add_halo(df, back, ahead, chunk_rows), chunk_window(keys))
    return out.filter("own").drop("chunk", "own", "o")


def running(df: DataFrame, specs: dict[str, tuple[str, Column]], *, by: Sequence[str] = ("symbol", "seg"),
            order: str = "pos", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Unbounded running aggregates (row included) of kinds sum, max, min, last, prev.

    ``last`` is the latest non-null value, ``prev`` the latest before the row.  Each chunk is scanned on its own; only
    one summary row per (by, chunk) is ordered globally.  Chunks are ``chunk_rows`` wide on the order axis where its
    density is bounded (positions); with None they hold about equal numbers of rows (``equal_depth``).
    """
    by = list(by)
    part = [*by, "_chunk"]
    df = equal_depth(df, by, order) if chunk_rows is None else df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_rows)))
    for name, (_, expr) in specs.items():
        df = df.withColumn(f"_in_{name}", expr)
    scan = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals, carries, local, final = [], [], [], []
    for name, (kind, _) in specs.items():
        src = F.col(f"_in_{name}")
        if kind in ("last", "prev"):
            totals.append(F.max_by(src, F.when(src.isNotNull(), F.col(order))).alias(f"_t_{name}"))
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(before).alias(f"_c_{name}"))
            rows = scan if kind == "last" else scan.rowsBetween(W.unboundedPreceding, -1)
            local.append(F.last(src, ignorenulls=True).over(rows).alias(f"_l_{name}"))
            final.append(F.coalesce(f"_l_{name}", f"_c_{name}").alias(name))
        else:
            agg = getattr(F, kind)
            totals.append(agg(src).alias(f"_t_{name}"))
            carries.append(agg(f"_t_{name}").over(before).alias(f"_c_{name}"))
            local.append(agg(src).over(scan).alias(f"_l_{name}"))
            both = F.col(f"_l_{name}"), F.col(f"_c_{name}")
            merged = (F.when(both[0].isNull() & both[1].isNull(), F.lit(None))
                      .otherwise(F.coalesce(both[0], F.lit(0)) + F.coalesce(both[1], F.lit(0)))
                      if kind == "sum" else (F.greatest(*both) if kind == "max" else F.least(*both)))
            final.append(merged.alias(name))
    carry = df.groupBy(*part).agg(*totals).select(*part, *carries)
    kept = [c for c in df.columns if not c.startswith("_in_") and c != "_chunk" and c not in specs]
    return (df.select("*", *local).join(carry, part, "left")
            .select(*kept, *final))


def equal_depth(df: DataFrame, by: Sequence[str], order: str, name: str = "_chunk") -> DataFrame:
    """Staged rows with a chunk number that never falls along (by, order); chunks hold about equal numbers of rows.

    The borders come from Spark's sampled range partitioning, so they follow the data: a busy hour of one key gets as
    many chunks as a quiet year, and there are as many as ``spark.sql.shuffle.partitions``.  Rows with equal (by, order)
    share a chunk.  The number is staged with the rows, since a second sampling could draw other borders.
    """
    from barloom.sources.stage import stage
    return stage(df.repartitionByRange(*by, order).withColumn(name, F.spark_partition_id()))


def islands(df: DataFrame, same_as_prev: Column, name: str = "run", **kw) -> DataFrame:
    """Number maximal runs: ``same_as_prev`` is true when a row continues the run."""
    return running(df, {name: ("sum", F.when(same_as_prev, 0).otherwise(1).cast("long"))}, **kw)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "idx", drop: Sequence[str] = ()) -> DataFrame:
    """0-based row number in a total ``order``, for any skew.

    Rows are range-partitioned and sorted on the whole order and staged with their partition id and place in it, without the columns ``drop``, so
    they are shuffled once and partitions stay balanced even if one day holds a third of the rows.  The number is the place plus the sizes of the
    earlier partitions (one row each).
    """
    from barloom.sources.stage import stage
    # the id holds the partition above 33 bits of the place in it
    parts = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).drop(*drop))
    part = F.shiftright("_id", 33)
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
               .select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o")))
    return (parts.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o")).cast("long")).drop("_part", "_id", "_o"))
