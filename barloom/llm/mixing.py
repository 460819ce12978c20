"""Mixing sources to target weights: a time-varying curriculum in DataFrame functions only.

Each source gets a target of words: weights share the budget, a target stops at ``max_passes`` times its source's size and the excess goes to
the others by weight. Its weight over training time is a piecewise linear schedule. The integral of that schedule is the source's cumulative
demand; documents fill the demand in the order of a hash of their id, pass after pass, and the inverse of the integral gives the training
position (0 to 1) at which a document is due. ``mix`` range-sorts by it.

Defined cases: null or word-less text has size 0 and is never taken (position null); a null source is a source of its own, sorted last; rows
with equal id take their turns one after the other; an empty table gives an empty result. Only the document at which a source's budget ends is
taken in part. Nothing depends on partitioning, so reruns agree.

Hot sources are cut into buckets of the hash; prefix sums are per bucket plus one sum per earlier bucket, so no task holds a source.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.llm.common import C, WORD
from barloom.sources.stage import stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_PASSES = 2
#: (time, relative weight) knots per weight class: the first fades out, the second stays, the third comes in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
ROWS_PER_BUCKET = 8192


def _key(source: Column) -> Column:
    """Sorts like the source by code point with null last, and has no nulls."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """(skey, source_size, rank, target) of each source from rows (skey, size): one row per source.

    Sources are full in the order of capacity over weight; the level at which the rest of the budget meets the rest of the weights is found
    by prefix sums over that order: it is the highest one that its source doesn't fill up below.
    """
    n = len(weights)
    s = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy("skey")) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (C("rank") % n + 1).cast("int"))).withColumn("cap", C("source_size") * max_passes)
    by_fill = W.orderBy(C("cap") / C("weight"), "skey")
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"budget": F.sum("source_size").over(everything) * F.lit(share), "all_weight": F.sum("weight").over(everything),
                       "full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "spent_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    s = s.withColumn("level", (C("budget") - C("full")) / (C("all_weight") - C("spent_weight")))
    s = s.withColumn("water", F.max(F.when(C("cap") / C("weight") >= C("level"), C("level"))).over(everything))
    return s.select("skey", "source_size", "n_rows", "rank", F.when(C("water").isNull(), C("cap").cast("double")).otherwise(F.least(C("cap").cast("double"), C("water") * C("weight"))).alias("target"))


def position_at(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the integral of the schedule reaches ``fraction`` of its total."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        r = fraction * total - done
        t = F.lit(t0) + 2 * r / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * r * ((w1 - w0) / (t1 - t0)))))
        done += area
        out = F.when(fraction * total <= done, t) if out is None else out.when(fraction * total <= done, t)
    return out.otherwise(F.lit(float(knots[-1][0])))


def _places(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, max_passes, carry: bool) -> DataFrame:
    """Rows with size, source_size, target, take (words of the source's target), before (words of its source before it) and taken."""
    text = C(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    own = [C(id_col).alias("doc_id"), _key(C(source_col)).alias("skey"), size.alias("size"), F.md5(F.coalesce(C(id_col).cast("string"), F.lit(""))).alias("key")]
    rows = stage(docs.select(*own, *[F.struct("*").alias("row")] * carry))
    sources = stage(source_targets(rows.select("skey", "size"), weights, share, max_passes))
    digits = 0
    while rows.count() > ROWS_PER_BUCKET << 4 * digits:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    at = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("words").over(at), F.lit(0))).join(sources, "skey").select("skey", "bucket", "earlier", "source_size", "rank", "target")
    ties = [C("row")[c] for c, kind in docs.dtypes if carry and c in (text_col,)]
    inner = W.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size", *ties).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["skey", "bucket"])
    placed = placed.withColumns({"before": C("earlier") + C("inner"), "take": F.floor(C("target") + 0.5)})
    full = F.when(C("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0))
    rest = C("take") - full * C("source_size")
    return placed.withColumns({"full": full, "part": F.greatest(F.lit(0), F.least(C("size"), rest - C("before")))}).withColumn("taken", C("full") * C("size") + C("part"))


def _position(taken_before: Column, schedules) -> Column:
    out, n = None, len(schedules)
    for i, knots in enumerate(schedules):
        t = position_at(taken_before / C("take"), knots)
        out = F.when(C("rank") % n == i, t) if out is None else out.when(C("rank") % n == i, t)
    return out


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
             share: float = SHARE, max_passes: int = MAX_PASSES, schedules=SCHEDULES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position and positions (training position of its first pass and those of
    all its passes; null if never taken). Range-sorted by position, the untaken first."""
    placed = _places(docs, id_col, text_col, source_col, weights, share, max_passes, False)
    last = C("full").cast("long") - F.when(C("part") > 0, 0).otherwise(1)
    due = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda p: _position(p * C("source_size") + C("before"), schedules))
    rows = placed.withColumn("positions", F.when(C("taken") > 0, due)).select("doc_id", "size", "source_size", "target", "taken", C("positions")[0].alias("position"), "positions")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, max_passes: int = MAX_PASSES, schedules=SCHEDULES, with_position: bool = False) -> DataFrame:
    """The mixed corpus in training order: a row of ``docs`` for each pass. A pass taken in part has the text up to its last taken word."""
    placed = _places(docs, id_col, text_col, source_col, weights, share, max_passes, True)
    passes = F.explode(F.expr("sequence(0L, CAST(full AS BIGINT))")).alias("pass")
    due = placed.select("row", "size", "before", "source_size", "take", "rank", "full", "part", passes)
    due = due.withColumn("words", F.when(C("pass") < C("full"), C("size")).otherwise(C("part"))).filter("words > 0")
    due = due.withColumn("position", _position(C("pass") * C("source_size") + C("before"), schedules))
    words = F.array_join(F.slice(F.regexp_extract_all(C("_row")[text_col], F.lit(f"({WORD})"), 1), 1, C("words").cast("int")), " ")
    text = F.when(C("words") < C("size"), words).otherwise(C("_row")[text_col])
    order = ["position", f"_row.{id_col}", "pass"]
    out = due.withColumnRenamed("row", "_row").withColumn("_text", text).repartitionByRange(*order).sortWithinPartitions(*order)
    cols = [C("_text").alias(c) if c == text_col else C("_row")[c].alias(c) for c in docs.columns]
    return out.select(*cols, *[C("position").alias("mix_position")] * with_position)


SQL = r"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) - 1 AS rnk FROM d GROUP BY skey),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rnk % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight,
  coalesce(sum(cap) OVER b, 0)::BIGINT AS filled, coalesce(sum(weight) OVER b, 0) AS spent
  FROM w WINDOW b AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - filled) / (all_weight - spent) AS lvl FROM f),
m AS (SELECT *, max(CASE WHEN cap / weight >= lvl THEN lvl END) OVER () AS water FROM l),
t AS (SELECT skey, source_size, CASE WHEN water IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, water * weight) END AS target FROM m),
p AS (SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS take,
  coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM d JOIN t ON d.skey = t.skey),
q AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS passes FROM p),
r AS (SELECT q.*, rnk, greatest(0, least(size, take - passes * q.source_size - bef)) AS part, bef::DOUBLE / nullif(take, 0)::DOUBLE AS f1, (bef + q.source_size)::DOUBLE / nullif(take, 0)::DOUBLE AS f2 FROM q JOIN s USING (skey)),
x AS (SELECT *, (passes * size + part)::BIGINT AS taken, CASE WHEN size > 0 THEN passes + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS n FROM r)
SELECT doc_id, size, source_size, target, taken, CASE WHEN n >= 1 THEN round({f1}, 6) END AS position, CASE WHEN n >= 2 THEN round({f2}, 6) END AS position_2 FROM x"""
#: The inverse of each schedule's integral, written out.
_AT = """CASE rnk % 3 WHEN 0 THEN 2 * {f} / (1.5::DOUBLE + sqrt(greatest(0, 2.25::DOUBLE - 2 * {f}))) WHEN 1 THEN 2 * {f} / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
  ELSE CASE WHEN {f} <= 0.3125 THEN 2 * {f} / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * {f} * 0.5::DOUBLE)) ELSE 0.5::DOUBLE + 2 * ({f} - 0.3125::DOUBLE) / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + 2 * ({f} - 0.3125::DOUBLE) * 2.5::DOUBLE)) END END"""
for _f in ("f1", "f2"):
    SQL = SQL.replace("{%s}" % _f, _AT.replace("{f}", _f))
