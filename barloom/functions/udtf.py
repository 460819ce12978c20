"""Table functions and SQL functions."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from barloom.sources.stage import stage


@udtf(returnType="path string, value string")
class FlattenJson:
    """JSON document to (path, value) leaves: dict keys dotted, list items as [i]."""

    def eval(self, text: str):
        import json
        if text is None:
            return
        stack = [("", json.loads(text))]
        while stack:
            path, node = stack.pop()
            if isinstance(node, dict):
                stack.extend((f"{path}.{k}" if path else k, v) for k, v in node.items())
            elif isinstance(node, list):
                stack.extend((f"{path}[{i}]", v) for i, v in enumerate(node))
            else:
                yield path, json.dumps(node)


def flatten_json_rows(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """(ids, path, value) leaves of JSON documents: VARIANT values, opened one depth at a time inside the JVM.

    Each depth is a generator over the rows that still hold objects or arrays; what is left to open is staged, so the
    plan does not grow with the depth and the loop ends at the deepest document.  A null or malformed document and empty
    objects and arrays have no leaves; of a repeated key the last value counts; a scalar document is one leaf with an empty path.
    Values are JSON again, numbers in shortest form (2.50 is 2.5).
    """
    # Spark refuses repeated keys unless told otherwise
    session = df.sparkSession
    session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    keep = [f"_id{i}" for i in range(len(ids))]
    kind = F.schema_of_variant("_v")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    level = df.select(*[F.col(c).alias(k) for c, k in zip(ids, keep)], F.lit("").alias("_path"), F.try_parse_json(text).alias("_v")).filter("_v is not null")
    leaves = []
    while True:
        level = stage(level.select(*keep, "_path", "_v", nested.alias("_open")))
        leaves.append(level.filter(~F.col("_open")).select(*[F.col(k).alias(c) for c, k in zip(ids, keep)], F.col("_path").alias("path"), F.to_json("_v").alias("value")))
        inner = level.filter("_open")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        inner = inner.lateralJoin(session.tvf.variant_explode(F.col("_v").outer()).toDF("_at", "_key", "_in"))
        dotted = F.when(F.col("_path") == "", F.col("_key")).otherwise(F.concat("_path", F.lit("."), "_key"))
        path = F.when(F.col("_key").isNull(), F.concat("_path", F.lit("["), F.col("_at").cast("string"), F.lit("]"))).otherwise(dotted)
        level = inner.select(*keep, path.alias("_path"), F.col("_in").alias("_v"))


# fixed values: scalar helpers registered for SQL; Catalyst inlines their bodies
SQL_FUNCTIONS = {
    "safe_ratio": "(n DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN CASE WHEN d <> 0 AND abs(n) < double('inf') AND abs(d) < double('inf') AND abs(try_divide(n, d)) < double('inf') THEN try_divide(n, d) END",
    "wilson_low": "(w DOUBLE, n DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN greatest(0.0D, (w / n + z * z / (2 * n) - z * sqrt(w / n * (1 - w / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END",
    "wilson_high": "(w DOUBLE, n DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN least(1.0D, (w / n + z * z / (2 * n) + z * sqrt(w / n * (1 - w / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END",
    "block_index": "(ts TIMESTAMP, zone STRING, minutes INT) RETURNS INT RETURN CAST(floor((hour(from_utc_timestamp(ts, zone)) * 60 + minute(from_utc_timestamp(ts, zone))) / minutes) AS INT)",
    "block_start": "(ts TIMESTAMP, zone STRING, minutes INT) RETURNS TIMESTAMP RETURN to_utc_timestamp(date_trunc('DAY', from_utc_timestamp(ts, zone)) + make_dt_interval(0, 0, minutes * CAST(floor((hour(from_utc_timestamp(ts, zone)) * 60 + minute(from_utc_timestamp(ts, zone))) / minutes) AS INT)), zone)",
}


def register_sql(spark: SparkSession) -> None:
    """Create the helpers as temporary SQL functions and the table function by name."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("flatten_json", FlattenJson)


def per_segment(df: DataFrame, fn, schema, by: Sequence[str] = ("symbol", "seg")) -> DataFrame:
    """Grouped-map escape hatch for automata over one continuity segment (pandas in, pandas out).

    Segments end at every gap; use it on thin rows only, the built-in operators need none.
    """
    return df.groupBy(*by).applyInPandas(fn, schema)
