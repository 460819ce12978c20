"""Files, hour blobs, archive merge, stage, quality on hot groups."""
import gzip
import json
import lzma
import os
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.udtf import flatten_json_rows
from barloom.operators import quality as Q
from barloom.sources import files as A, ticks as K
from barloom.sources.stage import stage


def test_read_csv_gz_with_mapping(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("when,b,a\n2024-01-01T00:00:00Z,1.5,1.6\nbad,x,1.7\n")
    d = A.read_market_files(spark, [str(tmp_path / "a.csv.gz")], {"ts": "when", "bid": "b", "ask": "a"}, header=["when", "b", "a"]).orderBy("seq").collect()
    assert d[0].bid == 1.5 and d[0].ts is not None and d[1].ts is None and d[1].bid is None and d[1].raw.b == "x"


def test_hour_blobs(spark, tmp_path):
    def put(rel, rows, raw=None):
        p = tmp_path / rel
        os.makedirs(p.parent, exist_ok=True)
        body = b"".join(struct.pack(">IIIff", *r) for r in rows) if raw is None else raw
        p.write_bytes(lzma.compress(body, format=lzma.FORMAT_ALONE))
    put("EURUSD/2024/00/02/10h_ticks.bi5", [(0, 110010, 110000, 1.0, 2.0), (5, 110020, 110010, 1.0, 2.0)])
    put("EURUSD/2024/00/02/11h_ticks.bi5", [(9, 110010, 110000, 1.0, 2.0), (5, 110020, 110010, 1.0, 2.0)])
    put("EURUSD/2024/00/02/12h_ticks.bi5", [(9, 110000, 110010, 1.0, 2.0)])
    put("EURUSD/2024/00/02/13h_ticks.bi5", [], raw=b"123")
    put("EURUSD/2024/00/06/13h_ticks.bi5", [])  # a Saturday
    (tmp_path / "EURUSD/2024/00/02/14h_ticks.bi5").write_bytes(b"junk" * 9)
    d = K.read_hour_blobs(spark, str(tmp_path)).toPandas()
    good = d[d.fault.isna()].sort_values("seq")
    assert good.bid.tolist() == [1.1, 1.1001] and good.ts.iloc[1] == pd.Timestamp("2024-01-02 10:00:00.005")
    assert sorted(d.fault.dropna()) == ["BACKWARD", "CROSSED", "NOT_LZMA", "TRUNCATED"]


def bars(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "close"]).assign(ts=lambda p: pd.to_datetime(p.ts)))


def test_archive_merge_is_idempotent_and_quarantines(spark, tmp_path):
    path, bad = str(tmp_path / "archive"), str(tmp_path / "bad")
    first = bars(spark, [("A", "2024-01-31 23:59", 1.0), ("A", "2024-02-01 00:00", 2.0)])
    assert A.write_bars_monthly(first, path, bad) == 0
    assert A.write_bars_monthly(first.unionByName(bars(spark, [("A", "2024-02-01 00:01", 3.0)])), path, bad) == 0
    assert spark.read.parquet(path).count() == 3
    assert A.write_bars_monthly(bars(spark, [("A", "2024-02-01 00:01", 9.0)]), path, bad) == 1
    assert spark.read.parquet(path).count() == 3 and spark.read.parquet(bad).count() == 2


def test_sanitize_with_a_third_of_rows_at_one_instant(spark):
    n = 3000
    d = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("seq"), F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")) * 60).alias("ts"),
                              *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("tick_volume"))
    got = dict(Q.sanitize(d, 60).groupBy("classification").count().collect())
    assert got == {"VALID": 2001, "DUPLICATE_IDENTICAL": 999}


def test_fingerprint_ignores_partitioning(spark):
    d = spark.range(5000).withColumn("v", F.col("id") * 1.5)
    a, b = (A.table_fingerprint(d.repartition(k), "id").first() for k in (1, 7))
    c = A.table_fingerprint(d.withColumn("v", F.when(F.col("id") == 4999, 0.0).otherwise(F.col("v"))), "id").first()
    assert a == b and a.rows == 5000 and a.fingerprint != c.fingerprint


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    p = str(tmp_path / "f")
    spark.range(100).select(F.timestamp_seconds("id").alias("ts"), "id", F.lit("x").alias("pad")).write.parquet(p)
    d = A.read_features(spark, p, ["id"], "1970-01-01 00:00:10", "1970-01-01 00:00:20")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 10 and "GreaterThanOrEqual(ts" in plan and "pad" not in plan.split("ReadSchema")[1]


def test_stage_keeps_schema(spark):
    d = spark.range(3).withColumn("s", F.struct("id"))
    assert stage(d).schema.simpleString() == d.schema.simpleString()


def test_hash_chain(spark):
    import hashlib
    prev, rows = "0" * 64, []
    for i in range(50):
        h = hashlib.sha256((prev + f"c{i}").encode()).hexdigest()
        rows.append([i, f"c{i}", prev, h])
        prev = h
    rows[20][1] = "forged"
    rows[30][2] = "broken"
    d = spark.createDataFrame(rows, "seq long, content string, previous_hash string, entry_hash string")
    got = {r.seq: r.fault for r in Q.verify_hash_chain(d, size=7).collect()}
    assert got == {20: "BAD_HASH", 30: "BROKEN_LINK"}


def test_outcome_guard(spark):
    from barloom.plans.event_table import field_catalog, predictors_only
    d = spark.range(1).select(F.col("id").alias("x.a"), F.col("id").alias("y.h1.close_change"))
    assert [r for _, r, _ in field_catalog(d)] == ["PREDICTOR", "TARGET"]
    for bad in (d, spark.range(1).select(F.col("id").alias("x.mfe"))):
        with pytest.raises(ValueError):
            predictors_only(bad)


def test_import_counters(spark):
    from barloom.operators import quality as Q
    rows = [("S", 1, 1.10000, 1.10008, "a"), ("S", 1, 1.10001, 1.10008, "a"), ("S", 1, 1.10000, 1.10008, "b"), ("S", 2, None, 1.1, "a"), ("S", 2, -1.0, 1.1, "a"),
            ("S", 3, 1.2, 1.1, "a"), ("S", None, 1.1, 1.2, "a")]
    d = spark.createDataFrame(rows, "symbol string, t long, bid double, ask double, file string").withColumn("ts", F.timestamp_seconds("t"))
    got = Q.import_counters(d).first()
    assert (got.rows_read, got.invalid_quotes, got.crossed_quotes, got.rows_rejected, got.rows_accepted, got.duplicate_events, got.cross_file_keys) == (7, 3, 1, 4, 3, 1, 1)


def test_small_spreads_are_kept(spark):
    from barloom.sources.ticks import ticks_to_bars
    d = spark.createDataFrame([("S", 1, 1.10000, 1.10008)], "symbol string, seq long, bid double, ask double").withColumn("ts", F.timestamp_seconds("seq"))
    assert ticks_to_bars(d, 900).first().spread == pytest.approx(0.00008)


def test_upsert_looks_inside_the_batch(spark):
    from barloom.operators import history as H
    kind = "candidate_id string, fingerprint string, content string"
    memory = spark.createDataFrame([("m", "f0", "x")], kind)
    inc = spark.createDataFrame([("a", "f1", "x"), ("a", "f1", "y"), ("b", "f2", "x"), ("c", "f2", "x"), ("d", "f0", "x"), ("m", "f0", "x"), ("e", "f3", "x"), ("e", "f3", "x")], kind)
    d = H.memory_upsert(memory, inc)
    assert {(r.candidate_id, r.action) for r in d.collect()} == {("a", "CONFLICT"), ("b", "NEW"), ("c", "DUPLICATE_FINGERPRINT"), ("d", "DUPLICATE_FINGERPRINT"), ("m", "NO_OP"), ("e", "NEW")}
    assert sorted(r.candidate_id for r in H.apply_upsert(memory, d.filter("action <> 'CONFLICT'")).collect()) == ["b", "e", "m"]


def test_json_leaves_by_depth(spark):
    def leaves(path, node):
        if isinstance(node, dict):
            return [x for k, v in node.items() for x in leaves(f"{path}.{k}" if path else k, v)]
        if isinstance(node, list):
            return [x for i, v in enumerate(node) for x in leaves(f"{path}[{i}]", v)]
        return [(path, node)]
    texts = ['{"a":1,"b":{"c":[1,2.5,{"d":"x\\"y"}],"e":null},"f":[],"g":{}}', None, "{bad", "7", "[true,1e3,12345678901234567890,\"é\"]", "null", '{"a.b":{"":1}}', "", "[" * 30 + "1" + "]" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "path long, text string")  # an id column with the name of a result column
    out = flatten_json_rows(df.withColumnRenamed("path", "value_of"), "text", ["value_of"])
    assert "Python" not in out._jdf.queryExecution().toString()
    got = sorted((r.value_of, r.path, json.loads(r.value)) for r in out.collect() if r.value is not None)
    want = sorted(((i, p, v) for i, t in enumerate(texts) if t and t != "{bad" for p, v in leaves("", json.loads(t))), key=lambda x: x[:2])
    assert sorted(got, key=lambda x: x[:2]) == want
    assert flatten_json_rows(df.limit(0), "text", ["path"]).count() == 0


def test_lost_instants_split_every_bar(spark):
    rows = [(k, t, 1.0, 2.0, 0.5, 1.5, t or 0) for k in "AB" for t in [*range(0, 3600 * 6, 3600), 3600 * 9]] + [("A", None, 1.0, 2.0, 0.5, 1.5, 99)]
    raw = spark.createDataFrame(rows, "symbol string, s long, open double, high double, low double, close double, seq long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    seg, gaps = Q.gap_inventory(Q.sanitize(raw, 3600), 3600)
    got = seg.orderBy("symbol", "ts").select("symbol", "seg", "seg_pos").collect()
    assert [(r.seg, r.seg_pos) for r in got if r.symbol == "A"] == [(i, 0) for i in range(7)]
    assert [(r.seg, r.seg_pos) for r in got if r.symbol == "B"] == [(0, i) for i in range(6)] + [(1, 0)]
    assert sorted((r.symbol, r.missing_slots, r.next_segment_id) for r in gaps.collect()) == [("A", 3, 1), ("B", 3, 1)]
