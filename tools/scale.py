"""One-off scale run of the event table: random-walk M15 bars with weekend gaps, staged first.

Not a registered query; it answers how the build grows with bars, beside the stored run
profile of 243,177 bars in 611 segments.
"""
import argparse, os, sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession, Window as W, functions as F
from barloom.operators.timeline import index_bars, running
from barloom.plans.event_table import build_event_table
from barloom.sources.stage import stage

ap = argparse.ArgumentParser()
ap.add_argument("--symbols", type=int, default=10)
ap.add_argument("--weeks", type=int, default=50)
ap.add_argument("--master", default="local[8]")
ap.add_argument("--partitions", default="16")
a = ap.parse_args()
spark = (SparkSession.builder.master(a.master).config("spark.sql.shuffle.partitions", a.partitions).config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "20g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
n = a.weeks * 480  # five trading days of 96 bars
d = spark.range(a.symbols * n).select(F.concat(F.lit("S"), (F.col("id") / n).cast("int").cast("string")).alias("symbol"), (F.col("id") % n).alias("k"))
d = d.withColumn("ts", F.timestamp_seconds(F.lit(1578265200) + F.floor(F.col("k") / 480) * 604800 + (F.col("k") % 480) * 900))
d = running(d.withColumn("step", F.randn(7) * 0.0004), {"x": ("sum", F.col("step"))}, by=("symbol",), order="k")
d = stage(d.select("symbol", "ts", "x", "step", (F.abs(F.randn(8)) * 0.0002).alias("u"), (F.abs(F.randn(9)) * 0.0002).alias("v")))
px = lambda x: F.exp(x)
o, c = px(F.col("x") - F.col("step")), px(F.col("x"))
bars = stage(d.select("symbol", "ts", o.alias("open"), (F.greatest(o, c) * (1 + F.col("u"))).alias("high"), (F.least(o, c) * (1 - F.col("v"))).alias("low"), c.alias("close"), F.lit(1).alias("tick_volume")))
t0 = time.time()
ix = stage(index_bars(bars, 900))
t1 = time.time()
events = stage(build_event_table(ix, 900))
t2 = time.time()
print(dict(bars=ix.count(), segments=ix.select("symbol", "seg").distinct().count(), events=events.count(), columns=len(events.columns),
           index_sec=round(t1 - t0, 1), build_sec=round(t2 - t1, 1), master=a.master))
