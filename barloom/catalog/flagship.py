"""The flagship: ticks to bars, segments, features, outcomes and a breakout study in one plan."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import CHUNK, M15, bars, ep, indexed_sql
from barloom.operators import outcomes as O, windows as X
from barloom.operators.stats import outcome_distribution
from barloom.operators.timeline import index_bars
from barloom.sources.stage import stage

C = F.col
FR = lambda a, b: f"OVER (PARTITION BY symbol, seg ORDER BY pos ROWS BETWEEN {a} AND {b})"


def register(cat):
    @cat.add("flagship_event_study", f"""WITH {indexed_sql(M15)}, f AS (SELECT *, CASE WHEN seg_pos >= 12 THEN close > max(high) {FR('12 PRECEDING', '1 PRECEDING')} END AS up, CASE WHEN seg_pos >= 12 THEN close < min(low) {FR('12 PRECEDING', '1 PRECEDING')} END AS down,
        CASE WHEN lead(pos, 4) OVER (PARTITION BY symbol, seg ORDER BY pos) IS NOT NULL THEN (lead(close, 4) OVER (PARTITION BY symbol, seg ORDER BY pos) - close) / close END AS r FROM x), k AS (SELECT *, CASE WHEN up THEN 'BREAKOUT_HIGH' WHEN down THEN 'BREAKOUT_LOW' WHEN up IS NULL THEN 'WARM_UP' ELSE 'INSIDE' END AS cohort FROM f)
        SELECT symbol, cohort, count(*) AS n, count(r) AS observed, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75), 6) AS q75, round(count(*) FILTER (r > 0) / nullif(count(r), 0), 6) AS positive_fraction FROM k GROUP BY 1, 2""")
    def _(s, sf):
        x = stage(index_bars(stage(bars(s, sf, M15)), M15, bucket_rows=1024))
        d = O.forward_outcomes(X.with_lags(x, CHUNK), (4,), chunk_rows=CHUNK)
        cohort = (F.when(C("breakout_high_12"), "BREAKOUT_HIGH").when(C("breakout_low_12"), "BREAKOUT_LOW").when(C("breakout_high_12").isNull(), "WARM_UP").otherwise("INSIDE"))
        d = d.select("symbol", cohort.alias("cohort"), C("h4.close_return_fraction").alias("r"))
        return outcome_distribution(d, ["symbol", "cohort"], "r").select("symbol", "cohort", "n", "observed", "mean", "q25", "median", "q75", "positive_fraction")
