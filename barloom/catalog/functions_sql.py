"""Group N: SQL functions, table functions and the grouped-map hatch."""
from pyspark.sql import functions as F

from barloom.catalog.fixtures import H1, M15, ep, indexed, indexed_sql, table, ticks
from barloom.functions.udtf import per_segment, register_sql

C = F.col


def register(cat):
    @cat.add("n02_sql_functions", "SELECT event_id, round(value / nullif(user_id % 5, 0), 6) AS ratio, floor(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') / 3)::BIGINT AS block FROM events")
    def _(s, sf):
        table(s, sf, "events").createOrReplaceTempView("events_n02")
        register_sql(s)
        return s.sql("SELECT event_id, safe_ratio(value, CAST(user_id % 5 AS DOUBLE)) AS ratio, block_index(CAST(ts AS TIMESTAMP), 'America/New_York', 180) AS block FROM events_n02")

    @cat.add("n03_flatten_json_sql", "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
    def _(s, sf):
        table(s, sf, "events").createOrReplaceTempView("events_n03")
        register_sql(s)
        return s.sql("SELECT e.event_id, t.path, t.value FROM events_n03 e, LATERAL flatten_json(e.props) t")

    @cat.add("n01_per_segment", f"WITH {indexed_sql(M15)}, d AS (SELECT symbol, seg, count(*) AS bars, sum(CASE WHEN seg_pos > 0 AND close > pc THEN 1 ELSE 0 END) AS rises FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, seg ORDER BY pos) AS pc FROM x) GROUP BY 1, 2) SELECT symbol, seg, bars, rises::BIGINT AS rises FROM d")
    def _(s, sf):
        def walk(pdf):
            import pandas as pd
            p = pdf.sort_values("pos")
            return pd.DataFrame([dict(symbol=p.symbol.iloc[0], seg=p.seg.iloc[0], bars=len(p), rises=int((p.close.diff() > 0).sum()))])
        return per_segment(indexed(s, sf, M15).select("symbol", "seg", "pos", "close"), walk, "symbol string, seg long, bars long, rises long")
