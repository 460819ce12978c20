"""Group L: set operations, sorts, limits, nested values, pivots and strings."""
from pyspark.sql import Window as W, functions as F

from barloom.catalog.fixtures import H1, M15, bars, bars_sql, ep, indexed, indexed_sql, table

C = F.col


def register(cat):
    @cat.add("l01_union_tagged", f"WITH {bars_sql(M15)}, u AS (SELECT *, 'early' AS part FROM b WHERE ts < TIMESTAMP '2024-01-15 00:00:00' UNION ALL SELECT *, 'late' FROM b WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') SELECT part, symbol, count(*) AS n, round(sum(close), 2) AS total FROM u GROUP BY 1, 2", digits=2)
    def _(s, sf):
        b = indexed(s, sf, M15)
        u = b.filter("ts < '2024-01-15'").withColumn("part", F.lit("early")).unionByName(b.filter("ts >= '2024-01-10'").withColumn("part", F.lit("late")), allowMissingColumns=True)
        return u.groupBy("part", "symbol").agg(F.count("*").alias("n"), F.sum("close").alias("total"))

    @cat.add("l02_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
    def _(s, sf): return table(s, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount").distinct()

    @cat.add("l03_set_difference", "SELECT c_custkey AS k, 'only_customer' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT k, 'both' FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)")
    def _(s, sf):
        c, o = table(s, sf, "customer").select(C("c_custkey").alias("k")), table(s, sf, "orders").select(C("o_custkey").alias("k"))
        return c.subtract(o).withColumn("side", F.lit("only_customer")).unionByName(c.intersect(o).withColumn("side", F.lit("both")))

    @cat.add("l04_multi_key_sort", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_custkey DESC, o_orderkey")
    def _(s, sf): return table(s, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").orderBy("o_orderpriority", F.desc("o_custkey"), "o_orderkey")

    @cat.add("l05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
    def _(s, sf): return table(s, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)

    @cat.add("l05_top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
    def _(s, sf):
        # a row-number filter is a group limit: Spark keeps 3 rows per key before the shuffle
        rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
        return table(s, sf, "orders").withColumn("rn", rn).filter("rn <= 3").select("o_custkey", "o_orderkey")

    @cat.add("l06_nested_values", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, len(list_filter([value, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value * 2 END, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 1.0 END], lambda x: x IS NULL))::BIGINT AS nulls, CASE WHEN user_id % 3 = 0 THEN 'b' ELSE '' END || CASE WHEN user_id % 4 = 0 THEN 'c' ELSE '' END AS missing FROM events")
    def _(s, sf):
        e = table(s, sf, "events")
        vals = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (
            ("a", C("value")), ("b", F.when(C("user_id") % 3 != 0, C("value") * 2)), ("c", F.when(C("user_id") % 4 != 0, F.lit(1.0))))]))
        gone = F.map_keys(F.map_filter(vals, lambda k, v: v.isNull()))
        return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.size(gone).alias("nulls"), F.array_join(gone, "").alias("missing"))

    @cat.add("l07_pivot", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
    def _(s, sf): return table(s, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()

    @cat.add("l07_unpivot", "SELECT l_returnflag, metric, round(avg(v), 6) AS mean FROM (SELECT l_returnflag, unnest([{'metric': 'l_quantity', 'v': l_quantity}, {'metric': 'l_discount', 'v': l_discount}], recursive := true) FROM lineitem) GROUP BY 1, 2")
    def _(s, sf):
        u = table(s, sf, "lineitem").unpivot(["l_returnflag"], ["l_quantity", "l_discount"], "metric", "v")
        return u.groupBy("l_returnflag", "metric").agg(F.avg("v").alias("mean"))

    @cat.add("l08_strings", r"SELECT p_partkey, regexp_matches(upper(replace(p_brand, '#', '_')), '^[A-Z0-9_]+$') AS valid_id, regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g') AS safe_name, p_brand || '_TOUCH_' || p_size AS code FROM part")
    def _(s, sf):
        return table(s, sf, "part").select("p_partkey", F.upper(F.regexp_replace("p_brand", "#", "_")).rlike("^[A-Z0-9_]+$").alias("valid_id"),
                                           F.regexp_replace("p_type", "[^A-Za-z0-9]+", "_").alias("safe_name"), F.concat_ws("_TOUCH_", "p_brand", C("p_size").cast("string")).alias("code"))
