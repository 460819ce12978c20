"""Queries that are sent to a shard and reach their floor with none of its vectors."""
from pyspark.sql import functions as F

from barloom.llm import vector_search


def test_a_shard_without_a_hit(spark):
    rows = [(50, [10.0, 10.0])] + [(i, [10.5, 8.5]) for i in range(1, 9)] + [(i, [13.45, 0.0]) for i in range(11, 20)]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, shard_rows=9).collect()
    assert sorted(tuple(r) for r in got) == [(50, i, i, 190 * 65536) for i in range(1, 6)]
